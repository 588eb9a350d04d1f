"""Votes of the nearest neighbors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NEIGHBORS, THRESHOLD
from ..functions.scalar import approved, is_fraud, round4


def vote(neighbors: DataFrame, queries: DataFrame | None = None, k: int = NEIGHBORS, threshold: float = THRESHOLD) -> DataFrame:
    """idx, votes, fraud_score, approved. The divisor is k even where fewer neighbors were found.

    With `queries` (idx), a query without neighbors scores 0.
    """
    votes = neighbors.groupBy("idx").agg(F.count_if(is_fraud(F.col("label"))).alias("votes"))
    if queries is not None:
        votes = queries.select("idx").join(votes, "idx", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    score = round4(F.col("votes") / F.lit(float(k)))
    return votes.withColumn("fraud_score", score).withColumn("approved", approved(F.col("fraud_score"), threshold))


def majority(neighbors: DataFrame) -> DataFrame:
    """idx, share of fraud among the neighbors found, whether they are more than half."""
    share = neighbors.groupBy("idx").agg(F.avg(is_fraud(F.col("label")).cast("double")).alias("share"))
    return share.withColumn("fraud", F.col("share") > 0.5)


def weighted(neighbors: DataFrame, epsilon: float = 1e-6, root: bool = True) -> DataFrame:
    """idx, score: fraud's share of the weights 1 / (epsilon + distance); root: the distances are squared."""
    d = F.sqrt("distance") if root else F.col("distance")
    w = F.lit(1.0) / (F.lit(epsilon) + d)
    return neighbors.groupBy("idx").agg((F.sum(w * is_fraud(F.col("label")).cast("double")) / F.sum(w)).alias("score"))
