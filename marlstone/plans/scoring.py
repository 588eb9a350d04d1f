"""The three pipelines: label a batch, decide on transactions, evaluate decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NEIGHBORS, Normalization
from ..operators import evaluate
from ..operators.knn import knn
from ..operators.vectorize import vectorize
from ..operators.vote import vote
from ..sources.writers import write_test_file


def decide(transactions: DataFrame, refs: DataFrame, k: int = NEIGHBORS, plan: str = "buckets", risks: dict[str, float] | None = None, norm: Normalization | None = None) -> DataFrame:
    """idx, fraud_score, approved for transactions (idx and the payload's columns)."""
    queries = vectorize(transactions, risks, norm).select("idx", "vector")
    return vote(knn(queries, refs, k, plan=plan), queries, k).select("idx", "fraud_score", "approved")


def label(transactions: DataFrame, refs: DataFrame, **how) -> DataFrame:
    """transactions with expected_fraud_score and expected_approved, from their exact neighbors."""
    found = decide(transactions, refs, **how).withColumnsRenamed({"fraud_score": "expected_fraud_score", "approved": "expected_approved"})
    return transactions.join(found, "idx")


def write_labeled(labeled: DataFrame, checksum: str, path: str, pretty: bool = False) -> None:
    """A test file of labeled transactions (as `label` returns them): envelope and entries in the order of idx."""
    stats = evaluate.stats(labeled.select(F.col("expected_fraud_score").alias("fraud_score"), F.col("expected_approved").alias("approved")))
    stats = stats.select("total", "fraud_count", "legit_count", "fraud_rate", "legit_rate", "edge_case_count", "edge_case_rate")
    payload = F.struct("id", "transaction", "customer", "merchant", "terminal", "last_transaction").alias("request")
    write_test_file(labeled.select("idx", payload, "expected_approved", "expected_fraud_score"), checksum, stats, path, pretty)


def evaluate_run(expected: DataFrame, responses: DataFrame, timeout_ms: float = 2001.0) -> DataFrame:
    """The result document over expected (idx, expected_approved) and responses (idx, approved, status, duration_ms)."""
    return evaluate.result(evaluate.judge(expected, responses, timeout_ms))


def classifier(training: DataFrame, seed: int = 1):
    """Another way to decide: logistic regression over (vector, label). The fitted pipeline adds `probability` and `prediction`."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rows = training.select(array_to_vector("vector").alias("features"), (F.col("label") == "fraud").cast("double").alias("target"))
    return Pipeline(stages=[LogisticRegression(labelCol="target", maxIter=50)]).fit(rows)
