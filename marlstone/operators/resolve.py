"""Submissions: the default of an owner, and the store of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.writers import upsert


def first_of(rows: DataFrame, owner: str, position: str, value: str) -> DataFrame:
    """owner, first: the value at the least position of each owner; combined before the shuffle."""
    return rows.groupBy(owner).agg(F.min_by(value, position).alias("first"))


def resolve(requests: DataFrame, participants: DataFrame) -> DataFrame:
    """requests (owner, submission) with `default` replaced by the owner's first id; null if there is none."""
    first = first_of(participants, "owner", "pos", "id")
    chosen = F.when(F.col("submission") == "default", F.col("first")).otherwise(F.col("submission"))
    return requests.join(first, "owner", "left").withColumn("submission", chosen).drop("first")


def store_results(store: DataFrame, results: DataFrame) -> DataFrame:
    """Keyed by owner and submission; an id may occur under several owners."""
    return upsert(store, results, ["owner", "submission"])
