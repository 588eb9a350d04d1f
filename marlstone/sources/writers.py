"""JSON sinks, and the keyed store of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import number_array


def request_json(row: Column) -> Column:
    """A transaction struct as JSON; a missing last transaction is written as null."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def reference_json(vector: Column, label: Column) -> Column:
    """Numbers without floating-point noise."""
    return F.concat(F.lit('{"vector":'), number_array(vector), F.lit(',"label":'), F.to_json(label.cast("variant")), F.lit("}"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON document a line, nulls written."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_document(df: DataFrame, path: str, pretty: bool = False) -> None:
    """A frame of one row as one JSON document."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})
    df.limit(1).select(row.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_test_file(entries: DataFrame, checksum: str, stats: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON document: checksum, stats (a row) and entries (idx, request, expected_approved, expected_fraud_score) in the order of idx.

    Rows are sorted in parallel and streamed through one writer, as one document is one file; nothing is collected but the stats.
    """
    how = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    head = stats.select(F.to_json(F.struct(F.lit(checksum).alias("references_checksum_sha256"), F.struct(*stats.columns).alias("stats")), how)).first()[0]
    one = F.to_json(F.struct("request", "expected_approved", "expected_fraud_score"), how)
    first = entries.agg(F.min("idx")).first()[0]
    body = entries.select(F.col("idx").cast("long").alias("at"), F.concat(F.when(F.col("idx") == F.lit(first), "").otherwise(","), one).alias("value"))
    spark = entries.sparkSession
    edges = spark.createDataFrame([(-1, head.rstrip().removesuffix("}") + ',"entries":['), ((1 << 63) - 1, "]}")], "at long, value string")
    body.unionByName(edges).orderBy("at").select("value").coalesce(1).write.mode("overwrite").text(path)


def upsert(store: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """store with the rows of new in place of those with the same keys (nulls equal), and the rest of new added.

    Of rows of new with the same keys the last holds: by the column `order`, else by all other columns.
    """
    others = [c for c in new.columns if c not in keys]
    if others:
        by = F.struct(*([order] if order else []), *others)
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("_last")).select(*keys, "_last.*").select(*new.columns)
    else:
        new = new.distinct()
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    condition = same[0]
    for s in same[1:]:
        condition &= s
    kept = store.alias("o").join(new.select(*keys).alias("n"), condition, "left_anti")
    return kept.unionByName(new)
