"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import hold as hold
from ..shared import materialize as materialize
from ..shared import tidy as tidy

#: Words in every contract here are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Those names, with underscores before each until df has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """spark, whose Arrow and Parquet batches hold few rows and bytes from now on. For applications, not for operators.

    The JVM keeps the direct memory of the largest batches for good, and texts are long: 4096 of them make arrays of tens of MB on the heap.
    """
    conf = spark.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1024), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20), ("spark.sql.parquet.columnarReaderBatchSize", 512)):
        now = conf.get(key, None)
        number = int(re.match(r"-?[0-9]+", now)[0]) if now else 0
        if number <= 0 or number > most or (now and not now.rstrip("b").isdigit()):
            conf.set(key, str(most))
    return spark


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices: Python objects of long texts then take little memory at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """A broadcast hint, given only when the counted rows are few; else Spark joins by shuffle."""
    return F.broadcast(df) if rows <= most else df


def numbered(rows: DataFrame, alike: str, nth: str, most: int, block: int = 4096) -> DataFrame:
    """Each row of rows as often as its column `alike` (at most `most`) says, numbered from 0 in a column `nth`.

    A row that stands for very many is spread over tasks by blocks of them.
    """
    first = "_first_" + nth
    spread = rows.withColumn(first, F.explode(F.sequence(F.lit(0).cast("long"), F.col(alike) - 1, F.lit(block).cast("long"))))
    if most > block:
        spread = spread.repartition(F.xxhash64(*[c for c in rows.columns if c != alike], first))
    return spread.withColumn(nth, F.explode(F.sequence(F.col(first), F.least(F.col(first) + block, F.col(alike)) - 1))).drop(first, alike)
