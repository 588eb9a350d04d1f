"""Decisions on a stream of transactions, and running counts of their outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import NEIGHBORS, THRESHOLD
from ..functions.scalar import approved, round4
from ..operators.boxes import Boxes
from ..operators.vectorize import vectorize
from ..shared import drop, written

#: Bytes of references that the driver and each worker hold: 8 a dimension, 17 for the id, the place and the label. Beyond it use `decide_each_batch`.
MOST_HELD = 512 << 20


def arrivals(spark: SparkSession, path: str, files_a_trigger: int = 1) -> DataFrame:
    """Transactions from JSON lines that appear in a folder."""
    return spark.readStream.schema(schemas.PAYLOAD).option("maxFilesPerTrigger", files_a_trigger).json(path)


def ramping(spark: SparkSession, rate: int, ramp_seconds: int, partitions: int = 2) -> DataFrame:
    """An open arrival process: timestamp and value, up to `rate` a second after the ramp, dealt round robin."""
    return spark.readStream.format("rate").option("rowsPerSecond", rate).option("rampUpTime", f"{ramp_seconds}s").option("numPartitions", partitions).load()


def dealt(stream: DataFrame, workers: int) -> DataFrame:
    """A stream whose rows go round robin to that many tasks a batch."""
    return stream.repartition(workers)


def _extent(refs: DataFrame) -> tuple[int, int]:
    return tuple(refs.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(14))).first())


def _bytes(n: int, dims: int) -> int:
    return n * (8 * dims + 17)


def fits(refs: DataFrame) -> bool:
    """Whether score_stream holds these references with ease: a quarter of MOST_HELD. Beyond it drain_batches asks less of the driver and of each worker."""
    return _bytes(*_extent(refs)) <= MOST_HELD // 4


def score_stream(transactions: DataFrame, refs: DataFrame, k: int = NEIGHBORS, threshold: float = THRESHOLD) -> DataFrame:
    """id, fraud_score, approved of a stream: stateless, each event alone. refs (ref_id, vector, label) is held by every worker.

    Their size is checked against MOST_HELD first; they come as Arrow columns, without a Python object each, and are searched by boxes.
    """
    n, dims = _extent(refs)
    if _bytes(n, dims) > MOST_HELD:
        raise ValueError(f"{n} references of {dims} dimensions; score_stream holds {MOST_HELD} bytes at most: use decide_each_batch")
    held = refs.select("ref_id", (F.col("label") == "fraud").alias("fraud"), *[F.get("vector", F.lit(i)).cast("double").alias(f"d{i}") for i in range(dims)]).toArrow()
    x = np.empty((n, dims))
    for i in range(dims):
        x[:, i] = held[f"d{i}"].to_numpy()
    ids, fraud = held["ref_id"].to_numpy(), held["fraud"].to_numpy().astype(bool)
    del held
    # The others are at no distance that is a number.
    fine = np.isfinite(x).all(axis=1)
    if not fine.all():
        x, ids, fraud = x[fine], ids[fine], fraud[fine]
    sent = refs.sparkSession.sparkContext.broadcast((Boxes(x, ids), fraud))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes, fraud = sent.value
        for pdf in batches:
            votes = np.zeros(len(pdf))
            if len(pdf):
                row, col, _ = boxes.search(np.stack([np.asarray(v, float) for v in pdf["vector"]]), k)
                votes = np.bincount(row, weights=fraud[col], minlength=len(pdf)).astype(float)
            yield pd.DataFrame({"id": pdf["id"], "votes": votes})

    scored = vectorize(transactions).select("id", "vector").mapInPandas(run, "id string, votes double")
    out = scored.withColumn("fraud_score", round4(F.col("votes") / F.lit(float(k))))
    return out.select("id", "fraud_score", approved(F.col("fraud_score"), threshold).alias("approved"))


def decide_each_batch(transactions: DataFrame, refs: DataFrame, sink, **how):
    """A writer that decides micro-batch by micro-batch with the batch plans; sink(decisions, epoch) must be idempotent by epoch."""
    from ..plans.scoring import decide

    def each(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("idx", F.monotonically_increasing_id())
        rows = rows.persist()
        sink(rows.select("idx", "id").join(decide(rows, refs, **how), "idx"), epoch)
        rows.unpersist()

    return transactions.writeStream.foreachBatch(each)


def running_counts(classified: DataFrame, column: str = "class") -> DataFrame:
    """How many of each class so far; for the output modes update and complete."""
    return classified.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def drain(stream: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there now and return the sink's table."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    query = writer.start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drain_batches(transactions: DataFrame, refs: DataFrame, path: str, state: str, **how) -> DataFrame:
    """decide_each_batch over what is there now, however many the references: id, fraud_score, approved.

    Decisions go to the folder `path`, a folder a micro-batch, and progress to `state`. What a micro-batch wrote on its way is deleted after it.
    """
    spark, since, columns = transactions.sparkSession, written(), "id string, fraud_score double, approved boolean"

    def sink(decided: DataFrame, epoch: int) -> None:
        decided.select("id", "fraud_score", "approved").write.mode("overwrite").parquet(f"{path}/{epoch}")
        drop(since, written())

    # There is something to read even if nothing arrived.
    spark.createDataFrame([], columns).write.mode("overwrite").parquet(f"{path}/none")
    decide_each_batch(transactions, refs, sink, **how).trigger(availableNow=True).option("checkpointLocation", state).start().awaitTermination()
    return spark.read.schema(columns).parquet(f"{path}/*")


def health(query) -> dict:
    """Whether a streaming query runs, and its last progress."""
    return {"active": query.isActive, "message": query.status["message"], "batch": (query.lastProgress or {}).get("batchId")}
