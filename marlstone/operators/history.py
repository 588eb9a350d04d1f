"""Features of a transaction from the history of its user.

A user's rows may be a third of all, so no window is partitioned by user alone: rows are
windowed by (user, day), and what earlier days add comes from one aggregated row a user and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_DAY = 86_400_000_000


def with_micros(events: DataFrame, ts: str = "ts") -> DataFrame:
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.withColumn("_t", t).withColumn("_day", F.floor(t / F.lit(_DAY)))


def last_and_prior(events: DataFrame, user: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """events with last_t (µs of the user's event before, null for the first), prior_n and prior_sum of values before."""
    e = with_micros(events)
    day = W.partitionBy(user, "_day").orderBy("_t", order)
    before = day.rowsBetween(W.unboundedPreceding, -1)
    # What the days before hold: one row a user and day.
    daily = e.groupBy(user, "_day").agg(F.max("_t").alias("m"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    days = W.partitionBy(user).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    daily = daily.select(F.col(user).alias("_u"), F.col("_day").alias("_d"), F.max("m").over(days).alias("_m"), F.coalesce(F.sum("n").over(days), F.lit(0)).alias("_n"), F.coalesce(F.sum("s").over(days), F.lit(0.0)).alias("_s"))
    own = e.withColumns({"_lag": F.lag("_t").over(day), "_own_n": F.count(F.lit(1)).over(before), "_own_s": F.coalesce(F.sum(value).over(before), F.lit(0.0))})
    out = own.join(daily, F.col(user).eqNullSafe(F.col("_u")) & (F.col("_day") == F.col("_d")))
    return out.select(*events.columns, "_t", F.coalesce("_lag", "_m").alias("last_t"), (F.col("_own_n") + F.col("_n")).alias("prior_n"), (F.col("_own_s") + F.col("_s")).alias("prior_sum"))


def count_24h(events: DataFrame, user: str = "user_id", order: str = "event_id") -> DataFrame:
    """events with tx_count_24h: the user's events in the 24 hours before, the event itself and its instant left out."""
    e = with_micros(events)
    # Each row is counted in its own day's window and, as past only, in the next day's.
    both = e.withColumn("_window", F.explode(F.array(F.col("_day"), F.col("_day") + 1)))
    span = W.partitionBy(user, "_window").orderBy("_t").rangeBetween(-_DAY, -1)
    counted = both.withColumn("tx_count_24h", F.count(F.lit(1)).over(span))
    return counted.where(F.col("_window") == F.col("_day")).select(*events.columns, "tx_count_24h")


def first_seen(events: DataFrame, user: str = "user_id", item: str = "merchant", order: str = "event_id") -> DataFrame:
    """events with `unknown`: whether the user meets the item for the first time."""
    first = events.groupBy(F.col(user).alias("_u"), F.col(item).alias("_i")).agg(F.min(F.struct("ts", order)).alias("_f"))
    same = F.col(user).eqNullSafe(F.col("_u")) & F.col(item).eqNullSafe(F.col("_i"))
    return events.join(first, same).select(*events.columns, (F.struct(F.col("ts"), F.col(order)) == F.col("_f")).alias("unknown"))
