"""The event stream as transactions: what the payload brings ready-made is derived from each user's history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RISK, MCC_RISK, Normalization
from ..functions import scalar as S
from ..operators import history

# Fixed values of this mapping: the risk of each type of event.
EVENT_RISK = {"purchase": 0.85, "signup": 0.45, "error": 0.75, "click": 0.15, "view": 0.2}


def with_merchant(events: DataFrame) -> DataFrame:
    return events.withColumn("merchant", F.get_json_object("props", "$.k"))


def gaps(events: DataFrame) -> DataFrame:
    """event_id, value, last_t, average (of the user's earlier events, 0 if none), minutes (null if none), ..."""
    e = history.last_and_prior(events.select("event_id", "ts", "user_id", "event_type", "value", "props"))
    return _gaps(e)


def _gaps(e: DataFrame) -> DataFrame:
    average = F.when(F.col("prior_n") > 0, F.col("prior_sum") / F.col("prior_n")).otherwise(F.lit(0.0))
    here = F.unix_seconds(F.col("ts").cast("timestamp"))
    minutes = S.minutes_between(here, F.floor(F.col("last_t") / F.lit(1_000_000)))
    return e.withColumns({"average": average, "minutes": minutes})


def transactions(events: DataFrame) -> DataFrame:
    """event_id, amount, avg_amount (of the user's earlier events, 0 if none), tx_count_24h, minutes (null if none), unknown, ..."""
    e = with_merchant(events.select("event_id", "ts", "user_id", "event_type", "value", "props")).drop("props")
    e = history.last_and_prior(e)
    e = history.count_24h(e)
    e = history.first_seen(e)
    per_merchant = e.groupBy("merchant").agg(F.avg("value").alias("merchant_avg")).withColumnRenamed("merchant", "_m")
    return _gaps(e).join(per_merchant, F.col("merchant").eqNullSafe(F.col("_m")), "left").drop("_m", "_t")


def vectors(events: DataFrame, norm: Normalization | None = None) -> DataFrame:
    """event_id and the 14 dimensions d0 to d13. Distances, which events lack, come from event_id and the merchant's number."""
    n = norm or Normalization()
    c = F.col
    first = c("last_t").isNull()
    online = c("event_type").isin("click", "view", "signup")
    merchant = F.coalesce(c("merchant").cast("double"), F.lit(0.0))
    part = lambda v, most: S.clamp01(v / F.lit(float(most)))
    exact = (
        part(c("value") * 20, n.max_amount),
        part(F.pmod(c("event_id"), F.lit(13)) + 1, n.max_installments),
        S.clamp01(S.safe_ratio(c("value"), c("average")) / F.lit(n.amount_vs_avg_ratio)),
        F.hour("ts") / F.lit(23.0),
        S.day_of_week(c("ts")) / F.lit(6.0),
        S.or_sentinel(first, part(c("minutes"), n.max_minutes)),
        S.or_sentinel(first, part(merchant * 7, n.max_km)),
        part(F.pmod(c("event_id") * 37, F.lit(1000)), n.max_km),
        part(c("tx_count_24h"), n.max_tx_count_24h),
        S.flag(online),
        S.flag(~online & (F.pmod(c("event_id"), F.lit(10)) < 9)),
        S.flag(c("unknown")),
        S.mcc_risk(c("event_type"), EVENT_RISK, DEFAULT_RISK),
        part(c("merchant_avg") * 20, n.max_merchant_avg_amount),
    )
    return transactions(events).select("event_id", *[S.round4(v).alias(f"d{i}") for i, v in enumerate(exact)])


def payloads(events: DataFrame) -> DataFrame:
    """idx (event_id) and the columns of a transaction, from each event alone by this mapping."""
    c = F.col
    at = F.unix_seconds(F.to_timestamp_ltz(F.concat(c("ts").cast("string"), F.lit("Z"))))
    code = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    n = c("event_id")
    known = F.transform(F.sequence(F.lit(1), F.pmod(n, F.lit(4)) + 2), lambda i: code("M", F.pmod(n * i, F.lit(7))))
    last = F.struct(S.timestamp_text(at - F.pmod(n * 61, F.lit(100_000))).alias("timestamp"), (F.pmod(n, F.lit(1200)) / 1.0).alias("km_from_current"))
    return events.select(
        n.alias("idx"),
        code("tx-", n).alias("id"),
        F.struct((c("value") * 20).alias("amount"), (F.pmod(n, F.lit(13)) + 1).cast("int").alias("installments"), S.timestamp_text(at).alias("requested_at")).alias("transaction"),
        F.struct((F.pmod(n, F.lit(11)) * 25.0).alias("avg_amount"), F.pmod(n, F.lit(25)).cast("int").alias("tx_count_24h"), known.alias("known_merchants")).alias("customer"),
        F.struct(code("M", F.pmod(n, F.lit(9))).alias("id"), F.element_at(F.array(*[F.lit(k) for k in (*MCC_RISK, "0000")]), (F.pmod(n, F.lit(len(MCC_RISK) + 1)) + 1).cast("int")).alias("mcc"), (F.pmod(n, F.lit(997)) * 12.5).alias("avg_amount")).alias("merchant"),
        F.struct((n % 3 == 0).alias("is_online"), (n % 4 == 1).alias("card_present"), (F.pmod(n * 37, F.lit(1300)) / 1.0).alias("km_from_home")).alias("terminal"),
        F.when(n % 5 != 0, last).alias("last_transaction"),
    )
