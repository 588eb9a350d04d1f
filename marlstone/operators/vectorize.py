"""A transaction as a vector of 14 normalized dimensions: one projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Normalization
from ..functions import scalar as S
from ..schemas import DIMENSIONS


def dimensions(risks: dict[str, float] | None = None, norm: Normalization | None = None) -> dict[str, Column]:
    """name -> column, over the transaction's columns, each rounded to four places."""
    n = norm or Normalization()
    c = F.col
    at = S.epoch_of(c("transaction.requested_at"))
    no_last = c("last_transaction").isNull()
    minutes = S.minutes_between(at, S.epoch_of(c("last_transaction.timestamp")))
    ratio = S.safe_ratio(c("transaction.amount"), c("customer.avg_amount"))
    part = lambda v, most: S.clamp01(v / F.lit(float(most)))
    exact = (
        part(c("transaction.amount"), n.max_amount),
        part(c("transaction.installments"), n.max_installments),
        S.clamp01(ratio / F.lit(n.amount_vs_avg_ratio)),
        S.hour_of_epoch(at) / F.lit(23.0),
        S.weekday_of_epoch(at) / F.lit(6.0),
        S.or_sentinel(no_last, part(minutes, n.max_minutes)),
        S.or_sentinel(no_last, part(c("last_transaction.km_from_current"), n.max_km)),
        part(c("terminal.km_from_home"), n.max_km),
        part(c("customer.tx_count_24h"), n.max_tx_count_24h),
        S.flag(c("terminal.is_online")),
        S.flag(c("terminal.card_present")),
        F.lit(1.0) - S.flag(S.is_known(c("customer.known_merchants"), c("merchant.id"))),
        S.mcc_risk(c("merchant.mcc"), risks),
        part(c("merchant.avg_amount"), n.max_merchant_avg_amount),
    )
    return {name: S.round4(v) for name, v in zip(DIMENSIONS, exact, strict=True)}


def vectorize(transactions: DataFrame, risks: dict[str, float] | None = None, norm: Normalization | None = None, columns: bool = False) -> DataFrame:
    """transactions with `vector`, or with the 14 columns."""
    named = dimensions(risks, norm)
    return transactions.withColumns(named) if columns else transactions.withColumn("vector", F.array(*named.values()))


def bucket(vector: Column) -> Column:
    """The key of vectors that differ by no binary dimension: online, present, unknown merchant, last transaction or not."""
    bit = lambda i: (F.get(vector, i) == 1.0).cast("int")
    return bit(9) * 8 + bit(10) * 4 + bit(11) * 2 + (F.get(vector, 5) != -1.0).cast("int")
