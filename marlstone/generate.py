"""Synthetic transactions and labeled references.

Every value is a function of (seed, row number, field), so any partitioning gives the same rows
and a row can be made again alone. Ranges by profile are the tables below; draws are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MCC_RISK, Normalization
from .functions.scalar import round2, timestamp_text
from .operators.vectorize import vectorize

# What each profile draws from. Whole-number ranges exclude their end.
PROFILES = ("legit", "fraud", "borderline")
REAL = {
    "amount": ((10, 500), (2000, 10000), (400, 3000)),
    "merchant_avg": ((30, 500), (20, 100), (50, 300)),
    "km_home": ((0, 50), (200, 1000), (30, 400)),
    "last_km": ((0, 20), (200, 1000), (20, 300)),
}
WHOLE = {
    "installments": ((1, 4), (6, 13), (3, 8)),
    "hour": ((8, 21), (0, 7), (6, 23)),
    "tx_count_24h": ((1, 6), (8, 21), (4, 12)),
    "minutes_back": ((30, 720), (1, 10), (5, 120)),
}
CUSTOMER_AVG = {"fraud": (50, 300), "borderline": (100, 500)}
CHANCE_ONLINE = (0.3, 0.8, 0.5)
CODES = {"legit": ("5411", "5812", "5912", "5311"), "fraud": ("7995", "7801", "7802")}
DAYS, RANDOM_YEARS = (10, 28), (2026, 2031)
TEN_YEARS = 10 * 365 * 24 * 3600


class Draws:
    """Uniform draws for a row, by field name."""

    def __init__(self, seed: int, row: str = "idx"):
        self.seed, self.row = seed, row

    def unit(self, field: str) -> Column:
        h = F.xxhash64(F.col(self.row), F.lit(field), F.lit(self.seed))
        return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))

    def real(self, field: str, lo: Column, hi: Column) -> Column:
        return lo + self.unit(field) * (hi - lo)

    def whole(self, field: str, lo, hi) -> Column:
        lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
        return (lo + F.floor(self.unit(field) * (hi - lo))).cast("int")


def _by_profile(values: tuple) -> Column:
    return F.when(F.col("profile") == "legit", F.lit(values[0])).when(F.col("profile") == "fraud", F.lit(values[1])).otherwise(F.lit(values[2]))


def transactions(spark: SparkSession, n: int, fraud_ratio: float = 0.3, seed: int = 4242, random_dates: bool = False, codes: list[str] | None = None) -> DataFrame:
    """idx, profile and the payload's columns of n transactions. A tenth of the fraud share is borderline."""
    d = Draws(seed)
    real = lambda f: d.real(f, _by_profile(tuple(float(r[0]) for r in REAL[f])), _by_profile(tuple(float(r[1]) for r in REAL[f])))
    whole = lambda f: d.whole(f, _by_profile(tuple(r[0] for r in WHOLE[f])), _by_profile(tuple(r[1] for r in WHOLE[f])))
    pick = lambda f, options: F.element_at(F.array(*[F.lit(x) for x in options]), d.whole(f, 1, len(options) + 1))
    merchant = lambda f, lo, hi: F.format_string("MERC-%03d", d.whole(f, lo, hi))
    share = d.unit("profile")
    rows = spark.range(n).withColumnRenamed("id", "idx")
    rows = rows.withColumn("profile", F.when(share < 1 - fraud_ratio, "legit").when(share < 1 - 0.1 * fraud_ratio, "fraud").otherwise("borderline"))
    year = d.whole("year", *RANDOM_YEARS) if random_dates else F.lit(2026)
    month = F.when(F.lit(random_dates), d.whole("month", F.when(year == 2026, 3).otherwise(1), 13)).otherwise(F.lit(3))
    day = d.whole("day", 1, 29) if random_dates else d.whole("day", *DAYS)
    rows = rows.withColumns(
        {
            "amount": round2(real("amount")),
            "at": F.unix_timestamp(F.make_timestamp(year, month, day, whole("hour"), d.whole("minute", 0, 60), d.whole("second", 0, 60))),
            "known": F.slice(F.array(*[merchant(f"known{i}", 1, 20) for i in range(5)]), F.lit(1), d.whole("n_known", 2, 6)),
            "online": d.unit("online") < _by_profile(CHANCE_ONLINE),
            "back": (d.whole("back", 60, 61).cast("long") + F.floor(d.unit("back_seconds") * TEN_YEARS)) if random_dates else whole("minutes_back").cast("long") * 60,
        }
    )
    own = F.element_at(F.col("known"), d.whole("own", F.lit(1), F.size("known") + 1))
    average = F.when(F.col("profile") == "legit", F.col("amount") * 2).otherwise(d.real("customer_avg", *(F.when(F.col("profile") == "fraud", F.lit(float(CUSTOMER_AVG["fraud"][i]))).otherwise(F.lit(float(CUSTOMER_AVG["borderline"][i]))) for i in (0, 1))))
    other = F.when(d.unit("is_own") < 0.5, own).otherwise(merchant("border", 30, 60))
    mcc = F.when(F.col("profile") == "legit", pick("mcc", CODES["legit"])).when(F.col("profile") == "fraud", pick("mcc", CODES["fraud"])).otherwise(pick("mcc", codes or list(MCC_RISK)))
    last = F.struct(timestamp_text(F.col("at") - F.col("back")).alias("timestamp"), real("last_km").alias("km_from_current"))
    return rows.select(
        "idx",
        "profile",
        F.concat(F.lit("tx-"), F.floor(d.unit("id") * 2**32).cast("long")).alias("id"),
        F.struct("amount", whole("installments").alias("installments"), timestamp_text(F.col("at")).alias("requested_at")).alias("transaction"),
        F.struct(round2(average).alias("avg_amount"), whole("tx_count_24h").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.when(F.col("profile") == "legit", own).when(F.col("profile") == "fraud", merchant("far", 50, 100)).otherwise(other).alias("id"), mcc.alias("mcc"), round2(real("merchant_avg")).alias("avg_amount")).alias("merchant"),
        F.struct(F.col("online").alias("is_online"), (~F.col("online") & (d.unit("present") < 0.9)).alias("card_present"), real("km_home").alias("km_from_home")).alias("terminal"),
        F.when(d.unit("has_last") >= 0.2, last).alias("last_transaction"),
    )


def references(spark: SparkSession, n: int, fraud_ratio: float = 0.3, seed: int = 42, risks: dict[str, float] | None = None, norm: Normalization | None = None) -> DataFrame:
    """ref_id, vector, label of n references, labeled by profile; a borderline one is fraud half of the time."""
    rows = vectorize(transactions(spark, n, fraud_ratio, seed), risks, norm)
    coin = F.when(Draws(seed).unit("label") < 0.5, "fraud").otherwise("legit")
    label = F.when(F.col("profile") == "borderline", coin).otherwise(F.col("profile"))
    return rows.select(F.col("idx").alias("ref_id"), "vector", label.alias("label"))


# PCG32 (O'Neill 2014, XSH-RR): a 64-bit linear congruential state, permuted to 32 bits.
_MULTIPLIER = 6364136223846793005
_MASK = (1 << 64) - 1


def _ahead(state: int, step: int, n: int) -> int:
    """The state after n steps, in log n multiplications."""
    mul, add, by, plus = 1, 0, _MULTIPLIER, step
    while n:
        if n & 1:
            mul, add = mul * by & _MASK, (add * by + plus) & _MASK
        by, plus, n = by * by & _MASK, (by + 1) * plus & _MASK, n >> 1
    return (mul * state + add) & _MASK


def pcg32(seed: int, start: int, n: int) -> np.ndarray:
    """Outputs start to start + n - 1 of the generator seeded with `seed` (stream: the seed as well)."""
    step = (seed << 1 | 1) & _MASK
    first = _ahead((_ahead(0, step, 1) + seed) & _MASK, step, 1)
    state = np.empty(n, np.uint64)
    if n:
        # Doubling: the second half is the first half jumped ahead by its length.
        state[0], have = _ahead(first, step, start), 1
        while have < n:
            more = min(have, n - have)
            mul = _ahead(1, 0, have)
            state[have : have + more] = state[:more] * np.uint64(mul) + np.uint64(_ahead(0, step, have))
            have += more
    x = (((state >> np.uint64(18)) ^ state) >> np.uint64(27)).astype(np.uint32)
    turn = (state >> np.uint64(59)).astype(np.uint32)
    return (x >> turn) | (x << ((np.uint32(32) - turn) & np.uint32(31)))


def pcg32_rows(spark: SparkSession, seed: int, n: int, block: int = 65_536) -> DataFrame:
    """i, u32, unit (u32 over its largest value, 1 included): the sequence, made in parallel by jumping ahead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                lo = int(b) * block
                u = pcg32(seed, lo, min(block, n - lo)).astype(np.int64)
                yield pd.DataFrame({"i": np.arange(lo, lo + len(u)), "u32": u, "unit": u / 4294967295.0})

    return spark.range(-(-n // block)).mapInPandas(run, "i long, u32 long, unit double")
