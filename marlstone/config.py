"""Normalization constants and merchant-category risks."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

# The ceilings and the risks that scores are defined by.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.5
NEIGHBORS = 5
THRESHOLD = 0.6
MOST_CODES = 32


@dataclass(frozen=True)
class Normalization:
    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0


def read_normalization(spark: SparkSession, path: str) -> Normalization:
    """From a JSON object; a missing key is an error that names it."""
    names = [f.name for f in fields(Normalization)]
    row = spark.read.schema(", ".join(f"{n} double" for n in names)).json(path, multiLine=True).first()
    missing = [n for n in names if row is None or row[n] is None]
    if missing:
        raise ValueError(f"{path}: missing {', '.join(missing)}")
    return Normalization(**row.asDict())


def read_mcc_risk(spark: SparkSession, path: str) -> dict[str, float]:
    """From a JSON object code -> risk; the first MOST_CODES entries count."""
    text = spark.read.text(path, wholetext=True)
    entries = text.selectExpr("explode(map_entries(from_json(value, 'map<string,double>'))) AS e").limit(MOST_CODES).collect()
    return {r["e"]["key"]: r["e"]["value"] for r in entries}
