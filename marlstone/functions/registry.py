"""The scalar functions by name for SQL: SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "clamp01": ("v DOUBLE", "DOUBLE", "CASE WHEN isnan(v) THEN v WHEN v < 0 THEN 0D WHEN v > 1 THEN 1D ELSE v END"),
    "round2": ("v DOUBLE", "DOUBLE", "round(v * 100D) / 100D"),
    "round4": ("v DOUBLE", "DOUBLE", "round(v * 10000D) / 10000D"),
    "day_of_week_mon0": ("ts TIMESTAMP", "INT", "weekday(ts)"),
    "minutes_between": ("later BIGINT, earlier BIGINT", "DOUBLE", "(later - earlier) / 60D"),
    "or_sentinel": ("v DOUBLE", "DOUBLE", "coalesce(v, -1D)"),
    "approved": ("score DOUBLE", "BOOLEAN", "score < 0.6D"),
    "l2_squared": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "l1": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
    "p99_score": ("p99 DOUBLE", "DOUBLE", "CASE WHEN p99 <= 0 THEN 0D WHEN p99 > 2000 THEN -3000D ELSE 1000D * log10(1000D / greatest(p99, 1D)) END"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions as temporary functions of this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
