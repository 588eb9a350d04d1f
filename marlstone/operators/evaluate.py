"""Statistics of decisions, the confusion of decisions with expectations, and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalar import round4, round_up_half

# The scoring rules.
SCALE, SLOWEST_FULL, FASTEST, SLOWEST = 1000.0, 1000.0, 1.0, 2000.0
LEAST_EPSILON, PENALTY, MOST_FAILURES, CUT = 0.001, 300.0, 0.15, -3000.0
WEIGHTS = {"fp": 1, "fn": 3, "err": 5}
EDGE = 0.6


def stats(decisions: DataFrame) -> DataFrame:
    """One row over decisions (fraud_score, approved); rates are fractions, 0 of an empty table."""
    counts = decisions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("approved")).alias("fraud_count"),
        F.count_if("approved").alias("legit_count"),
        F.count_if(F.col("fraud_score") == EDGE).alias("edge_case_count"),
    )
    rate = lambda n: F.when(F.col("total") > 0, round4(F.col(n) / F.col("total"))).otherwise(F.lit(0.0))
    return counts.withColumns({"fraud_rate": rate("fraud_count"), "legit_rate": rate("legit_count"), "edge_case_rate": rate("edge_case_count")})


def outcome(expected: Column, approved: Column, status: Column) -> Column:
    """tn, tp, fn, fp or err. A missing response or another status than 200 is an error; so is, by this engine's rule,
    a malformed body (status 200 is then to be nulled by the reader). A missing `approved` counts as not approved."""
    ok = F.coalesce(status == 200, F.lit(False))
    yes = F.coalesce(approved, F.lit(False))
    right = expected == yes
    return F.when(~ok, "err").when(right & expected, "tn").when(approved.isNotNull() & right, "tp").when(yes, "fn").otherwise("fp")


def judge(expected: DataFrame, responses: DataFrame, timeout_ms: float = 2001.0) -> DataFrame:
    """idx, class, duration_ms: expected (idx, expected_approved) held against responses (idx, approved, status, duration_ms)."""
    late = F.col("duration_ms") > F.lit(float(timeout_ms))
    joined = expected.select("idx", "expected_approved").join(responses, "idx", "left")
    status = F.when(late, F.lit(None)).otherwise(F.col("status"))
    return joined.select("idx", outcome(F.col("expected_approved"), F.col("approved"), status).alias("class"), "duration_ms")


def confusion(judged: DataFrame) -> DataFrame:
    """One row: tp, tn, fp, fn, err."""
    return judged.agg(*[F.count_if(F.col("class") == c).alias(c) for c in ("tp", "tn", "fp", "fn", "err")])


def errors(counts: DataFrame) -> DataFrame:
    """counts with n, weighted_errors, failures, epsilon, failure_rate."""
    c = F.col
    out = counts.withColumn("n", c("tp") + c("tn") + c("fp") + c("fn") + c("err"))
    out = out.withColumn("weighted_errors", sum((c(k) * w for k, w in WEIGHTS.items()), F.lit(0))).withColumn("failures", c("fp") + c("fn") + c("err"))
    per = lambda v: F.when(c("n") > 0, c(v).cast("double") / c("n")).otherwise(F.lit(0.0))
    return out.withColumn("epsilon", per("weighted_errors")).withColumn("failure_rate", per("failures"))


def p99_score(p99: Column) -> Column:
    return F.when(p99 <= 0, F.lit(0.0)).when(p99 > SLOWEST, F.lit(CUT)).otherwise(F.lit(SCALE) * F.log10(F.lit(SLOWEST_FULL) / F.greatest(p99, F.lit(FASTEST))))


def rate_component(epsilon: Column) -> Column:
    return F.lit(SCALE) * F.log10(F.lit(1.0) / F.greatest(epsilon, F.lit(LEAST_EPSILON)))


def absolute_penalty(weighted_errors: Column) -> Column:
    return F.lit(-PENALTY) * F.log10(F.lit(1.0) + weighted_errors)


def detection_score(failure_rate: Column, epsilon: Column, weighted_errors: Column) -> Column:
    """Cut if strictly more than MOST_FAILURES failed."""
    return F.when(failure_rate > MOST_FAILURES, F.lit(CUT)).otherwise(rate_component(epsilon) + absolute_penalty(weighted_errors))


def scored(counts: DataFrame) -> DataFrame:
    """errors(counts) and p99 -> with p99_score, detection_score, final_score and the cuts."""
    c = F.col
    cut = c("failure_rate") > MOST_FAILURES
    out = counts.withColumns(
        {
            "p99_score": p99_score(c("p99")),
            "p99_cut": (c("p99") > 0) & (c("p99") > SLOWEST),
            "detection_score": detection_score(c("failure_rate"), c("epsilon"), c("weighted_errors")),
            "detection_cut": cut,
            "rate_component": F.when(~cut, rate_component(c("epsilon"))),
            "absolute_penalty": F.when(~cut, absolute_penalty(c("weighted_errors"))),
        }
    )
    return out.withColumn("final_score", c("p99_score") + c("detection_score"))


def result(judged: DataFrame, expected_stats: DataFrame | None = None, exact: bool = True) -> DataFrame:
    """The result document as one nested row. exact=False: p99 from p99_approximate."""
    p99 = judged.agg(F.percentile("duration_ms", 0.99).alias("p99")) if exact else p99_approximate(judged)
    p99 = p99.select(F.coalesce("p99", F.lit(0.0)).alias("p99"))
    row = scored(errors(confusion(judged)).crossJoin(p99))
    s = F.struct
    c = F.col
    scoring = s(
        s(c("fp").alias("false_positive_detections"), c("fn").alias("false_negative_detections"), c("tp").alias("true_positive_detections"), c("tn").alias("true_negative_detections"), c("err").alias("http_errors")).alias("breakdown"),
        round_up_half(c("failure_rate"), 6).alias("failure_rate"),
        c("weighted_errors").alias("weighted_errors_E"),
        c("epsilon").alias("error_rate_epsilon"),
        s(c("p99_score").alias("value"), c("p99_cut").alias("cut_triggered")).alias("p99_score"),
        s(c("detection_score").alias("value"), "rate_component", "absolute_penalty", c("detection_cut").alias("cut_triggered")).alias("detection_score"),
        "final_score",
    ).alias("scoring")
    if expected_stats is None:
        return row.select("p99", scoring)
    return row.crossJoin(expected_stats.select(s(*expected_stats.columns).alias("expected"))).select("expected", "p99", scoring)


def p99_approximate(judged: DataFrame, by: list[str] | None = None, column: str = "duration_ms", accuracy: int = 10_000) -> DataFrame:
    """p99 a group from a summary of bounded size, for streams and very many distinct values: a value whose rank is off by at most rows / accuracy."""
    return judged.groupBy(*(by or [])).agg(F.percentile_approx(column, 0.99, accuracy).alias("p99"))


def ramp(stages: DataFrame, start: int) -> DataFrame:
    """stages (stage, duration, target) with from_rate, requests of the stage, and all so far; whole numbers, halves cut."""
    by = W.orderBy("stage")
    out = stages.withColumn("from_rate", F.lag("target", 1, start).over(by))
    out = out.withColumn("stage_requests", F.floor((F.col("from_rate") + F.col("target")) * F.col("duration") / 2).cast("long"))
    return out.withColumn("cumulative", F.sum("stage_requests").over(by.rowsBetween(W.unboundedPreceding, 0)))


def metric(values: DataFrame, kind: str, by: list[str], seconds: float | None = None) -> DataFrame:
    """The summary of a counter, gauge, rate or trend: values (name, value[, at]) grouped by `by`."""
    v = F.col("value").cast("double")
    kinds = {
        "counter": [F.sum(v).alias("count"), (F.sum(v) / F.lit(float(seconds or 1))).alias("rate")],
        "rate": [F.avg((v != 0).cast("double")).alias("rate"), F.count_if(v != 0).alias("passes"), F.count_if(v == 0).alias("fails")],
        "trend": [F.avg(v).alias("avg"), F.min(v).alias("min"), F.percentile(v, 0.5).alias("med"), F.max(v).alias("max"), F.percentile(v, 0.9).alias("p90"), F.percentile(v, 0.95).alias("p95"), F.percentile(v, 0.99).alias("p99")],
    }
    if kind == "gauge":
        return values.groupBy(*by).agg(F.max_by(v, F.col("at")).alias("value"), F.min(v).alias("min"), F.max(v).alias("max"))
    return values.groupBy(*by).agg(*kinds[kind])


def check_percent(passes: Column, fails: Column) -> Column:
    return F.floor(F.lit(100) * passes / F.when(passes + fails > 0, passes + fails))
