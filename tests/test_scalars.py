import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import formatting as T
from marlstone.functions import jsonfns as J
from marlstone.functions import registry
from marlstone.functions import scalar as S


def one(spark, column, kind="double", *values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_clamp_keeps_nan(spark):
    got = one(spark, S.clamp01, "double", -1.0, 0.3, 7.0, float("nan"), None)
    assert got[:3] == [0.0, 0.3, 1.0] and math.isnan(got[3]) and got[4] is None


def test_rounding_goes_by_the_scaled_double(spark):
    assert one(spark, S.round4, "double", 0.00015, 0.00145, -0.00025) == [0.0001, 0.0014, -0.0003]
    assert one(spark, S.round2, "double", 1.005, 2.675) == [1.0, 2.68]
    assert one(spark, lambda v: S.round_up_half(v, 0), "double", -0.5, 0.5) == [0.0, 1.0]


def test_division_by_zero(spark):
    got = [r[0] for r in spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double").select(S.safe_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.25


def test_risk_and_time(spark):
    assert one(spark, S.mcc_risk, "string", "7995", "0000", None) == [0.85, 0.5, 0.5]
    assert one(spark, S.epoch_of, "string", "2026-03-11T18:45:53Z", "nonsense") == [1773254753, None]
    assert one(spark, lambda v: S.timestamp_text(v), "long", 1773254753) == ["2026-03-11T18:45:53Z"]
    assert one(spark, lambda v: S.day_of_week(F.to_date(v)), "string", "2026-03-11", "2026-03-15", "2026-03-16") == [2, 6, 0]


def test_approval_is_strict(spark):
    assert one(spark, S.approved, "double", 0.4, 0.6, 0.8) == [True, False, False]


def test_numbers_as_text(spark):
    assert one(spark, T.number_text, "double", 3.0, 0.25, 1e-11, -2.5, 123456.789) == ["3", "0.25", "0", "-2.5", "123456.789"]
    assert one(spark, T.bytes_text, "double", 7.0, 999.0, 1000.0, 1536.0, 5e9, 250e6) == ["7 B", "999 B", "1.0 kB", "1.5 kB", "5.0 GB", "250 MB"]
    assert one(spark, T.duration_text, "double", 0.0, 0.0005, 0.5, 5.819, 1500.0, 61000.0, 3723000.0) == ["0s", "500ns", "500µs", "5.81ms", "1.5s", "1m1s", "1h2m3s"]
    assert one(spark, T.percent_text, "double", 0.99999) == ["99.99%"]
    assert one(spark, lambda v: T.duration_text(v, "s"), "double", 1500.0) == ["1.50s"]


def test_names(spark):
    assert one(spark, T.metric_name, "string", "a", "a{b:c}") == ["a", "{ b:c }"]
    assert one(spark, T.escaped, "string", "<a & 'b'>\"") == ["&lt;a &amp; &#39;b&#39;&gt;&quot;"]
    assert one(spark, T.text_width, "string", "\x1b[32mok\x1b[0m", "ﬁ", None) == [2, 2, None]


def test_json(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": null}], "c": "x", "d": true}',), ("not json",)], "t string")
    v = J.parse(F.col("t"), strict=False)
    got = df.select(*[J.kind(v, p) for p in ("$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b", "$.c", "$.d", "$.e")], J.string_value(v, "$.c"), J.number_value(v, "$.a[0]")).collect()
    assert list(got[0])[:10] == ["object", "array", "number", "object", "null", "string", "bool", "invalid", "x", 1.0]
    assert list(got[1])[:8] == ["invalid"] * 8
    same = spark.createDataFrame([('{"a":1,"b":2}', '{ "b": 2, "a": 1 }')], "x string, y string")
    assert same.select(J.equal_documents(F.col("x"), F.col("y")), J.minified(F.lit('{ "a": 1 /* c */ }'))).first()[:] == (True, '{"a":1}')
    arrays = spark.sql("SELECT array(1, 2, 3) AS a").select(J.insert(F.col("a"), 1, F.lit(9)), J.insert(F.col("a"), 9, F.lit(9)), J.removed(F.col("a"), 0), J.replaced(F.col("a"), 2, F.lit(0)), J.array_item(F.col("a"), 5), J.array_size(F.lit(None).cast("array<int>")))
    assert arrays.first()[:] == ([1, 9, 2, 3], [1, 2, 3, 9], [2, 3], [1, 2, 0], None, 0)
    assert spark.sql("SELECT named_struct('a', 1, 'b', 2) AS s").select(J.set_field(F.col("s"), "a", F.lit(5)).alias("s")).select(J.drop_field(F.col("s"), "b")).first()[0].asDict() == {"a": 5}
    assert spark.range(1).select(J.equal_numbers(F.lit(0.1) + F.lit(0.2), F.lit(0.3))).first()[0]


def test_sql_functions(spark):
    names = registry.register(spark)
    assert "round4" in names
    row = spark.sql("SELECT round4(0.00015D), p99_score(10D), l2_squared(array(1D, 2D), array(0D, 0D)), l1(array(1D), array(-1D)), or_sentinel(NULL), day_of_week_mon0(TIMESTAMP '2026-03-11 00:00:00')").first()
    assert row[:] == (0.0001, 2000.0, 5.0, 2.0, -1.0, 2)


@pytest.mark.parametrize("text,width", [("", 0), ("abc", 3), ("\x1b[1;31mred", 3)])
def test_width(text, width):
    assert T.width_of(text) == width


def test_years_after_9999(spark):
    rows = spark.createDataFrame([(780_000_000_000,), (253_402_300_800,), (253_402_300_799,), (0,)], "e long")
    text = S.timestamp_text(F.col("e"))
    found = rows.select(text, S.epoch_of(text), "e").collect()
    assert [r[0] for r in found] == ["26687-03-20T18:40:00Z", "10000-01-01T00:00:00Z", "9999-12-31T23:59:59Z", "1970-01-01T00:00:00Z"]
    assert all(r[1] == r[2] for r in found)


def test_decimals_of_halves(spark):
    """Ten decimals of exact halves and of numbers whose shortest text only looks like one, as C's printf writes them."""
    values = [0.00048828125, -0.00146484375, 0.25048828125, 0.12345678905, 123456.12345678905, 0.99999999995, 7.99999999995, 1e-12, -1e-12, 0.3 * 3, 98765432.109876543, 0.1, 4503599627370495.5]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(T.number_text(F.col("v"))).collect()]
    assert found == [(f"{v:.10f}".rstrip("0").rstrip(".")) for v in values]
