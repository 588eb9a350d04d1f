"""A query for each operator, over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generate
from .config import read_mcc_risk
from .functions import formatting as T
from .functions import jsonfns as J
from .functions import registry
from .functions import scalar as S
from .operators import evaluate as E
from .operators import history, resolve
from .operators.knn import edit_neighbors, knn, measured
from .operators.vectorize import vectorize
from .operators.vote import majority, vote, weighted
from .plans import events as P
from .plans.scoring import classifier, write_labeled
from .schemas import DIMENSIONS
from .shared import materialize, shared_dir
from .sources import readers, writers
from .streaming.scorer import arrivals, drain, drain_batches, fits, running_counts, score_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated queries, every twentieth embedding, and all as references; labels below 5 stand for fraud."""
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("label") < 5, "fraud").otherwise("legit").alias("label"))
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("idx"), "vector"), e.select(F.col("vec_id").alias("ref_id"), "vector", "label")


def _neighbors(spark: SparkSession, sf_dir: str, k: int = 5, metric: str = "l2", plan: str = "blocks", **how) -> DataFrame:
    q, r = _vectors(spark, sf_dir)
    return knn(q, r, k, metric, plan, skip_self=True, **how)


# neighbors and votes


@query
def q01_vector_score(spark, sf_dir):
    q, r = _vectors(spark, sf_dir)
    return vote(knn(q, r, skip_self=True), q).select("idx", "votes", "fraud_score", "approved")


def _rows(found: DataFrame, root: bool = False) -> DataFrame:
    d = F.sqrt("distance") if root else F.col("distance")
    return found.select("idx", "rank", "ref_id", "label", F.round(d, 6).alias("d"))


@query
def q02_knn_l2(spark, sf_dir):
    return _rows(_neighbors(spark, sf_dir), root=True)


@query
def q02b_knn_l2_pivots(spark, sf_dir):
    return _rows(_neighbors(spark, sf_dir, plan="pivots"), root=True)


@query
def q03_knn_l1(spark, sf_dir):
    return _rows(_neighbors(spark, sf_dir, metric="l1"))


@query
def q04_knn_cosine(spark, sf_dir):
    return _rows(_neighbors(spark, sf_dir, metric="cosine"))


@query
def q05_knn_majority(spark, sf_dir):
    return majority(_neighbors(spark, sf_dir, k=3)).select("idx", F.round("share", 6).alias("share"), "fraud")


@query
def q06_weighted_vote(spark, sf_dir):
    return weighted(_neighbors(spark, sf_dir)).select("idx", F.round("score", 6).alias("score"))


# scalars


@query
def q07_clamp_round4(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    v = F.col("l_extendedprice") / 50000 - 0.2
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.clamp01(v).alias("clamped"), S.round4(v).alias("r4"), S.round2(v).alias("r2"))


@query
def q08_hour_dow(spark, sf_dir):
    at = S.epoch_of(F.col("ts").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", S.hour_of_epoch(at).alias("hour"), S.day_of_week(F.col("ts")).alias("dow"))


@query
def q09_minutes_since_last(spark, sf_dir):
    t = P.gaps(_table(spark, sf_dir, "events"))
    return t.select("event_id", F.round(S.or_sentinel(F.col("last_t").isNull(), F.col("minutes")), 6).alias("minutes"))


@query
def q10_tx_count_24h(spark, sf_dir):
    return history.count_24h(_table(spark, sf_dir, "events")).select("event_id", "tx_count_24h")


@query
def q11_amount_vs_average(spark, sf_dir):
    t = P.gaps(_table(spark, sf_dir, "events"))
    return t.select("event_id", F.round(F.col("average") + 1e-9, 6).alias("average"), S.round4(S.clamp01(S.safe_ratio(F.col("value"), F.col("average")) / 10)).alias("ratio"))


@query
def q12_unknown_merchant(spark, sf_dir):
    return history.first_seen(P.with_merchant(_table(spark, sf_dir, "events"))).select("event_id", "unknown")


@query
def q13_mcc_risk(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    dim = spark.createDataFrame(list(P.EVENT_RISK.items())[:4], "code string, risk double")  # the fifth gets the default
    return e.join(dim, F.col("event_type") == F.col("code"), "left").select("event_id", S.mcc_risk(F.col("event_type"), P.EVENT_RISK).alias("by_map"), F.coalesce("risk", F.lit(0.5)).alias("by_join"))


@query
def q14_event_vector(spark, sf_dir):
    return P.vectors(_table(spark, sf_dir, "events"))


# evaluation


def _event_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = P.vectors(_table(spark, sf_dir, "events")).select("event_id", F.array(*[f"d{i}" for i in range(14)]).alias("vector"))
    e = materialize(e, "events")
    label = F.when(F.get("vector", F.lit(12)) >= 0.75, "fraud").otherwise("legit")
    return e.where("event_id % 20 = 0").select(F.col("event_id").alias("idx"), "vector"), e.select(F.col("event_id").alias("ref_id"), "vector", label.alias("label"))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The decisions on the stated events, and what their own labels expect."""
    q, r = _event_vectors(spark, sf_dir)
    decisions = materialize(vote(knn(q, r, plan="buckets", skip_self=True), q), "decisions")
    expected = r.join(q.select("idx"), F.col("ref_id") == F.col("idx")).select("idx", (F.col("label") != "fraud").alias("expected_approved"))
    return decisions, expected


@query
def q15_stats(spark, sf_dir):
    return E.stats(_decided(spark, sf_dir)[0])


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions held against labels; some responses are missing, failed, slow, or lack the answer."""
    decisions, e = _decided(spark, sf_dir)
    n = F.col("idx") / 20
    d = decisions.withColumn("n", n.cast("long")).where("n % 50 <> 7")
    answer = F.when(F.col("n") % 41 != 0, F.col("approved"))
    r = d.select("idx", answer.alias("approved"), F.when(F.col("n") % 31 == 0, 503).otherwise(200).alias("status"), (F.col("n") * 37 % 2100).cast("double").alias("duration_ms"))
    return E.judge(e, r)


@query
def q16_confusion(spark, sf_dir):
    return E.confusion(_judged(spark, sf_dir))


@query
def q17_weighted_errors(spark, sf_dir):
    return E.errors(E.confusion(_judged(spark, sf_dir))).select("n", "weighted_errors", "failures", F.round("epsilon", 9).alias("epsilon"), S.round_up_half(F.col("failure_rate"), 6).alias("failure_rate"))


@query
def q18_p99(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.99), 6).alias("p99"))


@query
def q19_p99_score(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.round(E.p99_score((F.col("value") - 5) * 20), 6).alias("p99_score"))


@query
def q20_detection_score(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    epsilon, errors = F.col("o_custkey") % 1000 / 1000, F.col("o_orderkey") % 500
    return o.select("o_orderkey", F.round(E.detection_score(F.col("o_orderkey") % 200 / 1000, epsilon, errors), 6).alias("detection_score"))


@query
def q21_final_score(spark, sf_dir):
    counts = E.errors(E.confusion(_judged(spark, sf_dir)))
    p99 = _table(spark, sf_dir, "events").agg(F.percentile("value", 0.99).alias("p99"))
    s = E.scored(counts.crossJoin(p99))
    return s.select(F.round("p99_score", 6).alias("p99_score"), F.round("detection_score", 6).alias("detection_score"), "detection_cut", F.round("final_score", 6).alias("final_score"))


@query
def q22_ramp(spark, sf_dir):
    stages = spark.createDataFrame([(1, 120, 900), (2, 31, 900), (3, 7, 10)], "stage int, duration int, target int")
    return E.ramp(stages, 1)


@query
def q23_first_per_owner(spark, sf_dir):
    return resolve.first_of(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority")


@query
def q23b_resolve_default(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    entries = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"))
    requests = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.when(F.col("c_nationkey") % 2 == 0, "default").otherwise(F.col("c_mktsegment")).alias("submission"))
    return resolve.resolve(requests, entries)


@query
def q24_upsert(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_mktsegment").alias("submission"), F.col("c_acctbal").alias("score"))
    new = c.where("owner % 3 = 0").select("owner", F.when(F.col("owner") % 2 == 0, F.col("submission")).otherwise(F.lit("NEW")).alias("submission"), (F.col("score") + 1).alias("score"))
    return writers.upsert(c, new, ["owner", "submission"]).select("owner", "submission", F.round("score", 6).alias("score"))


@query
def q25_sha256(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


# JSON, arrays, text


@query
def q26_json(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    v = J.parse(F.col("props"))
    row = F.struct("event_id", F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("last"))
    return e.select("event_id", J.kind(v, "$.k").alias("kind"), J.number_value(v, "$.k").alias("k"), J.kind(v, "$.missing").alias("missing"), writers.request_json(row).alias("encoded"))


@query
def q27_arrays(spark, sf_dir):
    a = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"))
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    c = F.col("a")
    return a.select(
        "o_custkey",
        J.array_size(c).cast("long").alias("n"),
        J.array_item(c, 1).alias("second"),
        S.is_known(c, F.col("o_custkey")).alias("has"),
        text(J.insert(c, 1, F.lit(-1).cast("long"))).alias("inserted"),
        text(J.removed(c, 0)).alias("removed"),
        text(J.replaced(c, 0, F.lit(-2).cast("long"))).alias("replaced"),
    )


@query
def q27b_maps(spark, sf_dir):
    m = F.create_map(F.lit("A"), F.col("c_acctbal"), F.lit("a"), F.lit(1.0), F.col("c_mktsegment"), F.lit(2.0))
    c = _table(spark, sf_dir, "customer").withColumn("m", m)
    return c.select("c_custkey", J.object_item(F.col("m"), "a").alias("any_case"), J.object_item(F.col("m"), "a", True).alias("exact"), J.has_item(F.col("m"), "building").alias("has"), F.size(J.remove_key(F.col("m"), "A")).cast("long").alias("left"))


@query
def q28_formats(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    ms = F.col("l_extendedprice") * F.col("l_quantity") / 7
    return li.select("l_orderkey", "l_linenumber", "l_partkey", T.number_text(F.col("l_discount") * 3).alias("number"), T.duration_text(ms).alias("duration"), T.bytes_text(F.floor(F.col("l_extendedprice") * F.col("l_quantity"))).alias("bytes"), T.percent_text(F.col("l_tax")).alias("percent"))


@query
def q28b_names(spark, sf_dir):
    p = _table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit("{"), F.col("p_type"), F.lit("}"))).otherwise(F.concat(F.lit("<"), F.col("p_name"), F.lit(" & 'x'>")))
    return p.select("p_partkey", T.metric_name(name).alias("shown"), T.metric_indent(name).alias("indent"), T.escaped(name).alias("escaped"), T.text_width(name).alias("width"))


@query
def q29_buckets(spark, sf_dir):
    """The stated queries: every twentieth event, against all."""
    q, r = _event_vectors(spark, sf_dir)
    return _rows(knn(q, r, plan="buckets", skip_self=True), root=True)


@query
def q30_streaming_counts(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/event[s].parquet")
    name = f"counts_{uuid.uuid4().hex}"
    return drain(running_counts(stream, "event_type"), name)


@query
def q31_sql_functions(spark, sf_dir):
    registry.register(spark)
    _table(spark, sf_dir, "lineitem").createOrReplaceTempView("marlstone_lineitem")
    return spark.sql("SELECT l_orderkey, l_linenumber, l_partkey, round4(l_extendedprice / 33333) AS r4, clamp01(l_extendedprice / 50000 - 0.2) AS c, approved(round2(l_discount * 10)) AS ok, minutes_between(l_orderkey, l_partkey) AS m FROM marlstone_lineitem")


@query
def q32_metrics(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value", F.struct("ts", "event_id").alias("at"))
    r6 = lambda c: F.round(c, 6).alias(c)
    trend = E.metric(e, "trend", ["name"]).select("name", *[r6(c) for c in ("avg", "min", "med", "max", "p90", "p95")])
    gauge = E.metric(e, "gauge", ["name"]).select(F.col("name"), F.col("value").alias("last"))
    rate = E.metric(e.withColumn("value", (F.col("value") > 50).cast("int")), "rate", ["name"]).select("name", r6("rate"), "passes", "fails", E.check_percent(F.col("passes"), F.col("fails")).alias("percent"))
    return trend.join(gauge, "name").join(rate, "name")


@query
def q33_edit_neighbors(spark, sf_dir):
    words = _table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("w")).select(F.explode("w").alias("word")).union(_table(spark, sf_dir, "customer").select(F.concat(F.substring("c_mktsegment", 1, 4), F.col("c_nationkey") % 7)))
    return edit_neighbors(words, words.withColumnRenamed("word", "other"))


# files, payloads, values


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _payload_file(spark: SparkSession, sf_dir: str) -> str:
    """The events as a JSON array of transactions, one file a partition."""
    path = _folder(spark, "payloads")
    rows = P.payloads(_table(spark, sf_dir, "events"))
    rows.select(writers.request_json(F.struct(*[c for c in rows.columns if c != "idx"])).alias("value")).write.text(path)
    return path


@query
def q46_payload_vectors(spark, sf_dir):
    """Transactions through JSON lines and back, as vectors; whatever the session's time zone."""
    rows = readers.payload_lines(spark, _payload_file(spark, sf_dir)).where(~F.col("malformed"))
    return vectorize(rows, columns=True).select(F.substring("id", 4, 20).cast("long").alias("event_id"), *[F.col(n).alias(f"d{i}") for i, n in enumerate(DIMENSIONS)])


def _reference_file(spark: SparkSession, sf_dir: str, **how: str) -> str:
    _, r = _vectors(spark, sf_dir)
    path = _folder(spark, "references")
    one = writers.reference_json(F.col("vector"), F.col("label"))
    listed = r.select("ref_id", one.alias("value"))
    first = listed.agg(F.min("ref_id")).first()[0]
    text = listed.select("ref_id", F.concat(F.when(F.col("ref_id") == first, "[").otherwise(","), "value").alias("value")).unionByName(spark.createDataFrame([((1 << 63) - 1, "]")], "ref_id long, value string"))
    text.orderBy("ref_id").select("value").coalesce(1).write.options(**how).text(path)
    return path


@query
def q47_references(spark, sf_dir):
    """References through a JSON array and back: place in the array, checked vector and label."""
    r = readers.references(spark, _reference_file(spark, sf_dir), dims=64)
    return r.select("ref_id", F.get("vector", F.lit(0)).alias("first"), F.get("vector", F.lit(63)).alias("last"), F.size("vector").cast("long").alias("dims"), "label", T.number_array(F.slice("vector", 1, 2)).alias("text"))


@query
def q47b_references_gzip(spark, sf_dir):
    r = readers.references(spark, _reference_file(spark, sf_dir, compression="gzip"), dims=64)
    return r.select("ref_id", F.get("vector", F.lit(7)).alias("eighth"), "label")


@query
def q48_timestamps(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_orderkey") * 86_399 + F.col("l_partkey") * 61 - 40_000_000).alias("e"))
    text = S.timestamp_text(F.col("e"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"), S.epoch_of(text).alias("epoch"), S.hour_of_epoch(F.col("e")).alias("hour"), S.weekday_of_epoch(F.col("e")).alias("dow"))


@query
def q49_json_values(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    spaced = F.concat(F.lit('{ "b" : /* c */ [ 1 , "x  y" ] , // end\n "a" :\t'), n.cast("string"), F.lit(' , "b" : null }'))
    v = J.object_value(type=J.scalar_value(F.col("event_type")), n=J.scalar_value(n), none=J.scalar_value(F.when(n < 0, n)), list=J.array_value(n, F.lit(True)))
    whole = F.concat(F.lit('{"K":[1,{"z":'), (n / F.lit(7)).cast("string"), F.lit('}],"a":"'), F.col("event_type"), F.lit('"}'))
    near = F.concat(F.lit('{"A":"'), F.col("event_type"), F.lit('","k":[1.0,{"Z":'), (n / F.lit(7) * F.lit(1 + 2.0**-53)).cast("string"), F.lit("}]}"))
    odd = F.when(n % 5 == 0, F.lit(float("nan"))).when(n % 5 == 1, F.lit(float("inf"))).otherwise(n / F.lit(4))
    return e.select(
        "event_id",
        J.minified(spaced).alias("minified"),
        J.unparse(v).alias("made"),
        J.string_value(v, "$.type").alias("string"),
        J.kind(v, "$.none").alias("none"),
        J.compare(whole, near, False).alias("any_case"),
        J.compare(whole, near, True).alias("exact_case"),
        J.equal_numbers(n / F.lit(3), n / F.lit(3) * (1 + 2.0**-52)).alias("close"),
        J.print_number(odd).alias("printed"),
        J.number_list(F.array(odd, n.cast("double"))).alias("numbers"),
        J.string_list(F.array(F.col("event_type"), F.lit('q"'))).alias("strings"),
    )


@query
def q49b_json_items(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    m = J.add_item(F.create_map(F.lit("a"), F.col("c_acctbal"), F.lit("B"), F.lit(1.0)), "a", F.lit(2.0))
    r = J.set_field(F.struct("c_custkey", "c_mktsegment"), "c_mktsegment", F.lit("set"))
    return c.select("c_custkey", F.to_json(m).alias("map"), F.to_json(r).alias("set"), F.to_json(J.drop_field(r, "c_custkey")).alias("dropped"), J.duplicate(F.col("c_acctbal")).alias("copy"))


@query
def q50_value_text(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 1, "rate").otherwise("trend")
    contains = F.when(F.col("l_linenumber") == 2, "data").when(F.col("l_linenumber") == 3, "time").otherwise("default")
    v = F.when(F.col("l_linenumber") == 1, F.col("l_tax")).when(F.col("l_linenumber") == 2, F.floor(F.col("l_extendedprice") * F.col("l_quantity"))).when(F.col("l_linenumber") == 3, F.col("l_extendedprice") * F.col("l_quantity") / 7).otherwise(F.col("l_discount") * 3)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", T.value_text(v, kind, contains).alias("text"))


@query
def q51_is_known(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    known = o.groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("known"))
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "none")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = _table(spark, sf_dir, "customer").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", S.is_known(F.col("known"), wanted).alias("known"), S.flag(~S.is_known(F.col("known"), wanted)).alias("unknown"))


@query
def q52_counter(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), "value")
    return E.metric(e, "counter", ["name"], seconds=120).select("name", F.round("count", 6).alias("count"), F.round("rate", 6).alias("rate"))


@query
def q53_upsert_last(spark, sf_dir):
    """Of new rows with one key the last by an order holds."""
    o = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("owner"), F.col("o_orderpriority").alias("submission"), F.col("o_orderkey").alias("place"))
    return writers.upsert(o.where("place < 0").unionByName(spark.createDataFrame([(1, "1-URGENT", -1), (1, "none", -2)], o.schema)), o, ["owner", "submission"], "place")


@query
def q54_test_file(spark, sf_dir):
    """Labeled transactions through a test file and back."""
    path = _folder(spark, "test")
    rows = P.payloads(_table(spark, sf_dir, "events"))
    score = F.pmod(F.col("idx"), F.lit(6)) / F.lit(5.0)
    write_labeled(rows.withColumns({"expected_fraud_score": score, "expected_approved": S.approved(score)}), "00", path)
    header = readers.test_header(spark, path).select("stats.*")
    entries = readers.test_file(spark, path)
    return entries.crossJoin(header).select("idx", "request.id", "expected_approved", "expected_fraud_score", F.col("request.transaction.amount").alias("amount"), F.col("request.last_transaction").isNull().alias("first"), "total", "fraud_count", "legit_rate", "edge_case_count")


@query
def q55_participants(spark, sf_dir):
    """A file an owner, read back as a folder; a default submission is the owner's first."""
    path = _folder(spark, "participants")
    listed = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    files = listed.groupBy("r_name").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("id"), F.concat(F.lit("repo/"), x["n_nationkey"].cast("string")).alias("repo")))).alias("value"))
    files = files.withColumn("owner", F.col("r_name")).select("owner", "value")
    files.repartition("owner").write.partitionBy("owner").text(path)
    p = readers.participants(spark, path)
    asked = p.select("owner").distinct().withColumn("submission", F.lit("default"))
    return p.join(resolve.resolve(asked, p).withColumnRenamed("submission", "first"), "owner").select("owner", "pos", "id", "repo", "first")


@query
def q56_stream_scores(spark, sf_dir):
    """Transactions arrive as files; each is decided alone against the references: held by each worker or, where they are too many, dealt to cells."""
    rows = vectorize(P.payloads(_table(spark, sf_dir, "events"))).select("idx", "vector")
    rows = materialize(rows, "rows")
    fraud = F.when(F.get("vector", F.lit(12)) >= 0.75, "fraud").otherwise("legit")
    refs = rows.select(F.col("idx").alias("ref_id"), "vector", fraud.alias("label"))
    path = _folder(spark, "arrivals")
    lines = P.payloads(_table(spark, sf_dir, "events").where("event_id % 20 = 0"))
    lines.select(writers.request_json(F.struct(*[c for c in lines.columns if c != "idx"])).alias("value")).write.text(path)
    stream = arrivals(spark, path, 1000)
    if fits(refs):
        scored = drain(score_stream(stream, refs), f"scored_{uuid.uuid4().hex}", mode="append")
    else:
        scored = drain_batches(stream, refs, _folder(spark, "decisions"), _folder(spark, "state"))
    return scored.select(F.substring("id", 4, 20).cast("long").alias("idx"), "fraud_score", "approved")


@query
def q57_config(spark, sf_dir):
    """Category risks from a JSON object, and what they make of each event."""
    path = _folder(spark, "risks")
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", (F.col("n_nationkey") / F.lit(100.0)).alias("risk")))))
    _table(spark, sf_dir, "nation").agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(path)
    risks = read_mcc_risk(spark, path)
    s = _table(spark, sf_dir, "supplier").join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    code = F.when(F.col("s_suppkey") % 3 == 0, F.lit("none")).otherwise(F.col("n_name"))
    return s.select("s_suppkey", S.mcc_risk(code, risks).alias("risk"))


# without a twin in SQL


@query
def q18b_p99_approximate(spark, sf_dir):
    return E.p99_approximate(_table(spark, sf_dir, "events"), ["event_type"], "value")


@query
def q58_file_hashes(spark, sf_dir):
    return readers.sha256_of_files(spark, f"{sf_dir}/nation.parquet")


@query
def q59_stream_micro_batches(spark, sf_dir):
    """The stated transactions, every twentieth event, decided micro-batch by micro-batch with the batch plans."""
    path, out = _folder(spark, "arrivals"), _folder(spark, "decisions")
    events = _table(spark, sf_dir, "events")
    lines = P.payloads(events.where("event_id % 20 = 0"))
    lines.select(writers.request_json(F.struct(*[c for c in lines.columns if c != "idx"])).alias("value")).write.text(path)
    rows = materialize(vectorize(P.payloads(events)).select(F.col("idx").alias("ref_id"), "vector"), "refs")
    refs = rows.withColumn("label", F.when(F.get("vector", F.lit(12)) >= 0.75, "fraud").otherwise("legit"))
    return drain_batches(arrivals(spark, path, 1000), refs, out, _folder(spark, "state"))


def _measured(spark: SparkSession, sf_dir: str, plan: str, **how) -> DataFrame:
    """With `recall`, which tests hold against 0.9."""
    q, r = _vectors(spark, sf_dir)
    found = measured(knn(q, r, plan=plan, skip_self=True, **how), q, r, skip_self=True)
    return found.select("idx", "rank", "ref_id", "label", F.round(F.sqrt("distance"), 6).alias("d"), "recall")


@query
def q40_knn_cells(spark, sf_dir):
    return _measured(spark, sf_dir, "cells", probes=8)


@query
def q41_knn_hashes(spark, sf_dir):
    return _measured(spark, sf_dir, "hashes", width=1.0, tables=4)


@query
def q42_knn_graph(spark, sf_dir):
    return _measured(spark, sf_dir, "graph")


@query
def q43_generated(spark, sf_dir):
    n = _table(spark, sf_dir, "orders").count()
    return generate.references(spark, n).select("ref_id", F.to_json("vector").alias("vector"), "label")


@query
def q44_pcg32(spark, sf_dir):
    return generate.pcg32_rows(spark, 42, _table(spark, sf_dir, "lineitem").count())


@query
def q45_classifier(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    _, r = _vectors(spark, sf_dir)
    model = classifier(r)
    return model.transform(r.withColumn("features", array_to_vector("vector"))).select("ref_id", (F.col("prediction") == 1.0).alias("fraud"))
