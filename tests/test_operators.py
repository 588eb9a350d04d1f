import json
import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone import generate, queries, report, schemas, shared
from marlstone.cli import parser
from marlstone.functions import jsonfns as J
from marlstone.functions import scalar as S
from marlstone.operators import evaluate as E
from marlstone.operators import boxes
from marlstone.operators import knn as N
from marlstone.operators import resolve
from marlstone.operators.vectorize import vectorize
from marlstone.operators.vote import majority, vote, weighted
from marlstone.plans import scoring
from marlstone.sources import readers, writers
from marlstone.streaming import scorer

SF = "/root/testdata/sf0.1"
# Two transactions of the documentation.
LEGIT = {
    "id": "tx-1", "transaction": {"amount": 41.12, "installments": 2, "requested_at": "2026-03-11T18:45:53Z"},
    "customer": {"avg_amount": 82.24, "tx_count_24h": 3, "known_merchants": ["MERC-003", "MERC-016"]},
    "merchant": {"id": "MERC-016", "mcc": "5411", "avg_amount": 60.25},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 29.23}, "last_transaction": None,
}
FRAUD = {
    "id": "tx-2", "transaction": {"amount": 9505.97, "installments": 10, "requested_at": "2026-03-14T05:15:12Z"},
    "customer": {"avg_amount": 81.28, "tx_count_24h": 20, "known_merchants": ["MERC-008", "MERC-007", "MERC-005"]},
    "merchant": {"id": "MERC-068", "mcc": "7802", "avg_amount": 54.86},
    "terminal": {"is_online": False, "card_present": True, "km_from_home": 952.27}, "last_transaction": None,
}


@pytest.fixture(scope="module")
def payloads_text():
    last = dict(LEGIT, last_transaction={"timestamp": "2026-03-11T17:45:53Z", "km_from_current": 100})
    return json.dumps([LEGIT, FRAUD, last, dict(LEGIT, customer=dict(LEGIT["customer"], avg_amount=0))])


@pytest.fixture(scope="module")
def payloads(spark, tmp_path_factory, payloads_text):
    path = tmp_path_factory.mktemp("p") / "payloads.json"
    path.write_text(payloads_text)
    return readers.payloads(spark, str(path))


def test_documented_vectors(payloads):
    got = [r["vector"] for r in vectorize(payloads).orderBy("idx").collect()]
    assert got[0] == [0.0041, 0.1667, 0.05, 0.7826, 0.3333, -1, -1, 0.0292, 0.15, 0, 1, 0, 0.15, 0.006]
    assert got[1] == [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1.0, 0, 1, 1, 0.75, 0.0055]
    assert got[2][5:7] == [0.0417, 0.1] and got[3][2] == 1.0


def _tied(spark, n, seed=0, dims=14):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 3, (n, dims)) / 2
    x[:, 5] = x[:, 6] = np.where(rng.random(n) < 0.2, -1, 0.5)
    x[:, 9:12] = rng.integers(0, 2, (n, 3))
    return [(i, v.tolist(), "fraud" if rng.random() < 0.4 else "legit") for i, v in enumerate(x)]


def _brute(queries, refs, k, metric="l2"):
    out = []
    for i, v, _ in queries:
        d = sorted((sum((a - b) ** 2 if metric == "l2" else abs(a - b) for a, b in zip(v, w, strict=True)), j) for j, w, _ in refs)
        out += [(i, j, n + 1) for n, (_, j) in enumerate(d[:k])]
    return sorted(out)


@pytest.mark.parametrize("plan,metric", [("blocks", "l2"), ("blocks", "l1"), ("join", "l2"), ("buckets", "l2"), ("pivots", "l2"), ("pivots", "l1")])
def test_exact_plans_with_ties(spark, plan, metric):
    refs, queries = _tied(spark, 400), _tied(spark, 40, 1)
    r = spark.createDataFrame(refs, "ref_id long, vector array<double>, label string")
    q = spark.createDataFrame([x[:2] for x in queries], "idx long, vector array<double>")
    got = sorted((x["idx"], x["ref_id"], x["rank"]) for x in N.knn(q, r, 5, metric, plan).collect())
    assert got == _brute(queries, refs, 5, metric)


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_buckets_in_many_cells(spark, monkeypatch, metric):
    """Equal to brute force where neighbors lie in other cells; NaN and missing numbers have none."""
    monkeypatch.setattr(N, "_CELL", 40)
    refs, queries = _tied(spark, 600, 3), _tied(spark, 40, 4)
    odd = [(9000, [float("nan")] * 14, "fraud"), (9001, [None] * 14, "fraud"), (9002, [float("inf")] * 14, "fraud")]
    r = spark.createDataFrame(refs + odd, "ref_id long, vector array<double>, label string")
    q = spark.createDataFrame([x[:2] for x in queries + odd], "idx long, vector array<double>")
    got = sorted((x["idx"], x["ref_id"], x["rank"]) for x in N.knn(q, r, 5, metric, "buckets").collect())
    assert got == _brute(queries, refs, 5, metric)
    none = N.knn(q, r.where("ref_id < 0"), 5, metric, "buckets")
    assert none.count() == 0


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_boxes_leave_most_references_out(monkeypatch, metric):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((40_000, 5)), 2)
    ids = rng.permutation(len(x))
    read, leaves = [0], boxes.Boxes._leaves
    monkeypatch.setattr(boxes.Boxes, "_leaves", lambda self, y, k, own, kth, best, row, leaf: (read.append(len(row)), leaves(self, y, k, own, kth, best, row, leaf))[1])
    row, col, d = boxes.Boxes(x, ids, metric).search(x[:500], 5, ids[:500])
    all_d = N.distances(metric, x[:500], x)
    all_d[ids[:500][:, None] == ids] = np.nan
    r, c = N._best(all_d, ids, 5)
    assert (row == r).all() and (col == c).all() and (d == all_d[r, c]).all()
    assert sum(read) * boxes.LEAF < 0.05 * 500 * len(x)


@pytest.mark.parametrize("plan", ["cells", "hashes", "graph"])
def test_approximate_plans(spark, plan):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), "fraud") for i, v in enumerate(rng.random((600, 14)))]
    r = spark.createDataFrame(rows, "ref_id long, vector array<double>, label string")
    q = r.where("ref_id < 60").select(F.col("ref_id").alias("idx"), "vector")
    found = N.knn(q, r, 5, plan=plan, skip_self=True, probes=8, width=0.3, tables=6)
    assert N.recall(found, N.knn(q, r, 5, skip_self=True)) >= 0.9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["q40_knn_cells", "q41_knn_hashes", "q42_knn_graph"])
def test_recall_as_registered(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert N.recall(found, queries.QUERIES["q02_knn_l2"](spark, SF)) >= 0.9 and found.agg(F.min("recall")).first()[0] >= 0.9


def test_nan_and_few_references(spark):
    r = spark.createDataFrame([(0, [1.0, 2.0], "fraud"), (1, [float("nan"), 0.0], "legit")], "ref_id long, vector array<double>, label string")
    q = spark.createDataFrame([(7, [1.0, 1.0]), (8, [float("nan"), 1.0])], "idx long, vector array<double>")
    for plan in ("blocks", "join", "pivots"):
        assert [(x["idx"], x["ref_id"]) for x in N.knn(q, r, plan=plan).collect()] == [(7, 0)]
    scores = {x["idx"]: (x["fraud_score"], x["approved"]) for x in vote(N.knn(q, r), q).collect()}
    assert scores == {7: (0.2, True), 8: (0.0, True)}


def test_empty_tables(spark):
    r = spark.createDataFrame([], "ref_id long, vector array<double>, label string")
    q = spark.createDataFrame([], "idx long, vector array<double>")
    assert N.knn(q, r).count() == 0 and E.stats(spark.createDataFrame([], "fraud_score double, approved boolean")).first()["fraud_rate"] == 0


def test_votes(spark):
    n = spark.createDataFrame([(1, "fraud", 0.0), (1, "legit", 1.0), (1, "fraud", 4.0)], "idx long, label string, distance double")
    assert majority(n).first()["fraud"]
    w = [1 / 1e-6, 1 / (1 + 1e-6), 1 / (2 + 1e-6)]
    assert weighted(n).first()["score"] == pytest.approx((w[0] + w[2]) / sum(w))


SCORES = [(0, 0, 0, 1.0, 6000.0), (5, 5, 0, 3.0, 4524.15), (0, 0, 0, 100.0, 4000.0), (30, 20, 0, 10.0, 3157.02), (100, 50, 0, 300.0, 1104.01), (500, 250, 0, 200.0, 371.85), (500, 300, 0, 10.0, -1000.0), (0, 0, 5000, 60000.0, -6000.0)]


def test_score_table(spark):
    rows = [(0, 5000 - fp - fn - err, fp, fn, err, p99) for fp, fn, err, p99, _ in SCORES]
    df = spark.createDataFrame(rows, "tp long, tn long, fp long, fn long, err long, p99 double")
    got = [r["final_score"] for r in E.scored(E.errors(df)).collect()]
    assert got == pytest.approx([s[-1] for s in SCORES], abs=0.006)


def test_outcomes(spark):
    expected = spark.createDataFrame([(i, i % 2 == 0) for i in range(8)], "idx long, expected_approved boolean")
    answers = spark.createDataFrame([(0, True, 200, 1.0), (1, False, 200, 1.0), (2, False, 200, 1.0), (3, True, 200, 1.0), (4, True, 500, 1.0), (5, None, 200, 1.0), (6, True, 200, 3000.0)], "idx long, approved boolean, status int, duration_ms double")
    got = {r["idx"]: r["class"] for r in E.judge(expected, answers).collect()}
    assert got == {0: "tn", 1: "tp", 2: "fp", 3: "fn", 4: "err", 5: "fp", 6: "err", 7: "err"}
    doc = scoring.evaluate_run(expected, answers).first()
    assert doc["scoring"]["detection_score"]["rate_component"] is None and doc["scoring"]["breakdown"]["http_errors"] == 3


def test_nothing_was_measured(spark):
    empty = spark.createDataFrame([], "idx long, class string, duration_ms double")
    doc = E.result(empty).first()
    assert doc["p99"] == 0 and doc["scoring"]["final_score"] == 3000


def test_files(spark, tmp_path):
    refs = tmp_path / "refs.json"
    refs.write_text(json.dumps([{"vector": [i / 10] * 14, "label": "fraud"} for i in range(3)]))
    table = readers.references(spark, str(refs))
    assert [r["ref_id"] for r in table.orderBy("ref_id").collect()] == [0, 1, 2]
    readers.store_references(table, str(tmp_path / "refs.parquet"))
    assert readers.stored_references(spark, str(tmp_path / "refs.parquet")).count() == 3
    refs.write_text(json.dumps([{"vector": [1.0], "label": "fraud"}]))
    with pytest.raises(Exception, match="reference 0"):
        readers.references(spark, str(refs)).collect()
    (tmp_path / "who").mkdir()
    (tmp_path / "who" / "ann.json").write_text('[{"id": "a", "repo": "r"}, {"id": "b", "repo": "s"}]')
    people = readers.participants(spark, str(tmp_path / "who"))
    wanted = spark.createDataFrame([("ann", "default"), ("ann", "b"), ("bob", "default")], "owner string, submission string")
    assert sorted(r["submission"] or "" for r in resolve.resolve(wanted, people).collect()) == ["", "a", "b"]
    hashed = readers.sha256_of_files(spark, str(tmp_path / "who" / "*.json")).first()["sha256"]
    import hashlib

    assert hashed == hashlib.sha256((tmp_path / "who" / "ann.json").read_bytes()).hexdigest()
    row = spark.createDataFrame([(1, None)], "a int, b string")
    writers.write_document(row, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"a":1,"b":null}'


def test_generated_rows(spark):
    t = generate.transactions(spark, 3000, 0.3)
    share = {r["profile"]: r["count"] / 3000 for r in t.groupBy("profile").count().collect()}
    assert share["legit"] == pytest.approx(0.7, abs=0.04) and share["borderline"] == pytest.approx(0.03, abs=0.015)
    legit = t.where("profile = 'legit'")
    assert legit.where("transaction.amount < 10 OR transaction.amount > 500 OR NOT array_contains(customer.known_merchants, merchant.id)").count() == 0
    assert t.where("terminal.is_online AND terminal.card_present").count() == 0
    assert t.orderBy("idx").collect() == generate.transactions(spark, 3000, 0.3).repartition(7).orderBy("idx").collect()
    refs = generate.references(spark, 2000)
    labeled = scoring.label(generate.transactions(spark, 60, 0.47, 4141, True), refs)
    r, q = [(x["ref_id"], x["vector"], x["label"]) for x in refs.collect()], [(x["idx"], x["vector"], "") for x in vectorize(labeled).collect()]
    label = {i: lab for i, _, lab in r}
    votes = {}
    for i, j, _ in _brute(q, r, 5):
        votes[i] = votes.get(i, 0) + (label[j] == "fraud")
    assert {x["idx"]: x["expected_fraud_score"] for x in labeled.collect()} == {i: round(v / 5, 4) for i, v in votes.items()}


def _pcg(seed, n):
    mask, inc = (1 << 64) - 1, (seed << 1) | 1
    state, out = 0, []
    state = (state * 6364136223846793005 + inc + seed) & mask
    state = (state * 6364136223846793005 + inc) & mask
    for _ in range(n):
        x = (((state >> 18) ^ state) >> 27) & 0xFFFFFFFF
        turn = state >> 59
        out.append(((x >> turn) | (x << (-turn % 32))) & 0xFFFFFFFF)
        state = (state * 6364136223846793005 + inc) & mask
    return out


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**63), st.integers(0, 300), st.integers(0, 300))
def test_pcg_jumps(seed, start, n):
    assert generate.pcg32(seed, start, n).tolist() == _pcg(seed, start + n)[start:]


def test_pcg_rows(spark):
    assert [r["u32"] for r in generate.pcg32_rows(spark, 42, 100, 30).orderBy("i").collect()] == _pcg(42, 100)


def test_stream(spark, tmp_path, monkeypatch):
    made = generate.transactions(spark, 200, seed=9)
    made.drop("idx", "profile").repartition(3).write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    refs = generate.references(spark, 300)
    decisions = scorer.score_stream(scorer.dealt(scorer.arrivals(spark, str(tmp_path / "in")), 2), refs)
    counts = scorer.drain(scorer.running_counts(decisions, "approved"), "stream_counts")
    batch = scoring.decide(made, refs).groupBy("approved").count()
    assert {r["approved"]: r["n"] for r in counts.collect()} == {r["approved"]: r["count"] for r in batch.collect()}
    seen = {}
    query = scorer.decide_each_batch(scorer.arrivals(spark, str(tmp_path / "in"), 10), refs, lambda df, epoch: seen.__setitem__(epoch, df.count())).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(seen.values()) == 200 and not scorer.health(query)["active"]
    with pytest.raises(ValueError, match="decide_each_batch"):
        monkeypatch.setattr(scorer, "MOST_HELD", 1000)
        scorer.score_stream(scorer.arrivals(spark, str(tmp_path / "in")), refs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stream_of_more_references_than_workers_hold(spark, tmp_path, monkeypatch):
    small = SF.replace("sf0.1", "sf0.001")
    held = sorted(map(tuple, queries.q56_stream_scores(spark, small).collect()))
    monkeypatch.setattr(scorer, "MOST_HELD", 1000)
    assert held and sorted(map(tuple, queries.q56_stream_scores(spark, small).collect())) == held


def test_drained_batches(spark, tmp_path):
    made = shared.materialize(generate.transactions(spark, 90, seed=9))
    made.drop("idx", "profile").repartition(3).write.option("ignoreNullFields", "false").json(str(tmp_path / "in"))
    refs = shared.materialize(generate.references(spark, 300))
    at, state = str(tmp_path / "out"), str(tmp_path / "state")
    before = shared.written()
    found = scorer.drain_batches(scorer.arrivals(spark, str(tmp_path / "in")), refs, at, state)
    assert shared.written() == before
    want = made.join(scoring.decide(made, refs), "idx").select("id", "fraud_score", "approved")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"none", "0", "1", "2"}
    (tmp_path / "nothing").mkdir()
    assert scorer.drain_batches(scorer.arrivals(spark, str(tmp_path / "nothing")), refs, at + "2", state + "2").count() == 0


def test_elements_that_are_no_transactions(spark, tmp_path, payloads_text):
    good = json.loads(payloads_text)[:2]
    path = tmp_path / "payloads.json"
    path.write_text("\ufeff" + json.dumps([good[0], {"id": 5, "transaction": "x"}, 7, None, good[1], {**good[0], "transaction": {**good[0]["transaction"], "amount": "much"}}]))
    rows = readers.payloads(spark, str(path)).orderBy("idx").collect()
    assert [r["malformed"] for r in rows] == [False, True, True, True, False, True] and [r["idx"] for r in rows] == list(range(6))
    assert rows[4]["transaction"]["amount"] == good[1]["transaction"]["amount"]
    path.write_text(json.dumps(good)[:-3])
    assert [r["malformed"] for r in readers.payloads(spark, str(path)).collect()] == [True]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join([json.dumps(good[0]), "{oops", json.dumps(good[1])]))
    assert sorted(r["malformed"] for r in readers.payload_lines(spark, str(lines)).collect()) == [False, False, True]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_vectors_in_any_time_zone(spark, payloads, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    want = [tuple(r["vector"]) for r in vectorize(payloads).orderBy("idx").collect()]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert [tuple(r["vector"]) for r in vectorize(payloads).orderBy("idx").collect()] == want
        t = spark.sql("SELECT explode(array(0L, -1L, 1773253553L, 4102444799L)) AS e")
        got = t.select(S.timestamp_text(F.col("e")), S.epoch_of(S.timestamp_text(F.col("e"))), "e").collect()
        assert [r[0] for r in got] == ["1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "2026-03-11T18:25:53Z", "2099-12-31T23:59:59Z"] and all(r[1] == r[2] for r in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_references_in_splits(spark, tmp_path):
    import gzip

    made = [{"vector": [round(i / 7, 4)] * 14, "label": "fraud" if i % 3 else "legit"} for i in range(4000)]
    compact, pretty = tmp_path / "compact.json", tmp_path / "pretty.json"
    compact.write_text(json.dumps(made, separators=(",", ":")))
    pretty.write_text("\ufeff" + json.dumps(made, indent=2) + "\n")
    with gzip.open(tmp_path / "small.json.gz", "wt") as f:
        f.write(json.dumps(made))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        for path in (compact, pretty, tmp_path / "small.json.gz"):
            df = readers.references(spark, str(path))
            got = df.orderBy("ref_id").collect()
            assert [(r["ref_id"], r["vector"], r["label"]) for r in got] == [(i, m["vector"], m["label"]) for i, m in enumerate(made)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_command_line_round_trip(spark, tmp_path):
    from marlstone import cli

    out, refs = str(tmp_path / "test-data"), str(tmp_path / "refs")
    assert cli.main(["--refs", "50", "--payloads", "40", "--refs-out", refs, "--payloads-out", out]) == 0
    entries = readers.test_file(spark, out).orderBy("idx").collect()
    header = readers.test_header(spark, out).collect()
    assert len(entries) == 40 and [r["idx"] for r in entries] == list(range(40)) and len(header) == 1
    stats = header[0]["stats"]
    assert stats["total"] == 40 and stats["fraud_count"] == sum(not r["expected_approved"] for r in entries) and len(header[0]["references_checksum_sha256"]) == 64
    whole = json.loads("".join(x.read_text() for x in sorted((tmp_path / "test-data").glob("part-*"))))
    assert list(whole) == ["references_checksum_sha256", "stats", "entries"] and len(whole["entries"]) == 40
    again = scoring.decide(readers.test_file(spark, out).select("idx", "request.*"), readers.stored_references(spark, refs)).collect()
    off = sum({r["idx"]: r["fraud_score"] for r in again}[r["idx"]] != r["expected_fraud_score"] for r in entries)
    assert off <= 1  # printed numbers may differ at a rounding edge
    assert cli.main(["--refs-in", refs, "--reuse-refs", "--payloads", "5", "--payloads-out", out, "--pretty-json"]) == 0
    assert readers.test_file(spark, out).count() == 5


def test_the_last_of_repeated_keys_is_stored(spark):
    store = spark.createDataFrame([("a", "x", 1, 0), (None, "y", 2, 0)], "owner string, submission string, v int, at int")
    new = spark.createDataFrame([("a", "x", 9, 1), ("a", "x", 3, 2), (None, "y", 7, 1), ("b", "z", 5, 1), ("b", "z", 4, 3)], store.schema)
    got = {(r["owner"], r["submission"]): r["v"] for r in writers.upsert(store, new, ["owner", "submission"], "at").collect()}
    assert got == {("a", "x"): 3, (None, "y"): 7, ("b", "z"): 4} and writers.upsert(store, new, ["owner", "submission"], "at").count() == 3


def test_served_decisions(spark, payloads_text, payloads):
    import threading
    import urllib.error
    import urllib.request

    from marlstone import serve

    refs = generate.references(spark, 60)
    made = serve.server(refs, port=0, timeout=60)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{made.server_address[1]}"

    def post(body: str) -> tuple[int, dict]:
        try:
            with urllib.request.urlopen(urllib.request.Request(base + "/fraud-score", body.encode(), {"Content-Type": "application/json"})) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, {}

    try:
        with urllib.request.urlopen(base + "/ready") as r:
            assert r.status == 200
        bodies = [json.dumps(x) for x in json.loads(payloads_text)]
        answers: dict[int, tuple[int, dict]] = {}
        threads = [threading.Thread(target=lambda i=i: answers.__setitem__(i, post(bodies[i]))) for i in range(len(bodies))]
        for t in threads:
            t.start()
        assert post("{oops")[0] == 400 and post('{"id": "x"}')[0] == 400
        for t in threads:
            t.join()
        want = {r["idx"]: (200, {"approved": r["approved"], "fraud_score": r["fraud_score"]}) for r in scoring.decide(payloads, refs).collect()}
        assert answers == want
    finally:
        made.shutdown()
        made.server_close()
        made.scorer.close()


def test_approximate_p99(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("g"), (F.pmod(F.xxhash64("id"), F.lit(100_000)) / 10).alias("duration_ms"))
    exact = {r["g"]: sorted(x["duration_ms"] for x in rows.where(F.col("g") == r["g"]).collect()) for r in rows.select("g").distinct().collect()}
    for r in E.p99_approximate(rows, ["g"]).collect():
        at = np.searchsorted(exact[r["g"]], r["p99"], side="right") / len(exact[r["g"]])
        assert abs(at - 0.99) < 0.001
    judged = rows.select(F.lit("tp").alias("class"), "duration_ms")
    assert abs(E.result(judged, exact=False).first()["p99"] - E.result(judged).first()["p99"]) < 20


def test_json_values(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    text = '{ "b": 1, /* c */ "a" : "x  // y", "b" : 2 } // end'
    assert value(J.minified(F.lit(text))) == '{"b":1,"a":"x  // y","b":2}'
    assert [value(J.print_number(F.lit(x))) for x in (1.0, -2.5, float("nan"), float("-inf"), 0.1)] == ["1", "-2.5", "null", "null", "0.1"]
    assert value(J.unparse(F.struct(J.finite(F.lit(float("nan"))).alias("a"), J.finite(F.lit(1.5)).alias("b")))) == '{"b":1.5}'
    same = lambda a, b, case=True: value(J.compare(F.lit(a), F.lit(b), case))
    assert same('{"a":[1,{"b":0.1}],"c":null}', '{"c":null,"a":[1.0,{"b":0.10000000000000002}]}') and not same('{"a":1}', '{"A":1}') and same('{"a":1}', '{"A":1}', False)
    assert not same("[1,2]", "[2,1]") and not same("1", "true") and not same("{oops", "{oops") and not same('{"a":1}', '{"a":1,"b":2}')
    assert value(J.kind(J.null_value())) == "null" and value(J.string_value(J.raw_value(F.lit('"x"')))) == "x"


def test_reports_leave_nothing_out(spark):
    many = spark.range(10_050).select(F.concat(F.lit("m"), "id").alias("metric"), F.lit("p<1").alias("threshold"), (F.col("id") % 2 == 0).alias("ok"))
    from xml.etree import ElementTree

    root = ElementTree.fromstring(report.thresholds_xml(many, "all & more"))
    assert root.attrib == {"tests": "10050", "failures": "5025"} and len(root[0]) == 10_050 and root[0].attrib["name"] == "all & more"
    assert sum(len(case) for case in root[0]) == 5025
    assert len(report.table(many).splitlines()) == 10_050 + 4


def test_groups_of_checks(spark):
    checks = spark.createDataFrame([("", "root", 2, 0, 0), ("a::b", "inner", 1, 1, 2), ("a", "outer", 3, 0, 1)], "group string, name string, passes long, fails long, at long")
    lines = report.checks_text(checks, " ").splitlines()
    assert lines == [" ✓ root", "", " █ a", "", "   ✓ outer", "", "   █ b", "", "     ✗ inner", "      ↳  50% — ✓ 1 / ✗ 1"]
    m = spark.createDataFrame([("a", "10")], "name string, value string")
    assert report.summary_text(checks, m).endswith("   a...: 10")


def test_reports(spark):
    stages = spark.createDataFrame([(1, 120, 900)], "stage int, duration int, target int")
    box = report.table(E.ramp(stages, 1), {"stage": "total", "cumulative": 54060})
    assert "54060" in box and box.startswith("┌") and len({len(line) for line in box.splitlines()}) == 1
    m = spark.createDataFrame([("b{x:1}", "2", "", True), ("a", "10", "min=1", None)], "name string, value string, extra string, ok boolean")
    assert report.metrics_text(m).splitlines() == ["    a...........: 10 min=1", "    ✓ { x:1 }...: 2"]
    assert "50%" in report.checks_text(spark.createDataFrame([("c", 1, 1)], "name string, passes long, fails long"))
    xml = report.thresholds_xml(spark.createDataFrame([("a&b", "p<1", False)], "metric string, threshold string, ok boolean"))
    assert 'failures="1"' in xml and "a&amp;b - p&lt;1" in xml


def test_defaults():
    o = parser().parse_args([])
    assert (o.refs, o.payloads, o.refs_seed, o.payloads_seed) == (200, 1000, 42, 4242)
    assert len(schemas.DIMENSIONS) == 14 and math.isclose(sum([0.1] * 10), 1)


def test_edit_neighbors(spark):
    words = ["", "a", "ab", "abc", "abd", "xabc", "bac"]
    w = spark.createDataFrame([(x,) for x in words], "word string")

    def near(a, b):
        return a == b or any(a[:i] + a[i + 1 :] in {b} | {b[:j] + b[j + 1 :] for j in range(len(b))} and abs(len(a) - len(b)) <= 1 for i in range(len(a))) or any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    got = {(r["word"], r["other"]) for r in N.edit_neighbors(w, w.withColumnRenamed("word", "other")).collect()}
    assert ("abc", "bac") not in got and {("a", "ab"), ("abc", "abd"), ("abc", "xabc"), ("", "a")} <= got
    assert all(near(a, b) for a, b in got)


def test_test_file_in_splits(spark, tmp_path):
    """A line an entry is read in splits, in the order of the file; other layouts of the same document give the same rows."""
    made = generate.transactions(spark, 300, seed=4).drop("profile")
    score = F.pmod("idx", F.lit(6)) / F.lit(5.0)
    out, other = str(tmp_path / "lines"), tmp_path / "other.json"
    scoring.write_labeled(made.withColumns({"expected_fraud_score": score, "expected_approved": S.approved(score)}), "00", out)
    text = "\n".join(r[0] for r in spark.read.text(out).collect())
    document = json.loads(text)
    other.write_text(json.dumps(document, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        rows = readers.test_file(spark, out)
        assert rows.select(F.spark_partition_id()).distinct().count() > 1 or rows.rdd.getNumPartitions() > 1
        assert len(spark.read.text(out).inputFiles()) == 1 and readers._by_lines(spark, out) is not None and readers._by_lines(spark, str(other)) is None
        got = rows.orderBy("idx").collect()
        assert [r["idx"] for r in got] == list(range(300)) and [r["request"]["id"] for r in got] == [e["request"]["id"] for e in document["entries"]]
        assert got == readers.test_file(spark, str(other)).orderBy("idx").collect()
        assert readers.test_header(spark, out).collect() == readers.test_header(spark, str(other)).collect()
        two = tmp_path / "two.json"
        two.write_text(text.replace("\n,", ",", 1))
        assert readers._by_lines(spark, str(two)) is None and readers.test_file(spark, str(two)).orderBy("idx").collect() == got
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_hashes_write_no_pairs(spark, monkeypatch):
    """Rows that leave the buckets are at most k a query and block, though all pairs share a bucket."""
    rng = np.random.default_rng(6)
    r = spark.createDataFrame([(i, v.tolist(), "fraud") for i, v in enumerate(rng.random((500, 6)))], "ref_id long, vector array<double>, label string")
    q = r.where("ref_id < 40").select(F.col("ref_id").alias("idx"), "vector")
    kept, within = [], N._blocks_within
    monkeypatch.setattr(N, "_blocks_within", lambda *a, **how: kept.append(within(*a, **how)) or kept[-1])
    found = N.knn(q, r, 5, plan="hashes", skip_self=True, width=100.0, tables=3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, N.knn(q, r, 5, skip_self=True).collect()))
    assert len(kept) == 1 and kept[0].groupBy("idx").count().agg(F.max("count")).first()[0] <= 5 * 3 * 2
