"""Mixing, packing, sharding, URL filters and personal data."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone import shared
from marlstone.llm import mixing, packing, pii, sharding, urlfilter
from marlstone.llm.common import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


# mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + ([None] if None in sizes else [])
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    fixed, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2.0 * sizes[s] for s in fixed)
        open_ = [s for s in names if s not in fixed]
        total = sum(w[s] for s in open_)
        share = {s: rest * w[s] / total for s in open_} if total else {}
        over = {s for s in open_ if share[s] > 2.0 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in fixed else share[s] for s in names}
        fixed |= over


def test_mixing(docs, rows, empty):
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _, _ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    source = {(d, size(t)): s for d, t, _, s in rows}
    targets, taken, most = brute_targets(sizes), defaultdict(int), defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(most[s] / 2, 0.02 * targets[s])
    again = mixing.plan(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in want.items() if v})
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_keeps_columns_and_deals_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_ALIKE", 5000)
    names = ["_t", "_times", "_copies", "_alike", "_row", "_kept_row", "row", "t", "copies", "alike", "nth", "part", "chosen"]
    alike = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    other = spark.createDataFrame([(i, "w " * (1 + i % 9), "t" if i % 2 else None) for i in range(200)], "doc_id long, text string, source string")
    docs = alike.unionByName(other).withColumns({n: F.lit(f"own {n}") for n in names})
    got = mixing.plan(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 9 for r in got) and sum(r["n"] for r in got) == 50_200
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.select(names).distinct().collect() == [tuple(f"own {n}" for n in names)]
    assert mixed.where("doc_id IS NULL").count() * 3 == next(r["taken"] for r in got if r["n"] == 50_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.floats(0, 1)), max_size=60), st.integers(0, 99))
def test_flight_keeps_totals(units, seed):
    s, p = [float(a) for a, _ in units], [b if 1e-6 < b < 1 - 1e-6 else float(round(b)) for _, b in units]
    words, count = sum(a * b for a, b in zip(s, p, strict=True)), sum(p)
    mixing.fly(s, p, random.Random(seed))
    assert sum(a * b for a, b in zip(s, p, strict=True)) == pytest.approx(words, abs=1e-3) and sum(p) == pytest.approx(count, abs=1e-5)
    assert sum(0 < x < 1 for x in p) <= 2
    mixing.land(s, p)
    assert set(p) <= {0.0, 1.0}


def test_inclusion_probabilities():
    rng, n = random.Random(1), 4000
    s = [float(rng.randint(1, 50)) for _ in range(12)]
    start = [rng.random() for _ in range(12)]
    mean = np.zeros(12)
    for seed in range(n):
        p = list(start)
        mixing.fly(s, p, random.Random(seed))
        mean += p
    assert np.abs(mean / n - start).max() < 0.04


# packing


def test_packing(docs, rows, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    odd = [(9000 + i, x, "en", "a") for i, x in enumerate(["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|", "x" * 5000 + "<|endoftext|>" * 3000])]
    rows = rows + odd
    docs = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([r[:2] for r in odd], "doc_id long, text string"))
    assert packing.ids_of("a<|endoftext|>b").tolist() == [64, 50256, 65, 0]
    got = packing.pack_documents(docs).collect()
    ids = defaultdict(list)
    for d, text, _, _ in rows:
        ids[d].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    want = Counter()
    for d, copies in ids.items():
        for a in copies:
            for s in range(0, len(a), 1024):
                want[d, s, len(a[s : s + 1024]), zlib.crc32(a[s : s + 1024].tobytes()), len(a)] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and len(parts) <= packing.SEGMENTS
    total = sum(n for parts in sequences.values() for _, n in parts)
    assert 1 - total / (1024 * len(sequences)) < 0.02
    assert packing.pack_documents(empty).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=80))
def test_vector_limits(items):
    v = np.array([(a, 1, min(a, b)) for a, b in items], np.int64).reshape(-1, 3)
    bins, at = packing.pack(v, (50, 4, 30))
    for b in set(bins.tolist()):
        inside = v[bins == b]
        assert len(inside) == 1 or (inside.sum(axis=0) <= (50, 4, 30)).all()
        order = np.argsort(at[bins == b], kind="stable")
        assert inside[order, 0].cumsum().tolist()[-1] == inside[:, 0].sum()
    fit = (v <= (50, 4, 30)).all(axis=1)
    assert len(set(bins.tolist())) <= (~fit).sum() + 1 + 2 * max([0.0, *(v[fit].sum(axis=0) / (50, 4, 30)).tolist()]) + len(v) / 4


def test_conversations(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (2, 0, "assistant", None), (2, 1, None, "x")], "conv_id long, turn long, role string, text string")
    items = {r["conv_id"]: (r["tokens"], r["loss"]) for r in packing.conversation_items(turns).collect()}
    assert items == {1: (5, 2), 2: (2, 0)}
    packed = packing.pack_conversations(turns).collect()
    assert len({r["sequence_id"] for r in packed}) == 1 and sorted(r["offset"] for r in packed) in ([0, 2], [0, 5])
    # Loss binds: more than half of the room for tokens stays free.
    many = spark.createDataFrame([(i, 0, "assistant", "word " * 30) for i in range(40)], "conv_id long, turn long, role string, text string")
    got = packing.pack_conversations(many, (1024, 100, 200)).groupBy("sequence_id").agg(F.sum("tokens").alias("t"), F.sum("loss").alias("l")).collect()
    assert all(r["l"] <= 200 and r["t"] < 512 for r in got) and sum(r["l"] for r in got) == sum(r["t"] for r in got)
    assert packing.pack_conversations(turns.limit(0)).count() == 0


def test_equal_rows_are_dealt_over_groups(spark):
    alike = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = packing.pack_documents(alike).groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("t"), F.countDistinct("sequence_id").alias("s")).collect()
    assert sum(r["n"] for r in got) == 50_000 and len(got) == 13 and max(r["n"] for r in got) < 4600
    assert sum(r["t"] for r in got) / (1024 * sum(r["s"] for r in got)) > 0.97


# sharding


def test_sharding(docs, rows, empty):
    got = sharding.assign(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _, _ in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 24 and r["grown_shard"] in (r["shard"], 24) and r["law"] == "key"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    assert sharding.assign(empty).count() == 0


def test_equal_rows_get_their_slots(spark):
    docs = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("alike"))
    got = sharding.assign(docs).agg(F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.countDistinct("shard")).first()
    assert tuple(got) == (50_000, 0, 49_999, 1)


def test_sharding_writes_no_files(spark, docs, rows):
    before = shared.written()
    assert sharding.assign(docs).count() == len(rows) and shared.written() == before
    assert int(small_batches(spark).conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def brute_shard(key, tree, draw):
    level = tree
    while True:
        name, weight, below = min(level, key=lambda c: -math.log((draw(key, c[0]) + 0.5) / 2.0**53) / c[1])
        if isinstance(below, int):
            return below
        level = below


def test_the_descent_against_a_plain_loop(spark):
    tree, n = sharding.layout(25), 300
    names = [g[0] for g in tree] + [k[0] for g in tree for k in g[2]] + [s[0] for g in tree for k in g[2] for s in k[2]]
    draws = spark.range(n).select("id", *[F.shiftrightunsigned(F.xxhash64("id", F.lit(x)), 11).alias(f"`{x}`") for x in names]).collect()
    u = {(r[0], x): r[i + 1] for r in draws for i, x in enumerate(names)}
    got = {r[0]: r[1] for r in spark.range(n).select("id", sharding.shard_of([F.col("id")], tree)).collect()}
    assert got == {k: brute_shard(k, tree, lambda k, x: u[k, x]) for k in range(n)}


def test_shards_fill_by_weight_and_move_only_into_the_new_one(spark):
    keys = spark.range(40_000)
    shard = lambda n: sharding.shard_of([F.col("id")], sharding.layout(n))
    moves = keys.select(shard(24).alias("a"), shard(25).alias("b"), shard(26).alias("c")).collect()
    assert all(r["b"] in (r["a"], 24) and r["c"] in (r["b"], 25) for r in moves)
    share = Counter(r["b"] for r in moves)
    assert len(share) == 25 and all(abs(n / 40_000 - 1 / 25) < 0.008 for n in share.values())


def test_a_changed_weight_moves_keys_into_its_subtree_only(spark):
    tree = sharding.layout(24)
    name, weight, racks = tree[1]
    heavier = [tree[0], (name, weight * 2, racks), tree[2]]
    df = spark.range(5000).select(sharding.shard_of([F.col("id")], tree).alias("a"), sharding.shard_of([F.col("id")], heavier).alias("b"))
    assert all(r["a"] == r["b"] or 8 <= r["b"] < 16 for r in df.collect())


# URL filters


def brute_screen(captures, changes):
    log = defaultdict(dict)
    for kind, value, listed, action in changes:
        if None not in (kind, value, listed, action):
            log[kind, value][listed] = max(action, log[kind, value].get(listed, ""))
    out = []
    for page, url, fetched in captures:
        u = urlsplit((url or "").strip(" "))
        host = (u.hostname or "").rstrip(".") if u.scheme else ""
        keys = []
        if host:
            host, labels = (f"[{host}]", [f"[{host}]"]) if ":" in host else (host, host.split("."))
            keys = [("host", host), *(("domain", ".".join(labels[i:])) for i in range(max(1, len(labels) - 1)))]
            first = u.path[1:].split("/")[0]
            keys += [("prefix", f"{host}/{first}")] if first else []
        hits = set()
        for k in keys:
            past = [d for d in log.get(k, {}) if fetched is not None and d <= fetched]
            if past and log[k][max(past)] == "add":
                hits.add((*k, max(past)))
        first = min(hits) if hits else (None, None, None)
        out.append((page, url, fetched, bool(hits), *first, len(hits)))
    return out


def test_url_filters(spark):
    import datetime

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    rng = random.Random(4)
    urls = ["http://a.b.example.com/x/y", "HTTPS://User:pw@B.Example.com.:8080/x?q", "ftp://c.org", "no url", None, "", "http:///x", "http://ä.example.com/ü", "http://" + "l." * 300 + "deep.net/p", "http://c.org/list/1"]
    urls += ["HTTP://C.org/list/2", "http://[::1]/x", "HTTP://u@[2001:DB8::1]:80/y/z", "http://a@b@c.org/list", " http://c.org/list ", "http://C.ORG:99?q=/list", "//c.org/list", "http://1.2.3.4/list/"]
    captures = [(i, rng.choice(urls), None if i == 5 else day(rng.randint(0, 50))) for i in range(600)] + [(1000, urls[0], day(9))] * 3 + [(None, urls[0], day(9))]
    values = [("host", "a.b.example.com"), ("domain", "example.com"), ("domain", "c.org"), ("prefix", "c.org/list"), ("prefix", "b.example.com/x"), ("host", None), ("domain", "deep.net"), ("host", "[::1]"), ("domain", "[2001:db8::1]"), ("prefix", "[::1]/x"), ("host", "1.2.3.4")]
    changes = [(*rng.choice(values), None if rng.random() < 0.05 else day(rng.randint(0, 50)), rng.choice(["add", "remove"])) for _ in range(90)]
    c = spark.createDataFrame(captures, "page_id long, url string, fetched date").withColumn("kind", F.lit("clash")).withColumn("since", F.lit(1))
    e = spark.createDataFrame(changes, "kind string, value string, listed date, action string")
    got = sorted((tuple(r) for r in urlfilter.screen(c, e).collect()), key=str)
    assert got == sorted(brute_screen(captures, changes), key=str)
    assert urlfilter.screen(c.limit(0), e).count() == 0 and not any(r["blocked"] for r in urlfilter.screen(c, e.limit(0)).collect())


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
    return out


def test_personal_data(spark):
    rng = random.Random(8)
    bits = ["a@b.c", "@d.e", "x_y@q.rs-t.u", "1.2.3.4", ".5", "256.1.1.1", "007.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (974) 555-3436", "+49.30.1234567", "+", "ü", "😀", " ", "\n", "-", "9", "(555) 123-4567", "call ", "GB82WEST12345698765432", "DE89370400440532013000", "DE89370400440532013001", "12345678901234567890123", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "1 " * 30_000 + "a@b.c", "9" * 200_000, "a" * 200_000 + "@", "1.2.3.4 " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("email", F.lit(2))
    for r in pii.find(df).collect():
        want = brute_base(texts[r["doc_id"]] or "") if r["doc_id"] != 404 else []
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        spans = r["spans"].split(",") if r["spans"] else []
        assert spans[: len(want)] == want and all(s.startswith(("iban:", "phone_local:")) for s in spans[len(want) :])
        assert len(spans) == (len(r["scores"].split(",")) if r["scores"] else 0)
    assert pii.find(df.limit(0)).count() == 0


def test_checks_and_context(spark):
    text = "iban GB82WEST12345698765432 and GB82WEST12345698765433, call (555) 123-4567 or far away from any hint of what it is (555) 123-4567"
    r = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["spans"] == f"iban:5:27,phone_local:{text.index('(555)')}:{text.index('(555)') + 14}" and r["scores"] == "100,60"
    kept = spark.createDataFrame([(1, "mail a@b.c now, +1 (974) 555-3436 and 1.2.3.4!", 9), (2, None, None)], "doc_id long, text string, n_chars long")
    out = pii.redact(kept).orderBy("doc_id").collect()
    assert out[0]["text"] == "mail <EMAIL> now, <PHONE> and <IP>!" and out[0]["n_chars"] == len(out[0]["text"]) and out[1]["text"] is None
    assert math.isclose(pii.CONTEXT, 20)


def test_context_of_lists_and_printed_ibans(spark):
    numbers = ["(555) 123-4567", "(555) 765-4321", "(555) 222-3333"]
    text = f"call {numbers[0]} or {numbers[1]}, {numbers[2]}; DE89 3704 0044 0532 0130 00 AND GB82 WEST 1234 5698 7654 33, GB82 WEST 1234 5698 7654 32"
    far = "no hint here (555) 123-4567 or (555) 765-4321"
    df = spark.createDataFrame([(1, text), (2, far), (3, "+1 (974) 555-3436 or (555) 765-4321")], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    span = lambda kind, s: f"{kind}:{text.index(s)}:{text.index(s) + len(s)}"
    assert found[1].split(",") == [span("iban", "DE89 3704 0044 0532 0130 00"), span("iban", "GB82 WEST 1234 5698 7654 32"), *[span("phone_local", n) for n in numbers]]
    assert found[2] == "" and found[3] == "phone:0:17"
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[1] == "call <PHONE_LOCAL> or <PHONE_LOCAL>, <PHONE_LOCAL>; <IBAN> AND GB82 WEST 1234 5698 7654 33, <IBAN>"
    assert out[2] == far and out[3] == "<PHONE> or (555) 765-4321"
