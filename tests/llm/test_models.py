"""Language ID, digests, near duplicates, nearest neighbours, LM scoring, the pipeline."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, components, digest, langid, lm, neardup, queries, shingles

from .conftest import SCHEMA, corpus, edited, prose

# language ID


def test_language(docs, rows, empty):
    model = langid.train(docs, per_lang=100)
    assert model.languages == ["de", "en", "es", "fr"] and set(model.pairs) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}
    got = langid.predict(docs, model).collect()
    assert len(got) == len(rows)
    text = defaultdict(set)
    for d, t, _, _ in rows:
        text[d].add(t)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        lettered = any(t and any(unicodedata.category(c)[0] == "L" for c in t) for t in text[r["doc_id"]])
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] in model.languages if lettered else (r["lang_pred"], r["score"]) == ("und", 0.0))
    lang = {d: lang for d, t, lang, _ in rows if t and len(t.split()) > 20 and d < 240}
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in lang]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    few = langid.train(docs, sample_bytes=4 * 3000)
    assert few.languages == model.languages and sum((few.weights != 0).sum(axis=1)) < 0.9 * sum((model.weights != 0).sum(axis=1))
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["lang_pred"] != "und" for r in got)
    nothing = langid.train(empty)
    assert langid.predict(empty, model).count() == 0 and nothing.languages == []
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"} and langid.keep_known(docs, nothing).count() == kept.count()


def test_predictions_against_a_plain_loop(docs, rows):
    model = langid.train(docs, per_lang=60)
    got = {}
    for r in langid.predict(docs, model).collect():
        got.setdefault(r["doc_id"], (r["lang_pred"], r["score"]))

    def duel(names, z, p):
        won = {a: 0.0 for a in names}
        least, margin = dict.fromkeys(names, 1.0), dict.fromkeys(names, 0.0)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                k = model.pairs[a, b]
                won[a if z[k] >= 0 else b] += 1
                margin[a], margin[b] = margin[a] + z[k], margin[b] - z[k]
                least[a], least[b] = min(least[a], p[k]), min(least[b], 1 - p[k])
        best = max(names, key=lambda n: (won[n], margin[n]))
        return best, least[best]

    for d, t, _, _ in rows:
        if d is None or not t or len(t) > 50_000 or not any(unicodedata.category(c)[0] == "L" for c in t):
            continue
        index, count = langid.features(t)
        z = [float(w[index].astype(float) @ count) / math.sqrt(count.sum() / 3) for w in model.weights]
        p = [1 / (1 + math.exp(-a * x)) for a, x in zip(model.slopes, z, strict=True)]
        if min(abs(x) for x in z) < 1e-3:
            continue  # single precision may decide otherwise
        family, sure = duel(list(model.families), z, p)
        lang, q = duel(model.families[family], z, p)
        assert got[d][0] == lang and got[d][1] == pytest.approx(sure * q, abs=1e-3)


def test_other_scripts_are_rejected(spark, docs):
    model = langid.train(docs, per_lang=60)
    foreign = ["Это совершенно другой язык и другая письменность", "これは別の言語で書かれた文章です", "هذا نص مكتوب بلغة أخرى", "schungen oreau theing verein leitre", "verschung eingen ichzu zuein schver: слово"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in langid.keep_known(df, model).collect()) == [3, 4]
    lettered = langid.predict(docs, model).where("lang_pred <> 'und'").count()
    assert langid.keep_known(docs, model).count() == lettered


def test_sums_do_not_depend_on_the_batch():
    rng = random.Random(0)
    texts = [prose(rng, "de", n) for n in (1, 5, 400, 2)]
    weights = np.random.default_rng(0).standard_normal((1, langid.DIM)).astype(np.float32)
    model = langid.Model(["a", "b"], {"x": ["a", "b"]}, {("a", "b"): 0}, weights, [1.0])
    together, n = model.sums(texts)
    for i, t in enumerate(texts):
        index, count = langid.features(t)
        assert together[i, 0] == pytest.approx(weights[0, index] @ count, rel=1e-3, abs=1e-2) and count.sum() == 3 * n[i]
        assert model.sums([t])[0][0, 0] == pytest.approx(together[i, 0])


def test_machines_separate():
    rng = np.random.default_rng(2)
    rows, y = [], []
    for i in range(200):
        index = np.unique(rng.integers(0, 50, 8) + 50 * (i % 2)).astype(np.int32)
        rows.append((index, np.full(len(index), len(index) ** -0.5)))
        y.append(1.0 if i % 2 else -1.0)
    w = langid.svm(rows, np.array(y))
    assert all(np.sign(w[i] @ v) == s for (i, v), s in zip(rows, y, strict=True))


# digests


def test_windows_against_brute_force():
    b = np.frombuffer(random.Random(1).randbytes(300), np.uint8) % 17
    got = digest.collisions(b)
    assert got.tolist() == [sum(c * (c - 1) // 2 for c in Counter(b[i : i + digest.WINDOW].tolist()).values()) for i in range(len(b) - digest.WINDOW + 1)]
    texts = ["".join(chr(97 + x) for x in b), "short", "ü" * 40]
    hist = digest.histogram(texts)
    assert hist.sum() == 300 - 31 + 80 - 31 and (hist[np.unique(got)] > 0).all()


def test_features_against_brute_force(monkeypatch):
    text = prose(random.Random(3), "en", 400)
    raw = text.encode()
    rank = digest.ranks(digest.histogram([text]))
    w = digest.WINDOW
    key = [(int(rank[c]), i) if rank[c] >= 0 else (10**9, -1) for i, c in enumerate(digest.collisions(np.frombuffer(raw, np.uint8)))]
    points = Counter(min(key[max(0, s) : s + w])[1] for s in range(1 - w, len(key)))
    want = {i for i, n in points.items() if i >= 0 and n >= digest.POPULAR}
    got = digest.digests([text], rank)[0]
    assert got.features == len(want) and len(got.filters) == -(-len(want) // digest.PER_FILTER)
    monkeypatch.setattr(digest, "_CHUNK", 300)
    assert str(digest.digests(["x" * 50, text, "y"], rank)[1]) == str(got)


def test_likeness():
    rng = random.Random(5)
    a, b = prose(rng, "en", 900), prose(rng, "en", 900)
    rank = digest.ranks(digest.histogram([a, b]))
    da, db, half, none = digest.digests([a, b, a[: len(a) // 2], ""], rank)
    assert digest.likeness(da, da) == 1 and digest.likeness(none, none) == 1 and digest.likeness(da, none) == 0
    assert digest.likeness(da, db) < 0.2 < 0.8 < digest.likeness(da, half) == digest.likeness(half, da)
    long = digest.digests([a * 30, a * 30 + b], rank)
    assert digest.likeness(*long) > 0.9


def test_fingerprints(docs, rows, empty):
    got = digest.fingerprint(docs, rows_a_part=20)
    assert got.columns == [f.split()[0] for f in digest.SCHEMA.split(", ")]
    found = got.collect()
    assert len(found) == len(rows)
    alone = [r for r in found if r["doc_id"] is not None and r["doc_id"] > 0]
    text = {d: t or "" for d, t, _, _ in rows}
    order = sorted(k for k in text if k is not None)
    prints = {r["doc_id"]: r for r in alone}
    for d in order[1:]:
        after = text[order[order.index(d) + 1]] if d != order[-1] else text[None]
        q = len(text[d]) // 4
        want = text[d][: len(text[d]) - q] + after[:q] if q else text[d]
        r = prints[d]
        assert r["n_chars"] == len(text[d]) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    last = next(r for r in found if r["doc_id"] is None)
    q = len(text[None]) // 4
    assert last["edited_sha256"] == hashlib.sha256((text[None][:-q] + text[0][:q]).encode()).hexdigest()
    by_text = defaultdict(set)
    for r in alone:
        by_text[text[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by_text.values()) and prints[240]["near_next"] == 1.0
    assert digest.fingerprint(empty).count() == 0


def plain_likeness(a, b):
    """From the printed digests, bit by bit."""
    import base64

    def read(x):
        n, f = x.split(":")
        raw = np.unpackbits(np.frombuffer(base64.b64decode(f), np.uint8)).reshape(-1, digest.BITS).astype(int)
        return int(n), [set(np.flatnonzero(r).tolist()) for r in raw]

    def one_way(n, fa, fb):
        total = 0.0
        for i, f in enumerate(fa):
            best = 0.0
            for g in fb:
                chance, most = len(f) * len(g) / digest.BITS, min(len(f), len(g))
                best = max(best, min(1.0, max(0.0, (len(f & g) - chance) / max(most - chance, 1e-9))))
            total += best * min(digest.PER_FILTER, n - digest.PER_FILTER * i)
        return total / n

    (na, fa), (nb, fb) = read(a), read(b)
    if not na or not nb:
        return float(na == nb)
    if na == nb:
        return (one_way(na, fa, fb) + one_way(nb, fb, fa)) / 2
    return one_way(na, fa, fb) if na < nb else one_way(nb, fb, fa)


def test_near_columns_against_brute_force(docs):
    some = docs.where("doc_id < 260 OR doc_id IN (270, 271)")
    got = sorted((r for r in digest.fingerprint(some, rows_a_part=50).collect()), key=lambda r: r["doc_id"])
    unique = [r for r in got if r["doc_id"] != 0]
    for r, after in zip(unique, unique[1:], strict=False):
        assert r["near_edited"] == pytest.approx(plain_likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(plain_likeness(r["fingerprint"], after["fingerprint"]))
    assert any(0.05 < r["near_next"] < 0.95 for r in unique) and any(0.3 < r["near_edited"] < 1 for r in unique)


def test_many_rows_without_ids_have_digests(spark):
    rng = random.Random(2)
    texts = [prose(rng, "en", 30) for _ in range(300)]
    rows = [(i, texts[i]) for i in range(100)] + [(None, t) for t in texts[100:]] + [(7, texts[7])] * 4 + [(None, "")] * 5
    alike = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for very many rows of the table").alias("text"))
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(alike).withColumn("alike", F.lit("x")).withColumn("h", F.lit(1))
    got = digest.fingerprint(df, rows_a_part=60).collect()
    again = Counter(r["edited_sha256"] for r in digest.fingerprint(df, rows_a_part=10**6).collect())
    assert len(got) == 3309 and Counter(r["edited_sha256"] for r in got) == again
    own = [r for r in got if r["n_chars"] == 40]
    assert len(own) == 3000 and sum(r["near_next"] == 1.0 for r in own) >= 2999


# near duplicates


def brute_classes(rows):
    sets = {}
    for d, t, _, _ in rows:
        w = (t or "").split()
        n = min(5, len(w))
        sets[d] = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()
    text = {d: t for d, t, _, _ in rows}
    ids = [d for d in text if d is not None]
    above = {d: d for d in ids}

    def top(d):
        while above[d] != d:
            d = above[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if text[a] is None or text[b] is None:
                continue
            both = sum((sets[a] & sets[b]).values())
            if text[a] == text[b] or (both and both / sum((sets[a] | sets[b]).values()) >= 0.8):
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {d: top(d) for d in ids}


def near_corpus():
    """Copies, near copies of several bases at every distance, texts that share a passage."""
    rng = random.Random(11)
    rows = corpus(60)
    shared = prose(rng, "en", 60)
    for g in range(4):
        base = prose(rng, "en", 150 + 40 * g)
        for i in range(40):
            rows.append((1000 + 100 * g + i, edited(rng, base, i // 3), "en", "a"))
    rows += [(2000 + i, shared + " " + prose(rng, "en", 40), "en", "a") for i in range(40)]
    return rows


def test_near_duplicates(spark, docs, empty):
    rows = near_corpus()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("class_id", F.lit(1)).withColumn("band", F.lit(2))
    got = {(r["doc_id"], r["class_id"]) for r in neardup.classes(df).collect()}
    want = brute_classes(rows)
    assert {(d, c) for d, c in got if d is not None} == set(want.items())
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == Counter(set(want.values()))
    assert neardup.classes(empty).count() == 0 and neardup.deduplicate(empty).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    rng = random.Random(12)
    base, near, other, third = prose(rng, "en", 200), prose(rng, "de", 200), prose(rng, "fr", 200), prose(rng, "es", 200)
    rows = [(None, base, "en", "a"), (None, base, "en", "a"), (7, base, "en", "a"), (None, edited(rng, base, 2), "en", "a")]  # one class
    rows += [(1, near, "de", "a"), (1, other, "fr", "a"), (2, edited(rng, other, 2), "fr", "a"), (1, None, None, "a")]  # a shared id
    rows += [(None, third, "es", "a"), (None, third, "es", "a"), (None, None, "en", "a"), (None, None, "en", "b"), (2, near, "de", "a")]
    kept = neardup.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(7, base), (1, near), (1, other), (1, None), (None, third), (None, None), (None, None)]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)
    found = sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    alone = next(c for d, c in found if c is not None and c < 0)  # a class without any id
    ids = [(None, 7)] * 3 + [(7, 7), (1, 1), (1, 1), (2, 1), (1, 1), (2, 1)] + [(None, alone)] * 2 + [(None, None)] * 2
    assert found == sorted(ids, key=str)


def test_many_rows_without_ids(spark):
    text = prose(random.Random(3), "en", 80)
    alike = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.lit(1).alias("g0"), F.lit(2).alias("T1"))
    got = neardup.classes(alike).groupBy("doc_id", "class_id").count().collect()
    assert len(got) == 1 and got[0]["class_id"] < 0 and got[0]["count"] == 50_000
    kept = neardup.deduplicate(alike.unionByName(alike.limit(1).withColumn("doc_id", F.lit(9).cast("long"))))
    assert kept.columns == alike.columns and [tuple(r) for r in kept.collect()] == [(9, text, 1, 2)]


@pytest.mark.parametrize("turns", [0, 2])
def test_tiles_and_turns_agree_with_brute_force(spark, monkeypatch, turns):
    monkeypatch.setattr(neardup, "_TILE", 7)
    monkeypatch.setattr(neardup, "TURNS", turns)
    rows = near_corpus()
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {d: c for d, c in got.items() if d is not None} == brute_classes(rows)


def test_only_contested_sketches_are_read_again(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TURNS", 0)
    read, real = [], neardup._tiled
    monkeypatch.setattr(neardup, "_tiled", lambda left, sketches, docs: (read.append((left.select("id").distinct().count(), sketches.count())), real(left, sketches, docs))[1])
    rows = near_corpus()
    assert neardup.classes(spark.createDataFrame(rows, SCHEMA)).count() == len(rows)
    assert len(read) == 1 and 0 < read[0][0] == read[0][1] < len(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    off = []
    for _ in range(40):
        h, w = rng.integers(0, 2**63, 120).astype(np.uint64), rng.random(120) * 4
        v = w * rng.choice([1, 0.5, 1.3], 120)
        a, b = neardup.signatures([(h, w), (h, v)])
        off.append((a == b).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(off)) < 0.015 and np.std(off) < 0.05
    h = rng.integers(0, 2**63, 3).astype(np.uint64)
    whole = neardup.signatures([(h, np.array([2, 1, 3])), (h, np.array([2.0, 1.0, 3.0]))])
    assert (whole[0] == whole[1]).all() and (neardup.signatures([(h[:0], np.zeros(0, int))]) == neardup._EMPTY).all()


def test_hashes_of_long_texts(monkeypatch):
    rng = random.Random(4)
    text = prose(rng, "fr", 500) + " " + "z" * 900 + "\n" + prose(rng, "es", 300)
    want = [s[0].tolist() for s in shingles.multisets([text, "", "a b", text])]
    monkeypatch.setattr(shingles, "_CHUNK", 700)
    got = [s[0].tolist() for s in shingles.multisets([text, "", "a b", text])]
    # The word longer than a chunk is hashed another way, but always the same way.
    assert got[0] == got[3] and got[1:3] == want[1:3] and len(set(got[0]) ^ set(want[0])) == 10


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    above = {x: x for e in edges for x in e}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        above[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(root == top(n) for n, root in got.items()) and {n for n in above if top(n) != n} <= set(got)


def test_few_links_are_joined_in_one_task(spark, monkeypatch):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i + 1, i) for i in range(1000, 1040)] + [(5, 5)] * 2
    df = spark.createDataFrame(edges, "a long, b long")
    want = dict(map(tuple, components.components(df).collect()))
    cuts, cut = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda d, name: cuts.append(name) or cut(d, name))
    got = components.components(df, few=1000).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want and cuts == ["links"]
    assert components.components(df.limit(0), few=1000).collect() == []
    assert dict(map(tuple, components.components(df, few=3).collect())) == want and len(cuts) > 3
    cuts.clear()
    # Near duplicates join few links so, at each turn.
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + f" end{i}") for i in range(6)] + [(9, "other words than these are here")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.classes(docs).collect())) == [(i, 0) for i in range(6)] + [(9, 9)]
    assert cuts and set(cuts) == {"links"}


def test_unsettled_components_are_no_result(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="settle"):
        components.components(edges, most_turns=1)


# nearest neighbours


def brute_neighbors(vectors, queries_, k):
    """queries_: row numbers."""
    x = np.array([v for _, v in vectors])
    ids = np.array([i for i, _ in vectors])
    out = {}
    for n in queries_:
        s = (x * x[n]).sum(axis=1)
        out[n] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s)) if j != n][:k]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbors(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2600, 24)) * rng.random((2600, 1))
    x[100:900] = x[100]
    x[1000:1040] = x[1000] + rng.standard_normal((40, 24)) * 1e-3
    x = x.astype(np.float32).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(3000, None), (3020, [0.0] * 24), (3040, [float("nan")] + [1.0] * 23), (3060, [None] + [1.0] * 23), (3080, [1.0] * 5), (None, [1.0] * 24), (3100, [float("inf")] + [1.0] * 23), (3120, [])]
    df = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>").withColumn("rank", F.lit(1)).withColumn("v", F.lit(2)).withColumn("list", F.lit(3))
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    want = brute_neighbors(rows, range(0, 2600, 20), 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [f[2] for f in found] == list(range(1, 21)) and q not in [f[0] for f in found]
        assert [f[:2] for f in found] == sorted((f[:2] for f in found), key=lambda f: (-f[1], f[0]))
        for i, s, _ in found:
            assert s == pytest.approx(float((x[i] * x[q]).sum()), abs=1e-9)
        hits += len({f[0] for f in found} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9


def test_few_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 2.0]), (5, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    # Each row numbered 20 is the other's candidate.
    assert got == {(0, 1, 5, 1.0), (0, 2, 20, 0.0), (0, 3, 20, 0.0), (20, 1, 5, 2.0), (20, 1, 20, 2.0), (20, 2, 5, 1.0), (20, 2, 20, 2.0), (20, 3, 0, 0.0)}
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0 and ann.search(df, F.lit(False)).count() == 0


@pytest.mark.parametrize("n", [300, 2500])
def test_repeated_ids_are_candidates(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 16)).round(2)
    ids = np.arange(n)
    ids[30:32], ids[50:80] = 20, 40  # 20 and 40 occur 3 and 31 times, with vectors of their own
    x[60:70] = x[40]  # ... but for some of the latter
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    asked = [j for j in range(n) if ids[j] % 20 == 0]
    want = brute_neighbors(rows, asked, 20)
    hits = 0
    for i in {int(ids[j]) for j in asked}:
        alike = [j for j in asked if ids[j] == i]
        assert Counter(r for r, _, _ in got[i]) == Counter(dict.fromkeys(range(1, 21), len(alike)))
        found, true = Counter((v, s) for _, v, s in got[i]), Counter((v, round(s, 9)) for j in alike for v, s in want[j])
        hits += sum((found & true).values())
    assert hits >= 0.9 * 20 * len(asked)


def test_scan_finds_what_is_near():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((500, 40)).astype(np.float32), rng.standard_normal((30, 40)).astype(np.float32)
    d = ((y[:, None] - x) ** 2).sum(axis=2)
    bound = np.sort(d, axis=1)[:, 10] * 1.0001
    q, c = ann.scan(x, y, bound)
    near = set(zip(*np.nonzero(d <= np.sort(d, axis=1)[:, 10:11]), strict=True))
    assert len(near & set(zip(q, c, strict=True))) >= 0.99 * len(near) and (d[q, c] <= bound[q] * 1.001).all()


# LM scoring


def test_scores(docs, rows, empty):
    got = lm.score(docs, frequent=50).collect()
    assert len(got) == len(rows)
    learned = [t for d, t, _, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 10]
    words = [lm.words_of(t) for t in learned]
    c = Counter(w for t in words for w in t)
    c["end"] += len(words)
    n, v = sum(c.values()), len(c)
    text = defaultdict(set)
    for d, t, _, _ in rows:
        text[d].add(t)
    for r in got:
        t = lm.words_of(next(iter(text[r["doc_id"]])))
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*t, "end"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t) + 1, sum(c[w] > 0 for w in t) + 1, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    by_text = defaultdict(set)
    for r in got:
        by_text[next(iter(text[r["doc_id"]])), r["held_out"]].add(round(r["score"], 6))
    assert all(len(s) == 1 for s in by_text.values())
    assert lm.score(empty).count() == 0


def small_model():
    rng = random.Random(2)
    texts = [prose(rng, "en", 150) for _ in range(40)]
    c = Counter(w for t in texts for w in lm.words_of(t))
    words, n = list(c), np.array(list(c.values()))
    ids, size = lm.by_word(words)
    counts = np.bincount(ids, weights=np.repeat(n, size), minlength=lm.VOCAB).astype(np.int64)
    counts[lm.END] += len(texts)
    paired = np.flatnonzero(counts[: lm.END])[:60]
    number = np.full(lm.VOCAB, len(paired))
    number[paired] = np.arange(len(paired))
    inner = np.ones(len(ids), bool)
    inner[np.cumsum(size) - size] = False
    pairs = np.zeros((len(paired) + 1, len(paired) + 1), np.float32)
    np.add.at(pairs, (number[ids[:-1]][inner[1:]], number[ids[1:]][inner[1:]]), np.repeat(n, size)[1:][inner[1:]])
    windows = []
    for t in texts:
        flat = np.concatenate((np.full(lm.STRIDE + 1, lm.PAD), lm.ids_of(lm.words_of(t)), np.full(lm.STRIDE, lm.END)))
        windows += [flat[s : s + lm.SPAN + 1] for s in range(0, len(flat) - lm.SPAN - 1, lm.STRIDE)]
    return lm.fit(np.array(windows), counts, pairs[:-1, :-1], paired, epochs=2, least_steps=10), texts


def test_the_model_is_a_distribution():
    model, texts = small_model()
    ids = lm.ids_of(lm.words_of(texts[0]))[:15]
    line = np.concatenate((np.full(lm.STRIDE, lm.PAD), ids, [lm.PAD]))
    prev = np.concatenate(([lm.PAD], line[:-1]))
    every = np.arange(lm.VOCAB - 1)
    # One id of each class with all the class's mass shows the classes' own distribution.
    some = [int(np.flatnonzero(model.cls[every] == k)[0]) for k in np.unique(model.cls[every])]
    for at in (0, 6, 15):
        p = 0.0
        for x in some:
            line[lm.STRIDE + at] = x
            p += 10 ** (model._windows(line, prev)[at] - model.within.log10(prev[lm.STRIDE + at][None], np.array([x]))[0])
        assert p == pytest.approx(1.0, abs=1e-3)
    for before in [lm.PAD, *ids.tolist()]:
        sums = np.bincount(model.cls[every], weights=10.0 ** model.within.log10(np.full(len(every), before), every))
        assert sums[np.unique(model.cls[every])] == pytest.approx(1.0, abs=2e-3)


def test_each_id_is_scored_once_whatever_the_batch():
    model, texts = small_model()
    ids = [lm.ids_of(lm.words_of(t)) for t in texts[:6]] + [np.zeros(0, np.int64)]
    together = model.each(ids)
    alone = [model.score(i) for i in ids]
    sums = np.add.reduceat(together, np.cumsum([0, *(len(i) + 1 for i in ids[:-1])]))
    assert sums == pytest.approx(alone, rel=1e-6) and np.concatenate(model._long(ids[0])).sum() == pytest.approx(alone[0], rel=1e-6)
    long = np.concatenate([ids[0]] * 60)
    assert len(long) > 4 * lm._AT_ONCE and model.each([ids[1], long])[len(ids[1]) + 1 :].sum() == pytest.approx(model._some([long]).sum(), rel=1e-6)
    # causal: what follows doesn't change what was predicted
    a, b = np.concatenate((np.full(16, lm.PAD), ids[0][:32])), np.concatenate((np.full(16, lm.PAD), ids[0][:20], ids[1][:12]))
    prev = lambda x: np.concatenate(([lm.PAD], x[:-1]))
    assert model._windows(a, prev(a))[:20] == pytest.approx(model._windows(b, prev(b))[:20], abs=1e-5)


def plain_logp(model, ids):
    """Of each id and the end: one position at a time, with plain sums."""
    w, out = model.weights, []
    line = [lm.PAD] * (lm.STRIDE + 1) + [int(i) for i in ids] + [lm.END]
    d, v = w["Q"].shape[1], w["V"].shape[1]
    wq, wk, wv = (w["QKV"][:, a:b].astype(float) for a, b in ((0, d), (d, 2 * d), (2 * d, 2 * d + v)))
    for t in range(lm.STRIDE + 1, len(line)):
        nth = (t - lm.STRIDE - 1) % lm.STRIDE  # within the last half of its window
        first = t - 1 - nth - lm.STRIDE  # the window's first input
        x = w["E"][model.row[line[t - 1]]].astype(float)
        q, top, total = x @ wq, np.zeros(v), 0.0
        for k in range(first, t):
            y = w["E"][model.row[line[k] if k >= 0 else lm.PAD]].astype(float)
            a = math.exp(min(30.0, max(-30.0, float(q @ (y @ wk)))) + float(w["bias"][nth, k - first]))
            top, total = top + a * (y @ wv), total + a
        z = np.clip((x + top / total @ w["O"]) @ w["U"] + w["c"], -30, 30)
        own = math.log10(math.exp(z[model.cls[line[t]]]) / sum(math.exp(c) for c in z))
        out.append(own + float(model.within.log10(np.array([line[t - 1]]), np.array([line[t]]))[0]))
    return out


def test_the_model_against_a_plain_loop():
    model, texts = small_model()
    ids = lm.ids_of(lm.words_of(texts[3]))[:70]
    assert model.each([ids]) == pytest.approx(plain_logp(model, ids), abs=2e-4)


def test_blocks_and_what_is_remembered(spark):
    rng = random.Random(4)
    a, b, c = prose(rng, "en", 100), prose(rng, "en", 100), prose(rng, "de", 40)
    words = [lm.words_of(t) for t in (a, "", c)]
    length, base = np.ones(140, np.int64), np.where(np.arange(140) % 3 == 0, -np.inf, -2.0)
    lm_each = np.linspace(-5, -1, 143)
    got, many = lm.mixed(words, length, base, lm_each, -1.0, 0.3)
    each, known = iter(lm_each), iter(base)
    want = []
    for t in words:
        of = [math.log10(0.3 * 10 ** next(known) + 0.7 * 10 ** next(each)) for _ in t] + [math.log10(0.3 * 0.1 + 0.7 * 10 ** next(each))]
        want += [sum(of[i : i + 32] if i + 32 < len(t) else of[i:]) for i in range(0, max(1, len(t)), 32)]
    assert many.tolist() == [4, 1, 2] and got == pytest.approx(want)
    # Counts with a document's own occurrence left out.
    training = [a, a, b, c, c, c, c + " more", " ".join([c] * 4)]
    scored = [(i, False, t) for i, t in enumerate(training)] + [(100, True, b), (101, True, "x y z"), (102, True, c + " less")]
    pairs, after = Counter(), Counter()

    def steps(t):
        h = lm.blocks_of(lm.words_of(t))
        return list(zip([0, *h[:-1]], h, strict=True))

    for t in training:
        pairs.update(steps(t))
        after.update(x for x, _ in steps(t))
    kinds = Counter(x for x, _ in pairs)
    rows, want = [], {}
    for row, held, t in scored:
        own, first, gain = Counter(steps(t)), Counter(x for x, _ in steps(t)), 0.0
        rows.append((row, held, [(x, y, -3.0, own[x, y], first[x]) for x, y in steps(t)]))
        for x, y in steps(t):
            n, m = after[x] - (0 if held else first[x]), pairs[x, y] - (0 if held else own[x, y])
            if n > 0:
                k = max(1, kinds[x] - (m == 0 and pairs[x, y] > 0))
                gain += math.log10(m / (n + k) + k / (n + k) * 10**-3.0) + 3.0
        want[row] = gain
    df = spark.createDataFrame(rows, "row long, held_out boolean, seen array<struct<ctx:long,block:long,lm:double,c:long,n:long>>")
    got = {r["row"]: r["gain"] for r in lm.remembered(df, lm.count_blocks(spark.createDataFrame([(t,) for t in training], "text string"))).collect()}
    assert got == pytest.approx({k: v for k, v in want.items()}) and got[0] > 8 > 0 > got[2] and got[100] > 8


def test_documents_that_occur_twice_stand_out(spark):
    rng = random.Random(6)
    texts = [prose(rng, "en", rng.randint(60, 200)) for _ in range(260)]
    rows = list(enumerate(texts + texts[:20]))
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    learned = lambda d: zlib.crc32(str(d).encode()) % 10 != 0
    mean = {r["doc_id"]: r["score"] / r["n_tokens"] for r in got}
    twice = [d for d in range(20) if learned(d + 260)]
    alone = [mean[d] for d in range(20, 260)]
    assert min(mean[d] for d in twice) > max(alone)
    out = [r for r in got if 20 <= r["doc_id"] < 260 and not learned(r["doc_id"])]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lexicon():
    words = lm.words_of("The cat\tsat ON the\x0bmat\x1cx   end ÄÖ")
    assert words[:5] == [b"the", b"cat", b"sat", b"on", b"the"] and "Ä".encode() in words[-1]
    lexicon = lm.Lexicon([b"the", b"cat"], np.array([-1.0, -2.0]))
    ids, length, logp, others = lexicon.read([words, [], [b"cat"]])
    assert [i.tolist() for i in ids] == [lm.ids_of(w).tolist() for w in (words, [], [b"cat"])]
    assert np.flatnonzero(np.isfinite(logp)).tolist() == [0, 1, 4, len(words)] and logp[[0, 1, 4, -1]] == pytest.approx([-1, -2, -1, -2])
    assert length.sum() == sum(map(len, ids)) and others[1:] == [[], []]


def test_fitted_windows_grow_with_the_corpus(spark, monkeypatch):
    rng = random.Random(9)
    texts = [(i, prose(rng, "en", 60)) for i in range(400)] + [(400, prose(rng, "de", 3000))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    windows = lambda t: -(-(len(lm.ids_of(lm.words_of(t))) + 1) // lm.STRIDE)
    # A long text has all its windows, far more than lm.WINDOWS of them.
    assert lm.sample_windows(df.where("doc_id = 400"), 1).count() == windows(texts[400][1]) > 2 * lm.WINDOWS
    few = [lm.sample_windows(df.where(F.col("doc_id") < n), n, most=5, share=4).count() for n in (100, 400)]
    assert few[1] > 2.5 * few[0] > 0
    every = df.where("doc_id < 400")
    seen, keys, n = lm.window_stats(lm.sample_windows(every, 400, most=400))
    ids = np.concatenate([[*lm.ids_of(lm.words_of(t)), lm.END] for _, t in texts[:400]])
    assert (seen[: lm.END] == np.bincount(ids, minlength=lm.VOCAB)[: lm.END]).all() and n.sum() >= 2 * len(ids)
    # What the driver doesn't start on is trained on by the tasks.
    monkeypatch.setattr(lm, "WINDOWS", 4)
    monkeypatch.setattr(lm, "_TASK", 50)
    done, real = [], lm.train_on
    monkeypatch.setattr(lm, "train_on", lambda w, total, p, *model: (done.append((total, p["U"].copy())), real(w, total, p, *model), done.append(p["U"])))
    model = lm.learn(every, 400, np.bincount(ids, minlength=lm.VOCAB), np.zeros((0, 0)), np.zeros(0, np.int64), most=20, share=1)
    assert done[0][0] == sum(windows(t) for _, t in texts[:400]) and np.abs(done[0][1] - done[1]).max() > 1e-4
    assert np.isfinite(model.each([ids[:50]])).all()


def test_all_training_documents_are_learned_from(spark, monkeypatch):
    rng = random.Random(10)
    texts = [(i, prose(rng, "en", 60)) for i in range(300)] + [(300, prose(rng, "de", 9000))]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    own = [[*lm.ids_of(lm.words_of(t)), lm.END] for _, t in texts]
    counts = np.bincount(np.concatenate(own), minlength=lm.VOCAB)
    monkeypatch.setattr(lm, "WINDOWS", 4)
    seen, fit, train_on = [], lm.fit, lm.train_on
    monkeypatch.setattr(lm, "fit", lambda *a, **b: (seen.append(b["stats"][0]), fit(*a, **b))[1])
    monkeypatch.setattr(lm, "train_on", lambda rows, *a: (seen.append([np.frombuffer(r["w"], np.uint16) for r in rows.collect()]), train_on(rows, *a)))
    lm.learn(df, len(texts), counts, np.zeros((0, 0)), np.zeros(0, np.int64), most=20)
    # The classes' counts and the rounds' rows have each id of each text as a target once.
    assert (seen[0] == counts).all()
    assert (np.bincount(np.concatenate([w[lm.LEAD :] for w in seen[1]]), minlength=lm.VOCAB) == counts).all() and len(seen[1]) > len(texts)


def test_steps_are_the_gradients():
    rng = np.random.default_rng(5)
    f32 = lambda *s: rng.standard_normal(s).astype(np.float32) * np.float32(0.4)
    p = {"E": f32(9, 6), "Q": f32(6, 6), "K": f32(6, 6), "V": f32(6, 6), "O": f32(6, 6), "U": f32(6, 5), "c": f32(5), "rel": f32(lm.SPAN)}
    row, cls = np.arange(lm.VOCAB) % 9, np.arange(lm.VOCAB) % 5
    texts = [np.concatenate((np.full(lm.LEAD, lm.PAD), rng.integers(0, 900, m))) for m in (40, 3)] + [rng.integers(0, 900, lm.LEAD + 20)]

    def loss(q):
        total, n = 0.0, 0
        for t in texts:
            for i in range(lm.LEAD, len(t)):
                nth = (i - lm.LEAD) % lm.STRIDE
                x = q["E"][row[t[i - 1 - nth - lm.STRIDE : i]]].astype(float)
                a = (x[-1] @ q["Q"]) @ (x @ q["K"]).T * 6**-0.5 + q["rel"][np.arange(len(x))[::-1]]
                a = np.exp(a) / np.exp(a).sum()
                z = (x[-1] + (a @ (x @ q["V"])) @ q["O"]) @ q["U"] + q["c"]
                total, n = total + np.log(np.exp(z).sum()) - z[cls[t[i]]], n + 1
        return total / n, n

    q = {k: v.copy() for k, v in p.items()}
    assert lm._train(q, row, cls, iter([texts]), lambda step: 1e-3) == loss(p)[1]
    for name, v in p.items():  # a first step of Adam goes against the sign of each gradient
        for _ in range(6):
            at = tuple(rng.integers(0, m) for m in v.shape)
            up, down = ({k: x.astype(float) for k, x in p.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            slope = (loss(up)[0] - loss(down)[0]) / 2e-4
            if abs(slope) > 1e-5:
                assert q[name][at] - v[at] == pytest.approx(-1e-3 * np.sign(slope), rel=0.05), name


# the pipeline and the registry


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixture", "sequences"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = Counter(r["doc_id"] for r in at.collect())
    assert Counter(r["doc_id"] for r in got if r["start"] == 0) == want


def test_registry():
    assert [n.split("_")[0] for n in queries.queries()] == [*(f"op{i}" for i in range(1, 11)), "packing"]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_pieces_by_the_lexicon_are_those_of_the_tokenizer(spark, monkeypatch):
    texts = ["Some words, some WORDS and others", "", None, "odd\u00a0white \u2003 space <|endoftext|> here", "naïve 漢字 words " * 3000, "rare unseen"]
    df = spark.createDataFrame(list(enumerate(texts)), "h long, text string")
    known = [w for w, _ in Counter(w for t in texts[:-1] for w in lm.words_of(t)).most_common(9)]
    sent = spark.sparkContext.broadcast(lm.Lexicon(known, np.zeros(len(known))))
    plain, fast = (sorted((r["draw"], bytes(r["w"])) for r in lm.pieces(df, 4096, x).collect()) for x in (None, sent))
    assert plain == fast and len(plain) > len(texts)
    given, learn = [], lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a, lexicon=None, **k: given.append(lexicon) or learn(*a, lexicon=lexicon, **k))
    assert lm.score(df.withColumnRenamed("h", "doc_id")).count() == len(texts)
    assert "words" in [w.decode() for w in given[0].value.number]


def test_columns_are_read_as_texts_are(spark):
    texts = ["  a\x0bbb \t c\x1cd\x85e  f\n", "", " ", None, "a\x0cb\rc", "ÄÖ É漢字 odd white", "x " * 100, "x " * 32, ("y " * 64).strip(), "A-Z Zz", "z" * 70_000]
    words = [lm.words_of(t) for t in texts]
    lexicon = lm.Lexicon([b"x", b"a", b"zz"], np.array([-1.0, -2.0, -3.0]))
    for column, want in ((pa.array(texts), words), (pa.array(texts)[3:6], words[3:6]), (pa.array([], pa.string()), [])):
        flat, ends = lm.split(column)
        assert [flat[a:b].to_pylist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want
        assert [h.tolist() for h in lm.blocks_of_all(flat, ends)] == [lm.blocks_of(w) for w in want]
        for i, (some, at, ids, *more) in enumerate(lexicon.read_column(column, 2)):
            part = want[2 * i : 2 * i + 2]
            plain = lexicon.read(part)
            assert [x.tolist() for x in ids] == [x.tolist() for x in plain[0]] == [lm.ids_of(w).tolist() for w in part]
            assert [x.tolist() for x in more[:2]] == [x.tolist() for x in plain[1:3]] and more[2] == plain[3]
            assert [h.tolist() for h in lm.blocks_of_all(some, at)] == [lm.blocks_of(w) for w in part]
    # Counts of words, of their ids, and of ids after each other.
    counts = lm.with_ids(lm.count_words(spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(3)))
    c = Counter(w for t in words * 3 for w in t)
    assert {bytes(r["word"]): r["c"] for r in counts.collect()} == c
    ids = {w: lm.ids_of([w]) for w in c}
    assert {bytes(r["word"]): np.frombuffer(r["ids"], np.uint16).tolist() for r in counts.collect()} == {w: x.tolist() for w, x in ids.items()}
    want, after = np.zeros(lm.VOCAB), Counter()
    for w, x in ids.items():
        np.add.at(want, x, c[w])
        for a, b in zip(x[:-1].tolist(), x[1:].tolist(), strict=True):
            after[a, b] += c[w]
    paired = np.flatnonzero(want)[1:]
    assert (lm.count_ids(counts) == want).all() and len(after) > 5
    assert lm.count_pairs(counts, paired).tolist() == [[after[a, b] for b in paired.tolist()] for a in paired.tolist()]


def test_a_step_in_parts_is_the_same_step(monkeypatch):
    rng = np.random.default_rng(8)
    f32 = lambda *s: rng.standard_normal(s).astype(np.float32) * np.float32(0.4)
    p = {"E": f32(9, 6), "Q": f32(6, 6), "K": f32(6, 6), "V": f32(6, 6), "O": f32(6, 6), "U": f32(6, 5), "c": f32(5), "rel": f32(lm.SPAN)}
    row, cls = np.arange(lm.VOCAB) % 9, np.arange(lm.VOCAB) % 5
    texts = [np.concatenate((np.full(lm.LEAD, lm.PAD), rng.integers(0, 900, m))) for m in (300, 1, 16)] + [rng.integers(0, 900, lm.LEAD + 95)]
    got = []
    for most in (1 << 13, 64, lm.STRIDE):
        monkeypatch.setattr(lm, "_CACHED", most)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        done = [lm._add_gradients(g, p, row, cls, some, 412) for some in lm._batches(lm._cut(texts, most), most)]
        q = {k: v.copy() for k, v in p.items()}
        assert sum(done) == lm._train(q, row, cls, iter([texts, texts]), lambda step: 1e-3) / 2 == 412 and (len(done) > 5) == (most < 100)
        got.append(g)
    for g in got[1:]:
        for name, v in got[0].items():
            assert g[name] == pytest.approx(v, rel=1e-3, abs=1e-6), name
    # Scores and logits out of bounds are kept within them.
    wide = {k: v * np.float32(200 if k in "QU" else 1) for k, v in p.items()}
    g = {k: np.zeros_like(v) for k, v in wide.items()}
    lm._add_gradients(g, wide, row, cls, texts, 412)
    assert all(np.isfinite(v).all() for v in g.values())
