"""Improbable-feature digests: rare byte windows in chained Bloom filters, compared by bit overlap.

Every window of WINDOW bytes of the UTF-8 text has a collision entropy, from the number of equal
pairs of bytes in it. How often each entropy occurs over the windows of all documents ranks
them: the rarer, the more telling. Windows of under LEAST_BITS bits are never features. In
each run of WINDOW neighbouring windows the rarest (the leftmost, if tied) scores a point, and
a window with POPULAR points is a feature. Features fill Bloom filters of 2048 bits in text
order, 5 bits each, PER_FILTER features a filter; then the next filter begins. Likeness is the
mean over the smaller digest's filters, weighed by features, of the best overlap with a
filter of the other, normalised: 0 is what chance gives, 1 is all bits of the emptier one.

A text without features (shorter than a window, or monotonous) has its hash as its only one.
An empty or null text has none; two such are alike (1), such and another are not (0). Very
long texts are cut into overlapping segments, which changes nothing in the result. Equal
texts have equal digests. Rows with equal doc_id follow one another in the order of a hash of their
text, and null doc_ids come last; so rows alike in both follow one another, and each but the last has
its own text as the next. Where these are many, one stands for all. Empty tables give empty results.
Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, slices, small

WINDOW, POPULAR = 32, 8
LEAST_BITS = 2.0
BITS, HASHES, PER_FILTER = 2048, 5, 160
CLASSES = WINDOW * (WINDOW - 1) // 2 + 1
_CHUNK, _HALO = 1 << 18, 2 * WINDOW
_SPAN = _CHUNK + 4 * WINDOW + 2 * _HALO
_NONE = np.int32((1 << 31) - 1)
_MULT = 0x9E3779B97F4A7C15 | 1


def _powers(x: int, n: int) -> np.ndarray:
    a = np.full(n, x, dtype=np.uint64)
    a[0] = 1
    return np.cumprod(a, dtype=np.uint64)


_UP = _powers(_MULT, _SPAN + 1)
_DOWN = _powers(pow(_MULT, -1, 1 << 64), _SPAN + 1)


def collisions(b: np.ndarray) -> np.ndarray:
    """For each window of b, its number of equal pairs of bytes: 0 to CLASSES - 1."""
    ahead, behind = np.zeros(len(b), np.uint8), np.zeros(len(b), np.uint8)
    for j in range(1, min(WINDOW, len(b))):
        same = (b[:-j] == b[j:]).view(np.uint8)
        ahead[:-j] += same
        behind[j:] += same
    # Pairs that end before the window's end, less those that start before its start.
    ends, starts = np.cumsum(behind, dtype=np.int32), np.cumsum(ahead, dtype=np.int32)
    out = ends[WINDOW - 1 :].copy()
    out[1:] -= starts[: len(out) - 1]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _chunks(raw: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]]:
    """(bytes, which positions start a window, [(text, first window, end, position of its first byte)]).

    Short texts share a chunk; a long one is cut into segments with a halo on both sides.
    """
    held: list[int] = []
    size = 0

    def shared() -> tuple:
        b = np.frombuffer(b"".join(raw[i] for i in held) + bytes(WINDOW), np.uint8)
        starts = np.ones(len(b), bool)
        at, where = 0, []
        for i in held:
            n = len(raw[i])
            starts[at + max(0, n - WINDOW + 1) : at + n] = False
            where.append((i, at, at + n, at))
            at += n
        starts[at:] = False
        return b, starts, where

    for i, text in enumerate(raw):
        if len(text) > _CHUNK:
            for a in range(0, len(text) - WINDOW + 1, _CHUNK):
                lo, hi = max(0, a - _HALO), min(len(text), a + _CHUNK + _HALO + WINDOW)
                b = np.frombuffer(text[lo:hi] + bytes(WINDOW), np.uint8)
                starts = np.arange(len(b)) <= hi - lo - WINDOW
                yield b, starts, [(i, a - lo, min(a + _CHUNK, len(text)) - lo, -lo)]
            continue
        if size + len(text) > _CHUNK:
            yield shared()
            held, size = [], 0
        held.append(i)
        size += len(text)
    if held:
        yield shared()


def histogram(texts: list[str | None]) -> np.ndarray:
    """How many windows of the texts have each number of collisions."""
    out = np.zeros(CLASSES, np.int64)
    for b, starts, where in _chunks([(t or "").encode("utf-8", "replace") for t in texts]):
        found = collisions(b)
        for _, a, e, _ in where if len(where) == 1 else [(0, 0, len(found), 0)]:
            out += np.bincount(found[a:e][starts[: len(found)][a:e]], minlength=CLASSES)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """For each number of collisions its rank, the rarest first; -1: too even to tell anything."""
    bits = -np.log2((WINDOW + 2 * np.arange(CLASSES)) / WINDOW**2)
    rank = np.empty(CLASSES, np.int32)
    rank[np.lexsort((np.arange(CLASSES), counts))] = np.arange(CLASSES)
    return np.where(bits >= LEAST_BITS, rank, -1).astype(np.int32)


def _features(b: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the features of a chunk."""
    r = rank[collisions(b)]
    n = len(r)
    pos = np.arange(n, dtype=np.int32)
    key = np.where(starts[:n] & (r >= 0), (r << np.int32(20)) | pos, _NONE)
    least = np.concatenate((np.full(WINDOW - 1, _NONE), key, np.full(WINDOW - 1, _NONE)))
    step = 1
    while step < WINDOW:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    edge = np.flatnonzero(np.diff(least, prepend=-1))
    points = np.diff(edge, append=len(least))
    best = least[edge][points >= POPULAR]
    at = (best[best != _NONE] & np.int32((1 << 20) - 1)).astype(np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(b * _UP[: len(b)], dtype=np.uint64)))
    return at, _mix((total[at + WINDOW] - total[at]) * _DOWN[at])


class Digest:
    """A chain of Bloom filters."""

    __slots__ = ("features", "filters")

    def __init__(self, features: int, filters: np.ndarray):
        self.features, self.filters = features, filters

    def __str__(self) -> str:
        return f"{self.features}:{base64.b64encode(self.filters.tobytes()).decode()}"

    def sizes(self) -> np.ndarray:
        return np.minimum(PER_FILTER, self.features - PER_FILTER * np.arange(len(self.filters)))


def digests(texts: list[str | None], rank: np.ndarray) -> list[Digest]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in raw]
    for b, starts, where in _chunks(raw):
        at, h = _features(b, starts, rank)
        for i, a, e, _ in where:
            lo, hi = np.searchsorted(at, (a, e))
            found[i].append(h[lo:hi])
    hashes = [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]
    for i, h in enumerate(hashes):
        if not len(h) and raw[i]:
            hashes[i] = np.frombuffer(hashlib.blake2b(raw[i], digest_size=8).digest(), np.uint64)
    n = np.array([len(h) for h in hashes], np.int64)
    chains = -(-n // PER_FILTER)
    first = np.concatenate(([0], np.cumsum(chains))).astype(np.int64)
    out = []
    # Some texts at a time: the bits of a filter take 2 KB before they are packed.
    i = 0
    while i < len(raw):
        j = i + 1
        while j < len(raw) and first[j + 1] - first[i] <= 4096:
            j += 1
        bits = np.zeros((first[j] - first[i], BITS), bool)
        h = np.concatenate(hashes[i:j])
        row = np.concatenate([first[k] - first[i] + np.arange(n[k]) // PER_FILTER for k in range(i, j)]).astype(np.int64)
        for k in range(HASHES):
            bits[row, ((h >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        out += [Digest(int(n[k]), packed[first[k] - first[i] : first[k + 1] - first[i]]) for k in range(i, j)]
        i = j
    return out


def _one_way(a: Digest, b: Digest) -> float:
    ones_b = np.bitwise_count(b.filters).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(a.filters))
    if len(a.filters) * len(b.filters) <= 64:
        shared = np.array([np.bitwise_count(f & b.filters).sum(axis=1, dtype=np.int64) for f in a.filters])
        best = _normal(shared, np.bitwise_count(a.filters).sum(axis=1, dtype=np.int64), ones_b).max(axis=1)
    else:
        for i in range(0, len(a.filters), 512):
            x = np.unpackbits(a.filters[i : i + 512], axis=1).astype(np.float32)
            for j in range(0, len(b.filters), 512):
                y = np.unpackbits(b.filters[j : j + 512], axis=1).astype(np.float32)
                best[i : i + 512] = np.maximum(best[i : i + 512], _normal(x @ y.T, x.sum(axis=1), ones_b[j : j + 512]).max(axis=1))
    return float(best @ a.sizes() / a.features)


def _normal(shared: np.ndarray, ones_a: np.ndarray, ones_b: np.ndarray) -> np.ndarray:
    chance, most = np.outer(ones_a, ones_b) / BITS, np.minimum.outer(ones_a, ones_b)
    return np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1)


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1; the same both ways."""
    if not a.features or not b.features:
        return float(a.features == b.features)
    if a.features != b.features:
        return _one_way(*sorted((a, b), key=lambda d: d.features))
    return (_one_way(a, b) + _one_way(b, a)) / 2


def rarity(docs: DataFrame) -> np.ndarray:
    """The ranks, from the windows of every text of docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES, np.int64)
        for batch in slices(batches):
            total += histogram(batch.column(0).to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["c", "n"])

    rows = docs.select("text").mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES, np.int64)
    for r in rows:
        counts[r["c"]] = r["n"]
    return ranks(counts)


def edited(text: str, following: str) -> str:
    """text with the last quarter of its code points replaced by the first as many of `following`."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _part_of(cuts: list[int], k: Column, h: Column) -> Column:
    """The part of a row (k, h): the number of cuts up to k. A k that is d cuts at once has d parts, which its rows share by h."""
    if not cuts:
        return F.lit(0)
    wide = max(1, int(len(cuts) ** 0.5))
    # One literal each after constant folding, however many cuts there are.
    flat, coarse = (F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>") for c in (cuts, cuts[::wide]))

    def count(holds) -> Column:
        group = F.size(F.filter(coarse, holds))
        return F.when(group == 0, F.lit(0)).otherwise((group - 1) * wide + F.size(F.filter(F.slice(flat, (group - 1) * wide + 1, F.lit(wide)), holds)))

    upto = count(lambda c: c <= k)
    if len(set(cuts)) == len(cuts):
        return upto
    below = count(lambda c: c < k)
    share = F.floor((h / F.lit(2.0**64) + 0.5) * (upto - below))
    return F.when(upto - below < 2, upto).otherwise(below + 1 + F.least(share, upto - below - 1)).cast("int")


def fingerprint(docs: DataFrame, rows_a_part: int = 1000) -> DataFrame:
    """SCHEMA for each row of docs, ascending doc_id; the last is followed by the first.

    The texts are shuffled once, into parts that are ranges of doc_id (of the text's hash, where one
    doc_id has many rows); the first row of each part goes to the part before it as well, which needs it
    as the next document. Parts are streamed, not held; of n rows there are at most sqrt(n) parts, as
    the driver knows their bounds.
    """
    spark = docs.sparkSession
    rank = rarity(docs)
    n = docs.count()
    parts = max(1, min(n // rows_a_part, int(n**0.5)))
    last = F.lit((1 << 63) - 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), last).alias("k"), F.xxhash64("text").alias("h"), F.lit(1).cast("long").alias("alike"), "text")
    cuts = sorted(rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] or []) if parts > 1 else []
    hot = [c for c, d in Counter(cuts).items() if d > 1]
    if hot:
        # One row stands for the many that are alike in doc_id and text.
        key = ["k", "h"]
        many = rows.where(F.col("k").isin(hot)).groupBy(*key).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > rows_a_part).select(*key)
        many = small(materialize(many, "many"), n // rows_a_part)
        one = rows.join(many, key, "left_semi").groupBy("doc_id", *key).agg(F.sum("alike").alias("alike"), F.first("text").alias("text"))
        rows = rows.join(many, key, "left_anti").unionByName(one)
        rows = materialize(rows, "rows")
    part = _part_of(cuts, F.col("k"), F.col("h"))
    firsts = sorted((r["part"], r["f"]["k"], r["f"]["h"]) for r in rows.groupBy(part.alias("part")).agg(F.min(F.struct("k", "h")).alias("f")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    ahead = spark.createDataFrame([(k, h, firsts[i - 1][0]) for i, (_, k, h) in enumerate(firsts)], "first_k long, first_h long, before int")
    place = lambda p, look: F.struct(p.alias("part"), F.lit(look).alias("look"))
    own, also = place(F.col("part"), 0), place(F.col("before"), 1)
    rows = (
        rows.join(F.broadcast(ahead), (F.col("k") == F.col("first_k")) & (F.col("h") == F.col("first_h")), "left")
        .withColumn("part", part.cast("int"))
        .withColumn("p", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, also))))
        .select("p.part", "p.look", "doc_id", "k", "h", "alike", "text")
    )
    sent = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, look, ids_, alike, texts, made = [], [], [], [], [], []
        for batch in slices(batches):
            part += batch.column(0).to_pylist()
            look += batch.column(1).to_pylist()
            ids_ += batch.column(2).to_pylist()
            alike += batch.column(3).to_pylist()
            new = [t or "" for t in batch.column(4).to_pylist()]
            texts += new
            made += digests(new, sent.value)
            own = [i for i in range(len(texts) - 1) if not look[i] and part[i] == part[i + 1]]
            pairs = [(i, i + 1, 1) for i in own] + [(i, i, alike[i] - 1) for i in own if alike[i] > 1]
            changed = [edited(texts[i], texts[j]) for i, j, _ in pairs]
            after = digests(changed, sent.value)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids_[i] for i, _, _ in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i, _, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
                    pa.array([str(made[i]) for i, _, _ in pairs], pa.string()),
                    pa.array([str(d) for d in after], pa.string()),
                    pa.array([likeness(made[i], d) for (i, _, _), d in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([likeness(made[i], made[j]) for i, j, _ in pairs], pa.float64()),
                    pa.array([m for _, _, m in pairs], pa.int64()),
                ],
                [*(f.split()[0] for f in SCHEMA.split(", ")), "times"],
            )
            part, look, ids_, alike, texts, made = part[-1:], look[-1:], ids_[-1:], alike[-1:], texts[-1:], made[-1:]

    dealt = rows.repartition("part").sortWithinPartitions("part", "look", "k", "h")
    found = dealt.select("part", "look", "doc_id", "alike", "text").mapInArrow(run, SCHEMA + ", times long")
    return numbered(found, "times", "nth", n).drop("nth") if hot else found.drop("times")
