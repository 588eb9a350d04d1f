"""Near-duplicate documents by DartMinHash.

A text is the multiset of its runs of five words; two texts are linked if the weighted Jaccard
similarity of theirs is at least THRESHOLD, and classes are the components of the links.

1. Equal texts collapse into one by hash; everything below sees different texts only.
2. Every shingle throws darts into the region of its weight: unit cells of weight and rank get
   a Poisson number of darts each, all drawn from the shingle's hash. Each dart belongs to a
   coordinate, and each coordinate keeps its earliest dart. Only ranks up to a bound that is
   in inverse proportion to the total weight are thrown, so a text costs its number of
   shingles or K ln K darts, whichever is more; if a coordinate stays empty the bound doubles.
3. ROWS coordinates make a band. A band's bucket has a leader; each member is held against it.
4. Buckets that still span components get a new leader, for TURNS turns; a member is held against
   it unless they share a component by then. A turn is linear in the buckets.
5. What spans components even so is compared in full, in tiles of bounded size: all members outside
   the bucket's largest component against each other and against that component. Tiles see
   signatures of one byte a coordinate only, each pair once over all bands.
6. Pairs are judged by signature where that is beyond doubt (four standard deviations), else by
   the exact similarity of the whole texts, which are fetched for members of doubtful pairs only.

So no pair of a bucket is left untested except within a component. A pair at exactly 0.8 shares
no bucket with probability 0.0006, at 0.85 under 0.00001.

Null texts are classes of their own; wordless texts link to equal ones only. Ids decide nothing but
a class's name: texts are told apart by hashes, so null and repeated doc_ids do no harm. Repeated
rows are copies. Very long texts are cut at white space while they are hashed. Empty tables give
empty results. Extra columns are ignored by `classes` and kept by `deduplicate`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hold, materialize, slices, small, tidy
from .components import components
from .shingles import jaccard, mix, multisets

THRESHOLD = 0.8
ROWS, BANDS = 8, 40
K = ROWS * BANDS
_DARTS = K * math.log(K) + 2 * K
_EMPTY = np.uint64((1 << 64) - 1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])
_POISSON32 = (np.minimum(_POISSON, 1 - 2**-33) * 2**32).astype(np.uint32)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SIGMA = math.sqrt(THRESHOLD * (1 - THRESHOLD) / K)
SURE, HOPELESS = THRESHOLD + 4 * _SIGMA, THRESHOLD - 4 * _SIGMA
TURNS = 2
_TILE = 1024
#: So many links are joined in one task.
_FEW = 200_000


def _throw(text: np.ndarray, cell: np.ndarray, bound: np.ndarray, out: np.ndarray, weight: np.ndarray | None = None) -> None:
    """Darts of the unit weight cells of some texts, ranks below bound[text]; out[text, coordinate] keeps the least.

    weight: the part of a cell that its element covers, where not all.
    """
    ranks = np.ceil(bound).astype(np.int64)[text]
    if (ranks > 1).any():
        base = np.repeat(np.cumsum(ranks) - ranks, ranks)
        b = np.arange(len(base)) - base
        text, cell = np.repeat(text, ranks), np.repeat(cell, ranks)
        weight = None if weight is None else np.repeat(weight, ranks)
    else:
        b = np.zeros(len(text), np.int64)
    seed = mix(cell + b.astype(np.uint64) * _GOLD)
    n = np.searchsorted(_POISSON32, (seed >> np.uint64(32)).astype(np.uint32), side="right")
    base = np.repeat(np.cumsum(n) - n, n)
    dart = mix(np.repeat(seed, n) + (np.arange(len(base)) - base + 1).astype(np.uint64) * _GOLD)
    text, b = np.repeat(text, n), np.repeat(b, n)
    # 20 bits after the point; 12 before it, so ranks up to 4095
    rank = (b.astype(np.uint64) << np.uint64(20)) | (dart >> np.uint64(44))
    keep = rank < (bound * 2**20).astype(np.uint64)[text]
    if weight is not None:
        keep &= (mix(dart ^ _GOLD) >> np.uint64(11)).astype(float) * 2.0**-53 < np.repeat(weight, n)
    dart, text, rank = dart[keep], text[keep], rank[keep]
    name = mix(dart + _GOLD)
    at = text * K + (name % np.uint64(K)).astype(np.int64)
    np.minimum.at(out.reshape(-1), at, (rank << np.uint64(32)) | (name >> np.uint64(32)))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts x K) rank and name of each coordinate's earliest dart; a row of _EMPTY for an empty multiset.

    Weights may be fractions; a whole weight fills its cells.
    """
    out = np.full((len(sets), K), _EMPTY)
    total = np.array([float(w.sum()) for _, w in sets])
    todo = np.flatnonzero(total > 0)
    darts = _DARTS
    while len(todo):
        at = 0
        while at < len(todo):  # some texts at a time, about 250,000 darts
            end, size = at, 0.0
            while end < len(todo) and (end == at or size < 2.5e5):
                size += max(total[todo[end]], darts)
                end += 1
            some = todo[at:end]
            bound = np.minimum(darts / total[some], 4095.0)
            text, cell, part = [], [], []
            fractions = any(sets[k][1].dtype.kind == "f" for k in some)
            for i, k in enumerate(some):
                h, w = sets[k]
                cells = np.ceil(w).astype(np.int64)
                first = np.repeat(np.cumsum(cells) - cells, cells)
                nth = np.arange(len(first)) - first
                cell.append(mix(np.repeat(h, cells) + nth.astype(np.uint64) * _GOLD) if len(first) > len(h) else mix(h))
                text.append(np.full(len(first), i))
                if fractions:
                    part.append(np.minimum(1.0, np.repeat(w, cells) - nth))
            got = np.full((len(some), K), _EMPTY)
            text, cell = np.concatenate(text), np.concatenate(cell)
            part = np.concatenate(part) if part else None
            for lo in range(0, len(text), 1 << 18):
                hi = lo + (1 << 18)
                _throw(text[lo:hi], cell[lo:hi], bound, got, None if part is None else part[lo:hi])
            out[some] = got
            at = end
        empty = (out[todo] == _EMPTY).any(axis=1) & (darts / total[todo] < 4095.0)
        todo, darts = todo[empty], darts * 2
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    name = (sig & np.uint64(0xFFFFFFFF)).reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _GOLD, (len(sig), BANDS)).copy()
    for k in range(ROWS):
        h = mix((h + name[:, :, k]) * _GOLD)
    return h.view(np.int64)


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), F.length(text).alias("t3")]


KEY = ["t1", "t2", "t3"]


def sketch(docs: DataFrame) -> DataFrame:
    """id (the row's number), doc_id, t1, t2, t3 (the text's hashes; null without text), weight, bands, bytes (one a coordinate) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = list(multisets([t or "" for t in batch.column(4).to_pylist()]))
            sig = signatures(sets)
            some = np.array([len(h) > 0 for h, _ in sets], bool)
            bands, low = _bands(sig), (sig & np.uint64(255)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k) for k in range(4)),
                    pa.array([int(w.sum()) for _, w in sets], pa.int64()),
                    pa.array([b if s else None for b, s in zip(bands, some, strict=True)], pa.list_(pa.int64())),
                    pa.array([x.tobytes() if s else None for x, s in zip(low, some, strict=True)], pa.binary()),
                ],
                ["doc_id", *KEY, "weight", "bands", "bytes"],
            )

    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long"), *[F.when(text.isNotNull(), k).alias(n) for k, n in zip(_key(text), KEY, strict=True)], "text")
    made = rows.mapInArrow(run, "doc_id long, t1 long, t2 int, t3 int, weight long, bands array<long>, bytes binary")
    return made.select(F.monotonically_increasing_id().alias("id"), "*")


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from rows of bytes; names that differ agree in a byte once in 256 times."""
    return ((a == b).mean(axis=-1) - 1 / 256) * (256 / 255)


def _texts(ids: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """id, text of the texts that ids names."""
    keys = hold(sketches.select("id", *KEY).join(ids.distinct(), "id", "left_semi"))
    text = docs.where(F.col("text").isNotNull()).select(*_key(F.col("text")), "text")
    # Copies collapse before they are shuffled.
    return materialize(text.join(small(keys, keys.count()), KEY).select("id", "text").dropDuplicates(["id"]), "texts")


def _side(sketches: DataFrame, s: str) -> DataFrame:
    return sketches.select(F.col("id").alias(s), F.col("weight").alias("w" + s), F.col("bytes").alias("s" + s))


def _judge(pairs: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b) that are links."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, K) for k in (2, 3))
            guess = _estimate(sa, sb)
            keep = pa.array(guess >= HOPELESS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(guess >= SURE).filter(keep)], ["a", "b", "sure"])

    near = F.least("wa", "wb") >= F.lit(THRESHOLD) * F.greatest("wa", "wb")
    guessed = pairs.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b").where(near).select("a", "b", "sa", "sb").mapInArrow(estimate, "a long, b long, sure boolean")
    guessed = hold(guessed)
    doubt = guessed.where(~F.col("sure"))
    texts = _texts(doubt.select(F.explode(F.array("a", "b")).alias("id")), sketches, docs)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2), batch.column(3)
            keep, last = [], (None, None)
            for i in sorted(range(len(a)), key=lambda i: b[i]):
                if last[0] != b[i]:
                    last = (b[i], next(multisets([tb[i].as_py()])))
                if jaccard(next(multisets([ta[i].as_py()])), last[1]) >= THRESHOLD:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])

    text = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias("t" + s))
    checked = doubt.select("a", "b").join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")
    return guessed.where("sure").select("a", "b").unionByName(checked)


class _Forest:
    """Components that grow together."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def top(self, c: int) -> int:
        above = self.above
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        x, y = self.top(a), self.top(b)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


_FOUND = "band long, lo int, hi int, id long, comp long, block int, link long"


def _near(band: int, lo: int, hi: int, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, guess): a tile's pairs that aren't hopeless by signature. A pair belongs to the first band its members share."""
    comp, w, block = pdf["comp"].to_numpy(), pdf["weight"].to_numpy(float), pdf["block"].to_numpy()
    sig = np.frombuffer(b"".join(pdf["bytes"]), np.uint8).reshape(-1, K)
    bands = np.stack(pdf["bands"].to_numpy())
    here = int(np.flatnonzero(bands[0] == band)[0])
    right = np.flatnonzero(block == hi)
    found_i, found_j, guesses = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in np.flatnonzero(block == lo):
        j = right[(comp[right] != comp[i]) & (np.minimum(w[right], w[i]) >= THRESHOLD * np.maximum(w[right], w[i]))]
        if lo == hi:
            j = j[j > i]
        j = j[~(bands[j, :here] == bands[i, :here]).any(axis=1)] if here else j
        guess = _estimate(sig[j], sig[i])
        near = guess >= HOPELESS
        found_i.append(np.full(near.sum(), i))
        found_j.append(j[near])
        guesses.append(guess[near])
    return np.concatenate(found_i), np.concatenate(found_j), np.concatenate(guesses)


def _tile(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a tile's members by signature: a row a sure link that joins components (comp, link), the likeliest first; and, without
    a link, each member of doubtful pairs between what is apart then, with its component as it is then."""
    band, lo, hi = (int(k) for k in key)
    pdf = pdf.reset_index(drop=True)
    comp = pdf["comp"].to_numpy()
    i, j, guess = _near(band, lo, hi, pdf)
    forest = _Forest()
    sure = np.flatnonzero(guess >= SURE)
    links = [n for n in sure[np.argsort(-guess[sure], kind="stable")].tolist() if forest.join(int(comp[i[n]]), int(comp[j[n]]))]
    root = np.array([forest.top(int(c)) for c in comp], np.int64)
    apart = (guess < SURE) & (root[i] != root[j])
    doubt = np.unique(np.concatenate((i[apart], j[apart])))
    at = np.concatenate((i[links], doubt))
    out = pd.DataFrame({"band": band, "lo": lo, "hi": hi, "id": pdf["id"].to_numpy()[at], "comp": np.concatenate((comp[i[links]], root[doubt])), "block": pdf["block"].to_numpy()[at]})
    return out.assign(link=pd.array([*comp[j[links]].tolist(), *[None] * len(doubt)], dtype="Int64"))


def _weigh(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the members of a tile's doubtful pairs: the links that join components by exact similarity, the likeliest first."""
    pdf = pdf.reset_index(drop=True)
    comp, text = pdf["comp"].tolist(), pdf["text"].tolist()
    sets: dict[int, tuple] = {}

    def words(i: int) -> tuple:
        if i not in sets:
            sets[i], text[i] = next(multisets([text[i]])), None
        return sets[i]

    i, j, guess = _near(*(int(k) for k in key), pdf)
    forest, out = _Forest(), []
    for n in np.argsort(-guess, kind="stable").tolist():
        a, b = int(i[n]), int(j[n])
        if forest.top(comp[a]) != forest.top(comp[b]) and jaccard(words(a), words(b)) >= THRESHOLD:
            forest.join(comp[a], comp[b])
            out.append((comp[a], comp[b]))
    return pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _tiled(left: DataFrame, sketches: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: links between components, enough to join all that the buckets left (band, id, comp) hold."""
    each = left.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = each.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n")).select(F.col("band").alias("mband"), F.col("m.comp").alias("most"), F.ceil(F.col("m.n") / _TILE).cast("int").alias("own"), F.ceil((F.col("n") - F.col("m.n")) / _TILE).cast("int").alias("rest"))
    h, first = F.xxhash64("id"), F.col("comp") == F.col("most")
    block = F.when(first, F.pmod(h, F.col("own"))).otherwise(F.col("own") + F.pmod(h, F.col("rest"))).cast("int")
    # Blocks of the largest component meet the others only, not each other.
    others = F.sequence(F.when(first, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("rest") - 1)
    placed = left.join(most, F.col("band") == F.col("mband")).select("band", "id", "comp", block.alias("block"), F.explode(others).alias("other"))
    sides = placed.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "comp")
    signed = sketches.select("id", "weight", "bytes", "bands")
    tile = ["band", "lo", "hi"]
    found = materialize(sides.join(signed, "id").groupBy(*tile).applyInPandas(_tile, _FOUND), "tiled")
    # A member of doubtful pairs is sent with its text once a tile, however many these are.
    doubt = found.where(F.col("link").isNull()).select(*tile, "id", "comp", "block")
    texts = _texts(doubt.select("id"), sketches, docs)
    weighed = doubt.join(signed, "id").join(texts, "id").groupBy(*tile).applyInPandas(_weigh, "a long, b long")
    return found.where(F.col("link").isNotNull()).select(F.col("comp").alias("a"), F.col("link").alias("b")).unionByName(weighed)


def connected(every: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, root of every text that is linked to another. every: sketch(docs); nodes: node, the id of one row of each text."""
    # No sort of the wide side: the narrow one is hashed, partition by partition.
    texts = every.where(F.col("bands").isNotNull()).select("id", "bands").join(nodes.select(F.col("node").alias("id")).hint("shuffle_hash"), "id", "left_semi")
    texts = materialize(texts, "texts")
    member = texts.select("id", F.explode("bands").alias("band"))
    leader = member.groupBy("band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("band", "lband")
    bucket = hold(member.join(leader.hint("shuffle_hash"), F.col("band") == F.col("lband")).select("band", "id", "leader", "n"))
    pairs = bucket.where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    good = hold(_judge(pairs, every, docs))
    roots = hold(components(good, few=_FEW))
    # What failed against the leader: its bucket is searched on across the components so far. Of two members there is no other pair.
    failed = bucket.where("id <> leader AND n > 2").join(good, (F.col("id") == F.col("a")) & (F.col("leader") == F.col("b")), "left_anti").select(F.col("band").alias("fband")).distinct()
    left = bucket.join(failed, F.col("band") == F.col("fband"), "left_semi").join(roots, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("root", "id").alias("comp"))
    left, more = _apart(left), []
    tidy(docs.sparkSession)
    # What follows reads the sketches several times; most texts are in no contested bucket, so these are left out once.
    here = hold(left.select("id").distinct())
    n = here.count()
    contested = materialize(every.drop("doc_id").join(small(here, n), "id", "left_semi"), "contested") if n else every
    for turn in range(TURNS):
        if left.isEmpty():
            break
        lead = left.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("id"), F.col("comp").alias("comp"))).alias("l")).select(F.col("band").alias("lband"), "l")
        held = left.join(lead, F.col("band") == F.col("lband")).where(F.col("comp") != F.col("l.comp")).select(F.col("id").alias("a"), F.col("l.id").alias("b"), F.col("comp").alias("ca"), F.col("l.comp").alias("cb"))
        held = hold(held.distinct())
        new = held.join(_judge(held.select("a", "b"), contested, docs), ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        more.append(hold(new.distinct()))
        joined = components(more[-1], few=_FEW)
        left = _apart(left.join(joined, F.col("comp") == F.col("node"), "left").select("band", "id", F.coalesce("root", "comp").alias("comp")))
        tidy(docs.sparkSession)
    if not left.isEmpty():
        more.append(_tiled(left, contested, docs))
    if not more:
        return roots
    # Links between components, as they were at each turn: each is named by one of its nodes, which an earlier link joins to the others.
    joined = more[0]
    for x in more[1:]:
        joined = joined.unionByName(x)
    joined = hold(components(joined, few=_FEW)).select(F.col("node").alias("was"), F.col("root").alias("now"))
    named = roots.unionByName(joined.select(F.col("was").alias("node"), F.col("was").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return named.join(joined, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root"))


def _apart(rows: DataFrame) -> DataFrame:
    """The rows (band, id, comp) of the bands that span components, written."""
    rows = hold(rows)
    spans = rows.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select(F.col("band").alias("sband"))
    return materialize(rows.join(spans, F.col("band") == F.col("sband"), "left_semi"), "apart")


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sketch(docs); t1, t2, t3, class, class_id of each text). Classes may share a class_id where rows share a doc_id."""
    every = materialize(sketch(docs), "sketches")
    tidy(docs.sparkSession)
    of = every.where(F.col("t1").isNotNull()).groupBy(*KEY).agg(F.min("id").alias("text"), F.min("doc_id").alias("least"))
    of = hold(of)
    roots = connected(every, of.select(F.col("text").alias("node")), docs)
    named = of.join(roots, F.col("text") == F.col("node"), "left").select(*KEY, "least", F.coalesce("root", "text").alias("class"))
    # No doc_id in all of a class: a name below zero, from its least hash.
    label = named.groupBy("class").agg(F.coalesce(F.min("least"), -1 - F.abs(F.shiftright(F.min("t1"), 1))).alias("class_id"))
    return every, materialize(named.join(label, "class").select(*KEY, "class", "class_id"), "labels")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id for each row of docs: the smallest doc_id of the class; below zero where none has one, but null for a null text."""
    every, of = _labelled(docs)
    # Both sides are plain files, so Spark can split a hot text.
    rows = every.where(F.col("t1").isNotNull()).select("doc_id", *KEY).join(of, KEY).select("doc_id", "class_id")
    return rows.unionByName(every.where(F.col("t1").isNull()).select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs, all columns as they were, with one row of each class: that of the smallest doc_id, null last.

    A row is known by doc_id and the text's hashes; of rows alike in both one stays. Null texts all stay.
    """
    every, of = _labelled(docs)
    rows = every.where(F.col("t1").isNotNull()).groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("n"))
    rows = hold(rows.join(of, KEY))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", *KEY))
    best = rows.groupBy("class").agg(first.alias("b"), F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("class").alias("c"), "b")
    best = hold(best)
    here = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", *KEY)
    gone = rows.join(small(best, best.count()), F.col("class") == F.col("c")).where(here != F.col("b"))
    known = fresh(docs, "g0", "g1", "g2", "g3")
    named = lambda df: df.select(*[F.col(k).alias(g) for k, g in zip(("doc_id", *KEY), known, strict=True)])
    gone, again = hold(named(gone)), hold(named(rows.where("n > 1")))
    own = [F.col("doc_id").cast("long"), *_key(F.col("text"))]
    d, t1, t2, t3 = (a.eqNullSafe(F.col(g)) if g == known[0] else a == F.col(g) for a, g in zip(own, known, strict=True))
    alike = d & t1 & t2 & t3
    kept = docs.join(small(gone, gone.count()), alike, "left_anti")
    n = again.count()
    if not n:
        return kept
    again = small(again, n)
    copies = kept.join(again, alike, "left_semi").select("*", *[a.alias(g) for a, g in zip(own, known, strict=True)]).dropDuplicates(known)
    return kept.join(again, alike, "left_anti").unionByName(copies.select(*[F.col(f"`{c}`") for c in docs.columns]))
