"""Approximate nearest neighbours by inner product: an inverted file scanned by adaptive dimensions.

- Rows with equal vectors beyond the first k + 1 by vec_id can be in no result of k, so they
  stay out of the index; queries with equal vectors are searched once. So a very common vector
  makes no large group.
- Vectors get one more component, which makes their lengths equal; then the largest inner product
  is the least distance. They are turned by a random rotation and kept in blocks of columns.
- Centroids come from k-means over at most FIT distinct vectors, drawn by hash (a parameter);
  every row is put into the list of its nearest centroid. How many lists a query probes is
  the least number that reaches TARGET recall for CALIBRATE queries, whose true neighbours one
  pass over the whole index gives.
- The k-th distance within the fitted sample bounds each query's k-th distance from above. In a
  probed list, a candidate's partial distance after some blocks, scaled up, is tested against
  that bound; if it is too large at a significance that falls with the dimensions seen, the
  candidate is abandoned. Survivors are scored on the original vectors in double precision.

Lists and the queries that probe them are joined in blocks of bounded size. Vectors that are
null, zero, or hold null or non-finite components take no part, neither do null vec_ids or
vectors of another than the most frequent dimension. Only the query's own row is no candidate:
other rows with its vec_id are, equal vectors or not. Ties go to the smaller vec_id. Empty tables
give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

FIT, CALIBRATE, TARGET = 16_384, 256, 0.97
#: Sampled vectors a list, at least: so the sample's size is what bounds the number of lists.
_A_LIST = 8
STRIDE, EPSILON = 16, 2.1
_CANDIDATES, _QUERIES = 8192, 2048
_PAIRS = 1 << 20


def valid(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


@dataclass
class Index:
    dim: int
    longest: float
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray
    k: int
    probes: int = 1
    home: np.ndarray | None = None

    def turn(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Rotated, with the component that makes lengths equal (0 for queries)."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest - (x.astype(np.float64) ** 2).sum(axis=1), 0))
        return np.column_stack([x, rest]).astype(np.float32) @ self.rotation

    def nearest(self, y: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row, nearest first."""
        d = (self.centroids**2).sum(axis=1) - 2 * (y @ self.centroids.T)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def bound(self, y: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """For each query, its (k + 1)-th squared distance to the sampled vectors of the lists it probes."""
        if len(self.sample) <= self.k:
            return np.full(len(y), np.inf, np.float32)
        if self.home is None:
            self.home = np.concatenate([self.nearest(self.sample[i : i + 4096], 1)[:, 0] for i in range(0, len(self.sample), 4096)])
        d = (y**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1) - 2 * (y @ self.sample.T)
        probed = np.zeros((len(y), len(self.centroids)), bool)
        np.put_along_axis(probed, lists, True, axis=1)
        d[~probed[:, self.home]] = np.inf
        return np.partition(d, self.k, axis=1)[:, self.k] * np.float32(1 + 1e-4) + np.float32(1e-5 * self.longest)


def kmeans(x: np.ndarray, lists: int, turns: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), lists, replace=False))].copy()
    for _ in range(turns):
        near = np.concatenate([np.argmin((c**2).sum(axis=1) - 2 * (x[i : i + 4096] @ c.T), axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=lists)
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(n)
        c[some] = np.add.reduceat(x[order], (np.cumsum(n) - n)[some], axis=0) / n[some][:, None]
    return c


def fit(x: np.ndarray, longest: float, rows: int, k: int, seed: int = 3) -> Index:
    """An index over a sample x; longest: the largest squared length, rows: of the whole table."""
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((d + 1, d + 1)))[0].astype(np.float32)
    index = Index(d, longest, rotation, np.zeros((1, d + 1), np.float32), np.zeros((0, d + 1), np.float32), k)
    index.sample = index.turn(x)
    index.centroids = kmeans(index.sample, max(1, min(int(rows**0.5), len(x) // _A_LIST)))
    return index


def scan(x: np.ndarray, y: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) that the adaptive scan of all dimensions doesn't abandon; x, y rotated."""
    d = x.shape[1]
    out_q, out_c = [], []
    step = max(1, _PAIRS // max(1, len(x)))
    xb, x2 = x[:, :STRIDE], (x[:, :STRIDE] ** 2).sum(axis=1)
    for lo in range(0, len(y), step):
        part = y[lo : lo + step]
        limit = bound[lo : lo + step]
        acc = (part[:, :STRIDE] ** 2).sum(axis=1)[:, None] + x2 - 2 * (part[:, :STRIDE] @ xb.T)
        seen = min(STRIDE, d)
        q, c = np.nonzero(acc * (d / seen) <= (limit * (1 + EPSILON / seen**0.5 * (seen < d)) ** 2)[:, None])
        acc = acc[q, c]
        while seen < d and len(q):
            end = min(seen + STRIDE, d)
            acc = acc + ((x[c, seen:end] - part[q, seen:end]) ** 2).sum(axis=1)
            seen = end
            keep = acc * (d / seen) <= limit[q] * (1 + EPSILON / seen**0.5 * (seen < d)) ** 2
            q, c, acc = q[keep], c[keep], acc[keep]
        out_q.append(q + lo)
        out_c.append(c)
    return np.concatenate(out_q) if out_q else np.zeros(0, np.int64), np.concatenate(out_c) if out_c else np.zeros(0, np.int64)


def best(q: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """The rows of each q's k largest scores, ties to the smaller vec_id."""
    order = np.lexsort((vec_id, -score, q))
    s = q[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return order[np.arange(len(s)) - start < k]


def _vectors(col, kind: str) -> np.ndarray:
    raw = b"".join(col)
    return np.frombuffer(raw, kind).reshape(len(col), -1) if len(col) else np.zeros((0, 0), kind)


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # Row by row in one order, so that equal vectors have equal scores.
    return (a.astype(np.float64) * b.astype(np.float64)).sum(axis=1)


def search(table: DataFrame, is_query: Column, k: int = 20, sample: int = FIT, target: float = TARGET, vector: str = "embedding", seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of table that is_query holds for."""
    spark = table.sparkSession
    out = "query_id long, rank int, vec_id long, score double"
    kind = "<f4" if "float" in table.schema[vector].dataType.simpleString() else "<f8"
    element = "float" if kind == "<f4" else "double"
    v = F.col(vector).cast(f"array<{element}>")
    rows = table.where(F.col("vec_id").isNotNull() & valid(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), is_query.alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    dim = sizes[0]["d"]
    rows = rows.where(F.size("v") == dim)
    key = [F.xxhash64("v").alias("k1"), F.hash("v").alias("k2")]
    nth = F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id"))
    packed = rows.select("vec_id", "v", *key).withColumn("nth", nth).where(F.col("nth") <= k + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            long = (x.astype(np.float64) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary()), b.column(2), pa.array(long)], ["vec_id", "v", "nth", "length"])

    kept = materialize(packed.select("vec_id", "v", "nth").mapInArrow(pack, "vec_id long, v binary, nth int, length double"), "vectors")
    about = kept.agg(F.count(F.lit(1)), F.max("length"), F.sum((F.col("nth") == 1).cast("long"))).first()
    h = F.xxhash64("vec_id", F.lit(seed))
    share = min(1.0, 2 * sample / about[2])
    drawn = kept.where((F.col("nth") == 1) & ((h / F.lit(2.0**64) + 0.5) <= share)).orderBy(h, "vec_id").limit(sample).select("v").toArrow()
    index = fit(_vectors(drawn["v"].to_pylist(), kind), float(about[1]), about[0], k, seed)

    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1).to_pylist(), kind)
            lists = sent.value.nearest(sent.value.turn(x), 1)[:, 0] if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lists, pa.int32())], ["vec_id", "v", "list"])

    placed = materialize(kept.select("vec_id", "v").mapInArrow(place, "vec_id long, v binary, list int"), "index")
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "v", *key)
    asked = queries.groupBy("k1", "k2").agg(F.min(F.struct("query_id", "v")).alias("s")).select("k1", "k2", F.monotonically_increasing_id().alias("q"), F.col("s.v").alias("v"))

    def blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([r.tobytes() for r in x], pa.binary())], ["k1", "k2", "q", "v"])

    asked = materialize(asked.mapInArrow(blob, "k1 long, k2 int, q long, v binary"), "queries")
    index.probes = _calibrate(placed, asked, index, kind, target, seed)
    found = materialize(_scan(placed, asked, index, kind), "found")
    # The test may abandon one of the last; who has fewer than k + 1 is searched again, in all lists and without it.
    enough = found.groupBy("q").count().where(F.col("count") > k).select("q")
    short = materialize(asked.join(enough, "q", "left_anti"), "short")
    if not short.isEmpty():
        plain = Index(**{**vars(index), "probes": len(index.centroids), "sample": index.sample[:0], "home": None})
        found = found.join(short.select("q"), "q", "left_anti").unionByName(_scan(placed, short, plain, kind))
    # k + 1 entries a query at most.
    each = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "same"))).alias("found"))
    hits = asked.select("k1", "k2", "q").join(each, "q").select("k1", "k2", "found")
    own = queries.select("query_id", "k1", "k2").join(hits, ["k1", "k2"])
    # Rows alike in vec_id and vector can't be told apart: the first of them stands for the query's own.
    at = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("found", lambda x, i: i + 1 != at), 1, k)
    return own.select("query_id", F.posexplode(others).alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _scan(placed: DataFrame, asked: DataFrame, index: Index, kind: str) -> DataFrame:
    """q, vec_id, score, same, r: the k + 1 nearest candidates found in the lists that each query probes; same: whether the vectors are equal."""
    spark, k = placed.sparkSession, index.k
    sent = spark.sparkContext.broadcast(index)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column(1).to_pylist(), kind)
            for lo in range(0, len(x), 1024):
                y = sent.value.turn(x[lo : lo + 1024], True)
                lists = sent.value.nearest(y, sent.value.probes)
                each = np.repeat(np.arange(lo, lo + len(y)), lists.shape[1])
                bound = np.repeat(sent.value.bound(y, lists), lists.shape[1]).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(each)), b.column(1).take(pa.array(each)), pa.array(lists.ravel(), pa.int32()), pa.array(bound)], ["q", "v", "list", "bound"])

    probes = materialize(asked.select("q", "v").mapInArrow(probe, "q long, v binary, list int, bound double"), "probes")
    # Blocks of each list: one row a list on the driver.
    many: dict[int, list[int]] = {}
    for i, (df, most) in enumerate(((placed, _CANDIDATES), (probes, _QUERIES))):
        for r in df.groupBy("list").count().collect():
            many.setdefault(r["list"], [1, 1])[i] = -(-r["count"] // most)
    blocks = F.broadcast(spark.createDataFrame([(a, c, q) for a, (c, q) in sorted(many.items())], "list int, ncb int, nqb int"))
    cand = placed.join(blocks, "list").select("list", F.pmod(F.xxhash64("vec_id", "v"), F.col("ncb")).cast("int").alias("cb"), F.explode(F.sequence(F.lit(0), F.col("nqb") - 1)).alias("qb"), "vec_id", "v")
    ask = probes.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("ncb") - 1)).alias("cb"), F.pmod(F.xxhash64("q"), F.col("nqb")).cast("int").alias("qb"), "q", F.col("v").alias("qv"), "bound")

    def block(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(c) or not len(a):
            return pd.DataFrame({"q": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0), "same": np.zeros(0, bool)})
        x, y = _vectors(c["v"].tolist(), kind), _vectors(a["qv"].tolist(), kind)
        q, i = scan(sent.value.turn(x), sent.value.turn(y, True), a["bound"].to_numpy(np.float32))
        score = np.concatenate([_inner(x[i[s : s + 65536]], y[q[s : s + 65536]]) for s in range(0, len(q), 65536)]) if len(q) else np.zeros(0)
        ids = c["vec_id"].to_numpy()
        top = best(q, ids[i], score, k + 1)
        same = (x[i[top]] == y[q[top]]).all(axis=1)
        return pd.DataFrame({"q": a["q"].to_numpy()[q[top]], "vec_id": ids[i[top]], "score": score[top], "same": same})

    grid = ["list", "cb", "qb"]
    found = cand.groupBy(*grid).cogroup(ask.groupBy(*grid)).applyInPandas(block, "q long, vec_id long, score double, same boolean")
    top = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)


def _calibrate(placed: DataFrame, asked: DataFrame, index: Index, kind: str, target: float, seed: int) -> int:
    """The least number of probed lists that finds `target` of the true neighbours of CALIBRATE queries."""
    lists = len(index.centroids)
    if lists == 1:
        return 1
    some = asked.orderBy(F.xxhash64("q", F.lit(seed)), "q").limit(CALIBRATE).select("v").toArrow()
    y = _vectors(some["v"].to_pylist(), kind)
    sent = placed.sparkSession.sparkContext.broadcast(y)
    k = index.k

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(sent.value)
        score, where, ids = np.full((n, 0), 0.0), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        for b in batches:
            x = _vectors(b.column(1).to_pylist(), kind)
            for lo in range(0, len(x), 8192):
                part = x[lo : lo + 8192]
                score = np.column_stack([score, sent.value.astype(np.float64) @ part.astype(np.float64).T])
                where = np.column_stack([where, np.broadcast_to(b.column(2).to_numpy()[lo : lo + 8192], (n, len(part)))])
                ids = np.column_stack([ids, np.broadcast_to(b.column(0).to_numpy()[lo : lo + 8192], (n, len(part)))])
                if score.shape[1] > k:
                    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
                    score, where, ids = (np.take_along_axis(m, top, axis=1) for m in (score, where, ids))
        q = np.repeat(np.arange(n), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(where.ravel(), pa.int32()), pa.array(ids.ravel(), pa.int64()), pa.array(score.ravel())], ["i", "list", "vec_id", "score"])

    seen = placed.select("vec_id", "v", "list").mapInArrow(exact, "i int, list int, vec_id long, score double")
    top = seen.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k).select("i", "list").collect()
    if not top:
        return lists
    order = index.nearest(index.turn(y, True), lists)
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    needed = np.sort([turn[r["i"], r["list"]] for r in top])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1
