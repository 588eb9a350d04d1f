"""Nearest neighbors of query vectors among labeled references: one contract, several plans.

Every plan returns idx, ref_id, label, distance and rank (1 to k) with ties to the smaller
ref_id. `l2` is the squared distance: taking the root could merge distinct doubles into false
ties. Distances that aren't numbers never enter.

- blocks: exact. References and queries are dealt into blocks of bounded size; each pair of
  blocks is one Arrow batch in numpy that keeps k candidates a query; a window merges them.
- join: exact, plain SQL: a nested-loop join and a window. For small tables and as a twin.
- buckets: exact, for the metrics l2 and l1 in few dimensions. A k-d tree deals the references to cells
  (of 14 dimensions it cuts the binary ones first, as they spread most). A query is searched in its own
  cell, then in every cell whose bounding box isn't farther than its k-th neighbor there; inside a cell
  by the boxes of `boxes.py`.
- pivots: exact, for the metrics l2 and l1. References belong to their nearest pivot, each pivot
  knows its radius, and the triangle inequality leaves out the pivots that can't hold a neighbor.
- cells: approximate. k-means cells, the nearest of which are searched: `probes` of them, or as many
  more as give RECALL for CALIBRATE queries drawn by hash, whose true neighbors `blocks` finds.
- hashes: approximate. Bucketed random projections; the buckets widen until CALIBRATE queries reach RECALL.
- graph: approximate. A navigable neighbor graph a block of references, walked greedily by blocks of queries.

Blocks are cut by the size of each cell or bucket, so a small one is one block however large the table is.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import NEIGHBORS
from ..shared import materialize
from .boxes import Boxes, outside

SCHEMA = "idx long, ref_id long, label string, distance double"
_REFS, _QUERIES = 65_536, 4_096
_CELLS = 1 << 22
_CELL, _DRAWN, _BOX_QUERIES = 32_768, 65_536, 32_768
_GRAPH_QUERIES = 65_536
RECALL, CALIBRATE = 0.95, 256


def distance(metric: str, a: Column, b: Column, dims: int | None = None) -> Column:
    """Of two double arrays, the components added up in order. With `dims` the sum is unrolled, which code generation likes."""
    if metric == "cosine":
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
        norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
        return F.when(norm > 0, F.lit(1.0) - dot(a, b) / norm)
    one = (lambda x, y: (x - y) * (x - y)) if metric == "l2" else (lambda x, y: F.abs(x - y))
    if metric not in ("l2", "l1"):
        raise ValueError(f"no such metric: {metric}")
    if dims:
        return reduce(lambda s, t: s + t, [one(F.get(a, i), F.get(b, i)) for i in range(dims)])
    return F.aggregate(F.zip_with(a, b, one), F.lit(0.0), lambda s, t: s + t)


def distances(metric: str, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """(queries x references), adding dimension after dimension, so that sums are equal to the bit to a scalar loop's."""
    out = np.zeros((len(q), len(r)))
    if metric == "cosine":
        norm = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((r * r).sum(axis=1))
        for i in range(q.shape[1]):
            out += q[:, i, None] * r[:, i]
        with np.errstate(all="ignore"):
            return 1 - out / norm
    for i in range(q.shape[1]):
        d = q[:, i, None] - r[:, i]
        out += d * d if metric == "l2" else np.abs(d)
    return out


def _best(d: np.ndarray, ref_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k smallest distances; a tie at the k-th goes to the smaller ref_id."""
    d = np.where(np.isnan(d), np.inf, d)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(d), np.inf)
    row, col = np.nonzero((d <= kth[:, None]) & (d < np.inf))
    order = np.lexsort((ref_id[col], d[row, col], row))
    row, col = row[order], col[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(d)))))[row]
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def _search(metric: str, k: int, skip_self: bool):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = {"idx": [], "ref_id": [], "label": [], "distance": []}
        if len(q) and len(r):
            r = r.sort_values("ref_id", kind="stable")
            x, ids, labels = np.stack(r["vector"].to_numpy()).astype(float), r["ref_id"].to_numpy(), r["label"].to_numpy()
            y, own = np.stack(q["vector"].to_numpy()).astype(float), q["idx"].to_numpy()
            step = max(1, _CELLS // len(x))
            for lo in range(0, len(y), step):
                d = distances(metric, y[lo : lo + step], x)
                if skip_self:
                    d[own[lo : lo + step][:, None] == ids] = np.nan
                row, col = _best(d, ids, k)
                for name, v in (("idx", own[lo + row]), ("ref_id", ids[col]), ("label", labels[col]), ("distance", d[row, col])):
                    out[name].append(v)
        kinds = {"idx": np.int64, "ref_id": np.int64, "label": object, "distance": float}
        return pd.DataFrame({n: np.concatenate(v) if v else np.zeros(0, kinds[n]) for n, v in out.items()})

    return run


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each idx with their rank; Spark limits each group before the shuffle too."""
    by = W.partitionBy("idx").orderBy("distance", "ref_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, on: list[str] | None = None, n_refs: int | None = None, n_queries: int | None = None) -> DataFrame:
    """Candidates: per block of references k a query. on: columns that both sides share and that must agree."""
    spark = refs.sparkSession
    if on:
        return _blocks_within(queries, refs, k, metric, skip_self, on)
    n_refs = refs.count() if n_refs is None else n_refs
    n_queries = queries.count() if n_queries is None else n_queries
    # As many blocks as the cluster has cores at least, where there are rows enough for it.
    cores = spark.sparkContext.defaultParallelism
    rb = max(1, -(-n_refs // _REFS), min(cores, n_refs // 2_000))
    qb = max(1, -(-n_queries // _QUERIES), min(-(-cores // rb), n_queries // 500))
    q = queries.select("idx", "vector", F.pmod(F.xxhash64("idx"), F.lit(qb)).cast("long").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    r = refs.select("ref_id", "vector", "label", F.pmod(F.xxhash64("ref_id"), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))).alias("qb"))
    key = ["qb", "rb"]
    return q.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(_search(metric, k, skip_self), SCHEMA)


def _blocks_within(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, on: list[str], search=None, n_queries: int = _QUERIES, more: list[str] | None = None) -> DataFrame:
    """The same within the cells that the columns `on` name on both sides: blocks by each cell's own size. Cells are few: their sizes are a small table.

    more: further columns of the queries that `search` reads.
    """
    sizes = refs.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(_REFS)).cast("int").alias("_rb")).join(queries.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(n_queries)).cast("int").alias("_qb")), on)
    sizes = F.broadcast(refs.sparkSession.createDataFrame(sizes.collect(), sizes.schema))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, on).select(*on, "idx", "vector", *(more or []), F.pmod(F.xxhash64("idx"), F.col("_qb")).cast("int").alias("qb"), upto("_rb").alias("rb"))
    r = refs.join(sizes, on).select(*on, "ref_id", "vector", "label", F.pmod(F.xxhash64("ref_id"), F.col("_rb")).cast("int").alias("rb"), upto("_qb").alias("qb"))
    key = [*on, "qb", "rb"]
    return q.groupBy(*key).cogroup(r.groupBy(*key)).applyInPandas(search or _search(metric, k, skip_self), SCHEMA)


def _join(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    q = queries.select("idx", F.col("vector").alias("qv"))
    r = refs.select("ref_id", "label", F.col("vector").alias("rv"))
    # Left to Spark whether a side is small enough to be sent around.
    pairs = q.join(r, F.col("idx") != F.col("ref_id") if skip_self else F.lit(True))
    d = pairs.select("idx", "ref_id", "label", distance(metric, F.col("qv"), F.col("rv")).alias("distance"))
    return d.where(F.col("distance").isNotNull() & ~F.isnan("distance"))


def _search_boxes(metric: str, k: int, skip_self: bool):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"idx": np.zeros(0, np.int64), "ref_id": np.zeros(0, np.int64), "label": np.zeros(0, object), "distance": np.zeros(0)})
        ids, own, most = r["ref_id"].to_numpy(), q["idx"].to_numpy(), q["most"].fillna(np.inf).to_numpy()
        boxes = Boxes(np.stack(r["vector"].to_numpy()).astype(float), ids, metric)
        row, col, d = boxes.search(np.stack(q["vector"].to_numpy()).astype(float), k, own if skip_self else None, most)
        return pd.DataFrame({"idx": own[row], "ref_id": ids[col], "label": r["label"].to_numpy()[col], "distance": d})

    return run


def _tree(x: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Cuts (dimension, value, where values up to it go, where others go) that deal x to about that many cells; a negative place is cell -1 - place."""
    cuts: list[tuple[int, float, int, int]] = []
    leaves = [0]

    def grow(x: np.ndarray, cells: int) -> int:
        dim = int(x.std(axis=0).argmax()) if len(x) else 0
        v = np.sort(x[:, dim])
        if cells < 2 or len(v) < 2 or v[0] == v[-1]:
            leaves[0] += 1
            return -leaves[0]
        at = v[(len(v) - 1) // 2]
        at = at if at < v[-1] else v[np.searchsorted(v, at) - 1]
        low = x[:, dim] <= at
        many = min(cells - 1, max(1, round(cells * low.mean())))
        cuts.append((dim, float(at), 0, 0))
        own = len(cuts) - 1
        cuts[own] = (dim, float(at), grow(x[low], many), grow(x[~low], cells - many))
        return own

    grow(x, cells)
    return cuts


def _homes(cuts: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    cell, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))] if cuts else []
    while todo:
        at, rows = todo.pop()
        dim, value, *ways = cuts[at]
        low = x[rows, dim] <= value
        for way, own in zip(ways, (rows[low], rows[~low]), strict=True):
            if way < 0:
                cell[own] = -1 - way
            else:
                todo.append((way, own))
    return cell


def _boxes(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    if metric not in ("l2", "l1"):
        raise ValueError("boxes are for l2 and l1")
    finite = F.coalesce(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    queries, refs = queries.where(finite), refs.where(finite)
    n = refs.count()
    # Only where to cut comes from a share of the rows; every row goes to its cell, and boxes are those of all rows.
    drawn = refs.where(F.pmod(F.xxhash64("ref_id"), F.lit(max(1, n // _DRAWN))) == 0).select("vector").toPandas()["vector"]
    cuts = _tree(np.stack(drawn.to_numpy()).astype(float), -(-n // _CELL)) if len(drawn) else []

    def home(it):
        for pdf in it:
            if len(pdf):
                yield pdf.assign(cell=_homes(cuts, np.stack(pdf["vector"].to_numpy()).astype(float)))

    r = materialize(refs.select("ref_id", "vector", "label").mapInPandas(home, "ref_id long, vector array<double>, label string, cell int"), "cells")
    dims = r.agg(F.max(F.size("vector"))).first()[0] or 0
    at = lambda i: F.get("vector", F.lit(i))
    edges = r.groupBy("cell").agg(F.array(*[F.min(at(i)) for i in range(dims)]).alias("lo"), F.array(*[F.max(at(i)) for i in range(dims)]).alias("hi")).collect()
    cells = np.array([e["cell"] for e in edges], np.int32)
    lo, hi = (np.array([e[c] for e in edges], float).reshape(len(edges), dims).T[:, None] for c in ("lo", "hi"))
    q = materialize(queries.select("idx", "vector").mapInPandas(home, "idx long, vector array<double>, cell int"), "homes")
    how = {"search": _search_boxes(metric, k, skip_self), "n_queries": _BOX_QUERIES, "more": ["most"]}
    near = materialize(ranked(_blocks_within(q.withColumn("most", F.lit(None).cast("double")), r, k, metric, skip_self, ["cell"], **how), k), "near")
    bound = near.groupBy("idx").agg(F.when(F.count(F.lit(1)) == k, F.max("distance")).alias("most"))

    def probe(it):
        for pdf in it:
            if len(pdf):
                y, most = np.stack(pdf["vector"].to_numpy()).astype(float), pdf["most"].fillna(np.inf).to_numpy()
                row, cell = np.nonzero((outside(metric, y, lo, hi) <= most[:, None]) & (cells != pdf["cell"].to_numpy()[:, None]))
                yield pdf.iloc[row].assign(cell=cells[cell])

    asked = q.join(bound, "idx", "left").select("idx", "vector", "most", "cell").mapInPandas(probe, "idx long, vector array<double>, most double, cell int")
    return near.drop("rank").unionByName(_blocks_within(asked, r, k, metric, skip_self, ["cell"], **how))


def _pivots(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, pivots: int, seed: int) -> DataFrame:
    if metric not in ("l2", "l1"):
        raise ValueError("pivots needs a metric with the triangle inequality")
    refs = materialize(refs, "refs")
    n = refs.count()
    m = max(1, min(pivots, int(math.sqrt(n))))
    drawn = refs.select("ref_id", "vector").orderBy(F.xxhash64("ref_id", F.lit(seed)), "ref_id").limit(m).collect()
    centers = np.array([r["vector"] for r in drawn], float)
    true = (lambda d: np.sqrt(d)) if metric == "l2" else (lambda d: d)

    def home(it):
        for pdf in it:
            d = true(distances(metric, np.stack(pdf["vector"].to_numpy()).astype(float), centers)) if len(pdf) else np.zeros((0, m))
            d = np.where(np.isnan(d), np.inf, d)
            yield pdf.assign(cell=d.argmin(axis=1).astype(np.int32), far=d.min(axis=1)) if len(pdf) else pdf.assign(cell=np.zeros(0, np.int32), far=np.zeros(0))

    celled = refs.select("ref_id", "vector", "label").mapInPandas(home, "ref_id long, vector array<double>, label string, cell int, far double")
    celled = materialize(celled.where(F.col("far") < float("inf")), "cells")
    stats = {r["cell"]: (r["far"], r["n"]) for r in celled.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radius = np.array([stats.get(i, (-np.inf, 0))[0] for i in range(m)])
    count = np.array([stats.get(i, (0, 0))[1] for i in range(m)])
    need = k + int(skip_self)

    def probe(it):
        for pdf in it:
            if not len(pdf):
                continue
            d = true(distances(metric, np.stack(pdf["vector"].to_numpy()).astype(float), centers))
            # All of a cell lies within d + radius: the cells that reach k rows first bound the k-th distance.
            order = np.argsort(d + radius, axis=1)
            reach = np.cumsum(count[order], axis=1) >= need
            first = np.where(reach.any(axis=1), reach.argmax(axis=1), m - 1)
            bound = np.where(reach.any(axis=1), np.take_along_axis(d + radius, np.take_along_axis(order, first[:, None], 1), 1)[:, 0], np.inf)
            row, cell = np.nonzero((d - radius <= bound[:, None] * (1 + 1e-12) + 1e-12) & (count > 0))
            yield pd.DataFrame({"idx": pdf["idx"].to_numpy()[row], "vector": pdf["vector"].to_numpy()[row], "cell": cell.astype(np.int32)})

    asked = queries.select("idx", "vector").mapInPandas(probe, "idx long, vector array<double>, cell int")
    return _blocks(asked, celled.drop("far"), k, metric, skip_self, ["cell"])


def _cells(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, cells: int, probes: int, seed: int) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    refs = materialize(refs, "refs")
    n = refs.count()
    cells = max(1, min(cells, n // 2))
    sample = refs.sample(min(1.0, 50_000 / max(1, n)), seed).select(array_to_vector("vector").alias("features"))
    centers = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample).clusterCenters())

    def near(many: int):
        def run(it):
            for pdf in it:
                if len(pdf):
                    d = distances("l2", np.stack(pdf["vector"].to_numpy()).astype(float), centers)
                    yield pdf.assign(cell=list(np.argsort(d, axis=1, kind="stable")[:, :many].astype(np.int32)))

        return run

    r = refs.select("ref_id", "vector", "label").mapInPandas(near(1), "ref_id long, vector array<double>, label string, cell array<int>").withColumn("cell", F.get("cell", F.lit(0)))
    r = materialize(r, "cells")
    m = queries.count()
    # The place of a true neighbor's cell in its query's order of cells is the number of probes that finds it.
    some = queries.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(CALIBRATE)
    true = ranked(_blocks(some, refs, k, metric, skip_self, None, n, min(m, CALIBRATE)), k)
    order = some.mapInPandas(near(len(centers)), "idx long, vector array<double>, cell array<int>").select("idx", F.col("cell").alias("cells"))
    place = true.join(r.select("ref_id", "cell"), "ref_id").join(order, "idx").select(F.array_position("cells", F.col("cell")).alias("p"))
    places = np.sort([x["p"] for x in place.collect()])
    if len(places):
        probes = max(probes, int(places[math.ceil(RECALL * len(places)) - 1]))
    q = queries.select("idx", "vector").mapInPandas(near(min(probes, len(centers))), "idx long, vector array<double>, cell array<int>").withColumn("cell", F.explode("cell"))
    return _blocks(q, r, k, metric, skip_self, ["cell"])


def _hashes(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, width: float, tables: int, seed: int) -> DataFrame:
    """Each bucket of each table is searched by blocks that keep k candidates a query, so pairs are never written; what two tables find is one row.

    Buckets are `width` wide or, doubled as often as needed, so wide that CALIBRATE queries find RECALL of their true neighbors.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    features = lambda df, i: df.select(i, "vector", *(["label"] if i == "ref_id" else []), array_to_vector("vector").alias("features"))
    some = materialize(queries.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(CALIBRATE), "some")
    true = materialize(ranked(_blocks(some, refs, k, metric, skip_self), k).join(refs.select("ref_id", "vector"), "ref_id").join(some.select("idx", F.col("vector").alias("qv")), "idx"), "true")

    def model(width: float):
        return BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(features(some, "idx"))

    def hashed(m, df: DataFrame, i: str) -> DataFrame:
        return m.transform(features(df, i)).select(*df.columns, F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("long")).alias("hashes"))

    def share(m) -> float:
        """Of the true pairs, those that share a bucket."""
        q = hashed(m, true.select("idx", F.col("qv").alias("vector")).distinct(), "idx").select("idx", F.col("hashes").alias("qh"))
        r = m.transform(true.select("idx", "ref_id", array_to_vector("vector").alias("features"))).select("idx", "ref_id", F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)).cast("long")).alias("rh"))
        hit = F.exists(F.zip_with("qh", "rh", lambda a, b: a == b), lambda x: x)
        return r.join(q, "idx").agg(F.coalesce(F.avg(hit.cast("double")), F.lit(1.0))).first()[0]

    for _ in range(12):
        m = model(width)
        if share(m) >= RECALL:
            break
        width *= 2
    q, r = (hashed(m, df, i).select(*df.columns, F.posexplode("hashes").alias("t", "h")) for df, i in ((queries, "idx"), (refs, "ref_id")))
    found = _blocks_within(q, r, k, metric, skip_self, ["t", "h"])
    return found.groupBy("idx", "ref_id").agg(F.first("label").alias("label"), F.first("distance").alias("distance"))


def _graph(queries: DataFrame, refs: DataFrame, k: int, metric: str, skip_self: bool, links: int, width: int) -> DataFrame:
    """A block's references are inserted one by one, each linked both ways to its nearest found so far."""

    def walk(x: np.ndarray, edges: list[list[int]], y: np.ndarray, many: int) -> list[tuple[float, int]]:
        one = lambda js: distances(metric, y[None], x[js])[0]
        seen, found = {0}, [(float(one([0])[0]), 0)]
        todo = list(found)
        while todo:
            todo.sort()
            d, i = todo.pop(0)
            if len(found) >= many and d > found[-1][0]:
                break
            new = [j for j in edges[i] if j not in seen]
            seen.update(new)
            if new:
                got = list(zip(one(new).tolist(), new, strict=True))
                found = sorted(found + got)[:many]
                todo += [g for g in got if g in found]
        return found

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("ref_id", kind="stable")
            x, ids, labels = np.stack(r["vector"].to_numpy()).astype(float), r["ref_id"].to_numpy(), r["label"].to_numpy()
            edges: list[list[int]] = [[]]
            for i in range(1, len(x)):
                near = [j for _, j in walk(x, edges, x[i], links)]
                edges.append(near[:])
                for j in near:
                    edges[j].append(i)
            for idx, v in zip(q["idx"], q["vector"], strict=True):
                found = [(d, int(ids[j]), labels[j]) for d, j in walk(x, edges, np.asarray(v, float), width) if not (skip_self and ids[j] == idx)]
                out += [(idx, i, label, d) for d, i, label in sorted(found, key=lambda f: f[:2])[:k]]
        return pd.DataFrame(out, columns=["idx", "ref_id", "label", "distance"]).astype({"idx": np.int64, "ref_id": np.int64, "distance": float})

    rb, qb = max(1, -(-refs.count() // 4_096)), max(1, -(-queries.count() // _GRAPH_QUERIES))
    q = queries.select("idx", "vector", F.pmod(F.xxhash64("idx"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    r = refs.select("ref_id", "vector", "label", F.pmod(F.xxhash64("ref_id"), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(run, SCHEMA)


def knn(queries: DataFrame, refs: DataFrame, k: int = NEIGHBORS, metric: str = "l2", plan: str = "auto", skip_self: bool = False, **how) -> DataFrame:
    """idx, ref_id, label, distance, rank. queries: idx, vector; refs: ref_id, vector, label.

    skip_self: a reference whose ref_id is the query's idx isn't its neighbor. plan `auto` is `blocks`.
    """
    q = queries.select(F.col("idx").cast("long").alias("idx"), F.col("vector").cast("array<double>").alias("vector"))
    r = refs.select(F.col("ref_id").cast("long").alias("ref_id"), F.col("vector").cast("array<double>").alias("vector"), "label")
    if plan in ("auto", "blocks"):
        found = _blocks(q, r, k, metric, skip_self)
    elif plan == "join":
        found = _join(q, r, k, metric, skip_self)
    elif plan == "buckets":
        found = _boxes(q, r, k, metric, skip_self)
    elif plan == "pivots":
        found = _pivots(q, r, k, metric, skip_self, how.get("pivots", 64), how.get("seed", 1))
    elif plan == "cells":
        found = _cells(q, r, k, metric, skip_self, how.get("cells", 16), how.get("probes", 4), how.get("seed", 1))
    elif plan == "hashes":
        found = _hashes(q, r, k, metric, skip_self, how.get("width", 1.0), how.get("tables", 4), how.get("seed", 1))
    elif plan == "graph":
        found = _graph(q, r, k, metric, skip_self, how.get("links", 12), how.get("breadth", 64))
    else:
        raise ValueError(f"no such plan: {plan}")
    return ranked(found, k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth's (idx, ref_id) that found has."""
    hit = truth.select("idx", "ref_id").join(found.select("idx", "ref_id", F.lit(1).alias("hit")), ["idx", "ref_id"], "left")
    return hit.agg(F.coalesce(F.try_divide(F.count("hit"), F.count(F.lit(1))), F.lit(1.0))).first()[0]


def measured(found: DataFrame, queries: DataFrame, refs: DataFrame, k: int = NEIGHBORS, metric: str = "l2", skip_self: bool = False, seed: int = 1) -> DataFrame:
    """found with `recall`: the share of the true neighbors of CALIBRATE queries, drawn by hash, that it has."""
    found = materialize(found, "found")
    some = queries.orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(CALIBRATE)
    return found.withColumn("recall", F.lit(float(recall(found, knn(some, refs, k, metric, skip_self=skip_self)))))


def edit_neighbors(words: DataFrame, others: DataFrame, most: int = 1) -> DataFrame:
    """word, other, distance for words (word) and others (other) within `most` edits (1 at most): an integer metric.

    Words within one edit share themselves or a form with one character deleted, so an equi-join on those
    forms finds them all; the exact distance decides.
    """
    if most not in (0, 1):
        raise ValueError("up to one edit")
    forms = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))))
    a = words.select("word").distinct().withColumn("form", F.explode(forms(F.col("word"))))
    b = others.select("other").distinct().withColumn("form", F.explode(forms(F.col("other"))))
    near = a.join(b, "form").select("word", "other").distinct()
    return near.withColumn("distance", F.levenshtein("word", "other")).where(F.col("distance") <= most)
