"""Connected components of a link table, by large-star and small-star turns, or of few links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, root of all the links (u, v) together."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], ["node", "root"])


def components(links: DataFrame, most_turns: int = 60, few: int = 0) -> DataFrame:
    """node, root (the smallest node of its component) for every node of links (a, b: long).

    Each turn is two aggregates by node (combined before the shuffle) and two joins, which
    Spark splits where a node has very many links; nothing is collected. Up to `few` different
    links are joined in one task instead: turns of small tables are many plans, which the driver's
    memory keeps, and little work.
    """
    e = F.col
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if few and edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_joined, "node long, root long")
    seen = None
    for _ in range(most_turns):
        # Large star: each node's larger neighbours link to its smallest neighbour, or itself.
        both = edges.unionByName(edges.select(e("v").alias("u"), e("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(e("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, e("u") == e("w")).where(e("v") > e("u")).select(e("v").alias("u"), e("m").alias("v"))
        large = materialize(large.distinct(), "large")
        # Small star: each node and its smaller neighbours link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(e("u").alias("w"), "m")
        small = large.join(least, e("u") == e("w"))
        edges = small.where(e("v") > e("m")).select(e("v").alias("u"), e("m").alias("v")).unionByName(least.select(e("w").alias("u"), e("m").alias("v"))).distinct()
        edges = materialize(edges, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"the components did not settle in {most_turns} turns")
    roots = edges.select(e("u").alias("node"), e("v").alias("root"))
    return roots.unionByName(edges.select(e("v").alias("node"), e("v").alias("root")).distinct())
