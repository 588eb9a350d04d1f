"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level.

A key descends from the root. At each level every child draws -ln(u)/weight from a hash of
(key, child's name) and the smallest draw wins, so a child is chosen in proportion to its
weight, and a changed weight moves keys only into or out of that child's subtree.

Law `key`: the key and the tree decide the shard. A shard that joins does so as a region of
its own: no other region's weight changes, so it takes rows only into itself.

Null keys draw like any other value (all of them land in one shard). Repeated rows land together
and get separate slots; they are counted first, so they make no large group. Ties in a shard's order
(rows alike in doc_id and text) are between equal rows. A very long text counts by its bytes and is
never moved; null text counts as no bytes. An empty table gives an empty result. Extra input columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import hold, numbered, small

RACKS, PER_RACK = 2, 4


def layout(shards: int, base: int = 24) -> list:
    """[(name, weight, [(name, weight, [(name, weight, shard)])])]: the first `base` shards in
    regions of RACKS racks of PER_RACK shards; each later one is a region of its own."""
    tree: list = []
    for s in range(shards):
        r, k = (s // (RACKS * PER_RACK), s // PER_RACK) if s < base else (s, s)
        region, rack = f"region{'' if s < base else '+'}{r}", f"rack{'' if s < base else '+'}{k}"
        if not tree or tree[-1][0] != region:
            tree.append((region, []))
        if not tree[-1][1] or tree[-1][1][-1][0] != rack:
            tree[-1][1].append((rack, []))
        tree[-1][1][-1][1].append((f"shard{s}", 1.0, s))
    racks = [(g, [(k, sum(x[1] for x in ss), ss) for k, ss in ks]) for g, ks in tree]
    return [(g, sum(k[1] for k in ks), ks) for g, ks in racks]


def _node(name: str, weight: float, below: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), below.alias("below"))


def _tree(tree: list) -> Column:
    return F.array(*[_node(g, gw, F.array(*[_node(k, kw, F.array(*[_node(s, sw, F.lit(i)) for s, sw, i in ss])) for k, kw, ss in ks])) for g, gw, ks in tree])


def _descend(key: list[Column], children: Column) -> Column:
    def draw(c: Column, i: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(*key, c["name"]), 11) + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((-F.log(u) / c["weight"]).alias("draw"), i.alias("i"))

    return F.element_at(children, F.array_min(F.transform(children, draw))["i"] + 1)["below"]


def shard_of(key: list[Column], tree: list) -> Column:
    """The shard (int) that `key` descends to."""
    return _descend(key, _descend(key, _descend(key, _tree(tree)))).cast("int")


def assign(docs: DataFrame, shards: int = 24, base: int = 24, bucket_rows: int = 100_000, least_buckets: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    Slots: each shard is cut into buckets by a second hash; rows are numbered within
    (shard, bucket), and the buckets' counts give the offsets. So no task holds a whole shard.
    """
    key = [F.col("doc_id")]
    tree, grown = layout(shards, base), layout(shards + 1, base)
    text = F.coalesce(F.col("text"), F.lit(""))
    seen = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"))
    # Held, not written: each file that is written starts processes that count the executor's memory again.
    rows = hold(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("alike")))
    known = rows.agg(F.count(F.lit(1)), F.max("alike")).first()
    buckets = max(least_buckets, -(-known[0] // (shards * bucket_rows)))
    bucket = F.pmod(F.xxhash64(*key, F.col("h")), F.lit(buckets)).cast("int")
    placed = rows.select("*", shard_of(key, tree).alias("shard"), shard_of(key, grown).alias("grown_shard"), bucket.alias("bucket"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = placed.groupBy("shard", "bucket").agg(F.sum("alike").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), zero).alias("offset"))
    within = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "h").rowsBetween(W.unboundedPreceding, -1)
    first = placed.withColumn("n", F.coalesce(F.sum("alike").over(within), zero)).join(small(offsets, shards * buckets), ["shard", "bucket"])
    first = first.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "alike", (F.col("offset") + F.col("n")).alias("first"))
    return numbered(first, "alike", "nth", known[1] or 0).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard")
