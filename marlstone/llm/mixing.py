"""Mixing sources to target weights by the cube method.

Each source gets a target number of words. A document is taken floor(r) times for certain
(r = target / source size) and once more with inclusion probability r - floor(r). The cube
method turns those probabilities into 0 or 1: in the flight phase three fractional documents
at a time move along the null space of (words, 1), so both the words and the number of
documents stay exactly balanced until one of the three settles. Chunks of a source fly
independently and leave two fractional documents each; these fly again, chunk by chunk,
until one chunk a source is left. Its flight stops at LANDING fractional documents; they are
the landing problem, and of its corners the one nearest to the balanced words is taken.

Null or blank text has size 0; a very long one is one document like others, whose size the landing
balances. A null source is a source like others, last in order. Empty tables give empty results.
Documents fly in the order of a hash of doc_id, ties (null or repeated ids) by a hash of the row, so
reruns agree. Repeated rows are counted first, then numbered and taken each on its own, so they are
dealt over the chunks like others. Extra columns, whatever their names, are kept by `mix` and ignored
by `plan`.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import fresh, materialize, n_words, numbered, small

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 4096
LANDING = 14
#: Rows alike that are numbered in one task, about.
_ALIKE = 20_000
_EPS = 1e-9


def targets(docs: DataFrame, budget: float = 1.5, weights: tuple = WEIGHTS, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target for each source of docs (source, size, alike: how many rows a row stands for).

    Sources by code point, null last, weigh `weights` in turn and share budget * all sizes;
    none gets more than most * its size, and the excess is shared again by weight.
    """
    per = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"), F.sum("alike").alias("n"))
    # One row a source. Ranking without a partition sorts in one task: rows are (name, two numbers).
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", "n", weight.alias("w")), "sources")
    cap = F.col("source_size") * F.lit(float(most))
    level, full = 0.0, -1
    total = budget * float(per.agg(F.sum("source_size")).first()[0] or 0)
    # level: words a unit of weight. Each turn fixes the sources above their cap and shares out the rest.
    while True:
        above = (F.lit(level) * F.col("w") > cap) if full >= 0 else F.lit(False)
        x = per.agg(F.sum(F.when(above, cap)).alias("fixed"), F.sum(F.when(~above, F.col("w"))).alias("w"), F.count(F.when(above, 1)).alias("full")).first()
        if x["full"] == full or not x["w"]:
            break
        full, level = x["full"], (total - (x["fixed"] or 0.0)) / x["w"]
    return per.select("source", "source_size", "n", F.least(F.lit(level) * F.col("w"), cap).alias("target"))


def fly(size: list[float], p: list[float], rng: random.Random, keep: int = 2) -> None:
    """The flight phase, in place: stops when at most max(2, keep) entries of p are fractional."""
    for i, x in enumerate(p):
        p[i] = x if _EPS < x < 1 - _EPS else float(round(x))
    waiting = [i for i, x in enumerate(p) if 0 < x < 1]
    waiting.reverse()
    active: list[int] = []
    while len(active) + len(waiting) > max(2, keep):
        while len(active) < 3:
            active.append(waiting.pop())
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        # How far the move can go either way before a probability reaches 0 or 1.
        up = min((1 - p[j]) / v if v > 0 else p[j] / -v for j, v in zip(active, u, strict=True) if v)
        down = min(p[j] / v if v > 0 else (1 - p[j]) / -v for j, v in zip(active, u, strict=True) if v)
        step = up if rng.random() * (up + down) < down else -down
        for j, v in zip(active, u, strict=True):
            p[j] += step * v
            if not _EPS < p[j] < 1 - _EPS:
                p[j] = 0.0 if p[j] < 0.5 else 1.0
        active = [j for j in active if 0 < p[j] < 1]


def land(size: list[float], p: list[float]) -> None:
    """The landing phase, in place: of the corners of what is left, the one nearest to the balanced words, then count."""
    left = [i for i, x in enumerate(p) if 0 < x < 1]
    corners = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    s, q = np.asarray([size[i] for i in left], float), np.asarray([p[i] for i in left], float)
    off_words, off_count = np.abs(corners @ s - s @ q), np.abs(corners.sum(axis=1) - q.sum())
    best = np.lexsort((off_count, off_words))[0]
    for i, x in zip(left, corners[best].tolist(), strict=True):
        p[i] = float(x)


def _flight(seed: int, turn: int, last: bool):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "row", "nth"], kind="stable")
        size, p = pdf["size"].astype(float).tolist(), pdf["p"].tolist()
        fly(size, p, random.Random(f"{seed}:{turn}:{key[0]}:{int(key[1])}"), LANDING if last else 2)
        if last:
            land(size, p)
        return pdf.assign(p=p, chunk=pdf["chunk"] // (CHUNK // LANDING))

    return run


def plan(docs: DataFrame, budget: float = 1.5, weights: tuple = WEIGHTS, most: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, row for every row of docs (doc_id, text, source).

    `row` is equal for rows alike in doc_id, text and source; `mix` joins on it.
    """
    seen = docs.select(_row(docs).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    rows = materialize(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("alike")), "sizes")
    per = materialize(targets(rows, budget, weights, most), "targets")
    known = per.agg(F.count(F.lit(1)), F.max("n")).first()
    r = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    state = (
        numbered(rows, "alike", "nth", rows.agg(F.max("alike")).first()[0] or 0)
        .withColumnRenamed("source", "_s")
        .join(small(per, known[0]), F.col("_s").eqNullSafe(F.col("source")))
        .select("row", "nth", "doc_id", "source", "size", "h", "source_size", "target", F.floor(r).cast("int").alias("base"), (r - F.floor(r)).alias("p"), F.pmod(F.xxhash64("h", "row", "nth"), chunks).alias("chunk"))
    )
    schema = T.StructType([*state.schema.fields])
    settled, left, turn = None, -(-(known[1] or 1) // CHUNK), 0
    while True:
        last = left <= 1
        state = materialize(state.groupBy("source", "chunk").applyInPandas(_flight(seed, turn, last), schema), "flight")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        settled = state.where(whole) if settled is None else settled.unionByName(state.where(whole))
        if last:
            break
        state, left, turn = state.where(~whole), -(-left // (CHUNK // LANDING)), turn + 1
    copies = F.col("base") + F.col("p").cast("int")
    return settled.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), "row")


def _row(docs: DataFrame) -> Column:
    return F.xxhash64("doc_id", "text", "source")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row of docs as often as the plan takes it, columns as they were.

    Rows alike in doc_id, text and source share `row`; their copies are summed and shared out among them.
    """
    row, chosen_row, copies, alike, nth, part, before, t = fresh(docs, "row", "chosen", "copies", "alike", "nth", "part", "before", "t")
    own = [F.col(f"`{c}`") for c in docs.columns]
    chosen = plan(docs, **how).groupBy("row").agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(alike)).withColumnRenamed("row", chosen_row)
    chosen = materialize(chosen, "chosen")
    keyed = docs.select(*own, _row(docs).alias(row))
    on = F.col(row) == F.col(chosen_row)
    times = lambda df, n: df.select(*own, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias(t)).select(*own)
    # The narrow side is hashed, so texts are not sorted.
    once = keyed.join(chosen.where(F.col(alike) == 1).where(F.col(copies) > 0).hint("shuffle_hash"), on)
    out = times(once, F.col(copies))
    again = chosen.where(F.col(alike) > 1)
    seen = again.agg(F.count(F.lit(1)), F.max(alike)).first()
    if not seen[0]:
        return out
    # Rows alike are numbered in parts of a group, so that a large one is in no single task.
    parts = -(-seen[1] // _ALIKE)
    few = materialize(keyed.join(small(again, seen[0]), on).withColumn(part, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), "alike")
    ahead = W.partitionBy(row).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    offsets = few.groupBy(row, part).count().select(row, part, F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias(before))
    number = F.row_number().over(W.partitionBy(row, part).orderBy(F.lit(0))) + F.col(before)
    ranked = few.join(offsets, [row, part]).withColumn(nth, number)
    share = F.floor(F.col(copies) / F.col(alike)) + F.when(F.col(nth) <= F.col(copies) % F.col(alike), 1).otherwise(0)
    return out.unionByName(times(ranked.withColumn(copies, share).where(F.col(copies) > 0), F.col(copies)))
