"""Vector bin packing of examples into training sequences.

Every item is a vector (tokens, segments, loss-bearing tokens); a sequence is a bin with a
limit on each. One bin is open at a time. Among the item classes that still fit, the next is
the one whose vector has the largest weighted dot product with the bin's free room; each
dimension is weighed by how scarce it is (total demand over the bin's limit). Items are dealt
into groups of about GROUP by the number of their row, and groups are packed apart from each
other; only a group's last bins stay unfilled, so padding falls with the group size.

Documents are cut every `capacity` tokens; a full piece is a sequence by itself and is moved
no further, and the rest of each document is packed. Conversations are packed whole up to the
limits, one over a limit alone; only assistant turns bear loss.

Null text is an empty document (its end id alone). The string of the vocabulary's special token
becomes that token's id, as the tokenizer has it. Very long texts become many full pieces and
one rest. Repeated rows are packed each on their own, equal items in any order; rows are dealt
by number, so equal ones make no large group. Ties between equally good items go to the
smaller vector. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY, SEGMENTS = 1024, 256
#: Limits of sequences of conversations: tokens, segments, loss-bearing tokens.
CONVERSATIONS = (4096, 8, 3072)
GROUP = 4096
END = 0
#: Fixed value: the vocabulary's special token and its id.
SPECIAL = {"<|endoftext|>": 50_256}


@cache
def encoder(ranks: str | None = None):
    """The ids of byte_bpe_50k.json, from the same vocabulary as ranks: equal ids, three times as fast."""
    import public_tokenizers as public
    import tiktoken

    with open(ranks or public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens=SPECIAL)


def ids_of(text: str | None, ranks: str | None = None) -> np.ndarray:
    """The document's ids (little-endian uint32), its end id last."""
    return np.append(encoder(ranks).encode_to_numpy(text or "", allowed_special="all"), END).astype("<u4")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document cut every `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py(), ranks)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    for col, x in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECE)


def pack(items: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each row of items (columns: tokens, segments, loss-bearing tokens).

    An item over a limit by itself gets a bin of its own.
    """
    cap = np.asarray(limits, dtype=np.float64)
    scarce = (items.sum(axis=0) / cap) / cap**2 if len(items) else cap
    classes, of = np.unique(items, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.argsort(of, kind="stable")
    left = np.bincount(of, minlength=len(classes))
    taken = np.concatenate(([0], np.cumsum(left)))[:-1]  # where in `order` the next item of each class is
    bins, offsets = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
    alive = np.arange(len(classes))
    vectors = classes.astype(np.float64)
    n = -1
    while len(alive):
        n, free, at = n + 1, cap.copy(), 0
        while True:
            v = vectors[alive]
            fits = (v <= free).all(axis=1)
            if at == 0 and not fits.any():
                fits[:] = True  # none fits an empty bin: each is over a limit
            if not fits.any():
                break
            score = np.where(fits, v @ (scarce * free), -1.0)
            k = int(np.argmax(score))
            c = alive[k]
            i = order[taken[c]]
            bins[i], offsets[i] = n, at
            at += int(classes[c, 0])
            free -= vectors[c]
            taken[c] += 1
            left[c] -= 1
            if not left[c]:
                alive = np.delete(alive, k)
                if not len(alive):
                    break
            if (free <= 0).any():
                break
    return bins, offsets


def pack_items(items: DataFrame, limits: tuple[int, int, int], group: int = GROUP) -> DataFrame:
    """items with sequence_id and offset added. items needs `tokens` and `loss` (int columns); each is one segment.

    items are written first: rows are dealt by their number, which must not change when a task is run again.
    """
    return _packed(materialize(items, "items"), limits, group)


def _packed(items: DataFrame, limits: tuple[int, int, int], group: int = GROUP) -> DataFrame:
    names = items.columns
    groups = max(1, -(-items.count() // group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", sequence_id long, offset long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in names if pdf[c].dtype != object], kind="stable")
        v = np.column_stack([pdf["tokens"], np.ones(len(pdf), np.int64), pdf["loss"]]).astype(np.int64)
        bins, at = pack(v, limits)
        return pdf[names].assign(sequence_id=(int(key[0]) << 32) + bins, offset=at)

    dealt = items.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, ranks: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of each row of docs.

    All ids of a piece but the first bear loss.
    """
    cut = materialize(pieces(docs, capacity, ranks), "pieces")
    rests = cut.where(F.col("length") < capacity).withColumns({"tokens": F.col("length"), "loss": F.col("length") - 1})
    full = cut.where(F.col("length") == capacity).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return full.unionByName(_packed(rests, (capacity, segments, capacity)).drop("tokens", "loss"))


def conversation_items(turns: DataFrame, ranks: str | None = None) -> DataFrame:
    """conv_id, turns, tokens, loss for each conversation; assistant turns bear loss. Null text or role: no tokens, no loss."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(ids_of(t.as_py(), ranks)) if t.is_valid else 0 for t in b.column(2)]
            loss = [x if r == "assistant" else 0 for x, r in zip(n, b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], ["conv_id", "tokens", "loss"])

    one = turns.select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(count, "conv_id long, tokens long, loss long")
    return one.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"))


def pack_conversations(turns: DataFrame, limits: tuple[int, int, int] = CONVERSATIONS, ranks: str | None = None) -> DataFrame:
    """conv_id, turns, tokens, loss, sequence_id, offset for each conversation of turns (conv_id, role, text)."""
    return pack_items(conversation_items(turns, ranks), limits)
