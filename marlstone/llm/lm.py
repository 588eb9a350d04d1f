"""LM scoring with a small causal self-attention model over subword ids, in numpy.

Text becomes words (ASCII letters lower-cased, runs of anything but ASCII white space) joined by
blanks, then byte-level BPE ids and an end id. The model predicts an id in two steps: its class
by one causal attention layer over the last SPAN ids, and the id within its class by how often
the training words of the whole corpus yield it, after the id before it in the word where both
are among the PAIRED most frequent ids (Witten-Bell). Classes group ids in similar company.
Scoring runs over overlapping windows of SPAN ids: the last STRIDE positions of a window are
scored, the first ones are context, so each id is scored once, in large masked batches.

A word's probability is a mixture of the model's, the product over its ids, and the base's (BASE_SHARE),
which is what keeps the model ahead where there is little to learn from.

The model also remembers all training documents: a block of BLOCK words is written as above, or copied
as the training corpus goes on after the block before it (Witten-Bell, from counts of every block). A
training document's own occurrence is left out of the counts it is scored by. So text that occurs again
somewhere is scored apart from text that doesn't, which has the model's probability alone.

What comes from the corpus: counts of all training words and blocks (shuffles), the ids' counts derived
from the words', the classes from counts of neighboring ids over all training documents, and the weights
from every training document. The driver only starts the weights, on about LEAST_DOCS * WINDOWS windows;
if there are more, the executors go on over all documents in ROUNDS rounds, each document in one of them,
each task on its own, and the tasks' weights are averaged after each round.

The base score needs every word's count. At most FREQUENT words, the most frequent down to a
power of two, go to the executors; the others' occurrences are joined with the counts by word
and summed by document, so no dictionary grows with the corpus.

Null text is empty: its end is its only token. Rows with a null doc_id are held out. Repeated
rows are scored each. Very long texts are scored in pieces of windows. Without a training
document every token has base probability 1, and the model is uniform. Empty tables give empty
results. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sized
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written
from .common import hold, materialize
from .packing import encoder

LEAST_DOCS, WINDOWS = 1500, 40
SHARE, ROUNDS = 64, 4
#: Ids of a document that are kept in a row, after LEAD ids before them; of a batch in training.
_PIECE, _BATCH = 1 << 13, 1 << 13
#: A task of a round has about as many windows at least, or it could hardly move the weights.
_TASK = 4096
FREQUENT = 200_000
#: The base's part of a word's probability; words in a remembered block.
BASE_SHARE, BLOCK = 0.3, 32
STRIDE = 16
SPAN = 2 * STRIDE
LEAD = STRIDE + 1
VOCAB, END, PAD = 50_258, 50_256, 50_257
DIM, CLASSES, OWN, PAIRED = 24, 96, 3000, 3072
_FLUSH = 1_000_000
_AT_ONCE = 1 << 12
#: Ids whose gradients are made at a time, and targets whose class logits are: what a core's cache holds.
_CACHED, _PART = 1 << 12, 1 << 10
#: Attention scores and class logits are kept within this, so that no maximum has to be taken off.
_BOUND = np.float32(30)


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower and bytes.split know ASCII only: A-Z, and white space 0x20 and 0x09 to 0x0D.
    return (text or "").encode("utf-8", "replace").lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all the texts, as words_of has them, as binary; 0 and where each text's words end among them)."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = found.values, found.offsets.to_numpy().astype(np.int64)
    # White space at an edge of a text, and an empty text, make an empty word.
    real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        words, ends = words.filter(pa.array(real)), np.concatenate(([0], np.cumsum(real)))[ends]
    return words.cast(pa.binary()), ends


#: White space that is part of words, but that the tokenizer could take together with the blanks between them.
_ODD = regex.compile(r"[^\S ]")


def _encode(text: str) -> np.ndarray:
    # The special token's string is a word like others here.
    return encoder().encode_to_numpy(text, disallowed_special=())


def by_word(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all the words, each with a blank before it; how many are each word's)."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = " " + b" ".join(words).decode("utf-8", "replace")
    if not _ODD.search(text):
        ids = _encode(text).astype(np.int64)
        # No word holds a blank, so each id that begins with one begins the next word.
        first = np.flatnonzero(_begins()[ids])
        if len(first) == len(words):
            return ids, np.diff(first, append=len(ids))
    each = [_encode(" " + w.decode("utf-8", "replace")).astype(np.int64) for w in words]
    return np.concatenate(each), np.array([len(e) for e in each])


def ids_of(words: list[bytes]) -> np.ndarray:
    """The ids of the words, without the end."""
    return by_word(words)[0]


class Lexicon:
    """The frequent words' ids and base probabilities, so that only other words are tokenized."""

    def __init__(self, words: list[bytes], logp: np.ndarray):
        self.words = pa.array(words, pa.binary())
        self.logp = np.append(logp, -np.inf)
        ids, size = by_word(words)
        self.ids = ids.astype(np.uint16)
        self.size, self.start = np.append(size, 0).astype(np.int32), np.append(np.cumsum(size) - size, 0).astype(np.int32)

    @property
    def number(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def find(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 if it isn't known here."""
        return pc.index_in(words, self.words).fill_null(-1).to_numpy()

    def read(self, texts: list[list[bytes]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[list[bytes]]]:
        """(each text's ids; of all the texts' words: how many ids, base log10 probability (-inf: not known here); each text's words not known here)."""
        words = pa.array([w for t in texts for w in t], pa.binary())
        return self._read(words, np.cumsum([0, *map(len, texts)]), self.find(words))

    def read_column(self, texts: pa.Array, step: int = 128) -> Iterator[tuple]:
        """(words, ends as split() has them, and what read() returns) of so many of the texts after another."""
        words, ends = split(texts)
        which = self.find(words)  # at once: the words here are hashed for each call
        for lo in range(0, len(texts), step):
            at = ends[lo : lo + step + 1]
            some = words[at[0] : at[-1]]
            yield some, at - at[0], *self._read(some, at - at[0], which[at[0] : at[-1]])

    def _read(self, words: pa.Array, ends: np.ndarray, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, list[list[bytes]]]:
        new = np.flatnonzero(which < 0)
        others = words.take(pa.array(new)).to_pylist()
        ids, size = by_word(others)
        length, start = self.size[which], self.start[which]
        length[new], start[new] = size, len(self.ids) + np.cumsum(size) - size
        end = np.concatenate(([0], np.cumsum(length)))
        # An id's place among those of the words here and the others: its word's, and how far it is from its word's first.
        flat = np.concatenate((self.ids, ids.astype(np.uint16))).take(np.repeat(start - end[:-1], length) + np.arange(end[-1]))
        part = np.searchsorted(new, ends)
        return np.split(flat, end[ends[1:-1]]) if len(ends) > 1 else [], length, self.logp[which], [others[a:b] for a, b in zip(part[:-1], part[1:], strict=True)]


def mixed(texts: list[Sized], length: np.ndarray, base: np.ndarray, lm: np.ndarray, end: float, share: float = BASE_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(log10 probability of each block of the texts, how many are each text's).

    length, base: of each word, its ids and its base log10 probability; lm: of each id, and of each text's end after them; end: the base's for it.
    """
    n = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(n)
    size = np.insert(length, ends, 1)
    word = np.add.reduceat(lm, np.cumsum(size) - size)
    known = np.insert(base, ends, end)
    both = np.logaddexp((known + math.log10(share)) * math.log(10), (word + math.log10(1 - share)) * math.log(10)) / math.log(10)
    many = np.maximum(1, -(-n // BLOCK))
    first = np.repeat(ends - n + np.arange(len(n)) - BLOCK * (np.cumsum(many) - many), many) + BLOCK * np.arange(many.sum())
    return np.add.reduceat(both, first), many


def blocks_of(words: list[bytes]) -> list[int]:
    """A hash of each block of words; the last one holds the end."""
    cut = [b" ".join(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)] or [b""]
    cut[-1] += b"\n"
    return [xxhash.xxh64_intdigest(b) - (1 << 63) for b in cut]


def blocks_of_all(words: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
    """blocks_of each text; words, ends: as split() has them."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), b" ")
    text, at = b"".join(joined.to_pylist()), np.concatenate(([0], np.cumsum(pc.binary_length(joined).to_numpy())))
    # Where each word would begin if a blank followed the last one too.
    begin = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)))
    out = []
    for a, b, lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        cut = (lo + begin[a:b:BLOCK] - begin[a]).tolist() or [lo]
        found = [xxhash.xxh64_intdigest(text[i : j - 1]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        found.append(xxhash.xxh64_intdigest(text[cut[-1] : hi] + b"\n"))
        out.append((np.array(found, np.uint64) ^ np.uint64(1 << 63)).view(np.int64))
    return out


@cache
def _starts() -> np.ndarray:
    """Whether an id can't go on with a word: it begins one, or is the end."""
    out = _begins().copy()
    out[[END, PAD]] = True
    return out


@cache
def _begins() -> np.ndarray:
    """Whether an id begins a word: whether its bytes begin with a blank."""
    e = encoder()
    return np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(END)] + [False, False])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(True))


@dataclass
class Within:
    """log10 of an id's share of its class."""

    cls: np.ndarray
    #: of each id, whatever is before it
    alone: np.ndarray
    #: of each id: its number among the paired ids, the last for all others
    number: np.ndarray
    #: paired id before x paired id: its share; paired id before x class: what the shares of all others are scaled by
    pair: np.ndarray
    scale: np.ndarray

    def log10(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = self.alone[ids]
        if not len(self.pair):
            return out
        most = len(self.pair)
        a, b = self.number[before], self.number[ids]
        # Only an id that goes on with a word depends on the one before it; what begins a word, or ends the text, doesn't.
        inner = np.flatnonzero((a < most) & ~_starts()[ids])
        a, b = a[inner], b[inner]
        known = b < most
        more = np.empty(len(inner))
        more[known] = self.pair[a[known], b[known]]
        rest = ~known
        more[rest] = out[inner[rest]] + self.scale[a[rest], self.cls[ids[inner[rest]]]]
        out[inner] = more
        return out


def within_class(cls: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None = None, paired: np.ndarray | None = None, add: float = 0.5) -> Within:
    """From the ids' counts, and the counts of `paired` ids after each other inside a word.

    Ids that begin a word and ids that go on with one share a class's mass apart, so that the
    shares of a class add up to one whatever is before; the caller's classes never mix the two.
    """
    c = counts + add
    c[PAD] = 0
    total = np.bincount(cls, weights=c)
    alone = np.log10(np.maximum(c, 1e-300) / np.maximum(total[cls], 1e-300))
    number = np.full(VOCAB, 0 if paired is None else len(paired))
    if paired is None or not len(paired):
        return Within(cls, alone, number, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    number[paired] = np.arange(len(paired))
    k = int(cls.max()) + 1
    member = np.zeros((len(paired), k), np.float32)
    member[np.arange(len(paired)), cls[paired]] = 1
    n, kinds = pairs @ member, (pairs > 0).astype(np.float32) @ member
    # Witten-Bell: as much goes to the shares without context as there are different ids after this one.
    kinds = np.maximum(kinds, 1e-3)
    share = (10.0 ** alone[paired]).astype(np.float32)
    pair = np.log10((pairs + kinds[:, cls[paired]] * share) / (n + kinds)[:, cls[paired]])
    return Within(cls, alone, number, pair.astype(np.float32), np.log10(kinds / (n + kinds)).astype(np.float32))


@dataclass
class Model:
    #: of each id: its row of E, its class
    row: np.ndarray
    cls: np.ndarray
    within: Within
    weights: dict[str, np.ndarray]

    def score(self, ids: np.ndarray) -> float:
        return float(self.each([ids]).sum())

    def each(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each of the first text's ids and its end, of the second's, and so on."""
        out = [np.zeros(0)]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < _AT_ONCE):
                size += len(texts[j]) + 1 + SPAN
                j += 1
            if size >= 4 * _AT_ONCE:
                if j - 1 > i:
                    out.append(self._some(texts[i : j - 1]))
                out += self._long(texts[j - 1])
            else:
                out.append(self._some(texts[i:j]))
            i = j
        return np.concatenate(out)

    def _some(self, texts: list[np.ndarray]) -> np.ndarray:
        # Each text: a block of PAD as context, its ids and its end, PAD up to a whole block.
        n = np.array([len(t) + 1 for t in texts])
        room = -(-n // STRIDE) * STRIDE + STRIDE
        starts = np.cumsum(room) - room
        ids = np.full(int(room.sum()), PAD, np.int64)
        for t, s in zip(texts, (starts + STRIDE).tolist(), strict=True):
            ids[s : s + len(t)] = t
            ids[s + len(t)] = END
        prev = np.concatenate(([PAD], ids[:-1]))
        prev[starts] = PAD  # not the text before
        logp = self._windows(ids, prev)  # from the second block on
        return logp[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _long(self, ids: np.ndarray) -> list[np.ndarray]:
        lead, out = STRIDE, []
        ids = np.concatenate((np.full(lead, PAD), ids, [END]))
        n = len(ids) - lead
        for lo in range(0, n, _AT_ONCE):
            m = min(_AT_ONCE, n - lo)
            some = np.concatenate((ids[lo : lo + lead + m], np.full(-m % STRIDE, PAD)))
            prev = np.concatenate(([PAD if lo == 0 else ids[lo - 1]], some[:-1]))
            out.append(self._windows(some, prev)[:m])
        return out

    def _windows(self, ids: np.ndarray, prev: np.ndarray) -> np.ndarray:
        """log10 probability of ids[STRIDE:], a multiple of STRIDE; prev: the id ahead of each.

        A window is two blocks of STRIDE inputs (each input is the id before its target): the second
        block's positions ask, both blocks answer, the future is masked. Windows are views, not copies.
        """
        w = self.weights
        r = self.row[prev]
        x = w["E"].take(r[STRIDE:], axis=0)
        blocks, d = len(ids) // STRIDE - 1, x.shape[1]
        q, k, v = (w["inputs"][i].take(r, axis=0) for i in range(3))
        s = np.matmul(q[STRIDE:].reshape(blocks, STRIDE, d), _both_turned(np.ascontiguousarray(k.T)))
        _bound(s)
        np.exp(s, out=s)
        s *= w["decay"]
        h = np.matmul(s, _both(v)).reshape(-1, d)
        h /= (s.reshape(-1, SPAN) @ np.ones(SPAN, np.float32))[:, None]
        h += x
        target = ids[STRIDE:]
        y = self.cls.take(target)
        own, total = w["c"].take(y), np.empty(len(h), np.float32)
        start = np.exp(w["c"])
        for lo in range(0, len(h), _PART):
            z = h[lo : lo + _PART] @ w["U"]
            _bound(z)
            own[lo : lo + _PART] += z.ravel().take(np.arange(0, z.size, z.shape[1]) + y[lo : lo + _PART])
            np.exp(z, out=z)
            total[lo : lo + _PART] = z @ start
        return (own.astype(np.float64) - np.log(total.astype(np.float64))) / math.log(10) + self.within.log10(prev[STRIDE:], target)


def _bound(t: np.ndarray) -> None:
    """Keeps t within _BOUND; a look is cheaper than a clip."""
    if t.size and not (t.max() <= _BOUND and t.min() >= -_BOUND):
        np.clip(t, -_BOUND, _BOUND, out=t)


def _both(t: np.ndarray) -> np.ndarray:
    """Each block of STRIDE rows behind the block before it, as views."""
    return np.lib.stride_tricks.as_strided(t, (len(t) // STRIDE - 1, SPAN, t.shape[1]), (STRIDE * t.strides[0], *t.strides))


def _both_turned(t: np.ndarray) -> np.ndarray:
    """As _both, of what has a column for each row there, turned as well: products with it are faster."""
    return np.lib.stride_tricks.as_strided(t, (t.shape[1] // STRIDE - 1, len(t), SPAN), (STRIDE * t.strides[1], *t.strides))


def _masked(rel: np.ndarray) -> np.ndarray:
    """(STRIDE x SPAN) additive scores by distance; the future is masked."""
    back = (np.arange(STRIDE)[:, None] + SPAN - STRIDE) - np.arange(SPAN)
    return np.where(back >= 0, rel[np.clip(back, 0, SPAN - 1)], -1e9).astype(np.float32)


def _grouped(f: np.ndarray, weight: np.ndarray, groups: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means of the rows of f."""
    c = f[rng.choice(len(f), min(groups, len(f)), replace=False, p=weight / weight.sum())]
    for _ in range(10):
        near = np.argmax(f @ c.T, axis=1)
        for g in range(len(c)):
            if (m := near == g).any():
                c[g] = weight[m] @ f[m]
                c[g] /= np.linalg.norm(c[g]) + 1e-6
    return near


def _keys(before: np.ndarray, here: np.ndarray, column: np.ndarray) -> np.ndarray:
    """id * 512 + column of the id before it, and 256 + column of the id after it, of each target."""
    return np.concatenate((here * 512 + column[before], before * 512 + 256 + column[here]))


def _pair_keys(windows: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a key of _keys, how often) of the windows' targets."""
    keys = _keys(windows[:, -STRIDE - 1 : -1].ravel(), windows[:, -STRIDE:].ravel(), column)
    return _summed(keys, np.ones(len(keys), np.int64))


def _columns(seen: np.ndarray) -> np.ndarray:
    """Of each id: its rank if it's among the 255 most frequent, else 255."""
    column = np.full(VOCAB, 255)
    column[np.lexsort((np.arange(VOCAB), -seen))[:255]] = np.arange(255)
    return column


def _seen(windows: np.ndarray) -> np.ndarray:
    seen = np.bincount(windows[:, -STRIDE:].ravel(), minlength=VOCAB)
    seen[PAD] = 0
    return seen


def classify(seen: np.ndarray, keys: np.ndarray, n: np.ndarray, classes: int = CLASSES, own: int | None = None, seed: int = 1) -> np.ndarray:
    """The class of each id: the most frequent ids have one each, the others are grouped by what they follow.

    seen: how often each id is a target; keys, n: as _pair_keys counts them.
    """
    own = classes // 2 if own is None else own
    rng = np.random.default_rng(seed)
    order = np.lexsort((np.arange(VOCAB), -seen))
    # The last two classes are for ids that the windows don't show: those that begin a word, and the others.
    cls = np.where(_starts(), classes - 1, classes - 2)
    alone = order[:own][seen[order[:own]] > 0]
    cls[alone] = np.arange(len(alone))
    rest = order[own:][seen[order[own:]] > 0]
    groups = (classes - own - 2) // 2
    if len(rest) and groups > 0:
        at = np.full(VOCAB, -1)
        at[rest] = np.arange(len(rest))
        row = at[keys // 512]
        f = np.zeros((len(rest), 512), np.float32)
        f[row[row >= 0], (keys % 512)[row >= 0]] = n[row >= 0]
        np.sqrt(f, out=f)
        f /= np.linalg.norm(f, axis=1, keepdims=True) + 1e-6
        weight = np.sqrt(seen[rest]).astype(np.float32)
        for half, side in enumerate((_starts()[rest], ~_starts()[rest])):
            if side.any():
                cls[rest[side]] = own + half * groups + _grouped(f[side], weight[side], groups, rng)
    return np.unique(cls, return_inverse=True)[1].ravel()  # no class without ids: it would hold probability


def _lines(pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, the id before each, which are targets) of pieces of LEAD ids and the targets after them, in whole blocks."""
    n = np.array([len(x) - LEAD for x in pieces])
    room = STRIDE + -(-n // STRIDE) * STRIDE
    starts = np.cumsum(room) - room
    ids, prev = np.full(int(room.sum()), PAD, np.int64), np.full(int(room.sum()), PAD, np.int64)
    asked = np.zeros(len(ids), bool)
    for x, s, m in zip(pieces, starts.tolist(), n.tolist(), strict=True):
        ids[s : s + STRIDE + m], prev[s : s + STRIDE + m] = x[1:], x[:-1]
        asked[s + STRIDE : s + STRIDE + m] = True
    return ids, prev, asked & (ids != PAD)


def _batches(pieces: list[np.ndarray], most: int | None = None) -> Iterator[list[np.ndarray]]:
    """The pieces, about _BATCH ids at a time, or `most`."""
    some, size, most = [], 0, most or _BATCH
    for x in pieces:
        some.append(x)
        size += len(x)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def _cut(pieces: list[np.ndarray], size: int) -> Iterator[np.ndarray]:
    """The same targets behind the same ids, in pieces of at most `size` targets, a multiple of STRIDE."""
    for x in pieces:
        for lo in range(0, len(x) - LEAD, size):
            yield x[lo : lo + LEAD + size]


def _add_gradients(g: dict[str, np.ndarray], p: dict[str, np.ndarray], row: np.ndarray, cls: np.ndarray, pieces: list[np.ndarray], most: int) -> int:
    """Adds to g the gradients of the pieces' loss over `most`; how many targets there were.

    As in Model._windows, a window is two blocks, of which the second asks; keys and values are made once for both
    windows that a block is in. V and O act as their product, whose gradient yields theirs. What scales a row or a
    column (attention's and classes' sums, c) is applied to the narrow side of a product.
    """
    ids, prev, asked = _lines(pieces)
    blocks, at = len(ids) // STRIDE - 1, np.flatnonzero(asked[STRIDE:])
    r, y, n = row[prev], cls[ids[STRIDE:][at]], np.float32(1 / most)
    (d, classes), scale = p["U"].shape, np.float32(p["U"].shape[0] ** -0.5)
    wq, wv = p["Q"] * scale, p["V"] @ p["O"]
    x = p["E"].take(r, axis=0)
    q, k, v = (x[STRIDE:] @ wq).reshape(blocks, STRIDE, d), x @ p["K"], x @ wv
    a = np.matmul(q, _both_turned(np.ascontiguousarray(k.T)))
    _bound(a)
    np.exp(a, out=a)
    a *= np.exp(_masked(p["rel"]))
    part = 1 / (a.reshape(-1, SPAN) @ np.ones(SPAN, np.float32))[:, None]
    o = np.matmul(a, _both(v)).reshape(-1, d)
    o *= part
    h = (x[STRIDE:] + o).take(at, axis=0)
    # The classes and, backwards, the gradients of U and c, while the logits are in the cache. The last row of dh is for what isn't asked.
    start, gu, gc, dh = np.exp(p["c"]), np.zeros_like(p["U"]), np.zeros_like(p["c"]), np.zeros((len(at) + 1, d), np.float32)
    u = (p["U"] * start).T
    for lo in range(0, len(at), _PART):
        some, here = h[lo : lo + _PART], y[lo : lo + _PART]
        z = some @ p["U"]
        _bound(z)
        np.exp(z, out=z)
        total = z @ start
        z.ravel()[np.arange(0, z.size, classes) + here] -= total / start.take(here)
        total = n / total
        gu += (some * total[:, None]).T @ z
        gc += total @ z
        np.multiply(z @ u, total[:, None], out=dh[lo : lo + len(some)])
    g["U"] += gu * start
    g["c"] += gc * start
    place = np.full(len(o), len(at))
    place[at] = np.arange(len(at))
    dh = dh.take(place, axis=0)
    do = dh * part
    ds = np.matmul(do.reshape(blocks, STRIDE, d), _both_turned(np.ascontiguousarray(v.T)))
    ds -= np.einsum("ij,ij->i", do, o).reshape(blocks, STRIDE, 1)
    ds *= a
    summed = (np.ones(blocks, np.float32) @ ds.reshape(blocks, -1)).reshape(STRIDE, SPAN)
    back = (np.arange(STRIDE)[:, None] + SPAN - STRIDE) - np.arange(SPAN)
    g["rel"] += np.bincount(np.clip(back, 0, None).ravel(), weights=np.where(back >= 0, summed, 0).ravel(), minlength=SPAN).astype(np.float32)
    dq = np.matmul(ds, _both(k)).reshape(-1, d)
    dk, dv = (_met(np.matmul(t.transpose(0, 2, 1), by)) for t, by in ((ds, q), (a, do.reshape(blocks, STRIDE, d))))
    gv = x.T @ dv
    for name, t in (("Q", (x[STRIDE:].T @ dq) * scale), ("K", x.T @ dk), ("V", gv @ p["O"].T), ("O", p["V"].T @ gv)):
        g[name] += t
    dx = dk @ p["K"].T
    dx += dv @ wv.T
    dx[STRIDE:] += dq @ wq.T
    dx[STRIDE:] += dh
    # Numbers of 16 bits are sorted by their digits.
    order = np.argsort(r.astype(np.uint16 if len(p["E"]) <= 1 << 16 else np.int32), kind="stable")
    rows = r.take(order)
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    g["E"][rows[first]] += np.add.reduceat(dx.take(order, axis=0), first, axis=0)
    return len(at)


def _train(p: dict[str, np.ndarray], row: np.ndarray, cls: np.ndarray, batches: Iterator[list[np.ndarray]], rate: Callable[[int], float]) -> int:
    """Changes the parameters p by a step for each batch of pieces; how many targets there were."""
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = done = 0
    for pieces in batches:
        g = {k: np.zeros_like(v) for k, v in p.items()}
        most = max(1, sum(np.count_nonzero(x[LEAD:] != PAD) for x in pieces))
        # In parts that the cache holds; the step is the same.
        for some in _batches(_cut(pieces, _CACHED), _CACHED):
            done += _add_gradients(g, p, row, cls, some, most)
        step += 1
        lr = rate(step)
        for name, grad in g.items():
            mean, square = m1[name], m2[name]
            mean *= np.float32(0.9)
            mean += np.float32(0.1) * grad
            grad = grad * grad
            grad *= np.float32(0.01)
            square *= np.float32(0.99)
            square += grad
            np.sqrt(square, out=grad)
            grad *= np.float32((1 - 0.99**step) ** -0.5)
            grad += np.float32(1e-8)
            np.divide(mean, grad, out=grad)
            grad *= np.float32(lr / (1 - 0.9**step))
            p[name] -= grad
    return done


def _met(t: np.ndarray) -> np.ndarray:
    """Of rows for each of _both: their sums for each row."""
    blocks, d = len(t), t.shape[2]
    t = t.reshape(blocks, 2, STRIDE * d)
    out = np.empty((blocks + 1, STRIDE * d), t.dtype)
    out[0], out[-1] = t[0, 0], t[-1, 1]
    np.add(t[:-1, 1], t[1:, 0], out=out[1:-1])
    return out.reshape(-1, d)


def fit(windows: np.ndarray, counts: np.ndarray, pairs: np.ndarray | None = None, paired: np.ndarray | None = None, dim: int = DIM, classes: int = CLASSES, own_rows: int = OWN, epochs: int = 12, least_steps: int = 1000, batch: int = 64, rate: float = 4e-3, seed: int = 1, stats: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, go_on: Callable[..., None] | None = None) -> Model:
    """A model from windows (rows of SPAN + 1 ids, the last STRIDE are targets) and the ids' counts.

    stats: what `classify` takes, of more windows than these; go_on(p, row, cls) trains p further.
    """
    if not len(windows):
        zero = {k: np.zeros((1, 1), np.float32) for k in "EQKVOU"} | {"c": np.zeros(1, np.float32), "rel": np.zeros(SPAN, np.float32)}
        cls = np.zeros(VOCAB, np.int64)
        return _model(np.zeros(VOCAB, np.int64), cls, within_class(cls, counts.astype(float)), zero)
    rng = np.random.default_rng(seed)
    if stats is None:
        seen = _seen(windows)
        stats = (seen, *_pair_keys(windows, _columns(seen)))
    seen = stats[0]
    cls = classify(*stats, classes)
    classes = int(cls.max()) + 1
    order = np.lexsort((np.arange(VOCAB), -seen))[:own_rows]
    row = own_rows + cls
    row[order] = np.arange(own_rows)
    f32 = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
    p = {"E": f32(own_rows + classes, dim, scale=0.3), "Q": f32(dim, dim, scale=dim**-0.5), "K": f32(dim, dim, scale=dim**-0.5), "V": f32(dim, dim, scale=dim**-0.5), "O": f32(dim, dim, scale=0.1), "U": f32(dim, classes, scale=0.1), "c": np.zeros(classes, np.float32), "rel": np.linspace(1, -1, SPAN).astype(np.float32)}
    turn = -(-len(windows) // batch)
    # Where the executors go on over all documents, this is a start only.
    epochs = max(epochs if go_on is None else 3, -(-least_steps // turn))
    steps = epochs * turn
    some = (list(windows[chosen]) for _ in range(epochs) for chosen in np.array_split(rng.permutation(len(windows)), turn))
    _train(p, row, cls, some, lambda step: rate * min(1.0, step / 50) * (1 - 0.9 * step / steps))
    if go_on is not None:
        go_on(p, row, cls)
    return _model(row, cls, within_class(cls, counts.astype(float), pairs, paired), p)


def _model(row: np.ndarray, cls: np.ndarray, within: Within, p: dict[str, np.ndarray]) -> Model:
    """The model of trained parameters p, with what scoring reads instead of them."""
    scaled = p["Q"] * np.float32(p["Q"].shape[1] ** -0.5)
    inputs = np.stack([p["E"] @ m for m in (scaled, p["K"], p["V"] @ p["O"])])  # of each row of E: query, key, value
    bias = _masked(p["rel"])
    weights = {k: v for k, v in p.items() if k not in ("rel", "K")} | {"QKV": np.column_stack([scaled, p["K"], p["V"]]), "bias": bias, "inputs": inputs, "decay": np.exp(bias)}
    return Model(row, cls, within, weights)


def count_words(docs: DataFrame) -> DataFrame:
    """word (binary), c: how often each word occurs in docs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, 0

        def summed() -> pa.Table:
            return pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("c", "sum")]).rename_columns(["word", "c"])

        for batch in batches:
            found = split(batch.column(0))[0].value_counts()
            held.append(pa.RecordBatch.from_arrays(found.flatten(), ["word", "c"]))
            size += len(found)
            if size > max(_FLUSH, 2 * least):
                held = summed().combine_chunks().to_batches()
                size = least = sum(map(len, held))
                if least > _FLUSH:
                    yield from held
                    held, size, least = [], 0, 0
        if size:
            yield from summed().combine_chunks().to_batches()

    return docs.select("text").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def with_ids(counts: DataFrame) -> DataFrame:
    """counts (word, c) with each word's ids (uint16, two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, size = by_word(batch.column(0).to_pylist())
            ends = np.concatenate(([0], 2 * np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype(np.uint16))])], ["word", "c", "ids"])

    return counts.select("word", "c").mapInArrow(run, "word binary, c long, ids binary")


def _of_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all the words, how many are each word's) of what with_ids made."""
    size = pc.binary_length(column).to_numpy().astype(np.int64) // 2
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).astype(np.int64), size


def count_blocks(docs: DataFrame) -> DataFrame:
    """ctx (the block before; 0 for the first), block, c: how often each block follows each in docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = blocks_of_all(*split(batch.column(0)))
            block = np.concatenate([np.zeros(0, np.int64), *found])
            ctx = np.concatenate(([0], block))[:-1]
            ctx[np.cumsum([0, *map(len, found)])[:-1]] = 0
            yield pa.RecordBatch.from_arrays([pa.array(ctx, pa.int64()), pa.array(block, pa.int64())], ["ctx", "block"])

    return docs.select("text").mapInArrow(run, "ctx long, block long").groupBy("ctx", "block").agg(F.count(F.lit(1)).alias("c"))


def remembered(scored: DataFrame, blocks: DataFrame) -> DataFrame:
    """row, gain: what remembering adds to the log10 probability of scored's rows.

    scored: row, held_out, seen (array of ctx, block, lm: the block's log10 probability; c, n: how often the row has the pair, the ctx).
    """
    after = hold(blocks.groupBy("ctx").agg(F.sum("c").alias("all"), F.count(F.lit(1)).alias("kinds")))
    seen = scored.select("row", "held_out", F.explode("seen").alias("x")).select("row", F.when(F.col("held_out"), 0).otherwise(1).alias("own"), "x.*")
    # All documents begin alike: these counts are two numbers, not a key to join by.
    start = after.where("ctx = 0").select("all", "kinds").first() or (0, 0)
    first = seen.where("ctx = 0").withColumns({"all": F.lit(start[0]).cast("long"), "kinds": F.lit(start[1]).cast("long")})
    known = after.where("ctx <> 0").withColumnRenamed("ctx", "_ctx")
    later = seen.where("ctx <> 0").join(known, F.col("ctx") == F.col("_ctx")).drop("_ctx")
    n = F.col("all") - F.col("own") * F.col("n")
    left = first.unionByName(later).withColumn("left", n).where("left > 0")
    pairs = blocks.select(F.col("ctx").alias("_ctx"), F.col("block").alias("_block"), F.col("c").alias("times"))
    held = left.join(pairs, (F.col("ctx") == F.col("_ctx")) & (F.col("block") == F.col("_block")), "left")
    times = F.coalesce("times", F.lit(0)) - F.when(F.col("times").isNull(), 0).otherwise(F.col("own") * F.col("c"))
    other = F.greatest(F.col("kinds") - F.when((times == 0) & F.col("times").isNotNull(), 1).otherwise(0), F.lit(1))
    new = F.log10(other / (F.col("left") + other)) + F.col("lm")
    score = F.when(times > 0, F.log10(times / (F.col("left") + other) + F.pow(F.lit(10.0), new))).otherwise(new)
    return held.groupBy("row").agg(F.sum(score - F.col("lm")).alias("gain"))


def count_ids(counts: DataFrame) -> np.ndarray:
    """How often the words counted (with_ids) yield each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(VOCAB, np.int64)
        for batch in batches:
            ids, size = _of_words(batch.column(0))
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), size))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    out = np.zeros(VOCAB, np.int64)
    for r in counts.select("ids", "c").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def count_pairs(counts: DataFrame, paired: np.ndarray) -> np.ndarray:
    """How often the words counted (with_ids) have one of the paired ids right after another."""
    number = np.full(VOCAB, len(paired))
    number[paired] = np.arange(len(paired))
    sent = counts.sparkSession.sparkContext.broadcast(number)
    wide = len(paired) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            ids, size = _of_words(batch.column(0))
            inner = np.ones(len(ids), bool)
            inner[np.cumsum(size) - size] = False
            a, b = sent.value[ids[:-1]], sent.value[ids[1:]]
            some = np.flatnonzero(inner[1:] & (a < wide - 1) & (b < wide - 1))
            keys.append(a[some] * wide + b[some])
            sums.append(np.repeat(batch.column(1).to_numpy(), size)[1:][some])
            if sum(map(len, keys)) > 4_000_000:
                k, n = _summed(np.concatenate(keys), np.concatenate(sums))
                keys, sums = [k], [n]
        k, n = _summed(np.concatenate(keys), np.concatenate(sums))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["k", "n"])

    out = np.zeros((len(paired), len(paired)), np.float32)
    got = counts.select("ids", "c").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k = got["k"].to_numpy()
    out[k // wide, k % wide] = got["n"].to_numpy()
    return out


def _summed(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, sums = keys[order], sums[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool))
    return keys[first], np.add.reduceat(sums, first) if len(first) else sums


def pieces(docs: DataFrame, size: int = _PIECE, lexicon: Broadcast | None = None) -> DataFrame:
    """w (LEAD ids, then at most `size` targets, as uint16), draw: all ids of all rows of docs (h, text), each a target once.

    lexicon: its words need no tokenizer; the ids are the same without it.
    """

    def found(column: pa.Array) -> Iterator[np.ndarray]:
        if lexicon:
            for _, _, ids, *_ in lexicon.value.read_column(column):
                yield from ids
        else:
            yield from (ids_of(words_of(t.as_py())) for t in column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, at = [], [], []
            for name, own in zip(batch.column(0).to_pylist(), found(batch.column(1)), strict=True):
                ids = np.concatenate((np.full(LEAD, PAD), own, [END])).astype(np.uint16)
                for lo in range(0, len(ids) - LEAD, size):
                    w.append(ids[lo : lo + LEAD + size].tobytes())
                    h.append(name)
                    at.append(lo)
                    if len(w) * size >= _FLUSH:
                        yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(h, pa.int64()), pa.array(at, pa.int64())], ["w", "h", "at"])
                        w, h, at = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(h, pa.int64()), pa.array(at, pa.int64())], ["w", "h", "at"])

    return docs.select("h", "text").mapInArrow(run, "w binary, h long, at long").select("w", F.xxhash64("h", "at").alias("draw"))


def _drawn(n: int, most: int, share: int) -> float:
    return min(1.0, max(1 / share, most / max(1, n)))


def sample_windows(docs: DataFrame, n: int, most: int = LEAST_DOCS, share: int = SHARE, seed: int = 7) -> DataFrame:
    """w (LEAD ids and at most STRIDE targets), draw: all windows of one in `share` of the n rows of docs, or about `most` if that is more, drawn by hash."""
    h = F.xxhash64("doc_id", F.lit(seed))
    return pieces(docs.where((h / F.lit(2.0**64) + 0.5) <= _drawn(n, most, share)).select(h.alias("h"), "text"), STRIDE)


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(w, np.uint16).astype(np.int64) for w in column.to_pylist()]


def window_stats(rows: DataFrame, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What `classify` takes, counted over the targets of all rows of windows or pieces. seen: how often each id is a target, if that is known."""

    def counted(most: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(most, np.int64)
            for batch in batches:
                for some in _batches(_ids(batch.column(0))):
                    np.add.at(total, f(np.concatenate([x[STRIDE:-1] for x in some]), np.concatenate([x[LEAD:] for x in some])), 1)
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

        got = rows.select("w").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
        return got["k"].to_numpy(), got["n"].to_numpy()

    if seen is None:
        seen = np.zeros(VOCAB, np.int64)
        k, n = counted(VOCAB, lambda before, here: here)
        seen[k] = n
    column = _columns(seen)
    # Only ids that are there have rows while it is counted; PAD is before a text.
    there = np.union1d(np.flatnonzero(seen), [PAD])
    place = np.zeros(VOCAB, np.int64)
    place[there] = np.arange(len(there))
    k, n = counted(len(there) * 512, lambda before, here: _keys(place[before], place[here], column[there]))
    k = there[k // 512] * 512 + k % 512
    order = np.argsort(k)
    return seen, k[order], n[order]


def train_on(rows: DataFrame, n: int, p: dict[str, np.ndarray], row: np.ndarray, cls: np.ndarray, rounds: int = ROUNDS, rate: float = 2e-3) -> None:
    """Changes p by training on all rows of pieces, of n windows in all, each in one of the rounds; the tasks' weights are averaged."""
    sc = rows.sparkSession.sparkContext
    shapes = {k: v.shape for k, v in p.items()}

    def packed(q: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([q[k].ravel() for k in shapes]).astype(np.float64)

    def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in shapes.values()])
        return {k: x.reshape(s).astype(np.float32) for (k, s), x in zip(shapes.items(), np.split(flat, ends[:-1]), strict=True)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, done = 0.0, 0
        for b in batches:
            for flat, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total, done = total + np.frombuffer(flat), done + m
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([done], pa.int64())], ["flat", "n"])

    for turn in range(rounds):
        sent = sc.broadcast((dict(p), row, cls))
        speed = rate * (1 - 0.9 * turn / rounds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, speed=speed) -> Iterator[pa.RecordBatch]:
            start, row, cls = sent.value
            q = {k: v.copy() for k, v in start.items()}
            rng = np.random.default_rng(1)

            def some() -> Iterator[list[np.ndarray]]:
                for b in batches:
                    ids = _ids(b.column(0))
                    yield from _batches([ids[i] for i in rng.permutation(len(ids))])

            if done := _train(q, row, cls, some(), lambda step: speed * min(1.0, step / 20)):
                yield pa.RecordBatch.from_arrays([pa.array([(packed(q) * done).tobytes()], pa.binary()), pa.array([done], pa.int64())], ["flat", "n"])

        part = rows.where(F.pmod("draw", F.lit(rounds)) == turn).select("w").coalesce(max(1, n // rounds // _TASK))
        sums = part.mapInArrow(run, "flat binary, n long").repartition(8).mapInArrow(add, "flat binary, n long").collect()
        if done := sum(r["n"] for r in sums):
            p.update(unpack(sum(np.frombuffer(r["flat"]) for r in sums) / done))
        sent.unpersist()


def learn(docs: DataFrame, n: int, counts: np.ndarray, pairs: np.ndarray, paired: np.ndarray, most: int = LEAST_DOCS, share: int = SHARE, lexicon: Broadcast | None = None) -> Model:
    """The model of the n rows of docs: classes and weights from all of them. most, share: what the weights are started on; lexicon: see pieces()."""
    since = written()
    every = materialize(pieces(docs.select(F.xxhash64("doc_id").alias("h"), "text"), lexicon=lexicon), "pieces")
    total = every.agg(F.sum(F.ceil((F.octet_length("w") / 2 - LEAD) / STRIDE))).first()[0] or 0
    start = most * WINDOWS
    if total > start:
        first = sample_windows(docs, n, most, share).where((F.col("draw") / F.lit(2.0**64) + 0.5) <= min(1.0, start / (total * _drawn(n, most, share))))
    else:
        first = sample_windows(docs, n, n)
    found = _ids(first.select("w").toArrow()["w"])
    # The last window of a text has PAD for what it lacks, which is no target.
    found = np.array([np.pad(x, (0, SPAN + 1 - len(x)), constant_values=PAD) for x in found], np.int64).reshape(-1, SPAN + 1)
    found = found[np.lexsort(found.T)]
    model = fit(found, counts, pairs, paired, stats=window_stats(every, counts), go_on=(lambda *model: train_on(every, total, *model)) if total > start else None)
    drop(since, written())
    return model


def score(docs: DataFrame, most_docs: int = LEAST_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    training = rows.where(~F.col("held_out"))
    counts = materialize(with_ids(count_words(training)), "words")
    blocks = materialize(count_blocks(training), "blocks")
    ends = training.count()
    # Words and their occurrences, by the power of two that the occurrences reach.
    levels = {r["e"]: (r["n"], r["c"]) for r in counts.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()}
    n, distinct = sum(c for _, c in levels.values()) + ends, sum(x for x, _ in levels.values()) + (ends > 0)
    mass = n + 0.1 * (distinct + 1)
    # The least power of two that at most `frequent` words reach.
    least = next((e for e in range(65) if sum(x for k, (x, _) in levels.items() if k >= e) <= frequent), 65)
    top = counts.where(F.col("c") >= F.lit(2.0**least)).select("word", "c").toArrow()
    frequent_words, frequent_c = top["word"].to_pylist(), top["c"].to_numpy()
    ids = count_ids(counts)
    ids[END] += ends
    paired = np.lexsort((np.arange(VOCAB), -ids))[:PAIRED]
    paired = paired[(ids[paired] > 0) & (paired < END)]
    lexicon = spark.sparkContext.broadcast(Lexicon(frequent_words, np.log10((frequent_c + 0.1) / mass)))
    sent = spark.sparkContext.broadcast(learn(training, ends, ids, count_pairs(counts, paired), paired, most_docs, lexicon=lexicon))
    end_logp = math.log10((ends + 0.1) / mass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = sent.value, lexicon.value
        for batch in batches:
            tokens, known, base, lm, rare, often = [], [], [], [], [], []
            seen: list[np.ndarray] = []
            for some, ends, ids, length, logp, others in words.read_column(batch.column(1)):
                n, found = np.diff(ends), np.isfinite(logp)
                texts = [some[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                sums = np.concatenate(([0.0], np.cumsum(np.where(found, logp, 0.0))))
                many = np.concatenate(([0], np.cumsum(found)))
                block, parts = mixed(texts, length, logp, model.each(ids), end_logp)
                first = np.cumsum(parts) - parts
                counted = [Counter(o) for o in others]
                tokens += (n + 1).tolist()
                known += (many[ends[1:]] - many[ends[:-1]] + (train_docs > 0)).tolist()
                base += (sums[ends[1:]] - sums[ends[:-1]] + end_logp).tolist()
                lm += np.add.reduceat(block, first).tolist()
                rare += [list(c) for c in counted]
                often += [list(c.values()) for c in counted]
                for h, a, m in zip(blocks_of_all(some, ends), first.tolist(), parts.tolist(), strict=True):
                    ctx = np.concatenate(([0], h[:-1]))
                    if len(set(h.tolist())) == m:
                        c = k = np.ones(m, np.int64)
                    else:  # the document repeats itself
                        _, at, k = np.unique(ctx, return_inverse=True, return_counts=True)
                        k = k[at.ravel()]
                        _, at, c = np.unique(np.column_stack([ctx, h]), axis=0, return_inverse=True, return_counts=True)
                        c = c[at.ravel()]
                    seen.append((ctx, h, block[a : a + m], c, k))
            offsets = np.concatenate(([0], np.cumsum([len(x[0]) for x in seen]))).astype(np.int32)
            columns = [np.concatenate([x[i] for x in seen]) if seen else np.zeros(0) for i in range(5)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            pairs = pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["ctx", "block", "lm", "c", "n"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(lm, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(often, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(offsets), pairs)],
                ["doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "often", "seen"],
            )

    train_docs = ends
    scored = rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<binary>, often array<int>, seen array<struct<ctx:long,block:long,lm:double,c:long,n:long>>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    seen = scored.select("row", F.explode(F.arrays_zip("rare", "often")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.often").alias("t"))
    c = F.coalesce("c", F.lit(0))
    joined = seen.join(counts.where(F.col("c") < F.lit(2.0**least)).select("word", "c"), "word", "left")
    sums = joined.groupBy("row").agg(F.sum(F.col("t") * F.log10((c + 0.1) / F.lit(float(mass)))).alias("more"), F.sum(F.when(c > 0, F.col("t")).otherwise(0)).alias("more_known"))
    gains = remembered(scored.select("row", "held_out", "seen"), blocks)
    return (
        scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "score")
        .join(sums, "row", "left")
        .join(gains, "row", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score"))
    )
