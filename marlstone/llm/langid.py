"""Language ID by hierarchical discrimination.

The family is predicted first, then one-versus-one linear support vector machines tell the
languages within it apart; families are told apart by one-versus-one machines too. Features
are hashed n-grams of 2 to 4 bytes of the lower-cased text, all ASCII but letters being blanks.
The machines have no bias, so only the sign of the summed weights decides, and a prediction is
one pass over the whole text with table look-ups.

Training takes the rows of each language with the smallest hashes of doc_id, PER_LANG of them,
SAMPLE in all and SAMPLE_BYTES of text in all at most (these are parameters; texts over a sixteenth
of a language's bytes come last, and a language keeps one text at least): their whole texts become
sparse counts on the executors, and dual coordinate descent on the driver fits the machines.

`keep_known` rejects what the machines can't judge: text whose pairs of bytes are mostly none of those
that the training texts are made of, as in another script. The share that is asked for is HALF of the
least one among the training texts, or HALF if that is less, so their like stays.

Null text, or text without a letter, gets `und` and score 0; so does every row if nothing could
be learned. Rows with a null doc_id count as held out. Repeated rows and equal texts get equal
predictions; ties between languages go to the first by code point. Empty tables give empty
results. Extra columns are ignored by `predict` and kept by `keep_known`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import slices


PER_LANG, SAMPLE, SAMPLE_BYTES = 1000, 8000, 64 << 20
#: Families by ISO 639-1 code. A language that isn't listed is in the family `other`.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr uz",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_BITS = 17
_SIZES = (1 << 16, 1 << _BITS, 1 << _BITS)
_OFFSETS = (0, _SIZES[0], _SIZES[0] + _SIZES[1])
DIM = sum(_SIZES)
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]
_BLANKS = 32 << 8 | 32
HALF = 0.5
#: A pair of bytes is familiar from this share of all on.
_FAMILIAR = 1e-6
_LETTER = regex.compile(r"\p{L}")
#: Bytes of text looked up at a time.
_CHUNK = 1 << 20


def grams(data: np.ndarray) -> Iterator[np.ndarray]:
    """For n = 2, 3, 4: the feature of each byte's n-gram. data ends with 3 blanks that start none."""
    b = data.astype(np.uint32)
    m = len(b) - 3
    two = (b[:m] << 8) | b[1 : m + 1]
    three = (two << 8) | b[2 : m + 2]
    four = (three << 8) | b[3 : m + 3]
    yield two.astype(np.int64)
    for k, x in ((1, three), (2, four)):
        h = x * np.uint32(2654435761)
        yield ((h ^ (h >> np.uint32(15))) >> np.uint32(32 - _BITS)).astype(np.int64) + _OFFSETS[k]


def _bytes(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b"   "


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of the whole text."""
    found = np.concatenate(list(grams(_BLANK[np.frombuffer(_bytes(text), np.uint8)])))
    index, count = np.unique(found, return_counts=True)
    return index.astype(np.int32), count.astype(np.int32)


@dataclass
class Model:
    languages: list[str]
    families: dict[str, list[str]] = field(default_factory=dict)
    #: (first, second) -> column of `weights`; a positive sum speaks for the first.
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)
    weights: np.ndarray | None = None
    slopes: list[float] = field(default_factory=list)
    #: Pairs of bytes that the training texts are made of, and the least share of them in a text that is kept.
    familiar: np.ndarray | None = None
    least: float = 0.0

    def shares(self, texts: list[str]) -> np.ndarray:
        """Of each text's pairs of bytes, the share that is familiar."""
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            raw = np.frombuffer(_bytes(t), np.uint8)
            known = total = 0
            for lo in range(0, len(raw) - 3, _CHUNK):
                pairs = next(grams(_BLANK[raw[lo : lo + _CHUNK + 3]]))
                pairs = pairs[pairs != _BLANKS]
                known += int(np.count_nonzero(self.familiar[pairs]))
                total += len(pairs)
            out[i] = known / max(1, total)
        return out

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x machines) sums of weights, and each text's number of n-grams a size."""
        raw = [_bytes(t) for t in texts]
        n = np.array([len(r) - 3 for r in raw])
        out = np.zeros((len(raw), len(self.pairs)))
        i = 0
        while i < len(raw):
            j, size = i, 0
            while j < len(raw) and (j == i or size + len(raw[j]) <= _CHUNK):
                size += len(raw[j])
                j += 1
            data = _BLANK[np.frombuffer(b"".join(raw[i:j]), np.uint8)]
            starts = np.concatenate(([0], np.cumsum(n[i:j] + 3)))[:-1]
            # A text's last 3 blanks start n-grams that reach into the next text: cut them off.
            edges = np.column_stack([starts, starts + n[i:j]]).ravel()
            for index in grams(data):
                for k in range(out.shape[1]):
                    x = np.append(self.weights[k].take(index), np.float32(0))
                    out[i:j, k] += np.add.reduceat(x, edges, dtype=np.float64)[::2]
            i = j
        return out, n

    def _best(self, names: list[str], z: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in names, probability): most won duels, then the largest sum of margins."""
        won, margin = np.zeros((len(z), len(names))), np.zeros((len(z), len(names)))
        least = np.ones((len(z), len(names)))
        for a, b in combinations(range(len(names)), 2):
            k = self.pairs[names[a], names[b]]
            first = z[:, k] >= 0
            won[:, a] += first
            won[:, b] += ~first
            margin[:, a] += z[:, k]
            margin[:, b] -= z[:, k]
            least[:, a] = np.minimum(least[:, a], p[:, k])
            least[:, b] = np.minimum(least[:, b], 1 - p[:, k])
        best = np.argmax(won + 1e-3 * np.tanh(margin / (1 + np.abs(margin).max(initial=0))), axis=1)
        return best, least[np.arange(len(z)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not known or not self.languages:
            return lang, score
        sums, n = self.sums([texts[i] for i in known])
        z = sums / np.sqrt(n)[:, None] if len(self.pairs) else sums
        p = 1 / (1 + np.exp(-np.clip(z * np.array(self.slopes), -50, 50))) if len(self.pairs) else z
        names = list(self.families)
        family, sure = self._best(names, z, p)
        for f, name in enumerate(names):
            rows = np.flatnonzero(family == f)
            best, q = self._best(self.families[name], z[rows], p[rows])
            for r, b, s in zip(rows.tolist(), best.tolist(), (q * sure[rows]).tolist(), strict=True):
                lang[known[r]], score[known[r]] = self.families[name][b], float(min(1.0, max(0.0, s)))
        return lang, score


def svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 4.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """A linear machine without bias, by dual coordinate descent; rows: (features, values of norm 1)."""
    w, alpha = np.zeros(DIM), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    # Each side weighs as much as the other, however many rows it has.
    most = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            index, value = rows[i]
            new = min(max(alpha[i] + 1 - y[i] * (w[index] @ value), 0.0), most[i])
            if new != alpha[i]:
                w[index] += (new - alpha[i]) * y[i] * value
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def _slope(z: np.ndarray, y: np.ndarray) -> float:
    """The a for which 1 / (1 + exp(-a z)) fits the signs y best, found by halving steps."""
    grid = np.exp(np.linspace(-6, 6, 97))
    loss = [np.log1p(np.exp(-np.clip(a * z * y, -50, 50))).mean() + 1e-4 * a * np.abs(z).mean() for a in grid]
    return float(grid[int(np.argmin(loss))])


def fit(samples: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """A model from (language, features, counts)."""
    languages = sorted({s[0] for s in samples})
    families: dict[str, list[str]] = {}
    for lang in languages:
        families.setdefault(FAMILY.get(lang, "other"), []).append(lang)
    model = Model(languages, dict(sorted(families.items())))
    unit = [(i, v / np.sqrt((v.astype(float) ** 2).sum())) for _, i, v in samples]
    n = np.array([v.sum() / 3 for _, _, v in samples])
    of = {lang: f for f, names in model.families.items() for lang in names}
    duels = [(a, b, [of[s[0]] for s in samples]) for a, b in combinations(model.families, 2)]
    duels += [(a, b, [s[0] for s in samples]) for names in model.families.values() for a, b in combinations(names, 2)]
    weights = []
    for a, b, names in duels:
        rows = [i for i, name in enumerate(names) if name in (a, b)]
        y = np.array([1.0 if names[i] == a else -1.0 for i in rows])
        w = svm([unit[i] for i in rows], y)
        z = np.array([w[samples[i][1]] @ samples[i][2] for i in rows]) / np.sqrt(n[rows])
        model.pairs[a, b] = len(weights)
        model.slopes.append(_slope(z, y))
        weights.append(w.astype(np.float32))
    pairs = [(i[i < _SIZES[0]], v[i < _SIZES[0]]) for _, i, v in samples]
    counts = np.zeros(_SIZES[0])
    for i, v in pairs:
        counts[i] += v
    counts[_BLANKS] = 0
    model.familiar = counts >= max(2.0, _FAMILIAR * counts.sum())
    inside = [(v[model.familiar[i]].sum(), v[i != _BLANKS].sum()) for i, v in pairs]
    model.least = HALF * min(1.0, min((a / b for a, b in inside if b), default=1.0))
    model.weights = np.array(weights, dtype=np.float32).reshape(len(weights), DIM)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, seed: int = 17, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from text and lang of the rows of docs that aren't held out."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    if not counts:
        return Model([])
    need = max(1, min(per_lang, sample // len(counts)))
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, min(1.0, 3 * need / n)) for k, n in counts.items()], "lang string, share double")
    h = F.xxhash64("doc_id", F.lit(seed))
    # Rows above three times the needed share can't be among the smallest hashes; so no group is large.
    few = known.select("doc_id", "lang", F.octet_length("text").cast("long").alias("size"), h.alias("h")).join(F.broadcast(table), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share"))
    room = sample_bytes // len(counts)
    line = W.partitionBy("lang").orderBy(F.col("size") > room // 16, "h", "doc_id")
    ranked = few.withColumns({"r": F.row_number().over(line), "sum": F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0))})
    first = ranked.where((F.col("r") <= need) & ((F.col("sum") <= room) | (F.col("r") == 1))).select("doc_id").distinct()

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, index, count = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (t := text.as_py()) and _LETTER.search(t):
                    i, n = features(t)
                    langs.append(lang)
                    index.append(i)
                    count.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(index, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32()))], ["lang", "index", "count"])

    rows = known.join(F.broadcast(first), "doc_id", "left_semi").select("lang", "text").mapInArrow(sparse, "lang string, index array<int>, count array<int>")
    got = rows.toArrow()
    samples = [(a, i.values.to_numpy(), c.values.to_numpy()) for a, i, c in zip(got["lang"].to_pylist(), got["index"], got["count"], strict=True)]
    samples.sort(key=lambda s: (s[0], len(s[1]), int(s[1].sum()), int(s[2].sum())))
    return fit(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang, score = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.0) -> DataFrame:
    """The rows of docs, all columns as they were, whose text has a language of at least that score and is made of familiar pairs of bytes.

    If nothing could be learned, all text with a letter stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if shared.value.languages:
                share = shared.value.shares([t or "" for t in texts])
                keep = [a != "und" and s >= least and f >= shared.value.least for a, s, f in zip(*shared.value.predict(texts), share.tolist(), strict=True)]
            else:
                keep = [bool(t and _LETTER.search(t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
