"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

All of it is DataFrame functions; a row is read once and no row leaves its partition.

- A pattern proposes spans, leftmost and non-overlapping within its kind. Patterns are
  anchored to the start of a run (or the end of the last match) and possessive, which finds
  the same spans as the plain forms in time linear in the text.
- A validator drops proposals: parts of an address at most 255, Luhn for cards, mod 97 for
  IBANs, digit counts for phones. Dropped ones aren't tried again from a later start.
- Each kind has a base score in percent; a context word within the 40 characters of the text
  before the span, whatever else is found there, adds CONTEXT. Kinds that the method adds (`iban`, `phone_local`) need LEAST; the four base
  kinds are always kept.

Positions are in code points, end exclusive. Null text counts as empty. Very long texts are read
whole, each in its row. Ties don't occur: spans of one kind don't overlap, and kinds are listed apart.
Empty tables give empty results. Repeated rows give repeated results. Extra columns are ignored by
`find` and kept by `redact`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, LEAST, NEAR = 20, 60, 40


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Text without it has no span of this kind; spares the pattern.
    needs: str
    #: Of a proposal and the text between the last proposal and it.
    valid: Callable[[Column, Column], Column]
    score: int
    context: str


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _mod97(x: Column) -> Column:
    """The rest of an IBAN's number: first four characters last, letters as 10 to 35."""
    moved = F.concat(F.substr(x, F.lit(5)), F.substr(x, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return (rest * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


#: Lengths of IBANs by country (ISO 13616), for those printed in groups of four.
_IBANS = {15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU", 31: "MT|SC", 32: "LC", 33: "RU"}
_GROUPED = "|".join(rf"(?:{c})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in _IBANS.items())
_IBAN = r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9])?"
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda m, p: F.lit(True), 70, "mail|contact|kontakt|correo|courriel|write to"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", ".", lambda m, p: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 60, "host|server|address|adresse|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "", lambda m, p: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m)), 80, "card|visa|karte|carte|tarjeta|credit|kredit"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", lambda m, p: F.length(_digits(m)).between(9, 15), 60, "tel|phone|call|fax|mobile|handy"),
    Kind("iban", rf"(?=[A-Z]{{2}}[0-9]{{2}} )(?:{_GROUPED})(?![A-Z0-9])|{_IBAN}", "", lambda m, p: _mod97(F.replace(m, F.lit(" "))) == 1, 80, "iban|account|konto|compte|cuenta|bank"),
    Kind("phone_local", r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "(", lambda m, p: ~p.rlike(r"\+[0-9]{1,3} $"), 40, "tel|phone|call|fax|mobile|handy"),
)
BASE = ("email", "ip", "card", "phone")
_LABEL = f"<(?:{'|'.join(k.name.upper() for k in KINDS)})>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _before(lengths: Column) -> Column:
    """For each length, the sum of those before it; in blocks of the root of their number, so 10^6 of them cost 10^9 steps, not 10^12."""

    def blocks(x: Column) -> Column:
        n, width = F.size(x["v"]), x["width"]
        total = lambda a: F.aggregate(a, F.lit(0), lambda s, y: s + y)
        numbers = F.sequence(F.lit(0), ((n - 1) / width).cast("int"))
        sums = F.transform(numbers, lambda k: total(F.slice(x["v"], k * width + 1, width)))

        def spread(s: Column) -> Column:
            def one(k: Column) -> Column:
                inside = F.slice(x["v"], k * width + 1, width)
                return _let(F.struct(total(F.slice(s, F.lit(1), k)).alias("base"), inside.alias("in")), lambda b: F.transform(b["in"], lambda _, j: b["base"] + total(F.slice(b["in"], F.lit(1), j))))

            return F.flatten(F.transform(numbers, one))

        return _let(sums, spread)

    return _let(F.struct(lengths.alias("v"), F.ceil(F.sqrt(F.size(lengths))).cast("int").alias("width")), blocks)


def _ahead(x: Column, i: Column) -> Column:
    """The last NEAR code points of the text before proposal i. A proposal has two at least, so NEAR / 2 pieces reach back far enough."""
    p, back = F.get(x["pieces"], i), NEAR // 2
    some = lambda a: F.slice(a, F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back)))
    parts = F.zip_with(some(x["pieces"]), some(x["found"]), lambda q, m: F.right(F.concat(q, m), F.lit(NEAR)))
    return F.right(F.when(F.length(p) >= NEAR, p).otherwise(F.concat(F.array_join(parts, ""), p)), F.lit(NEAR))


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<start, end, score>> of the kind's confirmed spans."""
    pattern = F.lit(kind.pattern)
    none = F.lit(None).cast("array<struct<start:int,end:int,score:int>>")

    def place(x: Column) -> Column:
        # x: pieces (the text between proposals) and found (the proposals)
        ahead = _before(F.zip_with(x["pieces"], x["found"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0))))

        def of(a: Column) -> Column:
            def span(m: Column, i: Column) -> Column:
                p = F.get(x["pieces"], i)
                start = F.get(a, i) + F.length(p)
                near = F.lower(_ahead(x, i)).rlike(kind.context)
                score = F.lit(kind.score) + F.when(near, CONTEXT).otherwise(0)
                ok = kind.valid(m, p) & (F.lit(kind.name in BASE) | (score >= LEAST))
                return F.when(ok, F.struct(start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score")))

            return F.filter(F.transform(x["found"], span), lambda s: s.isNotNull())

        return _let(ahead, of)

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    placed = _let(found, lambda m: F.when(F.size(m) > 0, _let(F.struct(F.split(text, kind.pattern, -1).alias("pieces"), m.alias("found")), place)))
    spans = F.when(F.contains(text, F.lit(kind.needs)), placed) if kind.needs else placed
    return F.coalesce(spans, none, F.array().cast("array<struct<start:int,end:int,score:int>>"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores (percent, in the spans' order) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *[_spans(k, text).alias(k.name) for k in KINDS])

    def named(n: str) -> Column:
        return F.transform(F.col(n), lambda s: F.concat(F.lit(n + ":"), s["start"], F.lit(":"), s["end"]))

    def said(names: tuple[str, ...]) -> Column:
        return F.array_join(F.flatten(F.array(*[named(n) for n in names])), ",")

    every = tuple(k.name for k in KINDS)
    return rows.select(
        "doc_id",
        *[F.size(n).cast("long").alias(f"n_{n}") for n in BASE],
        F.sha2(said(BASE), 256).alias("base_sha256"),
        said(every).alias("spans"),
        F.array_join(F.flatten(F.array(*[F.transform(F.col(n), lambda s: s["score"].cast("string")) for n in every])), ",").alias("scores"),
    )


def _redacted_kind(kind: Kind, text: Column) -> Column:
    def swap(x: Column) -> Column:
        def put(m: Column, i: Column) -> Column:
            p = F.get(x["pieces"], i)
            # What was put in for other kinds is no word of the text.
            near = F.lower(F.regexp_replace(_ahead(x, i), _LABEL, "")).rlike(kind.context)
            sure = F.lit(kind.name in BASE) | (F.lit(kind.score) + F.when(near, CONTEXT).otherwise(0) >= LEAST)
            return F.when(kind.valid(m, p) & sure, F.lit(f"<{kind.name.upper()}>")).otherwise(m)

        return F.array_join(F.zip_with(x["pieces"], F.transform(x["found"], put), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    def change(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))
        changed = _let(found, lambda m: F.when(F.size(m) > 0, _let(F.struct(F.split(t, kind.pattern, -1).alias("pieces"), m.alias("found")), swap)).otherwise(t))
        return F.when(F.contains(t, F.lit(kind.needs)), changed).otherwise(t) if kind.needs else changed

    return _let(text, change)


def redacted(text: Column) -> Column:
    """text with each confirmed span replaced by <KIND>, kind after kind; null stays null."""
    for kind in KINDS:
        text = _redacted_kind(kind, text)
    return text


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in `text` replaced; n_chars, if there, follows the new text."""
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), redacted(F.col("text"))))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _IBAN,
}
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_SQL_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length({_DIGITS})), lambda j: "
    f"(CAST(substr({_DIGITS}, CAST(length({_DIGITS}) - j AS INT), 1) AS INT) * (1 + j % 2)) // 10 + (CAST(substr({_DIGITS}, CAST(length({_DIGITS}) - j AS INT), 1) AS INT) * (1 + j % 2)) % 10)) % 10 = 0",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "list_reduce(list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1), "
    "lambda a, v: (a * (CASE WHEN v > 9 THEN 100 ELSE 10 END) + v) % 97, CAST(0 AS BIGINT)) = 1",
    "phone_local": r"NOT regexp_matches(pre, '\+[0-9]{1,3} $')",
}


def _sql_kind(i: int, kind: Kind) -> str:
    pattern = _PLAIN.get(kind.name, kind.pattern)
    keep = "" if kind.name in BASE else f" AND score >= {LEAST}"
    return f"""SELECT doc_id, {i} AS o, '{kind.name}' AS kind, s, s + length(m) AS e, score FROM (
  SELECT doc_id, m, pre, s, {kind.score} + CASE WHEN regexp_matches(lower(right(pre, {NEAR})), '{kind.context}') THEN {CONTEXT} ELSE 0 END AS score FROM (
    SELECT doc_id, f[i] AS m, p[i] AS pre, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT doc_id, f, string_split_regex(text, '{pattern}') AS p, unnest(range(1, len(f) + 1)) AS i
      FROM (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS f FROM t) WHERE len(f) > 0)))
  WHERE {_SQL_VALID[kind.name]}{keep}"""


#: DuckDB, with the plain patterns. It looks for context after the last proposal only, and for IBANs without blanks.
ORACLE = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_kind(i, k) for i, k in enumerate(KINDS))}),
said AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{n}') AS n_{n}" for n in BASE)},
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s) FILTER (o < {len(BASE)}) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY o, s) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY o, s) AS scores FROM spans GROUP BY doc_id)
SELECT t.doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM t LEFT JOIN said USING (doc_id)"""
