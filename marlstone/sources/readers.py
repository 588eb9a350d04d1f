"""Readers of transactions, labeled references, test files and participants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """idx and the transaction's columns, from a JSON array; `malformed` marks rows that couldn't be read.

    Position is the identity: `id` isn't unique. An element that isn't a transaction is one malformed
    row, the others stay; a file that isn't JSON is one malformed row.
    """
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json(F.ltrim("value", F.lit("\ufeff"))).alias("v"))
    every = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array(F.col("v")))
    return transactions_of(text.select(F.posexplode(every).alias("pos", "e")).select(F.col("pos").cast("long").alias("idx"), F.to_json("e").alias("value")))


def transactions_of(rows: DataFrame) -> DataFrame:
    """rows (idx, value: a transaction as JSON) with its columns and `malformed`."""
    parsed = rows.select("idx", F.from_json("value", schemas.PAYLOAD + ", _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("p")).select("idx", "p.*")
    broken = F.col("_broken").isNotNull() | F.col("id").isNull() | F.col("transaction").isNull()
    return parsed.withColumn("malformed", broken).drop("_broken")


def payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, splittable; idx is a line's place within its file's read, unique but not dense."""
    return transactions_of(spark.read.text(path).select(F.monotonically_increasing_id().alias("idx"), "value"))


def references(spark: SparkSession, path: str, dims: int = 14) -> DataFrame:
    """ref_id (place in the array), vector, label; a wrong length or a missing label is an error.

    References are flat objects, so the array is cut at their closing braces and read in splits. Each
    split's references are counted, and the counts of those before it give its first place. A gzip file
    is one split: convert it once with `store_references`.
    """
    pieces = _pieces(spark, path, "}")
    rows = pieces.withColumn("value", F.regexp_replace("value", r"^[\s\ufeff\[,]+", "")).where(F.startswith("value", F.lit("{")))
    out = _placed(rows, F.from_json(F.concat("value", F.lit("}")), schemas.REFERENCE).alias("r"))
    return checked(out.select(F.col("place").alias("ref_id"), "r.vector", "r.label"), dims)


def _pieces(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """value, file, start (of its split), n (rising in a split) of a text cut at sep, in splits."""
    return spark.read.option("lineSep", sep).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def _placed(rows: DataFrame, *columns: Column) -> DataFrame:
    """The columns, and each row's place among all: a split's rows are counted, and the counts of those before it give its first place."""
    counts = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("c"))
    # A row a split of the files.
    before = F.coalesce(F.sum("c").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(W.partitionBy("file", "start").orderBy("n")) - 1 + F.col("before")
    out = rows.join(counts.select("file", "start", before.alias("before")), ["file", "start"])
    return out.withColumn("place", place.cast("long")).select("place", *columns)


def checked(refs: DataFrame, dims: int) -> DataFrame:
    fine = (F.size("vector") == dims) & F.col("label").isNotNull()
    message = F.concat(F.lit("reference "), F.col("ref_id").cast("string"), F.lit(f": needs {dims} numbers and a label"))
    return refs.withColumn("label", F.when(F.coalesce(fine, F.lit(False)), F.col("label")).otherwise(F.raise_error(message).cast("string")))


def store_references(refs: DataFrame, path: str) -> None:
    """As Parquet, which is splittable and column-pruned."""
    refs.write.mode("overwrite").parquet(path)


def stored_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ref_id long, vector array<double>, label string").parquet(path)


_HEAD, _ENTRY, _TWO = r'(?s)^\ufeff?\{.*"entries"\s*:\s*\[\s*$', r'(?s)^,?\{"request":.*\}\s*$', r"\}\s*,\s*\{"


def _by_lines(spark: SparkSession, path: str) -> str | None:
    """The first line of a test file with a line for its head, each entry and its end, as `write_test_file` writes it; None for any other layout.

    Every line is looked at. A line break isn't allowed within JSON strings and `request` is the name of an entry's first field only,
    so lines that begin so are entries; one with another object behind a comma isn't taken for one.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    head = lines.select("value").where(F.rlike("value", F.lit(_HEAD))).take(2)
    if len(head) != 1:
        return None
    kind = F.when(F.rlike("value", F.lit(_ENTRY)) & ~F.rlike("value", F.lit(_TWO)), "entry").when(F.rlike("value", F.lit(_HEAD)), "head").when(F.rlike("value", F.lit(r"^\]\s*\}\s*$")), "end").when(F.trim("value") != "", "other")
    found = lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("file"), F.max("file")).collect()
    n = {r["kind"]: r["n"] for r in found}
    one_file = len({f for r in found if r["kind"] for f in (r[2], r[3])}) == 1
    return head[0][0].lstrip("\ufeff") if one_file and n.get("end") == 1 and not n.get("other") else None


def test_header(spark: SparkSession, path: str) -> DataFrame:
    """references_checksum_sha256 and stats of a labeled test file."""
    head = _by_lines(spark, path)
    if head is None:
        return spark.read.schema(schemas.TEST_HEADER).json(path, multiLine=True)
    return spark.createDataFrame([(head + "]}",)], "value string").select(F.from_json("value", schemas.TEST_HEADER).alias("h")).select("h.*")


def test_file(spark: SparkSession, path: str) -> DataFrame:
    """idx, request, expected_approved, expected_fraud_score of a labeled test file.

    A file with a line an entry is read in splits; any other document is one split.
    """
    if _by_lines(spark, path) is None:
        rows = spark.read.schema(schemas.TEST_FILE).json(path, multiLine=True)
        return rows.select(F.posexplode("entries").alias("pos", "e")).select(F.col("pos").cast("long").alias("idx"), "e.*")
    rows = _pieces(spark, path, "\n").where(F.rlike("value", F.lit(_ENTRY)))
    entry = F.from_json(F.ltrim("value", F.lit(",")), schemas.ENTRY, {"mode": "FAILFAST"})
    return _placed(rows, entry.alias("e")).select(F.col("place").alias("idx"), "e.*")


def participants(spark: SparkSession, path: str) -> DataFrame:
    """owner, pos, id, repo of a folder of JSON arrays: a file NAME.json, or a folder owner=NAME, an owner."""
    text = spark.read.text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    text = text.select((F.col("owner") if "owner" in text.columns else name).alias("owner"), "value")
    rows = text.select("owner", F.posexplode(F.from_json("value", f"array<struct<{_fields(schemas.PARTICIPANT)}>>")).alias("pos", "p"))
    return rows.select("owner", "pos", "p.id", "p.repo")


def sha256_of_files(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 (lowercase hexadecimal) of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def _fields(ddl: str) -> str:
    depth, out, at = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            name, kind = ddl[at:i].strip().split(" ", 1)
            out.append(f"{name}:{kind}")
            at = i + 1
    return ",".join(out)
