"""A corpus pipeline of five stages over `documents`.

Language ID, near-duplicate removal, redaction of personal data, mixing to target weights,
packing. Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of docs. run() writes every stage's rows as Parquet
into the shared folder and reads them back for the next one, so a lost executor costs a task,
not a stage.

Null text goes at the first stage, with text that has no letter; an empty table gives an empty
result at each stage. Null and repeated doc_ids pass: rows are told apart by id and text together.
Very long texts are read whole everywhere and cut into pieces by the last stage only. Extra columns,
whatever their names, pass all stages but the last. Of equal and similar texts, ties included, one
stays; rows that the mix takes twice are equal rows from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import langid, mixing, neardup, packing, pii
from marlstone.llm.common import materialize, small_batches, table, tidy
from marlstone.shared import drop, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null and letterless text, and text of other bytes than the labelled languages are written in, as in another script.

    Text in another language of the same script stays: of few languages the machines always find one likely.
    """
    small_batches(spark)
    machines = langid.train(docs)
    tidy(spark)
    return langid.keep_known(docs, machines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal or similar texts stays: that of the smallest doc_id."""
    small_batches(spark)
    return neardup.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the names of their kinds; n_chars follows."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, packed into sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("sequences", sequences),
]

#: SQL can't express the language machines, the signatures or the packing heuristic.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way goes once its rows are written, these once the next stage's are."""
    docs, last = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        own = written()
        docs = materialize(out, name)
        drop(last, own)
    return docs
