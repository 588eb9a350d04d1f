import random

import pytest

SYLLABLES = {
    "en": "the ing er on an re st ed or th".split(), "de": "sch ung en ich ver zu ein ge ß ü".split(),
    "fr": "eau eux ai oi que é è tre le ment".split(), "es": "ción ñ os ar el la ez ue ll rr".split(),
}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, changes):
    words = text.split()
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"changed{rng.randint(0, 10**9)}"
    return " ".join(words)


def corpus(n=240, seed=3):
    """(doc_id, text, lang, source): prose in four languages, copies, near copies, odd and empty texts."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.randint(3, 300)), lang, rng.choice(["a", "b", "b", "b", None])))
    base = prose(rng, "en", 200)
    rows += [(n + i, base, "en", "b") for i in range(8)]
    rows += [(n + 10 + i, edited(rng, base, 2), "en", "c") for i in range(8)]
    rows += [(n + 20, None, "en", "a"), (n + 21, None, None, None), (n + 22, "", "de", "a"), (n + 23, "", "de", "a"), (n + 24, " \n\t ", "fr", "a"), (n + 25, "12 34 !?", "fr", "a"), (n + 26, "x", None, "c")]
    rows += [(n + 30, prose(rng, "de", 30_000), "de", "b"), (n + 31, "q" * 300_000, "en", "c"), (n + 32, "a b " * 20_000, "en", "c")]
    rows += [rows[0], rows[0], (None, "no id here at all friend", "en", "a")]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """With columns whose names the operators use themselves."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "length(text) AS n_chars", "1 AS size", "'x' AS row", "2 AS score", "3 AS id", "4 AS bands", "5 AS shard", "6 AS tokens", "7 AS rank", "8 AS part", "9 AS spans", "10 AS weight")
    df.coalesce(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
