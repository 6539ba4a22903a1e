import random

import pytest

WORDS = {
    "en": "the of and to in is that it was for on are with as his they be at one have this from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
}


def prose(rng, lang, n):
    common = WORDS[lang]
    made = ["".join(rng.choice(common) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(rng.choice(common) if rng.random() < 0.6 else w for w in made).capitalize() + "."


def corpus():
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, junk, empties, nulls, a long text, a repeated row."""
    rng = random.Random(7)
    texts = [(prose(rng, lang := rng.choice(["en", "en", "de"]), rng.randint(20, 120)), lang) for _ in range(120)]
    texts += [(texts[i][0], texts[i][1]) for i in (0, 0, 0, 5)]
    texts += [(texts[1][0].replace(" ", " \n\t"), "en"), (texts[2][0] + " tail", "en"), (" ".join(prose(rng, "en", 80) for _ in range(300)), "en")]
    texts += [("".join(f"{w}*** " for w in prose(rng, "en", 40).split()), "en") for _ in range(6)]
    texts += [(None, "en"), ("", None), ("   \n", "de"), ("Ünï😀 çôde 12345 <|endoftext|> x", "fr"), ("A", "en"), ("a", "en")]
    rows = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", "en", None, None), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory, rows):
    """The corpus as a table, with extra columns whose names clash with the operators' own."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS component_id", "1 AS shard", "2 AS fp", "'k' AS keep_id", "3 AS piece", "0.5D AS score", "array('q') AS items", "7 AS n", "'w' AS word", "true AS kept", "1 AS gram", "2 AS row")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)
