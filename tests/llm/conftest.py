import random

import pytest
from pyspark.sql import types as T

# Extra columns whose names the operators use inside.
DOC_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("h", "sha", "keep_id", "fp", "chunk", "key", "norm", "score", "_id", "_gone", "n", "label")),
])
CLASH = ("x",) * 12

WORDS = "the of and to in night river stone paper green window market letter garden sugar bridge silver engine planet forest".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def doc_rows():
    """Nulls, empty and very long texts, ties, repeated rows and odd white space."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randrange(1, 120)), rng.choice(["en", "fr", None]), "s", None) for i in range(60)]
    rows += [(60, None, None, None, None), (61, "", "en", "s", 0), (62, " \t\n ", "en", "s", 0), (None, "alone with no id at all", "en", None, None), (None, None, None, None, None)]
    base = prose(rng, 80)
    rows += [(70 + i, base, "en", "hot", 1) for i in range(40)]
    rows += [(110, base.replace(" ", "\t\n "), "en", "hot", 1), (111, base + " end", "en", "hot", 1), (112, prose(rng, 10) + " " + base, "en", "s", 1)]
    rows += [(120, prose(rng, 30_000), "en", "long", 1), (121, "x" * 50_000, "en", "long", 1), (122, "ab" * 3_000 + " 漢字😀é  z", "fr", "odd", 1)]
    rows += [(5, rows[5][1], "en", "s", 3), (5, rows[5][1], "en", "s", 3), (6, "another text of id six", "en", "s", 3)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame([r + CLASH for r in doc_rows], DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


PAGE_SCHEMA = "page_id long, url string, html string, host string, value string, sha string, bytes string"


@pytest.fixture(scope="session")
def page_rows():
    big = "<html><body><article><p>" + "word " * 400 + "</p></article></body></html>"
    return [
        (1, "http://a.example.org/x?b=1", big), (2, "http://a.example.org/x?b=1", big), (3, "https://b.example.org:8080/y#f", big),
        (4, "http://a.example.org/", "small"), (5, "http://a.example.org/", "small"), (6, None, None), (7, "not a url\r\nWARC/1.1", ""),
        (None, "http://c.example.org/", "no id " * 300), (8, "http://c.example.org/", "no id " * 300),
        (9, "http://d.example.org/", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n\r\n" * 100 + "\r\n\r\n"), (10, "http://d.example.org/", "\r\n\r\n"),
        (9, "http://d.example.org/", "a\r\n\r\nb\r\n\r\nWARC/1.1\r\n\r\n" * 100 + "\r\n\r\n"), (11, "http://e.example.org/", "é漢" * 20_000),
    ]


@pytest.fixture(scope="session")
def pages(spark, page_rows):
    return spark.createDataFrame([r + ("x",) * 4 for r in page_rows], PAGE_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_pages(spark):
    return spark.createDataFrame([], PAGE_SCHEMA)
