"""Rows that every operator has to take: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import pytest

LONG = " ".join(f"wort{i % 977}" for i in range(60_000))

ODD = [
    (1, "The same text of seven words here.", "en"),
    (2, "The same text of seven words here.", "en"),
    (2, "The same text of seven words here.", "en"),
    (3, "THE  same text\tof seven words here.", "en"),
    (4, None, None),
    (5, "", "en"),
    (6, " \n\t ", "en"),
    (7, "two words", "en"),
    (8, "two words", None),
    (9, LONG, "de"),
    (10, LONG + " ende", "de"),
    (None, "a row without an id has words too", "en"),
    (11, "12345 !!! ??", "fr"),
    (12, "naïve café – “quotes” 漢字 🙂 İstanbul Σίσυφος", "fr"),
    (-3, "negative ids are ids as well, are they not", "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns whose names operators use inside."""
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    return docs.selectExpr("*", "'s' source", "1 n", "2 value", "3 node", "4 score", "5 shard", "6 size", "7 tier", "8 bucket", "cast(null as string) digest")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
