"""Small tables with every odd case in them."""

from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, __id string"

_LONG = " ".join(f"word{i % 97} and#{i}" for i in range(30_000))
_PASSAGE = "A passage that stands in several places, with some commas, and goes on for a while. " * 6

ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "one",
    "One two",
    "ONE two three\none two three\n  one two three  \n\nshort\nshort",
    "one two three\nanother line of text\n",
    "Éa ß Ünïcode — “quotes” 漢字 ١٢٣ a b c\x85d e\x0cf\x0bg",
    "<|endoftext|> and <|startoftext|>and more<|endoftext|>",
    "x" * 3000,
    "ab" * 1500,
    _PASSAGE + "first ending of this text",
    "Another beginning of a text. " + _PASSAGE + "second ending",
    _PASSAGE + _PASSAGE,
    _LONG,
    _LONG + " one more",
    "tabs\tand\r\nline ends\r\nof all\rkinds",
    "# * $ % & | < > " * 20,
]


def odd_rows() -> list[tuple]:
    rows = [(i, t, ["en", "fr", None, "xx", "DE"][i % 5], ["a", None, "b", ""][i % 4], 7, True, 3, "x") for i, t in enumerate(ODD_TEXTS)]
    return [*rows, (100, ODD_TEXTS[11], "en", "a", None, None, None, None), (101, ODD_TEXTS[5], None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark: SparkSession) -> DataFrame:
    from docweave.session import ship

    ship(spark)
    return spark.read.parquet(f"{DATA}/documents.parquet")


def pairs_of(df: DataFrame) -> list[tuple[int, str | None]]:
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
