"""The corpus pipeline: documents through quality rules, line dedup, near-dedup, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; each is written as Parquet in the shared folder and read again as the
next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docweave.llm.common import materialize, scratch
from docweave.llm.lines import dedup_lines
from docweave.llm.minhash import drop_near_duplicates
from docweave.llm.mixing import mixed_documents
from docweave.llm.packing import about_pieces, pack_pieces, tokenize_pieces
from docweave.llm.quality import STRICT, good_documents
from docweave.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules; documents that they reject go."""
    return good_documents(docs, **STRICT)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup; repeated lines go from the texts."""
    ship(spark)
    return dedup_lines(docs).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup on five-word shingles at a similarity of 0.8; one document of each group stays."""
    ship(spark)
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights; documents are left out, kept or repeated."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of 2048 tokens: pieces with their ids, sequence and offset."""
    ship(spark)
    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack_pieces(pieces, n_rows=about_pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("line dedup", drop_lines),
    ("near-dedup", drop_near),
    ("mixing", mix),
    ("packing", pack),
]

#: Near-dedup, mixing and packing are not expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.pop()  # the stage's own result stays
    return STAGES[-1][1](spark, docs, sf_dir)
