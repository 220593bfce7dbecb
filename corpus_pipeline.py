"""The corpus pipeline: five stages over ``documents``, each of them one of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import stash
from brindle.llm.lines import dedup_lines
from brindle.llm.mixing import mix_sources, repeat_rows
from brindle.llm.packing import pack_documents
from brindle.llm.quality import filter_quality, fit_bands, good_ids
from brindle.llm.simhash import drop_near_copies


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go; the bands are fitted to those labelled as good.

    Null and empty texts go, too; rows that repeat stay or go together, and an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_quality(docs, bands=fit_bands(docs, good_ids(labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, alike or nearly, go from the texts; ``n_chars`` follows. No row goes.

    The earlier line is that of the smaller id, null ids last, then text hash and line number; rows that repeat id and text
    keep each other's lines. Null texts and an empty table stay as they are.
    """
    return dedup_lines(docs).select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in docs.columns))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles) stays: the one with the smallest id.

    Null ids count as the last, then the text hash decides; null and empty texts are one group.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words as often as complete epochs say."""
    return repeat_rows(mix_sources(docs, keep_row=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences; repeated rows are packed one by one, null texts are one id."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: zstandard, SimHash and the tokenizer are beyond SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
