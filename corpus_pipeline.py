"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing; each stage's rows are written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tripleforge.llm import linededup, mixing, packing, quality, simhash
from tripleforge.llm.util import delete, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the counts and the compression bands, with all columns. A null or empty text goes, a very long one is judged whole, equal rows alike; an empty table gives an empty one."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with all columns; lines that stand earlier, but for two edits at most, are taken out of the text and n_chars counted again.

    A null text stays null, and one whose lines all stand earlier becomes empty; rows of one doc_id or none are documents of their
    own where their texts differ, equal rows lose the same lines; an empty table gives an empty one.
    """
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints, with all columns: that of the least doc_id (none comes last), then of the least text hash. Texts without words are one group; an empty table gives an empty one."""
    return simhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target takes them (0 to 2 times), with all columns. A null source is a source, a null text has size 0, rows of one doc_id go together; an empty table gives an empty one."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token windows: a null or empty text is the end id alone, long ones are cut into whole windows first, copies are packed as often as they come; an empty table gives an empty one."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: Compression, edit joins and a tokenizer can't be expressed in DuckDB SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            delete(spark, before)
        before = f"{at}/{name}"
    return docs
