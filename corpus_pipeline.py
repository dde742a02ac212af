"""The corpus pipeline: stages over documents, each calling one text operator.

Every stage takes (spark, docs, sf_dir) and returns the columns of documents, but the last, which
returns each document's ids. Extra columns of documents are carried along. A stage begins when
what the one before returned has been written, so it deletes the scratch tables of that one (and
no others). Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column
names are treated as each stage's operator defines them: a null or empty text has no words and
fails the quality rules; of rows that share the least id of a group of near copies one stays;
a null text stays null; a document that the mix doesn't take is left out; no text has no ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.bpe import bpe
from netloom.llm.common import collecting, drop, written
from netloom.llm.mixing import Mix
from netloom.llm.near_copies import near_copies
from netloom.llm.quality import quality
from netloom.llm.suffix_dedup import suffix_dedup


_scratch: list[str] = []
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """Drops what the stage before wrote to scratch, and notes what this one writes."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _scratch)
        with collecting(_scratch):
            return f(spark, docs, sf_dir)

    return run_stage


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` in the given columns, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and aren't outliers of their language and source."""
    return quality(docs).where("kept").select(*docs.columns)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the least id; of rows that share it, one (null ids alone: one of each group)."""
    return near_copies(docs, first=("lang", "source")).select(*docs.columns)


#: Bytes that a repeated string has at least: on sf0.1, 99 % of all runs of 51 words take more, in each language.
REPEATED = 220


@_stage
def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that repeat anywhere; where a cut splits a character, its rest goes too."""
    cut = suffix_dedup(docs, width=REPEATED)
    left = F.col("kept_text").cast("string")
    text = F.when(F.is_valid_utf8(left), left).otherwise(F.translate(F.make_valid_utf8(left), "\ufffd", ""))
    return _with_text(cut.withColumn("text", F.when(F.col("text").isNotNull(), text)), docs.columns)


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document is taken, cut where it is taken in part."""
    return _with_text(Mix(docs).texts(), docs.columns)


@_stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether they decode to its text."""
    vocabulary = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    encoded = bpe(docs, vocabulary, public_tokenizers.PATTERN, remember=200_000, lot_bytes=2 << 20)
    text = F.coalesce("text", F.lit(""))
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        (F.sha2("decoded", 256) == F.sha2(text.cast("binary"), 256)).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Some stages are iterative, so no SQL gives the rows of run().
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each stage keeps is written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
