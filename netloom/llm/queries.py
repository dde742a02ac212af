"""Registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe as bpe_op
from . import token_counts
from .hard_negatives import hard_negatives, negatives_sql
from .histogram_sort import shard_documents
from .html_text import extract_text
from .mixing import Mix
from .pivots import near_vectors
from .quality import quality
from .relative_lz import relative_lz
from .reputation import filter_sql, filter_urls
from .simhash import simhash_groups
from .suffix_dedup import suffix_dedup
from .tables import table
from .whitening import whiten

#: Vocabulary of the tokenizing queries.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a window of 50 words shared with a smaller doc_id covers, removed: one row a row of documents. Null texts have no words; rows of null ids stay whole and are no reference; see relative_lz.py."""
    return relative_lz(table(spark, sf_dir, "documents").select("doc_id", "text"), width=50, digests=True, carry=["doc_id"])


def op2_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, near equal bytes (law ``bytes``). Null texts have no bytes (size 1, crc 0); rows that agree are told apart by an arbitrary row number; see histogram_sort.py."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), n_shards=8, carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every row and the least doc_id that links of up to two bits reach. Null and empty texts have fingerprint zero; null ids are never least; see simhash.py."""
    return simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3, radius=2, seed=42, carry=["doc_id"])


def op4_token_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each token length that occurs, with totals for every context limit. Null and empty texts have length 0; no documents, no rows; see token_counts.py."""
    docs = table(spark, sf_dir, "documents").select("text")
    lengths = token_counts.encoded_lengths(docs, Path(VOCABULARY).read_bytes(), public_tokenizers.PATTERN)
    return token_counts.length_histogram(lengths)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that a string of 400 bytes covers which also starts anywhere else, removed: one row a row of documents. Null texts are empty; repeated rows go in all places; see suffix_dedup.py."""
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), width=400, digests=True, carry=["doc_id"])


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes of pages from the table labels, whose ids pages share: bad if of low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or reputation verdict of every page. Null urls have an empty host and path; null and repeated ids are judged like any other; see reputation.py."""
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), page_outcomes(table(spark, sf_dir, "labels")), carry=["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op7_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every row. Null texts have size 0; null sources are one source, last; see mixing.py."""
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), carry=["doc_id"]).documents()


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every row. Null and empty texts have no words and fail the base; null languages and sources are groups; see quality.py."""
    judged = quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of every row's ids and of their decoded bytes. Null and empty texts have no ids; see bpe.py."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_op.bpe(docs, Path(VOCABULARY).read_bytes(), public_tokenizers.PATTERN, digests=True, carry=["doc_id"])


def op10_pivot_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null, zero and non-finite vectors link with nothing; rows of one id are separate vectors; see pivots.py."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95, carry=["vec_id"])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best negatives of each positive's window, for all anchors against all rows. Rows with a null id, label, vector or component, or a non-finite one, take no part; see hard_negatives.py."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), F.col("vec_id") % 100 == 0, label=label)


def op12_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty pages have an empty text; pages with a null url are judged alone; see html_text.py."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), carry=["page_id", "url"])


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of every vector without null or non-finite entries; see whitening.py."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=4, carry=["vec_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_relative_lz_dedup": op1_relative_lz_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op2_histogram_sort_shards": op2_histogram_sort_shards,
    "op3_simhash_bk_tree": op3_simhash_bk_tree,
    "op4_token_length_histogram": op4_token_length_histogram,
    "op6_url_reputation": op6_url_reputation,
    "op7_golden_ratio_mix": op7_golden_ratio_mix,
    "op8_robust_quality": op8_robust_quality,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_pivot_permutation_index": op10_pivot_permutation_index,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_consensus_extraction": op12_consensus_extraction,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op6_url_reputation": filter_sql(), "op11_hard_negatives": negatives_sql()}
