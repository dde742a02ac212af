"""Exact token length histogram, with answers for every context limit.

Defined cases: a null or empty text has length 0; every row counts, so repeated rows and null ids
need no care, and texts of any length are one row; rows of null length are left out of a
histogram; an empty table gives no rows; a column named like the length is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import CACHE_ENTRIES, CUT, read_ranks
from .common import chunks, written

#: Lengths that one window group of the suffix sums takes.
SPAN = 64


def encoded_lengths(docs: DataFrame, ranks: bytes, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_tokens`` (null or empty text: 0; a column of that name is replaced)."""
    carried = [c for c in docs.columns if c not in ("n_tokens", text_col)]
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("n_tokens", T.LongType())])
    payload = docs.sparkSession.sparkContext.broadcast(ranks)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = None, {}
        for batch, texts in chunks(batches, "__text"):
            encode = encode or tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(payload.value), special_tokens={}).encode_ordinary
            out = []
            for text in texts:
                n = 0
                for cut in CUT.split(text.decode()):
                    if (k := known.get(cut)) is None:
                        if len(known) >= CACHE_ENTRIES:
                            known.clear()
                        k = known[cut] = len(encode(cut))
                    n += k
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=[*carried, "n_tokens"])

    return docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text_col}`").alias("__text")).mapInArrow(count, schema)


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens", span: int = SPAN) -> DataFrame:
    """One row for each length that occurs, with suffix sums.

    n_tokens, n_docs; docs_at_least and tokens_at_least over documents of this length or more;
    docs_total and tokens_total; quantile, the share of documents up to this length; and
    truncated_total, the tokens left if every document is cut at this length. Rows of null length
    are left out; an empty table gives no rows. The sums are taken in spans of ``span`` lengths,
    then over the spans, so no window group holds more than ``span`` rows.
    """
    counts = lengths.where(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))
    counts = written(counts).withColumn("__span", F.floor(F.col("n_tokens") / span))
    spans = counts.groupBy("__span").agg(F.sum("n_docs").alias("__docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("__tokens"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("__span")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    spans = spans.select(
        "__span", F.coalesce(F.sum("__docs").over(above), F.lit(0)).alias("__docs_above"), F.coalesce(F.sum("__tokens").over(above), F.lit(0)).alias("__tokens_above"),
        F.sum("__docs").over(everything).alias("docs_total"), F.sum("__tokens").over(everything).alias("tokens_total"),
    )
    within = Window.partitionBy("__span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        counts.withColumn("__docs", F.sum("n_docs").over(within))
        .withColumn("__tokens", F.sum(F.col("n_docs") * F.col("n_tokens")).over(within))
        .join(spans, "__span")
    )
    docs, tokens = F.col("__docs") + F.col("__docs_above"), F.col("__tokens") + F.col("__tokens_above")
    return summed.select(
        "n_tokens", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"), "docs_total", "tokens_total",
        ((F.col("docs_total") - docs + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        (F.col("tokens_total") - tokens + docs * F.col("n_tokens")).alias("truncated_total"),
    )


def length_quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that at least ``share`` of the documents do not exceed: one row ``n_tokens``, null if there are no documents."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut at ``limit``, for any limit: one row ``truncated_total`` (no documents: 0)."""
    return histogram.agg(F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0)).alias("truncated_total"))
