"""Substring deduplication by relative Lempel-Ziv parsing over words.

Every document is reference text for those with larger ids. The reference is indexed in blocks:
a block holds the different phrases of one anchor, each with the least id that has it and the
place there (see blocks.py). Each phrase is parsed from left to right against its block: where
the next ``width`` words also start in reference text of a smaller id, the index names the place
with the least id, and the factor is extended from there as far as the words agree. A factor is
(start, length, block, offset) and has at least ``width`` words. The parse goes on at the first
window that crosses the factor's end, so windows across a boundary are looked up like all others,
and exactly those windows lie in factors whose word sequence also starts in a smaller id.

A phrase at further places than its first is a factor as a whole. So copies, however many, are
parsed once; windows are compared by 128-bit hashes, phrases by their anchor and 64 bits.

Defined cases: a null text has no words; a null id is neither smaller nor larger than another, so
such rows stay whole and are no reference; rows with the same id and text are treated alike and
are no reference for each other; an empty table gives no rows; other columns are carried along,
and a column named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import MOST, SHARD_BYTES, WORDS, Texts, searched
from .phrases import word_items

#: Words of a gram that can be an anchor, and windows that a phrase has at most.
GRAM, LONGEST = 8, 128


def parse(segments: list[bytes], ids: np.ndarray, width: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """Factors of segments (words joined by a space) against those with smaller ids: segment, start and windows, and the segment and place they are found at."""
    part = word_items(segments)
    n = part.end - part.begin - width + 1
    base = np.cumsum(n) - n
    seg = np.repeat(np.arange(len(n)), n)
    one, two = part.window_hashes(np.arange(n.sum()) - base[seg] + part.begin[seg], width)
    order = np.lexsort((ids[seg], two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    number, entry = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)  # equal windows have equal numbers
    entry[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]  # the index: the window with the least id
    hits = np.flatnonzero(ids[seg[entry]] < ids[seg])
    stop = (base + n)[seg]
    rows, starts, counts, sources, offsets = [], [], [], [], []
    at = 0
    while at < len(hits):
        p = int(hits[at])
        q = int(entry[p])
        most = int(min(stop[p] - p, stop[q] - q))
        differ = np.flatnonzero(number[p : p + most] != number[q : q + most])
        m = int(differ[0]) if len(differ) else most
        rows.append(int(seg[p]))
        starts.append(p - int(base[seg[p]]))
        counts.append(m)
        sources.append(int(seg[q]))
        offsets.append(q - int(base[seg[q]]))
        at = int(np.searchsorted(hits, p + m))
    return rows, starts, counts, sources, offsets


def _factors(texts: DataFrame, width: int, most: int, shard_bytes: int) -> DataFrame:
    """__id, __key, start, n (windows), block and offset of all factors."""
    id_type = texts.schema["__id"].dataType
    schema = T.StructType([*T._parse_datatype_string("anchor long, phrase long, later boolean").fields, T.StructField("least", id_type), *T._parse_datatype_string("start int, n int").fields, T.StructField("block", id_type), T.StructField("offset", T.IntegerType())])

    def shared(phrases: DataFrame) -> DataFrame:
        return phrases.groupBy("anchor").agg(F.min("__id").alias("a"), F.max("__id").alias("b")).where("a < b").select("anchor")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        segments = [x.as_py() for x in batch.column("segment")]
        ids = np.asarray(pc.rank(batch.column("least"), tiebreaker="dense")).astype(np.int64)
        rows, starts, counts, sources, offsets = parse(segments, ids, width)
        # places after the first one: the phrase itself is the reference
        again = np.flatnonzero(np.asarray(pc.greater(batch.column("greatest"), batch.column("least")))).tolist()
        later = [False] * len(rows) + [True] * len(again)
        rows, sources = rows + again, sources + again
        starts, offsets = starts + [0] * len(again), offsets + [0] * len(again)
        counts = counts + [len(segments[k].split()) - width + 1 for k in again]
        own, source = batch.take(pa.array(rows, pa.int64())), batch.take(pa.array(sources, pa.int64()))
        offset = np.asarray(source.column("at")) + np.array(offsets, np.int32)
        return pa.RecordBatch.from_arrays([own.column("anchor"), own.column("phrase"), pa.array(later, pa.bool_()), own.column("least"), pa.array(starts, pa.int32()), pa.array(counts, pa.int32()), source.column("least"), pa.array(offset.astype(np.int32))], names=schema.names)

    found = searched(texts.where("__id IS NOT NULL"), WORDS, width, GRAM, LONGEST, shared, judge, schema, most, shard_bytes)
    return found.where("later = (__id > least)").select("__id", "__key", (F.col("place") + F.col("start")).alias("start"), "n", "block", "offset")


def lz_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Factors of the documents: id, start and length (in words), block (the id whose text holds the factor) and offset there.

    A factor ends where its phrase does, at the latest; the next one overlaps it by width - 1 words.
    """
    texts = Texts(docs, id_col, text_col, WORDS, True, [])
    found = _factors(texts.keyed(), width, most, shard_bytes)
    return found.select(F.col("__id").alias(id_col), "start", (F.col("n") + width - 1).alias("length"), "block", "offset").distinct()


def relative_lz(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, digests: bool = False, carry: list[str] | None = None, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with the words taken out that a window of ``width`` words shared with a smaller id covers.

    Adds n_words, n_removed, n_spans, spans (array of start and stop, in words) and kept_text, or
    with ``digests`` kept_sha256 instead of the last two. carry: the columns of ``docs`` to keep
    (all). Blocks of more than ``most`` phrases are cut anew, ``shard_bytes`` are parsed together.
    """
    texts = Texts(docs, id_col, text_col, WORDS, digests, carry)
    return texts.cut(_factors(texts.keyed(), width, most, shard_bytes).select("__id", "__key", F.col("start").alias("first"), "n"), width)
