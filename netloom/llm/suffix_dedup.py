"""Removal of byte strings that also start anywhere else, by suffix arrays.

Texts are cut into content-defined phrases, dealt out in blocks (see blocks.py), so that all
strings of ``width`` bytes that can be equal come together. Every task sorts the suffixes of its
blocks by inducing (see induced.py), a shard at a time: one copy of each different phrase. A
suffix of a phrase that stands at several places is one entry of the array with a count, as all
its copies would be neighbours. A string is repeated if its suffix shares ``width`` bytes with a
neighbour in the suffix array, or is counted more than once. A phrase that makes up its block has
no neighbours but its copies, so it needs no sorting.

Defined cases: a null text is empty; every row counts, so repeated rows are removed in both
places, whatever their ids, null ones included; an empty table gives no rows; other columns are
carried along, and a column named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BYTES, MOST, SHARD_BYTES, Texts, searched
from .induced import repeated_windows

#: Bytes of a gram that can be an anchor, and windows that a phrase has at most.
GRAM, LONGEST = 32, 1024


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 400, digests: bool = False, carry: list[str] | None = None, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with each byte taken out that a string of ``width`` bytes covers which also starts anywhere else.

    Adds n_bytes, n_removed, n_spans, spans (array of start and stop, in bytes) and kept_text
    (binary), or with ``digests`` kept_sha256 instead of the last two. carry: the columns of
    ``docs`` to keep (all). width: 8 or more. Blocks of more than ``most`` phrases are cut anew,
    ``shard_bytes`` are sorted together.
    """
    texts = Texts(docs, id_col, text_col, BYTES, digests, carry)
    schema = T._parse_datatype_string("anchor long, phrase long, start int, n int")

    def shared(phrases: DataFrame) -> DataFrame:
        return phrases.groupBy("anchor").agg(F.count("*").alias("a"), F.max("twice").alias("b")).where("a > 1 OR b").select("anchor")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, starts, counts = [], [], []
        segments = [x.as_py() for x in batch.column("segment")]
        copies, anchors = np.asarray(batch.column("copies")), np.asarray(batch.column("anchor"))
        block = np.concatenate([[True], anchors[1:] != anchors[:-1], [True]])
        alone = block[:-1] & block[1:] & (copies > 1)
        found = iter(repeated_windows([x for x, one in zip(segments, alone.tolist(), strict=True) if not one], width))
        for row, (n, one) in enumerate(zip(copies.tolist(), alone.tolist(), strict=True)):
            twice = None if one else next(found)
            if n > 1:
                twice = np.ones(len(segments[row]) - width + 1, bool)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], twice.astype(np.int8), [0]])))
            rows += [row] * (len(edges) // 2)
            starts += edges[::2].tolist()
            counts += (edges[1::2] - edges[::2]).tolist()
        take = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("anchor").take(take), batch.column("phrase").take(take), pa.array(starts, pa.int32()), pa.array(counts, pa.int32())], names=schema.names)

    found = searched(texts.keyed(), BYTES, width, max(min(GRAM, width // 2), 8), LONGEST, shared, judge, schema, most, shard_bytes)
    return texts.cut(found.select("__id", "__key", (F.col("place") + F.col("start")).alias("first"), "n"), width)
