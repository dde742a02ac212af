"""Blocks of phrases that may hold equal windows, and texts cut by what is found in them.

Texts fall into content-defined phrases (phrases.py). All phrases with one anchor are a block;
equal windows always lie in the same block. A block's different phrases meet in one task, each
with one copy of its items and what is known of all its places (how many, least and greatest
id); what is found for a phrase then holds at all its places. So copies are counted, not moved.

A block with more than ``most`` different phrases (a passage with ever different surroundings)
is cut anew by longer anchors, again and again, in the end by anchors as long as the window: then
a block's phrases are copies of a window or runs of one item. So no task holds an unbounded block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written
from .phrases import Items, byte_items, byte_pieces, passes, word_items, word_pieces

#: Different phrases of a block that one task takes, and bytes of phrases that are looked at together.
MOST, SHARD_BYTES = 1500, 1 << 20
PLACE = ["__id", "__key"]


class Unit(NamedTuple):
    """What texts are made of."""

    items: Callable[[list[bytes]], Items]
    pieces: Callable[[bytes, int], Iterator[tuple[int, bytes]]]
    split: Callable[[bytes], Any]
    join: Callable[[Any], bytes]


WORDS = Unit(word_items, word_pieces, bytes.split, b" ".join)
BYTES = Unit(byte_items, byte_pieces, bytes, bytes)


def phrase_table(keyed: DataFrame, unit: Unit, width: int, gram: int, longest: int) -> DataFrame:
    """A row for each phrase of ``__text``: __id, __key, first, n, anchor, phrase, twice."""
    schema = T.StructType([keyed.schema["__id"], *T._parse_datatype_string("__key long, first int, n int, anchor long, phrase long, twice boolean").fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text", 8 << 20):
            for rows, begins, lot in passes(texts, unit.pieces, width):
                found = unit.items(lot).phrases(width, gram, longest)
                if len(found.n):
                    take = pa.array(rows[found.text])
                    columns = [batch.column("__id").take(take), batch.column("__key").take(take), *(pa.array(x) for x in ((found.first + begins[found.text]).astype(np.int32), found.n.astype(np.int32), found.anchor.view(np.int64), found.phrase.view(np.int64), found.twice))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return keyed.select(*PLACE, "__text").mapInArrow(cut, schema)


def segment_table(texts: DataFrame, entries: DataFrame, unit: Unit, width: int) -> DataFrame:
    """``entries`` with the items that their windows cover: anchor, phrase, copies, least, greatest, at, segment."""
    schema = T.StructType([*entries.select("anchor", "phrase", "copies", "one.__id", "greatest", "one.first").schema.fields, T.StructField("segment", T.BinaryType())])
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(("anchor", "phrase", "copies", "least", "greatest", "at", "segment"), schema.fields, strict=True)])
    picks = entries.groupBy(F.col("one.__id").alias("__id"), F.col("one.__key").alias("__key")).agg(F.collect_list(F.struct("anchor", "phrase", "copies", F.col("one.__id").alias("least"), "greatest", F.col("one.first").alias("at"), F.col("one.n").alias("n"))).alias("__picks"))
    wide = beside(texts, picks, "inner")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch, found in chunks(batches, "__text", 4 << 20):
            rows, parts = [], []
            keys = zip(batch.column("__id").to_pylist(), batch.column("__key").to_pylist(), strict=True)
            picked = batch.column("__picks")
            offsets = np.asarray(picked.offsets) - picked.offsets[0].as_py()
            flat = pa.RecordBatch.from_struct_array(picked.flatten())
            at, n = (np.asarray(flat.column(c)).tolist() for c in ("at", "n"))
            for i, (key, text) in enumerate(zip(keys, found, strict=True)):
                if key == before:  # rows that agree in id and text stand side by side: one of them will do
                    continue
                before, items = key, unit.split(text)
                for k in range(offsets[i], offsets[i + 1]):
                    rows.append(k)
                    parts.append(unit.join(items[at[k] : at[k] + n[k] - 1 + width]))
            out = flat.select(["anchor", "phrase", "copies", "least", "greatest", "at"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(parts, pa.binary())], names=schema.names)

    return wide.mapInArrow(cut, schema)


def cut_anew(segments: DataFrame, unit: Unit, width: int, gram: int, longest: int) -> DataFrame:
    """Phrases of ``segments`` by anchors of ``gram`` items: the columns of segments, with __anchor, __phrase (where it is from) and __off."""
    names = segments.columns
    schema = T.StructType([*segments.schema.fields, *T._parse_datatype_string("__anchor long, __phrase long, __off int").fields])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "segment", 1 << 20):
            for rows, begins, lot in passes(texts, unit.pieces, width):
                found = unit.items(lot).phrases(width, gram, longest)
                if len(found.n):
                    whole = [unit.split(x) for x in lot]
                    off = (found.first + begins[found.text]).astype(np.int32)
                    out = batch.take(pa.array(rows[found.text]))
                    new = {"anchor": pa.array(found.anchor.view(np.int64)), "phrase": pa.array(found.phrase.view(np.int64)), "at": pa.array((np.asarray(out.column("at")) + off).astype(np.int32))}
                    new["segment"] = pa.array([unit.join(whole[t][a : a + n - 1 + width]) for t, a, n in zip(found.text.tolist(), found.first.tolist(), found.n.tolist(), strict=True)], pa.binary())
                    columns = [new.get(c, out.column(c)) for c in names]
                    yield pa.RecordBatch.from_arrays([*columns, out.column("anchor"), out.column("phrase"), pa.array(off)], names=schema.names)

    return segments.mapInArrow(cut, schema)


def in_shards(segments: DataFrame, judge: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, shard_bytes: int) -> DataFrame:
    """What ``judge`` finds in whole blocks, about ``shard_bytes`` of them together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # begins with a block's first segment
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows:
                sizes = np.cumsum(np.asarray(pa.compute.binary_length(held.column("segment"))))
                anchors = np.asarray(held.column("anchor"))
                edges = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
                full = edges[sizes[edges - 1] >= shard_bytes]
                if not len(full):
                    break
                yield judge(held.slice(0, int(full[0])).combine_chunks().to_batches()[0])
                held = held.slice(int(full[0]))
        if held is not None and held.num_rows:
            yield judge(held.combine_chunks().to_batches()[0])

    return segments.repartition("anchor").sortWithinPartitions("anchor", "least", "at").mapInArrow(run, schema)


def searched(texts: DataFrame, unit: Unit, width: int, gram: int, longest: int, shared: Callable[[DataFrame], DataFrame], judge: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType, most: int = MOST, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What is found at all places: __id, __key, place (of the phrase's first item), and the columns of ``schema``.

    texts: __id, __key, __text. shared: the anchors among phrases whose blocks can hold equal
    windows. judge: rows of ``schema`` (anchor, phrase, ...) for whole blocks of segments.
    """
    phrases = written(phrase_table(texts, unit, width, min(gram, width), longest))
    places = written(phrases.join(shared(phrases), "anchor"))
    entries = places.groupBy("anchor", "phrase").agg(F.count("*").alias("copies"), F.max("__id").alias("greatest"), F.min(F.struct("__id", "__key", "first", "n")).alias("one"))
    segments = written(segment_table(texts, entries, unit, width))
    places = places.select(*PLACE, F.col("first").alias("place"), "anchor", "phrase")
    out = None
    for longer in (width // 2, width * 4 // 5, width, None):
        cold = segments
        if longer is not None:
            hot = written(segments.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > most).select("anchor"))
            again = not hot.isEmpty()
            if again:
                cold = segments.join(hot, "anchor", "left_anti")
        found = in_shards(cold, judge, schema, shard_bytes)
        found = places.join(found, ["anchor", "phrase"])
        out = found if out is None else out.unionByName(found)
        if longer is None or not again:
            return out
        anew = written(cut_anew(segments.join(hot, "anchor", "left_semi"), unit, width, max(longer, min(gram, width)), longest))
        inner = anew.select(F.col("__anchor").alias("a"), F.col("__phrase").alias("p"), "__off", F.col("anchor").alias("anchor2"), F.col("phrase").alias("phrase2"))
        places = written(places.join(inner, (F.col("anchor") == F.col("a")) & (F.col("phrase") == F.col("p"))).select(*PLACE, (F.col("place") + F.col("__off")).alias("place"), F.col("anchor2").alias("anchor"), F.col("phrase2").alias("phrase")))
        one = F.min(F.struct("least", "at", "segment")).alias("one")
        segments = written(anew.groupBy("anchor", "phrase").agg(F.sum("copies").alias("copies"), one, F.max("greatest").alias("greatest")).select("anchor", "phrase", "copies", "one.least", "greatest", "one.at", "one.segment"))
    raise AssertionError


def beside(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` joined with the row of ``right`` that has its __id and __key."""
    right = right.withColumnsRenamed({"__id": "__rid", "__key": "__rkey"})
    return left.join(right, (left["__key"] == right["__rkey"]) & left["__id"].eqNullSafe(right["__rid"]), how).drop("__rid", "__rkey")


def covered(marks: Iterable[tuple[int, int]], width: int, size: int) -> list[tuple[int, int]]:
    """Maximal runs of items covered by windows; marks: first window and how many."""
    runs: list[list[int]] = []
    for first, n in sorted(marks):
        last = min(first + n - 1 + width, size)
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


class Texts:
    """Texts with keys that marks can be joined to; rows that agree in id and text have the same key."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, unit: Unit, digests: bool, carry: list[str] | None) -> None:
        self.unit, self.digests = unit, digests
        words = unit is WORDS
        total = "n_words" if words else "n_bytes"
        results = [total, "n_removed", "n_spans", "kept_sha256"] if digests else [total, "n_removed", "n_spans", "spans", "kept_text"]
        carried = [c for c in (docs.columns if carry is None else carry) if c not in results]
        kinds = {total: "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "spans": "array<struct<start:int,stop:int>>", "kept_text": "string" if words else "binary"}
        self.added = {c: kinds[c] for c in results}
        self.renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
        #: The texts' column: the carried one if there is one, so that no text is moved twice.
        self.text = self.renamed.get(text_col, "__text")
        text = F.col(f"`{text_col}`")
        own = [] if text_col in self.renamed else [text.alias("__text")]
        self.rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in self.renamed.items()), *own, F.col(f"`{id_col}`").alias("__id"), F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(text, F.lit(""))).alias("__key"))

    def keyed(self) -> DataFrame:
        """__id, __key and __text."""
        return self.rows.select(*PLACE, F.col(self.text).alias("__text"))

    def cut(self, marks: DataFrame, width: int) -> DataFrame:
        """The rows without the items that windows at ``marks`` (__id, __key, first, n) cover."""
        unit, digests, words, text_name = self.unit, self.digests, self.unit is WORDS, self.text
        carried = list(self.renamed.values())
        wide = beside(self.rows, marks.groupBy(*PLACE).agg(F.collect_set(F.struct("first", "n")).alias("__marks")), "left")
        schema = T.StructType([*(wide.schema[c] for c in carried), *(T.StructField(c, T._parse_datatype_string(kind)) for c, kind in self.added.items())])
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        own = text_name == "__text"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in chunks(batches, text_name, 8 << 20):
                rows = []
                for text, marks in zip(texts, batch.column("__marks").to_pylist(), strict=True):
                    items = unit.split(text)
                    runs = covered([(m["first"], m["n"]) for m in marks or ()], width, len(items))
                    kept = text
                    if runs or words:
                        parts = [items[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(items)], strict=True)]
                        kept = unit.join([w for part in parts for w in part]) if words else b"".join(parts)
                    common = (len(items), sum(b - a for a, b in runs), len(runs))
                    # texts that stay whole aren't carried twice
                    rows.append((*common, hashlib.sha256(kept).hexdigest()) if digests else (*common, [{"start": a, "stop": b} for a, b in runs], None if not own and not runs and kept == text else kept.decode() if words else kept))
                kinds = [pa.int64()] * 3 + ([pa.string()] if digests else [spans, pa.string() if words else pa.binary()])
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], names=schema.names)

        done = wide.select(*carried, *(["__text"] if own else []), "__marks").mapInArrow(run, schema)
        added = {c: F.col(c) for c in self.added}
        if "kept_text" in added and not own:
            whole = F.coalesce(F.col(text_name), F.lit(""))
            added["kept_text"] = F.coalesce("kept_text", whole if words else whole.cast("binary"))
        return done.select(*(F.col(n).alias(c) for c, n in self.renamed.items()), *(v.alias(c) for c, v in added.items()))
