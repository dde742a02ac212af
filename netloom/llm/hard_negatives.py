"""Hard negatives by slots of scores.

An anchor's positives are its best rows of the same label. Each positive's window takes the rows
of other labels whose score lies between two shares of the positive's own. The windows' upper
limits split the scores into disjoint slots: a slot reaches from one upper limit down to the next
smaller one. Every task keeps the best k rows of each slot (a combiner), and so does the exchange.
A window is the suffix of slots that begins at its upper limit: its best k are the first of the
slots' lists, in descending order, that reach its lower limit. One list answers all windows.

Anchors meet all rows in blocks: those of one block (``BLOCK_BYTES``) are broadcast, and every task
scores its rows against them as a matrix product. There are as many passes as blocks; what leaves
a task is k rows for each anchor and slot, and the exchange keeps k of them before it sorts.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part; shorter vectors are filled with zeros; scores beyond a long are cut to its limits; an
anchor row never has a row of its own id as a positive; repeated anchor rows are answered each,
repeated other rows count each; an anchor without positives, or a window without rows, gives no
rows; so does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import LOT, dimension, largest, matrix, whole

#: Bytes of anchors that are broadcast at once, and scores that a task holds at once.
BLOCK_BYTES, SCORES = 16 << 20, 1 << 20

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: a row for each anchor."""
    if largest(anchors) * largest(rows) * max(1, rows.shape[1]) < 1 << 53:
        return (anchors.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = anchors.astype(object) @ rows.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Best:
    """The best ``k`` of each group: higher scores first, ties by smaller id."""

    def __init__(self, groups: int, k: int) -> None:
        self.k, self.least = k, np.full(groups, _LEAST)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.least[group]
        if not may.any():
            return
        group, score, ids = (np.concatenate([a, b[may]]) for a, b in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, group))  # ~score falls as score rises, without overflow
        group, score, ids = group[order], score[order], ids[order]
        rank = np.arange(len(group)) - np.searchsorted(group, group)
        keep = rank < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.least[group[full]] = score[full]


def _ranked(rows: DataFrame, within: list[str], k: int) -> DataFrame:
    """The best ``k`` rows of each group with their rank from 1; Spark keeps k a task before the exchange."""
    order = Window.partitionBy(*within).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


Choose = Callable[[slice, np.ndarray, np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, np.ndarray]]]


def _scored(rows: DataFrame, block: dict[str, np.ndarray], dim: int, slots: int, k: int, choose: Choose) -> DataFrame:
    """``anchor``, ``slot``, ``id``, ``score``: each task's best ``k`` for the anchors of a block and its slots.

    choose: given some anchors, their scores, ids and labels of some rows, the numbers (within the
    scores) of those that count for each slot.
    """
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        best = Best(len(held["anchor"]) * slots, k)
        step = max(1, SCORES // LOT)
        for batch in batches:
            for first in range(0, batch.num_rows, LOT):
                part = batch.slice(first, LOT)
                ids, labels, x = np.asarray(part.column("id")), np.asarray(part.column("label")), matrix(part.column("x"), dim)
                for at in range(0, len(held["anchor"]), step):
                    some = slice(at, at + step)
                    score = scores(held["x"][some], x)
                    for slot, (a, r) in enumerate(choose(held, some, score, ids, labels)):
                        best.add((at + a) * slots + slot, score[a, r], ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(held["anchor"][best.group // slots]), pa.array((best.group % slots).astype(np.int32)), pa.array(best.id), pa.array(best.score)], names=["anchor", "slot", "id", "score"])

    return rows.select("id", "label", "x").mapInArrow(run, "anchor long, slot int, id long, score long")


def _same_label(held, some, score, ids, labels):
    yield np.nonzero((held["label"][some, None] == labels) & (held["id"][some, None] != ids))


def _in_slots(held, some, score, ids, labels):
    other = held["label"][some, None] != labels
    for slot in range(held["upper"].shape[1]):
        yield np.nonzero(other & (score <= held["upper"][some, slot, None]) & (score >= held["lower"][some, slot, None]))


def _block(anchors: DataFrame, dim: int) -> dict[str, np.ndarray]:
    table = anchors.select("anchor", "id", "label", "x").toArrow().combine_chunks()
    column = lambda c: table.column(c).combine_chunks()
    return {c: np.asarray(column(c)).astype(np.int64) for c in ("anchor", "id", "label")} | {"x": matrix(column("x"), dim)}


def _windows(positives: DataFrame, low: int, high: int) -> DataFrame:
    """Each positive's window: lower and upper limit of 100 * score, in whole scores; and its slot from 0, largest upper limit first."""
    share = lambda p: F.col("positive_score").cast("decimal(38,0)") * p / 100
    limits = positives.withColumn("lower", F.ceil(share(low)).cast("long")).withColumn("upper", F.floor(share(high)).cast("long")).where("lower <= upper")
    return limits.withColumn("slot", F.dense_rank().over(Window.partitionBy("anchor").orderBy(F.desc("upper"))) - 1)


def _answer(rows: DataFrame, anchors: DataFrame, dim: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Negatives of one block of anchors."""
    block = _block(anchors, dim)
    found = _ranked(_scored(rows, block, dim, 1, positives, _same_label), ["anchor"], positives)
    windows = written(_windows(found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), low, high))
    limits = windows.groupBy("anchor", "slot").agg(F.max("upper").alias("upper"), F.min("lower").alias("lower")).toArrow()
    at = np.searchsorted(block["anchor"], np.asarray(limits.column("anchor"))), np.asarray(limits.column("slot"))
    for name, empty in (("upper", _LEAST), ("lower", _MOST)):
        block[name] = np.full((len(block["anchor"]), positives), empty)
        block[name][at] = np.asarray(limits.column(name))
    kept = _ranked(_scored(rows, block, dim, positives, negatives, _in_slots), ["anchor", "slot"], negatives)
    lists = kept.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("list"))
    suffix = F.filter("list", lambda x: (x["slot"] >= F.col("slot")) & (x["score"] >= F.col("lower")))
    chosen = windows.join(lists, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "negative"))
    named = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return written(chosen.join(named, "anchor").select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("negative.id").alias("negative_id"), "positive_score", F.col("negative.score").alias("negative_score")))


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    is_anchor: which rows are anchors. label: a column of whole numbers. positives: rows of the same
    label for each anchor, the best. negatives: rows for each positive, the best whose score is
    between ``low`` and ``high`` hundredths of the positive's. Vectors are scaled to whole numbers.
    """
    labels = F.col(f"`{label}`") if isinstance(label, str) else label
    given = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), labels.cast("long").alias("label"), whole(F.col(f"`{vector_col}`"), scale).alias("x"), is_anchor.alias("chosen"))
    rows = given.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    anchors = written(rows.where("chosen").select("id", "label", "x", F.monotonically_increasing_id().alias("anchor")))
    dim, n = dimension(rows), anchors.count()
    blocks = max(1, -(-n * (dim + 3) * 8 // block_bytes))
    parts = [anchors.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b).orderBy("anchor") for b in range(blocks)]
    return reduce(DataFrame.unionByName, [_answer(rows, part, dim, positives, negatives, low, high) for part in parts])


def negatives_sql() -> str:
    """The registered query's rows of the table embeddings as SQL."""
    return """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.x, r.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows a JOIN rows r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""
