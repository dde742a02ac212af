"""SimHash fingerprints, and near duplicates among them by BK-trees.

Fingerprints at most ``radius`` bits apart agree in at least two of radius + 2 blocks of bits, so
each distinct fingerprint goes to one shard for each pair of blocks, keyed by their bits. A shard
holds a BK-tree: children are keyed by their integer Hamming distance to the parent, and a search
follows only edges within the radius of the distance at hand. A shard with more than ``MOST``
fingerprints is dealt out again by pairs of parts of its other bits, so that hot shards get small.
Trees are built where their shard is; only distinct fingerprints and a spanning forest of
their links leave a task, so copies cost nothing. Trees are not broadcast: together they grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written
from .components import components

#: Fingerprints of a shard above which it is dealt out again.
MOST = 400


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits, each set if over half the shingles' hashes have it; no words: 0."""
    words = text.lower().split()  # bytes: lowers A to Z, splits at the six spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    k = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops[k:], strict=False)], "<u8")
    return int.from_bytes(np.packbits(_bit_counts(hashes) * 2 > len(hashes), bitorder="little").tobytes(), "little")


#: Number of hashes with each bit, by adding bytes spread over 64-bit words, 255 at a time.
_SPREAD = np.array([int.from_bytes(bytes((b >> i) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):
        part = _SPREAD[hashes[at : at + 255].view(np.uint8).reshape(-1, 8)].sum(axis=0, dtype=np.uint64)
        total += part.view(np.uint8)
    return total


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fp`` (long, the 64 bits as signed); null texts count as empty."""
    carried = [c for c in (docs.columns if carry is None else carry) if c != "fp"]
    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text", 8 << 20):
            found = np.array([fingerprint(x, shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in carried), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


class BKTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.items: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, item: int) -> None:
        self.items.append(item)
        self.children.append({})
        new, at = len(self.items) - 1, 0
        while new:
            distance = (self.items[at] ^ item).bit_count()
            below = self.children[at].setdefault(distance, new)
            if below == new:
                return
            at = below

    def within(self, item: int, radius: int) -> list[int]:
        """Places of the items at most ``radius`` bits away."""
        found, open_ = [], [0] if self.items else []
        while open_:
            at = open_.pop()
            distance = (self.items[at] ^ item).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            for d in range(max(distance - radius, 0), distance + radius + 1):
                if (below := children.get(d)) is not None:
                    open_.append(below)
        return found


def forest(items: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever links of at most ``radius`` bits connect among the items."""
    tree, root = BKTree(), list(range(len(items)))
    for i, item in enumerate(items):
        for j in tree.within(item, radius):
            a = i
            while root[a] != a:
                a = root[a]
            while root[j] != j:
                root[j] = root[root[j]]
                j = root[j]
            if a != j:
                root[a] = j
                yield item, items[j]
        tree.add(item)


def _keys(bits: Column, spans: list[tuple[int, int]], tag: Column) -> Column:
    """An array of shard keys, one for each pair of spans (first bit, width) of ``bits``."""
    parts = [F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in spans]
    return F.array(*(F.xxhash64(tag, F.lit(i), parts[a], parts[b]) for i, (a, b) in enumerate(combinations(range(len(parts)), 2))))


def _spans(first: int, width: int, n: int) -> list[tuple[int, int]]:
    edges = [first + width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def shard_links(distinct: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """Links u, v (a spanning forest of each shard) between distinct fingerprints ``fp``."""
    n = radius + 2
    blocks = _spans(0, 64, n)
    pairs = list(combinations(range(n), 2))
    rows = distinct.select("fp", F.posexplode(_keys(F.col("fp"), blocks, F.lit(0))).alias("pair", "key"))
    rows = rows.withColumn("key", F.xxhash64("pair", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, "key")
    # of a hot shard, the bits outside its pair of blocks: again two of n parts must agree
    rest = F.lit(None).cast("array<bigint>")
    for i, (a, b) in enumerate(pairs):
        others = [part for k in range(n) if k not in (a, b) for part in _spans(*blocks[k], -(-n // (n - 2)))]
        while len(others) < n:
            others.append(others[-1])
        rest = F.when(F.col("pair") == i, _keys(F.col("fp"), others, F.col("key"))).otherwise(rest)
    rows = rows.withColumn("key", F.explode(F.when(F.col("size") > most, rest).otherwise(F.array("key"))))

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for last, batch in _and_last(batches):
            keys = np.concatenate([keys, np.asarray(batch.column("key"))])
            fps = np.concatenate([fps, np.asarray(batch.column("fp"))])
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            whole = edges if last else edges[:-1]
            sizes = np.diff(whole)
            # a shard of two is a root and a child
            two = whole[:-1][sizes == 2]
            close = two[np.bitwise_count((fps[two] ^ fps[two + 1]).view(np.uint64)) <= radius] if len(two) else two
            u, v = fps[close].tolist(), fps[close + 1].tolist()
            for at, size in zip(whole[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for a, b in forest(fps[at : at + size].view(np.uint64).tolist(), radius):
                    u.append(a - (1 << 64) if a >> 63 else a)
                    v.append(b - (1 << 64) if b >> 63 else b)
            keys, fps = keys[whole[-1] :], fps[whole[-1] :]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(link, "u long, v long")


def _and_last(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    before = None
    for batch in batches:
        if before is not None:
            yield False, before
        before = batch
    if before is not None:
        yield True, before


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, seed: int = 42, carry: list[str] | None = None, most: int = MOST) -> DataFrame:
    """``docs`` with fingerprint (16 hexadecimal digits) and component_id, the least id reachable by links.

    Defined cases: null and empty texts have fingerprint zero and are linked like any other; a null
    id is never least (a group of null ids alone has component_id null); repeated rows are copies;
    an empty table gives no rows; columns named like an output are replaced.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c not in ("fingerprint", "component_id")]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = written(fingerprints(keyed, "__text", shingle, seed, [*renamed.values(), "__id"]))
    classes = written(rows.groupBy("fp").agg(F.min("__id").alias("least")))
    roots = components(shard_links(classes.select("fp"), radius, most))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = linked.join(least, "root").select("fp", "component_id")
    return rows.join(of_class, "fp").select(*(F.col(n).alias(c) for c, n in renamed.items()), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
