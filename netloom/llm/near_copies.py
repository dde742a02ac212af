"""Groups of documents whose sets of word shingles are alike by exact Jaccard similarity.

First SimHash fingerprints at most ``RADIUS`` bits apart are linked by the BK-trees of simhash.py.
They find the near copies that differ least; what they can't promise is completed by shards of keys.
A document's shingles are hashed to 64 bits, as in simhash.py. Sets of n shingles that reach the
similarity share one among their first n - ceil(similarity * n) + 1 each, in whatever order all
sets are read, so shards keyed by those lose no pair. Shingles are read by hash, those that are
known to be frequent last, so a common passage makes no shard of texts that share nothing else.
Which ones are frequent is counted on a hashed share of the texts, as the order has no part in
what is found, only in how many pairs are looked at. Keys that one set has alone are left out
before anything else travels with them.

In a shard, pairs whose sizes allow the similarity and whose parities (see ``parities``) don't rule
it out are candidates, and a task that holds both texts counts the shingles that they share.
Each set is held against the one before it and the first one of every shard, along with the links of
the trees, then against all sets that this has not joined with it. There, rows of a shard's commonest
group meet only the rows of other groups, so a large group of near copies costs links, not pairs.
There, a pair is left to the shard of the first key that its sets share: see ``fit``.

Equal sets are one class throughout; their equality is by 64 bits of hash, as the shingles' is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, written
from .components import components
from .simhash import _and_last, _bit_counts, shard_links

#: Bits in which fingerprints may differ that the trees link.
RADIUS = 2
#: Bits of a set's parities; sets of more shingles than that are sampled for them. Standard deviations that a sample is given.
PARITIES, DEVIATIONS = 512, 10
WORDS = [f"s{i}" for i in range(PARITIES // 64)]
#: One text in SHARE is counted; shingles of over OFTEN of them are read last, of too many the MOST_FREQUENT (8 bytes each, broadcast).
SHARE, OFTEN, MOST_FREQUENT = 8, 2, 2_000_000
#: Pairs that are looked at in one go, and sets of a shard up to which its pairs are looked at with those of others.
LOT, SMALL = 4_000_000, 32
#: Pairs whose parities are compared in one go.
COMPARED = 1 << 17


def shingle_set(text: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """The different hashes of a text's shingles, ascending; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    k = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops[k:], strict=False)), np.uint64))


def among(found: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Which hashes of ``found`` are in ``given``, ascending: each is looked up, so a text doesn't cost all that is given."""
    return given[np.minimum(np.searchsorted(given, found), len(given) - 1)] == found if len(given) else np.zeros(len(found), bool)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets have at least this Jaccard similarity; two empty ones have."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def sampling(size: np.ndarray) -> np.ndarray:
    """For each size of a set the number of zero bits that a shingle's hash begins with to count for the parities."""
    size = np.asarray(size)
    return np.where(size <= PARITIES, 0, np.ceil(np.log2(np.maximum(size, 1))) - np.log2(PARITIES // 2)).astype(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """PARITIES bits as 64-bit words: whether an odd number of the set's hashes ends with each number.

    Two sets' bits differ in at most as many places as there are shingles that one of them has
    alone. So a pair whose bits differ in more than the similarity allows is ruled out for certain.
    Of a set of more than PARITIES shingles a sample by hash is counted, of at most half as many.
    """
    zeros = int(sampling(np.array(len(found))))
    if zeros:
        found = found[found >> np.uint64(64 - zeros) == 0]
    odd = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def most_apart(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Places in which the parities of similar sets of these sizes may differ; of sets that are sampled in different ways, all.

    For samples it is the expected number and DEVIATIONS standard deviations: a similar pair goes
    beyond with a chance below 1e-14 by Chernoff's bound, as small as that of equal hashes.
    """
    zeros = sampling(a)
    alone = (100 - percent) * (a + b) // (100 + percent)
    expected = alone / 2.0**zeros
    return np.where(zeros != sampling(b), PARITIES, np.where(zeros == 0, alone, expected + DEVIATIONS * np.sqrt(expected)))


def frequent(docs: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """Hashes of frequent shingles of ``docs`` (with __text), ascending: at most MOST_FREQUENT."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text", 1 << 20):
            found = np.concatenate([shingle_set(x, shingle, seed) for x in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["key"])

    counted = docs.select("__text", F.xxhash64("__text").alias("h")).where(F.pmod("h", F.lit(SHARE)) == 0).dropDuplicates(["h"]).select("__text").mapInArrow(run, "key long")
    often = counted.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(MOST_FREQUENT)
    return np.sort(np.asarray(often.select("key").toArrow().column("key").combine_chunks()).view(np.uint64))


def described(docs: DataFrame, shingle: int, percent: int, seed: int) -> DataFrame:
    """``docs`` (with __text) and of each set: cls (its hash), fp (fingerprint), size, keys (its first hashes) and the words of its parities."""
    late = docs.sparkSession.sparkContext.broadcast(frequent(docs, shingle, seed))
    extra = [T.StructField("cls", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(c, T.LongType()) for c in WORDS)]
    schema = T.StructType([*docs.schema.fields, *extra])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text", 4 << 20):
            cls, fps, sizes, keys, odd = [], [], [], [], []
            for text in texts:
                found = shingle_set(text, shingle, seed)
                cls.append(xxhash.xxh64_intdigest(found.tobytes(), seed))
                fps.append(int.from_bytes(np.packbits(_bit_counts(found) * 2 > len(found), bitorder="little").tobytes(), "little"))
                sizes.append(len(found))
                odd.append(parities(found).view(np.int64))
                take = len(found) + (percent * len(found)) // -100 + 1 if len(found) else 0
                last = among(found, late.value)
                keys.append(np.concatenate([found[~last], found[last]])[:take].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            columns = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (cls, fps)]
            flat = pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64())
            words = [pa.array(np.ascontiguousarray(x)) for x in np.stack(odd).T]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), flat), *words], names=schema.names)

    return docs.mapInArrow(run, schema)


def shared_keys(rows: DataFrame) -> DataFrame:
    """key and cls of each of the ``keys`` that more than one class of ``rows`` has, at: its place among them, past: the one before it (0 for the first)."""
    placed = F.transform("keys", lambda k, i: F.struct(k.alias("key"), i.alias("at"), F.coalesce(F.get("keys", i - 1), F.lit(0)).alias("past")))
    rows = rows.groupBy("cls").agg(F.first("keys").alias("keys")).select("cls", F.inline(placed))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "cls", "at", "past")


def tree_links(classes: DataFrame) -> DataFrame:
    """Pairs u, v of classes whose fingerprints the trees link; those of one fingerprint with its least class."""
    least = written(classes.groupBy("fp").agg(F.min("cls").alias("u")))
    equal = classes.join(least, "fp").where("cls <> u").select("u", F.col("cls").alias("v"))
    found = shard_links(least.select("fp"), RADIUS).distinct().select(F.col("u").alias("fp"), F.col("v").alias("other"))
    near = found.join(least, "fp").select("u", F.col("other").alias("fp")).join(least.withColumnRenamed("u", "v"), "fp").select("u", "v")
    return equal.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def met(keys: DataFrame, classes: DataFrame, percent: int, everything: bool) -> DataFrame:
    """Pairs u, v of different ``root`` in a shard of ``keys`` that may be alike: of each class with the one before and the first, or all.

    A pair may come from several shards.
    """

    def fit(i: np.ndarray, j: np.ndarray, size: np.ndarray, odd: np.ndarray, root: np.ndarray, at: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs i, j that may be alike and, where all are looked at, may have no earlier key in common.

        Similar sets have all that they share at or after the first key in common, in either set's
        order, so they pass in its shard. Elsewhere a pair goes if too little is left of a set from
        there on, or if the keys just before are the same one: then an earlier shard has the pair, too.
        """
        ok = (root[i] != root[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[ok], j[ok]
        if everything:
            left = np.minimum(size[i] - at[i], size[j] - at[j])
            ok = ((100 + percent) * left >= percent * (size[i] + size[j])) & ((past[i] != past[j]) | (at[i] == 0) | (at[j] == 0))
            i, j = i[ok], j[ok]
        parts = [slice(at, at + COMPARED) for at in range(0, len(i), COMPARED)]
        apart = [np.bitwise_count(odd[i[p]] ^ odd[j[p]]).sum(axis=1, dtype=np.int64) for p in parts]
        ok = np.concatenate([np.zeros(0, np.int64), *apart]) <= most_apart(size[i], size[j], percent)
        return i[ok], j[ok]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for last, batch in _and_last(batches):
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            key = np.asarray(held.column("key"))
            edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            whole = edges if last else edges[:-1]
            if whole[-1] == 0:
                continue
            size, root, cls = (np.asarray(held.column(c))[: whole[-1]] for c in ("size", "root", "cls"))
            odd = np.stack([np.asarray(held.column(c))[: whole[-1]] for c in WORDS], axis=1).view(np.uint64)
            size = size.astype(np.int64)
            at, past = (np.asarray(held.column(c))[: whole[-1]].astype(np.int64) for c in ("at", "past"))
            row = np.arange(len(size))
            first = np.repeat(whole[:-1], np.diff(whole))
            if everything:
                sizes = np.diff(whole)
                n = np.where(np.repeat(sizes <= SMALL, sizes), row - first, 0)
                for i, j in ranges(row, first, n):
                    yield pairs(cls, *fit(i, j, size, odd, root, at, past))
                for begin, end in zip(whole[:-1][sizes > SMALL].tolist(), whole[1:][sizes > SMALL].tolist(), strict=True):
                    yield from across(np.arange(begin, end), cls, size, odd, root, at, past)
            else:
                later = row[row > first]
                i, j = fit(np.concatenate([later, later]), np.concatenate([later - 1, first[later]]), size, odd, root, at, past)
                yield pairs(cls, i, j)
            held = held.slice(int(whole[-1]))

    def across(rows: np.ndarray, cls: np.ndarray, size: np.ndarray, odd: np.ndarray, root: np.ndarray, at: np.ndarray, past: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs of a shard's rows (by size) of different roots: all but those of the commonest root, each with the rows before it and with that root's."""
        _, of, counts = np.unique(root[rows], return_inverse=True, return_counts=True)
        common = of == np.argmax(counts)
        others, same = rows[~common], rows[common]
        least, most = -(-percent * size[others] // 100), 100 * size[others] // percent
        for given, low, high in ((others, np.searchsorted(size[others], least), np.arange(len(others))), (same, np.searchsorted(size[same], least), np.searchsorted(size[same], most, "right"))):
            for i, j in ranges(others, low, np.maximum(high - low, 0)):
                yield pairs(cls, *fit(i, given[j], size, odd, root, at, past))

    def ranges(rows: np.ndarray, low: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each of ``rows`` with the n numbers from low on, about LOT pairs at once."""
        start, total = 0, np.concatenate([[0], np.cumsum(n)])
        while start < len(n):
            stop = max(int(np.searchsorted(total, total[start] + LOT, "right")) - 1, start + 1)
            i = np.repeat(rows[start:stop], n[start:stop])
            if len(i):
                yield i, np.arange(len(i)) - np.repeat(total[start:stop] - total[start], n[start:stop]) + np.repeat(low[start:stop], n[start:stop])
            start = stop

    def pairs(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        found = np.unique(np.stack([np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])]), axis=1) if len(i) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

    rows = keys.join(classes.select("cls", "size", "root", *WORDS), "cls").select("key", "size", "root", "cls", "at", "past", *WORDS)
    return rows.repartition("key").sortWithinPartitions("key", "size", "cls").mapInArrow(run, "u long, v long")


def candidates(keys: DataFrame, classes: DataFrame, percent: int, everything: bool) -> DataFrame:
    """The pairs of ``met``, each once."""
    return met(keys, classes, percent, everything).distinct()


def verified(found: DataFrame, texts: DataFrame, shingle: int, percent: int, seed: int) -> DataFrame:
    """The pairs u, v of ``found`` whose texts (cls, __text) have the similarity. Texts travel packed: they are what takes room."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(64)(lambda packed: shingle_set(zlib.decompress(packed), shingle, seed))
        for batch in batches:
            a, b = ([x.as_py() for x in batch.column(c)] for c in ("a", "b"))
            ok = pa.array([alike(known(x), known(y), percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield batch.select(["u", "v"]).filter(ok)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "__text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array([zlib.compress(x, 1) for x in texts], pa.binary())], names=["cls", "packed"])

    ends = found.select(F.explode(F.array("u", "v")).alias("cls")).distinct()
    needed = written(texts.join(ends, "cls", "left_semi").select("cls", "__text").mapInArrow(pack, "cls long, packed binary").groupBy("cls").agg(F.min("packed").alias("packed")))
    one, two = (needed.select(F.col("cls").alias(k), F.col("packed").alias(t)) for k, t in (("u", "a"), ("v", "b")))
    return found.join(two, "v").join(one, "u").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, seed: int = 42, first: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with group (a number for each group of near copies) and component_id, the group's least id.

    Documents are linked if their sets of shingles have a Jaccard similarity of ``percent`` / 100
    or more, and a group is what links connect. Null and empty texts are equal; a null id is never
    least (a group of null ids alone has component_id null); columns named like an output are replaced.
    first: one row of each group is returned, one with the least id; of several the first by the text's
    hash and these columns. It is chosen without the texts, which then travel once.
    """
    carried = [c for c in docs.columns if c not in ("group", "component_id")]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items() if c != text_col), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    if first is not None:
        keyed = keyed.withColumn("__row", F.monotonically_increasing_id())  # written with the rows, so it stays
    rows = written(described(keyed, shingle, percent, seed))
    texts = rows.select("cls", "__text")
    classes = written(rows.groupBy("cls").agg(F.min("__id").alias("least"), F.min("fp").alias("fp"), F.min("size").alias("size"), *(F.min(c).alias(c) for c in WORDS)))
    keys = written(shared_keys(rows))
    rooted = classes.withColumn("root", F.col("cls"))
    links = None
    for everything in (False, True):
        pairs = candidates(keys, rooted, percent, everything)
        pairs = pairs if everything else pairs.unionByName(tree_links(classes)).distinct()
        found = written(verified(written(pairs), texts, shingle, percent, seed))
        links = found if links is None else links.unionByName(found)
        roots = written(components(links)).withColumnRenamed("node", "cls")
        rooted = classes.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.select("cls", "root").join(least, "root").select("cls", F.col("root").alias("group"), "component_id")
    if first is not None:
        order = F.struct(F.xxhash64("__text"), *(F.col(renamed[c]) for c in first), "__row").alias("order")
        heads = rows.select("cls", "__id", order, "__row").join(of_class, "cls").where(F.col("__id").eqNullSafe(F.col("component_id")))
        heads = written(heads.groupBy("group").agg(F.min(F.struct("order", "cls", "component_id")).alias("m")).select("m.cls", "m.order.__row", "group", "m.component_id"))
        return rows.join(heads, ["cls", "__row"]).select(*(F.col("__text" if c == text_col else n).alias(c) for c, n in renamed.items()), "group", "component_id")
    return rows.join(of_class, "cls").select(*(F.col("__text" if c == text_col else n).alias(c) for c, n in renamed.items()), "group", "component_id")
