"""Sharding by histogram sort: splitters from exact histograms, then one exchange.

Keys are one or more long columns, compared in turn. Candidate boundaries (probes) are laid evenly
over the bits of a key; a round counts exactly how many bytes and rows lie below each of them in
all partitions. A splitter whose nearest probe is within tolerance is settled; the others are
looked for among finer probes inside the one interval that holds them, and inside a single heavy
key among the next key's bits. Only counts of probes reach the driver: at most PROBES for each
open splitter and round. The last key is a row number, so no group of equal rows is too heavy to
be split. Then all rows go to their place in one exchange by shard and keys, in as many ranges as
their bytes ask for, and slots follow from a row's place in its range and the counts of ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sums_before, written

#: Bits of a round's probes.
BITS = 12
PROBES = 1 << BITS
#: Bytes that a range sorted by one task has about.
RANGE_BYTES = 64 << 20
SIGN = -(1 << 63)


@dataclass(frozen=True)
class Splitter:
    """Rows whose keys are at least ``bound`` lie on its right; keys as unsigned, shorter bounds mean zeros behind."""

    bound: tuple[int, ...]
    below_bytes: int
    below_rows: int


@dataclass(frozen=True)
class _Open:
    """An interval that holds splitters: keys before ``level`` equal ``equal``; bits above ``shift`` equal ``prefix``."""

    equal: tuple[int, ...]
    level: int
    prefix: int
    shift: int
    below_bytes: int
    below_rows: int


def _unsigned(value: int) -> int:
    return value ^ SIGN if value < 0 else value + (1 << 63)


def _signed(value: int) -> int:
    return value - (1 << 63)


def find_splitters(rows: DataFrame, keys: list[str], size: str, targets: list[tuple[int, int]]) -> list[Splitter]:
    """For each (bytes below, tolerance), in order, a splitter as near as the keys allow."""
    found: dict[int, Splitter] = {}
    ends = rows.agg(*(f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("a", F.min), ("b", F.max)))).first()
    if ends["a0"] is None:
        return [Splitter((0,), 0, 0) for _ in targets]

    def bits(level: int) -> int:
        """Bits in which values of a key differ."""
        return (_unsigned(ends[f"a{level}"]) ^ _unsigned(ends[f"b{level}"])).bit_length()

    def begin(equal: tuple[int, ...], below: tuple[int, int]) -> _Open:
        level = len(equal)
        n = bits(level)
        return _Open(equal, level, _unsigned(ends[f"a{level}"]) >> n, n, *below)

    open_: dict[_Open, list[int]] = {begin((), (0, 0)): list(range(len(targets)))}
    while open_:
        groups: dict[tuple[int, int], list[_Open]] = {}
        for part in open_:
            groups.setdefault((part.level, part.shift), []).append(part)
        counted: list[tuple[_Open, list[tuple[int, int, int]], int]] = []
        for (level, shift), parts in groups.items():
            low = max(shift - BITS, 0)
            key = F.col(keys[level]).bitwiseXOR(F.lit(SIGN))
            digit = F.shiftrightunsigned(key, low).bitwiseAND(F.lit((1 << (shift - low)) - 1))
            head = F.shiftrightunsigned(key, shift) if shift < 64 else F.lit(0).cast("long")
            which = F.lit(None).cast("int")
            for i, part in enumerate(parts):
                here = head == F.lit(part.prefix if part.prefix < 1 << 63 else part.prefix - (1 << 64))
                for k, value in zip(keys, part.equal, strict=False):
                    here = here & (F.col(k) == F.lit(_signed(value)))
                which = F.when(here, F.lit(i)).otherwise(which)
            counts: list[list[tuple[int, int, int]]] = [[] for _ in parts]
            for row in rows.select(which.alias("part"), digit.alias("digit"), F.col(size).alias("size")).where("part IS NOT NULL").groupBy("part", "digit").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).orderBy("part", "digit").collect():
                counts[row["part"]].append((row["digit"], row["bytes"], row["rows"]))
            counted += [(part, c, low) for part, c in zip(parts, counts, strict=True)]
        after: dict[_Open, list[int]] = {}
        for part, counts, low in counted:
            width = part.shift - low
            edges = [(part.prefix << width, part.below_bytes, part.below_rows)]
            for digit, n_bytes, n_rows in counts:
                head = part.prefix << width | digit
                if head != edges[-1][0]:
                    edges.append((head, *edges[-1][1:]))
                edges.append((head + 1, edges[-1][1] + n_bytes, edges[-1][2] + n_rows))
            at = 0
            for t in sorted(open_[part], key=lambda t: targets[t][0]):
                want, tolerance = targets[t]
                while at + 1 < len(edges) and edges[at + 1][1] <= want:
                    at += 1
                left, right = edges[at], edges[min(at + 1, len(edges) - 1)]
                head, n_bytes, n_rows = left if want - left[1] <= right[1] - want else right
                last = low == 0 and part.level + 1 == len(keys)
                if abs(n_bytes - want) <= tolerance or last or left == right:
                    bound = head << low
                    found[t] = Splitter((*part.equal, bound) if bound < 1 << 64 else _next(part.equal), n_bytes, n_rows)
                elif low:
                    after.setdefault(_Open(part.equal, part.level, left[0], low, left[1], left[2]), []).append(t)
                else:
                    after.setdefault(begin((*part.equal, left[0]), left[1:]), []).append(t)
        open_ = after
    return [found[t] for t in range(len(targets))]


def _next(equal: tuple[int, ...]) -> tuple[int, ...]:
    """The bound behind all keys that begin with ``equal``; empty: behind all keys."""
    while equal and equal[-1] == (1 << 64) - 1:
        equal = equal[:-1]
    return (*equal[:-1], equal[-1] + 1) if equal else ()


def _beyond(keys: list[str], bound: tuple[int, ...]) -> Column:
    """Whether a row's keys are at least ``bound``."""
    if not bound:
        return F.lit(False)
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, bound, strict=False))):
        limit = F.lit(_signed(value))
        out = (F.col(key) > limit) | ((F.col(key) == limit) & out)
    return out


def histogram_sort(df: DataFrame, keys: list[str], size: str, n_shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1, in key order, near equal sums of ``size``) and ``slot`` (gapless from 0 in key order).

    keys: long columns without nulls. tolerance: of a shard's even share, for each splitter; it is
    met unless a single row is heavier. Rows with equal first keys part only where a shard would
    miss the tolerance otherwise; rows that agree in all keys go by an arbitrary row number. Sizes
    are non-negative. An empty table gives no rows.
    """
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()))
    keys = [*keys, "__row"]
    narrow = rows.select(*keys, F.col(size).cast("long").alias("__size"))
    total = narrow.agg(F.coalesce(F.sum("__size"), F.lit(0))).first()[0]
    share = total / n_shards
    merged: list[Splitter] = []  # a splitter is never left of the one before it
    for s in find_splitters(narrow, keys, "__size", [(total * j // n_shards, int(share * tolerance)) for j in range(1, n_shards)]):
        merged.append(merged[-1] if merged and (s.below_rows, s.below_bytes) < (merged[-1].below_rows, merged[-1].below_bytes) else s)
    shard = sum((_beyond(keys, s.bound).cast("int") for s in merged), F.lit(0))
    ranges = max(-(-total // RANGE_BYTES), 2 * n_shards)
    sorted_ = rows.withColumn("shard", shard).repartitionByRange(ranges, "shard", *keys).sortWithinPartitions("shard", *keys)
    # a row's number has its range's number in the high bits and its place there in the low 33
    placed = written(sorted_.drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).alias("__part")
    counts = placed.groupBy("shard", part).agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = sums_before(counts, "shard", "__part", "n").select("shard", "__part", "__first", "before")
    slot = F.col("before") + F.col("__at") - F.col("__first")
    return placed.withColumn("__part", part).join(before, ["shard", "__part"]).withColumn("slot", slot).select(*df.columns, "shard", "slot")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, tolerance: float = 0.002, carry: list[str] | None = None) -> DataFrame:
    """``docs`` dealt into shards of near equal bytes, equal texts side by side.

    Adds size (UTF-8 bytes of the text plus 1), text_crc32 (of these bytes), shard and slot; columns
    with these names are replaced. A null text has no bytes: size 1, crc 0. The keys are a hash of
    the text, then the id (null first): equal texts share a shard unless their group is heavier
    than the tolerance. Rows with equal text and id are told apart by an arbitrary row number.
    """
    added = {"size", "text_crc32", "shard", "slot"}
    carried = [c for c in (docs.columns if carry is None else carry) if c not in added]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    text = F.col(f"`{text_col}`")
    crc = F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32")
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), F.xxhash64(text).alias("__k1"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(SIGN)).alias("__k2"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), crc)
    placed = histogram_sort(keyed, ["__k1", "__k2"], "size", n_shards, tolerance)
    return placed.select(*(F.col(n).alias(c) for c, n in renamed.items()), "size", "text_crc32", "shard", "slot")
