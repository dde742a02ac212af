"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot j of the schedule is a point of the golden-ratio sequence; mapped through the cumulative
weights it names a source, so that any stretch of slots holds each source in its share. A slot's
rank among its source's slots is a block of that source: its documents, shuffled by a hash, form
a stream of words, and block r covers words r * block to (r + 1) * block of it. The stream goes
round again where a source is taken more than once, up to ``most`` times.

Targets: sources by code point, null last, take the weights in turn and share all words by them;
a target stops at ``most`` times the source's words, and the excess is shared again by weight.

Ranks and stream positions are prefix sums: within a stretch of slots, or a part of a source's
hash range, by a window; over the parts by windows over their counts. So a hot source is many
small groups, and no task holds a source. Words are counted once: the rows are written with their
sizes, all that follows moves narrow rows, and texts are joined to what is taken of them at the end.

Defined cases: null or empty texts have size 0 and are never taken; null sources are one source;
rows that agree in all columns are separate documents of equal standing; reruns agree up to such
rows; without words nothing is taken; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, sums_before, written

#: Words of a block, slots of a stretch, and documents of a part of a source's stream (about).
BLOCK, STRETCH, PART = 128, 8192, 2048
#: 2**32 divided by the golden ratio, odd (a fixed value), and cells of the unit interval that sources are looked up by.
GOLDEN, CELLS = 2654435769, 1024
WEIGHTS = (1, 2, 3)
#: Sources whose rows (some 100 bytes each) are broadcast to the documents; more meet them in an ordinary join.
FEW = 100_000


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """For each row of ``totals`` (source, source_size): sid, weight and target.

    Targets are what sharing the excess again and again comes to: with sources in order of
    source_size / weight, the first k are full and the others share what is left by weight. One
    row a source, so the windows over all of them hold few rows.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    given = totals.withColumn("sid", F.row_number().over(by_name) - 1)
    given = given.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    given = given.withColumn("cap", F.col("source_size") * most).withColumn("total", F.sum("source_size").over(every))
    order = every.orderBy(F.col("cap") / F.col("weight"), "sid")
    left = F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # the first source in this order that isn't full fixes the level for all after it
    given = given.withColumn("level", F.when(F.col("cap") > level * F.col("weight"), level))
    given = given.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return given.select("source", "source_size", "sid", "weight", target.alias("target"))


def schedule(spark_sources: DataFrame, n_slots: int) -> DataFrame:
    """``slot``, ``sid`` and ``rank`` of ``n_slots`` slots, from sources with sid and target."""
    spark = spark_sources.sparkSession
    order = Window.partitionBy(F.lit(0)).orderBy("sid")
    high = F.sum("target").over(order) / F.sum("target").over(Window.partitionBy(F.lit(0)))
    last = F.max("sid").over(Window.partitionBy(F.lit(0)))
    bounds = spark_sources.where("target > 0").select("sid", F.when(F.col("sid") == last, 1.0).otherwise(high).alias("high"))
    bounds = bounds.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    cells = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id").bitwiseAND(F.lit((1 << 31) - 1)) * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(1 << 32)).alias("u"))
    slots = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("low <= u AND u < high").select("slot", "sid", F.floor(F.col("slot") / STRETCH).alias("stretch"))
    counts = slots.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    before = sums_before(counts, "sid", "stretch", "n").select("sid", "stretch", "before")
    ranked = slots.withColumn("at", F.row_number().over(Window.partitionBy("sid", "stretch").orderBy("slot")) - 1)
    return ranked.join(before, ["sid", "stretch"]).select("slot", "sid", (F.col("before") + F.col("at")).alias("rank"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Mix:
    """A mix of ``docs``: its sources, its schedule, and what the schedule takes of each document."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = 7, carry: list[str] | None = None) -> None:
        outputs = {"size", "source_size", "target", "taken"}
        self.most, self.block = most, block
        carried = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
        self.renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
        id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
        rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in self.renamed.items()), F.col(f"`{source_col}`").alias("__source"), id_.alias("__id"), F.xxhash64(F.lit(seed), id_, text).alias("__h"), word_count(text).alias("size"))
        #: The documents with their sizes and a number for each.
        self.rows = written(rows.withColumn("__row", F.monotonically_increasing_id()))
        narrow = self.rows.select("__row", "__source", "__h", "__id", "size")
        total, n = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
        totals = narrow.groupBy(F.col("__source").alias("source")).agg(F.sum("size").alias("source_size"))
        self.sources = written(source_targets(totals, weights, most))
        self.few = F.broadcast if self.sources.count() <= FEW else lambda df: df
        self.slots = written(schedule(self.sources, -(-total // block)))
        parts = 1 << max(0, (n // PART).bit_length())
        part = F.floor((F.col("__h").cast("double") + float(1 << 63)) / float(1 << 64) * (1 - 2**-40) * parts)
        sizes = self.sources.select(F.col("source").alias("__s"), "sid", "source_size", "target")
        of_source = narrow.withColumn("__part", part).join(self.few(sizes), narrow["__source"].eqNullSafe(F.col("__s"))).drop("__s", "__source")
        counts = of_source.groupBy("sid", "__part").agg(F.sum("size").alias("n"))
        before = sums_before(counts, "sid", "__part", "n").select("sid", "__part", "before")
        order = Window.partitionBy("sid", "__part").orderBy("__h", "__id", "__row").rowsBetween(Window.unboundedPreceding, 0)
        placed = of_source.withColumn("__end", F.sum("size").over(order)).join(before, ["sid", "__part"])
        #: Each document's number with its source's columns and where it begins in its source's stream.
        self.placed = written(placed.select("__row", "sid", "source_size", "target", "size", (F.col("before") + F.col("__end") - F.col("size")).alias("begin")))

    def pieces(self) -> DataFrame:
        """What each slot takes: slot, sid, begin (of the document), turn (of the stream), n (words) from word ``skip`` on."""
        taken = self.slots.groupBy("sid").agg((F.count("*") * self.block).alias("limit"))
        docs = self.placed.where("size > 0").select("sid", "begin", "size", "source_size").join(self.few(taken), "sid")
        docs = docs.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(self.most - 1))))
        docs = docs.withColumn("first", F.col("begin") + F.col("turn") * F.col("source_size")).where("first < limit")
        docs = docs.withColumn("last", F.least(F.col("first") + F.col("size"), "limit"))
        docs = docs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / self.block), F.floor((F.col("last") - 1) / self.block))))
        start, stop = F.greatest("first", F.col("rank") * self.block), F.least("last", (F.col("rank") + 1) * self.block)
        return docs.join(self.slots, ["sid", "rank"]).select("slot", "sid", "begin", "turn", (start - F.col("first")).alias("skip"), (stop - start).alias("n"))

    def _taken(self, *turn: str) -> DataFrame:
        """What is taken of each document, in all or in each turn: __row, size and taken."""
        taken = self.pieces().groupBy("sid", "begin", *turn).agg(F.sum("n").alias("taken"))
        return self.placed.where("size > 0").join(taken, ["sid", "begin"]).select("__row", "size", "taken")

    def documents(self) -> DataFrame:
        """The documents with size, source_size, target and taken."""
        taken = self.placed.select("__row", "source_size", "target").join(self._taken().select("__row", "taken"), "__row", "left")
        joined = self.rows.join(taken, "__row")
        return joined.select(*(F.col(n).alias(c) for c, n in self.renamed.items()), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, text_col: str = "text") -> DataFrame:
        """The mix itself: a row for each turn in which a document is taken, with the words taken; a text taken in part is cut."""
        joined = self.rows.drop("size").join(self._taken("turn"), "__row")
        text = F.col(self.renamed[text_col])
        words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
        part = F.when(F.col("taken") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")).otherwise(text)
        return joined.select(*((part if c == text_col else F.col(n)).alias(c) for c, n in self.renamed.items()))
