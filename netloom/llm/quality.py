"""Quality rules: base limits on text statistics, then robust multivariate outliers.

All of it is DataFrame functions. Statistics are taken from whole texts by array functions, each
in its own row. For every language and source the statistic vectors get a mean and a scatter by
the minimum covariance determinant, in its regularised form (a fixed diagonal, FLOORS squared, is
part of the scatter whose determinant is minimised): from two starts (all rows; medians and median
deviations), concentration steps keep the KEEP share of rows with the least Mahalanobis distances
and estimate anew until the determinant no longer falls by SETTLED, and the start that ends with
the smaller determinant counts. A row is rejected if its distance is above CUTOFF. Groups with
fewer than ``least`` rows use their language's estimate, or that of all rows.

The share of rows is cut at exact counts of distances in fine bins, so groups of any size are
aggregates that combine before the shuffle; only the vectors, not the texts, are read again.
Estimates, one row a group, are broadcast while they are FEW; beyond, rows meet them by group and
salt, so the key of all rows isn't one task's.

Defined cases: null and empty texts have no words and fail the base; null languages and sources
are groups of their own; every row is judged by itself, so repeated rows and null ids need no
care; an empty table gives no rows; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Share of rows that a concentration step keeps, and what scatter of that share is multiplied by:
#: KEEP / P(chi2_7 <= q) where P(chi2_5 <= q) = KEEP (fixed values).
KEEP, CONSISTENT = 0.75, 1.412
#: Chi-square quantile of 5 degrees at 1 - 1e-6 (a fixed value).
CUTOFF = 35.888
#: Spread added to the scatter of each statistic, so that one that hardly varies in clean text doesn't reject by itself at once.
FLOORS = (0.5, 0.08, 0.2, 0.06, 0.1)
N = len(FLOORS)
#: Fall of the log determinant below which a group has settled.
SETTLED = 1e-4
#: Groups whose estimates are broadcast (some 250 bytes each), and parts that a group's rows are dealt into beyond.
FEW, SALTS = 20_000, 64
#: Bins of distances per doubling, and width of the bins that medians are taken from.
FINE, WIDTH = 32, 0.01
PAIRS = [(i, j) for i in range(N) for j in range(i + 1)]


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words in windows of ``window`` words that are found twice or more in the array ``words``, the first included."""

    def covered(places: Column) -> Column:
        """Words that windows at these ascending places cover."""
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda s, p: F.struct((p + window).cast("int").alias("end"), (s["n"] + p + window - F.greatest(p, s["end"])).cast("int").alias("n")), lambda s: s["n"])

    def repeated(hashes: Column) -> Column:
        by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(by_hash, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(places, covered))

    def hashed(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))

    found = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(hashed(h), repeated))
    return F.when(F.size(words) >= window, found).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; ``__lines`` lines have a word."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(F.col("__whole"), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    out = docs.withColumn("__whole", whole)
    out = out.withColumn("__words", F.filter(F.split("__whole", SPACES), lambda w: w != "")).withColumn("__rows", lines)
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate("__whole", " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length("__whole") - F.length(F.translate("__whole", SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__rows") - F.size(F.array_distinct("__rows"))).cast("long"),
        "n_repeat_words": repeat_words(F.col("__words")),
        "__lines": F.size("__rows"),
    }).drop("__whole", "__words", "__rows")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def vector() -> list[Column]:
    """Length, word length (drawn to 5 in short texts), symbols, repeated words and repeated lines, transformed."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return [
        F.log1p(n.cast("double")),
        F.log((chars + 100) / (n + 20)),
        F.log1p(50.0 * F.col("n_symbols") / F.greatest(chars, F.lit(1))),
        F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
        F.col("n_dup_lines") / F.greatest(F.col("__lines"), F.lit(1)),
    ]


def _level(lang: Column, source: Column) -> list[Column]:
    """Keys of a row's groups: language and source, language, all."""
    tag = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("-"))
    return [F.concat(tag(lang), F.lit("\n"), tag(source)), tag(lang), F.lit("")]


def _of_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` joined with the rows of ``groups`` (written; some for each key) that have their key."""
    if groups.count() <= FEW:
        return rows.join(F.broadcast(groups), "key")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*(f"x{i}" for i in range(N))), F.lit(SALTS)))
    return salted.join(groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["key", "__salt"]).drop("__salt")


def _moments(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("key", *more).agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(N)), *(F.covar_pop(f"x{i}", f"x{j}").alias(f"c{i}{j}") for i, j in PAIRS))


def _inverted(moments: DataFrame, factor: float, *more: str) -> DataFrame:
    """m0.., and c00.. (times factor, plus the floors) turned into w00.. with distance = sum of (sum of w_ij (x_j - m_j))^2."""
    out = moments

    def lower(i: int, j: int) -> Column:
        value = F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        return F.sqrt(value) if i == j else value / F.col(f"l{j}{j}")

    def inverse(i: int, j: int) -> Column:
        value = F.lit(1.0) if i == j else F.lit(0.0)
        for k in range(j, i):
            value = value - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
        return value / F.col(f"l{i}{i}")

    # what doesn't need each other is one step of the plan: steps, not columns, are what the driver has to hold
    for j in range(N):  # Cholesky factor, column by column
        out = out.withColumn(f"l{j}{j}", lower(j, j))
        if j + 1 < N:
            out = out.withColumns({f"l{i}{j}": lower(i, j) for i in range(j + 1, N)})
    for d in range(N):  # its inverse, diagonal by diagonal
        out = out.withColumns({f"w{j + d}{j}": inverse(j + d, j) for j in range(N - d)})
    determinant = sum((F.log(f"l{i}{i}") for i in range(1, N)), F.log("l00"))
    return out.select("key", *more, *(f"m{i}" for i in range(N)), *(f"w{i}{j}" for i, j in PAIRS), determinant.alias("logdet"))


def distance() -> Column:
    total = F.lit(0.0)
    for i in range(N):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + row * row
    return total


def _nearest(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """The KEEP share of each group's rows with the least distances, for each start: whole bins, at least that share."""
    binned = _of_group(rows, estimates).withColumn("bin", F.floor(F.log2(distance() + 1e-9) * FINE)).select("key", "start", *(f"x{i}" for i in range(N)), "bin")
    counts = binned.groupBy("key", "start", "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy("key", "start")
    order = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    cut = written(counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("all", F.sum("n").over(group)).where(F.col("before") < KEEP * F.col("all")).groupBy("key", "start").agg(F.max("bin").alias("cut")))
    return _of_group(binned, cut.withColumnRenamed("start", "s")).where("start = s AND bin <= cut").drop("bin", "cut", "s")


def _medians(rows: DataFrame, values: list[Column]) -> DataFrame:
    """For each key and statistic ``i``, the middle of the bin that holds the median of values[i]."""
    long = rows.select("key", F.posexplode(F.array(*(F.floor(v / WIDTH) for v in values))).alias("i", "bin"))
    counts = long.groupBy("key", "i", "bin").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    found = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("all", F.sum("n").over(Window.partitionBy("key", "i"))).where("2 * before < all").groupBy("key", "i").agg(F.max("bin").alias("bin"))
    return found.groupBy("key").agg(*(F.max(F.when(F.col("i") == i, (F.col("bin") + 0.5) * WIDTH)).alias(f"v{i}") for i in range(len(values))))


def robust_estimates(vectors: DataFrame, least: int) -> DataFrame:
    """MCD estimates by ``key`` from vectors (lang, source, x0..): for each group of at least ``least`` rows, and for all rows."""
    rows = vectors.select(F.explode(F.array(*_level(F.col("lang"), F.col("source")))).alias("key"), *(f"x{i}" for i in range(N)))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") >= least) | (F.col("key") == ""))
    rows = written(_of_group(rows, written(sizes.select("key"))))
    plain = _inverted(_moments(rows), 1.0)
    middle = written(_medians(rows, [F.col(f"x{i}") for i in range(N)]))
    spread = _medians(_of_group(rows, middle), [F.abs(F.col(f"x{i}") - F.col(f"v{i}")) for i in range(N)])
    spread = spread.select("key", *(F.col(f"v{i}").alias(f"s{i}") for i in range(N))).join(middle, "key")
    deviation = 1.4826  # of a normal spread from its median deviation (a fixed value)
    middled = _inverted(spread.select("key", *(F.col(f"v{i}").alias(f"m{i}") for i in range(N)), *((F.pow(F.col(f"s{i}") * deviation, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS)), 1.0)
    # the starts' own determinants are of other shares of the rows, so any first step is better
    at = plain.withColumn("start", F.lit(0)).unionByName(middled.withColumn("start", F.lit(1))).withColumn("logdet", F.lit(float("inf")))
    at, open_ = written(at.withColumn("open", F.lit(True))), True
    names = at.columns
    while open_:
        moved = _inverted(_moments(_nearest(rows, at.where("open").drop("open", "logdet")), "start"), CONSISTENT, "start")
        both = at.alias("a").join(moved.alias("b"), ["key", "start"], "left")
        falls = F.coalesce(F.col("b.logdet") < F.col("a.logdet") - SETTLED, F.lit(False))
        at = written(both.select("key", "start", *(F.when(falls, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in names if c not in ("key", "start", "open")), falls.alias("open")))
        open_ = not at.where("open").isEmpty()
    first = Window.partitionBy("key").orderBy("logdet", "start")
    return at.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at", "start", "logdet", "open")


def quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 50, cutoff: float = CUTOFF, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with the statistics, base_failed, distance (null where the base failed) and kept. carry: the columns of ``docs`` to keep (all)."""
    outputs = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept"}
    carried = [c for c in (docs.columns if carry is None else carry) if c not in outputs]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    taken = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("__text"))
    rows = statistics(taken, F.col("__text")).drop("__text")
    rows = written(rows.select("*", *(x.alias(f"x{i}") for i, x in enumerate(vector()))))
    estimates = written(robust_estimates(rows.where("NOT base_failed").select("lang", "source", *(f"x{i}" for i in range(N))), least))
    keys = estimates.select("key").withColumn("has", F.lit(True))
    groups = rows.select("lang", "source").distinct()  # few: one row a language and source
    levels = _level(F.col("lang"), F.col("source"))
    for i, level in enumerate(levels[:2]):
        groups = groups.withColumn(f"k{i}", level).join(keys.select(F.col("key").alias(f"k{i}"), F.col("has").alias(f"h{i}")), f"k{i}", "left")
    groups = groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), F.when(F.col("h0"), F.col("k0")).when(F.col("h1"), F.col("k1")).otherwise(F.lit("")).alias("key"))
    fitted = written(groups.join(estimates, "key", "left").drop("key"))
    fitted = F.broadcast(fitted) if fitted.count() <= FEW else fitted
    judged = rows.join(fitted, rows["lang"].eqNullSafe(F.col("gl")) & rows["source"].eqNullSafe(F.col("gs")), "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.sqrt(distance())))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff**0.5)
    return judged.select(*(F.col(n).alias(c) for c, n in renamed.items()), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
