"""URL rules, and host reputation by empirical Bayes.

A page's url is judged by the longest rule that fits it, or else by its host's reputation: labelled
page outcomes (1: bad) are shrunk through beta-binomial priors. The suffix (last label, or the last
two where a country's registry sells names below a second label, as in co.uk) is shrunk towards
all pages, the registered domain (suffix and one more label) towards its suffix, the host towards
its domain. Each level's prior strength is estimated by moments over that level's groups, and is at
most that of 1 / LEAST_RHO - 1 outcomes, so a host with many outcomes of its own is judged by them.
A page is blocked if the lower posterior bound of its host's bad share, mean - Z deviations, is
above the bad share of all labelled pages (or a given limit): its host is worse than the corpus.

All of it is DataFrame functions. Outcomes are aggregated before any shuffle, and pages meet
their host's row in an ordinary join, which Spark broadcasts or splits by size at run time.

Defined cases: a null url, or one without "://", has an empty host and path; labels that are null
or of no page are ignored, and a page with several labels is bad if one says so; null and repeated
page ids are judged like any other; without labels nothing is blocked by reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Deviations below the mean (90 % of a normal posterior lie above).
Z = 1.2816
#: Limits of a level's estimated correlation, which keep the prior's strength a finite positive number: groups that differ by no more than chance take the level above (a million outcomes), and groups that always agree with themselves keep a ninth of one.
LEAST_RHO, MOST_RHO = 1e-6, 0.9
#: Second labels under which country registries sell names (fixed values).
SECOND = "ac co com edu gob gov go mil ne net nom or org".split()
TWO = rf"(^|\.)({'|'.join(SECOND)})\.[a-z][a-z]$"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased (A to Z), and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct of rule and verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def domain_of(host: Column) -> Column:
    return F.when(F.rlike(host, F.lit(TWO)), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix_of(host: Column) -> Column:
    return F.when(F.rlike(host, F.lit(TWO)), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _strength(groups: DataFrame) -> float:
    """Prior strength (a + b) of a level by moments, from its groups' n, k and prior mean m."""
    spread = F.col("m") * (1 - F.col("m"))
    row = groups.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("m"), 2) - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("pairs"),
    ).first()
    rho = row["over"] / row["pairs"] if row["pairs"] else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def _shrink(groups: DataFrame, strength: float) -> DataFrame:
    """Adds the posterior's mean and deviation."""
    a = F.lit(strength) * F.col("m") + F.col("k")
    total = F.lit(strength) + F.col("n")
    mean = a / total
    return groups.withColumn("mean", mean).withColumn("deviation", F.sqrt(mean * (1 - mean) / (total + 1)))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host: host, n, k, mean, deviation, and share (bad ones of all pages); from rows of host and bad (0, 1 or null)."""
    hosts = written(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))))
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    suffixes = suffixes.withColumn("m", F.lit((k + 0.5) / (n + 1)))
    suffixes = _shrink(suffixes, _strength(suffixes))
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix")
    domains = _shrink(domains, _strength(domains))
    hosts = hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain")
    return _shrink(hosts, _strength(hosts)).select("host", "n", "k", "mean", "deviation", F.lit((k + 0.5) / (n + 1)).alias("share"))


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", z: float = Z, limit: float | None = None, rules: tuple[tuple[str, str, str], ...] = RULES, carry: list[str] | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict and bad_bound (the lower posterior bound).

    labels: page_id and bad (0 or 1). limit: the bad share that the bound must exceed (that of all pages). carry: the columns of ``pages`` to keep (all); columns named like an output are replaced.
    """
    outputs = {"host", "path", "rule", "verdict", "bad_bound"}
    carried = [c for c in (pages.columns if carry is None else carry) if c not in outputs]
    renamed = {c: f"__c{i}" for i, c in enumerate(carried)}
    host, path = url_parts(F.col(f"`{url_col}`"))
    rows = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in renamed.items()), F.col(f"`{id_col}`").alias("__id"), host.alias("host"), path.alias("path"))
    bad = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = rows.select("__id", "host").join(bad, F.col("__id") == F.col("page_id"), "left").select("host", F.col("bad").cast("long").alias("bad"))
    known = host_reputation(outcomes).select(F.col("host").alias("__host"), F.greatest(F.col("mean") - z * F.col("deviation"), F.lit(0.0)).alias("bad_bound"), (F.col("share") if limit is None else F.lit(limit)).alias("__limit"))
    out = rows.join(known, rows["host"] == F.col("__host"), "left").withColumn("__rule", matching_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("bad_bound") > F.col("__limit"), "block").otherwise("allow"))
    return out.select(*(F.col(n).alias(c) for c, n in renamed.items()), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "bad_bound")


def filter_sql() -> str:
    """The same judgement of the tables pages and labels as SQL."""
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1:])))
    verdicts = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)

    def level(name: str, source: str) -> str:
        return f"""
{name}_s AS (SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN 1 / {LEAST_RHO}
    ELSE 1 / least(greatest(sum(pow(k - n * m, 2) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)), {LEAST_RHO}), {MOST_RHO}) END - 1 AS s FROM {source}),
{name}_p AS (SELECT *, (s * m + k) / (s + n) AS mean, sqrt((s * m + k) / (s + n) * (1 - (s * m + k) / (s + n)) / (s + n + 1)) AS deviation FROM {source}, {name}_s)"""

    return f"""
WITH split AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, array_to_string(string_split(host, '.')[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain, array_to_string(string_split(host, '.')[CASE WHEN two THEN -2 ELSE -1 END:], '.') AS suffix, n, k
    FROM (SELECT host, regexp_matches(host, '{TWO}') AS two, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM parts LEFT JOIN bad ON page_id = doc_id GROUP BY host)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
total AS (SELECT (sum(k) + 0.5) / (sum(n) + 1) AS share FROM suffixes),
top AS (SELECT suffix, n, k, share AS m FROM suffixes, total),{level("top", "top")},
middle AS (SELECT domains.*, top_p.mean AS m FROM domains JOIN top_p USING (suffix)),{level("middle", "middle")},
low AS (SELECT hosts.*, middle_p.mean AS m FROM hosts JOIN middle_p USING (domain)),{level("low", "low")},
ruled AS (SELECT page_id, host, path, CASE {when} END AS rule FROM parts)
SELECT page_id, ruled.host AS host, path, rule,
    CASE rule {verdicts} ELSE CASE WHEN mean - {Z} * deviation > share THEN 'block' ELSE 'allow' END END AS verdict
FROM total, ruled JOIN low_p ON low_p.host = ruled.host
"""
