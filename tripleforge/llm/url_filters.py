"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or good) are counted by host. Each level's bad rate is shrunk towards its parent's through
a beta-binomial prior: everything -> suffix -> registered domain -> host. A level's prior weight is a moment estimate
from the spread of the rates of its groups. A host is blocked where the posterior's lower bound passes a limit.

Defined results: a null url, or one without "://", has an empty host and path, no rule and the verdict "allow"; null
labels are no labels; repeated pages are judged alike and count once for their host; of several labels of a page the
worst holds; a null page_id has no label; an empty table gives an empty result; extra columns are ignored; a url of any length is read whole. Counts are
aggregated by host and stored, so a hot host costs one row and every level is made from the level below. A host equal to
its domain, or a domain equal to its suffix, is a group of one and keeps its parent's rate as prior.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import ascii_lower, stored

#: Rules in the form host/path prefix; the longest that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Suffixes of two labels: a general second label under a country's two letters. Any other suffix has one.
TWO_LABELS = r"^(?:com?|org?|net?|ac|edu?|gov?|gob|mil|nom|sch|ltd|plc|ad|lg|id|web)\.[a-z]{2}$"
#: One-sided normal bound, limit on the bad rate, and the range of a prior's weight in pages.
Z, LIMIT, WEIGHT = 1.2815515655446004, 0.5, (2.0, 200.0)


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END")
    return pages.select("page_id", "url", rest.alias("rest")).select(
        "page_id",
        "url",
        F.coalesce(ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*)", 1), F.lit("")).alias("path"),
    )


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host, then path prefix) that fits, as struct(rule, verdict); null where none fits."""
    out = None
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at, _, prefix = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{prefix}")
        made = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def with_levels(hosts: DataFrame) -> DataFrame:
    """Adds domain (the registered one) and suffix to a table with host."""
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    two = F.substring_index(bare, ".", -2)
    deep = two.rlike(TWO_LABELS) & (bare != two)
    ip = bare.rlike(r"^[0-9.]+$|^\[")
    domain = F.when(ip, bare).when(deep, F.substring_index(bare, ".", -3)).otherwise(two)
    suffix = F.when(ip, F.lit("")).when(deep, two).otherwise(F.substring_index(bare, ".", -1))
    return hosts.withColumn("domain", domain).withColumn("suffix", suffix)


def _weight(groups: DataFrame) -> tuple[float, float, float]:
    """The moment estimate of the prior weight from groups with counts x of n; all counts, all bad ones."""
    low, high = WEIGHT
    sums = ("sum(n)", "sum(x)", "sum(CAST(n AS DOUBLE) * n)", "sum(CASE WHEN n > 0 THEN CAST(x AS DOUBLE) * x / n END)", "sum(CASE WHEN n > 0 THEN 1 END)")
    N, X, N2, R, k = (float(v or 0) for v in groups.agg(*[F.expr(e).alias(f"s{i}") for i, e in enumerate(sums)]).first())
    if not N:
        return high, N, X
    pq = X / N * (1 - X / N)
    room = pq * (N - N2 / N - (k - 1))
    rho = min(max((R - X * X / N - pq * (k - 1)) / room, 1e-9), 1.0) if room > 0 else 1e-9
    return min(max((1 - rho) / rho, low), high), N, X


def reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, x, mean, lower for every host of pages (with host); outcomes: page_id, bad (0 or 1). A page counts once for a host, as bad if one of its outcomes is."""
    seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    at = pages.select("page_id", "host").distinct().join(seen, "page_id", "left")
    hosts = stored(with_levels(at.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))))
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    (ks, N, X), (kd, *_), (kh, *_) = map(_weight, (suffixes, domains, hosts))
    top = (X + 1.0) / (N + 2.0)
    shrunk = lambda prior, k: (prior * k + F.col("x")) / (k + F.col("n"))
    s = suffixes.select("suffix", shrunk(F.lit(top), ks).alias("ms"))
    d = domains.join(s, "suffix").select("suffix", "domain", shrunk(F.col("ms"), kd).alias("md"))
    h = hosts.join(d, ["suffix", "domain"]).withColumn("mean", shrunk(F.col("md"), kh))
    return h.select("host", "n", "x", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (kh + F.col("n") + 1))).alias("lower"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, lower, mean for every row of pages(page_id, url)."""
    p = parsed(pages)
    scores = reputation(p, outcomes).select("host", "mean", "lower")
    found = p.join(scores, "host").withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("lower") > limit) & (F.col("host") != ""), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), F.round("mean", 6).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower"))


def outcomes_of(pages: DataFrame, labels: DataFrame, number: str = r"/([0-9]{1,18})(?:[^0-9]|$)") -> DataFrame:
    """Page outcomes (page_id, bad) from labels of documents; a page shows the document whose number its url names first after a slash.

    bad where the quality is 0 or the text toxic; rows without either label are left out.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    marks = labels.select(F.col("doc_id").cast("long").alias("shown"), bad.alias("bad")).where("shown IS NOT NULL AND bad IS NOT NULL")
    marks = marks.groupBy("shown").agg(F.max("bad").alias("bad"))
    shown = pages.select("page_id", F.expr("try_cast(nullif(regexp_extract(path, '" + number.replace("\\", "\\\\") + "', 1), '') AS bigint)").alias("shown"))
    return shown.join(marks, "shown").groupBy("page_id").agg(F.max("bad").alias("bad"))
