"""The operators and the pipeline as queries over the driver's tables: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import discriminant, divergence, fingerprints, langid, licenses, linededup, lm, mixing, negatives, packing, quality, simhash, url_filters
from .util import load


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = url_filters.outcomes_of(url_filters.parsed(pages), load(spark, sf_dir, "labels"))
    return url_filters.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(load(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(load(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(load(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a tree of files: source/lang/n/doc_id.txt with n = doc_id div 100. A text that speaks of a licence is a LICENSE-doc_id, every tenth one a directory higher."""
    docs = load(spark, sf_dir, "documents")
    speaks = F.coalesce(F.col("text").rlike("(?i)licen[sc]e|permission is hereby|redistribution and use"), F.lit(False))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    folder = F.when(speaks & (F.col("doc_id") % 10 == 0), F.lit(None)).otherwise(F.coalesce(F.expr("CAST(doc_id div 100 AS STRING)"), F.lit("none")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), folder, F.when(speaks, F.concat(F.lit("LICENSE-"), name)).otherwise(F.concat(name, F.lit(".txt"))))
    return licenses.inherited(docs.select("doc_id", path.alias("path"), "text"), "doc_id").withColumnRenamed("key", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.decisions(load(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(load(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(load(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(load(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(load(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discriminant.scored(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_url_filters, op2_quality_rules, op3_order_minhash, op4_mixing, op5_simhash, op6_license_scans, op7_line_dedup, op8_lm_scoring, op9_packing, op10_language_id, op11_source_divergence, op12_quality_classifier, op13_hard_negatives)
}

def _weight_sql(level: str) -> str:
    """The moment estimate of a level's prior weight, between its bounds."""
    low, high = url_filters.WEIGHT
    return f"""SELECT CASE WHEN n > 0 THEN least(greatest((1 - rho) / rho, {low}), {high}) ELSE {high} END FROM (SELECT n, CASE WHEN room > 0 THEN least(greatest((r - x * x / n - pq * (k - 1)) / room, 1e-9), 1.0) ELSE 1e-9 END AS rho
      FROM (SELECT *, pq * (n - n2 / n - (k - 1)) AS room FROM (SELECT *, x / n * (1 - x / n) AS pq FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(x) AS DOUBLE) AS x, sum(CAST(n AS DOUBLE) * n) AS n2, sum(CAST(x AS DOUBLE) * x / n) FILTER (n > 0) AS r, CAST(count(*) FILTER (n > 0) AS DOUBLE) AS k FROM {level}))))"""


#: Rules, outcomes and posterior of op 1 as another engine computes them.
_REPUTATION = f"""WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
    FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages)),
  marks AS (SELECT doc_id AS shown, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
  outcomes AS (SELECT page_id, max(bad) AS bad FROM p JOIN marks ON try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[^0-9]|$)', 1) AS BIGINT) = shown WHERE page_id IS NOT NULL GROUP BY page_id),
  counts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS x FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN outcomes USING (page_id) GROUP BY host),
  bare AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM counts),
  two AS (SELECT *, array_to_string(l, '.') AS whole, array_to_string(l[-2:], '.') AS last2 FROM bare),
  deep AS (SELECT *, regexp_matches(last2, '{url_filters.TWO_LABELS}') AND whole <> last2 AS d, regexp_matches(whole, '^[0-9.]+$|^\\[') AS ip FROM two),
  hosts AS (SELECT host, n, x, CASE WHEN ip THEN whole WHEN d THEN array_to_string(l[-3:], '.') ELSE last2 END AS domain, CASE WHEN ip THEN '' WHEN d THEN last2 ELSE l[-1] END AS suffix FROM deep),
  domains AS (SELECT suffix, domain, sum(n) AS n, sum(x) AS x FROM hosts GROUP BY ALL), suffixes AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM domains GROUP BY ALL),
  w AS (SELECT ({_weight_sql("suffixes")}) AS ks, ({_weight_sql("domains")}) AS kd, ({_weight_sql("hosts")}) AS kh, (SELECT (sum(x) + 1.0) / (sum(n) + 2.0) FROM suffixes) AS top),
  s AS (SELECT suffix, (top * ks + x) / (ks + n) AS m FROM suffixes, w), dm AS (SELECT suffix, domain, (s.m * kd + x) / (kd + n) AS m FROM domains JOIN s USING (suffix), w),
  h AS (SELECT host, m, m - {url_filters.Z} * sqrt(m * (1 - m) / (kh + n + 1)) AS lower FROM (SELECT host, n, (dm.m * kh + x) / (kh + n) AS m, kh FROM hosts JOIN dm USING (suffix, domain), w)),
  r(rule, home, prefix, verdict) AS (VALUES {", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in url_filters.RULES)}),
  f AS (SELECT p.page_id, p.host, p.path, h.lower, (SELECT struct_pack(rule := rule, verdict := verdict) FROM r WHERE (p.host = home OR ends_with(p.host, '.' || home)) AND starts_with(p.path, prefix) ORDER BY length(rule) DESC LIMIT 1) AS found FROM p JOIN h USING (host))
SELECT page_id, host, path, found.rule AS rule, coalesce(found.verdict, CASE WHEN lower > {url_filters.LIMIT} AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict FROM f"""

#: Counts, kept terms, probabilities, pairs and terms of op 11 in whole numbers.
_DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
  w AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
  n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v, sum(lang_n) AS t FROM kept GROUP BY lang),
  g AS (SELECT lang, source, coalesce(sum(n), 0) AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) GROUP BY ALL),
  p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (g.t + v.v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 1)) // (v.t + v.v) AS q
    FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
  f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200"""

#: Positives and windowed negatives of op 13 from all exact inner products of the anchors.
_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
  WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10"""

ORACLE_SQL: dict[str, str] = {"op1_url_filters": _REPUTATION, "op11_source_divergence": _DIVERGENCE, "op13_hard_negatives": _NEGATIVES}
