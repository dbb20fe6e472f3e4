"""URL filter: ordered host and path rules, then a blocked Bloom filter in front of an exact join with listed URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bloom import build_filter, might_hold
from tidemark.llm.common import UPPER, read, written

#: Fixed values: (host, path, verdict), as the query's contract gives them.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MARKER = r"(^|[.])adult[^.]*[.]"


def host_of(url):
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url):
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host, path):
    """Host without a leading ``www.`` or ``m.``, path without ``.html`` or a closing slash; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^(www|m)[.]", ""), F.regexp_replace(path, r"(/|[.]html)$", ""))


def rule_for(host, path, rules=RULES):
    """(rule, verdict) struct of the longest fitting rule, null if none fits; of equal lengths the later one wins.

    For a stated list of at most 256 rules; each becomes one comparison in generated code.
    """
    if len(rules) > 256:
        raise ValueError("at most 256 rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, listed: DataFrame, url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed; ``listed`` has one string column of canonical URLs.

    A rule decides where one fits. Elsewhere a page is blocked if its canonical URL is listed: the Bloom filter passes
    probable hits, an exact join keeps the true ones. Null or schemeless urls have an empty host and path, no rule, and
    are listed only if the empty string is. Columns of ``pages`` named like the new ones are replaced.
    """
    spark = pages.sparkSession
    names = listed.select(F.col(listed.columns[0]).alias("__listed")).where("__listed is not null").distinct()
    names = written(names, "listed")
    table = build_filter(names, "__listed")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumns({"__rule": rule_for(F.col("host"), F.col("path"), rules), "__canon": canonical(F.col("host"), F.col("path"))})
    out = out.withColumn("__maybe", might_hold(spark, table, "__canon"))
    no = out.where(~F.col("__maybe")).withColumn("__listed", F.lit(None).cast("string"))
    yes = out.where(F.col("__maybe")).join(names.hint("shuffle_hash"), F.col("__canon") == F.col("__listed"), "left")
    out = yes.unionByName(no).withColumn("listed", F.col("__listed").isNotNull())
    own = F.when(F.col("listed"), "block").otherwise("allow")
    out = out.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.verdict"), own)})
    return out.drop("__rule", "__canon", "__maybe", "__listed")


def marked_urls(pages: DataFrame, marker: str = MARKER) -> DataFrame:
    """The block list of the query: canonical URLs of pages on a host with a marked label."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return pages.select(host.alias("h"), path.alias("p")).where(F.col("h").rlike(marker)).select(canonical(F.col("h"), F.col("p")).alias("url"))


def op2_url_filter(spark, sf_dir):
    """Every page with host, path, rule, verdict and whether it is listed. Null and schemeless urls have neither host nor
    path; repeated pages get the same answer; no pages give no rows."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, marked_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


_SPLIT = r"'^.*?://([^/?#]*)([^?#]*)'"
OP2_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), {_SPLIT}, 1, 's'), '{UPPER}', '{UPPER.lower()}') AS host,
         regexp_extract(coalesce(url, ''), {_SPLIT}, 2, 's') AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '(/|[.]html)$', '') AS canon FROM u),
l AS (SELECT DISTINCT canon AS name FROM c WHERE regexp_matches(host, '{MARKER}')),
r(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
b AS (
  SELECT c.*, (SELECT max_by(struct_pack(rule := h || p, verdict := v), length(h || p)) FROM r
               WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS x FROM c)
SELECT page_id, host, path, x.rule AS rule,
       coalesce(x.verdict, CASE WHEN name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       name IS NOT NULL AS listed
FROM b LEFT JOIN l ON canon = name
"""
