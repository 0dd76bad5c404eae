"""op6: verdicts on the urls of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulmark.llm._common import table
from haulmark.llm.url_filter import KEEP, LINK, OF, RATIO, ROUNDS, SHARE_OF, UNITS, judge

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _host(url: str) -> str:
    return f"coalesce(CASE WHEN strpos({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), {_AZ}) END, '')"


def _sql() -> str:
    rules = ", ".join(f"('{r}', '{v}', split_part('{r}', '/', 1), substr('{r}', strpos('{r}', '/')))" for r, v in RULES)
    rounds = "".join(
        f""",
r{i + 1} AS (SELECT walk, host, sum(mass) AS mass FROM (
  SELECT walk, host, mass - mass * {KEEP} // {OF} AS mass FROM seed UNION ALL
  SELECT g.walk, g.dst, (r.mass::HUGEINT * g.n * {KEEP}) // (g.whole::HUGEINT * {OF}) FROM r{i} r JOIN graph g ON g.walk = r.walk AND g.src = r.host) GROUP BY ALL)"""
        for i in range(ROUNDS)
    )
    link = LINK.replace("'", "''")
    target = "CASE WHEN link LIKE '//%' THEN 'http:' || link ELSE link END"
    return f"""
WITH rules(rule, verdict, domain, prefix) AS (VALUES {rules}),
own AS (SELECT page_id, html, {_host("url")} AS host,
  coalesce(CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path,
  row_number() OVER () AS n FROM pages),
fit AS (SELECT n, rule, verdict FROM own JOIN rules ON (host = domain OR host LIKE '%.' || domain) AND starts_with(path, prefix)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, verdict DESC) = 1),
ruled AS (SELECT own.*, rule, verdict AS ruled FROM own LEFT JOIN fit USING (n)),
counts AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM ruled WHERE ruled IS NOT NULL GROUP BY host),
total AS (SELECT coalesce(sum(a + b), 1) AS t FROM counts),
seed AS (SELECT * FROM (SELECT 0 AS walk, host, a::HUGEINT * {UNITS} // t AS mass FROM counts, total UNION ALL SELECT 1, host, b::HUGEINT * {UNITS} // t FROM counts, total) WHERE mass > 0),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM own WHERE host <> '' AND html IS NOT NULL),
edges AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {_host(target)} AS dst FROM links) WHERE dst <> '' AND dst <> src GROUP BY ALL),
both_ AS (SELECT 0 AS walk, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges),
graph AS (SELECT *, sum(n) OVER (PARTITION BY walk, src) AS whole FROM both_),
r0 AS (SELECT walk, host, mass FROM seed){rounds},
ranks AS (SELECT host, coalesce(sum(mass) FILTER (walk = 0), 0) AS trust, coalesce(sum(mass) FILTER (walk = 1), 0) AS distrust FROM r{ROUNDS} GROUP BY host),
hosts AS (SELECT host, count(*)::HUGEINT * {UNITS} // (SELECT t FROM total) AS whole FROM own GROUP BY host),
judged AS (SELECT host, CASE WHEN distrust > {RATIO} * trust AND distrust * {SHARE_OF} > whole AND host <> '' THEN 'block' ELSE 'allow' END AS found FROM hosts LEFT JOIN ranks USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, found) AS verdict FROM ruled JOIN judged USING (host)
"""


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLES = {"op6_url_filter": _sql()}
