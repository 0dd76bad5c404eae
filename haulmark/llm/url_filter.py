"""URL filter: host and path rules, and for urls without a rule trust and distrust spread over the host graph.

Hosts of urls that a rule allows are trusted seeds, hosts of urls that a rule blocks are distrusted ones, each weighed
by such urls. Trust follows links by personalised PageRank (a page vouches for what it links to); distrust follows
them backwards (who links to a blocked host is suspect). A host is blocked when its distrust exceeds both RATIO times
its trust and one part in SHARE_OF of what it would have if a rule blocked all its urls.

Ranks are whole numbers of UNITS and all divisions are integer ones, so the result doesn't depend on the order of
additions. Only DataFrame functions are used.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits and which is
allowed; null html has no links; relative links and links to the own host are no edges; repeated pages count each;
links from and to hosts without pages take part. Only page_id, url and html are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulmark.llm._common import staged

ROUNDS, UNITS, KEEP, OF = 8, 1_000_000_000, 85, 100
RATIO, SHARE_OF = 2, 5
#: Up to so many hosts or rules (under 1 kB each) are broadcast; beyond that the joins shuffle.
BROADCAST_ROWS = 20_000
LINK = r"""(?i)(?:href|src)\s*=\s*["']([^"']*)"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(None))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """hosts(host), rules(rule, verdict) -> (host, own): the rules for the host or a domain above it, longest first.
    Of two equally long the blocking one is first."""
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    cut = F.instr("rule", "/")
    ruled = rules.select(
        F.substring("rule", F.lit(1), cut - 1).alias("domain"),
        F.struct((-F.length("rule")).alias("rank"), (F.col("verdict") != "block").alias("mild"), "rule", "verdict", F.substring("rule", cut, F.length("rule")).alias("path")).alias("r"),
    )
    fits = hosts.where("host <> ''").select("host", F.explode(above).alias("domain")).join(_small(ruled), "domain")
    return fits.groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("own"))


def host_edges(pages: DataFrame) -> DataFrame:
    """pages(host, html) -> (src, dst, n): links between different hosts, counted."""
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return (
        pages.where("host <> '' and html is not null")
        .select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
        .select("src", host_of(link).alias("dst"))
        .where("dst <> '' and dst <> src")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def _share(mass: Column, part: Column, whole: Column) -> Column:
    """floor(mass * part * KEEP / (whole * OF)) without overflow."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.floor(wide(mass) * wide(part) * F.lit(KEEP) / (wide(whole) * F.lit(OF))).cast("long")


def spread(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds(host, trust0, distrust0) -> (host, trust, distrust) after ROUNDS of both walks in one join a round."""
    both = edges.select(F.lit(0).alias("walk"), "src", "dst", "n").union(edges.select(F.lit(1), "dst", "src", "n"))
    total = staged(both.groupBy("walk", "src").agg(F.sum("n").alias("whole")), "degrees")
    graph = staged(both.join(total, ["walk", "src"]), "graph")
    seed = staged(
        seeds.select(F.lit(0).alias("walk"), "host", F.col("trust0").alias("mass")).union(seeds.select(F.lit(1), "host", "distrust0")).where("mass > 0"), "seeds"
    )
    rank = seed
    restart = seed.select("walk", "host", F.expr(f"mass - mass * {KEEP} div {OF}").alias("mass"))
    for _ in range(ROUNDS):
        moved = rank.withColumnRenamed("host", "src").join(graph, ["walk", "src"])
        moved = moved.select("walk", F.col("dst").alias("host"), _share(F.col("mass"), F.col("n"), F.col("whole")).alias("mass"))
        rank = staged(restart.union(moved).groupBy("walk", "host").agg(F.sum("mass").alias("mass")), "rank")
    mass = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("mass"))), F.lit(0))
    return rank.groupBy("host").agg(mass(0).alias("trust"), mass(1).alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust)."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    per_host = staged(own.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    known = staged(host_rules(per_host.select("host"), rules), "host_rules")
    first = F.get(F.filter("own", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
    ruled = own.select("page_id", "host", "path").join(_small(known), "host", "left")
    ruled = staged(ruled.select("page_id", "host", "path", F.when(F.col("own").isNotNull(), first).alias("r")).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled")), "ruled")

    count = lambda v: F.count(F.when(F.col("ruled") == v, 1))
    seeds = staged(ruled.where("ruled is not null").groupBy("host").agg(count("allow").alias("a"), count("block").alias("b")), "counts")
    total = F.lit(seeds.agg(F.coalesce(F.sum(F.col("a") + F.col("b")), F.lit(1))).first()[0])
    scale = lambda n: F.floor(F.col(n).cast("decimal(38,0)") * UNITS / total).cast("long")
    ranks = spread(seeds.select("host", scale("a").alias("trust0"), scale("b").alias("distrust0")), host_edges(own.select("host", "html")))
    judged = per_host.withColumn("whole", scale("pages")).join(ranks, "host", "left")
    bad = (F.col("distrust") > RATIO * F.col("trust")) & (F.col("distrust") * SHARE_OF > F.col("whole"))
    judged = staged(
        judged.select("host", F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"), F.when(bad & (F.col("host") != ""), "block").otherwise("allow").alias("found")),
        "judged",
    )
    return ruled.join(_small(judged), "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "found").alias("verdict"), "trust", "distrust")
