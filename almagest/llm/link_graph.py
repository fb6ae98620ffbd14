"""URL rules, and trust over the graph of hosts where no rule speaks.

Hosts are linked by hyperlinks in pages and by domain (a host and the domain above it, both ways). Trust is a
personalised PageRank from hosts whose pages rules allow, along links; distrust is one from hosts
whose pages rules block, against links. A page that no rule fits is blocked if its host's share of distrust
passes a threshold. All of it is joins and sums over host edges that are counted before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
ROUNDS = 20
# Pieces into which every host's pages are dealt when they meet what is known of the host, as one may hold a third of all.
SALTS = 16
# Rounds between two cuts in lineage.
CUT_EVERY = 5
BLOCK_ABOVE = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"\A([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def domains(host: Column) -> Column:
    """A host and all domains above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, host string, path string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fitting): rules of a host and the domains above it, longest first, equally long ones by text; repeats count once."""
    names = hosts.select("host", F.explode(domains(F.col("host"))).alias("domain"))
    known = rules.select(F.col("host").alias("domain"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict").distinct()
    return names.join(known, "domain").groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct((-F.length("rule")).alias("longest"), "rule", "rule_path", "verdict"))).alias("fitting")
    )


def with_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Pages beside what is known of their hosts: each host is there once per piece of its pages."""
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    copies = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.join(copies, ["host", "salt"], "left").drop("salt")


def longest_rule(fitting: Column, path: Column) -> Column:
    """First of a host's rules whose path the page's path starts with; null if none."""
    return F.try_element_at(F.filter(fitting, lambda r: F.startswith(path, r["rule_path"])), F.lit(1))


def host_edges(pages: DataFrame) -> DataFrame:
    """(source, target, weight): counted hyperlinks between different hosts, and one step up and down each domain."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))
    links = pages.select(F.col("host").alias("source"), F.explode(targets).alias("target")).where("source <> target AND source <> ''")
    links = links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = pages.select("host").where("host <> ''").union(links.select("target")).distinct()
    chain = F.filter(domains(F.col("host")), lambda d: F.size(F.split(d, r"\.")) >= 2)
    steps = F.zip_with(chain, F.slice(chain, 2, F.size(chain) + 1), lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    up = hosts.where(F.size(chain) >= 2).select(F.inline(F.filter(steps, lambda s: s["target"].isNotNull()))).distinct()
    both = up.unionByName(up.select(F.col("target").alias("source"), F.col("source").alias("target")))
    every = links.unionByName(both.withColumn("weight", F.lit(1.0)))
    return every.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust), each kind of seed summing to one.

    Trust runs along edges, distrust against them. What reaches a host without a way on leaves the walk.
    """
    forth = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "weight")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "weight")
    ways = forth.unionByName(back)
    out = ways.groupBy("kind", "from").agg(F.sum("weight").alias("out"))
    ways = cut(ways.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("weight") / F.col("out")).alias("share")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed")).where("seed > 0")
    total = start.groupBy("kind").agg(F.sum("seed").alias("total"))
    start = cut(start.join(total, "kind").select("kind", "host", (F.col("seed") / F.col("total")).alias("rank")))
    ranks = start
    for step in range(1, rounds + 1):
        passed = ranks.withColumnRenamed("host", "from").join(ways, ["kind", "from"]).select(
            "kind", F.col("to").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank")
        )
        renewed = start.select("kind", "host", (F.lit(1 - damping) * F.col("rank")).alias("rank"))
        ranks = passed.unionByName(renewed).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0:
            ranks = cut(ranks)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", html: str = "html", key: str = "page_id",
    damping: float = DAMPING, rounds: int = ROUNDS, block_above: float = BLOCK_ABOVE,
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust (of the host).

    A rule's verdict holds where one fits. Else the page is blocked if distrust / (trust + distrust) of its
    host passes ``block_above``; a host that neither reaches is allowed. Pages without a host (null urls, or
    without ``://``) fit no rule and are allowed. Null html has no links. Repeated rows stay; other columns
    are not read; an empty table gives no rows.
    """
    rows = pages.select(
        F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).cast("string").alias("html")
    )
    paths = rows.select("page_id", "host", "path")
    by_host = cut(host_rules(paths.select("host").distinct(), rule_table(pages.sparkSession, rules)))
    seen = with_host(paths, by_host).withColumn("rule_verdict", longest_rule(F.col("fitting"), F.col("path"))["verdict"])
    count = lambda v: F.count(F.when(F.col("rule_verdict") == v, 1)).cast("double")
    seeds = seen.where("rule_verdict IS NOT NULL").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    ranks = propagate(host_edges(rows), seeds, damping, rounds)
    found = with_host(paths, by_host.join(ranks, "host", "full")).withColumn("fit", longest_rule(F.col("fitting"), F.col("path")))
    share = F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    own = F.when(F.coalesce(share > block_above, F.lit(False)), "block").otherwise("allow")
    return found.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
