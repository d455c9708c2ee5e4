"""URL filter by link-graph propagation.

Hosts are nodes; a link from a page of one host to another host is an edge, and
so are a host and its parent domain, both ways, and so on up to the domain of two
labels, whether those have pages or not: hosts of one domain connect through it.
A domain of one label (``com``) is no site and needs pages to be a node.  Trust is
a personalised PageRank that starts from hosts with pages under an allow rule;
distrust is the same walk over reversed edges from hosts with pages under a block
rule (who links to bad hosts is suspect).  Scores are in page equivalents.  A
page under a rule gets the rule's verdict; any other gets its host's: block if the
distrust that flows in reaches ``threshold`` of the host's pages and outweighs the
trust that flows in.  A host's own seed doesn't count there: a rule for one path
says nothing about the host's other paths.

Both walks go on together until they have converged: what is still under way, the
L1 residual, is at most ``tolerance`` of the seeds' mass, as each step passes on no
more than ``damping`` of it.  At a millionth that is 86 steps.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.line_dedup import _ASCII_LOWER, _UPPER
from plumbline.llm.scratch import Scratch, column, fresh, without

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    found = F.coalesce(F.locate("://", F.coalesce(url, F.lit(""))), F.lit(0)) > 0
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _ASCII_LOWER)
    return F.when(found, host).otherwise(""), F.when(found, F.regexp_extract(url, pattern, 2)).otherwise("")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct ``(src, dst, n)`` of links between different hosts, counted before the shuffle."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""), F.lit(1))
    hosts = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    hosts = hosts.withColumn("dst", F.translate("dst", _UPPER, _ASCII_LOWER)).where((F.col("src") != "") & (F.col("src") != F.col("dst")))
    return hosts.groupBy("src", "dst").agg(F.count("*").alias("n"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """Edges both ways between each host or ancestor domain and its parent domain.

    Parents of one label are taken only if they are in ``hosts``; addresses of
    digits have no parent.  A domain's weight is shared by all it is joined to.
    """
    labels = F.split("host", r"\.")
    named = hosts.where(~F.col("host").rlike(r"^[0-9.]+(:[0-9]*)?$")).select(labels.alias("l"))
    steps = named.where(F.size("l") > 1).select("l", F.explode(F.sequence(F.lit(1), F.size("l") - 1)).alias("i"))
    src, dst = (F.array_join(F.expr(f"slice(l, {start}, size(l))"), ".") for start in ("i", "i + 1"))
    up = steps.select(src.alias("src"), dst.alias("dst"), (F.size("l") - F.col("i") == 1).alias("top")).where("dst <> ''").distinct()
    bare = up.where("top").join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi")
    up = up.where("NOT top").select("src", "dst").unionByName(bare.select("src", "dst")).withColumn("n", F.lit(1).cast("long"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))


def shares(edges: DataFrame) -> DataFrame:
    """``(walk, src, dst, share)``: the links for trust, the links turned round for distrust."""
    turned = edges.select(F.lit("distrust").alias("walk"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n").unionByName(turned)
    out = both.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    return both.join(out, ["walk", "src"]).select("walk", "src", "dst", (F.col("n") / F.col("total")).alias("share"))


def rounds_for(damping: float, tolerance: float) -> int:
    """Steps after which at most ``tolerance`` of the mass is under way."""
    return max(1, ceil(log(tolerance) / log(damping)))


#: Edges that a task of the walk takes.
_EDGES = 200_000


def propagate(shared: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float, tolerance: float, cut_every: int = 6) -> DataFrame:
    """Personalised PageRank from ``(walk, host, seed)``; ``(walk, host, score)`` without the seeds' own part.

    Each step is one join of scores with out-edges and one aggregation with
    map-side sums, in as many tasks as the number of edges asks for: a graph that
    is much smaller than the pages would else leave files of a few bytes at every
    step.  Lineage is cut by a written table every ``cut_every`` steps.
    """
    parts = max(1, ceil(shared.count() / _EDGES))
    base = seeds.select("walk", "host", (F.col("seed") * (1 - damping)).alias("score")).coalesce(parts)
    scores, rounds = base, rounds_for(damping, tolerance)
    for i in range(1, rounds + 1):
        moved = shared.join(scores.withColumnRenamed("host", "src"), ["walk", "src"])
        moved = moved.select("walk", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score")).coalesce(parts)
        scores = (moved if i == rounds else base.unionByName(moved)).coalesce(parts).groupBy("walk", "host").agg(F.sum("score").alias("score")).coalesce(parts)
        if i % cut_every == 0 or i == rounds:
            scores = scratch.put(scores, f"scores_{i}")
    return scores


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = 0.05, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """The input's columns plus ``host, path, rule, verdict, trust, distrust``.

    A host's seed is its number of pages under block (or allow) rules.  Null or
    malformed URLs have an empty host, fit no rule and are allowed; null html has
    no links.  Repeated pages count again as evidence and each gets a row.  With
    no seeds nothing propagates.  Very long pages are searched for links whole.  An
    empty table gives no rows.  Columns named like the added ones are replaced.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    host, path = url_parts(F.col("url"))
    added = ["host", "path", "rule", "verdict", "trust", "distrust"]
    kept = without(pages.columns, added)
    ruled, n_pages = fresh([*pages.columns, *added, "html"], "ruled", "n_pages")
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    parted = pages.select(*map(column, kept)).withColumns({"host": host, "path": path}).withColumns({"rule": name, ruled: verdict})

    counts = [F.count("*").alias(n_pages), *(F.count_if(F.col(ruled) == x).alias(x) for x in ("allow", "block"))]
    hosts = scratch.put(parted.where(F.col("host") != "").groupBy("host").agg(*counts), "hosts")
    edges = host_edges(parted).unionByName(site_edges(hosts)).groupBy("src", "dst").agg(F.sum("n").alias("n"))
    shared = scratch.put(shares(scratch.put(edges, "edges")), "shares")
    seeds = hosts.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("walk"), F.col("allow").alias("seed")), F.struct(F.lit("distrust").alias("walk"), F.col("block").alias("seed")))).alias("x"))
    seeds = seeds.select("x.walk", "host", "x.seed").where("seed > 0")
    found = propagate(shared, seeds, scratch, damping, tolerance)
    found = found.groupBy("host").agg(*(F.sum(F.when(F.col("walk") == x, F.col("score"))).alias(x) for x in ("trust", "distrust")))
    scored = scratch.put(hosts.select("host", n_pages).join(found, "host", "left").na.fill(0.0, ["trust", "distrust"]), "scored")
    out = parted.join(scored, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= F.col(n_pages) * threshold) & (F.col("distrust") > F.col("trust"))
    out = out.withColumn("verdict", F.coalesce(ruled, F.when(bad, "block").otherwise("allow")))
    return out.select(*map(column, [*kept, *added]))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_pages(pages).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
