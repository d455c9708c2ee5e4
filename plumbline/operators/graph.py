"""Link graph: resolved links, degrees, orphans, candidate selection, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.evidence import TRUST


def outbound_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links with their targets' titles; a link to no document stays with nulls."""
    titles = documents.select(F.col("doc_id").alias("target_doc"), "title")
    return links.join(titles, "target_doc", "left").select("source_doc", "href", "target_doc", "title", "external")


def inbound_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Backlinks: for each resolved target, the sources' paths and titles."""
    sources = documents.select(F.col("doc_id").alias("source_doc"), "path", "title")
    return links.where(F.col("target_doc").isNotNull()).join(sources, "source_doc").select("target_doc", "source_doc", "path", "title")


def degrees(links: DataFrame, documents: DataFrame) -> DataFrame:
    """In and out degree of every document; self links and repeats count."""
    inside = links.where(F.col("target_doc").isNotNull()).groupBy(F.col("target_doc").alias("doc_id")).agg(F.count("*").alias("in_degree"))
    outside = links.where(F.col("target_doc").isNotNull()).groupBy(F.col("source_doc").alias("doc_id")).agg(F.count("*").alias("out_degree"))
    out = documents.select("doc_id").join(inside, "doc_id", "left").join(outside, "doc_id", "left")
    return out.na.fill(0, ["in_degree", "out_degree"])


def centrality(links: DataFrame, durability: DataFrame | None = None) -> DataFrame:
    """In-degree without self, external and unresolved links; repeats count, distinct citing documents beside."""
    real = links.where(~F.col("external") & F.col("target_doc").isNotNull() & (F.col("target_doc") != F.col("source_doc")))
    counts = [F.count("*").alias("in_degree"), F.count_distinct("source_doc").alias("citing_docs")]
    if durability is not None:
        real = real.join(durability.select(F.col("doc_id").alias("source_doc"), "durability"), "source_doc", "left")
        counts.append(F.max(F.coalesce(F.col("durability") == "provable", F.lit(False))).alias("cited_by_provable"))
    return real.groupBy(F.col("target_doc").alias("doc_id")).agg(*counts)


def orphans(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that no link reaches; a self link counts as reaching."""
    targets = links.where(F.col("target_doc").isNotNull()).select(F.col("target_doc").alias("doc_id"))
    return documents.join(targets, "doc_id", "left_anti").select("doc_id", "path", "title")


def broken_links(links: DataFrame) -> DataFrame:
    """Internal links with no target."""
    return links.where(~F.col("external") & F.col("target_doc").isNull()).select("source_doc", "href")


def shared_source(citations: DataFrame, claims: DataFrame, paths: DataFrame) -> DataFrame:
    """Claims that rest on one of the given archive paths."""
    touched = citations.join(paths, "archive_path", "left_semi").select("claim_id").distinct()
    return claims.join(touched, "claim_id", "left_semi")


def one_hop(citations: DataFrame, claims: DataFrame, links: DataFrame, paths: DataFrame) -> DataFrame:
    """Claims of documents one link away, either direction, from documents with an affected claim; those excluded."""
    affected = shared_source(citations, claims, paths).select("doc_id").distinct()
    edges = links.where(F.col("target_doc").isNotNull()).select("source_doc", "target_doc")
    forth = edges.join(affected, edges["source_doc"] == affected["doc_id"], "left_semi").select(F.col("target_doc").alias("doc_id"))
    back = edges.join(affected, edges["target_doc"] == affected["doc_id"], "left_semi").select(F.col("source_doc").alias("doc_id"))
    near = forth.union(back).distinct().join(affected, "doc_id", "left_anti")
    return claims.join(near, "doc_id", "left_semi")


def candidates(citations: DataFrame, claims: DataFrame, links: DataFrame, paths: DataFrame, limit: int, deferring: DataFrame) -> DataFrame:
    """``(doc_id, claim_id, rule)``: shared-source claims, one-hop claims for what is left of ``limit``, then conflict-edge ones.

    The claims of documents ``deferring (doc_id)`` a conflict come without a
    limit, but for those already there.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    keys = ["doc_id", "claim_id"]
    first = shared_source(citations, claims, paths).select(*keys).distinct().withColumns({"rule": F.lit("shared-source"), "rank": F.lit(0)})
    second = one_hop(citations, claims, links, paths).select(*keys).distinct().withColumns({"rule": F.lit("one-hop"), "rank": F.lit(1)})
    chosen = first.unionByName(second).orderBy("rank", *keys).limit(limit).select(*keys, "rule")
    edges = claims.select(*keys).distinct().join(deferring, "doc_id", "left_semi").join(chosen.select("claim_id"), "claim_id", "left_anti")
    return chosen.unionByName(edges.select(*keys, F.lit("conflict-edge").alias("rule")))


def reconcile(observed: DataFrame, indexed: DataFrame) -> DataFrame:
    """Resolutions ``(kind, id, path, other)`` between observed ``(path, id)`` and indexed ``(path, id)`` rows.

    An observed row without id is a quarantine; an id on several paths is a
    duplicate and nothing else; a known id elsewhere is update-path; an unknown
    id on a path of another id is a conflict, and that other id is no tombstone;
    any other unknown id is an index; an indexed id neither seen nor displaced is
    a tombstone.  ``path`` is the first of the paths; ``other`` is the former path
    or the displaced id.
    """
    quarantine = observed.where(F.col("id").isNull()).select(F.lit("quarantine").alias("kind"), "id", "path", F.lit(None).cast("string").alias("other"))
    seen = observed.where(F.col("id").isNotNull()).groupBy("id").agg(F.count_distinct("path").alias("n"), F.min("path").alias("path"))
    known = indexed.select("id", F.col("path").alias("old_path"))
    both = seen.join(known, "id", "full_outer")
    owner = indexed.select(F.col("path"), F.col("id").alias("owner"))
    both = both.join(owner, "path", "left")
    kind = (
        F.when(F.col("n") > 1, "duplicate")
        .when(F.col("path").isNull(), "tombstone")
        .when(F.col("old_path") == F.col("path"), F.lit(None))
        .when(F.col("old_path").isNotNull(), "update-path")
        .when(F.col("owner").isNotNull() & (F.col("owner") != F.col("id")), "conflict")
        .otherwise("index")
    )
    found = both.withColumn("kind", kind).where(F.col("kind").isNotNull())
    displaced = found.where(F.col("kind") == "conflict").select(F.col("owner").alias("id"))
    gone = found.where(F.col("kind") == "tombstone").join(displaced, "id", "left_anti")
    rest = found.where(F.col("kind") != "tombstone")
    other = F.when(F.col("kind") == "update-path", F.col("old_path")).when(F.col("kind") == "conflict", F.col("owner").cast("string"))
    out = rest.select("kind", F.col("id"), "path", other.alias("other")).unionByName(gone.select("kind", "id", F.col("old_path").alias("path"), F.lit(None).cast("string").alias("other")))
    return quarantine.withColumn("id", F.col("id").cast(indexed.schema["id"].dataType)).unionByName(out)


def reconcile_findings(resolutions: DataFrame, severity: dict[str, tuple[str, str]], kinds: tuple[str, ...]) -> DataFrame:
    """Resolutions of some kinds as findings: ``(kind, id, path, severity, action)``."""
    level, action = (F.coalesce(*[F.when(F.col("kind") == k, v[i]) for k, v in severity.items()]) for i in (0, 1))
    return resolutions.where(F.col("kind").isin(*kinds)).select("kind", "id", "path", level.alias("severity"), action.alias("action"))


def in_scope(prefix: str | None = None, kind: str | None = None, status: str | None = None, trust: str | None = None, fresh: bool = False, provable: bool = False) -> Column:
    """Whether a document with its states is in a scope.

    The prefix holds by whole segments; a blank status is stable; trust is at
    least the given tier; fresh and provable mean exactly that state.
    """
    out = F.lit(True)
    if prefix:
        out = out & ((F.col("path") == prefix) | F.col("path").startswith(prefix.rstrip("/") + "/"))
    if kind:
        out = out & (F.col("type") == kind)
    if status:
        out = out & (F.when(F.trim(F.coalesce("status", F.lit(""))) == "", "stable").otherwise(F.col("status")) == status)
    if trust:
        out = out & F.col("trust").isin(*TRUST[TRUST.index(trust) :])
    if fresh:
        out = out & (F.col("freshness") == "fresh")
    if provable:
        out = out & (F.col("durability") == "provable")
    return out


def document_cards(documents: DataFrame, indexed: DataFrame, claims: DataFrame, links: DataFrame, states: list[DataFrame]) -> DataFrame:
    """A card per document: its states, claims, links both ways, and whether the index has another hash of it."""
    counts = [
        claims.groupBy("doc_id").agg(F.count("*").alias("claims")),
        links.where(F.col("target_doc").isNotNull()).groupBy(F.col("target_doc").alias("doc_id")).agg(F.count("*").alias("n_in")),
        links.groupBy(F.col("source_doc").alias("doc_id")).agg(F.count("*").alias("n_out"), F.array_join(F.sort_array(F.collect_set("href")), ",").alias("outs")),
    ]
    out = documents.select("doc_id", "title", "content_hash")
    for part in (*states, *counts, indexed):
        out = out.join(part, "doc_id", "left")
    stale = ~F.col("content_hash").eqNullSafe(F.col("indexed_hash"))
    return out.na.fill(0, ["claims", "n_in", "n_out"]).withColumn("stale_index", stale).drop("content_hash", "indexed_hash")


def listing_by_type(documents: DataFrame) -> DataFrame:
    """Documents by type, then title; a blank type is ``untyped``.  One range sort, no group in one task."""
    kind = F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("untyped"))
    return documents.select(kind.alias("type"), "title", "doc_id").orderBy("type", "title", "doc_id")
