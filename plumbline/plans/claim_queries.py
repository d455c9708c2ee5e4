"""Queries of further claim checks and pairs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import claims
from plumbline.plans.registry import query


@query("check_challenge_age", "SELECT event_id AS challenge_id, CASE WHEN event_id % 11 = 0 THEN 'unreadable-date' ELSE 'aged' END AS problem FROM events WHERE user_id % 3 <> 1 AND (event_id % 11 = 0 OR date_diff('day', ts::DATE, DATE '2024-02-15') > 30)")
def _(c):
    state = F.when(F.col("user_id") % 3 == 0, "open").when(F.col("user_id") % 3 == 1, "closed").otherwise(" ")
    opened = F.when(F.col("event_id") % 11 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd"))
    rows = c.raw("events").select(F.col("event_id").alias("challenge_id"), state.alias("state"), opened.alias("opened"))
    return claims.aged_challenges(rows, F.lit("2024-02-15").cast("date"), 30)


@query("check_schema_version", "SELECT o_orderkey AS doc_id, nullif(o_custkey % 4, 0) AS schema_version FROM orders WHERE o_custkey % 4 < 3")
def _(c):
    rows = c.raw("orders").select(F.col("o_orderkey").alias("doc_id"), F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("schema_version"))
    return claims.schema_versions(rows, 3)


@query("check_limitations", "SELECT doc_id, type FROM docs WHERE type IN ('1-URGENT', '2-HIGH') AND doc_id % 3 = 0")
def _(c):
    limits = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("title"))
    rows = c.documents().withColumn("limitations", limits)
    return rows.where(F.col("type").isin("1-URGENT", "2-HIGH") & (F.size("limitations") == 0)).select("doc_id", "type")


@query("check_subject_missing", "SELECT c.claim_id, type FROM claims c JOIN docs USING (doc_id) WHERE type = '1-URGENT' AND c.claim_id NOT IN (SELECT claim_id FROM citations WHERE uri % 3 = 0)")
def _(c):
    expecting = c.claims().join(c.documents().where(F.col("type") == "1-URGENT").select("doc_id", "type"), "doc_id")
    return expecting.join(c.citations().where("uri % 3 = 0").select("claim_id"), "claim_id", "left_anti").select("claim_id", "type")


@query("check_subject_unknown", "SELECT DISTINCT claim_id, uri FROM citations WHERE uri NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def _(c):
    known = c.raw("part").where("p_size > 10").select(F.col("p_partkey").alias("uri"))
    return c.citations().select("claim_id", "uri").distinct().join(known, "uri", "left_anti").select("claim_id", "uri")


@query("check_constraint_drift", "SELECT claim_id, value::INTEGER::VARCHAR AS value FROM bounds WHERE NOT regexp_matches(' The limit is ' || (CASE WHEN subject % 4 = 0 THEN value * 10 ELSE value END)::INTEGER || ' now. ', '[^0-9.]' || value::INTEGER || '[^0-9.]')")
def _(c):
    value = F.col("value").cast("int").cast("string")
    stated = F.when(F.col("subject") % 4 == 0, (F.col("value") * 10).cast("int")).otherwise(F.col("value").cast("int"))
    rows = c.bounds().select("claim_id", F.concat(F.lit("The limit is "), stated, F.lit(" now.")).alias("text"), value.alias("value"))
    return claims.pinned_values(rows)


@query("cite_check", "WITH r AS (SELECT doc_id, list(DISTINCT uri) AS cites, list(DISTINCT uri) FILTER (WHERE uri % 50 <> 0) AS offered FROM citations GROUP BY 1) SELECT doc_id AS reply_id, CASE WHEN len(list_filter(cites, lambda x: NOT list_contains(coalesce(offered, []), x))) > 0 THEN 'unknown-cite' WHEN doc_id % 7 = 0 THEN 'no-title' END AS problem FROM r")
def _(c):
    offered = F.collect_set(F.when(F.col("uri") % 50 != 0, F.col("uri")))
    rows = c.citations().groupBy(F.col("doc_id").alias("reply_id")).agg(F.collect_set("uri").alias("cites"), offered.alias("offered"))
    rows = rows.withColumn("title", F.when(F.col("reply_id") % 7 != 0, "t")).withColumn("answered", F.lit(True))
    return claims.cite_check(rows)


@query("resolve_refs", "SELECT o_orderkey || '#' || (o_custkey % 9) AS ref, claim_id, claim_id IS NULL AS missing FROM orders LEFT JOIN claims ON claim_id = o_orderkey || '#' || (o_custkey % 9)")
def _(c):
    return claims.resolve_refs(c.raw("orders").select(F.concat_ws("#", "o_orderkey", F.col("o_custkey") % 9).alias("ref")), c.claims())


@query("list_sources", "SELECT uri, version, archive_path, disposition, byte_size FROM records")
def _(c):
    return c.records().orderBy("uri", "version")


@query("list_claim_subjects", "SELECT claim_id, subject, op, value, dimension FROM bounds")
def _(c):
    return c.bounds().select("claim_id", "subject", "op", "value", "dimension").orderBy("subject", "claim_id")


_PAIRS = """p AS (SELECT subject, claim_id, value > 5 AS parsed FROM bounds), q AS (SELECT DISTINCT a.subject, least(a.claim_id, b.claim_id) AS first, greatest(a.claim_id, b.claim_id) AS second FROM p a JOIN p b ON a.subject = b.subject AND NOT a.parsed AND (a.claim_id < b.claim_id OR (b.parsed AND a.claim_id <> b.claim_id))),
pairs AS (SELECT subject, first, second, substr(sha256(first || chr(0) || second), 1, 16) AS pair_id FROM q)"""


@query("pair_review_inputs", f"WITH {_PAIRS}, src AS (SELECT claim_id, min(archive_path) AS source FROM citations WHERE archive_path IN (SELECT archive_path FROM records WHERE disposition <> 'referenced') GROUP BY 1) SELECT pair_id, a.source AS first_source, b.source AS second_source, a.source IS NULL OR b.source IS NULL AS skipped FROM pairs LEFT JOIN src a ON a.claim_id = first LEFT JOIN src b ON b.claim_id = second")
def _(c):
    return claims.pair_inputs(c.bounds().select("subject", "claim_id", (F.col("value") > 5).alias("parsed")), c.citations(), c.records())


_EDGES = "edges AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN -o_orderkey ELSE o_orderkey END AS concept, substr(sha256(o_orderkey || '#1' || chr(0) || o_orderkey || '#2'), 1, 16) AS pair_id FROM orders)"


def _edges(c):
    key = F.col("o_orderkey")
    concept = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, -key).otherwise(key)
    return c.raw("orders").select(key.alias("doc_id"), concept.alias("concept"), F.concat(key, F.lit("#1")).alias("first"), F.concat(key, F.lit("#2")).alias("second"))


@query("stale_conflict_edge", f"WITH {_PAIRS}, {_EDGES} SELECT doc_id, CASE WHEN concept IS NULL THEN 'incomplete' WHEN concept NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown-concept' ELSE 'no-live-pair' END AS problem FROM edges WHERE concept IS NULL OR concept NOT IN (SELECT o_orderkey FROM orders) OR pair_id NOT IN (SELECT pair_id FROM pairs)")
def _(c):
    return claims.stale_edges(_edges(c), c.documents(), c.bounds().select("claim_id", "subject", (F.col("value") > 5).alias("parsed")))


@query("candidates_conflict_edge", f"WITH {_EDGES} SELECT claim_id FROM claims WHERE doc_id IN (SELECT doc_id FROM edges WHERE concept % 100 = 2) AND claim_id NOT IN (SELECT claim_id FROM citations WHERE uri = 8)")
def _(c):
    deferring = _edges(c).where(F.col("concept") % 100 == 2).select("doc_id")
    chosen = c.citations().where("uri = 8").select("claim_id")
    return c.claims().join(deferring, "doc_id", "left_semi").join(chosen, "claim_id", "left_anti").select("claim_id")


@query("fold_lower", r"SELECT doc_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS folded FROM docs")
def _(c):
    return c.documents().select("doc_id", fx.fold_lower(F.col("title")).alias("folded"))


