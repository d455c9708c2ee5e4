"""The library's queries over the given tables, each with its SQL.

Importing this module registers them; ``QUERIES`` and ``ORACLE_SQL`` hold them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import conflict, digest, evidence, graph, sampling, trail
from plumbline.plans.registry import ORACLE_SQL, QUERIES, query
from plumbline.sources.scratch import fresh_folder

__all__ = ["ORACLE_SQL", "QUERIES"]



def now():
    return F.lit("2003-06-01").cast("date")


def since():
    return F.lit("2024-01-15").cast("timestamp")


# ---------------------------------------------------------------- sources


@query("checks_latest", 'SELECT uri, version, "at", drift FROM checks QUALIFY row_number() OVER (PARTITION BY uri, version ORDER BY "at" DESC, line DESC, drift DESC) = 1')
def _(c):
    return evidence.latest_checks(c.checks())


@query("retrievals_latest", 'SELECT claim_id, line, "at" FROM retrievals QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY line DESC) = 1')
def _(c):
    return trail.last_per_key(c.retrievals(), ["claim_id"], ["line"])


@query("read_records", "SELECT * FROM records")
def _(c):
    return c.records()


@query("read_sessions", "SELECT session_id, pos, role, text FROM turns WHERE trim(coalesce(text, '')) <> ''")
def _(c):
    return c.turns().where(F.trim(F.coalesce("text", F.lit(""))) != "")


_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
'(?i)<(/?(p|div|li|ul|h[1-6]|article|nav|footer|header|section|tr|table)|br)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ' || chr(10))"""


@query("extract_html", f"SELECT page_id, {_HTML} AS text FROM pages")
def _(c):
    return c.raw("pages").select("page_id", fx.html_text(F.coalesce("html", F.lit(""))).alias("text"))


def indexed_tables(c):
    """The nine tables that a digest of the index covers."""
    part = c.raw("part")
    return {
        "documents": c.documents(), "links": c.links(), "claims": c.claims(), "records": c.records(), "claim_sources": c.citations(), "verifications": c.verifications(), "claim_subjects": c.bounds(),
        "subjects": part.select(F.col("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("dimension"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("description")),
        "subject_aliases": part.select(F.concat(F.lit("part "), "p_partkey").alias("alias"), F.concat(F.lit("k"), "p_partkey").alias("key")),
    }


_SQL_TABLES_OF = {
    "documents": "docs", "links": "links", "claims": "claims", "records": "records", "claim_sources": "citations", "verifications": "verifications", "claim_subjects": "bounds",
    "subjects": "(SELECT p_partkey AS key, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS dimension, CASE WHEN p_size % 3 <> 0 THEN p_type END AS description FROM part)",
    "subject_aliases": "(SELECT 'part ' || p_partkey AS alias, 'k' || p_partkey AS key FROM part)",
}


def _digest_sql(name: str, spec: str) -> str:
    """Entries ``{name}_root (rows, digest)``: ordered rows, cut by their hashes, blocks and three levels of nodes."""
    order, rest = digest.columns_of(spec)
    row = " || ".join(f"coalesce('1' || strlen(\"{x}\"::VARCHAR) || ':' || \"{x}\"::VARCHAR, '0')" for x in [*order, *rest])
    out = [
        f"{name}_r AS (SELECT {', '.join(f'any_value(k{i}) AS k{i}' for i in range(len(order)))}, count(*) AS n, sha256(row || 'x' || count(*)) AS h FROM (SELECT {row} AS row, {', '.join(f'{chr(34)}{x}{chr(34)}::VARCHAR AS k{i}' for i, x in enumerate(order))} FROM {_SQL_TABLES_OF[name]}) GROUP BY row)",
        f"{name}_o AS (SELECT n, h, row_number() OVER (ORDER BY {', '.join(f'k{i} NULLS FIRST' for i in range(len(order)))}, h) AS place FROM {name}_r)",
        f"{name}_b AS (SELECT n, h, place, coalesce(sum(CASE WHEN ('0x' || substr(h, 50, 15))::BIGINT % 4096 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block FROM {name}_o)",
        f"{name}_0 AS (SELECT block, sum(n)::BIGINT AS rows, sha256(string_agg(h, '' ORDER BY place)) AS digest FROM {name}_b GROUP BY 1)",
    ]
    for k in range(3):
        out.append(f"{name}_{k + 1} AS (SELECT block // 64 AS block, sum(rows)::BIGINT AS rows, CASE WHEN (SELECT count(*) FROM {name}_{k}) > 1 THEN sha256(string_agg(digest, '' ORDER BY block)) ELSE any_value(digest) END AS digest FROM {name}_{k} GROUP BY 1)")
    return ", ".join([*out, f"{name}_root AS (SELECT coalesce(sum(rows), 0)::BIGINT AS rows, coalesce(max(digest), sha256('')) AS digest FROM {name}_3)"])


_ROOTS = " UNION ALL ".join(f"SELECT '{n}' AS name, rows, digest FROM {n}_root" for n in digest.DIGESTED)


@query("table_digest", f"""WITH {', '.join(_digest_sql(n, s) for n, s in digest.DIGESTED.items())}, each AS ({_ROOTS})
SELECT * FROM each UNION ALL SELECT 'index', sum(rows)::BIGINT, sha256(string_agg('table:' || name || ':' || digest || ';', '' ORDER BY name)) FROM each""")
def _(c):
    return digest.index_digest(digest.index_blocks(indexed_tables(c)), list(digest.DIGESTED))


@query("floor_check", "SELECT (SELECT count(*) FROM docs) AS previous, (SELECT count(*) FROM docs WHERE status = 'stable') AS now, (SELECT count(*) FROM docs WHERE status = 'stable') < 0.5 * (SELECT count(*) FROM docs) AS breached")
def _(c):
    out = c.documents().agg(F.count("*").alias("previous"), F.count_if(F.col("status") == "stable").alias("now"))
    return out.withColumn("breached", F.col("now") < 0.5 * F.col("previous"))


# ---------------------------------------------------------------- lookups


@query("find_document", "SELECT d.doc_id, d.path, coalesce(i.n, 0)::BIGINT AS n_in, coalesce(o.n, 0)::BIGINT AS n_out FROM docs d LEFT JOIN (SELECT target_doc, count(*) n FROM links WHERE target_doc IS NOT NULL GROUP BY 1) i ON i.target_doc = d.doc_id LEFT JOIN (SELECT source_doc, count(*) n FROM links GROUP BY 1) o ON o.source_doc = d.doc_id WHERE regexp_extract(d.path, '([0-9]+)[.]md$', 1) IN ('8', '16', '24')")
def _(c):
    links = c.links()
    inside = links.where(F.col("target_doc").isNotNull()).groupBy(F.col("target_doc").alias("doc_id")).agg(F.count("*").alias("n_in"))
    outside = links.groupBy(F.col("source_doc").alias("doc_id")).agg(F.count("*").alias("n_out"))
    d = c.documents().where(F.regexp_extract("path", r"([0-9]+)[.]md$", 1).isin("8", "16", "24"))
    return d.join(inside, "doc_id", "left").join(outside, "doc_id", "left").na.fill(0, ["n_in", "n_out"]).select("doc_id", "path", "n_in", "n_out")


@query("list_indexed", "SELECT doc_id, path, type, title, status FROM docs")
def _(c):
    return c.documents().select("doc_id", "path", "type", "title", "status").orderBy("doc_id")


@query("list_claims", "SELECT c.claim_id, c.lead, d.path FROM claims c LEFT JOIN docs d USING (doc_id)")
def _(c):
    return c.claims().join(c.documents().select("doc_id", "path"), "doc_id", "left").select("claim_id", "lead", "path").orderBy("claim_id", "path")


@query("list_claim_sources", "SELECT claim_id, archive_path, count(*) AS times FROM citations GROUP BY ALL")
def _(c):
    return c.citations().groupBy("claim_id", "archive_path").agg(F.count("*").alias("times")).orderBy("claim_id", "archive_path")


@query("prior_rationales", "SELECT line, actor, \"at\" FROM trail WHERE op = 'promote' AND outcome = 'ok' AND path = 'c/7'")
def _(c):
    return trail.prior_rationales(c.trail(), "c/7")


@query("adjudications", "SELECT DISTINCT actor, path FROM trail WHERE op = 'promote' AND outcome = 'ok' AND actor <> ''")
def _(c):
    return c.trail().where((F.col("op") == "promote") & (F.col("outcome") == "ok") & (F.col("actor") != "")).select("actor", "path").distinct()


@query("trail_validate", "SELECT line, 'actor' AS problems FROM trail WHERE trim(actor) = ''")
def _(c):
    return trail.trail_validate(c.trail())


@query("listing_by_type", "SELECT type, title, doc_id FROM docs ORDER BY 1, 2, 3")
def _(c):
    return graph.listing_by_type(c.documents())


# ---------------------------------------------------------------- links and candidates

@query("outbound_links", "SELECT source_doc, href, target_doc, title, external FROM links LEFT JOIN docs ON doc_id = target_doc")
def _(c):
    return graph.outbound_links(c.links(), c.documents())


@query("inbound_links", "SELECT target_doc, source_doc, path, title FROM links JOIN docs ON doc_id = source_doc WHERE target_doc IS NOT NULL")
def _(c):
    return graph.inbound_links(c.links(), c.documents())


@query("link_graph_degrees", "SELECT doc_id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM docs LEFT JOIN (SELECT target_doc AS doc_id, count(*) i FROM links WHERE target_doc IS NOT NULL GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT source_doc AS doc_id, count(*) o FROM links WHERE target_doc IS NOT NULL GROUP BY 1) USING (doc_id)")
def _(c):
    return graph.degrees(c.links(), c.documents())


@query("centrality", "SELECT target_doc AS doc_id, count(*) AS in_degree, count(DISTINCT source_doc) AS citing_docs FROM links WHERE NOT external AND target_doc IS NOT NULL AND target_doc <> source_doc GROUP BY 1")
def _(c):
    return graph.centrality(c.links())


@query("orphan_documents", "SELECT doc_id, path, title FROM docs WHERE doc_id NOT IN (SELECT target_doc FROM links WHERE target_doc IS NOT NULL)")
def _(c):
    return graph.orphans(c.links(), c.documents())


@query("broken_link", "SELECT source_doc, href FROM links WHERE NOT external AND target_doc IS NULL")
def _(c):
    return graph.broken_links(c.links())


@query("current_record", "SELECT uri, version, archive_path, disposition FROM records QUALIFY row_number() OVER (PARTITION BY uri ORDER BY disposition <> 'referenced' DESC, version DESC) = 1")
def _(c):
    return evidence.current_record(c.records())


_RECONCILE = """WITH obs AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'new/' || o_orderkey WHEN o_orderkey % 29 = 0 THEN 'c/' || (o_orderkey + 1) ELSE 'c/' || o_orderkey END AS path FROM orders WHERE o_orderkey % 17 <> 0),
idx AS (SELECT o_orderkey AS id, 'c/' || o_orderkey AS path FROM orders WHERE o_orderkey % 19 <> 0),
seen AS (SELECT id, count(DISTINCT path) AS n, min(path) AS path FROM obs WHERE id IS NOT NULL GROUP BY id),
j AS (SELECT coalesce(s.id, i.id) AS id, s.n, s.path, i.path AS old_path, o.id AS owner FROM seen s FULL JOIN idx i ON s.id = i.id LEFT JOIN idx o ON o.path = s.path),
k AS (SELECT *, CASE WHEN n > 1 THEN 'duplicate' WHEN path IS NULL THEN 'tombstone' WHEN old_path = path THEN NULL WHEN old_path IS NOT NULL THEN 'update-path' WHEN owner IS NOT NULL AND owner <> id THEN 'conflict' ELSE 'index' END AS kind FROM j)
SELECT 'quarantine' AS kind, id, path, NULL::VARCHAR AS other FROM obs WHERE id IS NULL
UNION ALL SELECT kind, id, CASE WHEN kind = 'tombstone' THEN old_path ELSE path END, CASE kind WHEN 'update-path' THEN old_path WHEN 'conflict' THEN owner::VARCHAR END FROM k
WHERE kind IS NOT NULL AND NOT (kind = 'tombstone' AND id IN (SELECT owner FROM k WHERE kind = 'conflict'))"""


@query("reconcile", _RECONCILE)
def _(c):
    o = c.raw("orders")
    key = F.col("o_orderkey")
    path = F.when(key % 13 == 0, F.concat(F.lit("new/"), key)).when(key % 29 == 0, F.concat(F.lit("c/"), key + 1)).otherwise(F.concat(F.lit("c/"), key))
    observed = o.where(key % 17 != 0).select(F.when(key % 11 != 0, key).alias("id"), path.alias("path"))
    indexed = o.where(key % 19 != 0).select(key.alias("id"), F.concat(F.lit("c/"), key).alias("path"))
    return graph.reconcile(observed, indexed)


# ---------------------------------------------------------------- evidence and derived states

_RANK = "CASE WHEN \"by\" IS NULL OR trim(\"by\") = '' THEN 0 WHEN \"by\" LIKE 'human:_%' THEN 2 ELSE 1 END"
_TRUST = "list_extract(['unverified', 'machine-confirmed', 'human-reviewed'], coalesce(r, 0) + 1)"


@query("trust_claim", f"SELECT doc_id, claim_id, {_TRUST} AS trust FROM claims LEFT JOIN (SELECT claim_id, max({_RANK}) AS r FROM verifications GROUP BY 1) USING (claim_id)")
def _(c):
    return evidence.trust_claim(c.claims(), c.verifications())


@query("trust_document", f"SELECT doc_id, {_TRUST} AS trust FROM docs LEFT JOIN (SELECT doc_id, min(coalesce(r, 0)) AS r FROM claims LEFT JOIN (SELECT claim_id, max({_RANK}) AS r FROM verifications GROUP BY 1) USING (claim_id) GROUP BY 1) USING (doc_id)")
def _(c):
    return evidence.trust_document(c.documents(), c.claims(), c.verifications())


_LAST = 'last_check AS (SELECT uri, version, "at", drift FROM checks QUALIFY row_number() OVER (PARTITION BY uri, version ORDER BY "at" DESC, line DESC, drift DESC) = 1)'


@query("freshness_document", f"""WITH {_LAST}, s AS (SELECT doc_id, count(*) AS n, count("at") AS k, min("at") AS oldest FROM (SELECT DISTINCT doc_id, uri, version FROM citations) LEFT JOIN last_check USING (uri, version) GROUP BY 1)
SELECT doc_id, CASE WHEN n IS NULL THEN 'not_applicable' WHEN k < n THEN 'unknown' WHEN DATE '2003-06-01' >= stale_after THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN k = n THEN oldest END AS oldest FROM docs LEFT JOIN s USING (doc_id)""")
def _(c):
    return evidence.freshness_document(c.documents(), c.citations(), c.checks(), now())


@query("freshness_claim", f"""WITH {_LAST}, s AS (SELECT doc_id, claim_id, count(*) AS n, count("at") AS k FROM (SELECT DISTINCT doc_id, claim_id, uri, version FROM citations) LEFT JOIN last_check USING (uri, version) GROUP BY ALL)
SELECT claim_id, CASE WHEN k < n THEN 'unknown' WHEN DATE '2003-06-01' >= stale_after THEN 'stale' ELSE 'fresh' END AS freshness FROM s LEFT JOIN docs USING (doc_id)""")
def _(c):
    return evidence.freshness_claim(c.citations(), c.checks(), c.documents(), now())


@query("weakest_drift", f"""WITH {_LAST}, s AS (SELECT doc_id, archive_path, drift FROM (SELECT DISTINCT doc_id, uri, version, archive_path FROM citations) LEFT JOIN last_check USING (uri, version))
SELECT doc_id, CASE WHEN bool_or(coalesce(drift = 'unsupported', false)) THEN 'unsupported' WHEN bool_or(drift IS NULL) THEN 'unchecked' ELSE arg_min(drift, archive_path) END AS drift FROM s GROUP BY 1""")
def _(c):
    return evidence.weakest_drift(c.citations(), c.checks())


_DURABLE = """durability AS (SELECT d.doc_id, CASE WHEN n IS NULL THEN 'not-applicable' WHEN ok = n THEN 'provable' WHEN ok = 0 THEN 'unprovable' ELSE 'partly-provable' END AS durability FROM docs d LEFT JOIN
(SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE durable) AS ok FROM (SELECT DISTINCT doc_id, uri FROM citations) LEFT JOIN (SELECT uri, bool_or(disposition <> 'referenced') AS durable FROM records GROUP BY 1) USING (uri) GROUP BY 1) p ON p.doc_id = d.doc_id)"""


@query("durability_document", f"WITH {_DURABLE} SELECT * FROM durability")
def _(c):
    return evidence.durability_document(c.documents(), c.citations(), c.records())


@query("weakness", f"""WITH {_DURABLE}, cent AS (SELECT target_doc AS doc_id, count(*) AS n, bool_or(coalesce(durability = 'provable', false)) AS p FROM links LEFT JOIN durability ON durability.doc_id = source_doc WHERE NOT external AND target_doc IS NOT NULL AND target_doc <> source_doc GROUP BY 1)
SELECT doc_id, CASE WHEN coalesce(n, 0) >= 30 THEN 'load-bearing' WHEN coalesce(p, false) THEN 'cited-by-provable' ELSE 'peripheral' END AS weakness FROM durability LEFT JOIN cent USING (doc_id) WHERE durability = 'unprovable'""")
def _(c):
    durable = evidence.durability_document(c.documents(), c.citations(), c.records())
    return evidence.weakness(durable, graph.centrality(c.links(), durable), 30)


@query("answerability", """WITH h AS (SELECT c.uri AS question, c.claim_id, coalesce(max(b.claim_id) IS NOT NULL, false) AS contested, bool_or(coalesce(r.disposition <> 'referenced', false)) AS evidenced FROM citations c LEFT JOIN (SELECT claim_id FROM bounds WHERE value > 49) b USING (claim_id) LEFT JOIN records r USING (archive_path) GROUP BY 1, 2)
SELECT question, count(claim_id) AS retrieved, CASE WHEN count(claim_id) = 0 THEN 'silent' WHEN bool_or(contested) THEN 'unresolved' WHEN NOT bool_or(evidenced) THEN 'unevidenced' ELSE 'ready' END AS answerability FROM h GROUP BY 1""")
def _(c):
    contested = c.bounds().where(F.col("value") > 49).select("claim_id", F.lit(True).alias("contested")).distinct()
    held = c.records().select("archive_path", (F.col("disposition") != "referenced").alias("durable"))
    rows = c.citations().select(F.col("uri").alias("question"), "claim_id", "archive_path").join(held, "archive_path", "left").groupBy("question", "claim_id").agg(F.max(F.coalesce("durable", F.lit(False))).alias("evidenced"))
    return evidence.answerability(rows.join(contested, "claim_id", "left").na.fill(False, ["contested"]))


@query("archive_closure", """WITH arch AS (SELECT archive_path FROM records WHERE disposition <> 'referenced' AND byte_size <> 9000 UNION SELECT 'evidence/text/x/' || p_partkey FROM part WHERE p_size = 7)
SELECT archive_path, 'warning' AS severity FROM arch WHERE archive_path NOT IN (SELECT archive_path FROM records) UNION SELECT archive_path, 'error' FROM records WHERE disposition <> 'referenced' AND archive_path NOT IN (SELECT archive_path FROM arch)""")
def _(c):
    held = c.records().where((F.col("disposition") != "referenced") & (F.col("byte_size") != 9000)).select("archive_path")
    stray = c.raw("part").where("p_size = 7").select(F.concat(F.lit("evidence/text/x/"), "p_partkey").alias("archive_path"))
    return evidence.archive_closure(c.records(), held.union(stray))


@query("dangling_paths", "SELECT doc_id, count(*) AS missing, min(archive_path) AS first_path FROM (SELECT DISTINCT doc_id, archive_path FROM citations) WHERE archive_path NOT IN (SELECT archive_path FROM records WHERE disposition <> 'referenced') GROUP BY 1")
def _(c):
    return evidence.dangling_paths(c.citations(), c.records().where(F.col("disposition") != "referenced").select("archive_path"))


@query("cited_sources", "SELECT claim_id, string_agg(uri::VARCHAR, ',' ORDER BY uri) AS uris FROM (SELECT DISTINCT claim_id, uri FROM citations) GROUP BY 1")
def _(c):
    return evidence.cited_sources(c.citations())


@query("evidence_of", "SELECT doc_id, c.uri, coalesce(max(CASE disposition WHEN 'archived' THEN 2 WHEN 'extracted' THEN 1 ELSE 0 END), 0)::INTEGER AS support FROM citations c LEFT JOIN records USING (archive_path) GROUP BY 1, 2")
def _(c):
    return evidence.evidence_of(c.citations(), c.records())


@query("checks_by_path", f'WITH {_LAST} SELECT archive_path, uri, "at", drift FROM records JOIN last_check USING (uri, version)')
def _(c):
    return evidence.checks_by_path(c.records(), c.checks())


@query("extraction_worklist", """WITH r AS (SELECT uri, version, archive_path, disposition FROM records QUALIFY row_number() OVER (PARTITION BY uri ORDER BY disposition <> 'referenced' DESC, version DESC) = 1), done AS (SELECT DISTINCT archive_path FROM citations WHERE pos = 1)
SELECT p_partkey AS uri, archive_path, CASE WHEN version IS NULL THEN 'no-record' WHEN disposition = 'referenced' THEN 'no-text' END AS problem, coalesce(archive_path IN (SELECT archive_path FROM done), false) AS cached FROM part LEFT JOIN r ON r.uri = p_partkey""")
def _(c):
    return evidence.extraction_worklist(c.raw("part").select(F.col("p_partkey").alias("uri")), c.records(), c.citations().where("pos = 1").select("archive_path"))


@query("churn", f"WITH {_LAST} SELECT uri, count(*) AS versions, count(*) FILTER (WHERE drift = 'benign') AS benign, count(*) FILTER (WHERE drift = 'unsupported') AS unsupported, count(*) FILTER (WHERE drift = 'current') AS \"current\", count(*) FILTER (WHERE drift IS NULL) AS unchecked FROM (SELECT DISTINCT uri, version FROM records) LEFT JOIN last_check USING (uri, version) GROUP BY 1 HAVING count(*) >= 2")
def _(c):
    return evidence.churn(c.records(), c.checks())


@query("archive_budget", "SELECT count(*) AS files, coalesce(sum(byte_size), 0)::BIGINT AS bytes, CASE WHEN coalesce(sum(byte_size), 0) > 268435456 THEN 'error' WHEN coalesce(sum(byte_size), 0) >= 268435456 * 0.8 THEN 'warning' ELSE 'ok' END AS severity FROM records WHERE disposition <> 'referenced'")
def _(c):
    return evidence.archive_budget(c.records(), 268435456, 0.8)


@query("archive_largest", "SELECT archive_path, byte_size FROM records ORDER BY byte_size DESC, archive_path LIMIT 5")
def _(c):
    return c.records().orderBy(F.desc("byte_size"), "archive_path").limit(5).select("archive_path", "byte_size")


# ---------------------------------------------------------------- logs


@query("miss_report", "SELECT reason, count(*) AS emissions, count(DISTINCT coalesce(key, 'row:' || line)) AS questions, list_aggregate(list_sort(list(DISTINCT op)), 'string_agg', ',') AS ops, list_aggregate(list_sort(list(DISTINCT \"check\")), 'string_agg', ',') AS checks, reason IN ('no_deterministic_path', 'no_deterministic_predicate') AS actionable FROM misses GROUP BY reason")
def _(c):
    return trail.miss_report(c.misses())


@query("debt", """WITH p AS (SELECT * FROM trail WHERE op = 'promote' AND outcome = 'ok'), s AS (SELECT signal, count(*) AS owed, count(DISTINCT path) AS paths FROM (SELECT path, unnest(signals) AS signal FROM p) GROUP BY 1)
SELECT signal, owed, paths, (SELECT count(*) FROM p) AS promotions, (SELECT count(*) FROM events WHERE event_id % 97 = 5) AS unreadable FROM s""")
def _(c):
    return trail.debt(c.trail(), c.malformed_lines())


@query("debt_carried", "SELECT line, path, unnest(signals) AS signal, actor FROM trail WHERE op = 'promote' AND outcome = 'ok' AND path IN (SELECT 'c/' || (event_id % 20) FROM events)")
def _(c):
    paths = c.raw("events").select(F.concat(F.lit("c/"), F.col("event_id") % 20).alias("path")).distinct()
    return trail.carried(c.trail(), paths)


@query("outstanding", """WITH r AS (SELECT *, max(CASE WHEN op = 'discard' OR (op = 'promote' AND outcome = 'ok') THEN line END) OVER (PARTITION BY path) AS last_reset FROM trail)
SELECT path, count(*) AS attempts, max("at") AS last_at, arg_max(actor, line) AS last_actor FROM r WHERE op = 'promote' AND outcome <> 'ok' AND line > coalesce(last_reset, -1) GROUP BY 1""")
def _(c):
    return trail.outstanding(c.trail())


@query("relay_grade", """WITH f AS (SELECT "at", line FROM trail WHERE op = 'admit' AND outcome = 'ok' AND "at" >= TIMESTAMP '2024-01-15' ORDER BY "at", line LIMIT 1)
SELECT t.line, t.op, t.actor, t.path FROM trail t, f WHERE t."at" >= TIMESTAMP '2024-01-15' AND (t."at", t.line) < (f."at", f.line) AND t.op <> 'fetch'""")
def _(c):
    return trail.relay_grade(c.trail(), since(), ("fetch",))


@query("withheld_claims", "SELECT claim, count(*) AS times, count(DISTINCT path) AS sources FROM (SELECT path, unnest(signals) AS claim FROM trail WHERE op = 'admit' AND outcome <> 'ok') GROUP BY 1")
def _(c):
    return trail.withheld_claims(c.trail())


@query("domain_history", """WITH d AS (SELECT CASE WHEN l_partkey % 9 = 0 THEN '' WHEN l_partkey % 9 < 4 THEN 'flat' || (l_suppkey % 7) ELSE 'area' || (l_partkey % 40) || '.limit.' || l_partkey END AS subject, CASE WHEN l_suppkey % 6 = 0 THEN ' ' ELSE 'human:' || (l_suppkey % 30) END AS actor FROM lineitem WHERE l_quantity > 20),
n AS (SELECT split_part(subject, '.', 1) AS domain, actor, count(*) AS decisions FROM d WHERE subject <> '' AND trim(actor) <> '' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY domain ORDER BY decisions DESC, actor)::INTEGER AS place FROM n""")
def _(c):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    subject = F.when(part % 9 == 0, "").when(part % 9 < 4, F.concat(F.lit("flat"), supp % 7)).otherwise(F.concat(F.lit("area"), part % 40, F.lit(".limit."), part))
    actor = F.when(supp % 6 == 0, " ").otherwise(F.concat(F.lit("human:"), supp % 30))
    return trail.domain_history(c.raw("lineitem").where("l_quantity > 20").select(subject.alias("subject"), actor.alias("actor")))


@query("record_retrievals", 'SELECT claim_id, count(*) AS returns, max("at") AS last_at FROM retrievals GROUP BY 1')
def _(c):
    """The log in three batches merged into a stored table, one of them run twice, compacted after the second."""
    state = trail.retrieval_state(c.spark, fresh_folder(c.spark, "retrieval-state"))
    for n in range(3):
        trail.merge_retrievals(state, c.retrievals().where(F.col("line") % 3 == n), f"batch {n}")
        if n == 1:
            trail.merge_retrievals(state, c.retrievals().where(F.col("line") % 3 == n), f"batch {n}")
            state.compact()
    return state.read()


@query("record_checks", f'WITH {_LAST}, n AS (SELECT uri, version, count(*) AS checks FROM checks GROUP BY 1, 2) SELECT last_check.*, n.checks FROM last_check JOIN n USING (uri, version)')
def _(c):
    """The check log in two batches merged into a stored table."""
    state = trail.check_state(c.spark, fresh_folder(c.spark, "check-state"))
    for name in ("benign", "rest"):
        trail.merge_checks(state, c.checks().where((F.col("drift") == "benign") == (name == "benign")), name)
    return state.read().select("uri", "version", "last.at", "last.drift", "checks")


@query("unreached_claims", "SELECT claim_id, CASE WHEN m >= TIMESTAMP '2024-01-15' THEN 'observed' ELSE 'quiet' END AS reach FROM claims LEFT JOIN (SELECT claim_id, max(\"at\") AS m FROM retrievals GROUP BY 1) USING (claim_id) WHERE lead IS NOT NULL")
def _(c):
    return trail.unreached_claims(c.claims(), c.retrievals(), since())


@query("unextracted_count", "SELECT count(*) FILTER (WHERE lead IS NULL OR trim(lead) = '') AS unextracted, count(*) AS claims FROM claims")
def _(c):
    return c.claims().agg(F.count_if(F.col("lead").isNull() | (F.trim("lead") == "")).alias("unextracted"), F.count("*").alias("claims"))


@query("doc_count", "SELECT count(*) AS documents FROM docs")
def _(c):
    return c.documents().agg(F.count("*").alias("documents"))


@query("findings_gate", "SELECT count(*) FILTER (WHERE NOT external AND target_doc IS NULL) AS errors, count(*) FILTER (WHERE external) AS warnings, count(*) FILTER (WHERE NOT external AND target_doc IS NULL) > 0 AS blocks FROM links")
def _(c):
    severity = F.when(~F.col("external") & F.col("target_doc").isNull(), "error").when(F.col("external"), "warning")
    return trail.findings_gate(c.links().select(severity.alias("severity")))


_EXCHANGES = """WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM turns),
ex AS (SELECT session_id, min(pos) AS pos, max(text) FILTER (WHERE role = 'user' AND trim(coalesce(text, '')) <> '') AS question, string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE role <> 'user' AND trim(coalesce(text, '')) <> '') AS answer FROM g WHERE grp > 0 GROUP BY session_id, grp
HAVING max(text) FILTER (WHERE role = 'user' AND trim(coalesce(text, '')) <> '') IS NOT NULL AND count(*) FILTER (WHERE role <> 'user' AND trim(coalesce(text, '')) <> '') > 0)"""


@query("exchanges", _EXCHANGES + " SELECT * FROM ex")
def _(c):
    return trail.exchanges(c.turns())


@query("repeated_questions", _EXCHANGES + r""" SELECT lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) AS key, count(*) AS asked, arg_min(question, (session_id, pos)) AS question, arg_max(answer, (session_id, pos)) AS answer,
string_agg(session_id || ':' || pos, ',' ORDER BY session_id, pos) AS turns, count(DISTINCT session_id) AS sessions, CASE WHEN count(DISTINCT session_id) > 1 THEN 'recurring' ELSE 'retried' END AS kind FROM ex GROUP BY 1 HAVING count(*) >= 2""")
def _(c):
    return trail.repeated_questions(trail.exchanges(c.turns()))


# ---------------------------------------------------------------- conflicts, duplicates, populations


_PARSED = "SELECT subject, claim_id, value > 5 AS parsed FROM bounds"


@query("unseparated_pairs", f"""WITH p AS ({_PARSED}), q AS (SELECT DISTINCT a.subject, least(a.claim_id, b.claim_id) AS first, greatest(a.claim_id, b.claim_id) AS second FROM p a JOIN p b ON a.subject = b.subject AND NOT a.parsed AND (a.claim_id < b.claim_id OR (b.parsed AND a.claim_id <> b.claim_id)))
SELECT subject, first, second, substr(sha256(first || chr(0) || second), 1, 16) AS pair_id FROM q""")
def _(c):
    return conflict.unseparated_pairs(c.bounds().select("subject", "claim_id", (F.col("value") > 5).alias("parsed")))


@query("constraint_coverage", "SELECT subject, count(*) FILTER (WHERE value <> 7) AS parsed, count(*) FILTER (WHERE value = 7) AS unparsed FROM bounds GROUP BY 1 HAVING count(*) FILTER (WHERE value = 7) > 0")
def _(c):
    return conflict.constraint_coverage(c.bounds().withColumn("value", F.nullif("value", F.lit(7.0))))


@query("dimension_drift", "SELECT subject, CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END AS declared, dimension, count(*) AS claims FROM bounds JOIN part ON p_partkey = subject WHERE dimension <> CASE WHEN p_size % 2 = 0 THEN 'F' ELSE 'O' END GROUP BY ALL")
def _(c):
    declared = c.raw("part").select(F.col("p_partkey").alias("subject"), F.when(F.col("p_size") % 2 == 0, "F").otherwise("O").alias("dimension"))
    return conflict.dimension_drift(c.bounds(), declared)


@query("duplicate_titles", "SELECT lower(title) AS title, count(*) AS documents, min(doc_id) AS first_doc FROM docs GROUP BY 1 HAVING count(*) >= 2")
def _(c):
    return conflict.duplicate_titles(c.documents())


@query("evidence_divergence", r"""WITH s AS (SELECT l_orderkey AS doc_id, l_partkey AS uri, l_suppkey::VARCHAR AS version, CASE WHEN l_linenumber % 2 = 0 THEN 'The  limit of part ' || (l_partkey % 50) ELSE 'The limit of ' || chr(8220) || 'part' || chr(8221) || ' ' || (l_partkey % 50) END AS anchor FROM lineitem),
f AS (SELECT doc_id, uri, version, trim(regexp_replace(translate(anchor, '“”', '""'), '\s+', ' ', 'g')) AS anchor FROM s), v AS (SELECT anchor, uri, version, count(DISTINCT doc_id) AS n FROM f GROUP BY 1, 2, 3),
d AS (SELECT anchor, uri, count(DISTINCT doc_id) AS documents FROM f GROUP BY 1, 2) SELECT anchor, uri, count(*) AS versions, any_value(documents) AS documents, string_agg(version || ' in ' || n, '; ' ORDER BY version) AS shown FROM v JOIN d USING (anchor, uri) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(c):
    part = F.col("uri") % 50
    anchor = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("The  limit of part "), part)).otherwise(F.concat(F.lit("The limit of “part” "), part))
    return conflict.evidence_divergence(c.citations().select("doc_id", "uri", "version", anchor.alias("anchor")))


@query("subject_population", """WITH h AS (SELECT DISTINCT uri, doc_id, archive_path FROM citations), d AS (SELECT DISTINCT uri, doc_id FROM h),
ov AS (SELECT DISTINCT a.uri, a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.uri = b.uri AND a.archive_path = b.archive_path AND a.doc_id < b.doc_id),
np AS (SELECT uri, count(*) * (count(*) - 1) / 2 AS pairs FROM d GROUP BY 1), nov AS (SELECT uri, count(*) AS ovl FROM ov GROUP BY 1)
SELECT c.uri, count(DISTINCT claim_id) AS claims, count(DISTINCT doc_id) AS documents, any_value(pairs > coalesce(ovl, 0)) AS disjoint FROM citations c JOIN np USING (uri) LEFT JOIN nov USING (uri) GROUP BY 1""")
def _(c):
    return conflict.subject_population(c.citations())


@query("type_usage", "SELECT type, n AS documents, 'undeclared' AS problem FROM (SELECT type, count(*) AS n FROM docs GROUP BY 1) WHERE type NOT IN ('1-URGENT', '2-HIGH', '5-LOW', '9-NEVER') UNION ALL SELECT '9-NEVER', 0, 'unused' UNION ALL SELECT type, count(*), 'deprecated' FROM docs WHERE type = '5-LOW' GROUP BY type")
def _(c):
    types = c.spark.createDataFrame([("1-URGENT", False), ("2-HIGH", False), ("5-LOW", True), ("9-NEVER", False)], "type string, deprecated boolean")
    return conflict.type_usage(c.documents(), types)


@query("alias_resolve", "SELECT claim_id, 'Part  ' || uri AS surface, CASE WHEN uri IN (SELECT p_partkey FROM part WHERE p_size > 2) THEN 'k' || uri END AS key FROM citations")
def _(c):
    aliases = c.raw("part").where("p_size > 2").select(F.concat(F.lit("part "), "p_partkey").alias("alias"), F.concat(F.lit("k"), "p_partkey").alias("key"))
    return conflict.alias_resolve(c.citations().select("claim_id", F.concat(F.lit("Part  "), "uri").alias("surface")), aliases)


# ---------------------------------------------------------------- samples


@query("hash_sample", "SELECT path, sha256(unhex('0000000001352536') || encode(path)) AS draw FROM docs ORDER BY draw, path LIMIT 5")
def _(c):
    return sampling.hash_sample(c.documents().select("path"), "path", 5, seed=20260150)


@query("rewrite_diff", "WITH b AS (SELECT DISTINCT doc_id, uri AS quote FROM citations WHERE pos <= 4), a AS (SELECT DISTINCT doc_id, uri AS quote FROM citations WHERE pos >= 3) SELECT doc_id, quote, 'dropped' AS problem FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT doc_id, quote, 'unvalidated' FROM a WHERE quote NOT IN (SELECT uri FROM records WHERE disposition <> 'referenced')")
def _(c):
    rows = c.citations().select("doc_id", F.col("uri").alias("quote"), "pos")
    supported = c.records().where("disposition <> 'referenced'").select(F.col("uri").alias("quote"))
    return sampling.rewrite_diff(rows.where("pos <= 4").drop("pos"), rows.where("pos >= 3").drop("pos"), supported)


@query("accrete_quotes", "WITH e AS (SELECT DISTINCT doc_id AS anchor, uri AS quote FROM citations WHERE pos <= 3), i AS (SELECT DISTINCT doc_id AS anchor, uri AS quote FROM citations WHERE pos >= 3) SELECT anchor, quote, anchor IN (SELECT anchor FROM e) AS matched FROM (SELECT * FROM i EXCEPT SELECT * FROM e)")
def _(c):
    rows = c.citations().select(F.col("doc_id").alias("anchor"), F.col("uri").alias("quote"), "pos")
    return sampling.accrete(rows.where("pos <= 3").drop("pos"), rows.where("pos >= 3").drop("pos"))


# ---------------------------------------------------------------- text

_FOLD = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"


@query("fold", f"SELECT doc_id, sha256({_FOLD}) AS folded FROM texts")
def _(c):
    return c.texts().select("doc_id", F.sha2(fx.fold(F.col("body")).cast("binary"), 256).alias("folded"))


@query("slug", "SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'untitled') AS slug FROM docs")
def _(c):
    return c.documents().select("doc_id", fx.slug(F.col("title")).alias("slug"))


@query("one_line", rf"SELECT doc_id, CASE WHEN length({_FOLD}) > 60 THEN substr({_FOLD}, 1, 60) || '…' ELSE {_FOLD} END AS line FROM texts")
def _(c):
    return c.texts().select("doc_id", fx.one_line(F.col("body"), 60).alias("line"))


_SENTENCES = r"""s AS (SELECT doc_id, list_filter(list_transform(string_split(array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || CASE WHEN regexp_matches(coalesce(w[i + 1], ''), '^\p{Lu}')
 AND (regexp_matches(w[i], '[!?]$') OR (regexp_matches(w[i], '[.]$') AND length(w[i]) <> 2 AND NOT contains(substr(w[i], 1, length(w[i]) - 1), '.'))) THEN chr(1) ELSE ' ' END), ''), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS list
FROM (SELECT doc_id, list_filter(string_split(trim(regexp_replace(body, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM texts))"""


@query("sentences", f"WITH {_SENTENCES} SELECT doc_id, unnest(range(0, len(list)))::INTEGER AS pos, unnest(list) AS sentence FROM s")
def _(c):
    return c.texts().select("doc_id", F.posexplode(fx.sentences(F.col("body"))).alias("pos", "sentence"))


@query("states_value", "SELECT doc_id, regexp_matches(' ' || body || ' ', '[^0-9.]' || (doc_id % 40)::VARCHAR || '[^0-9.]') AS stated FROM texts")
def _(c):
    return c.texts().select("doc_id", fx.states_value(F.col("body"), (F.col("doc_id") % 40).cast("string")).alias("stated"))


@query("placeholder_markers", r"SELECT doc_id, len(list_distinct(regexp_extract_all(body, '\{\{[A-Z][A-Z0-9_]*\}\}')))::INTEGER AS markers FROM texts")
def _(c):
    return c.texts().select("doc_id", F.size(fx.placeholders(F.col("body"))).alias("markers"))


@query("hidden_channels", r"SELECT page_id, len(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1))::INTEGER AS channels, array_to_string(list_transform(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1), lambda x: trim(x)), '|') AS texts FROM pages")
def _(c):
    found = fx.hidden_channels(F.col("html"))
    return c.raw("pages").select("page_id", F.size(found).alias("channels"), F.array_join(found, "|").alias("texts"))


@query("days_since", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2003-06-01')::BIGINT AS days FROM orders")
def _(c):
    return c.raw("orders").select("o_orderkey", fx.days_between(F.col("o_orderdate").cast("date"), now()).alias("days"))


@query("claim_ref", "SELECT doc_id, claim_id, doc_id || '#' || claim_id AS ref FROM claims")
def _(c):
    return c.claims().select("doc_id", "claim_id", fx.claim_ref(F.col("doc_id").cast("string"), F.col("claim_id")).alias("ref"))


@query("cache_key", "SELECT claim_id, archive_path, sha256(claim_id || chr(0) || archive_path || chr(0) || version) AS key FROM (SELECT DISTINCT claim_id, archive_path, version FROM citations)")
def _(c):
    rows = c.citations().select("claim_id", "archive_path", "version").distinct()
    return rows.select("claim_id", "archive_path", fx.cache_key(F.col("claim_id"), F.col("archive_path"), F.col("version")).alias("key"))
