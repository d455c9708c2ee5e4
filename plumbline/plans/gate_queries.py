"""Queries of the gate, of all checks as one table, of cards and queues, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import checks, conflict, evidence, graph, trail
from plumbline.plans import claim_queries, more  # noqa: F401  their queries are among the checks
from plumbline.plans.corpus_queries import _SIGNED, _STATE, _decisions
from plumbline.plans.queries import _DURABLE, _LAST, _RANK, now
from plumbline.plans.registry import MAKERS, ORACLE_SQL, QUERIES, query
from plumbline.sources.bind import SQL_TABLES
from plumbline.sources.bind import Corpus as _Corpus
from plumbline.sources.scratch import fresh_folder

# ---------------------------------------------------------------- signals


@query("gate_conformance", "SELECT doc_id, CASE WHEN trim(type) <> '' AND trim(title) <> '' AND trim(status) <> '' THEN 'pass' ELSE 'fail' END AS state FROM docs")
def _(c):
    stated = [F.trim(F.coalesce(x, F.lit(""))) != "" for x in ("type", "title", "status")]
    return c.documents().select("doc_id", checks.ordered_state(stated[0] & stated[1] & stated[2]).alias("state"))


@query("gate_duplication", "SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lower(title)) > 1 THEN 'fail' ELSE 'pass' END AS state FROM docs")
def _(c):
    docs = c.documents()
    twice = conflict.duplicate_titles(docs).select(F.col("title").alias("_t"), F.lit(True).alias("twice"))
    return docs.join(twice, fx.fold_lower(F.col("title")) == F.col("_t"), "left").select("doc_id", checks.ordered_state(F.col("twice").isNull()).alias("state"))


_EVIDENCE = """held AS (SELECT s.doc_id, bool_and(len(quotes) > 0 AND r.uri IS NOT NULL AND len(list_filter(quotes, lambda q: contains(coalesce(r.text, ''), q))) > 0) AS ok FROM statements s LEFT JOIN (SELECT uri, string_agg(quote, '|' ORDER BY quote) AS text FROM (SELECT DISTINCT uri, unnest(quotes) AS quote FROM statements WHERE pos <> 3) JOIN (SELECT DISTINCT uri FROM records WHERE disposition <> 'referenced') USING (uri) GROUP BY 1) r USING (uri) WHERE pos < 3 GROUP BY 1)"""


@query("gate_evidence", f"WITH {_EVIDENCE} SELECT doc_id, CASE WHEN ok IS NULL THEN 'unchecked' WHEN ok THEN 'pass' ELSE 'fail' END AS state FROM docs LEFT JOIN held USING (doc_id)")
def _(c):
    durable = c.records().where("disposition <> 'referenced'").select("uri").distinct()
    archived = c.statements_by("uri").where("pos <> 3").select("uri", F.explode("quotes").alias("quote")).distinct().join(durable, "uri", "left_semi")
    archived = archived.groupBy("uri").agg(F.array_join(F.sort_array(F.collect_list("quote")), "|").alias("text"))
    enforced = c.statements().where("pos < 3").select("doc_id", "uri", "quotes")
    return checks.evidence_signal(c.documents().select("doc_id"), enforced, archived)


_FETCHED = "fetched AS (SELECT doc_id, bool_and(k.uri IS NOT NULL) AS ok FROM citations LEFT JOIN (SELECT DISTINCT uri, version FROM checks) k USING (uri, version) GROUP BY 1)"


@query("gate_provenance", f"WITH {_FETCHED} SELECT doc_id, CASE WHEN coalesce(ok, false) THEN 'pass' ELSE 'fail' END AS state FROM docs LEFT JOIN fetched USING (doc_id)")
def _(c):
    fetched = c.checks().select("uri", "version").distinct()
    return checks.provenance_signal(c.documents().select("doc_id"), c.citations(), fetched)


_STATES = tuple(x for x in checks.SIGNALS if x != "conflict")


def _signal_sql(name: str) -> str:
    return f"(SELECT doc_id, state AS {name} FROM ({ORACLE_SQL['gate_' + name]}))"


def _states(c) -> DataFrame:
    return checks.together(c.documents(), {name: QUERIES["gate_" + name](c.spark, c.sf_dir) for name in _STATES})


_REPORT = "sig AS (SELECT doc_id, " + ", ".join(f"coalesce({x}, 'unchecked') AS {x}" for x in _STATES) + ", 'unchecked' AS conflict FROM docs " + " ".join(f"LEFT JOIN {_signal_sql(x)} USING (doc_id)" for x in _STATES) + "),\n" + """
report AS (SELECT doc_id, array_to_string(list_filter([""" + ", ".join(f"CASE WHEN {x} = 'fail' THEN '{x}' END" for x in checks.SIGNALS) + """], lambda x: x IS NOT NULL), ',') AS failed,
array_to_string(list_filter([""" + ", ".join(f"CASE WHEN {x} = 'unchecked' THEN '{x}' END" for x in checks.SIGNALS) + """], lambda x: x IS NOT NULL), ',') AS unchecked FROM sig),
decided AS (SELECT *, CASE WHEN failed <> '' THEN 'refused' WHEN unchecked <> '' THEN 'needs_human' ELSE 'approved' END AS decision FROM report)"""


@query("gate_decision", f"WITH {_REPORT} SELECT doc_id, decision, failed, unchecked FROM decided")
def _(c):
    return checks.gate_decision(_states(c))


# ---------------------------------------------------------------- checks with rows of their own


@query("check_conformance", "SELECT doc_id, path FROM docs WHERE doc_id % 23 = 0")
def _(c):
    return checks.without_type(c.documents().withColumn("type", F.when(F.col("doc_id") % 23 == 0, F.lit(" ")).otherwise(F.col("type"))))


_SEVERITY = {"quarantine": ("error", "human"), "duplicate": ("error", "human"), "conflict": ("error", "human"), "tombstone": ("warning", "rebuild"), "update-path": ("warning", "rebuild"), "index": ("warning", "rebuild")}


def _reconciled_sql(kinds: tuple[str, ...]) -> str:
    severity, action = ("CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _SEVERITY.items()) + " END" for i in (0, 1))
    return f"SELECT kind, id, path, {severity} AS severity, {action} AS action FROM ({ORACLE_SQL['reconcile']}) WHERE kind IN ({', '.join(map(repr, kinds))})"


def _reconciled(kinds: tuple[str, ...]):
    return lambda c: graph.reconcile_findings(MAKERS["reconcile"](c), _SEVERITY, kinds)


_IDENTITY, _DRIFTED = ("quarantine", "duplicate", "conflict"), ("index", "update-path", "tombstone")
for _name, _of in (("check_identity", _IDENTITY), ("check_index_drift", _DRIFTED)):
    query(_name, _reconciled_sql(_of))(_reconciled(_of))
    ORACLE_SQL[_name] = _reconciled_sql(_of)


_DECIDED = """decided AS (SELECT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, l_quantity > 35 AS adjudicated, CASE WHEN l_partkey % 5 = 0 THEN 'human:' || (l_partkey % 3) ELSE ' ' END AS co_signed_by, CASE WHEN l_suppkey % 7 = 0 THEN 'urgent' END AS override_reason, [NULL, 'sole', 'paired', 'quorum'][l_linenumber % 4 + 1] AS authority,
CASE WHEN l_quantity > 40 THEN l_orderkey || '#1' ELSE '' END AS supersedes, CASE WHEN l_quantity % 3 = 0 THEN '' ELSE 'shown by ' || l_partkey END AS rationale, l_quantity % 4 <> 0 AS warranted FROM lineitem)"""


def _decided(c) -> DataFrame:
    authority = F.element_at(F.array(F.lit(None).cast("string"), F.lit("sole"), F.lit("paired"), F.lit("quorum")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    q = F.col("l_quantity")
    return c.raw("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("claim_id"), (q > 35).alias("adjudicated"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("human:"), F.col("l_partkey") % 3)).otherwise(" ").alias("co_signed_by"),
        F.when(F.col("l_suppkey") % 7 == 0, "urgent").alias("override_reason"), authority.alias("authority"), F.when(q > 40, F.concat("l_orderkey", F.lit("#1"))).otherwise("").alias("supersedes"),
        F.when(q % 3 == 0, "").otherwise(F.concat(F.lit("shown by "), "l_partkey")).alias("rationale"), (q % 4 != 0).alias("warranted"),
    )


@query("check_warrant", f"WITH {_DECIDED} SELECT claim_id, CASE WHEN NOT warranted THEN 'no-warrant' ELSE 'no-rationale' END AS problem FROM decided WHERE (NOT warranted AND supersedes <> '') OR (warranted AND trim(rationale) = '')")
def _(c):
    return checks.unwarranted(_decided(c))


@query("check_co_sign", f"""WITH {_DECIDED}, {_SIGNED}, corpus AS (SELECT {_STATE.format("count(DISTINCT who) FILTER (WHERE who LIKE 'human:_%')")} AS state FROM signed), cent AS (SELECT target_doc AS doc_id, count(*) AS n FROM links WHERE NOT external AND target_doc IS NOT NULL AND target_doc <> source_doc GROUP BY 1)
SELECT doc_id, claim_id, CASE WHEN type IN ('1-URGENT', '2-HIGH') THEN 'normative' ELSE 'load-bearing' END AS reason, coalesce(authority, state) AS authority FROM decided JOIN docs USING (doc_id) LEFT JOIN cent USING (doc_id), corpus
WHERE (type IN ('1-URGENT', '2-HIGH') OR coalesce(n, 0) >= 25) AND adjudicated AND trim(co_signed_by) = '' AND coalesce(trim(override_reason), '') = '' AND coalesce(authority, state) <> 'sole'""")
def _(c):
    corpus = trail.adjudicators(_decisions(c)).agg(F.count_distinct("who").alias("n")).select(trail.authority_of(F.col("n")).alias("state"))
    return checks.missing_co_signatures(_decided(c), c.documents(), graph.centrality(c.links()), corpus, ("1-URGENT", "2-HIGH"), 25)


# ---------------------------------------------------------------- all checks as one table

#: (query, severity, path, message) of each check; a query that gives severities of its own has none here.
CHECKS = (
    ("check_conformance", "error", "path", "doc_id"), ("check_identity", None, "path", "kind"), ("check_index_drift", None, "path", "kind"), ("check_log_format", "warning", "log_id", "line"), ("broken_link", "error", "source_doc", "href"),
    ("orphan_documents", "warning", "path", "title"), ("check_schema_version", "warning", "doc_id", "schema_version"), ("check_anchor_absent", "error", "claim_id", "doc_id"), ("check_evidence", None, "path", "message"), ("check_coverage", "warning", "claim_id", "claim_id"),
    ("check_rung", "warning", "claim_id", "claim_id"), ("check_lead", "warning", "claim_id", "problem"), ("check_language", "warning", "doc_id", "markers"), ("check_subject_missing", "warning", "claim_id", "type"), ("check_subject_unknown", "error", "claim_id", "uri"),
    ("check_limitations", "warning", "doc_id", "type"), ("check_filename_drift", "warning", "path", "wanted"), ("check_warrant", "error", "claim_id", "problem"), ("check_co_sign", "warning", "claim_id", "reason"), ("check_challenge_age", "warning", "challenge_id", "problem"),
    ("check_stale", "warning", "doc_id", "reason"), ("check_constraint_drift", "error", "claim_id", "value"), ("placeholder_markers", "warning", "doc_id", "markers"), ("empty_sections", "warning", "doc_id", "heading"), ("archive_closure", None, "archive_path", "archive_path"),
    ("dangling_paths", "error", "doc_id", "first_path"), ("duplicate_titles", "warning", "first_doc", "title"), ("duplicate_evidence", "warning", "first_doc", "evidence"), ("anchor_collision", "warning", "doc_id", "anchor"), ("type_usage", "warning", "type", "problem"),
    ("interval_conflict", "error", "first", "second"), ("stale_conflict_edge", "warning", "doc_id", "problem"), ("weakness", "warning", "doc_id", "weakness"), ("dimension_drift", "warning", "subject", "dimension"), ("constraint_coverage", "warning", "subject", "unparsed"), ("command_mentions", "warning", "doc_id", "command"),
)
_KEPT = {"placeholder_markers": "markers > 0"}


#: What the tables must hold for checks to apply, counted while the checks read them.
MEASURES = {
    "documents": {"documents": "true", "typed": "trim(type) <> ''", "dated": "stale_after IS NOT NULL", "retired": "status = 'retired'"}, "links": {"internal": "NOT external"},
    "statements": {"leads": "lead IS NOT NULL", "quoted": "size(quotes) > 0"}, "bounds": {"valued": "value IS NOT NULL", "ranged": "op = '~'"},
}
_MEASURES_SQL = {
    ("documents", "documents"): "SELECT count(*) FROM docs", ("documents", "typed"): "SELECT count(*) FROM docs WHERE trim(type) <> ''", ("documents", "retired"): "SELECT count(*) FROM docs WHERE status = 'retired'", ("documents", "dated"): "SELECT count(stale_after) FROM docs",
    ("links", "internal"): "SELECT count(*) FROM links WHERE NOT external", ("statements", "leads"): "SELECT count(lead) FROM statements", ("statements", "quoted"): "SELECT count(*) FROM statements WHERE len(quotes) > 0",
    ("bounds", "valued"): "SELECT count(value) FROM bounds", ("bounds", "ranged"): "SELECT count(*) FROM bounds WHERE op = '~'",
}
#: What each check needs: table, measure and what is said where there is none.
NEEDS = {
    "broken_link": ("links", "internal", "no document links to another"), "orphan_documents": ("links", "internal", "no document links to another"), "check_lead": ("statements", "leads", "no claim has a lead"), "check_coverage": ("statements", "quoted", "no claim has a quote"),
    "check_rung": ("statements", "quoted", "no claim has a quote"), "check_evidence": ("statements", "quoted", "no claim has a quote"), "duplicate_evidence": ("statements", "quoted", "no claim has a quote"), "interval_conflict": ("bounds", "valued", "no claim has a bound that can be read"),
    "constraint_coverage": ("bounds", "valued", "no claim has a bound that can be read"), "dimension_drift": ("bounds", "ranged", "no claim has a bound of two ends"), "check_stale": ("documents", "dated", "no document says how long it holds"), "type_usage": ("documents", "typed", "no document has a type"),
    "stale_conflict_edge": ("documents", "retired", "no document is retired"), "duplicate_titles": ("documents", "documents", "there are no documents"), "check_filename_drift": ("documents", "documents", "there are no documents"),
}


class _ObservedCorpus(_Corpus):
    """The corpus whose tables are measured while they are read; the four that most checks read are made once."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        plain = _Corpus(spark, sf_dir)
        self.observed = checks.Observed(lambda name: getattr(plain, name)(), MEASURES)


for _table in MEASURES:
    setattr(_ObservedCorpus, _table, lambda self, name=_table: self.observed.table(name))


def _check(name: str, severity: str | None, path: str, message: str, corpus: _Corpus) -> checks.Check:
    def run(_: checks.Observed) -> DataFrame:
        rows = MAKERS[name](corpus).where(_KEPT.get(name, "true"))
        return rows.select((F.lit(severity) if severity else F.col("severity")).alias("severity"), F.col(path).alias("path"), F.col(message).alias("message"))

    return checks.Check(name, run, (NEEDS[name],) if name in NEEDS else ())


def checked(spark, sf_dir, summed=None) -> tuple[DataFrame, DataFrame]:
    """Findings of all checks, or what ``summed`` makes of each check's, and the skipped ones."""
    corpus = _ObservedCorpus(spark, sf_dir)
    listed = [_check(*x, corpus) for x in CHECKS]
    return checks.run_checks(listed, corpus.observed, fresh_folder(spark, "findings"), summed)


def skipped(spark, sf_dir) -> DataFrame:
    corpus = _ObservedCorpus(spark, sf_dir)
    return checks.skipped_checks([_check(*x, corpus) for x in CHECKS], corpus.observed)


#: Checks that the given tables never have what they need for.
_NEVER = [n for n, (t, m, _) in NEEDS.items() if m in ("ranged", "retired")]


def _findings_sql() -> str:
    parts = []
    for name, severity, path, message in CHECKS:
        if name in _NEVER:
            continue
        level = f"'{severity}'" if severity else "severity"
        parts.append(f"SELECT {level} AS severity, '{name}' AS category, \"{path}\"::VARCHAR AS path, \"{message}\"::VARCHAR AS message FROM ({ORACLE_SQL[name]}) WHERE {_KEPT.get(name, 'true')}")
    return " UNION ALL ".join(parts)


def _register_checks() -> None:
    sql = _findings_sql()
    QUERIES["check_all"] = lambda spark, sf_dir: checked(spark, sf_dir, checks.digest_of)[0]
    ORACLE_SQL["check_all"] = f"SELECT severity, category, count(*) AS findings, count(DISTINCT path) AS paths, min(path) AS first_path, sum(('0x' || substr(sha256(coalesce(path, '') || '|' || coalesce(message, '')), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS digest FROM ({sql}) GROUP BY 1, 2"
    QUERIES["checks_skipped"] = skipped
    ORACLE_SQL["checks_skipped"] = f"WITH {SQL_TABLES}" + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", '{reason}' AS reason WHERE ({_MEASURES_SQL[t, m]}) = 0" for n, (t, m, reason) in NEEDS.items())
    QUERIES["check_summary"] = lambda spark, sf_dir: trail.findings_gate(checked(spark, sf_dir, checks.counts_of)[0])
    ORACLE_SQL["check_summary"] = f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'error') > 0 AS blocks FROM ({sql})"


# ---------------------------------------------------------------- scope, cards and queues

_FRESH = f"""{_LAST}, seen AS (SELECT doc_id, count(*) AS n, count("at") AS k FROM (SELECT DISTINCT doc_id, uri, version FROM citations) LEFT JOIN last_check USING (uri, version) GROUP BY 1),
fresh AS (SELECT doc_id, CASE WHEN n IS NULL THEN 'not_applicable' WHEN k < n THEN 'unknown' WHEN DATE '2003-06-01' >= stale_after THEN 'stale' ELSE 'fresh' END AS freshness FROM docs LEFT JOIN seen USING (doc_id))"""
_TRUSTED = f"trusted AS (SELECT doc_id, coalesce(r, 0) AS tier FROM docs LEFT JOIN (SELECT doc_id, min(coalesce(r, 0)) AS r FROM claims LEFT JOIN (SELECT claim_id, max({_RANK}) AS r FROM verifications GROUP BY 1) USING (claim_id) GROUP BY 1) USING (doc_id))"


@query("scope_filter", f"""WITH {_FRESH}, {_TRUSTED}, {_DURABLE} SELECT doc_id, path, scope FROM docs JOIN fresh USING (doc_id) JOIN trusted USING (doc_id) JOIN durability USING (doc_id), (SELECT unnest(['fresh', 'provable', 'typed']) AS scope)
WHERE CASE scope WHEN 'fresh' THEN path LIKE 'c/3/%' AND CASE WHEN status = '' THEN 'stable' ELSE status END = 'stable' AND freshness = 'fresh' WHEN 'provable' THEN tier >= 1 AND durability = 'provable' ELSE path LIKE 'c/_/%' AND type = '5-LOW' AND status = 'draft' AND tier >= 1 END""")
def _(c):
    docs = c.documents()
    states = docs.join(evidence.freshness_document(docs, c.citations(), c.checks(), now()), "doc_id").join(evidence.trust_document(docs, c.claims(), c.verifications()), "doc_id").join(evidence.durability_document(docs, c.citations(), c.records()), "doc_id")
    scopes = {"fresh": {"prefix": "c/3", "status": "stable", "fresh": True}, "provable": {"trust": "machine-confirmed", "provable": True}, "typed": {"prefix": "c", "kind": "5-LOW", "status": "draft", "trust": "machine-confirmed"}}
    found = [states.where(graph.in_scope(**scope)).select("doc_id", "path", F.lit(name).alias("scope")) for name, scope in scopes.items()]
    return reduce(DataFrame.unionByName, found)


@query("document_card", f"""WITH {_FRESH}, {_TRUSTED}, {_DURABLE}, drifts AS (SELECT doc_id, CASE WHEN bool_or(coalesce(drift = 'unsupported', false)) THEN 'unsupported' WHEN bool_or(drift IS NULL) THEN 'unchecked' ELSE arg_min(drift, archive_path) END AS drift FROM (SELECT DISTINCT doc_id, uri, version, archive_path FROM citations) LEFT JOIN last_check USING (uri, version) GROUP BY 1)
SELECT d.doc_id, d.title, list_extract(['unverified', 'machine-confirmed', 'human-reviewed'], tier + 1) AS trust, u.durability, freshness, drift, coalesce(claims, 0)::BIGINT AS claims, coalesce(i, 0)::BIGINT AS n_in, coalesce(o, 0)::BIGINT AS n_out, outs, d.doc_id % 12 = 0 AS stale_index
FROM docs d JOIN trusted USING (doc_id) JOIN durability u USING (doc_id) JOIN fresh USING (doc_id) LEFT JOIN drifts USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS claims FROM claims GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT target_doc AS doc_id, count(*) AS i FROM links WHERE target_doc IS NOT NULL GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT source_doc AS doc_id, count(*) AS o, string_agg(DISTINCT href, ',' ORDER BY href) AS outs FROM links GROUP BY 1) USING (doc_id)""")
def _(c):
    docs, links = c.documents(), c.links()
    hashed = F.sha2(F.concat_ws("|", "path", "title").cast("binary"), 256)
    indexed = docs.select("doc_id", F.when(F.col("doc_id") % 12 == 0, "old").otherwise(hashed).alias("indexed_hash"))
    states = [evidence.trust_document(docs, c.claims(), c.verifications()), evidence.durability_document(docs, c.citations(), c.records()), evidence.freshness_document(docs, c.citations(), c.checks(), now()).drop("oldest"), evidence.weakest_drift(c.citations(), c.checks())]
    return graph.document_cards(docs.withColumn("content_hash", hashed), indexed, c.claims(), links, states)


@query("review_queue", f"""WITH {_REPORT}, p AS (SELECT subject, claim_id, bool_and(value > 3) AS parsed FROM bounds GROUP BY 1, 2), u AS (SELECT subject, count(*) AS n, count(*) FILTER (WHERE NOT parsed) AS k, min(claim_id) AS a, max(claim_id) AS b, arg_min(parsed, claim_id) AND arg_max(parsed, claim_id) AS apart FROM p GROUP BY 1),
waiting AS (SELECT subject, k * (k - 1) // 2 + k * (n - k) AS pairs, CASE WHEN subject % 3 = 0 AND a <> b AND NOT apart THEN 1 ELSE 0 END AS put_off FROM u), hist AS (SELECT user_id % 25 AS domain, count(*) AS n FROM events WHERE event_type = 'click' AND user_id % 3 <> 2 GROUP BY 1),
aged AS ({ORACLE_SQL['check_challenge_age']}), lowhigh AS (SELECT subject FROM bounds JOIN docs USING (doc_id) WHERE type <> '5-LOW' AND value IS NOT NULL GROUP BY subject, dimension HAVING max(CASE WHEN op <> '<=' THEN value END) > min(CASE WHEN op <> '>=' THEN value END)), bad AS (SELECT DISTINCT subject FROM lowhigh)
SELECT 'draft' AS kind, doc_id::VARCHAR AS ref, decision || ':' || failed || ':' || unchecked AS state, NULL::BIGINT AS history, NULL::VARCHAR AS owner FROM decided JOIN docs USING (doc_id) WHERE status = 'draft'
UNION ALL SELECT 'conflict', subject::VARCHAR, 'open', n, CASE WHEN p_size % 7 <> 0 THEN 'team ' || p_brand END FROM bad JOIN part ON p_partkey = subject LEFT JOIN hist ON domain = subject % 25
UNION ALL SELECT 'unanswered-challenge', challenge_id::VARCHAR, problem, NULL, NULL FROM aged
UNION ALL SELECT 'pairs', subject::VARCHAR, (pairs - put_off)::VARCHAR || ' of ' || pairs::VARCHAR, n, CASE WHEN p_size % 7 <> 0 THEN 'team ' || p_brand END FROM waiting JOIN part ON p_partkey = subject LEFT JOIN hist ON domain = subject % 25 WHERE pairs > put_off""")
def _(c):
    drafts = QUERIES["gate_decision"](c.spark, c.sf_dir).join(c.documents().where("status = 'draft'").select("doc_id"), "doc_id", "left_semi")
    claims = c.bounds().select("subject", "claim_id", (F.col("value") > 3).alias("parsed"))
    ends = claims.groupBy("subject", "claim_id").agg(F.min("parsed").alias("parsed")).groupBy("subject").agg(F.min("claim_id").alias("a"), F.max("claim_id").alias("b"), (F.min_by("parsed", "claim_id") & F.max_by("parsed", "claim_id")).alias("both"))
    deferred = ends.where("subject % 3 = 0 AND a <> b AND NOT both").select("subject", F.lit(1).alias("deferred"))
    history = c.raw("events").where("event_type = 'click' AND user_id % 3 <> 2").groupBy((F.col("user_id") % 25).alias("domain")).agg(F.count("*").alias("history"))
    subjects = c.raw("part").select(F.col("p_partkey").alias("subject"), (F.col("p_partkey") % 25).alias("domain"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("team "), "p_brand")).alias("owner")).join(history, "domain", "left")
    episodic = c.documents().where("type = '5-LOW'").select("doc_id")
    standing = c.bounds().join(episodic, "doc_id", "left_anti").where("value IS NOT NULL")
    return checks.review_queue(drafts, conflict.contradicted(standing).select("subject").distinct(), QUERIES["check_challenge_age"](c.spark, c.sf_dir), conflict.unseparated_counts(claims), deferred, subjects)


_register_checks()
