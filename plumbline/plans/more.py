"""Further queries: warrants, terms, staleness and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as fx
from plumbline.operators import checks, evidence, rationale
from plumbline.plans.queries import _LAST, now
from plumbline.plans.registry import query
from plumbline.sources.bind import Corpus
from plumbline.sources.scratch import fresh_folder
from plumbline.streaming import trail as streams


@query("scan_coverage", "SELECT path AS doc_id, array_to_string(list_filter(['fetch', 'admit', 'promote', 'discard'], lambda x: NOT list_contains(s, x)), ',') AS missing FROM (SELECT path || '/' || actor AS path, list(DISTINCT op) AS s FROM trail GROUP BY 1) WHERE len(list_filter(['fetch', 'admit', 'promote', 'discard'], lambda x: NOT list_contains(s, x))) > 0")
def _(c):
    run = c.trail().groupBy(F.concat_ws("/", "path", "actor").alias("doc_id")).agg(F.collect_set("op").alias("stages"))
    return checks.scan_coverage(run, ("fetch", "admit", "promote", "discard"))


_WARRANTS = """warrants AS (SELECT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, 'human:' || l_suppkey AS "by", CASE WHEN l_partkey % 5 = 0 THEN 'human:' || l_partkey END AS co_signed_by,
CASE WHEN l_quantity > 40 THEN l_orderkey || '#1' ELSE '' END AS reverses, CASE WHEN l_quantity % 2 = 0 THEN 'shown by ' || l_partkey ELSE '' END AS rationale FROM lineitem)"""


def _warrants(c: Corpus):
    claim = F.concat_ws("#", "l_orderkey", "l_linenumber")
    return c.raw("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), claim.alias("claim_id"), F.concat(F.lit("human:"), "l_suppkey").alias("by"), F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("human:"), "l_partkey")).alias("co_signed_by"),
        F.when(F.col("l_quantity") > 40, F.concat("l_orderkey", F.lit("#1"))).otherwise("").alias("reverses"), F.when(F.col("l_quantity") % 2 == 0, F.concat(F.lit("shown by "), "l_partkey")).otherwise("").alias("rationale"),
    )


@query("reversals", f'WITH {_WARRANTS} SELECT claim_id, reverses, "by" FROM warrants WHERE reverses <> \'\'')
def _(c):
    return _warrants(c).where(F.col("reverses") != "").select("claim_id", "reverses", "by")


@query("declared_terms", "SELECT 'p' || p_partkey AS term, p_type AS description FROM part UNION ALL SELECT p_name || ' ' || p_partkey, p_type FROM part")
def _(c):
    terms = F.array(F.concat(F.lit("p"), "p_partkey"), F.concat_ws(" ", "p_name", "p_partkey"))
    return c.raw("part").select(F.explode(terms).alias("term"), F.col("p_type").alias("description"))


@query("subject_owners", "SELECT p_partkey AS key, 'team ' || p_brand AS owner FROM part WHERE p_size % 7 <> 0")
def _(c):
    owner = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("team "), "p_brand"))
    return c.raw("part").select(F.col("p_partkey").alias("key"), owner.alias("owner")).where(F.col("owner").isNotNull())


@query("check_stale", f"""WITH {_LAST}, s AS (SELECT doc_id, count(*) AS n, count("at") AS k, min("at") AS oldest FROM (SELECT DISTINCT doc_id, uri, version FROM citations) LEFT JOIN last_check USING (uri, version) GROUP BY 1)
SELECT doc_id, CASE WHEN DATE '2003-06-01' >= stale_after THEN 'declared' ELSE 'unchecked-for-long' END AS reason FROM docs LEFT JOIN s USING (doc_id) WHERE DATE '2003-06-01' >= stale_after OR (k = n AND date_diff('day', oldest::DATE, DATE '2003-06-01') >= 180 AND type <> '5-LOW')""")
def _(c):
    docs = c.documents()
    rows = docs.join(evidence.freshness_document(docs, c.citations(), c.checks(), now()).select("doc_id", "oldest"), "doc_id")
    old = F.col("oldest").isNotNull() & (F.datediff(now(), F.col("oldest").cast("date")) >= 180) & (F.col("type") != "5-LOW")
    declared = now() >= F.col("stale_after")
    return rows.where(declared | old).select("doc_id", F.when(declared, "declared").otherwise("unchecked-for-long").alias("reason"))


@query("check_filename_drift", "SELECT doc_id, path, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g') AS wanted FROM docs WHERE NOT contains(path, regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'))")
def _(c):
    wanted = fx.slug(F.col("title"))
    return c.documents().where(~F.contains(F.col("path"), wanted)).select("doc_id", "path", wanted.alias("wanted"))


class _Stream(Corpus):
    """The corpus with the given tables read as streams."""

    def raw(self, table: str):
        # A pattern, as a stream's plain path must be a folder and this table may be one file.
        schema = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.sf_dir}/{table}.parque[t]")


@query("stream_trail_counts", "SELECT date_trunc('day', \"at\")::TIMESTAMP AS day, op, count(*) AS n FROM trail WHERE outcome = 'ok' GROUP BY 1, 2")
def _(c):
    return streams.run_available(streams.trail_counts(_Stream(c.spark, c.sf_dir).trail(), "60 days"), "trail-counts", ["day", "op"])


@query("stream_retrievals", 'SELECT claim_id, count(*) AS returns, max("at") AS last_at FROM retrievals GROUP BY 1')
def _(c):
    return streams.stream_retrievals(_Stream(c.spark, c.sf_dir).retrievals(), fresh_folder(c.spark, "retrieval-stream"))


@query("trail_by_day", "SELECT date_trunc('day', \"at\")::TIMESTAMP AS day, op, outcome, count(*) AS n FROM trail GROUP BY ALL")
def _(c):
    return c.trail().groupBy(F.date_trunc("day", "at").alias("day"), "op", "outcome").agg(F.count("*").alias("n"))


#: What the promotion form asks for; the last is too short to prove anything.
ASKED = ("State why you are promoting this document despite the open signals", "Name the source that the claim rests on, and why it holds", "Say what would change your mind about this claim", "State your reason")


def _rationales(c: Corpus):
    """``line, label, rationale`` of the warrants; some repeat the form in other letters, some an earlier one."""
    part = F.col("l_partkey")
    own = F.concat(F.lit("shown by "), part % 500)
    quoted = F.upper(F.lit(ASKED[0]))
    text = (
        F.when(part % 11 == 0, F.concat(F.lit("We did re"), F.lower(F.lit(ASKED[1])), F.lit("s;  "), own)).when(part % 13 == 0, F.concat(quoted, F.lit("\n"), own)).when(part % 17 == 0, F.concat(F.lit(ASKED[3]), F.lit(": "), own))
        .when(part % 19 == 0, F.concat(F.lit(ASKED[2]), F.lit(" "), F.lit(ASKED[1]))).when(part % 23 == 0, "  ").otherwise(own)
    )
    line = F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_suppkey") % 10
    rows = c.raw("lineitem").select(line.alias("line"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("label"), text.alias("rationale"))
    return rows.groupBy("line").agg(F.min(F.struct("label", "rationale")).alias("r")).select("line", "r.*")


_RATIONALES = f"""said AS (SELECT l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10 AS line, l_orderkey || '#' || l_linenumber AS label, CASE WHEN l_partkey % 11 = 0 THEN 'We did re' || lower('{ASKED[1]}') || 's;  shown by ' || (l_partkey % 500)
  WHEN l_partkey % 13 = 0 THEN upper('{ASKED[0]}') || chr(10) || 'shown by ' || (l_partkey % 500) WHEN l_partkey % 17 = 0 THEN '{ASKED[3]}: shown by ' || (l_partkey % 500) WHEN l_partkey % 19 = 0 THEN '{ASKED[2]} {ASKED[1]}' WHEN l_partkey % 23 = 0 THEN '  ' ELSE 'shown by ' || (l_partkey % 500) END AS rationale FROM lineitem),
rationales AS (SELECT line, label, rationale FROM said QUALIFY row_number() OVER (PARTITION BY line ORDER BY label, rationale) = 1),
folded AS (SELECT *, lower(trim(regexp_replace(rationale, '\\s+', ' ', 'g'))) AS f FROM rationales),
asked AS (SELECT unnest(range(0, {len(ASKED)})) AS rank, unnest([{', '.join("'" + x + "'" for x in ASKED)}]) AS phrase)"""


@query("unusable_rationale", f"""WITH {_RATIONALES}, t AS (SELECT line, arg_min(phrase, rank) AS template FROM folded JOIN asked ON contains(f, lower(phrase)) WHERE len(string_split(phrase, ' ')) >= 6 GROUP BY 1),
p AS (SELECT line, first_value(label) OVER (PARTITION BY f ORDER BY line) AS prior, row_number() OVER (PARTITION BY f ORDER BY line) AS n FROM folded WHERE f <> '')
SELECT line, CASE WHEN template IS NOT NULL THEN 'template' ELSE 'prior' END AS reason, coalesce(template, prior) AS match FROM p LEFT JOIN t USING (line) WHERE template IS NOT NULL OR n > 1""")
def _(c):
    asked = c.spark.createDataFrame(list(enumerate(ASKED)), "rank int, phrase string")
    return rationale.unusable_rationales(_rationales(c), asked)
