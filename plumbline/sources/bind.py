"""Corpus tables taken from the given tables.

The given tables stand in for a corpus: orders are documents, lineitems cite
sources for claims, events are the log, conversations the sessions.
``SQL_TABLES`` says the same in SQL for the comparison runs.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import search
from plumbline.sources.prose import SQL_PROSE, statements
from plumbline.sources.scratch import shared_dir

#: Indexes built by this driver: (application, tables, their files, name, only which terms) to index.
_INDEXES: dict[tuple[str, str, str, str, search.Only | None], search.Index] = {}


class Corpus:
    """Corpus tables of one folder of given tables; each is read with the columns it needs."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def texts(self) -> DataFrame:
        """``doc_id, path, type, body`` of the prose."""
        kind = F.when(F.col("lang") == "en", "Rule").when(F.col("lang") == "de", "Procedure").when(F.col("lang") == "fr", "Decision").otherwise("Reference")
        return self.raw("documents").select("doc_id", F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), kind.alias("type"), F.col("text").alias("body"))

    def titled(self) -> DataFrame:
        """The prose with a title: the first eight words."""
        title = F.array_join(F.regexp_extract_all(F.regexp_extract("body", r"^\s*+(?:\S++\s++){0,7}\S*+", 0), F.lit(r"\S+"), F.lit(0)), " ")
        return self.texts().withColumn("title", title)

    def _index(self, name: str, documents, build=search.build, only: search.Only | None = None) -> search.Index:
        """The index of some documents; built and stored once for these tables, then read.  For ``only`` some terms the whole one will do, if there is one."""
        whole = (self.spark.sparkContext.applicationId, self.sf_dir, self._files(), name, None)
        key = whole if whole in _INDEXES else (*whole[:-1], only)
        if key not in _INDEXES:
            options = {"only": only} if only else {}
            _INDEXES[key] = build(documents(), f"{shared_dir(self.spark)}/index-{name}-{uuid.uuid4().hex[:12]}", **options)
        return search.Index(self.spark, _INDEXES[key].folder, key[-1])

    def _files(self) -> str:
        """What the indexed tables are made of: a digest of their files' names, sizes and times."""
        jvm, out = self.spark._jvm, []
        for table in ("documents", "lineitem"):
            at = jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{table}.parquet")
            system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if system.exists(at):
                out += sorted(f"{x.getPath()} {x.getLen()} {x.getModificationTime()}" for x in system.listStatus(at))
        return hashlib.sha256("\n".join(out).encode()).hexdigest()

    def text_index(self, only: search.Only | None = None) -> search.Index:
        return self._index("texts", lambda: self.titled().select("doc_id", "title", "body"), only=only)

    def lead_index(self) -> search.Index:
        """Claims by their leads, each lead once; claims without one are not in it."""
        leads = lambda: self.statements().where(F.col("lead").isNotNull()).select(F.col("claim_id").alias("doc_id"), F.lit("").alias("title"), F.col("lead").alias("body"))
        return self._index("leads", leads, search.build_alike)

    def documents(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "P", "draft").otherwise("")
        return self.raw("orders").select(
            key.alias("doc_id"), F.concat(F.lit("c/"), key % 10, F.lit("/"), key, F.lit(".md")).alias("path"), F.col("o_orderpriority").alias("type"),
            F.concat(F.lit("Title "), F.col("o_custkey")).alias("title"), status.alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 2000).alias("stale_after"),
        )

    def citations(self) -> DataFrame:
        """A row per source a claim cites (repeats kept): ``doc_id, claim_id, pos, uri, version, archive_path``."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("doc_id"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_linenumber").alias("pos"),
            F.col("l_partkey").alias("uri"), F.col("l_suppkey").cast("string").alias("version"), F.concat(F.lit("evidence/text/"), "l_partkey", F.lit("/"), "l_suppkey").alias("archive_path"),
        )

    def claims(self) -> DataFrame:
        """``doc_id, claim_id, lead``; claims in position 5 have no lead."""
        rows = self.raw("lineitem").select("l_orderkey", "l_linenumber").distinct()
        claim = F.concat_ws("#", "l_orderkey", "l_linenumber")
        return rows.select(F.col("l_orderkey").alias("doc_id"), claim.alias("claim_id"), F.when(F.col("l_linenumber") != 5, F.concat(claim, F.lit(" says so"))).alias("lead"))

    def statements(self) -> DataFrame:
        """English claims: ``doc_id, claim_id, pos, uri, text, lead, number, quotes``."""
        return statements(self.raw("lineitem"))

    def statements_by(self, key: str) -> DataFrame:
        """The same dealt by ``doc_id`` or ``uri``, for use by groups of it: rows are dealt as keys, and texts made where they meet."""
        return statements(self.raw("lineitem").repartition({"doc_id": "l_orderkey", "uri": "l_partkey"}[key]))

    def verifications(self) -> DataFrame:
        by = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("human:"), "l_suppkey")).when(F.col("l_returnflag") == "R", F.concat(F.lit("check:"), "l_suppkey"))
        return self.raw("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("claim_id"), by.alias("by"))

    def links(self) -> DataFrame:
        """``source_doc, href, target_doc, external``; the target of a link to no document is null."""
        rows = self.raw("lineitem").select(F.col("l_orderkey").alias("source_doc"), (F.col("l_partkey") * 8).alias("to"), (F.col("l_linenumber") == 7).alias("external"))
        known = self.raw("orders").select(F.col("o_orderkey").alias("target_doc"))
        found = rows.join(known, rows["to"] == known["target_doc"], "left")
        target = F.when(~F.col("external"), F.col("target_doc"))
        return found.select("source_doc", F.concat(F.lit("c/"), "to").alias("href"), target.alias("target_doc"), "external")

    def bounds(self) -> DataFrame:
        op = F.when(F.col("l_returnflag") == "A", "<=").when(F.col("l_returnflag") == "R", ">=").otherwise("==")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("doc_id"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_partkey").alias("subject"),
            F.col("l_linestatus").alias("dimension"), op.alias("op"), F.col("l_quantity").alias("value"),
        )

    def records(self) -> DataFrame:
        """Fetch records, one per source version: ``uri, version, archive_path, disposition, byte_size``.

        Versions are told apart by their keys; names are made of what is left.
        """
        rows = self.raw("lineitem").select(F.col("l_partkey").alias("uri"), "l_suppkey").distinct()
        part = self.raw("part").select(F.col("p_partkey").alias("uri"), "p_size")
        kind = F.when(F.col("p_size") % 3 == 0, "archived").when(F.col("p_size") % 3 == 1, "extracted").otherwise("referenced")
        path = F.concat(F.lit("evidence/text/"), "uri", F.lit("/"), "l_suppkey")
        return rows.join(part, "uri").select("uri", F.col("l_suppkey").cast("string").alias("version"), path.alias("archive_path"), kind.alias("disposition"), (F.col("p_size") * 1000).cast("long").alias("byte_size"))

    def checks(self) -> DataFrame:
        """The check log: ``uri, version, at, drift, line`` of shipped lines."""
        drift = F.when(F.col("l_returnflag") == "A", "benign").when(F.col("l_returnflag") == "R", "unsupported").otherwise("current")
        rows = self.raw("lineitem").where(F.col("l_linestatus") == "F")
        return rows.select(F.col("l_partkey").alias("uri"), F.col("l_suppkey").cast("string").alias("version"), F.col("l_shipdate").alias("at"), drift.alias("drift"), F.concat_ws("#", "l_orderkey", "l_linenumber").alias("line"))

    def trail(self) -> DataFrame:
        """The audit log: ``line, at, op, actor, path, outcome, signals``."""
        kind, user = F.col("event_type"), F.col("user_id")
        op = F.when(kind == "view", "fetch").when(kind == "signup", "admit").when(kind == "error", "discard").otherwise("promote")
        actor = F.when(user % 3 == 0, F.concat(F.lit("human:"), user)).when(user % 3 == 1, F.concat(F.lit("agent:"), user)).otherwise("")
        signals = F.when(user % 5 == 0, F.array().cast("array<string>")).when(user % 2 == 0, F.array(F.lit("conflict"))).otherwise(F.array(F.lit("conflict"), F.lit("hedging")))
        return self.raw("events").select(F.col("event_id").alias("line"), F.col("ts").alias("at"), op.alias("op"), actor.alias("actor"), F.concat(F.lit("c/"), F.col("event_id") % 50).alias("path"), F.when(F.col("value") < 40, "ok").otherwise("blocked").alias("outcome"), signals.alias("signals"))

    def malformed_lines(self) -> DataFrame:
        """Lines of the audit log that don't parse, by number."""
        return self.raw("events").where("event_id % 97 = 5").select(F.col("event_id").alias("line"))

    def misses(self) -> DataFrame:
        """The miss log: ``line, op, reason, key, check``."""
        op = F.when(F.col("event_type") == "view", "extract").when(F.col("event_type") == "click", "accrete").otherwise("critique")
        reason = F.when(F.col("user_id") % 3 == 0, "no_deterministic_path").when(F.col("user_id") % 3 == 1, "no_deterministic_predicate").otherwise("ambiguous_source")
        key = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("k"), F.col("event_id") % 400))
        return self.raw("events").select(F.col("event_id").alias("line"), op.alias("op"), reason.alias("reason"), key.alias("key"), F.concat(F.lit("check"), F.col("user_id") % 4).alias("check"))

    def retrievals(self) -> DataFrame:
        """Returned claims: ``line, claim_id, at``."""
        claim = F.concat(F.col("user_id"), F.lit("#"), F.col("event_id") % 7)
        return self.raw("events").where(F.col("event_type") == "view").select(F.col("event_id").alias("line"), claim.alias("claim_id"), F.col("ts").alias("at"))

    def turns(self) -> DataFrame:
        """The turns of sessions; users ask a few questions again, in other letters and spacing, within a session and in others."""
        rows = self.raw("conversations").where(F.col("role").isin("user", "assistant"))
        again = F.concat(F.lit("How  do I restart the queue of node "), F.col("conv_id") % 37, F.lit("?"))
        again = F.when(F.col("turn") % 4 < 2, F.upper(again)).otherwise(again)
        text = F.when((F.col("role") == "user") & ((F.col("conv_id") * 3 + F.col("turn")) % 5 == 0), again).otherwise(F.col("text"))
        return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", text.alias("text"))


SQL_TABLES = """
texts AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, CASE lang WHEN 'en' THEN 'Rule' WHEN 'de' THEN 'Procedure' WHEN 'fr' THEN 'Decision' ELSE 'Reference' END AS type, text AS body FROM documents),
docs AS (SELECT o_orderkey AS doc_id, 'c/' || (o_orderkey % 10) || '/' || o_orderkey || '.md' AS path, o_orderpriority AS type, 'Title ' || o_custkey AS title,
  CASE o_orderstatus WHEN 'F' THEN 'stable' WHEN 'P' THEN 'draft' ELSE '' END AS status, o_orderdate::DATE + 2000 AS stale_after FROM orders),
citations AS (SELECT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, l_linenumber AS pos, l_partkey AS uri, l_suppkey::VARCHAR AS version, 'evidence/text/' || l_partkey || '/' || l_suppkey AS archive_path FROM lineitem),
claims AS (SELECT DISTINCT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, CASE WHEN l_linenumber <> 5 THEN l_orderkey || '#' || l_linenumber || ' says so' END AS lead FROM lineitem),
verifications AS (SELECT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, CASE l_returnflag WHEN 'A' THEN 'human:' || l_suppkey WHEN 'R' THEN 'check:' || l_suppkey END AS "by" FROM lineitem),
links AS (SELECT l_orderkey AS source_doc, 'c/' || (l_partkey * 8) AS href, CASE WHEN l_linenumber <> 7 THEN o_orderkey END AS target_doc, l_linenumber = 7 AS external FROM lineitem LEFT JOIN orders ON o_orderkey = l_partkey * 8),
bounds AS (SELECT l_orderkey AS doc_id, l_orderkey || '#' || l_linenumber AS claim_id, l_partkey AS subject, l_linestatus AS dimension, CASE l_returnflag WHEN 'A' THEN '<=' WHEN 'R' THEN '>=' ELSE '==' END AS op, l_quantity AS value FROM lineitem),
records AS (SELECT DISTINCT uri, version, archive_path, CASE p_size % 3 WHEN 0 THEN 'archived' WHEN 1 THEN 'extracted' ELSE 'referenced' END AS disposition, (p_size * 1000)::BIGINT AS byte_size FROM citations JOIN part ON p_partkey = uri),
checks AS (SELECT l_partkey AS uri, l_suppkey::VARCHAR AS version, l_shipdate AS "at", CASE l_returnflag WHEN 'A' THEN 'benign' WHEN 'R' THEN 'unsupported' ELSE 'current' END AS drift, l_orderkey || '#' || l_linenumber AS line FROM lineitem WHERE l_linestatus = 'F'),
trail AS (SELECT event_id AS line, ts AS "at", CASE event_type WHEN 'view' THEN 'fetch' WHEN 'signup' THEN 'admit' WHEN 'error' THEN 'discard' ELSE 'promote' END AS op,
  CASE user_id % 3 WHEN 0 THEN 'human:' || user_id WHEN 1 THEN 'agent:' || user_id ELSE '' END AS actor, 'c/' || (event_id % 50) AS path, CASE WHEN value < 40 THEN 'ok' ELSE 'blocked' END AS outcome,
  CASE WHEN user_id % 5 = 0 THEN []::VARCHAR[] WHEN user_id % 2 = 0 THEN ['conflict'] ELSE ['conflict', 'hedging'] END AS signals FROM events),
misses AS (SELECT event_id AS line, CASE event_type WHEN 'view' THEN 'extract' WHEN 'click' THEN 'accrete' ELSE 'critique' END AS op,
  CASE user_id % 3 WHEN 0 THEN 'no_deterministic_path' WHEN 1 THEN 'no_deterministic_predicate' ELSE 'ambiguous_source' END AS reason, CASE WHEN event_id % 7 <> 0 THEN 'k' || (event_id % 400) END AS key, 'check' || (user_id % 4) AS "check" FROM events),
retrievals AS (SELECT event_id AS line, user_id || '#' || (event_id % 7) AS claim_id, ts AS "at" FROM events WHERE event_type = 'view'),
turns AS (SELECT conv_id AS session_id, turn AS pos, role, CASE WHEN role = 'user' AND (conv_id * 3 + turn) % 5 = 0 THEN CASE WHEN turn % 4 < 2 THEN upper('How  do I restart the queue of node ' || (conv_id % 37) || '?') ELSE 'How  do I restart the queue of node ' || (conv_id % 37) || '?' END ELSE text END AS text FROM conversations WHERE role IN ('user', 'assistant')),""" + SQL_PROSE.strip() + "\n"
