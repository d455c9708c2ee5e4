"""Reports over the append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import fold_lower
from plumbline.operators.sampling import hash_sample
from plumbline.sources.keyed import KeyedTable


def miss_report(misses: DataFrame) -> DataFrame:
    """Per reason: emissions, distinct questions (one without key is its own), ops and checks."""
    question = F.coalesce("key", F.concat(F.lit("row:"), "line"))
    actionable = F.col("reason").isin("no_deterministic_path", "no_deterministic_predicate")
    out = misses.groupBy("reason").agg(
        F.count("*").alias("emissions"), F.count_distinct(question).alias("questions"),
        F.array_join(F.sort_array(F.collect_set("op")), ",").alias("ops"), F.array_join(F.sort_array(F.collect_set("check")), ",").alias("checks"),
    )
    return out.withColumn("actionable", actionable)


def carried(trail: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``(line, path, signal, actor)`` of every signal that a successful promotion carried; ``paths`` restricts them."""
    rows = trail.where((F.col("op") == "promote") & (F.col("outcome") == "ok"))
    if paths is not None:
        rows = rows.join(paths, "path", "left_semi")
    return rows.select("line", "path", F.explode("signals").alias("signal"), "actor")


def debt(trail: DataFrame, malformed: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """``(signal, owed, paths, promotions, unreadable)``: each carried signal with how often and on how many paths.

    ``promotions`` is how many promotions the whole trail has, carried or not, and
    ``unreadable`` how many of its lines, the rows of ``malformed``, don't parse;
    with any, counts are a floor.  A row without a signal holds these two where
    nothing is owed.
    """
    owed = carried(trail, paths).groupBy("signal").agg(F.count("*").alias("owed"), F.count_distinct("path").alias("paths"))
    promoted = trail.agg(F.count_if((F.col("op") == "promote") & (F.col("outcome") == "ok")).alias("promotions"))
    totals = promoted.join(F.broadcast(malformed.agg(F.count("*").alias("unreadable"))))
    out = totals.join(owed, F.lit(True), "left")
    return out.select("signal", F.coalesce("owed", F.lit(0)).alias("owed"), F.coalesce("paths", F.lit(0)).alias("paths"), "promotions", "unreadable")


def gained(trail: DataFrame, since: Column) -> DataFrame:
    """Successful work since a time: one row of counts; a fetch counts its paths, deferrals and upkeep nothing."""
    rows = trail.where((F.col("outcome") == "ok") & (F.col("at") >= since))
    counted = (("promote", "promoted"), ("admit", "admitted"), ("discard", "declined"), ("challenge", "challenged"), ("adjudicate", "adjudicated"))
    archived = F.coalesce(F.sum(F.when(F.col("op") == "fetch", F.size("paths"))), F.lit(0)).alias("archived")
    return rows.agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in counted], archived)


def outstanding(trail: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """Blocked promotions of each path since its last discard or successful promotion."""
    reset = (F.col("op") == "discard") | ((F.col("op") == "promote") & (F.col("outcome") == "ok"))
    rows = trail.withColumn("last_reset", F.max(F.when(reset, F.col("line"))).over(W.partitionBy("path")))
    rows = rows.where((F.col("op") == "promote") & (F.col("outcome") != "ok") & (F.col("line") > F.coalesce("last_reset", F.lit(-1))))
    out = rows.groupBy("path").agg(F.count("*").alias("attempts"), F.max("at").alias("last_at"), F.max_by("actor", "line").alias("last_actor"))
    return out if drafts is None else out.join(drafts, "path", "left_semi")


def relay_grade(trail: DataFrame, since: Column, allowed: tuple[str, ...]) -> DataFrame:
    """Operations outside ``allowed`` between ``since`` and the first successful admission."""
    rows = trail.where(F.col("at") >= since)
    first = rows.where((F.col("op") == "admit") & (F.col("outcome") == "ok")).agg(F.min(F.struct("at", "line")).alias("first"))
    early = rows.join(F.broadcast(first)).where(F.col("first").isNull() | (F.struct("at", "line") < F.col("first")))
    return early.where(~F.col("op").isin(*allowed)).select("line", "op", "actor", "path")


def trail_validate(trail: DataFrame) -> DataFrame:
    """Rows with a blank operation or actor or without a time, and what is wrong."""
    problems = F.concat_ws(",", F.when(F.coalesce(F.trim("op"), F.lit("")) == "", "op"), F.when(F.coalesce(F.trim("actor"), F.lit("")) == "", "actor"), F.when(F.col("at").isNull(), "at"))
    return trail.select("line", problems.alias("problems")).where(F.col("problems") != "")


def withheld_claims(trail: DataFrame) -> DataFrame:
    """Signals of refused admissions: how often, on how many paths."""
    rows = trail.where((F.col("op") == "admit") & (F.col("outcome") != "ok")).select("path", F.explode("signals").alias("claim"))
    return rows.groupBy("claim").agg(F.count("*").alias("times"), F.count_distinct("path").alias("sources"))


def domain_of(subject: Column) -> Column:
    """A subject's domain: what stands before its first dot, else the whole key; null for an empty one."""
    return F.nullif(F.substring_index(subject, ".", 1), F.lit(""))


def domain_history(decided: DataFrame) -> DataFrame:
    """``(domain, actor, decisions, place)`` of adjudications ``(subject, actor)``: who decided how often in each subject's domain.

    Blank actors and subjects without a domain don't count.  ``place`` is the order
    within the domain: most decisions first, then by name.
    """
    rows = decided.withColumn("domain", domain_of(F.col("subject"))).where(F.col("domain").isNotNull() & (F.trim(F.coalesce("actor", F.lit(""))) != ""))
    counts = rows.groupBy("domain", "actor").agg(F.count("*").alias("decisions"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("decisions"), "actor")))


def authority_of(humans: Column) -> Column:
    """Four or more human adjudicators are a quorum, two or more paired, else sole."""
    return F.when(humans >= 4, "quorum").when(humans >= 2, "paired").otherwise("sole")


def adjudicators(decisions: DataFrame) -> DataFrame:
    """``(doc_id, line, who)`` of the humans among adjudicators, co-signers and verifiers."""
    who = F.explode(F.array("by", "co_signed_by", "verified_by")).alias("who")
    return decisions.select("doc_id", "line", who).where(F.col("who").rlike("^human:."))


def authority(decisions: DataFrame) -> DataFrame:
    """Per document, its distinct human adjudicators and the authority they make; a document without any is sole."""
    out = decisions.select("doc_id").distinct().join(adjudicators(decisions).groupBy("doc_id").agg(F.count_distinct("who").alias("humans")), "doc_id", "left").na.fill(0, ["humans"])
    return out.withColumn("authority", authority_of(F.col("humans")))


def authority_move(decisions: DataFrame) -> DataFrame:
    """Lines at which a document's authority changes: ``(doc_id, line, humans, before, after)``."""
    first = adjudicators(decisions).groupBy("doc_id", "who").agg(F.min("line").alias("line"))
    new = first.groupBy("doc_id", "line").agg(F.count("*").alias("gained"))
    rows = new.withColumn("humans", F.sum("gained").over(W.partitionBy("doc_id").orderBy("line")))
    moves = rows.select("doc_id", "line", "humans", authority_of(F.col("humans") - F.col("gained")).alias("before"), authority_of(F.col("humans")).alias("after"))
    return moves.where("before <> after")


def last_announced_authority(lines: DataFrame) -> DataFrame:
    """The last authority that the log lines ``(doc_id, line, text)`` of a document announce."""
    said = F.regexp_extract("text", r"^\s*Authority:.*→\s*(sole|paired|quorum)\s*(,|$)", 1)
    return lines.withColumn("authority", said).where("authority <> ''").groupBy("doc_id").agg(F.max_by("authority", "line").alias("authority"), F.max("line").alias("line"))


def covered_angles(critiques: DataFrame) -> DataFrame:
    """``(ref, angle, state)``: each examined angle in its first spelling, then those not examined that never were."""

    def angles(column: str) -> DataFrame:
        rows = critiques.select("ref", "line", F.explode(column).alias("angle"))
        rows = rows.withColumn("folded", fold_lower(F.col("angle"))).where("folded <> ''")
        return rows.groupBy("ref", "folded").agg(F.min_by("angle", "line").alias("angle"))

    examined = angles("examined")
    open_ = angles("not_examined").join(examined, ["ref", "folded"], "left_anti")
    return examined.select("ref", "angle", F.lit("examined").alias("state")).unionByName(open_.select("ref", "angle", F.lit("not-examined").alias("state")))


def semantic_review(documents: DataFrame, findings: DataFrame, critiques: DataFrame) -> DataFrame:
    """``(ref, review)``: findings if a critic found something, unknown without a ledger, clean if criticised, else structural-only."""
    bad = findings.groupBy("ref").agg(F.max(F.col("category").startswith("critic:")).alias("bad"))
    seen = critiques.groupBy("ref").agg(F.count("*").alias("n"))
    rows = documents.join(bad, "ref", "left").join(seen, "ref", "left")
    review = F.when(F.coalesce("bad", F.lit(False)), "findings").when(~F.col("ledger_read"), "unknown").when(F.coalesce("n", F.lit(0)) > 0, "clean").otherwise("structural-only")
    return rows.select("ref", review.alias("review"))


def critique_population(claims: DataFrame, citations: DataFrame, archived: DataFrame, n: int, seed: int) -> DataFrame:
    """A sample of claims with a quote and an archived source: the first such source, and how many claims were skipped."""
    source = citations.join(archived.select("archive_path"), "archive_path", "left_semi").groupBy("claim_id").agg(F.min("archive_path").alias("source"))
    fit = claims.where(F.size("quotes") > 0).select("claim_id").distinct().join(source, "claim_id")
    counts = claims.agg(F.count_distinct("claim_id").alias("all")).join(F.broadcast(fit.agg(F.count("*").alias("fit"))))
    drawn = hash_sample(fit, "claim_id", n, seed)
    return drawn.join(F.broadcast(counts)).select("claim_id", "source", (F.col("all") - F.col("fit")).alias("skipped"))


def prior_rationales(trail: DataFrame, path: str) -> DataFrame:
    return trail.where((F.col("op") == "promote") & (F.col("outcome") == "ok") & (F.col("path") == path)).select("line", "actor", "at")


def record_retrievals(retrievals: DataFrame) -> DataFrame:
    """Returns and last time per claim."""
    return retrievals.groupBy("claim_id").agg(F.count("*").alias("returns"), F.max("at").alias("last_at"))


def retrieval_state(spark: SparkSession, folder: str) -> KeyedTable:
    """The stored counters of returned claims: ``claim_id, returns, last_at``."""
    return KeyedTable(spark, folder, ["claim_id"], {"returns": "sum", "last_at": "max"})


def merge_retrievals(state: KeyedTable, retrievals: DataFrame, batch: str) -> int:
    """Count a batch of returns ``(claim_id, at)`` into the stored counters, once."""
    return state.merge_batch(retrievals.select("claim_id", F.lit(1).cast("long").alias("returns"), F.col("at").alias("last_at")), batch)


def check_state(spark: SparkSession, folder: str) -> KeyedTable:
    """The stored last check of each source version: ``uri, version, last``, a struct of the check's time, line and verdict."""
    return KeyedTable(spark, folder, ["uri", "version"], {"last": "max", "checks": "sum"})


def merge_checks(state: KeyedTable, checks: DataFrame, batch: str) -> int:
    """Merge a batch of checks ``(uri, version, at, line, drift)`` into the stored ones, once; the last by time, then line, stays."""
    return state.merge_batch(checks.select("uri", "version", F.struct("at", "line", "drift").alias("last"), F.lit(1).cast("long").alias("checks")), batch)


def unreached_claims(claims: DataFrame, retrievals: DataFrame, since: Column) -> DataFrame:
    """Claims with a lead: observed if last returned at or after ``since``, else quiet."""
    last = record_retrievals(retrievals).select("claim_id", "last_at")
    out = claims.where(F.col("lead").isNotNull()).join(last, "claim_id", "left")
    return out.select("claim_id", F.when(F.col("last_at") >= since, "observed").otherwise("quiet").alias("reach"))


def last_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; all its other columns come from that row."""
    rest = [c for c in log.columns if c not in keys]
    names = list(dict.fromkeys([*order, *rest]))
    return log.groupBy(*keys).agg(F.max(F.struct(*names)).alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def findings_gate(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether the errors block; a row stands for as many as its column ``findings`` says, or for one."""
    n = F.col("findings") if "findings" in findings.columns else F.lit(1)
    out = findings.agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, n)), F.lit(0)).cast("long").alias(f"{s}s") for s in ("error", "warning")])
    return out.withColumn("blocks", F.col("errors") > 0)


def exchanges(turns: DataFrame) -> DataFrame:
    """Each non-blank user turn with the assistant turns up to the next user turn, joined by blank lines."""
    w = W.partitionBy("session_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = turns.withColumn("group", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where(F.col("group") > 0)
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    out = rows.groupBy("session_id", "group").agg(
        F.max(F.when((F.col("role") == "user") & said, F.col("text"))).alias("question"), F.min("pos").alias("pos"),
        F.sort_array(F.collect_list(F.when((F.col("role") != "user") & said, F.struct("pos", "text")))).alias("parts"),
    )
    out = out.where(F.col("question").isNotNull() & (F.size("parts") > 0))
    return out.select("session_id", "pos", "question", F.array_join(F.col("parts.text"), "\n\n").alias("answer"))


def repeated_questions(asked: DataFrame) -> DataFrame:
    """Questions ``(session_id, pos, question, answer)`` asked at least twice: ``(key, asked, question, answer, turns, sessions, kind)``.

    Questions are the same if they are in folded lower case.  The first spelling
    and the last answer stay; ``turns`` lists where each was asked, in order.
    Asked in several sessions a question is recurring, else retried.
    """
    at = F.struct("session_id", "pos")
    rows = asked.withColumn("key", fold_lower(F.col("question"))).where("key <> ''")
    out = rows.groupBy("key").agg(
        F.count("*").alias("asked"), F.min_by("question", at).alias("question"), F.max_by("answer", at).alias("answer"), F.count_distinct("session_id").alias("sessions"), F.sort_array(F.collect_list(at)).alias("places"),
    )
    turns = F.array_join(F.transform("places", lambda x: F.concat_ws(":", x["session_id"], x["pos"])), ",")
    return out.where("asked >= 2").select("key", "asked", "question", "answer", turns.alias("turns"), "sessions", F.when(F.col("sessions") > 1, "recurring").otherwise("retried").alias("kind"))
