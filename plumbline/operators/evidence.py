"""Evidence and the states derived from it, as ordered-enum aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUST = ("unverified", "machine-confirmed", "human-reviewed")


def ranked(values: tuple[str, ...], rank: Column) -> Column:
    """The enum value of a rank; null is the first, the least reassuring."""
    return F.element_at(F.array(*map(F.lit, values)), F.coalesce(rank, F.lit(0)) + 1)


def trust_rank(by: Column) -> Column:
    blank = by.isNull() | (F.trim(by) == "")
    return F.when(blank, 0).when(by.rlike(r"^human:."), 2).otherwise(1)


def trust_claim(claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """Best verification of each claim; a blank verifier is none."""
    best = verifications.groupBy("claim_id").agg(F.max(trust_rank(F.col("by"))).alias("rank"))
    return claims.select("doc_id", "claim_id").join(best, "claim_id", "left").select("doc_id", "claim_id", ranked(TRUST, F.col("rank")).alias("trust"))


def trust_document(documents: DataFrame, claims: DataFrame, verifications: DataFrame) -> DataFrame:
    """Weakest claim of each document; one without claims is unverified."""
    best = verifications.groupBy("claim_id").agg(F.max(trust_rank(F.col("by"))).alias("rank"))
    weakest = claims.select("doc_id", "claim_id").join(best, "claim_id", "left").groupBy("doc_id").agg(F.min(F.coalesce("rank", F.lit(0))).alias("rank"))
    return documents.select("doc_id").join(weakest, "doc_id", "left").select("doc_id", ranked(TRUST, F.col("rank")).alias("trust"))


def latest_checks(checks: DataFrame) -> DataFrame:
    """Last check of each source version."""
    last = F.max(F.struct("at", "line", "drift")).alias("x")
    return checks.groupBy("uri", "version").agg(last).select("uri", "version", F.col("x.at").alias("at"), F.col("x.drift").alias("drift"))


def freshness_document(documents: DataFrame, citations: DataFrame, checks: DataFrame, now: Column) -> DataFrame:
    """No source: not_applicable; any source unchecked: unknown; past stale_after: stale; else fresh.

    ``oldest`` is the oldest check of the document's sources.
    """
    cited = citations.select("doc_id", "uri", "version").distinct()
    seen = cited.join(latest_checks(checks), ["uri", "version"], "left").groupBy("doc_id")
    seen = seen.agg(F.count("*").alias("sources"), F.count("at").alias("checked"), F.min("at").alias("oldest"))
    out = documents.select("doc_id", "stale_after").join(seen, "doc_id", "left")
    state = (
        F.when(F.col("sources").isNull(), "not_applicable").when(F.col("checked") < F.col("sources"), "unknown")
        .when(now >= F.col("stale_after"), "stale").otherwise("fresh")
    )
    return out.select("doc_id", state.alias("freshness"), F.when(F.col("checked") == F.col("sources"), F.col("oldest")).alias("oldest"))


def freshness_claim(citations: DataFrame, checks: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """The same per claim, from the claim's own sources and its document's date."""
    cited = citations.select("doc_id", "claim_id", "uri", "version").distinct()
    seen = cited.join(latest_checks(checks), ["uri", "version"], "left").groupBy("doc_id", "claim_id").agg(F.count("*").alias("sources"), F.count("at").alias("checked"))
    out = seen.join(documents.select("doc_id", "stale_after"), "doc_id", "left")
    state = F.when(F.col("checked") < F.col("sources"), "unknown").when(now >= F.col("stale_after"), "stale").otherwise("fresh")
    return out.select("claim_id", state.alias("freshness"))


def weakest_drift(citations: DataFrame, checks: DataFrame) -> DataFrame:
    """Per document: unsupported beats unchecked beats the first other verdict in path order."""
    cited = citations.select("doc_id", "uri", "version", "archive_path").distinct()
    rows = cited.join(latest_checks(checks), ["uri", "version"], "left")
    first = F.min(F.when(F.col("drift").isNotNull(), F.struct("archive_path", "drift"))).alias("first")
    out = rows.groupBy("doc_id").agg(F.max(F.col("drift") == "unsupported").alias("lost"), F.max(F.col("drift").isNull()).alias("open"), first)
    state = F.when(F.coalesce("lost", F.lit(False)), "unsupported").when(F.col("open"), "unchecked").otherwise(F.col("first.drift"))
    return out.select("doc_id", state.alias("drift"))


def durability_document(documents: DataFrame, citations: DataFrame, records: DataFrame) -> DataFrame:
    """Over distinct URIs: none: not-applicable; all durable: provable; none durable: unprovable; else partly."""
    durable = records.groupBy("uri").agg(F.max(F.col("disposition") != "referenced").alias("durable"))
    per = citations.select("doc_id", "uri").distinct().join(durable, "uri", "left").groupBy("doc_id")
    per = per.agg(F.count("*").alias("n"), F.count_if(F.coalesce("durable", F.lit(False))).alias("ok"))
    out = documents.select("doc_id").join(per, "doc_id", "left")
    state = F.when(F.col("n").isNull(), "not-applicable").when(F.col("ok") == F.col("n"), "provable").when(F.col("ok") == 0, "unprovable").otherwise("partly-provable")
    return out.select("doc_id", state.alias("durability"))


def weakness(durability: DataFrame, centrality: DataFrame, cut: int) -> DataFrame:
    """Unprovable documents: load-bearing at ``cut`` links in, else cited by a provable one, else peripheral."""
    rows = durability.where(F.col("durability") == "unprovable").join(centrality, "doc_id", "left")
    heavy = (F.lit(cut) > 0) & (F.coalesce("in_degree", F.lit(0)) >= cut)
    state = F.when(heavy, "load-bearing").when(F.coalesce("cited_by_provable", F.lit(False)), "cited-by-provable").otherwise("peripheral")
    return rows.select("doc_id", state.alias("weakness"))


def answerability(hits: DataFrame) -> DataFrame:
    """Per question ``(question, claim_id, contested, evidenced)``: silent, unresolved, unevidenced or ready."""
    per = hits.groupBy("question").agg(F.count("claim_id").alias("n"), F.max("contested").alias("c"), F.max("evidenced").alias("e"))
    state = F.when(F.col("n") == 0, "silent").when(F.coalesce("c", F.lit(False)), "unresolved").when(~F.coalesce("e", F.lit(False)), "unevidenced").otherwise("ready")
    return per.select("question", F.col("n").alias("retrieved"), state.alias("answerability"))


def current_record(records: DataFrame) -> DataFrame:
    """One record per URI: durable beats not durable, then the greatest version."""
    best = F.max(F.struct((F.col("disposition") != "referenced").alias("durable"), "version", "archive_path", "disposition")).alias("x")
    return records.groupBy("uri").agg(best).select("uri", "x.version", "x.archive_path", "x.disposition")


def archive_closure(records: DataFrame, archived: DataFrame) -> DataFrame:
    """Archived texts without a record (warning) and durable records without their text (error)."""
    said = records.select("archive_path", F.lit(True).alias("recorded"), (F.col("disposition") != "referenced").alias("kept"), F.lit(False).alias("held"))
    rows = said.unionByName(archived.select("archive_path", F.lit(False).alias("recorded"), F.lit(False).alias("kept"), F.lit(True).alias("held")))
    each = rows.groupBy("archive_path").agg(*[F.max(c).alias(c) for c in ("recorded", "kept", "held")])
    severity = F.when(F.col("held") & ~F.col("recorded"), "warning").when(F.col("kept") & ~F.col("held"), "error")
    return each.select("archive_path", severity.alias("severity")).where(F.col("severity").isNotNull())


def dangling_paths(citations: DataFrame, archived: DataFrame) -> DataFrame:
    """Per document, the cited paths that are not archived."""
    return citations.select("doc_id", "archive_path").distinct().join(archived, "archive_path", "left_anti").groupBy("doc_id").agg(F.count("*").alias("missing"), F.min("archive_path").alias("first_path"))


def cited_sources(citations: DataFrame) -> DataFrame:
    """Distinct sorted URIs of each claim."""
    return citations.groupBy("claim_id").agg(F.array_join(F.sort_array(F.collect_set("uri")), ",").alias("uris"))


def evidence_of(citations: DataFrame, records: DataFrame) -> DataFrame:
    """Best support per document and URI: archived over extracted over referenced."""
    support = F.when(F.col("disposition") == "archived", 2).when(F.col("disposition") == "extracted", 1).otherwise(0)
    best = citations.select("doc_id", "uri", "archive_path").distinct().join(records.select("archive_path", support.alias("s")), "archive_path", "left")
    return best.groupBy("doc_id", "uri").agg(F.coalesce(F.max("s"), F.lit(0)).alias("support"))


def checks_by_path(records: DataFrame, checks: DataFrame) -> DataFrame:
    """The last check of each archive path."""
    return records.join(latest_checks(checks), ["uri", "version"]).select("archive_path", "uri", "at", "drift")


def extraction_worklist(uris: DataFrame, records: DataFrame, done: DataFrame) -> DataFrame:
    """Wanted URIs with their current record; no record or no durable text is an error, done ones are flagged."""
    out = uris.join(current_record(records), "uri", "left").join(done.select("archive_path", F.lit(True).alias("cached")).distinct(), "archive_path", "left")
    problem = F.when(F.col("version").isNull(), "no-record").when(F.col("disposition") == "referenced", "no-text")
    return out.select("uri", "archive_path", problem.alias("problem"), F.coalesce("cached", F.lit(False)).alias("cached"))


def churn(records: DataFrame, checks: DataFrame) -> DataFrame:
    """URIs with at least two versions, and how their checks came out."""
    versions = records.select("uri", "version").distinct().join(latest_checks(checks), ["uri", "version"], "left")
    verdicts = [F.count_if(F.col("drift") == v).alias(v) for v in ("benign", "unsupported", "current")]
    return versions.groupBy("uri").agg(F.count("*").alias("versions"), *verdicts, F.count_if(F.col("drift").isNull()).alias("unchecked")).where(F.col("versions") >= 2)


def archive_budget(records: DataFrame, budget: int, fraction: float) -> DataFrame:
    """One row: total bytes, files, and whether the archive is over its budget or near it."""
    held = records.where(F.col("disposition") != "referenced").agg(F.count("*").alias("files"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"))
    level = F.when(F.col("bytes") > budget, "error").when(F.col("bytes") >= budget * fraction, "warning").otherwise("ok")
    return held.select("files", "bytes", level.alias("severity"))


def payload_size(text: Column) -> Column:
    """Length of the largest ``data:`` payload up to a delimiter; 0 for none."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(r"data:([^\s\"')>]*)"), F.lit(1)), F.char_length)
    return F.coalesce(F.array_max(sizes), F.lit(0))


def text_stats(sources: DataFrame) -> DataFrame:
    """``(doc_id, is_text, payload)`` of ``(doc_id, content)``: valid UTF-8 without a zero byte, and the largest payload."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    ok = F.is_valid_utf8(F.col("content").cast("string")) & (F.instr(text, "\0") == 0)
    return sources.select("doc_id", ok.alias("is_text"), payload_size(text).alias("payload"))


def disposition(sources: DataFrame, max_bytes: int, extensions: tuple[str, ...], flagged, max_payload: int = 8192, extracted_extension: str = ".txt") -> DataFrame:
    """Gate each source ``(source_id, extension, content, extracted)``: extension, size, binary, payload, scan, in that order.

    A source that fails is extracted if the text taken from it passes the same
    gates, else referenced for what was wrong with that text, or with the source
    if there is none.  ``flagged`` makes a text's scan verdict.
    """

    def reason(extension: Column, text: Column) -> Column:
        return (
            F.when(~extension.isin(*extensions), "extension").when(F.octet_length(text) > max_bytes, "size").when(F.instr(text, "\0") > 0, "binary")
            .when(payload_size(text) > max_payload, "payload").when(flagged(text), "scan")
        )

    rows = sources.withColumn("text", F.coalesce("content", F.lit("")))
    rows = rows.withColumns({"why": reason(F.col("extension"), F.col("text")), "why_not": F.when(F.col("extracted").isNotNull(), reason(F.lit(extracted_extension), F.col("extracted")))})
    whole, taken = F.col("why").isNull(), F.col("extracted").isNotNull() & F.col("why_not").isNull()

    def path(text: Column, extension: Column) -> Column:
        digest = F.sha2(text.cast("binary"), 256)
        return F.concat(F.lit("evidence/text/"), F.substring(digest, 1, 2), F.lit("/"), digest, extension)

    state = F.when(whole, "archived").when(taken, "extracted").otherwise("referenced")
    why = F.when(~whole & F.col("extracted").isNotNull(), F.col("why_not")).otherwise(F.col("why"))
    at = F.when(whole, path(F.col("text"), F.col("extension"))).when(taken, path(F.col("extracted"), F.lit(extracted_extension)))
    return rows.select("source_id", state.alias("disposition"), why.alias("reject_reason"), at.alias("archive_path"))
