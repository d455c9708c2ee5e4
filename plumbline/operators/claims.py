"""Checks on single claims and on what replies and reviews say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import ASSOCIATION, CONCLUSION, HEDGED, INTERVENTION, LANGUAGE, REASON, UNIVERSAL
from plumbline.functions.markers import any_of, consume, described, line_of
from plumbline.functions.text import fold, fold_lower, fold_once, let, states_value
from plumbline.operators.conflict import unseparated_pairs


def _either(c: Column, first: tuple[str, ...], second: tuple[str, ...], verdict) -> Column:
    """``verdict`` of whether a text has a word of each list; the text is folded once."""

    return let(line_of(c), lambda line: verdict(any_of(line, first), any_of(line, second)))


def strength(c: Column, universal=UNIVERSAL, hedged=HEDGED) -> Column:
    """``universal``, ``hedged``, ``both`` or null by the markers in a text."""
    return _either(c, universal, hedged, lambda u, h: F.when(u & h, "both").when(u, "universal").when(h, "hedged"))


def causal_rung(c: Column, intervention=INTERVENTION, association=ASSOCIATION) -> Column:
    """Intervention before association; null if a text states neither."""
    return _either(c, intervention, association, lambda i, a: F.when(i, "intervention").when(a, "association"))


def over_asserted(claims: DataFrame, universal=UNIVERSAL, hedged=HEDGED) -> DataFrame:
    """Claims ``(claim_id, text, quotes)`` with a universal word, no hedge and exactly one quote."""
    return claims.where((F.size("quotes") == 1) & (strength(F.col("text"), universal, hedged) == "universal")).select("claim_id")


def over_claimed(claims: DataFrame, intervention=INTERVENTION, association=ASSOCIATION) -> DataFrame:
    """Causal claims whose quotes state associations only, and at least one."""
    rung = lambda q: causal_rung(q, intervention, association)
    causal = (F.size("quotes") > 0) & let(line_of(F.col("text")), lambda line: any_of(line, intervention))
    stated = let(F.filter(F.transform("quotes", rung), lambda r: r.isNotNull()), lambda rungs: (F.size(rungs) > 0) & ~F.array_contains(rungs, "intervention"))
    return claims.where(causal & stated).select("claim_id")  # quotes are looked at in causal claims alone


def marked_language(documents: DataFrame, markers: tuple[tuple[str, str], ...] = LANGUAGE) -> DataFrame:
    """Documents ``(doc_id, body)`` with marked phrases: ``(doc_id, n, message)``, each phrase with its role, by phrase.

    A phrase inside a longer marked one that was found doesn't count there.
    """
    found = documents.select("doc_id", F.explode(F.array(consume(F.col("body"), markers))).alias("found")).where(F.size("found") > 0)  # a row of its own, or the filter would look for them once more
    return found.select("doc_id", F.size("found").alias("n"), described(F.col("found")).alias("message"))


def buried_leads(claims: DataFrame, reasons: tuple[str, ...] = REASON, conclusions: tuple[str, ...] = CONCLUSION) -> DataFrame:
    """Claims that open with a reason word, or state a conclusion word later on."""

    def judged(line: Column) -> Column:
        opens = F.lit(False)
        for word in reasons:
            opens = opens | line.startswith(word + " ")
        later = F.lit(False)
        for word in conclusions:
            later = later | F.contains(line, F.lit(f" {word} "))
        return F.when(opens, "opens-with-reason").when(later, "conclusion-later")

    problem = let(F.concat(F.regexp_replace(fold_lower(F.col("text")), "[,.]", " "), F.lit(" ")), judged)
    return claims.select("claim_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def absent_anchors(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims ``(claim_id, doc_id, anchor)`` whose folded anchor isn't in the folded body; a body is folded once for all its claims."""
    anchors = claims.select("doc_id", "claim_id", fold_once(F.col("anchor")).alias("_anchor"))
    rows = anchors.join(documents.select("doc_id", fold_once(F.col("body")).alias("_body")), "doc_id")
    return rows.where(~F.contains("_body", F.col("_anchor"))).select("claim_id", "doc_id")


def lost_quotes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row per quote ``(uri, quote)`` that a changed upstream text no longer holds."""
    rows = old.join(new, "uri").where((F.col("old_sha") != F.col("new_sha")) & F.col("text").isNotNull())
    rows = rows.select("uri", F.col("text"), F.posexplode("quotes").alias("pos", "quote"))
    return rows.where(~F.contains(fold(F.col("text")), fold(F.col("quote")))).select("uri", "pos", "quote")


def aged_challenges(challenges: DataFrame, now: Column, days: int) -> DataFrame:
    """Open challenges ``(challenge_id, state, opened)`` older than ``days``; a blank state is open, a bad date a finding."""
    opened = F.try_to_timestamp("opened")
    is_open = F.coalesce(F.trim("state"), F.lit("")).isin("", "open")
    age = F.datediff(now, opened)
    problem = F.when(opened.isNull(), "unreadable-date").when(age > days, "aged")
    return challenges.where(is_open).select("challenge_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def schema_versions(documents: DataFrame, current: int) -> DataFrame:
    """Documents with no or an older version, if any document has one."""
    used = documents.agg((F.count("schema_version") > 0).alias("used"))
    rows = documents.join(F.broadcast(used)).where(F.col("used"))
    return rows.where(F.col("schema_version").isNull() | (F.col("schema_version") < current)).select("doc_id", "schema_version")


def pinned_values(claims: DataFrame) -> DataFrame:
    """Claims ``(claim_id, text, value)`` whose text doesn't state the pinned value by itself."""
    return claims.where(~states_value(F.col("text"), F.col("value"))).select("claim_id", "value")


def cite_check(replies: DataFrame) -> DataFrame:
    """Replies ``(reply_id, title, answered, cites, offered)``: the first thing wrong, or null.

    Cites must be among those offered; an answer needs a title and a cite.
    """
    problem = (
        F.when(F.size(F.array_except("cites", "offered")) > 0, "unknown-cite").when(F.col("answered") & (F.coalesce(F.trim("title"), F.lit("")) == ""), "no-title")
        .when(F.col("answered") & (F.size("cites") == 0), "no-cite")
    )
    return replies.select("reply_id", problem.alias("problem"))


def resolve_refs(refs: DataFrame, claims: DataFrame) -> DataFrame:
    """References ``(ref)`` of the form ``doc#claim`` with their claim, null if there is none."""
    parts = refs.withColumn("doc_id", F.split_part("ref", F.lit("#"), F.lit(1))).withColumn("claim_no", F.split_part("ref", F.lit("#"), F.lit(2)))
    known = claims.select(F.col("claim_id").alias("_id"), "lead")
    out = parts.join(known, F.concat_ws("#", "doc_id", "claim_no") == F.col("_id"), "left")
    return out.select("ref", F.col("_id").alias("claim_id"), F.col("_id").isNull().alias("missing"))


def stale_edges(edges: DataFrame, documents: DataFrame, claims: DataFrame) -> DataFrame:
    """Deferred conflicts ``(doc_id, concept, first, second)`` that are incomplete, of an unknown concept, or of no live pair.

    A pair is live if its two claims ``(claim_id, subject, parsed)`` share a
    subject and not both have a bound there; only the named claims are looked up.
    """
    known = documents.select(F.col("doc_id").alias("concept"), F.lit(True).alias("known")).distinct()
    ends = [claims.select(F.col("claim_id").alias(c), "subject", F.col("parsed").alias(f"{c}_parsed")).distinct() for c in ("first", "second")]
    named = edges.select("first", "second").distinct()
    live = named.join(ends[0], "first").join(ends[1], ["second", "subject"]).where(~(F.col("first_parsed") & F.col("second_parsed")))
    live = live.select("first", "second", F.lit(True).alias("live")).distinct()
    rows = edges.join(known, "concept", "left").join(live, ["first", "second"], "left")
    lacking = F.col("concept").isNull() | F.col("first").isNull() | F.col("second").isNull()
    problem = F.when(lacking, "incomplete").when(F.col("known").isNull(), "unknown-concept").when(F.col("live").isNull(), "no-live-pair")
    return rows.select("doc_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def pair_inputs(claims: DataFrame, citations: DataFrame, records: DataFrame) -> DataFrame:
    """Unseparated pairs of claims ``(claim_id, subject, parsed)`` with the first archived source of each side; ``skipped`` if a side has none.

    Claims get their sources before they are paired: a pair is the result as it is
    formed, and none is moved.
    """
    held = citations.join(records.where(F.col("disposition") != "referenced").select("archive_path"), "archive_path", "left_semi")
    source = held.groupBy("claim_id").agg(F.min("archive_path").alias("source"))
    pairs = unseparated_pairs(claims.join(source, "claim_id", "left"))
    return pairs.select("pair_id", "first_source", "second_source", (F.col("first_source").isNull() | F.col("second_source").isNull()).alias("skipped"))
