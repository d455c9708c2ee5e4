"""Rationales that say nothing of their own: they repeat what was asked, or an earlier decision word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import fold_lower, words

#: A phrase of fewer words proves nothing.
LEAST_WORDS = 6


def inner_grams(folded: Column, k: int) -> Column:
    """Distinct runs of ``k`` words that leave out the first and the last word, hashed.

    Inside a text, a phrase's first and last word may be parts of longer ones; the
    words between stand between blanks in both.
    """
    w = words(folded)
    starts = F.when(F.size(w) >= k + 2, F.sequence(F.lit(2), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(k)), " "))))


def grams(folded: Column, k: int) -> Column:
    """Distinct runs of ``k`` words of a text, hashed."""
    w = words(folded)
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(k)), " "))))


def contained_phrases(texts: DataFrame, phrases: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(folded, rank, phrase)``: the phrases ``(rank, phrase)`` that stand in the texts ``(folded)``.

    Texts and phrases meet on hashes of ``least_words - 2`` words in a row: each
    phrase on the one that fewest texts have, and what meets is then compared
    letter by letter.  Phrases of fewer words than ``least_words`` are passed over.
    Texts should be distinct.
    """
    k = least_words - 2
    asked = phrases.select("rank", "phrase", fold_lower(F.col("phrase")).alias("sought")).where(F.size(words(F.col("sought"))) >= least_words)
    keys = asked.select("rank", F.explode(inner_grams(F.col("sought"), k)).alias("gram"))
    held = texts.select("folded", F.explode(grams(F.col("folded"), k)).alias("gram")).join(keys.select("gram").distinct(), "gram", "left_semi")
    common = held.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(common, "gram", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("x")).where("x.n > 0")
    found = held.join(rarest.select("rank", "x.gram"), "gram").join(asked, "rank")
    return found.where(F.contains("folded", F.col("sought"))).select("folded", "rank", "phrase")


def unusable_rationales(rationales: DataFrame, asked: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``(line, reason, match)`` of the rationales ``(line, label, rationale)`` that can't be used, in the order of the lines.

    ``template``: it holds one of the phrases ``asked (rank, phrase)``, the first of
    them by rank is the match; else ``prior``: an earlier line says the same, the
    match is the label of the first.  Both compare folded texts in lower case.
    Blank rationales are not looked at.  Equal texts are searched once.
    """
    rows = rationales.withColumn("folded", fold_lower(F.coalesce("rationale", F.lit("")))).where("folded <> ''")
    texts = rows.groupBy("folded").agg(F.min(F.struct("line", "label")).alias("earliest"))
    template = contained_phrases(texts.select("folded"), asked, least_words).groupBy("folded").agg(F.min(F.struct("rank", "phrase"))["phrase"].alias("template"))
    known = texts.join(template, "folded", "left")
    judged = rows.join(known, "folded")
    prior = F.when(F.col("line") > F.col("earliest.line"), F.col("earliest.label"))
    reason = F.when(F.col("template").isNotNull(), "template").when(prior.isNotNull(), "prior")
    return judged.select("line", reason.alias("reason"), F.coalesce("template", prior).alias("match")).where("reason IS NOT NULL")
