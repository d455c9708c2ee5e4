"""Contradictions, duplicates and populations of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import fold, fold_lower, fold_once


def _low() -> Column:
    return F.when(F.col("op") == "<=", F.lit(float("-inf"))).otherwise(F.col("value"))


def _high() -> Column:
    return F.when(F.col("op") == ">=", F.lit(float("inf"))).otherwise(F.col("value"))


def contradicted(bounds: DataFrame) -> DataFrame:
    """``(subject, dimension)`` whose closed ranges have no common point: the greatest low is above the least high."""
    out = bounds.groupBy("subject", "dimension").agg(F.max(_low()).alias("low"), F.min(_high()).alias("high"))
    return out.where("low > high").select("subject", "dimension")


def _dealt(ends: DataFrame, keys: list[str], per_range: int) -> DataFrame:
    """``ends (keys, claim_id, at, side)`` plus ``range``: each key's ends in order, ``per_range`` to a range, equal ends together.

    Keys of no more ends than that are one range, and nothing of theirs is sorted
    or joined.  For the others counts per distinct end come first, so ends that
    many claims share are one row of the running sum.
    """
    large = ends.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > per_range).select(*keys)
    counts = ends.join(large, keys, "left_semi").groupBy(*keys, "at").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.withColumn("range", F.floor(before / per_range).cast("long")).select(*keys, "at", "range")
    return ends.join(ranges, [*keys, "at"], "left").na.fill(0, ["range"])


def _per_claim(rows: DataFrame) -> DataFrame:
    """One row per claim of a subject: its greatest low, its least high and, if it has several bounds, all of them."""
    bound = F.struct(F.when(F.col("op") != "<=", F.col("value")).alias("low"), F.when(F.col("op") != ">=", F.col("value")).alias("high"))
    order = W.partitionBy("subject", "dimension", "claim_id").orderBy("value")
    each = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("bound", bound)
    found = rows.select(
        "subject", "dimension", "claim_id", F.row_number().over(order).alias("nth"), F.count("*").over(each).alias("n"),
        F.max("bound.low").over(each).alias("low"), F.min("bound.high").over(each).alias("high"), F.collect_list("bound").over(each).alias("bounds"),
    )
    return found.where("nth = 1").select("subject", "dimension", "claim_id", "low", "high", F.when(F.col("n") > 1, F.col("bounds")).alias("bounds"))


def _named(claims: DataFrame, side: str) -> DataFrame:
    return claims.select("subject", "dimension", *(F.col(c).alias(f"{c}_{side}") for c in claims.columns if c not in ("subject", "dimension", "range")), *(["range"] if "range" in claims.columns else []))


def _times(a: str, b: str) -> Column:
    """How many pairs of a bound of claim ``a`` and one of ``b`` don't meet; one, if both have a single bound."""
    mine, theirs = (F.coalesce(f"bounds_{x}", F.array(F.struct(F.col(f"low_{x}").alias("low"), F.col(f"high_{x}").alias("high")))) for x in (a, b))
    clashes = F.flatten(F.transform(mine, lambda m: F.filter(theirs, lambda t: (m["low"] > t["high"]) | (t["low"] > m["high"]))))
    return F.when(F.col(f"bounds_{a}").isNull() & F.col(f"bounds_{b}").isNull(), F.lit(1)).otherwise(F.size(clashes)).cast("long")


def _pairs_of_small(claims: DataFrame) -> DataFrame:
    """The pairs of subjects of few claims, which lie together: each two are compared, where the subject has a contradiction at all."""
    keys = ["subject", "dimension"]
    torn = claims.withColumns({"top": F.max("low").over(W.partitionBy(*keys)), "bottom": F.min("high").over(W.partitionBy(*keys))}).where("top > bottom").drop("top", "bottom")
    pairs = _named(torn, "a").join(_named(torn, "b"), keys).where((F.col("claim_id_a") < F.col("claim_id_b")) & ((F.col("low_a") > F.col("high_b")) | (F.col("low_b") > F.col("high_a"))))
    return pairs.select(*keys, F.col("claim_id_a").alias("first"), F.col("claim_id_b").alias("second"), _times("a", "b").alias("times"))


def _pairs_of_large(claims: DataFrame, per_range: int) -> DataFrame:
    """The pairs of subjects of any size, by ranges of their ends.

    A low end is above all high ends of lower ranges, so it goes to each of those
    that has any, where nothing is compared, and ends are compared only inside
    their own range: a subject is many independent pieces, and next to no pair is
    formed that isn't a row.  Two claims of several bounds can meet both ways; such
    a pair is kept one way.
    """
    keys = ["subject", "dimension"]
    torn = claims.groupBy(*keys).agg(F.max("low").alias("top"), F.min("high").alias("bottom")).where("top > bottom").select(*keys)
    claims = claims.join(F.broadcast(torn), keys, "left_semi")
    above = claims.where("low IS NOT NULL").withColumns({"at": F.col("low"), "side": F.lit("low")})
    below = claims.where("high IS NOT NULL").withColumns({"at": F.col("high"), "side": F.lit("high")})
    ends = _dealt(above.unionByName(below), keys, per_range)
    lows = _named(ends.where("side = 'low'").drop("at", "side"), "a").withColumnRenamed("range", "mine")
    highs = _named(ends.where("side = 'high'").drop("at", "side"), "b")
    above_others = lows.where("mine > 0")
    held = highs.join(above_others.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.sort_array(F.collect_set("range")).alias("ranges"))
    lower = above_others.join(held, keys).withColumn("range", F.explode(F.filter("ranges", lambda r: r < F.col("mine"))))
    far = lower.join(highs, [*keys, "range"])
    near = lows.withColumnRenamed("mine", "range").join(highs, [*keys, "range"]).where(F.col("low_a") > F.col("high_b"))
    both_ways = F.coalesce(F.col("low_b") > F.col("high_a"), F.lit(False))
    pairs = far.select(near.columns).unionByName(near).where((F.col("claim_id_a") < F.col("claim_id_b")) | ((F.col("claim_id_a") > F.col("claim_id_b")) & ~both_ways))
    return pairs.select(*keys, F.least("claim_id_a", "claim_id_b").alias("first"), F.greatest("claim_id_a", "claim_id_b").alias("second"), _times("a", "b").alias("times"))


def interval_conflicts(bounds: DataFrame, per_range: int = 4096) -> DataFrame:
    """All pairs ``(subject, dimension, first, second, times)`` of claims with closed ranges that don't meet, and how many of their bounds don't.

    Such a pair is a low end above a high end of the same subject.  A claim is one
    row, so each pair is formed once and none is grouped.  Subjects of at most
    ``per_range`` bounds are moved once and joined where they lie; the larger ones,
    at most one in ``per_range`` rows, are known beforehand and cut into ranges.
    """
    keys = ["subject", "dimension"]
    known = bounds.where("value IS NOT NULL").select(*keys, "claim_id", "op", "value")
    parts = known.select(*keys, (F.spark_partition_id() % 16).alias("part")).repartition(*keys, "part")  # else each task would hold a count of nearly all subjects
    large = F.broadcast(parts.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > per_range).select(*keys))
    hot = known.join(large, keys, "left_semi")
    small = known.join(large, keys, "left_anti").repartition(*keys)
    return _pairs_of_small(_per_claim(small)).unionByName(_pairs_of_large(_per_claim(hot), per_range))


def conflict_counts(bounds: DataFrame) -> DataFrame:
    """``(subject, dimension, claims, pairs)`` of contradicted subjects: how many claims and how many disjoint pairs, none of which is formed.

    The pairs of a low end are the high ends below it: a running count over the
    distinct ends.
    """
    keys = ["subject", "dimension"]
    known = bounds.where("value IS NOT NULL")
    rows = known.join(contradicted(known), keys, "left_semi")
    at = rows.groupBy(*keys, F.col("value").alias("at")).agg(F.count_if(F.col("op") != "<=").alias("lows"), F.count_if(F.col("op") != ">=").alias("highs"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("highs").over(W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return at.withColumn("pairs", F.col("lows") * before).groupBy(*keys).agg(F.sum("n").alias("claims"), F.sum("pairs").alias("pairs"))


def subject_gaps(claims: DataFrame, declared: DataFrame) -> DataFrame:
    """One row: claims ``(key)`` of no declared subject, and declared subjects ``(key)`` without a claim."""
    unresolved = claims.join(declared, "key", "left_anti").agg(F.count("*").alias("unresolved"))
    undeclared = declared.distinct().join(claims, "key", "left_anti").agg(F.count("*").alias("undeclared"))
    return unresolved.join(F.broadcast(undeclared))


def pair_id(a: Column, b: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the sorted refs joined by a zero byte."""
    return F.substring(F.sha2(F.concat_ws("\0", F.least(a, b), F.greatest(a, b)).cast("binary"), 256), 1, 16)


def unseparated_pairs(claims: DataFrame) -> DataFrame:
    """Pairs of claims ``(claim_id, subject, parsed)`` of one subject that no two parsed bounds separate.

    The pairs are the result itself.  Only pairs with an unparsed side are
    formed: unparsed ones with each other, and unparsed with parsed.  A claim of
    several bounds is one row that says which it has, so each pair is formed once
    and none has to be remembered.  A ``source`` of the claims, equal for all rows
    of one, comes along as ``first_source`` and ``second_source``.
    """
    own = ["source"] if "source" in claims.columns else []
    each = claims.groupBy("subject", "claim_id", *own).agg(F.coalesce(F.max(~F.col("parsed")), F.lit(False)).alias("open"), F.coalesce(F.max("parsed"), F.lit(False)).alias("shut"))
    open_ = each.where("open").select("subject", F.col("claim_id").alias("a"), *[F.col(x).alias(f"a_{x}") for x in own])
    any_ = each.select("subject", F.col("claim_id").alias("b"), *[F.col(x).alias(f"b_{x}") for x in own], "open", "shut")
    pairs = open_.join(any_, "subject").where((F.col("a") < F.col("b")) | ((F.col("a") > F.col("b")) & F.col("shut") & ~F.col("open")))
    sides = [F.when(F.col("a") < F.col("b"), F.col(f"{x}_{s}")).otherwise(F.col(f"{y}_{s}")).alias(f"{n}_{s}") for s in own for n, x, y in (("first", "a", "b"), ("second", "b", "a"))]
    pairs = pairs.select("subject", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("second"), *sides)
    return pairs.withColumn("pair_id", pair_id(F.col("first"), F.col("second")))


def unseparated_counts(claims: DataFrame) -> DataFrame:
    """``(subject, claims, unparsed, pairs)`` of subjects with unseparated pairs, by counting: none is formed.

    A claim of several bounds is unparsed if one of them is.  Every pair with an
    unparsed side counts; ``unseparated_pairs`` names them where someone asks.
    """
    each = claims.groupBy("subject", "claim_id").agg(F.min("parsed").alias("parsed"))
    out = each.groupBy("subject").agg(F.count("*").alias("claims"), F.count_if(~F.col("parsed")).alias("unparsed"))
    n, u = F.col("claims"), F.col("unparsed")
    return out.withColumn("pairs", ((u * (u - 1)) / 2 + u * (n - u)).cast("long")).where("pairs > 0")


def constraint_coverage(bounds: DataFrame) -> DataFrame:
    """Subjects with a claim whose bound can't be read, and how many can."""
    out = bounds.groupBy("subject").agg(F.count_if(F.col("value").isNotNull()).alias("parsed"), F.count_if(F.col("value").isNull()).alias("unparsed"))
    return out.where(F.col("unparsed") > 0)


def dimension_drift(bounds: DataFrame, declared: DataFrame) -> DataFrame:
    """Subjects with claims in another dimension than the declared one, by dimension."""
    rows = bounds.join(declared.withColumnRenamed("dimension", "declared"), "subject").where(F.col("dimension") != F.col("declared"))
    return rows.groupBy("subject", "declared", "dimension").agg(F.count("*").alias("claims"))


def duplicate_titles(documents: DataFrame) -> DataFrame:
    out = documents.groupBy(fold_lower(F.col("title")).alias("title")).agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return out.where(F.col("documents") >= 2)


def duplicate_evidence(quotes: DataFrame) -> DataFrame:
    """Sets of folded quotes ``(doc_id, quote)`` that two or more documents share exactly, named by their digest."""
    folded = quotes.select("doc_id", fold_once(F.col("quote")).alias("quote")).where("quote <> ''")
    sets = folded.groupBy("doc_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_set("quote")), "\0").cast("binary"), 256).alias("evidence"))
    return sets.groupBy("evidence").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc")).where(F.col("documents") >= 2)


def anchor_collision(claims: DataFrame) -> DataFrame:
    """Folded anchors that two or more claims ``(doc_id, claim_id, anchor)`` of a document share."""
    out = claims.groupBy("doc_id", fold_once(F.col("anchor")).alias("anchor")).agg(F.count("*").alias("claims"), F.array_join(F.sort_array(F.collect_list("claim_id")), ",").alias("ids"))
    return out.where("claims >= 2")


def evidence_divergence(claims: DataFrame) -> DataFrame:
    """``(anchor, uri, versions, documents, shown)``: one folded anchor and source of claims ``(doc_id, anchor, uri, version)`` on two or more versions.

    ``shown`` lists each version, its first twelve signs, with how many documents rest on it.
    """
    per = claims.select(fold(F.col("anchor")).alias("anchor"), "uri", "version", "doc_id").where("anchor <> ''").groupBy("anchor", "uri", "version").agg(F.count_distinct("doc_id").alias("n"), F.collect_set("doc_id").alias("docs"))
    out = per.groupBy("anchor", "uri").agg(F.count("*").alias("versions"), F.size(F.array_distinct(F.flatten(F.collect_list("docs")))).cast("long").alias("documents"), F.sort_array(F.collect_list(F.struct("version", "n"))).alias("x"))
    shown = F.array_join(F.transform("x", lambda v: F.concat(F.substring(v["version"], 1, 12), F.lit(" in "), v["n"].cast("string"))), "; ")
    return out.where("versions >= 2").select("anchor", "uri", "versions", "documents", shown.alias("shown"))


def subject_population(citations: DataFrame) -> DataFrame:
    """Per subject: claims, documents, and whether two documents rest on disjoint evidence.

    Two documents are disjoint iff no archive path is common to both.  A path that
    all documents hold rules it out and a document whose paths no other holds
    proves it.  In subjects that neither decides, each path keeps a bitmap of the
    documents that hold it; the union of a document's paths' bitmaps is what it
    isn't disjoint with, and two documents are disjoint iff a union doesn't cover
    all.  No document meets another.
    """
    base = citations.groupBy("uri").agg(F.count_distinct("claim_id").alias("claims"), F.count_distinct("doc_id").alias("documents"))
    held = citations.select("uri", "doc_id", "archive_path").distinct()
    per_path = held.groupBy("uri", "archive_path").agg(F.count("*").alias("n"))
    spread = per_path.groupBy("uri").agg(F.max("n").alias("most"))
    alone = held.join(per_path, ["uri", "archive_path"]).groupBy("uri", "doc_id").agg(F.max("n").alias("most_shared")).groupBy("uri").agg(F.min("most_shared").alias("least"))
    out = base.join(spread, "uri").join(alone, "uri")
    easy = F.when(F.col("documents") < 2, False).when(F.col("most") == F.col("documents"), False).when(F.col("least") == 1, True)
    out = out.withColumn("easy", easy)
    covered = cover_test(held.join(out.where(F.col("easy").isNull()).select("uri"), "uri", "left_semi"))
    out = out.join(covered, "uri", "left")
    return out.select("uri", "claims", "documents", F.coalesce("easy", "apart", F.lit(False)).alias("disjoint"))


def cover_test(held: DataFrame) -> DataFrame:
    """``(uri, apart)``: whether two documents of ``held (uri, doc_id, archive_path)`` share no path, by bitmaps.

    Documents with the same paths count as one and are numbered per subject.
    """
    sets = held.groupBy("uri", "doc_id").agg(F.sort_array(F.collect_set("archive_path")).alias("paths")).select("uri", "paths").distinct()
    numbered = sets.withColumn("number", (F.row_number().over(W.partitionBy("uri").orderBy("paths")) - 1).cast("long"))
    kinds = numbered.groupBy("uri").agg(F.count("*").alias("kinds"))
    each = numbered.select("uri", "number", F.explode("paths").alias("path"))
    part = F.bitmap_bucket_number("number").alias("part")
    bits = each.groupBy("uri", "path", part).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    reached = each.join(bits, ["uri", "path"]).groupBy("uri", "number", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    least = reached.groupBy("uri", "number").agg(F.sum(F.bitmap_count("bits")).alias("n")).groupBy("uri").agg(F.min("n").alias("least"))
    return least.join(kinds, "uri").select("uri", (F.col("least") < F.col("kinds")).alias("apart"))


def type_usage(documents: DataFrame, types: DataFrame) -> DataFrame:
    """Types used but not declared, declared but unused, or deprecated and used; types are ``(type, deprecated)``."""
    used = documents.groupBy("type").agg(F.count("*").alias("documents"))
    out = used.join(types, "type", "full_outer")
    problem = F.when(F.col("deprecated").isNull(), "undeclared").when(F.col("documents").isNull() & ~F.col("deprecated"), "unused").when(F.col("deprecated") & F.col("documents").isNotNull(), "deprecated")
    return out.select("type", F.coalesce("documents", F.lit(0)).alias("documents"), problem.alias("problem")).where(F.col("problem").isNotNull())


def alias_resolve(surfaces: DataFrame, aliases: DataFrame) -> DataFrame:
    """Surfaces ``(claim_id, surface)`` with the key of their folded alias, null if unknown.

    An alias that two keys claim is refused, as it would be when loading the table.
    """
    folded = aliases.select(fold_lower(F.col("alias")).alias("folded"), "key")
    clash = folded.groupBy("folded").agg(F.count_distinct("key").alias("n")).where(F.col("n") > 1)
    if clash.limit(1).count():
        raise ValueError("an alias belongs to two keys")
    return surfaces.withColumn("folded", fold_lower(F.col("surface"))).join(folded.distinct(), "folded", "left").select("claim_id", "surface", "key")
