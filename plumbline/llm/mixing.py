"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order.  A document's
virtual finish time is its source's words up to and including it, divided by the
source's target; a source whose target exceeds its size goes round again, with
times that continue.  All queues are range-sorted by finish time and the mix is
the front of that order, up to the total budget.

No queue is walked by one task: running sums are taken in buckets of the shuffle
hash (for a source) or of the range sort (for the mix) and put together from the
buckets' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch, column, fresh, without

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(keys: DataFrame, column: str, name: str) -> DataFrame:
    """Number the rows from 0 by ``column`` (nulls last), in ranges and not in one task."""
    parts = keys.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())) - 1
    out = parts.withColumn("_within", within).join(before, "_part")
    return out.withColumn(name, (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_part", "_n", "_before", "_within")


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in code point order, null last, have ``weights`` in turn and share the
    total of all sizes.  A target stops at ``most`` times its source's size; what
    is over is shared again by weight until no target is above its stop.  Each
    turn is one aggregation that gives the driver three numbers.
    """
    order = ranked(scratch.put(sizes, "source_sizes"), "source", "rank")
    order = scratch.put(order.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))), "sources")
    total = order.agg(F.sum("source_size")).first()[0] or 0
    stop = F.col("source_size") * most
    level = 0.0
    while True:
        over = stop < F.col("weight") * level if level else F.lit(False)
        capped, open_weight = order.agg(F.sum(F.when(over, stop).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        if not open_weight:
            break
        new = (total - capped) / open_weight
        if new <= level:
            break
        level = new
    target = F.least(stop.cast("double"), F.col("weight") * F.lit(float(level)))
    return order.select("source", "source_size", target.alias("target"))


def finish_times(docs: DataFrame, targets: DataFrame, scratch: Scratch, rows_per_bucket: int) -> DataFrame:
    """``docs`` with ``upto``, their source's words up to each in shuffled order, and targets.

    Buckets are equal ranges of the shuffle hash; their number follows the number
    of rows, so a bucket of the largest source holds about ``rows_per_bucket``.
    """
    n = docs.count()
    buckets = max(1, -(-n // rows_per_bucket))
    docs = docs.withColumn("bucket", F.floor((F.shiftrightunsigned("shuffle", 1) / F.lit(2.0**63)) * buckets).cast("long"))
    docs = docs.withColumn("bucket", F.least("bucket", F.lit(buckets - 1)))
    same = F.col("source").eqNullSafe(F.col("_source"))
    totals = docs.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)))
    totals = scratch.put(totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce("before", F.lit(0)).alias("before")), "bucket_totals")
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    docs = docs.withColumn("inside", inside).join(totals, same & (F.col("bucket") == F.col("_bucket")))
    docs = docs.withColumn("upto", F.col("inside") + F.col("before")).drop("_source", "_bucket", "bucket", "inside", "before")
    wanted = targets.select(F.col("source").alias("_source"), "source_size", "target")
    return docs.join(wanted, same).drop("_source")


def _cut(docs: DataFrame, most: int, budget: int, scratch: Scratch) -> tuple[float, int] | None:
    """Finish time and shuffle hash of the last document that fits the budget."""
    entries = docs.where(F.col("size") > 0).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    entries = entries.select(_time(F.col("turn")).alias("time"), "shuffle", "size")
    parts = scratch.put(entries.repartitionByRange("time", "shuffle").withColumn("part", F.spark_partition_id()), "queue")
    totals = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.sum("size").alias("n")).collect())
    taken = 0
    for part, n in totals:
        if taken + n > budget:
            break
        taken += n
    upto = F.sum("size").over(W.partitionBy("part").orderBy("time", "shuffle").rowsBetween(W.unboundedPreceding, 0))
    inside = parts.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") <= budget - taken)
    last = inside.agg(F.max(F.struct("time", "shuffle")).alias("x")).first()["x"]
    if last is None:
        last = parts.where(F.col("part") < part).agg(F.max(F.struct("time", "shuffle")).alias("x")).first()["x"]
    return None if last is None else (last["time"], last["shuffle"])


def _time(turn: Column) -> Column:
    """Virtual finish time of a document's ``turn``-th copy."""
    return F.try_divide((turn * F.col("source_size") + F.col("upto")).cast("double"), F.col("target"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: int = 7, rows_per_bucket: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all) plus ``size, source_size, target, copies, taken``.

    ``copies`` (0 to ``most``) says how often the mix takes the row and ``taken``
    is its words times that.  The shuffled order is a hash of doc_id and text
    size, so reruns agree.  Rows without words are never taken.  A null source is
    a source of its own; rows with equal ids are separate documents and those
    that are equal in every used column are taken together.  Columns named like
    the added ones are replaced.  Very long texts are one document with all their
    words.  An empty table gives an empty result.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "mixing")
    added = ["size", "source_size", "target", "copies", "taken"]
    kept = without(documents.columns if keep is None else keep, added)
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", text_hash.alias("version"), word_count(F.col("text")).alias("size"))
    sized = scratch.put(sized.withColumn("shuffle", F.xxhash64(F.lit(seed), "doc_id", "version")), "sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch, weights, most)
    timed = scratch.put(finish_times(sized, scratch.put(targets, "targets"), scratch, rows_per_bucket), "times")
    budget = timed.agg(F.sum("size")).first()[0] or 0
    last = _cut(timed, most, budget, scratch) if budget else None
    copies = F.lit(0)
    if last:
        time, shuffle = last
        for turn in range(most):
            at = _time(F.lit(turn))
            copies = copies + F.when((F.col("size") > 0) & ((at < time) | ((at == time) & (F.col("shuffle") <= shuffle))), 1).otherwise(0)
    taken = timed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    if kept == ["doc_id"]:
        return taken.select("doc_id", *added)
    doc, version, origin = fresh([*documents.columns, *added], "doc", "version", "origin")
    chosen = taken.select(F.col("doc_id").alias(doc), F.col("version").alias(version), F.col("source").alias(origin), *added).dropDuplicates([doc, version, origin])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (text_hash == F.col(version)) & F.col("source").eqNullSafe(F.col(origin))
    needed = list(dict.fromkeys([*kept, "doc_id", "text", "source"]))
    return documents.select(*map(column, needed)).join(chosen, same).select(*map(column, [*kept, *added]))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")
