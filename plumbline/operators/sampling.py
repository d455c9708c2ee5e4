"""Reproducible samples and set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_hash(seed: int, item: Column) -> Column:
    """SHA-256 of the seed's eight big-endian bytes followed by the item."""
    return F.sha2(F.concat(F.unhex(F.lit(f"{seed & (2**64 - 1):016x}")), item.cast("binary")), 256)


def hash_sample(population: DataFrame, item: str, n: int, seed: int = 20260822) -> DataFrame:
    """The ``n`` rows with the smallest hashes, ties by item; other rows coming or going change nothing else."""
    return population.withColumn("draw", sample_hash(seed, F.col(item))).orderBy("draw", item).limit(n)


def rewrite_diff(before: DataFrame, after: DataFrame, supported: DataFrame) -> DataFrame:
    """Quotes ``(doc_id, quote)`` dropped by a rewrite and quotes of the rewrite that nothing supports."""
    dropped = before.select("doc_id", "quote").distinct().join(after, ["doc_id", "quote"], "left_anti").withColumn("problem", F.lit("dropped"))
    unproved = after.select("doc_id", "quote").distinct().join(supported, "quote", "left_anti").withColumn("problem", F.lit("unvalidated"))
    return dropped.unionByName(unproved)


def accrete(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New quotes ``(anchor, quote)`` of anchors that exist; ``matched`` is false for unknown anchors."""
    new = incoming.distinct().join(existing.select("anchor", "quote"), ["anchor", "quote"], "left_anti")
    known = existing.select("anchor").distinct().withColumn("known", F.lit(True))
    return new.join(known, "anchor", "left").select("anchor", "quote", F.coalesce("known", F.lit(False)).alias("matched"))


def table_digest(df: DataFrame) -> DataFrame:
    """One row ``(n, digest)`` for a table, whatever its row order; null differs from any text.

    Row hashes are summed, so tasks add up their own and one number moves per task.
    """
    cells = [F.concat(F.lit("\x01"), F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))) for c in df.columns]
    row = F.conv(F.substring(F.sha2(F.concat(*cells).cast("binary"), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.select(row.alias("h")).agg(F.count("*").alias("n"), F.sum("h").cast("string").alias("digest"))


def floor_breached(previous: int, current: int, fraction: float = 0.5) -> bool:
    """Whether a rebuild lost too much: fewer than ``fraction`` of the rows before."""
    return previous > 0 and 0 < fraction <= 1 and current < previous * fraction
