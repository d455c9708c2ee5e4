"""A digest of tables that holds their order, cell by cell, and leads to the blocks in which two builds differ."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.sources.scratch import fresh_folder

#: Tables of the index: the columns they are ordered by and, after the bar, the others a digest covers.
DIGESTED = {
    "documents": "doc_id | path title status", "links": "source_doc href target_doc | external", "claims": "claim_id doc_id | lead", "records": "uri version archive_path | disposition byte_size", "claim_sources": "claim_id archive_path |",
    "verifications": "claim_id by |", "subjects": "key | dimension description", "subject_aliases": "alias | key", "claim_subjects": "claim_id subject | op value dimension",
}


def columns_of(spec: str) -> tuple[list[str], list[str]]:
    order, _, rest = spec.partition("|")
    return order.split(), rest.split()


def framed(columns: list[str]) -> Column:
    """A row as text: each cell a one, its byte count, a colon and its text, or a zero for null; no two rows read alike."""
    texts = [F.col(c).cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.lit("1"), F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("0")) for t in texts])


def hashed(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_blocks(df: DataFrame, spec: str, rows_per_block: int = 4096) -> DataFrame:
    """``(block, first, rows, digest)``: the rows in order, cut into blocks, each with the hash of its rows' hashes.

    Equal rows are one with their number.  A block ends after a row whose own hash
    says so, one in ``rows_per_block``: cuts don't depend on what stands before,
    so a row more or less changes one block or two and leaves the others alone.
    Rows are range-sorted and each task hashes its blocks as they pass; only the
    hashes of a task's first and last block, which may go on in the tasks beside
    it, are handed on to be hashed together.  No key, however frequent, gathers in
    a task.
    """
    order, rest = columns_of(spec)
    cells = [F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate([*order, *rest])]
    names, keys = [f"c{i}" for i in range(len(cells))], [f"c{i}" for i in range(len(order))]
    rows = df.select(*cells).groupBy(*names).agg(F.count("*").alias("n"))
    rows = rows.select(*keys, "n", F.unhex(hashed(F.concat(framed(names), F.lit("x"), F.col("n").cast("string")))).alias("h"))
    by = [F.asc_nulls_first(c) for c in (*keys, "h")]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(F.spark_partition_id().alias("part"), F.col("c0").alias("first"), "n", "h")
    folder = fresh_folder(df.sparkSession, "digest")
    ordered.mapInArrow(_pieces(rows_per_block), _PIECES).write.parquet(folder)
    pieces = df.sparkSession.read.schema(_PIECES).parquet(folder)
    starts = pieces.groupBy("part").agg(F.sum("cut").alias("cuts"))
    starts = starts.select("part", F.coalesce(F.sum("cuts").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    blocks = pieces.join(starts, "part").groupBy((F.col("start") + F.col("local")).alias("block"))
    out = blocks.agg(F.sum("rows").alias("rows"), F.max("digest").alias("whole"), F.sort_array(F.collect_list(F.struct("part", "first", "hashes"))).alias("x"))
    return out.select("block", F.col("x")[0]["first"].alias("first"), "rows", F.coalesce("whole", hashed(F.array_join("x.hashes", ""))).alias("digest"))


_PIECES = "part int, local long, first string, rows long, cut long, digest string, hashes string"


def _pieces(rows_per_block: int):
    """Blocks, or parts of blocks, of sorted rows ``(part, first, n, h)`` of one partition; the first and the last piece come with their hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, open_, text, sha = 0, 0, None, [], hashlib.sha256()

        def piece(cut: int) -> pa.RecordBatch:
            bare = local > 0 and cut
            row = (part, local, open_[0], open_[1], cut, sha.hexdigest() if bare else None, None if bare else "".join(text))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["part", "local", "first", "rows", "cut", "digest", "hashes"])

        for batch in batches:
            if not len(batch):
                continue
            part, raw = batch.column("part")[0].as_py(), b"".join(batch.column("h").to_pylist())
            low = np.frombuffer(raw, ">u8").reshape(-1, 4)[:, 3] & np.uint64((1 << 60) - 1)
            ends = (np.flatnonzero(low % np.uint64(rows_per_block) == 0) + 1).tolist()
            n, line, start = batch.column("n").to_numpy(), raw.hex(), 0
            for stop, cut in [*((x, True) for x in ends), (len(batch), False)]:
                if stop > start:
                    open_ = open_ or [batch.column("first")[start].as_py(), 0]
                    open_[1] += int(n[start:stop].sum())
                    text.append(line[64 * start : 64 * stop])
                    sha.update(text[-1].encode())
                if cut:
                    yield piece(1)
                    local, open_, text, sha = local + 1, None, [], hashlib.sha256()
                start = stop
        if open_:
            yield piece(0)

    return work


def root(blocks: DataFrame, fanout: int = 64) -> DataFrame:
    """One row ``(rows, digest)``: blocks hashed in order, ``fanout`` to a node, level by level, until one is left; an empty table has the hash of nothing."""
    level = blocks.select("block", "rows", "digest")
    count = level.count()
    while count > 1:
        up = level.groupBy(F.floor(F.col("block") / fanout).cast("long").alias("up")).agg(F.sum("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("block", "digest"))).alias("x"))
        level = up.select(F.col("up").alias("block"), "rows", hashed(F.array_join("x.digest", "")).alias("digest"))
        count = -(-count // fanout)
    return level.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.max("digest"), hashed(F.lit(""))).alias("digest"))


def index_blocks(tables: dict[str, DataFrame], spec: dict[str, str] = DIGESTED, rows_per_block: int = 4096) -> DataFrame:
    """``(name, block, first, rows, digest)`` of all tables, stored."""
    spark = next(iter(tables.values())).sparkSession
    folder = fresh_folder(spark, "blocks")
    for name in spec:
        row_blocks(tables[name], spec[name], rows_per_block).write.parquet(f"{folder}/name={name}")
    return spark.read.option("basePath", folder).parquet(*[f"{folder}/name={n}" for n in spec]).select("name", "block", "first", "rows", "digest")


def index_digest(blocks: DataFrame, names: list[str]) -> DataFrame:
    """``(name, rows, digest)`` of each table, and one row ``index`` over all by name.

    Each table's name stands before its root, so rows moved to another table of
    the same columns change the digest of the index, as does any cell.
    """
    each = None
    for name in sorted(names):
        one = root(blocks.where(F.col("name") == name)).select(F.lit(name).alias("name"), "rows", "digest")
        each = one if each is None else each.unionByName(one)
    whole = each.agg(F.sum("rows").alias("rows"), F.sort_array(F.collect_list(F.struct("name", "digest"))).alias("x"))
    lines = F.transform("x", lambda t: F.concat(F.lit("table:"), t["name"], F.lit(":"), t["digest"], F.lit(";")))
    return each.unionByName(whole.select(F.lit("index").alias("name"), "rows", hashed(F.array_join(lines, "")).alias("digest")))


def differing_blocks(one: DataFrame, other: DataFrame) -> DataFrame:
    """``(name, first, rows, side)`` of the blocks of one set that the other doesn't have: where to look for a difference."""
    keys = ["name", "digest"]
    a, b = (x.join(y.select(*keys), keys, "left_anti").select("name", "first", "rows", F.lit(s).alias("side")) for x, y, s in ((one, other, "one"), (other, one, "other")))
    return a.unionByName(b)
