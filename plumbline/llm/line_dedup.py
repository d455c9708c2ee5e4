"""Line dedup by levelled sorted runs of line hashes.

Documents arrive in batches.  The hashes of a batch's lines, with the number of
documents that hold each, are merge-anti-joined with the runs written so far:
a hash that no run knows gets its keeper (the largest doc_id of the batch), a
known one only adds to the count.  The batch's rows become a new run of level 0;
whenever a level holds ``fanout`` runs they are merged into one run of the next
level.  Runs are bucketed and sorted by hash, so neither the anti-joins nor the
merges shuffle a run again.

Batches are taken by falling doc_id, so the keeper of a hash is the largest
doc_id of all that hold it, as for a stream whose newest text wins.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch, column, fresh, without

_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _ASCII_LOWER)


class LineRuns:
    """Levelled runs ``(h1, h2, n_docs, keeper)``, each bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, scratch: Scratch, fanout: int = 2):
        self.spark, self.scratch, self.fanout = spark, scratch, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        (
            df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
            .option("path", self.scratch.path(name)).saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        self.scratch.drop(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs joined hash by hash; a full outer merge of sorted buckets."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.withColumnsRenamed({"n_docs": "n_more", "keeper": "keeper_more"})
            both = a.hint("merge").join(b, ["h1", "h2"], "full_outer")
            n = F.coalesce("n_docs", F.lit(0)) + F.coalesce("n_more", F.lit(0))
            return both.select("h1", "h2", n.alias("n_docs"), F.greatest("keeper", "keeper_more").alias("keeper"))

        return reduce(two, (self.spark.table(x) for x in names))

    def names(self) -> list[str]:
        return [x for level in self.levels for x in level]

    def add(self, summary: DataFrame) -> None:
        """Take a batch's ``(h1, h2, n_docs, keeper)`` as a new run, then compact.

        The anti-join is a left merge join, so that hashes that a run knows keep
        their counts in the same pass; only unknown ones keep their keeper.
        """
        batch = summary.repartition(self.buckets, "h1", "h2")
        unknown = F.lit(True)
        for i, run in enumerate(self.names()):
            known = self.spark.table(run).select("h1", "h2", F.lit(True).alias(f"known_{i}"))
            batch = batch.join(known.hint("merge"), ["h1", "h2"], "left")
            unknown = unknown & F.col(f"known_{i}").isNull()
        self._write(batch.select("h1", "h2", "n_docs", F.when(unknown, F.col("keeper")).alias("keeper")), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(full), level + 1)
            for name in full:
                self._remove(name)
            level += 1

    def result(self) -> DataFrame:
        """All hashes with the number of documents and the keeper over every run."""
        return self._merged(self.names())

    def close(self) -> None:
        for name in self.names():
            self._remove(name)
        self.levels = []


def line_table(documents: DataFrame, min_chars: int) -> DataFrame:
    """``(doc_id, version, pos, h1, h2)`` of every line whose key has ``min_chars`` code points.

    ``version`` is a hash of the text: with doc_id it names the row.  The two
    64-bit hashes have different seeds and count as one of 128 bits.
    """
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"),
        F.posexplode(lines_of(F.col("text"))).alias("pos", "line"),
    )
    rows = rows.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    return rows.select("doc_id", "version", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_lines(spark: SparkSession, lines: DataFrame, scratch: Scratch, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """``(h1, h2, keeper)`` of hashes held by ``min_docs`` documents, found batch by batch."""
    cuts = lines.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({float(x) for x in cuts}, reverse=True)
    runs = LineRuns(spark, scratch, fanout)
    doc = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    try:
        for high, low in zip([None, *cuts], [*cuts, None], strict=True):
            part = lines if high is None else lines.where(doc < F.lit(high))
            part = part if low is None else part.where(doc >= F.lit(low))
            held = part.select("h1", "h2", "doc_id").distinct()
            runs.add(held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")))
        return scratch.put(runs.result().where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "repeated")
    finally:
        runs.close()


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """Drop every repeated line except in the keeper of its key.

    A key (line without end blanks, A-Z lower-cased) of at least ``min_chars``
    code points held by ``min_docs`` distinct doc_ids loses all its lines except
    in the document with the largest doc_id.  Returns the input's columns with
    ``text`` replaced, plus ``n_lines`` (before) and ``n_dropped``, which replace
    columns of those names.

    Null text is empty and has one empty line.  Rows with equal doc_id count as
    one document; a null doc_id is smaller than all others and all null ones
    count as one.  Extra columns are kept.  Very long texts are split whole.  An empty
    table gives an empty result.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "line-dedup")
    lines = scratch.put(line_table(documents, min_chars), "lines")
    repeated = repeated_lines(spark, lines, scratch, min_docs, batches, fanout)
    older = F.col("keeper").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    drops = lines.join(repeated, ["h1", "h2"]).where(older)
    kept = without(documents.columns, ("n_lines", "n_dropped"))
    doc, version, at, held, n = fresh([*kept, "n_lines", "n_dropped"], "doc", "version", "at", "held", "n")
    drops = drops.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias(at))
    drops = drops.select(F.col("doc_id").alias(doc), F.col("version").alias(version), at)

    text, none = F.coalesce("text", F.lit("")), F.array().cast("array<int>")
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(version))
    joined = documents.select(*map(column, kept)).join(drops, key, "left").withColumn(at, F.coalesce(at, none))
    out = joined.withColumn(held, lines_of(F.col("text"))).withColumn(n, F.size(held))
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x + 1))
    ends = F.concat(at, F.array(n))
    rest = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(F.col(held), a + 1, b - a)))
    whole = F.when(F.size(at) == 0, text).otherwise(F.array_join(rest, "\n"))
    names = [whole.alias("text") if c == "text" else column(c) for c in kept]
    return out.select(*names, F.col(n).cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND k.doc_id < r.keeper AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
