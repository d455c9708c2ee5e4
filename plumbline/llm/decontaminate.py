"""Benchmark decontamination by winnowing.

The fingerprint of a window of ``window`` words is its smallest hash of ``k``
consecutive words (all of a shorter window's words).  Overlapping windows mostly
share it, so a text keeps few positions; equal windows keep equal ones, so every
shared window is found where the fingerprints of training and test texts join.
A hit is then extended: the windows that chose the position are joined with the
test windows word by word.

Only documents' positions whose fingerprint falls on a bit set by the test side
leave the pass over the texts.  That bit map has a fixed size; with a larger
benchmark more bits are set and more positions go to the join, which Spark makes
a broadcast or a shuffle by the size of the written test tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch, column, fresh, without

_WORD = tb.alnum_table()
_BITS = 22


def _gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (as many as start in ``h``)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : len(h) - n + 1 + j]
    return tb.mix(out)


def selected(h: np.ndarray, first: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each ``n``-word window of some texts, the position it keeps, and the fingerprint there.

    ``h`` has the texts' word hashes and ``first`` the first word of each text.
    """
    k = min(k, n)
    start = np.arange(max(len(h) - n + 1, 0))
    start = start[start + n <= np.repeat(first[1:], np.diff(first))[: len(start)]]
    grams = _gram(h, k)
    if not len(start):
        return start, start, grams[:0]
    least = np.lib.stride_tricks.sliding_window_view(grams, n - k + 1)
    at = np.concatenate([least[start[i : i + (1 << 17)]].argmin(axis=1) for i in range(0, len(start), 1 << 17)]) + start
    return start, at, grams[at]


def _words(h: np.ndarray, start: np.ndarray, n: int) -> pa.Array:
    """The word hashes of windows as lists."""
    values = tb.signed(h[(start[:, None] + np.arange(n)).reshape(-1)])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32) * n), pa.array(values))


def _hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: the first row, the word hashes and each row's first word."""
    data, offsets = tb.text_buffer(column)
    for a, b in tb.row_blocks(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = tb.spans(_WORD[part], offsets[a : b + 1] - offsets[a])
        yield a, tb.span_hashes(tb.LOWER[part], starts, ends), first


def benchmark_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """``(n, fingerprint, words, items)``: the distinct windows of the benchmark and the ids that hold each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, h, first in _hashes(batch.column("text")):
                size = np.diff(first)
                for n in np.unique(np.minimum(size, window)).tolist():
                    if not n:
                        continue
                    start, _, prints = selected(h, first, n, k)
                    row = np.searchsorted(first, start, "right") - 1
                    mine = np.minimum(size[row], window) == n
                    start, row = start[mine], row[mine]
                    columns = [pa.array(np.full(len(start), n, np.int32)), pa.array(tb.signed(prints[mine])), _words(h, start, n), batch.column("item_id").take(pa.array(row + a))]
                    yield pa.RecordBatch.from_arrays(columns, ["n", "fingerprint", "words", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = items.mapInArrow(work, "n int, fingerprint long, words array<long>, item_id string")
    return rows.groupBy("n", "words").agg(F.min("fingerprint").alias("fingerprint"), F.collect_set("item_id").alias("items"))


def bit_map(windows: DataFrame) -> np.ndarray:
    """Which of 2**22 slots some fingerprint of ``windows`` falls on; only their numbers reach the driver."""
    slots = windows.select(F.col("fingerprint").bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int").alias("slot")).distinct()
    out = np.zeros(1 << _BITS, bool)
    out[slots.toArrow()["slot"].to_numpy()] = True
    return out


def kept_positions(documents: DataFrame, lengths: list[int], bits: np.ndarray, k: int) -> DataFrame:
    """``(doc, version, n, fingerprint, start, words)``: windows of ``documents`` whose kept position falls on a set bit."""
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for a, h, first in _hashes(batch.column("text")):
                for n in lengths:
                    start, _, prints = selected(h, first, n, k)
                    hit = known[(prints & np.uint64(len(known) - 1)).astype(np.int64)]
                    start, prints = start[hit], prints[hit]
                    row = np.searchsorted(first, start, "right") - 1
                    owner = pa.array(row + a)
                    columns = [batch.column("doc").take(owner), batch.column("version").take(owner), pa.array(np.full(len(start), n, np.int32)), pa.array(tb.signed(prints)), pa.array(start - first[row]), _words(h, start, n)]
                    yield pa.RecordBatch.from_arrays(columns, ["doc", "version", "n", "fingerprint", "start", "words"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("string").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(work, "doc string, version long, n int, fingerprint long, start long, words array<long>")


def with_word_counts(rows: DataFrame, drop: list[str]) -> DataFrame:
    """``rows`` plus ``n_words`` of their ``text``, without the columns ``drop``."""
    kept = [c for c in rows.columns if c not in drop]
    plain = {c: f"c{i}" for i, c in enumerate(rows.columns)}  # names as tasks see them, whatever signs the real ones have
    fields = [T.StructField(plain[c], rows.schema[c].dataType) for c in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_buffer(batch.column(plain["text"]))
            found = [np.diff(tb.spans(_WORD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a])[2]) for a, b in tb.row_blocks(offsets)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(n)], [*(f.name for f in fields), "n_words"])

    found = rows.select(*(column(c).alias(name) for c, name in plain.items())).mapInArrow(work, T.StructType([*fields, T.StructField("n_words", T.LongType())]))
    return found.select(*(F.col(plain[c]).alias(c) for c in kept), "n_words")


def merged(spans: Column) -> Column:
    """Sorted spans ``struct<a, b>`` joined where they overlap or meet, as arrays of two."""
    none = F.array().cast("array<array<bigint>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("bigint").alias("a"), F.lit(None).cast("bigint").alias("b"))

    def closed(acc: Column) -> Column:
        return F.when(acc["a"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(F.array(acc["a"], acc["b"]))))

    def step(acc: Column, x: Column) -> Column:
        joins = x["a"] <= acc["b"]
        return F.when(joins, F.struct(acc["done"].alias("done"), acc["a"].alias("a"), F.greatest(acc["b"], x["b"]).alias("b"))).otherwise(F.struct(closed(acc).alias("done"), x["a"].alias("a"), x["b"].alias("b")))

    return F.aggregate(spans, start, step, closed)


_ADDED = ("n_words", "n_hit", "hit_spans", "items")


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, carry: list[str] | None = None) -> DataFrame:
    """Mark the words of ``documents`` that lie in a window of a benchmark item.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one.  Returns the columns ``carry`` (default: all) plus ``n_words``,
    ``n_hit``, ``hit_spans`` (runs of hit words, end exclusive) and ``items`` (the
    ids, as text, of items with a window in the document).

    Null and empty texts have no words.  Rows with equal ids are judged each by
    itself; items with equal ids count once; an item without id marks words but
    is not listed.  Columns of ``documents`` named like the added ones are
    replaced, others kept whatever their names.  Very long texts are searched whole.
    An empty table gives no rows.  Windows are equal if all their 64-bit word hashes are.
    """
    scratch = Scratch(documents.sparkSession, "decontaminate")
    carry = without(documents.columns if carry is None else carry, _ADDED)
    windows = scratch.put(benchmark_windows(benchmark, window, k), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    kept = kept_positions(documents, lengths, bit_map(windows), k)
    hits = kept.join(scratch.put(windows.select("n", "fingerprint").distinct(), "fingerprints"), ["n", "fingerprint"], "left_semi")
    extended = hits.join(windows.select("n", "words", "items"), ["n", "words"])
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    doc, version, spans = fresh([*documents.columns, *_ADDED], "doc", "version", "spans")
    found = extended.groupBy(F.col("doc").alias(doc), F.col("version").alias(version)).agg(F.sort_array(F.collect_set(span)).alias(spans), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    found = scratch.put(found.withColumn(spans, merged(F.col(spans))), "found")

    mine, own = fresh([*documents.columns, *_ADDED, doc, version, spans], "mine", "own")
    keys = {mine: F.col("doc_id").cast("string"), own: F.xxhash64(F.coalesce("text", F.lit("")))}
    rows = documents.withColumns(keys).select(*map(column, [*dict.fromkeys([*carry, "text"]), mine, own]))
    rows = with_word_counts(rows, without(["text"], carry))
    out = rows.join(found, F.col(mine).eqNullSafe(F.col(doc)) & (F.col(own) == F.col(version)), "left")
    size = F.aggregate(F.col("hit_spans"), F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    out = out.withColumn("hit_spans", F.coalesce(spans, F.array().cast("array<array<bigint>>"))).withColumn("n_hit", size)
    out = out.withColumn("items", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))))
    return out.select(*map(column, [*carry, *_ADDED]))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_leaks(docs, items, carry=["doc_id"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
il AS (SELECT item_id, w, least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
ip AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM il),
ik AS (SELECT DISTINCT item_id::VARCHAR AS item_id, n, array_to_string(w[p:p + n - 1], ' ') AS key FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM ik) WHERE len(w) >= n),
dk AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS key FROM dp),
hit AS (SELECT doc_id, n, p, item_id FROM dk JOIN ik USING (n, key)),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, n, p FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
