"""Ranked lexical search by dual trees.

A document is a sparse vector of what each term would add to a score, an item the
number of times it asks for each term; a score is their inner product.  Documents
are sorted so that like ones are near, and runs of them form a hierarchy whose
nodes hold the greatest value of every coordinate; items form one too.  For a pair
of nodes the product of their maxima bounds every score between them.  Where it is
below the weakest kth score that the node's items have so far, no document of the
node can enter any of their lists, and the pair is dropped whole.  What is left is
scored exactly, so the lists are those of a full scan.

Items are taken in blocks of bounded size, each a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch

_TERM = tb.alnum_table()
_FAN, _LEAF, _CODE = 8, 16, 12
_LEAST = np.iinfo(np.int64).min
_EXACT = 1 << 53


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of rows: the first row, the term hashes, and each row's first term."""
    data, offsets = tb.text_buffer(column)
    for a, b in tb.row_blocks(offsets, 1 << 21):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = tb.spans(_TERM[part], offsets[a : b + 1] - offsets[a])
        yield a, tb.span_hashes(tb.LOWER[part], starts, ends), first


def _counts(rows: np.ndarray, terms: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) in order with the number of each."""
    keys, n = np.unique(rows * width + terms, return_counts=True)
    return keys // width, keys % width, n


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """``values`` as one list for each of ``n`` rows; ``rows`` is sorted."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), pa.array(values))


@dataclass
class Items:
    """A block of items: ``number`` of each, the sorted hashes of their terms, and levels of maxima from single items up."""

    number: np.ndarray
    vocabulary: np.ndarray
    levels: list[np.ndarray]

    @classmethod
    def of(cls, table: pa.Table) -> Items:
        found = [(h, np.repeat(np.arange(len(first) - 1) + a, np.diff(first))) for a, h, first in _terms(table["text"])]
        h = np.concatenate([x for x, _ in found] or [np.zeros(0, np.uint64)])
        vocabulary, term = np.unique(h, return_inverse=True)
        rows, cols, n = _counts(np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)]), term, max(len(vocabulary), 1))
        single = np.zeros((table.num_rows, len(vocabulary)))
        single[rows, cols] = n
        starts, sizes = np.searchsorted(rows, np.arange(table.num_rows)), np.bincount(rows, minlength=table.num_rows)
        some = np.flatnonzero(sizes)
        order = np.argsort(_codes(cols, np.ones(len(cols)), starts[some], len(vocabulary))[0], kind="stable") if len(some) else some
        levels, number = [single[some[order]]], table["number"].to_numpy()[some[order]]
        while len(levels[-1]) > 1:
            levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), _FAN), axis=0))
        return cls(number, vocabulary, levels)


def _projection(width: int) -> np.ndarray:
    """Fixed signs for random projections of the coordinates."""
    h = tb.mix(np.arange(width * _CODE, dtype=np.uint64) + np.uint64(1))
    return np.where(h & np.uint64(1), 1.0, -1.0).reshape(width, _CODE)


def _codes(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A sign code of each vector, like ones having like codes, and the projections it is made of."""
    found = np.add.reduceat(_projection(width)[idx] * val[:, None], starts, axis=0)
    return (found > 0) @ (1 << np.arange(_CODE)[::-1]), found


def _tree_order(points: np.ndarray) -> np.ndarray:
    """Order of the points in which halves, quarters and so on are cut at the median of their widest coordinate."""
    order, parts = np.arange(len(points)), [(0, len(points))]
    while parts:
        a, b = parts.pop()
        if b - a <= _LEAF:
            continue
        mine = points[order[a:b]]
        mid = (b - a) // 2
        cut = np.argpartition(mine[:, np.argmax(mine.max(0) - mine.min(0))], mid)
        order[a:b] = order[a:b][cut]
        parts += [(a, a + mid), (a + mid, b)]
    return order


def vectors(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """``(doc_id, n, terms, tf)`` of every document with a term: its number of terms, and those of the vocabulary by number."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, h, first in _terms(batch.column("text")):
                n = np.diff(first)
                at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[at] == h if len(known) else np.zeros(len(h), bool)
                rows, terms, tf = _counts(np.repeat(np.arange(len(n)), n)[hit], at[hit], max(len(known), 1))
                columns = [batch.column("doc_id").slice(a, len(n)), pa.array(n), _lists(terms.astype(np.int32), rows, len(n)), _lists(tf, rows, len(n))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms array<int>, tf array<long>")


def document_counts(found: DataFrame, width: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(width, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["term", "n"])

    table = found.select("terms").mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(width, np.int64)
    out[table["term"].to_numpy()] = table["n"].to_numpy()
    return out


def _length(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """``m`` of documents with ``n`` terms."""
    if not len(n) or 25 * int(n.max()) * docs < 1 << 63:
        return 75 + (25 * n * docs) // total
    return np.array([75 + 25 * int(x) * docs // total for x in n], np.int64)


def forest(found: DataFrame, weights: np.ndarray, docs: int, total: int, scratch: Scratch, name: str) -> DataFrame:
    """``(doc_id, terms, value)`` with what each term adds to a score, in an order that has like documents near each other."""
    shared = found.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            idx, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            sizes = batch.column("terms").value_lengths().to_numpy()
            m = np.repeat(_length(batch.column("n").to_numpy(), docs, total), sizes)
            value = w[idx] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            rows = np.repeat(np.arange(len(sizes)), sizes)[value > 0]
            some, starts = np.unique(rows, return_index=True)
            idx, value = idx[value > 0], value[value > 0]
            code, _ = _codes(idx, value / 1e6, starts, len(w)) if len(some) else (some, None)
            place = np.searchsorted(some, rows)
            columns = [batch.column("doc_id").take(pa.array(some)), pa.array(code), _lists(idx, place, len(some)), _lists(value, place, len(some))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "code", "terms", "value"])

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("terms").offsets.to_numpy()[:-1].astype(np.int64)
            if batch.num_rows:
                idx, value = (batch.column(c).flatten().to_numpy() for c in ("terms", "value"))
                yield batch.take(pa.array(_tree_order(_codes(idx, value / 1e6, starts - starts[0], len(shared.value))[1])))

    rows = found.mapInArrow(weigh, "doc_id long, code long, terms array<int>, value array<long>")
    rows = rows.repartitionByRange("code", F.xxhash64("doc_id", "terms")).sortWithinPartitions("code")
    return scratch.put(rows.select("doc_id", "terms", "value").mapInArrow(arrange, "doc_id long, terms array<int>, value array<long>"), name)


class _Batch:
    """A batch of documents in order, as levels of nodes from leaves of 16 documents up to one root.

    A node is the sorted terms of its documents and the greatest value of each.
    """

    def __init__(self, batch: pa.RecordBatch, dtype: type):
        ids = batch.column("doc_id")
        self.doc_id = ids.fill_null(_LEAST).to_numpy()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        idx, value = (batch.column(c).flatten().to_numpy() for c in ("terms", "value"))
        sizes = batch.column("terms").value_lengths().to_numpy()
        self.idx, self.value, self.start = idx, value.astype(dtype), np.concatenate(([0], np.cumsum(sizes)))
        node, self.levels = np.repeat(np.arange(len(sizes)), sizes), []
        fan, count = _LEAF, len(sizes)
        while True:
            node, count = node // fan, -(-count // fan)
            order = np.lexsort((idx, node))
            node, idx, value = node[order], idx[order], value[order]
            first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (idx[1:] != idx[:-1]))))
            node, idx, value = node[first], idx[first], np.maximum.reduceat(value, first)
            self.levels.append((np.searchsorted(node, np.arange(count + 1)), idx, value.astype(dtype)))
            if count == 1:
                return
            fan = _FAN

    def leaf(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Its documents' places, its terms, and the documents' values of these as a matrix."""
        places = np.arange(number * _LEAF, min((number + 1) * _LEAF, len(self.doc_id)))
        a, b = self.start[places[0]], self.start[places[-1] + 1]
        bounds, terms, _ = self.levels[0]
        terms = terms[bounds[number] : bounds[number + 1]]
        dense = np.zeros((len(places), len(terms)), self.value.dtype)
        dense[np.repeat(places - places[0], np.diff(self.start[places[0] : places[-1] + 2])), np.searchsorted(terms, self.idx[a:b])] = self.value[a:b]
        return places, terms, dense


class _Search:
    """The lists of a task: each item's best ``k`` so far, over all its batches."""

    def __init__(self, items: Items, floors: np.ndarray, k: int, dtype: type):
        self.levels = [x.astype(dtype) for x in items.levels]
        self.k, self.floors = k, floors
        n = len(items.number)
        self.score, self.doc, self.null = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.least = np.maximum(floors, 1)
        self.pairs = self.scored = 0

    def bounds(self, batch: _Batch, level: int, node: int, rows: np.ndarray, at: int) -> np.ndarray:
        starts, idx, value = batch.levels[level]
        mine = slice(starts[node], starts[node + 1])
        self.pairs += len(rows)
        return self.levels[at][np.ix_(rows, idx[mine])] @ value[mine]

    def weakest(self, at: int, rows: np.ndarray) -> np.ndarray:
        """The weakest kth score among the items of each node of an item level."""
        step = _FAN**at
        return np.array([self.least[r * step : (r + 1) * step].min() for r in rows.tolist()])

    def open(self, batch: _Batch, level: int, node: int, rows: np.ndarray, at: int) -> tuple[np.ndarray, int, float]:
        """Of item nodes, or their children where these are finer than the documents' level, those that the node may serve."""
        best = self.bounds(batch, level, node, rows, at)
        rows = rows[best >= self.weakest(at, rows)]
        while at > level and len(rows):
            rows, at = (rows[:, None] * _FAN + np.arange(_FAN)).reshape(-1), at - 1
            rows = rows[rows < len(self.levels[at])]
            best = self.bounds(batch, level, node, rows, at)
            rows = rows[best >= self.weakest(at, rows)]
        return rows, at, float(best.max(initial=0))

    def visit(self, batch: _Batch, level: int, node: int, rows: np.ndarray, at: int) -> None:
        """Search below a pair of nodes, the most promising children first."""
        if not level:
            return self.score_leaf(batch, node, self._single(rows, at))
        count = len(batch.levels[level - 1][0]) - 1
        children = []
        for child in range(node * _FAN, min((node + 1) * _FAN, count)):
            mine, lower, best = self.open(batch, level - 1, child, rows, at)
            if len(mine):
                children.append((-best, child, mine, lower))
        for _, child, mine, lower in sorted(children, key=lambda x: x[:2]):
            mine = mine[self.bounds(batch, level - 1, child, mine, lower) >= self.weakest(lower, mine)]
            if len(mine):
                self.visit(batch, level - 1, child, mine, lower)

    def _single(self, rows: np.ndarray, at: int) -> np.ndarray:
        while at:
            rows, at = (rows[:, None] * _FAN + np.arange(_FAN)).reshape(-1), at - 1
            rows = rows[rows < len(self.levels[at])]
        return rows

    def score_leaf(self, batch: _Batch, node: int, rows: np.ndarray) -> None:
        places, terms, dense = batch.leaf(node)
        self.scored += len(rows) * len(places)
        found = (self.levels[0][np.ix_(rows, terms)] @ dense.T).astype(np.int64)
        better = found >= self.least[rows][:, None]
        for i in np.flatnonzero(better.any(1)).tolist():
            row, new = rows[i], places[better[i]]
            score, doc, null = (np.concatenate(x) for x in ((self.score[row], found[i][better[i]]), (self.doc[row], batch.doc_id[new]), (self.null[row], batch.null[new])))
            best = np.lexsort((doc, -score))[: self.k]
            self.score[row], self.doc[row], self.null[row] = score[best], doc[best], null[best]
            self.least[row] = max(self.floors[row], score[best[-1]], 1)

    def whole(self, batch: _Batch) -> None:
        top = len(batch.levels) - 1
        rows, at, _ = self.open(batch, top, 0, np.arange(1), len(self.levels) - 1)
        if len(rows):
            self.visit(batch, top, 0, rows, at)

    def nearest(self, batch: _Batch) -> None:
        """Score only the leaf that promises most to each item: what it finds bounds the kth scores from below."""
        starts, idx, value = batch.levels[0]
        best = np.stack([self.levels[0][:, idx[a:b]] @ value[a:b] for a, b in zip(starts[:-1], starts[1:])])
        chosen = best.argmax(0)
        for node in np.unique(chosen).tolist():
            self.score_leaf(batch, node, np.flatnonzero(chosen == node))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(trees: DataFrame, items: Items, floors: np.ndarray, k: int, dtype: type, greedy: bool) -> DataFrame:
    """``(number, doc_id, score)``: at most ``k`` of each task and item, none below the item's floor."""
    shared = trees.sparkSession.sparkContext.broadcast((items, floors))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = shared.value
        run = _Search(asked, least, k, dtype)
        for batch in batches:
            if batch.num_rows:
                (run.nearest if greedy else run.whole)(_Batch(batch, dtype))
        item, place = np.nonzero(run.score)
        docs = pa.array(run.doc[item, place], mask=run.null[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(asked.number[item]), docs, pa.array(run.score[item, place])], ["number", "doc_id", "score"])

    return trees.mapInArrow(work, "number long, doc_id long, score long")


def _block(documents: DataFrame, items: Items, k: int, scratch: Scratch, name: str) -> DataFrame:
    """``(number, doc_id, score, rank)`` of one block of items against all documents."""
    found = scratch.put(vectors(documents, items.vocabulary), f"vectors-{name}")
    docs, total = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = document_counts(found, len(items.vocabulary))
    weights = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    trees = forest(found, weights, docs, max(total, 1), scratch, f"forest-{name}")
    largest = int((items.levels[0] @ (weights * 1_000_000.0)).max(initial=0))
    dtype = np.float64 if largest < _EXACT else np.int64
    none = np.zeros(len(items.number), np.int64)
    seeds = _ranked(_search(trees, items, none, k, dtype, greedy=True), k).where(F.col("rank") == k).select("number", "score").toArrow()
    floors = none.copy()
    at = np.argsort(items.number)
    floors[at[np.searchsorted(items.number, seeds["number"].to_numpy(), sorter=at)]] = seeds["score"].to_numpy()
    return scratch.put(_ranked(_search(trees, items, floors, k, dtype, greedy=False), k), f"found-{name}")


def rank(documents: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 1 << 17) -> DataFrame:
    """The ``k`` best documents of each row of ``items``: ``item_id, rank, doc_id, score``.

    Terms are runs of ASCII letters and digits and of all signs beyond ASCII, A-Z
    lower-cased; they are compared by 64-bit hashes.  Only scores above 0 count,
    equal ones rank by doc_id.  Items are searched in blocks of about
    ``block_bytes`` of text, which is what the driver and each broadcast hold.

    Null and empty texts have no terms: such documents are not counted, such items
    have no rows.  A very long text is one vector; its terms are counted slice by
    slice of no more than itself.  Rows of equal doc_id are ranked each by itself,
    a null doc_id before all others; items of equal id have a list each.  Empty
    tables give no rows.  Further columns of both tables are left.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "dual-tree")
    text = F.coalesce("text", F.lit(""))
    asked = scratch.put(items.select(F.col("item_id").alias("item_id"), text.alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = spark.createDataFrame([], "number long, doc_id long, score long, rank int")
    for b in range(blocks):
        mine = Items.of(asked.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number", "text").toArrow())
        if len(mine.number):
            out = out.unionByName(_block(documents, mine, k, scratch, str(b)))
    return out.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return rank(documents, items)


OP11_SQL = r"""
WITH dt AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
it AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY doc_id),
tot AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM dn),
it2 AS (SELECT item_id, term, count(*) AS q FROM it GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM it2) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, tot GROUP BY term, nn),
c AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS v FROM tf JOIN w USING (term) JOIN dn USING (doc_id), tot),
s AS (SELECT item_id, doc_id, sum(q * v)::BIGINT AS score FROM it2 JOIN c USING (term) GROUP BY ALL HAVING sum(q * v) > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 20
"""
