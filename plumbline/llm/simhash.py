"""SimHash near-dedup with vantage-point trees.

Distinct fingerprints are indexed by a forest of vantage-point trees.  The bits
are cut into ``blocks`` runs; two fingerprints within ``radius`` bits agree on
all bits of at least ``blocks - radius`` runs, so there is one tree per choice
of so many runs, and its root deals fingerprints to shards by those (one plain
tree would prune little: distances of unrelated fingerprints all lie near 32).
Below the root a shard is a vantage-point tree over whole fingerprints.  By the
triangle inequality, partners' distances to a vantage point differ by at most
``radius``: a node splits at the median distance and only the boundaries of its
two sides are compared with each other; a leaf is a list in order of distance to
its vantage point, where each member meets those within ``radius`` of its own
distance.  So every pair within the radius meets in some shard, and pairs are exact.

A shard reports no pairs but its own connected parts (each member with the
smallest one), so a group of thousands of near copies gives as many rows as it
has members.  The parts of all shards are joined to components by alternating
star contractions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import shingle_sets
from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch, column, fresh

_WORD = tb.nonspace_table()
_BITS = 64
#: Stands for a null doc_id in join keys.
_NO_ID = -(2**63)


def _fingerprints(column: pa.Array, n: int, seed: int) -> np.ndarray:
    """SimHash of each text over its ``n``-word shingles, repeats included."""
    data, offsets = tb.text_buffer(column)
    out = np.zeros(len(offsets) - 1, np.uint64)
    digest = xxhash.xxh64_intdigest
    for a, b in tb.row_blocks(offsets):
        part = tb.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = tb.spans(_WORD[part], offsets[a : b + 1] - offsets[a])
        # The words with one space after each, as one buffer; a shingle is a slice of it.
        size = ends - starts + 1
        at = np.concatenate(([0], np.cumsum(size)))
        line = np.full(int(at[-1]), 0x20, np.uint8)
        word = np.ones(int(at[-1]), bool)
        word[at[1:] - 1] = False
        line[word] = part[_WORD[part]]
        raw = line.tobytes()
        count = np.maximum(np.diff(first) - n + 1, np.minimum(np.diff(first), 1))
        begin = np.arange(count.sum()) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
        stop = np.minimum(begin + n, np.repeat(first[1:], count))
        hashes = np.array([digest(raw[x:y], seed) for x, y in zip(at[begin].tolist(), (at[stop] - 1).tolist())], np.uint64)
        ends_of = np.concatenate(([0], np.cumsum(count)))
        for i in range(b - a):
            h = hashes[ends_of[i] : ends_of[i + 1]]
            if len(h):
                bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                out[a + i] = np.packbits(2 * bits > len(h)).view(">u8")[0]
    return out


def fingerprints(documents: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, version, fingerprint)``; the fingerprint is a LONG of 64 bits.

    ``version`` is a hash of the text: with doc_id it names the row.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _fingerprints(batch.column("text"), words, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(tb.signed(found))], ["doc_id", "version", "fingerprint"])

    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    return rows.mapInArrow(work, "doc_id long, version long, fingerprint long")


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the labels of the ends of some pairs, in place; a label is the smallest index of its part."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which of two fingerprints each are within ``radius`` bits."""
    return np.bitwise_count(x ^ y) <= radius


def _leaves(shards: np.ndarray, points: np.ndarray, index: np.ndarray, label: np.ndarray, radius: int) -> None:
    """Join the labels of near members of each leaf; ``shards`` is sorted and names the leaves of ``points``."""
    begin = np.flatnonzero(np.append(True, shards[1:] != shards[:-1])) if len(shards) else np.zeros(0, np.int64)
    vantage = np.repeat(points[begin], np.diff(np.append(begin, len(points))))
    distance = np.bitwise_count(points ^ vantage).astype(np.int64)
    order = np.lexsort((distance, shards))
    shards, points, index, distance = shards[order], points[order], index[order], distance[order]
    a, step = np.arange(len(points)), 1
    while len(a):
        a = a[a + step < len(points)]
        a = a[(shards[a + step] == shards[a]) & (distance[a + step] - distance[a] <= radius)]
        near = a[_near(points[a], points[a + step], radius)]
        _join_labels(label, index[near], index[near + step])
        step += 1


def _search(points: np.ndarray, index: np.ndarray, label: np.ndarray, radius: int, leaf: int) -> None:
    """Join the labels of all ``points[index]`` within ``radius`` of each other: one vantage-point tree."""
    stack = [(index, None)]
    while stack:
        left, right = stack.pop()
        if right is None:
            distance = np.bitwise_count(points[left] ^ points[left[0]])
            middle = int(np.median(distance))
            inner, outer = left[distance <= middle], left[distance > middle]
            if len(left) > leaf and len(outer):
                near = left[distance <= radius]
                _join_labels(label, np.full(len(near), left[0]), near)
                stack += [(inner, None), (outer, None), (left[(distance <= middle) & (distance > middle - radius)], left[(distance > middle) & (distance <= middle + radius)])]
            else:
                _leaves(np.zeros(len(left), np.int64), points[left], left, label, radius)
            continue
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            for to in range(0, len(right), 8192):
                columns = right[to : to + 8192]
                labels = label[rows], label[columns]
                if labels[0][0] == labels[1][0] and all((x == x[0]).all() for x in labels):
                    continue  # one part already
                x, y = np.nonzero(_near(points[rows][:, None], points[columns][None, :], radius))
                _join_labels(label, rows[x], columns[y])


def _shard_parts(shards: np.ndarray, points: np.ndarray, radius: int, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of each shard that have a partner there, with the smallest member of their part.

    ``shards`` is sorted.  Those of one leaf are worked off together.
    """
    label = np.arange(len(points))
    head = np.ones(len(points), bool)
    head[1:] = shards[1:] != shards[:-1]
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(points)))
    single = np.flatnonzero(np.repeat(size <= leaf, size))
    _leaves(shards[single], points[single], single, label, radius)
    for i in np.flatnonzero(size > leaf):
        _search(points, np.arange(begin[i], begin[i] + size[i]), label, radius, leaf)
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def trees(radius: int, blocks: int) -> list[int]:
    """For each tree, the mask of the bits on which members of a root's branch agree."""
    cuts = [round(i * _BITS / blocks) for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:])]
    return [sum(x) for x in combinations(runs, blocks - radius)]


def best_blocks(n: int, radius: int) -> int:
    """The number of runs that costs least for ``n`` fingerprints: copies sorted plus pairs compared.

    Every choice finds all pairs; more runs mean more trees with smaller shards.
    """

    def cost(blocks: int) -> float:
        bits = _BITS * (blocks - radius) / blocks
        return comb(blocks, radius) * n * (40 + n / 2**bits)

    return min(range(radius + 1, radius + 5), key=cost)


def links(points: DataFrame, radius: int = 4, blocks: int | None = None, leaf: int = 1024) -> DataFrame:
    """Spanning links ``(a, b)``, a member and the smallest of its part, over distinct ``fingerprint`` rows.

    Shards are dealt by hash, a few of them to one task in sorted order.
    """
    if blocks is None:
        blocks = best_blocks(points.count(), radius)
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in trees(radius, blocks)]
    branch = F.array(*[F.xxhash64(F.lit(i), F.col("fingerprint").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    copies = points.select("fingerprint", F.explode(branch).alias("shard"))
    dealt = copies.repartition("shard").sortWithinPartitions("shard")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(shard: np.ndarray, point: np.ndarray) -> pa.RecordBatch:
            a, b = _shard_parts(shard, point, radius, leaf)
            return pa.RecordBatch.from_arrays([pa.array(tb.signed(a)), pa.array(tb.signed(b))], ["a", "b"])

        held = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for batch in batches:
            shard, point = batch.column("shard").to_numpy(), batch.column("fingerprint").to_numpy().view(np.uint64)
            whole = int(np.searchsorted(shard, shard[-1])) if len(shard) else 0
            if whole:  # the last shard of a batch may go on in the next one
                held.append((shard[:whole], point[:whole]))
                yield parts(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append((shard[whole:], point[whole:]))
        yield parts(*(np.concatenate(x) for x in zip(*held)))

    return dealt.mapInArrow(work, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, component)`` of all nodes of ``edges (a, b)``: the smallest node each can reach.

    Large-star and small-star contractions by turns, each one grouped minimum and
    a join back on the node; the table written in each turn cuts lineage.
    """
    edges = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges_0")
    turn = 0
    while True:
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = scratch.put(small.where("a <> b").distinct(), f"edges_{turn}")
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (edges, new))
        scratch.drop(f"edges_{turn - 1}")
        edges = new
        if before == after:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def near_duplicates(documents: DataFrame, radius: int = 4, words: int = 4, blocks: int | None = None) -> DataFrame:
    """``(doc_id, version, fingerprint, component, component_id)``, one row per row of ``documents``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked;
    ``component`` is the smallest fingerprint and ``component_id`` the smallest
    doc_id of all that links reach.  Null, empty
    and blank texts have fingerprint zero and are linked like any other.  Null
    doc_ids are linked but name no component unless it has no other id; rows with
    equal ids are separate rows.  An empty table gives an empty result.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "simhash")
    prints = scratch.put(fingerprints(documents, words), "prints")
    points = scratch.put(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(points.select("fingerprint"), radius, blocks), scratch)
    labelled = points.join(found.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left")
    labelled = scratch.put(labelled.select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "labelled")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = labelled.join(least, "component").select("fingerprint", "component", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "version", "fingerprint", "component", "component_id")


def _fingerprint_guesses(texts: DataFrame, radius: int, words: int, scratch: Scratch):
    """Pairs of sets that the search over fingerprints takes for near: each with the least of its part's, unverified."""

    def guesses(sets: DataFrame) -> DataFrame:
        prints = fingerprints(texts.select("doc_id", "text"), words).select("version", "fingerprint").distinct()
        prints = scratch.put(sets.join(prints, "version").select("id", "fingerprint"), "prints")
        points = scratch.put(prints.groupBy("fingerprint").agg(F.min("id").alias("least")), "points")
        near = links(points.select("fingerprint"), radius)
        ends = [points.select(F.col("fingerprint").alias(c), F.col("least").alias(f"id_{c}")) for c in ("a", "b")]
        across = near.join(ends[0], "a").join(ends[1], "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        within = prints.join(points, "fingerprint").select(F.col("id").alias("a"), F.col("least").alias("b"))
        return across.unionByName(within).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    return guesses


def keep_one(documents: DataFrame, radius: int = 4, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``documents`` without near duplicates: of each component, one row with its smallest doc_id stays.

    Documents are linked if the Jaccard similarity of their sets of ``words``-word
    shingles is at least ``similarity``.  Fingerprints within ``radius`` bits only
    guess which pairs to verify first; ``shingle_sets`` finds all others.  Texts
    without a word are linked to each other.

    Of several rows with that doc_id the one with the smallest text hash stays,
    and of rows equal in id and text one.  A null id counts as larger than others.
    """
    scratch = Scratch(documents.sparkSession, "simhash-keep")
    text = F.coalesce("text", F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    found, parts = shingle_sets.similar_sets(texts, words, similarity, scratch, components, _fingerprint_guesses(texts, radius, words, scratch))
    found = found.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "version")).alias("first")
    doc, version = fresh(documents.columns, "doc", "version")
    kept = found.groupBy("component").agg(first).select(F.coalesce("first.doc_id", F.lit(_NO_ID)).alias(doc), F.col("first.version").alias(version))
    kept = scratch.put(kept, "kept")
    keys = {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), version: F.xxhash64(F.coalesce("text", F.lit("")))}
    return documents.withColumns(keys).join(kept, [doc, version], "left_semi").dropDuplicates([doc, version]).select(*map(column, documents.columns))


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", hex_of(F.col("fingerprint")).alias("fingerprint"), "component_id")
