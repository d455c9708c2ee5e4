"""Links between texts whose sets of word shingles are similar: an exact set-similarity join.

Sets are compared by Jaccard similarity.  With the shingles of all sets in one
order, two sets that are similar enough share a shingle among the first few of
each (prefix filter), so sets meet by one shuffle on those; every pair that is
linked has its similarity counted from the texts.  The order puts shingles that
many texts have last.  Any order finds all pairs; this one keeps groups small.

Only connected parts are asked for, so pairs that verified links have joined
already are not compared again: the first links are those of neighbours in each
group and of any given guesses, and all other pairs of different parts follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch

_WORD = tb.nonspace_table()
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHAPES = "doc_id long, version long, id long, size int, parity binary, prefix array<long>"
#: Least bits of a set's parity: shingles by hash, odd or even.  Each shingle that only one of two sets has flips one bit.
#: A larger set has more bits, as many as shingles or up to twice that, so that parities of unlike sets differ in more
#: bits than those of similar ones can.
_PARITY = 1024
_BLOCK = 1 << 19


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``words``-word shingles, and where each text's begin.

    A shorter text that has words is one shingle.
    """
    data, offsets = tb.text_buffer(column)
    found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in tb.row_blocks(offsets):
        part = tb.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = tb.spans(_WORD[part], offsets[a : b + 1] - offsets[a])
        word = tb.span_hashes(part, starts, ends)
        has = np.diff(first)
        count = np.maximum(has - words + 1, np.minimum(has, 1))
        row = np.repeat(np.arange(b - a), count)
        begin = np.arange(len(row)) + np.repeat(first[:-1] - (np.cumsum(count) - count), count)
        stop = first[1:][row]
        h = np.zeros(len(row), np.uint64)
        for j in range(words):
            inside = np.flatnonzero(begin + j < stop)
            h[inside] = tb.mix(h[inside] * _FACTOR + word[begin[inside] + j])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        found.append(h[new])
        sizes.append(np.bincount(row[new], minlength=b - a))
    return np.concatenate(found), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def common_shingles(texts: DataFrame, words: int, most: int = 1 << 18) -> np.ndarray:
    """Sorted hashes of shingles that many texts have, counted over a part of the texts; they only order the prefixes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.row_blocks(tb.text_buffer(batch.column("text"))[1], _BLOCK):  # bounds memory
                h, n = np.unique(shingle_sets(batch.column("text").slice(a, b - a), words)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(h)), pa.array(n)], ["token", "n"])

    part = texts.where(F.pmod(F.col("version"), F.lit(16)) == 0).select("text")
    counted = part.mapInArrow(work, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8")
    return np.sort(counted.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()["token"].to_numpy().view(np.uint64))


def parities(h: np.ndarray, row: np.ndarray, size: np.ndarray) -> pa.Array:
    """Each set's parity as bytes: bit ``i`` tells whether an odd number of its shingles have hash ``i`` modulo the bits."""
    bits = np.left_shift(_PARITY, np.ceil(np.log2(np.maximum(size, _PARITY) / _PARITY)).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(bits)))
    odd = np.bincount(begin[row] + (h % bits[row].astype(np.uint64)).astype(np.int64), minlength=int(begin[-1])) & 1
    packed = np.packbits(odd.astype(bool))
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((begin // 8).astype(np.int32)), pa.py_buffer(packed)])


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many bits the parities of pairs differ; a longer one is folded to the shorter one's bits."""
    ends = []
    for column in (a, b):
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        ends.append((at[:-1], np.diff(at), np.frombuffer(data, np.uint8)))
    out = np.zeros(len(a), np.int64)
    widths = np.stack((ends[0][1], ends[1][1]))
    for pair in np.unique(widths, axis=1).T:
        mine, least = np.flatnonzero((widths == pair[:, None]).all(axis=0)), int(pair.min())
        for at in range(0, len(mine), max(1, (1 << 24) // int(pair.max()))):  # bounds memory
            rows = mine[at : at + max(1, (1 << 24) // int(pair.max()))]
            x, y = (np.bitwise_xor.reduce(data[start[rows][:, None] + np.arange(width)].reshape(len(rows), -1, least), axis=1) for (start, _, data), width in zip(ends, pair.tolist()))
            out[rows] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def shapes(texts: DataFrame, words: int, similarity: Fraction, common: np.ndarray) -> DataFrame:
    """``(doc_id, version, id, size, prefix)`` of each row: its set by hash, the set's size and its first shingles."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def shape(batch: pa.RecordBatch, last: np.ndarray) -> pa.RecordBatch:
        h, bounds = shingle_sets(batch.column("text"), words)
        size = np.diff(bounds)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tb.mix(h + _FACTOR))))
        ids = tb.mix((total[bounds[1:]] - total[bounds[:-1]]) * _FACTOR + size.astype(np.uint64))
        row = np.repeat(np.arange(len(size)), size)
        parity = parities(h, row, size)
        late = last[np.minimum(np.searchsorted(last, h), len(last) - 1)] == h if len(last) else np.zeros(len(h), bool)
        h = h[np.lexsort((h, late, row))]
        # A similar set shares at least ceil(similarity * size) shingles.
        taken = np.where(size > 0, size + size * similarity.numerator // -similarity.denominator + 1, 0)
        cuts = np.concatenate(([0], np.cumsum(taken)))
        at = np.arange(cuts[-1]) + np.repeat(bounds[:-1] - cuts[:-1], taken)
        prefix = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tb.signed(h[at])))
        columns = [batch.column("doc_id"), batch.column("version"), pa.array(tb.signed(ids)), pa.array(size.astype(np.int32)), parity, prefix]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "id", "size", "parity", "prefix"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tb.row_blocks(tb.text_buffer(batch.column("text"))[1], _BLOCK):  # bounds memory
                for at in range(a, b, 2048):
                    yield shape(batch.slice(at, min(2048, b - at)), shared.value)

    return texts.select("doc_id", "version", "text").mapInArrow(work, _SHAPES)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``token``, those whose token another row has too."""
    held, again = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        token = table["token"].to_numpy()
        same = token[1:] == token[:-1]
        before = np.concatenate(([again], same))
        keep = before[:-1] | same
        yield from table.slice(0, len(token) - 1).filter(pa.array(keep)).to_batches()
        held, again = table.slice(len(token) - 1).to_batches()[0], bool(before[-1])
    if held is not None and again:
        yield held


def _pairs_of_groups(similarity: Fraction):
    """Pairs of different parts that meet in a group and may be similar, from rows sorted by ``(token, part)``."""
    p, q = similarity.numerator, similarity.denominator

    def ends(key_changes: np.ndarray) -> np.ndarray:
        """For each row, the end of its run."""
        cuts = np.append(np.flatnonzero(key_changes), len(key_changes))
        return np.repeat(cuts[1:], np.diff(cuts))

    def pairs(token, part, ident, size, pos) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        split = new.copy()
        split[1:] |= part[1:] != part[:-1]
        start, stop = ends(split), ends(new)
        total = np.concatenate(([0], np.cumsum(stop - start)))
        a = 0
        while a < len(token):
            b = max(a + 1, int(np.searchsorted(total, total[a] + (1 << 20), "right")) - 1)
            for low in range(0, int(total[b] - total[a]), 1 << 20):  # a row with many partners, in pieces
                n = np.arange(low, min(low + (1 << 20), int(total[b] - total[a]))) + total[a]
                x = np.searchsorted(total, n, "right") - 1
                y = start[x] + n - total[x]
                least = np.minimum(size[x] - pos[x], size[y] - pos[y])
                may = (size[x] * q >= p * size[y]) & (size[y] * q >= p * size[x]) & (least * (p + q) >= p * (size[x] + size[y]))
                found = np.unique(np.sort(np.stack((ident[x[may]], ident[y[may]])), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
            a = b

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy().astype(np.int64) for c in ("token", "part", "id", "size", "pos")]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))
            if whole or (held and held[-1][0][-1] != rows[0][0]):
                held.append([x[:whole] for x in rows])
                yield from pairs(*(np.concatenate(x) for x in zip(*held)))
                held = []
            held.append([x[whole:] for x in rows])
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    return work


def possible(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """``pairs`` without those whose parities differ in more bits than shingles of similar sets can."""
    p, q = similarity.numerator, similarity.denominator
    ends = [sets.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}")) for c in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differ = differing(batch.column("parity_a"), batch.column("parity_b"))
            size = batch.column("size_a").to_numpy().astype(np.int64) + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(differ * (p + q) <= (q - p) * size))

    return both.select("a", "b", "size_a", "size_b", "parity_a", "parity_b").mapInArrow(work, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """Those ``pairs (a, b)`` of set ids whose similarity is at least ``similarity``, counted from the texts."""
    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    versions = sets.join(needed, "id", "left_semi").select("id", "version")
    named = texts.select("version", "text").join(versions, "version").select("id", "text").dropDuplicates(["id"])
    both = pairs.join(named.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(named.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = tb.text_buffer(batch.column("text_a"))[1] + tb.text_buffer(batch.column("text_b"))[1]
            for at, to in tb.row_blocks(ends, _BLOCK):  # bounds memory
                part = batch.slice(at, to - at)
                (h, hb), (g, gb) = shingle_sets(part.column("text_a"), words), shingle_sets(part.column("text_b"), words)
                keep = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    x, y = h[hb[i] : hb[i + 1]], g[gb[i] : gb[i + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = common * similarity.denominator >= similarity.numerator * (len(x) + len(y) - common)
                yield part.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a long, b long")


def similar_sets(texts: DataFrame, words: int, similarity: float, scratch: Scratch, components, guesses=None) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, version, id)`` of each row of ``texts (doc_id, version, text)``, and ``(node, component)`` of similar sets.

    ``guesses`` makes pairs of ids worth a look first from ``(id, version)`` of
    each set; ``components`` joins links to parts.  Sets of no part are left out.
    """
    share = Fraction(str(similarity))
    shaped = scratch.put(shapes(texts, words, share, common_shingles(texts, words)), "shapes")
    # One text stands for each set: texts of one set have the same shingles.
    sets = scratch.put(shaped.drop("doc_id").dropDuplicates(["id"]), "sets")
    rows = sets.select("id", "size", F.posexplode("prefix").alias("pos", "token"))
    groups = scratch.put(rows.repartition("token").sortWithinPartitions("token").mapInArrow(_shared, "id long, size int, pos int, token long"), "groups")

    order = Window.partitionBy("token").orderBy(F.xxhash64("token", "id"))
    chain = groups.select("id", "size", F.lag("id").over(order).alias("other"), F.lag("size").over(order).alias("other_size"))
    chain = chain.where((F.least("size", "other_size") * share.denominator >= F.greatest("size", "other_size") * share.numerator) & F.col("other").isNotNull())
    first = chain.select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    if guesses is not None:
        first = first.unionByName(guesses(sets))
    first = scratch.put(possible(first.where("a <> b").distinct(), sets, share), "first_pairs")
    links = scratch.put(verified(first, sets, texts, words, share), "first_links")

    parts = components(links, scratch)
    labelled = groups.join(parts.select(F.col("node").alias("id"), F.col("component").alias("part")), "id", "left")
    labelled = labelled.select("token", F.coalesce("part", "id").alias("part"), "id", "size", "pos").repartition("token").sortWithinPartitions("token", "part")
    rest = labelled.mapInArrow(_pairs_of_groups(share), "a long, b long").distinct()
    rest = rest.join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = scratch.put(possible(rest, sets, share), "rest_pairs")
    more = scratch.put(verified(rest, sets, texts, words, share), "rest_links")
    return shaped.select("doc_id", "version", "id"), components(links.unionByName(more), scratch)
