"""LM scoring by context-tree weighting over bytes.

A byte is eight binary decisions; a decision's context is the bits of the byte so
far and the bytes before it, at every depth from none to ``depth``.  Each node of
the context tree keeps a Krichevsky-Trofimov estimate, and a node's weighted
probability is the even mix of its own estimate and the product of its
children's.  Block probabilities depend on counts alone, so the tree comes from
counts of byte sequences (``depth`` bytes and the next one) over the whole
training corpus.  A text's score is log10 of the probabilities of its bytes, A-Z
lower-cased, and of its end; a decision never met in a context predicts as in the
longest part of the context where it was met, and evenly if it never was.

The tree stays in Spark.  Sequences are dealt by the two bytes nearest to the
decision and sorted, so each task builds whole subtrees from the leaves up; the
three levels at the root are sums over those.  Then every distinct sequence of
the corpus gets its probability, from the root down.  Sequences and words that
are frequent everywhere are scored off tables of bounded size in one pass over
the texts; only the rare ones are joined by hash.

Beside it stands a unigram word baseline with exact counts of every training word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch

_WORD = tb.nonspace_table()
_WORDS, _GRAMS, _TEXTS = 0, 1, 2
#: Bytes that no UTF-8 text has: before a text, and its end.
_BEFORE, _END = 0xFE, 0xFF
_BYTE, _U8 = np.uint64(255), np.uint64(8)


def sequences(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of every byte and of each text's end with the bytes before it, and the texts' bounds in it.

    From the top: the nearest byte before, the one before that, and so on to the
    farthest, then the byte itself; so a context of fewer bytes is a prefix.
    """
    sizes, rows = np.diff(offsets), len(offsets) - 1
    padded = np.full(len(data) + (depth + 1) * rows, _BEFORE, np.uint64)
    padded[np.arange(len(data)) + np.repeat((depth + 1) * np.arange(rows) + depth, sizes)] = data
    padded[offsets[1:] + (depth + 1) * np.arange(rows) + depth] = _END
    code = padded[depth:].copy()
    for j in range(1, depth + 1):
        code |= padded[depth - j : len(padded) - j] << np.uint64(8 * (depth - j + 1))
    real = np.ones(len(padded), bool)
    firsts = offsets[:-1] + (depth + 1) * np.arange(rows)
    for j in range(depth):
        real[firsts + j] = False
    return code[real[depth:]], offsets + np.arange(rows + 1)


class _Tally:
    """Summed pairs of counts by key, held until there are many."""

    def __init__(self, kind: int, most: int = 1 << 21):
        self.kind, self.most, self.held, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray, n: np.ndarray, seen: np.ndarray) -> None:
        self.held.append((keys, n, seen))
        self.size += len(keys)
        if self.size > self.most:
            keys, n, seen = (np.concatenate(x) for x in zip(*self.held))
            index, keys = pd.factorize(keys)
            self.held = [(keys, *(np.bincount(index, weights=x, minlength=len(keys)).astype(np.int64) for x in (n, seen)))]
            self.size = len(keys)

    def full(self) -> bool:
        return self.size > self.most // 2

    def take(self) -> pa.RecordBatch:
        held, self.held, self.size = self.held or [(np.zeros(0, np.int64),) * 3], [], 0
        keys, n, seen = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), self.kind, np.int32)), *map(pa.array, (keys, n, seen))], ["kind", "key", "n", "seen"])


def corpus_counts(documents: DataFrame, depth: int) -> DataFrame:
    """``(kind, key, n, seen)`` of ``documents (text, training)``: words by hash, sequences by code, and the number of texts.

    ``n`` counts in training texts, ``seen`` in all.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = [_Tally(_WORDS), _Tally(_GRAMS)]
        for batch in batches:
            data, offsets = tb.text_buffer(batch.column("text"))
            learn = batch.column("training").to_numpy(zero_copy_only=False)
            for a, b in tb.row_blocks(offsets, 1 << 21):
                part, offs = tb.LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
                starts, ends, first = tb.spans(_WORD[part], offs)
                code, bounds = sequences(part, offs, depth)
                for tally, values, cuts in ((tallies[0], tb.span_hashes(part, starts, ends), first), (tallies[1], code, bounds)):
                    index, keys = pd.factorize(tb.signed(values))
                    n = np.bincount(index, weights=np.repeat(learn[a:b], np.diff(cuts)), minlength=len(keys)).astype(np.int64)
                    tally.add(keys, n, np.bincount(index, minlength=len(keys)))
            for tally in tallies:
                if tally.full():
                    yield tally.take()
            texts = [np.array([x], np.int64) for x in (0, int(learn.sum()), len(learn))]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_TEXTS], np.int32)), *map(pa.array, texts)], ["kind", "key", "n", "seen"])
        yield from (tally.take() for tally in tallies)

    rows = documents.select("text", "training").mapInArrow(work, "kind int, key long, n long, seen long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers (Stirling's series after a shift by 8)."""
    shift = np.zeros_like(x)
    for j in range(8):
        shift += np.log(x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = 4096
_HALVES, _WHOLES = _log_gamma(np.arange(_SMALL) + 0.5), _log_gamma(np.arange(_SMALL) + 1.0)


def _gammas(counts: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(counts, _SMALL - 1).astype(np.int64)]
    large = counts >= _SMALL
    out[large] = _log_gamma(counts[large] + plus)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a node's decisions by Krichevsky and Trofimov."""
    return _gammas(zeros, _HALVES, 0.5) + _gammas(ones, _HALVES, 0.5) - _gammas(zeros + ones, _WHOLES, 1.0) - np.log(np.pi)


class Nodes:
    """The nodes of one depth and one bit of the byte, by sorted name: the context, then the decision (1 to 255)."""

    def __init__(self, names: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None):
        self.names, self.zeros, self.ones = names, zeros, ones
        self.chance = (ones + 0.5) / (zeros + ones + 1)
        own = estimate(zeros, ones)
        if below is None:
            self.log, self.weight = own, np.ones(len(names))
        else:
            children = np.bincount(np.searchsorted(names, below[0]), weights=below[1], minlength=len(names))
            self.log = np.logaddexp(own, children) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(children - own, -700, 700)))

    def above(self) -> np.ndarray:
        """Names of the same decisions in the context without its farthest byte."""
        return _shorter(self.names)


def _shorter(names: np.ndarray) -> np.ndarray:
    return (names >> np.uint64(16) << _U8) | (names & _BYTE)


def _heads(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _decision(byte: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """A byte's ``j``-th decision, and whether it is a one."""
    return (np.uint64(256) + byte) >> np.uint64(8 - j), (byte >> np.uint64(7 - j)) & np.uint64(1)


def subtrees(code: np.ndarray, n: np.ndarray, depth: int, least: int) -> dict[int, list[Nodes]]:
    """Nodes of depths ``least`` to ``depth``, for each of eight bits, from sequences and their counts."""
    order = np.argsort(code)
    code, n, out, below = code[order], n[order].astype(float), {}, [None] * 8
    for d in range(depth, least - 1, -1):
        if d < depth:
            code = _shorter(code)
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
            head = _heads(code)
            code, n = code[head], np.add.reduceat(n, head) if len(head) else n
        out[d] = []
        for j in range(8):
            decision, one = _decision(code & _BYTE, j)
            names = (code & ~_BYTE) | decision
            head = _heads(names)
            total, ones = (np.add.reduceat(x, head) if len(head) else x for x in (n, n * one))
            out[d].append(Nodes(names[head], total - ones, ones, below[j]))
        below = [(x.above(), x.log) for x in out[d]]
    return out


def _find(names: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``names`` a sorted array has, and where."""
    if not len(among):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(among, names), len(among) - 1)
    return among[at] == names, at


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], group: Callable, size: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows in pieces of about ``size`` that no group crosses."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
        rows += batch.num_rows
        if rows >= size:
            whole = [np.concatenate(x) for x in zip(*held)]
            key = group(*whole)
            cut = np.flatnonzero(key[1:] != key[:-1])
            if len(cut):
                yield [x[: cut[-1] + 1] for x in whole]
                whole = [x[cut[-1] + 1 :] for x in whole]
            held, rows = [whole], len(whole[0])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _pair(key: Column, depth: int) -> Column:
    """The two bytes nearest to the decision."""
    return F.shiftrightunsigned(key, 8 * (depth - 1)).bitwiseAND(F.lit(0xFFFF)).cast("int")


def _level_two(grams: DataFrame, depth: int, chunk: int) -> DataFrame:
    """``(name, zeros, ones, below)`` of the decisions in contexts of two bytes, from the subtrees of three."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _chunks(batches, ["key", "n"], lambda key, n: key.view(np.uint64) >> np.uint64(8 * (depth - 2)), chunk):
            for nodes in subtrees(key.view(np.uint64), n, depth, 3)[3]:
                names = nodes.above()
                index, names = pd.factorize(names)
                sums = [np.bincount(index, weights=x, minlength=len(names)) for x in (nodes.zeros, nodes.ones, nodes.log)]
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(names)), *map(pa.array, sums)], ["name", "zeros", "ones", "below"])

    dealt = grams.select("key", "n").repartition(_pair(F.col("key"), depth)).sortWithinPartitions("key")
    return dealt.mapInArrow(work, "name long, zeros double, ones double, below double")


def _weighed(sums: DataFrame) -> DataFrame:
    """``(name, zeros, ones, log, chance, weight)`` from sums of a level, one row per name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, zeros, ones, below = (batch.column(c).to_numpy() for c in ("name", "zeros", "ones", "below"))
            own = estimate(zeros, ones)
            made = [np.logaddexp(own, below) - np.log(2), (ones + 0.5) / (zeros + ones + 1), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (name, zeros, ones, *made)], ["name", "zeros", "ones", "log", "chance", "weight"])

    summed = sums.groupBy("name").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
    return summed.mapInArrow(work, "name long, zeros double, ones double, log double, chance double, weight double")


def _name_above(name: Column) -> Column:
    return F.shiftleft(F.shiftright(name, 16), 8).bitwiseOR(name.bitwiseAND(F.lit(255)))


def root_levels(grams: DataFrame, depth: int, chunk: int, scratch: Scratch) -> list[DataFrame]:
    """``(name, stop, done, left)`` of the decisions in contexts of none, one and two bytes.

    ``stop`` is the chance of a one if the context is followed no further;
    ``done`` and ``left`` are the mix down to here and the weight still to give.
    """
    levels = [scratch.put(_weighed(_level_two(grams, depth, chunk)), "level_2")]
    for d in (1, 0):
        up = levels[0].select(_name_above(F.col("name")).alias("name"), "zeros", "ones", F.col("log").alias("below"))
        levels.insert(0, scratch.put(_weighed(up), f"level_{d}"))
    out = []
    for d, level in enumerate(levels):
        if d:
            before = out[-1].select(F.col("name").alias("up"), F.col("done").alias("before"), F.col("left").alias("weight_left"))
            level = level.withColumn("up", _name_above(F.col("name"))).join(before, "up")
        else:
            level = level.withColumn("before", F.lit(0.0)).withColumn("weight_left", F.lit(1.0))
        stop = F.col("before") + F.col("weight_left") * F.col("chance")
        done = F.col("before") + F.col("weight_left") * F.col("weight") * F.col("chance")
        out.append(scratch.put(level.select("name", stop.alias("stop"), done.alias("done"), (F.col("weight_left") * (1 - F.col("weight"))).alias("left")), f"root_{d}"))
    return out


def _fallback(root: DataFrame, one: DataFrame) -> np.ndarray:
    """Chance of a one by nearest byte and decision; at most 255 and 65,280 rows reach the driver."""
    out = np.full((256, 256), 0.5)
    top, below = root.toArrow(), one.toArrow()
    out[:, top["name"].to_numpy() & 255] = top["stop"].to_numpy()
    out[below["name"].to_numpy() >> 8, below["name"].to_numpy() & 255] = below["stop"].to_numpy()
    return out


def _probabilities(code: np.ndarray, n: np.ndarray, known: list[np.ndarray], fallback: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of the last byte of each sequence, given the level of two bytes ``known (names, stop, done, left)``."""
    trained = n > 0
    tree = subtrees(code[trained], n[trained], depth, 3)
    total, byte = np.zeros(len(code)), code & _BYTE
    nearest = (code >> np.uint64(8 * depth)).astype(np.int64)
    for j in range(8):
        decision, one = _decision(byte, j)
        chance = fallback[nearest, decision.astype(np.int64)]
        names, stop, done, left = known
        for d in range(2, depth + 1):
            if d > 2:
                nodes = tree[d][j]
                _, at = _find(nodes.above(), names)
                names, before, rest = nodes.names, done[at], left[at]
                stop = before + rest * nodes.chance
                done, left = before + rest * nodes.weight * nodes.chance, rest * (1 - nodes.weight)
            met, at = _find((code >> np.uint64(8 * (depth - d + 1)) << _U8) | decision, names)
            chance = np.where(met, stop[at] if len(stop) else 0.5, chance)
        total += np.log10(np.where(one == 1, chance, 1 - chance))
    return total


def sequence_scores(grams: DataFrame, depth: int, scratch: Scratch, chunk: int = 1 << 18) -> DataFrame:
    """``(key, seen, score)`` of all ``grams (key, n, seen)``: log10 probability of the last byte after the others.

    Rows are dealt by the two nearest bytes, at most 65,536 groups of distinct
    sequences; tasks take them ``chunk`` by ``chunk``, cut between contexts of three.
    """
    levels = root_levels(grams.where("n > 0"), depth, chunk, scratch)
    shared = grams.sparkSession.sparkContext.broadcast(_fallback(levels[0], levels[1]))
    none = [F.lit(None).cast("double").alias(c) for c in ("stop", "done", "left")]
    known = levels[2].select(F.shiftright("name", 8).cast("int").alias("pair"), F.lit(0).alias("kind"), F.col("name").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("seen"), "stop", "done", "left")
    rows = known.unionByName(grams.select(_pair(F.col("key"), depth).alias("pair"), F.lit(1).alias("kind"), "key", "n", "seen", *none))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(pair, kind, key, *_):
            return np.where(kind == 0, -1 - pair.astype(np.int64), (key.view(np.uint64) >> np.uint64(8 * (depth - 2))).astype(np.int64))

        held = [np.zeros(0, np.int64), *[np.zeros(0)] * 3, np.zeros(0, np.int32)]
        for pair, kind, key, n, seen, stop, done, left in _chunks(batches, ["pair", "kind", "key", "n", "seen", "stop", "done", "left"], group, chunk):
            top, gram = kind == 0, kind == 1
            held = [np.concatenate(x) for x in zip(held, (key[top], stop[top], done[top], left[top], pair[top]))]
            order = np.argsort(held[0].view(np.uint64))
            level = [held[0].view(np.uint64)[order], *(x[order] for x in held[1:4])]
            score = _probabilities(key[gram].view(np.uint64), n[gram], level, shared.value, depth)
            yield pa.RecordBatch.from_arrays([pa.array(key[gram]), pa.array(seen[gram]), pa.array(score)], ["key", "seen", "score"])
            last = held[4] == pair[-1]
            held = [x[last] for x in held]

    dealt = rows.repartition("pair").sortWithinPartitions("pair", "kind", "key")
    return dealt.mapInArrow(work, "key long, seen long, score double")


def most_frequent(counts: DataFrame, most: int, by: str = "n") -> DataFrame:
    """Rows with a count above a threshold that leaves at most ``most`` of them.

    The threshold comes from a histogram of counts in 16 bins per doubling, so
    no task sorts or gathers more than its own rows.
    """
    level = F.floor(F.log2(F.col(by).cast("double")) * 16)
    bins = counts.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for row in bins:
        taken += row["rows"]
        if taken > most:
            break
        least = row["level"]
    return counts.where(level >= least) if least is not None else counts.limit(0)


class Frequent:
    """Values of the most frequent keys, by sorted key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are frequent, and their values (0 for others)."""
        met, at = _find(keys, self.keys)
        return met, np.where(met, self.values[at] if len(self.values) else 0.0, 0.0)


_SCORED = "doc_id long, version long, row long, n_tokens long, n_known long, base double, score double, words array<long>, word_times array<int>, grams array<long>, gram_times array<int>"


def _sums(values: np.ndarray, bounds: np.ndarray, table: Frequent) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Per text: the number of frequent keys, the sum of their values, and the other keys with how often each occurs."""
    rows = len(bounds) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    index, distinct = pd.factorize(tb.signed(values))
    met, value = table.find(distinct)
    many, total = (np.bincount(owner, weights=x[index], minlength=rows) for x in (met, value))
    rare = np.flatnonzero(~met[index])
    width = max(1, len(distinct))
    pairs, times = np.unique(owner[rare] * width + index[rare], return_counts=True)
    cuts = pa.array(np.searchsorted(pairs // width, np.arange(rows + 1)).astype(np.int32))
    return many.astype(np.int64), total, pa.ListArray.from_arrays(cuts, pa.array(distinct[pairs % width])), pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32)))


def _score_block(batch: pa.RecordBatch, words: Frequent, grams: Frequent, depth: int, first_row: int) -> pa.RecordBatch:
    data, offsets = tb.text_buffer(batch.column("text"))
    data, n = tb.LOWER[data], len(offsets) - 1
    starts, ends, first = tb.spans(_WORD[data], offsets)
    known, base, rare_words, word_times = _sums(tb.span_hashes(data, starts, ends), first, words)
    _, score, rare_grams, gram_times = _sums(*sequences(data, offsets, depth), grams)
    columns = [batch.column("doc_id"), batch.column("version"), *map(pa.array, (np.arange(first_row, first_row + n), np.diff(first) + 1, known, base, score)), rare_words, word_times, rare_grams, gram_times]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCORED.split(", ")])


def _scored(rows: DataFrame, words: Frequent, grams: Frequent, depth: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    shared_words, shared_grams = context.broadcast(words), context.broadcast(grams)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in tb.row_blocks(tb.text_buffer(batch.column("text"))[1], 1 << 21):  # bounds memory
                yield _score_block(batch.slice(a, b - a), shared_words.value, shared_grams.value, depth, at)
                at += b - a

    return rows.mapInArrow(work, _SCORED)


def score_texts(documents: DataFrame, training: Column, depth: int = 5, frequent: int = 1 << 20, chunk: int = 1 << 18) -> DataFrame:
    """``(doc_id, version, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``training`` says which rows to learn from.  Tokens are words with A-Z
    lower-cased and one end.  ``depth`` (3 to 7) is the number of bytes of the
    longest context.  ``frequent`` bounds each of the two tables that executors
    get (16 bytes a row); all other words and sequences are joined.  Null text is
    empty and has its end only.  Repeated rows are scored each by itself and
    count again in training.  With nothing to learn from, all counts are 0 and
    bytes even.  Very long texts are scored whole, slice by slice.  An empty table
    gives no rows.  Further columns are left.
    """
    if not 3 <= depth <= 7:
        raise ValueError("depth must be 3 to 7")
    scratch = Scratch(documents.sparkSession, "ctw")
    text = F.coalesce("text", F.lit(""))
    learn = F.coalesce(training, F.lit(False))
    counts = scratch.put(corpus_counts(documents.select(text.alias("text"), learn.alias("training")), depth), "counts", "kind")
    word_counts = counts.where((F.col("kind") == _WORDS) & (F.col("n") > 0)).select("key", "n")
    n_words, distinct = word_counts.agg(F.sum("n"), F.count("*")).first()
    texts = counts.where(F.col("kind") == _TEXTS).agg(F.sum("n")).first()[0] or 0
    train_tokens, vocabulary = (n_words or 0) + texts, distinct + (texts > 0)
    top = most_frequent(word_counts, frequent >> 2).toArrow()
    words = Frequent(top["key"].to_numpy(), np.log10(top["n"].to_numpy() + 0.1) + 1)

    gram_scores = scratch.put(sequence_scores(counts.where(F.col("kind") == _GRAMS).select("key", "n", "seen"), depth, scratch, chunk), "sequences")
    top = most_frequent(gram_scores, frequent, "seen").select("key", "score").toArrow()
    grams = Frequent(top["key"].to_numpy(), top["score"].to_numpy())
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    scored = scratch.put(_scored(rows, words, grams, depth), "scored")

    def rare(kind: int, keys: str, times: str) -> DataFrame:
        return scored.select("row", F.explode(F.arrays_zip(keys, times)).alias("x")).select("row", F.lit(kind).alias("kind"), F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    word_values = word_counts.select(F.lit(_WORDS).alias("kind"), "key", (F.log10(F.col("n") + 0.1) + 1).alias("value"))
    values = word_values.unionByName(gram_scores.select(F.lit(_GRAMS).alias("kind"), "key", F.col("score").alias("value")))
    found = rare(_WORDS, "words", "word_times").unionByName(rare(_GRAMS, "grams", "gram_times")).join(values, ["kind", "key"])
    word = F.col("kind") == _WORDS
    found = found.groupBy("row").agg(
        F.sum(F.when(word, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.when(word, F.col("times") * F.col("value")).otherwise(0.0)).alias("gain"),
        F.sum(F.when(word, 0.0).otherwise(F.col("times") * F.col("value"))).alias("more_score"),
    )
    out = scored.drop("words", "word_times", "grams", "gram_times").join(found, "row", "left").na.fill(0, ["more_known", "gain", "more_score"])
    # A word scores -1 until a gain says otherwise: log10(0 + 0.1).
    base = F.col("base") + F.col("gain") - (F.col("n_tokens") - 1) + float(np.log10(texts + 0.1)) - F.col("n_tokens") * float(np.log10(train_tokens + 0.1 * (vocabulary + 1)))
    known = F.col("n_known") + F.col("more_known") + int(texts > 0)
    return out.select("doc_id", "version", "n_tokens", known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("more_score")).alias("score"))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(1)) % 10
    out = score_texts(docs, crc != 0)
    return out.select("doc_id", (crc == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
