"""Language identification by words first, character n-grams for the rest.

A known word scores its log frequency in each language.  A word that training
never saw is covered position by position with the longest known n-gram that
starts there, and scores their mean.  The language with the largest sum over all
words of the text wins; its score is its share of the softmax of the sums.

A word is a run of letters (Unicode category L), each lower-cased by itself;
training and prediction cut texts by the same function.  Words and n-grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textbytes as tb
from plumbline.llm.scratch import Scratch, column, without

UNKNOWN = "und"
_BEGIN, _END = ord("^"), ord("$")
_TABLES: list[np.ndarray] = []


def crc_of(doc_id: Column) -> Column:
    """crc32 of a doc_id's text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def _tables() -> list[np.ndarray]:
    """For each code point: whether it is a letter, and its lower case (itself if that has several signs)."""
    if not _TABLES:
        letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            sign = chr(code)
            if unicodedata.category(sign)[0] == "L":
                letter[code] = True
                small = sign.lower()
                if len(small) == 1:
                    lower[code] = ord(small)
        _TABLES.extend((letter, lower))
    return _TABLES


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of some texts, starts and ends of words in them, and each text's first word."""
    letter, lower = _tables()
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    starts, ends, first = tb.spans(letter[codes], np.searchsorted(lead, offsets))
    return lower[codes], starts, ends, first


def _marked(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``^word$`` of some words one after the other, and where each begins (one more than words)."""
    size = ends - starts + 2
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(at[-1]), _END, np.uint32)
    out[at[:-1]] = _BEGIN
    within = np.arange(int((size - 2).sum())) - np.repeat(np.cumsum(size - 2) - (size - 2), size - 2)
    out[np.repeat(at[:-1] + 1, size - 2) + within] = codes[np.repeat(starts, size - 2) + within]
    return out, at


def _gram_hashes(line: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of n-grams inside words of ``line``, and their hashes."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(line))
    where = np.flatnonzero(left >= n)
    h = np.full(len(where), n, np.uint64)
    for j in range(n):
        h = (h + line[where + j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return where, tb.mix(h)


class Model:
    """Log frequencies of words and n-grams by language, each by sorted hash."""

    def __init__(self, langs: list[str], longest: int, words: tuple[np.ndarray, np.ndarray], grams: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.longest = langs, longest
        self.words, self.grams = self._sorted(*words), [self._sorted(*g) for g in grams]

    @staticmethod
    def _sorted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(hashes)
        logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(counts) + 1)))
        return hashes[order], logs[order]


def _find(hashes: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Places of ``hashes`` in a sorted array, -1 for those not there."""
    if not len(among):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
    return np.where(among[at] == hashes, at, -1)


def _by_backoff(model: Model, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Scores of unseen words: the mean over positions of the longest known n-gram from there."""
    logs = np.zeros((len(line), len(model.langs)))
    covered = np.zeros(len(line), bool)
    for n in range(model.longest, 0, -1):
        where, h = _gram_hashes(line, at, n)
        open_ = ~covered[where]
        where, h = where[open_], h[open_]
        hashes, known = model.grams[n - 1]
        found = _find(h, hashes)
        hit = found >= 0
        logs[where[hit]] = known[found[hit]]
        covered[where[hit]] = True
    many = np.add.reduceat(covered, at[:-1], dtype=np.int64)
    return np.add.reduceat(logs, at[:-1], axis=0) / np.maximum(many, 1)[:, None]


def _predict(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language of each text (-1: none) and its score."""
    codes, starts, ends, first = words_of(data, offsets)
    rows = len(offsets) - 1
    best, score = np.full(rows, -1), np.zeros(rows)
    has = np.flatnonzero(np.diff(first) > 0)
    if not len(has) or not model.langs:
        return best, score
    index, distinct = tb.factorize(tb.span_hashes(codes, starts, ends))
    at = _find(distinct, model.words[0])
    table = np.zeros((len(distinct), len(model.langs)))
    table[at >= 0] = model.words[1][at[at >= 0]]
    new = np.flatnonzero(at < 0)
    if len(new):
        example = np.zeros(len(distinct), np.int64)
        example[index[::-1]] = np.arange(len(index))[::-1]
        table[new] = _by_backoff(model, *_marked(codes, starts[example[new]], ends[example[new]]))
    total = np.add.reduceat(table[index], first[has], axis=0)
    best[has] = total.argmax(axis=1)
    score[has] = 1.0 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
    return best, score


def _summed(hashes: np.ndarray, lang: np.ndarray, times: np.ndarray, langs: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of hash and language with their summed times, and where each stands for the first time."""
    index, distinct = tb.factorize(hashes)
    pair, pairs = tb.factorize(index * langs + lang)
    example = np.zeros(len(pairs), np.int64)
    example[pair[::-1]] = np.arange(len(pair))[::-1]
    return distinct[pairs // langs], pairs % langs, np.bincount(pair, weights=times, minlength=len(pairs)).astype(np.int64), example


def _counted(n: int, hashes: np.ndarray, lang: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(hashes), n, np.int32), tb.signed(hashes), lang.astype(np.int32), times]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["n", "hash", "lang", "times"])


def _count_words(sample: DataFrame, longest: int, langs: list[str]) -> DataFrame:
    """``(n, hash, lang, times)`` of words (n = 0) and of n-grams in ``(lang, text)``, summed within batches."""

    place = {lang: i for i, lang in enumerate(langs)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.text_buffer(batch.column("text"))
            of_row = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for a, b in tb.row_blocks(offsets):  # bounds memory
                codes, starts, ends, first = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lang = np.repeat(of_row[a:b], np.diff(first))
                found, seen, times, example = _summed(tb.span_hashes(codes, starts, ends), lang, np.ones(len(starts)), len(langs))
                yield _counted(0, found, seen, times)
                line, at = _marked(codes, starts[example], ends[example])
                owner = np.repeat(np.arange(len(example)), np.diff(at))
                for n in range(1, longest + 1):
                    where, h = _gram_hashes(line, at, n)
                    yield _counted(n, *_summed(h, seen[owner[where]], times[owner[where]], len(langs))[:3])

    return sample.mapInArrow(work, "n int, hash long, lang int, times long").groupBy("n", "hash", "lang").agg(F.sum("times").alias("times"))


def train(documents: DataFrame, max_docs: int = 20_000, longest: int = 4) -> Model:
    """Fit on texts with a language; ``documents`` needs ``doc_id``, ``text``, ``lang``.

    At most about ``max_docs`` whole texts are used, chosen by a hash of doc_id
    and text; all their words and n-grams up to ``longest`` are kept.  Only the
    tables of this bounded sample reach the driver.
    """
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = min(1.0, max_docs / max(1, labelled.count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id", F.col("text")), 1) / F.lit(2.0**63)
    sample = Scratch(documents.sparkSession, "language-id").put((labelled.where(draw < share) if share < 1 else labelled).select("lang", "text"), "sample")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    counts = _count_words(sample, longest, langs).toArrow() if langs else None
    tables = []
    for n in range(longest + 1):
        if counts is None:
            tables.append((np.zeros(0, np.uint64), np.zeros((0, 0))))
            continue
        mine = np.flatnonzero(counts["n"].to_numpy() == n)
        index, hashes = tb.factorize(counts["hash"].to_numpy()[mine])
        table = np.zeros((len(hashes), len(langs)))
        table[index, counts["lang"].to_numpy()[mine]] = counts["times"].to_numpy()[mine]
        tables.append((hashes.view(np.uint64), table))
    return Model(langs, longest, tables[0], tables[1:])


def identify(documents: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) plus ``lang_pred`` and ``score`` (0 to 1).

    Only ``text`` is looked at, whole.  A null text or one without a letter is
    ``und`` with score 0, as is everything under a model that learned nothing.
    Ties go to the language first in code point order.  Repeated rows are judged
    each by itself; columns named like the added ones are replaced, others kept
    whatever their names.  Very long texts are scored whole.  An empty table gives
    no rows.
    """
    carry = without(documents.columns if carry is None else carry, ("lang_pred", "score"))
    plain = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*carry, "text"]))}  # names as tasks see them, whatever signs the real ones have
    fields = {f.name: f.dataType for f in documents.schema.fields}
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.langs, UNKNOWN], object)
        for batch in batches:
            data, offsets = tb.text_buffer(batch.column(plain["text"]))
            parts = [_predict(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value) for a, b in tb.row_blocks(offsets)]
            best, score = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0))
            made = [*(batch.column(plain[c]) for c in carry), pa.array(names[best], pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(made, [*(plain[c] for c in carry), "lang_pred", "score"])

    schema = T.StructType([*(T.StructField(plain[c], fields[c]) for c in carry), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = documents.select(*(column(c).alias(name) for c, name in plain.items())).mapInArrow(work, schema)
    return found.select(*(F.col(plain[c]).alias(c) for c in carry), "lang_pred", "score")


def training_rows(documents: DataFrame) -> DataFrame:
    """Documents to learn from: crc32 of the doc_id's text modulo 4 is not 2 (a null id is among them)."""
    return documents.where(F.coalesce(crc_of(F.col("doc_id")), F.lit(0)) % 4 != 2)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, train(training_rows(docs)), carry=["doc_id"])
    held_out = F.coalesce(crc_of(F.col("doc_id")), F.lit(0)) % 4 == 2
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
