"""Token ids as Re-Pair compressed shards.

Documents are range-sorted by doc_id; each task encodes its range and cuts it
into shards of about ``shard_ids`` ids.  A shard's file replaces frequent id
pairs by nonterminals, round after round until none is left, and stores the rules with their
expansion lengths and where each document's symbols start, so that one document,
or a slice of it, is decoded without the rest.

File format (little-endian): magic ``RPS1``, then eight unsigned 32-bit numbers
(first nonterminal, rules, documents, symbols, ids, three zeros), then unsigned
32-bit arrays: rules' left symbols, right symbols, expansion lengths, documents'
first symbols (one more than documents), symbols.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import textbytes as tb
from plumbline.llm.pretokens import encoder
from plumbline.llm.scratch import Scratch

_MAGIC = b"RPS1"
_SLOTS = 18


def compress(ids: np.ndarray, sizes: np.ndarray, first_nonterminal: int, rounds: int | None = None, min_count: int = 4) -> bytes:
    """A shard's file from the ids of its documents, one after the other.

    Pairs never cross the end of a document.  All frequent pairs of a round are
    replaced at once, until none is left (or after ``rounds``).  In a round, pairs
    are told apart by a table of 2**18 slots; a pair that shares a slot with a
    later one waits for another round.  Occurrences that overlap are taken from
    the left.  A pair that is rare once stays so, so later rounds look only at
    pairs with a new symbol and at those that wait.
    """
    seq = ids.astype(np.int64)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    left, right, made = [], [], 0
    known, look = np.ones(first_nonterminal, np.int64), np.ones(len(seq), bool)
    while rounds is None or made < rounds:
        pos = np.flatnonzero(look[:-1] & ~last[:-1])
        if not len(pos):
            break
        made += 1
        code = (seq[pos] << 32) | seq[pos + 1]
        slot = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        owner = np.full(1 << _SLOTS, -1, np.int64)
        owner[slot] = code
        hit = owner[slot] == code
        many = np.bincount(slot[hit], minlength=1 << _SLOTS) >= min_count
        frequent = hit & many[slot]
        at, slot_at = pos[frequent], slot[frequent]
        look[:] = False
        look[pos[~hit]] = True
        if len(at):
            head = np.ones(len(at), bool)
            head[1:] = np.diff(at) > 1
            begin = at[head][np.cumsum(head) - 1]
            chosen = (at - begin) % 2 == 0
            often = np.bincount(slot_at[chosen], minlength=1 << _SLOTS) >= min_count
            chosen &= often[slot_at]
            used = np.flatnonzero(often)
            if len(used):
                look[at] = True
                at, slot_at = at[chosen], slot_at[chosen]
                name = np.zeros(1 << _SLOTS, np.int64)
                name[used] = np.arange(len(known), len(known) + len(used))
                a, b = owner[used] >> 32, owner[used] & 0xFFFFFFFF
                left.append(a)
                right.append(b)
                known = np.concatenate((known, known[a] + known[b]))
                seq[at] = name[slot_at]
                last[at] = last[at + 1]
                keep = np.ones(len(seq), bool)
                keep[at + 1] = False
                new = np.cumsum(keep)[at] - 1
                seq, last, look = seq[keep], last[keep], look[keep]
                look[new] = True
                look[np.maximum(new - 1, 0)] = True
    length = known[first_nonterminal:]
    ends = np.flatnonzero(last) + 1
    bounds = np.zeros(len(sizes) + 1, np.int64)
    bounds[1:][sizes > 0] = ends
    bounds = np.maximum.accumulate(bounds)
    arrays = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right)] + [length, bounds, seq]
    numbers = np.array([first_nonterminal, len(length), len(sizes), len(seq), len(ids), 0, 0, 0])
    return _MAGIC + b"".join(x.astype("<u4").tobytes() for x in (numbers, *arrays))


class Shard:
    """A shard's file, open for random access."""

    def __init__(self, blob: bytes):
        if blob[:4] != _MAGIC:
            raise ValueError("not a token shard")
        words = np.frombuffer(blob, "<u4", offset=4)
        self.base, rules, self.documents, symbols, self.n_ids = (int(x) for x in words[:5])
        cuts = np.cumsum([8, rules, rules, rules, self.documents + 1, symbols])
        self.left, self.right, self.length, self.bounds, self.seq = (words[a:b] for a, b in zip(cuts[:-1], cuts[1:]))

    def _lengths(self, seq: np.ndarray) -> np.ndarray:
        out = np.ones(len(seq), np.int64)
        rule = seq >= self.base
        out[rule] = self.length[seq[rule] - self.base]
        return out

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """The ids that some symbols stand for."""
        while len(seq) and int(seq.max()) >= self.base:
            rule = seq >= self.base
            at = np.cumsum(rule + 1)
            out = np.empty(int(at[-1]), np.uint32)
            out[at[~rule] - 1] = seq[~rule]
            name = seq[rule] - self.base
            out[at[rule] - 2], out[at[rule] - 1] = self.left[name], self.right[name]
            seq = out
        return seq

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document starts in them (one more than documents)."""
        size = self._lengths(self.seq)
        total = np.concatenate(([0], np.cumsum(size)))
        rule = self.seq >= self.base
        out = np.empty(int(total[-1]), np.uint32)
        out[total[:-1][~rule]] = self.seq[~rule]
        # Each rule is expanded once; its symbols are then copied from there.
        pool = self.expand(np.arange(self.base, self.base + len(self.length), dtype=np.uint32))
        begin, size = (np.cumsum(self.length, dtype=np.int64) - self.length)[self.seq[rule] - self.base], size[rule]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(total[:-1][rule], size) + within] = pool[np.repeat(begin, size) + within]
        return out, total[self.bounds]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of one document, from the symbols that hold them only."""
        seq = self.seq[self.bounds[i] : self.bounds[i + 1]]
        total = np.concatenate(([0], np.cumsum(self._lengths(seq))))
        stop = int(total[-1]) if stop is None else min(stop, int(total[-1]))
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = int(np.searchsorted(total, start, "right")) - 1, int(np.searchsorted(total, stop, "left"))
        return self.expand(seq[a:b])[start - total[a] : stop - total[a]]


_SHARDS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("ids_before", T.LongType()),
    T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("blob", T.BinaryType()),
])


def write_shards(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 18, rounds: int | None = None, min_count: int = 4) -> None:
    """Encode ``documents`` (``doc_id``, ``text``) to shards in ascending doc_id order.

    ``tokenizer`` is the path of a tokenizers file that every executor has.  Each
    document ends with ``end_id``; null text has nothing else.  Null doc_ids come
    first, equal ones stay together as separate documents, other columns are not
    written.  An empty table writes an empty folder of shards.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        base = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        held_ids, held_sizes, held_docs, size, before, shard = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held_sizes, held_docs, size, before, shard
            blob = compress(np.concatenate(held_ids), np.concatenate(held_sizes), base, rounds, min_count)
            row = {"part": part, "shard": shard, "ids_before": before, "n_ids": size, "doc_ids": held_docs, "blob": blob}
            before, shard = before + size, shard + 1
            held_ids, held_sizes, held_docs, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        def parts() -> Iterator[pa.RecordBatch]:  # bounds memory
            for batch in batches:
                for a, b in tb.row_blocks(tb.text_buffer(batch.column("text"))[1]):
                    yield batch.slice(a, b - a)

        for batch in parts():
            ids, sizes = enc.encode(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            ends = np.cumsum(sizes)
            ids, sizes = np.insert(ids, ends, end_id).astype(np.uint32), sizes + 1
            ends = np.cumsum(sizes)
            a = 0
            while a < len(docs):
                done = int(ends[a - 1]) if a else 0
                b = min(int(np.searchsorted(ends, done + shard_ids - size)) + 1, len(docs))
                held_ids.append(ids[done : int(ends[b - 1])])
                held_sizes.append(sizes[a:b])
                held_docs.extend(docs[a:b])
                size += int(ends[b - 1]) - done
                if size >= shard_ids:
                    yield flush()
                a = b
        if held_docs:
            yield flush()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(work, _SHARDS).write.option("compression", "zstd").mode("overwrite").parquet(path)


_ARROW = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("blob", pa.binary()),
])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the shards at ``path``: where it starts, its size and checksum.

    The only thing the driver sees is one total per writing task.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part], at = at, at + n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, docs, blob in zip(*(batch.column(c) for c in ("part", "ids_before", "doc_ids", "blob"))):
                shard = Shard(blob.as_py())
                ids, bounds = shard.decode()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                start = bounds[:-1].astype(np.int64) + before.as_py() + base[part.as_py()]
                yield pa.RecordBatch.from_pydict({"doc_id": docs.values, "start": pa.array(start), "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())})

    return shards.select("part", "ids_before", "doc_ids", "blob").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, tokenizer: str | None = None, end_id: int = 2, **options) -> DataFrame:
    """Write the shards to the shared folder, read them back and describe each document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = documents.sparkSession
    path = Scratch(spark, "token-output").path("shards")
    write_shards(documents, path, tokenizer, end_id, **options)
    return read_shards(spark, path)


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
