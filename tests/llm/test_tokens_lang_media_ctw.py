import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import ctw, language_id, media_columns, pretokens, token_output


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_equal_the_library():
    rng = random.Random(5)
    texts = ["", None, "it's we'll 'tis I'M don't 'll", "a\n\nb  c \t d\n", "  lead", "trail  ", "12ab34", "!!'s ''s 's", "日本語 émigré's", "a<|endoftext|>b", " ", "\xa0x　y", "\U0001f600s"]
    texts += ["".join(rng.choice(" \n\t'sdtlremv.a1é-\xa0　") for _ in range(rng.randrange(40))) for _ in range(500)]
    enc = pretokens.PieceEncoder(PATH, most_pieces=50)
    for part in (texts[:200], texts[200:], texts[:9]):
        ids, sizes = enc.encode(pa.array(part))
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain(*want))


def test_shard_round_trip():
    rng = np.random.default_rng(0)
    for n, most in ((0, 5), (1, 5), (2000, 3), (5000, 50), (3000, 60000)):
        ids = rng.integers(0, most, n).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 6))
        sizes = np.diff(np.concatenate(([0], cuts, [n])))
        blob = token_output.compress(ids, sizes, 70000, rounds=6, min_count=2)
        shard = token_output.Shard(blob)
        got, bounds = shard.decode()
        assert (got == ids).all() and (np.diff(bounds) == sizes).all()
        for i in range(len(sizes)):
            whole = ids[bounds[i] : bounds[i + 1]]
            assert (shard.document(i) == whole).all() and (shard.document(i, 2, 9) == whole[2:9]).all()
    assert len(token_output.compress(np.tile(np.arange(8, dtype=np.uint32), 500), np.array([4000]), 100)) < 4000 * 4 / 2


def test_token_output_equals_the_library(documents, rows, empty):
    tokenizer, start, want = Tokenizer.from_file(PATH), 0, Counter()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for doc, text, *_ in order:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want[(doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        start += len(ids)
    for shard_ids in (1 << 18, 300):
        out = token_output.token_output(documents.withColumn("shard", F.lit("clash")), shard_ids=shard_ids)
        assert Counter(tuple(r) for r in out.collect()) == want
    assert token_output.token_output(empty).count() == 0


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 500, 300)
    parts = [np.concatenate((rng.integers(0, 40, rng.integers(0, 60)), passage[: rng.integers(0, 300)])) for _ in range(80)] + [np.zeros(37, int), np.zeros(0, int), np.tile([1, 2], 50)]
    ids, sizes = np.concatenate(parts).astype(np.uint32), np.array([len(x) for x in parts])
    shard = token_output.Shard(token_output.compress(ids, sizes, 500))
    found, bounds = shard.decode()
    assert found.tolist() == ids.tolist() and np.diff(bounds).tolist() == sizes.tolist()
    for i in (0, 79, 80, 81, 82):
        assert shard.document(i).tolist() == parts[i].tolist() and shard.document(i, 3, 9).tolist() == parts[i][3:9].tolist()
    pairs = Counter()
    for a, b in zip(shard.bounds[:-1], shard.bounds[1:]):
        seq, at = shard.seq[a:b].tolist(), 0
        while at + 1 < len(seq):
            pairs[seq[at], seq[at + 1]] += 1
            at += 2 if at + 2 < len(seq) and seq[at] == seq[at + 1] == seq[at + 2] else 1
    assert max(pairs.values()) < 6  # four or more that don't overlap would have been replaced
    assert len(shard.seq) < 0.5 * len(ids) and int(shard.length.max()) > 16
    few = token_output.Shard(token_output.compress(ids, sizes, 500, rounds=1))
    assert int(few.length.max()) == 2 and few.decode()[0].tolist() == ids.tolist()


def test_language(spark, documents, empty):
    rng = random.Random(1)
    words = {"en": ["the", "and", "of", "river", "stone"], "de": ["der", "und", "von", "fluss", "stein"], "fr": ["le", "et", "de", "rivière", "pierre"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(itertools.islice(itertools.cycle(words), 90))]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(0, "the RIVER and the stone", "en"), (1, "und der flussstein", "de"), (2, "rivièrement et pierres", "fr"), (3, None, "und"), (4, "12 !! ½", "und"), (5, "", "und"), (6, "q", None), (7, "stone " * 20000, "en")]
    df = spark.createDataFrame([(i, t) for i, t, _ in tests], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == want for i, _, want in tests if want) and all(0 <= r.score <= 1 for r in got.values())
    nothing = language_id.train(empty)
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"} and language_id.identify(empty, model).count() == 0


def brute_language(train, texts, longest=4):
    """Word-first backoff from the definition: ``(language, score)`` of each text."""
    letter = lambda x: unicodedata.category(x)[0] == "L"

    def cut(text):
        low = lambda x: x.lower() if len(x.lower()) == 1 else x
        return ["".join(map(low, g)) for k, g in itertools.groupby(text or "", letter) if k]

    langs = sorted({lang for _, lang in train})
    tables = [Counter() for _ in range(longest + 1)]
    for text, lang in train:
        for word in cut(text):
            tables[0][word, lang] += 1
            marked = f"^{word}$"
            for n in range(1, longest + 1):
                for i in range(len(marked) - n + 1):
                    tables[n][marked[i : i + n], lang] += 1
    size = [len({k for k, _ in t}) for t in tables]
    total = [{x: sum(n for (_, lang), n in t.items() if lang == x) for x in langs} for t in tables]
    seen = [{k for k, _ in t} for t in tables]

    def log(n, key, lang):
        return math.log((tables[n][key, lang] + 0.5) / (total[n][lang] + 0.5 * (size[n] + 1)))

    def word_log(word, lang):
        if word in seen[0]:
            return log(0, word, lang)
        marked, found = f"^{word}$", []
        for i in range(len(marked)):
            n = next((n for n in range(min(longest, len(marked) - i), 0, -1) if marked[i : i + n] in seen[n]), 0)
            if n:
                found.append(log(n, marked[i : i + n], lang))
        return sum(found) / len(found) if found else 0.0

    out = []
    for text in texts:
        words = cut(text)
        sums = [sum(word_log(w, lang) for w in words) for lang in langs]
        best = max(sums, default=0)
        out.append((langs[sums.index(best)], 1 / sum(math.exp(s - best) for s in sums)) if words else ("und", 0.0))
    return out


def test_language_equals_the_definition(spark):
    rng = random.Random(8)
    train = [("the river and İstanbul ΣΑΣ ⅷ x² Straße", "en"), ("der fluss und die Straße straße", "de"), ("la rivière et l'été", "fr"), ("the the stone", "en"), ("same same", "en"), ("same same", "de")]
    texts = ["the river", "Flussstraße", "étés", None, "", "12 ²", "zzzz qqqq", "same", "İSTANBUL σας", "中文 the", "a̐b", "x" * 6000] + ["".join(rng.choice("thedrivsß éΣσ") for _ in range(30)) for _ in range(40)]
    model = language_id.train(spark.createDataFrame([(i, *x) for i, x in enumerate(train)], "doc_id long, text string, lang string"))
    rows = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, score) in zip(rows, brute_language(train, texts)):
        assert r.lang_pred == lang and math.isclose(r.score, score, rel_tol=1e-6, abs_tol=1e-9), (r, lang, score)


def test_held_out_accuracy(spark):
    out = language_id.op8_language_id(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id")
    n, right = out.where("held_out").agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 20 and right / n >= 0.95


def test_interleaved_sequence_keeps_order_and_captions(spark):
    html = "<h1>T &amp; t</h1><p>one<img src='media:d1' alt='a'>two</p><figure><img src='media:d2'><figcaption>cap</figcaption></figure><script>no</script><p>three"
    found = media_columns.parse_page(html)
    assert [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in found] == [(0, "text", "T & t", None), (1, "text", "one", None), (2, "media", "d1", "a"), (3, "text", "two", None), (4, "media", "d2", "cap"), (5, "text", "three", None)]
    assert media_columns.parse_page(None) == []
    shape = lambda page: [(x["kind"][0], x["text"] or x["digest"], x["caption"]) for x in media_columns.parse_page(page)]
    assert shape('<p>a</p><figure><img src="x"><figcaption>cap <p>lost text</p><p>more</p>') == [("t", "a", None), ("m", "x", "cap"), ("t", "lost text", None), ("t", "more", None)]
    assert shape('<img src="x" alt="own"><figcaption>stray</figcaption><figure>no <figcaption>media</figcaption></figure>') == [("m", "x", "own"), ("t", "stray", None), ("t", "no", None), ("t", "media", None)]
    assert shape('<figure><img src="x"><img src="y" alt="old"><figcaption>both') == [("m", "x", "both"), ("m", "y", "both")]
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    features = spark.createDataFrame([("d1", 5), ("d1", 5)], "digest string, size int")
    out = media_columns.resolve(media_columns.interleave(pages, "page_id"), "page_id", features)
    assert {(r.pos, r.digest, r["size"]) for r in out.collect()} == {(2, "d1", 5), (4, "d2", None)}


def test_media_round_trip(documents, rows, empty):
    out = media_columns.text_media(documents.withColumn("digest", F.lit("clash"))).collect()
    want = Counter()
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        media = b"P5\n192 %d\n255\n" % (len(payload) // 192) + payload
        want[(doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in out) == want
    assert len({(r.payload_sha256, r.feature) for r in out}) == len({r.payload_sha256 for r in out})
    for r in out:
        text = next(t or "" for doc, t, *_ in rows if doc == r.doc_id and len((t or "").encode()) == r.n_bytes)
        lines = [x for x in (" ".join(x.split()) for x in text.replace("\x00", "").split("\n")) if x]
        assert r.caption == f"text of {'no id' if r.doc_id is None else r.doc_id}" and r.n_texts == len(lines) and r.pos == (1 if " ".join(text.split("\n")[0].split()) else 0)
        raw = text.encode()
        x = list(raw + b" " * (-len(raw) % 192 or (0 if raw else 192)))
        mean = sum(x) / len(x)
        std = math.sqrt(max(0.0, sum(v * v for v in x) / len(x) - mean * mean))
        step = sum(abs(x[i + 1] - x[i]) for i in range(len(x) - 1) if i % 192 != 191) / len(x)
        assert r.feature == f"h={len(x) // 192};mean={mean:.4f};std={std:.4f};min={min(x)};max={max(x)};step={step:.4f}"
    assert media_columns.text_media(empty).count() == 0


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


def brute_tree(texts, depth):
    """Counts of decisions by context and the weighted log probability of a node, straight from the definition."""
    before, after, counts = b"\xfe" * depth, b"\xff", Counter()
    for text in texts:
        data = before + text.translate(LOWER).encode() + after
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                node = 1
                for bit in f"{data[i]:08b}":
                    counts[(data[i - d : i], node, bit)] += 1
                    node = node * 2 + int(bit)
    children = {}
    for context, *_ in counts:
        if context:
            children.setdefault(context[1:], set()).add(context)

    def met(context, node):
        return counts[(context, node, "0")] + counts[(context, node, "1")] > 0

    def weighted(context, node, memo):
        if (context, node) not in memo:
            own = kt(counts[(context, node, "0")], counts[(context, node, "1")])
            if len(context) == depth:
                memo[(context, node)] = (own, own)
            else:
                below = sum(weighted(c, node, memo)[0] for c in children.get(context, ()))
                memo[(context, node)] = (np.logaddexp(own, below) - math.log(2), own - below)
        return memo[(context, node)]

    memo = {}

    def chance(context, node, bit):
        return (counts[(context, node, bit)] + 0.5) / (counts[(context, node, "0")] + counts[(context, node, "1")] + 1)

    def byte_log(data, i, byte):
        node, total = 1, 0.0
        for bit in f"{byte:08b}":
            path = [data[i - d : i] for d in range(depth + 1) if met(data[i - d : i], node)]
            p = chance(path[-1], node, bit) if path else 0.5
            for context in reversed(path[:-1]):
                beta = math.exp(min(700, weighted(context, node, memo)[1]))
                p = (beta * chance(context, node, bit) + p) / (beta + 1)
            total += math.log10(p)
            node = node * 2 + int(bit)
        return total

    def score(text):
        data = before + text.translate(LOWER).encode() + after
        return sum(byte_log(data, i, data[i]) for i in range(depth, len(data)))

    score.byte_log = byte_log
    return score


@pytest.mark.parametrize(("depth", "frequent", "chunk"), [(5, 1 << 20, 1 << 18), (3, 4, 1), (7, 4, 20)])
def test_ctw_equals_the_definition(spark, depth, frequent, chunk):
    rows = [(1, "abab abab"), (2, "abcabc été"), (3, None), (4, "ab ab zz\0"), (5, ""), (5, "Abab"), (None, "q"), (6, "Abab" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    train = [r for r in rows if r[0] != 4]
    score = brute_tree([t or "" for _, t in train], depth)
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]
    counts = Counter(x for _, t in train for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = ctw.score_texts(docs, F.col("doc_id").isNull() | (F.col("doc_id") != 4), depth, frequent, chunk).collect()
    assert len(out) == len(rows)
    want = sorted((str(d), round(score(t or ""), 3), len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 3), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n}


def test_ctw_is_a_distribution(spark):
    score = brute_tree(["abcabc", "été"], 3)
    data = b"\xfe\xfe\xfeab"
    assert math.isclose(sum(10 ** score.byte_log(data, 5, b) for b in range(256)), 1, rel_tol=1e-9)


def test_deeper_contexts_tell_more(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.col("doc_id") % 10 == 0
    total = [ctw.score_texts(docs, ~held, depth).where("doc_id % 10 = 0").agg(F.sum("score")).first()[0] for depth in (3, 5)]
    assert total[1] > total[0]


def test_ctw_takes_nothing(documents, empty):
    assert ctw.score_texts(empty, F.lit(True)).count() == 0
    untrained = ctw.score_texts(documents, F.lit(False)).where("doc_id = 301").first()
    assert untrained.train_tokens == 0 and untrained.n_known == 0
    size = max(len(x) for x in ("short", "other text of one id"))
    assert math.isclose(untrained.score, 8 * math.log10(0.5) * (len("short") + 1), rel_tol=1e-9) or math.isclose(untrained.score, 8 * math.log10(0.5) * (size + 1), rel_tol=1e-9)
