import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, mixing, shingle_sets, simhash
from plumbline.llm.scratch import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def brute_leaks(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), ",".join(sorted(str(x) for x in found if x is not None))))
    return Counter(out)


def test_leaks_equal_brute_force(spark, documents, rows):
    long = rows[-7][1] if len(rows[-7][1] or "") > 1000 else next(r[1] for r in rows if r[0] == 300)
    items = [(1, "AA bb, cc dd ee ff gg hh ii jj kk ll"), (2, "short"), (2, "short"), (3, None), (4, ""), (5, " ".join(long.split()[500:530])), (None, "no id here"), (10, "Seed1 zz"), (6, "cc dd ee ff gg hh ii jj kk ll mm nn")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = documents.withColumn("items", F.lit("clash"))
    out = decontaminate.find_leaks(docs, bench)
    assert Counter((r.doc_id, r.n_words, r.n_hit, ",".join(sorted(r["items"]))) for r in out.collect()) == brute_leaks(rows, items)
    assert set(documents.columns) < set(out.columns)


def test_names_with_signs(spark, documents):
    from plumbline.llm import language_id

    odd = documents.where("doc_id < 20").withColumns({"a.b": F.lit(1), "a`b": F.lit(2), "a b": F.lit(3), "n": F.lit(4)})
    bench = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk ll")], "item_id long, text string")
    out = decontaminate.find_leaks(odd, bench)
    assert {(r["a.b"], r["a`b"], r["a b"], r.n) for r in out.collect()} == {(1, 2, 3, 4)} and out.where("n_hit > 0").count() == 2
    assert out.drop("n_words", "n_hit", "hit_spans", "items").columns == odd.columns
    named = language_id.identify(odd, language_id.train(documents))
    assert {(r["a.b"], r["a`b"], r["a b"], r.n) for r in named.collect()} == {(1, 2, 3, 4)} and named.columns == [*odd.columns, "lang_pred", "score"]
    assert {r.text for r in named.collect()} == {r.text for r in odd.collect()}


def test_leaks_of_nothing(documents, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(documents, none).where("n_hit > 0").count() == 0
    assert decontaminate.find_leaks(empty, none).count() == 0


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 2000).astype(np.uint64)
    other = np.concatenate((rng.integers(0, 2**63, 50).astype(np.uint64), h[70:80], rng.integers(0, 2**63, 50).astype(np.uint64)))
    start, at, prints = decontaminate.selected(h, np.array([0, 1000, 2000]), 10, 5)
    start_b, at_b, prints_b = decontaminate.selected(other, np.array([0, 110]), 10, 5)
    i, j = int(np.flatnonzero(start == 70)[0]), int(np.flatnonzero(start_b == 50)[0])
    assert prints[i] == prints_b[j] and at[i] - start[i] == at_b[j] - start_b[j]
    assert len(start) == 2 * 991 and len(set(at.tolist())) < 0.4 * len(start)  # few positions stand for all windows
    assert ((at >= start) & (at + 5 <= start + 10)).all() and len(set(prints) & set(prints_b)) <= 3


def test_leaks_come_through_the_joined_fingerprints(spark, documents, monkeypatch):
    bench = spark.createDataFrame([(1, "aa bb cc dd ee ff gg hh ii jj kk ll mm")], "item_id long, text string")
    assert decontaminate.find_leaks(documents, bench).where("n_hit > 0").count() > 0
    windows = decontaminate.benchmark_windows
    monkeypatch.setattr(decontaminate, "benchmark_windows", lambda *a: windows(*a).withColumn("fingerprint", F.col("fingerprint") + 1))
    assert decontaminate.find_leaks(documents, bench).where("n_hit > 0").count() == 0


def water_fill(sizes, weights, most=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    left = float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * level > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i], left = most * sizes[i], left - most * sizes[i]
        open_ -= over
    return target


def test_mix(documents, rows):
    out = mixing.mix(documents.withColumn("copies", F.lit("clash")), rows_per_bucket=7).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((doc, count(text)) for doc, text, *_ in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    want = water_fill([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))])
    for s, w in zip(order, want):
        assert math.isclose(target[s], w, rel_tol=1e-9)
        assert abs(taken[s] - w) <= 2 * max(r["size"] for r in out if r.source == s) + 1
    assert sum(taken.values()) <= sum(size.values())
    again = mixing.mix(documents, rows_per_bucket=3, keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in again) == Counter((r.doc_id, r["size"], r.taken) for r in out)


def brute_mix(rows, out):
    """Copies of each document by virtual finish times, from the definition, over all queues in one list."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    queues, entries = defaultdict(list), []
    for r in out:
        queues[r.source].append((r.order % 2**64, r.order, r.doc_id is not None, r.doc_id or 0, r["size"], r.target))
    budget = sum(count(t) for _, t, *_ in rows)
    for source, docs in queues.items():
        docs.sort()
        total = sum(d[4] for d in docs)
        for turn in range(3):
            upto = turn * total
            for _, order, _, _, size, target in docs:
                upto += size
                if size:
                    entries.append((upto / target, order, size))
    taken, used = Counter(), 0
    for _, order, size in sorted(entries):
        if used + size > budget:
            break
        used += size
        taken[order] += 1
    return taken


def test_mix_takes_the_front_of_all_queues(spark, documents, rows):
    distinct = documents.dropDuplicates(["doc_id", "text"])
    order = F.xxhash64(F.lit(7), F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))))
    out = mixing.mix(distinct.withColumn("order", order), rows_per_bucket=5).collect()
    want = brute_mix([(r.doc_id, r.text) for r in out], out)
    assert {r.order: r.copies for r in out if r.copies} == dict(want) and max(want.values()) > 1


def test_mix_of_nothing(documents, empty):
    assert mixing.mix(empty).count() == 0
    blank = mixing.mix(documents.where("doc_id in (200, 201, 202)")).collect()
    assert [r.taken for r in blank] == [0, 0, 0]


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius=4):
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates_equal_brute_force(documents, rows):
    out = simhash.near_duplicates(documents.withColumn("fingerprint", F.lit("clash")))
    prints = [brute_print(r[1]) for r in rows]
    parts = brute_components(prints)
    least = {}
    for p, r in zip(parts, rows):
        if r[0] is not None:
            least[p] = min(least.get(p, r[0]), r[0])
    got = Counter((r.doc_id, r.fingerprint & (2**64 - 1), r.component_id) for r in out.collect())
    assert got == Counter((r[0], f, least.get(p)) for r, f, p in zip(rows, prints, parts))
    assert len(set(parts)) < len(rows)


def test_keep_one(documents, empty):
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 not in ids and ids.count(301) == 2 and 200 in ids and 201 not in ids
    assert simhash.keep_one(empty).count() == 0


def brute_similar(texts, n=5, least=(4, 5)):
    """Parts of texts joined by Jaccard similarity of their shingles, each named by its first text."""
    sets = []
    for text in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) * least[1] >= least[0] * len(x | y):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    sets = []
    for size in (0, 1, 900, 1024, 1025, 3000, 9000):
        base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        sets += [base, np.unique(np.concatenate((base[: int(size * 0.95)], rng.integers(0, 2**63, size // 9).astype(np.uint64))))]
    size = np.array([len(x) for x in sets])
    parity = shingle_sets.parities(np.concatenate(sets), np.repeat(np.arange(len(sets)), size), size)
    a, b = np.triu_indices(len(sets))
    found = shingle_sets.differing(parity.take(pa.array(a)), parity.take(pa.array(b)))
    for i, j, n in zip(a, b, found):
        apart = len(np.setxor1d(sets[i], sets[j]))
        assert n <= apart and (n - apart) % 2 == 0
        if i // 2 != j // 2 and min(size[i], size[j]) > 500 and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j]):
            assert n * 9 > size[i] + size[j]  # unlike sets are told apart, however large


def test_keep_one_equals_brute_force_similarity(spark):
    rng = np.random.default_rng(5)
    texts = ["", " ", "one", "One", "a b c d", "a b c d e", "same words here and there"]
    for size in (5, 6, 9, 14, 30, 60, 200, 400):
        for _ in range(4):
            base = [f"w{x}" for x in rng.integers(0, 3000, size)]
            for changes in (0, 0, 1, 1, 2, 3, 5, 8, 12):
                w = list(base)
                for at in rng.integers(0, size, min(changes, size // 4)):
                    w[at] = f"x{rng.integers(0, 9999)}"
                texts.append(" ".join(w + [f"t{x}" for x in range(int(rng.integers(0, 3)))]))
    passage = " ".join(f"p{x}" for x in range(40))
    texts += [f"{passage} {' '.join(f'q{i}_{x}' for x in range(i))}" for i in range(40)]
    want = sorted(set(brute_similar(texts)))
    far = [i for i, p in enumerate(brute_components([brute_print(t) for t in texts])) if p == i]
    assert want != far  # four bits of 64 don't decide this
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_shards_lose_no_pair(spark, blocks):
    rng = np.random.default_rng(blocks)
    centres = rng.integers(0, 2**63, 6).astype(np.uint64)
    points = set()
    for c in centres:
        for _ in range(150):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            points.add(x)
    points = sorted(points)
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x,) for x in points], "fingerprint long")
    found = simhash.components(simhash.links(df, 4, blocks, leaf=16), Scratch(spark, "test"))
    got = {r.node: r.component for r in found.collect()}
    parts = brute_components(points)
    sign = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    groups, mine = defaultdict(set), defaultdict(set)
    for p, x in zip(parts, points):
        groups[p].add(sign(x))
        mine[got.get(sign(x), sign(x))].add(sign(x))
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


@pytest.mark.parametrize("leaf", [16, 1 << 20])
def test_vantage_points_prune(monkeypatch, leaf):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 120).astype(np.uint64)
    points = np.unique(np.concatenate((centres, centres[:40] ^ np.uint64(0b1011), rng.integers(0, 2**63, 240).astype(np.uint64))))
    asked, near = [], simhash._near
    monkeypatch.setattr(simhash, "_near", lambda x, y, r: asked.append(np.broadcast(x, y).size) or near(x, y, r))
    a, b = simhash._shard_parts(np.zeros(len(points), np.int64), points, 4, leaf)
    parts, joined = brute_components(points.tolist()), dict(zip(a.tolist(), b.tolist()))
    assert [joined.get(x, x) for x in points.tolist()] == [int(points[p]) for p in parts] and len(joined) >= 40
    assert sum(asked) < 0.85 * len(points) * (len(points) - 1) / 2  # the triangle bound leaves out the rest


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in simhash.components(edges, Scratch(spark, "chain")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[101] == 100


def test_common_shingles_come_from_the_same_part_at_any_size(spark):
    from plumbline.llm import shingle_sets

    texts = spark.createDataFrame([(16 * i + j, "one two three four five six") for i in range(10) for j in (0, 1)], "version long, text string")
    assert len(shingle_sets.common_shingles(texts, 5)) == 2
    assert len(shingle_sets.common_shingles(texts.where("version % 16 = 1"), 5)) == 0
