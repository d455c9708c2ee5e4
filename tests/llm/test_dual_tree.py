import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plumbline.llm import dual_tree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, (text or "").translate(LOWER))


def brute(docs, items, k):
    """Full scan by the definition; documents without an id come first among equals."""
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // total
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if t in bag)
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, i + 1, d if there else None, -s) for i, (s, there, d) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_equals_full_scan(spark, documents, rows):
    long = next(r[1] for r in rows if r[0] == 300)
    items = [(1, "The1 of2 ring3 stone4"), (1, "wall5 wall5 wall5 x17"), (2, None), (3, ""), (4, "nothing here matches"), (5, long), (None, "no id here"), (6, "émigré's 日本語 12"), (7, "aa bb cc dd ee ff gg hh ii jj kk ll mm")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2), "a.b": F.lit(3)})
    docs = documents.withColumns({"rank": F.lit("x"), "a.b": F.lit(1), "number": F.lit(2)})
    want = brute([(r[0], r[1]) for r in rows], items, 20)
    assert found(dual_tree.rank(docs, bench)) == want
    assert found(dual_tree.rank(docs, bench, block_bytes=200)) == want  # each item a block or so
    assert found(dual_tree.rank(docs, bench, k=3)) == brute([(r[0], r[1]) for r in rows], items, 3)


def test_of_nothing(spark, documents, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the1 of2")], "item_id long, text string")
    assert dual_tree.rank(documents, none).count() == 0
    assert dual_tree.rank(empty, some).count() == 0
    assert dual_tree.rank(empty, none).count() == 0


def _batch(vectors, ids):
    lists = [pa.array([[t for t, _ in v] for v in vectors], pa.list_(pa.int32())), pa.array([[x for _, x in v] for v in vectors], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], ["doc_id", "terms", "value"])


def test_bounds_prune_whole_nodes_and_lose_nothing():
    """Documents of eight vocabularies: most pairs of nodes fall, ties and lists are those of a full scan."""
    rng = random.Random(5)
    topics = [[f"t{a}w{i}" for i in range(60)] for a in range(8)]
    asked = [" ".join(rng.choices(topics[i % 8], k=12)) for i in range(64)]
    items = dual_tree.Items.of(pa.table({"number": list(range(64)), "text": asked}))
    word = {int(h): i for i, h in enumerate(items.vocabulary)}
    names = [np.array([next(dual_tree._terms(pa.array([w])))[1][0] for w in t]) for t in topics]
    known = [[word[int(h)] for h in t if int(h) in word] for t in names]
    docs = [sorted((t, rng.choice((5, 9, 400))) for t in rng.sample(known[i * 8 // 2000], 10)) for i in range(2000)]
    run = dual_tree._Search(items, np.zeros(64, np.int64), 5, np.float64)
    for a in (0, 1000):
        run.whole(dual_tree._Batch(_batch(docs[a : a + 1000], list(range(a, a + 1000))), np.float64))
    dense = np.zeros((2000, len(word)))
    for i, d in enumerate(docs):
        dense[i, [t for t, _ in d]] = [x for _, x in d]
    scores = (items.levels[0] @ dense.T).astype(np.int64)
    for i in range(64):
        best = np.lexsort((np.arange(2000), -scores[i]))[:5]
        assert run.score[i].tolist() == scores[i][best].tolist() and run.doc[i].tolist() == best.tolist()
    assert run.scored < 64 * 2000 / 4, "node pairs must be dropped by their bounds"


def test_maxima_bound_every_score():
    docs = [[(t, (i * 7 + t) % 50 + 1) for t in range(i % 5, 20, 3)] for i in range(300)]
    batch = dual_tree._Batch(_batch(docs, list(range(300))), np.float64)
    for level, (starts, idx, value) in enumerate(batch.levels):
        step = 16 * 8**level
        for node in range(len(starts) - 1):
            got = dict(zip(idx[starts[node] : starts[node + 1]].tolist(), value[starts[node] : starts[node + 1]].tolist()))
            want = defaultdict(int)
            for d in docs[node * step : (node + 1) * step]:
                for t, x in d:
                    want[t] = max(want[t], x)
            assert got == want
