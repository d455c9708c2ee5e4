import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text, lang, source, n):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def climb(nodes, fanout):
    """The root of ``nodes`` and each node's path of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + fanout])))
        nodes, at = [digest(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in at]
    return nodes[0], paths


def brute(rows, fanout):
    trees = {}
    for doc, text, lang, source, n in rows:
        claim = text.translate(LOWER) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text
        node = leaf(doc, text, lang, source, n)
        trees.setdefault((lang is not None, (lang or "").encode()), []).append(((doc is not None, doc or 0, node), doc, node, leaf(doc, claim, lang, source, n)))
    grown = [(sorted(trees[k], key=lambda x: x[0])) for k in sorted(trees)]
    low = [climb([x[2] for x in t], fanout) for t in grown]
    root, high = climb([x[0] for x in low], fanout) if low else (None, [])
    out = []
    for members, (subroot, paths), above in zip(grown, low, high):
        for (_, doc, node, claim), path in zip(members, paths):
            sides, h = "", claim
            for a, b in path + above:
                sides, h = sides + a + b, digest(a, h, b)
            out.append((doc, node, subroot, root, digest(sides), h, h == root))
    return Counter(out)


def rows_of(df):
    return Counter(tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def tampered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", merkle._UPPER, merkle._ASCII_LOWER)).otherwise(F.col("text"))


@pytest.mark.parametrize("fanout,depth", [(8, 3), (8, 1), (2, 2), (3, 1)])
def test_equals_brute_force(documents, rows, fanout, depth):
    """Several tiers of blocks, nulls, equal rows, ids that repeat or are null, a very long text."""
    out = merkle.verify_documents(documents.withColumns({"node": F.lit(1), "tree": F.lit("x"), "a.b": F.lit(2)}), tampered(), fanout, depth)
    assert rows_of(out) == brute(rows, fanout)
    assert 0 < out.where("verified").count() < len(rows)


def test_one_tree_of_many_languages(spark):
    rows = [(i, f"Text {i}", f"l{i % 70}", None, i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(merkle.verify_documents(docs, tampered(), 8, 1)) == brute(rows, 8)


def test_small_tables(spark, documents, empty):
    assert merkle.verify_documents(empty).count() == 0
    one = documents.where("doc_id = 100")
    found = merkle.verify_documents(one).first()
    assert found.leaf == found.subroot == found.root == found.folded_root and found.verified
    assert found.proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_every_change_shows(documents):
    assert merkle.verify_documents(documents).where("not verified").count() == 0
    changed = merkle.verify_documents(documents, F.concat("text", F.lit(" ")))
    assert changed.where("verified").count() == documents.where("text is null").count()
