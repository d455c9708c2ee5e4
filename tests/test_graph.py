import pytest

from plumbline.operators import graph


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([(x, f"c/{x}.md", x.title()) for x in ("alpha", "beta", "gamma", "delta")], "doc_id string, path string, title string")
    claims = spark.createDataFrame([("a1", "alpha"), ("b1", "beta"), ("g1", "gamma"), ("d1", "delta")], "claim_id string, doc_id string")
    cited = spark.createDataFrame([("a1", "alpha", "evidence/text/aa/one.md"), ("d1", "delta", "evidence/text/zz/other.md")], "claim_id string, doc_id string, archive_path string")
    links = spark.createDataFrame([("beta", "alpha", "c/alpha", False), ("alpha", "gamma", "c/gamma", False), ("delta", None, "https://x", True)], "source_doc string, target_doc string, href string, external boolean")
    paths = spark.createDataFrame([("evidence/text/aa/one.md",)], "archive_path string")
    return docs, claims, cited, links, paths


def test_candidates(corpus):
    docs, claims, cited, links, paths = corpus
    none, delta = docs.select("doc_id").limit(0), docs.where("doc_id = 'delta'").select("doc_id")
    got = lambda *x: [(r.claim_id, r.rule) for r in graph.candidates(cited, claims, links, *x).collect()]
    assert got(paths, 25, none) == [("a1", "shared-source"), ("b1", "one-hop"), ("g1", "one-hop")]
    assert len(got(paths, 2, none)) == 2 and got(paths, 1, delta) == [("a1", "shared-source"), ("d1", "conflict-edge")]
    assert got(paths, 25, docs.where("doc_id = 'alpha'").select("doc_id")) == got(paths, 25, none)  # a1 is there already
    with pytest.raises(ValueError):
        graph.candidates(cited, claims, links, paths, 0, none)
    assert got(paths.limit(0), 25, none) == []


def test_degrees_and_orphans(corpus):
    docs, _, _, links, _ = corpus
    assert {(r.doc_id, r.in_degree, r.out_degree) for r in graph.degrees(links, docs).collect()} == {("alpha", 1, 1), ("beta", 0, 1), ("gamma", 1, 0), ("delta", 0, 0)}
    assert {r.doc_id for r in graph.orphans(links, docs).collect()} == {"beta", "delta"}
    assert graph.broken_links(links).count() == 0


def test_self_link_is_no_centrality_but_no_orphan(spark, corpus):
    docs = corpus[0]
    links = spark.createDataFrame([("beta", "beta", "c/beta", False)], "source_doc string, target_doc string, href string, external boolean")
    assert graph.centrality(links).count() == 0
    assert "beta" not in {r.doc_id for r in graph.orphans(links, docs).collect()}


@pytest.mark.parametrize(
    ("observed", "indexed", "want"),
    [
        ([("c/a", "a")], [("c/a", "a")], []),
        ([("c/a", "a")], [], [("index", "a", "c/a", None)]),
        ([("c/b", "a")], [("c/a", "a")], [("update-path", "a", "c/b", "c/a")]),
        ([], [("c/a", "a")], [("tombstone", "a", "c/a", None)]),
        ([("c/a", "a"), ("c/b", "a")], [("c/a", "a")], [("duplicate", "a", "c/a", None)]),
        ([("c/a", None)], [], [("quarantine", None, "c/a", None)]),
        ([("c/a", "new")], [("c/a", "old")], [("conflict", "new", "c/a", "old")]),
    ],
)
def test_reconcile(spark, observed, indexed, want):
    out = graph.reconcile(spark.createDataFrame(observed, "path string, id string"), spark.createDataFrame(indexed, "path string, id string"))
    assert [tuple(r) for r in out.collect()] == want
