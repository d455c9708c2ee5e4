import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import conflict, evidence, sampling, trail


def test_trust(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    claims = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id int, claim_id string")
    by = spark.createDataFrame([("a", "human:x"), ("b", "check:y"), ("b", ""), ("c", "human:z")], "claim_id string, by string")
    assert {r.claim_id: r.trust for r in evidence.trust_claim(claims, by).collect()} == {"a": "human-reviewed", "b": "machine-confirmed", "c": "human-reviewed"}
    assert {r.doc_id: r.trust for r in evidence.trust_document(docs, claims, by).collect()} == {1: "machine-confirmed", 2: "human-reviewed", 3: "unverified"}


@pytest.mark.parametrize(
    ("bounds", "clash"),
    [
        ([("<=", 3.0), ("<=", 5.0)], False), ([(">=", 3.0), (">=", 5.0)], False), ([(">=", 1.0), ("<=", 5.0)], False), ([("==", 3.0), ("<=", 5.0)], False),
        ([("==", 3.0), (">=", 3.0)], False), ([("==", 3.0), ("==", 4.0)], True), ([("<=", 3.0), (">=", 4.0)], True),
    ],
)
def test_intervals(spark, bounds, clash):
    rows = spark.createDataFrame([("s", "count", f"c{i}", op, v) for i, (op, v) in enumerate(bounds)], "subject string, dimension string, claim_id string, op string, value double")
    assert (conflict.interval_conflicts(rows).count() == 1) is clash


def test_miss_report_counts_keyless_rows(spark):
    rows = spark.createDataFrame([(1, "extract", "p", "k1", "c"), (2, "extract", "p", "k1", "c"), (3, "accrete", "p", None, "c"), (4, "accrete", "p", None, "d")], "line int, op string, reason string, key string, check string")
    got = trail.miss_report(rows).first()
    assert (got.emissions, got.questions, got.ops, got.checks) == (4, 3, "accrete,extract", "c,d")


def test_outstanding(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at, "promote", "human:a", "p", "blocked"), (2, at, "promote", "human:a", "p", "ok"), (3, at, "promote", "human:b", "p", "blocked"), (4, at, "discard", "human:b", "q", "blocked")]
    got = trail.outstanding(spark.createDataFrame(rows, "line int, at timestamp, op string, actor string, path string, outcome string")).collect()
    assert [(r.path, r.attempts, r.last_actor) for r in got] == [("p", 1, "human:b")]


def test_sessions(spark):
    rows = [("s", 0, "user", "how?"), ("s", 1, "assistant", "a"), ("s", 2, "assistant", "b"), ("s", 3, "user", " "), ("s", 4, "assistant", "lost"), ("s", 5, "user", "How?"), ("s", 6, "assistant", "c"), ("t", 0, "user", "open")]
    found = trail.exchanges(spark.createDataFrame(rows, "session_id string, pos int, role string, text string"))
    assert [(r.pos, r.answer) for r in found.orderBy("pos").collect()] == [(0, "a\n\nb"), (5, "c")]
    again = trail.repeated_questions(found).first()
    assert (again.asked, again.question, again.answer, again.turns, again.kind) == (2, "how?", "c", "s:0,s:5", "retried")


def test_sample_is_stable(spark):
    rows = spark.createDataFrame([(f"x{i}",) for i in range(100)], "x string")
    first = {r.x for r in sampling.hash_sample(rows, "x", 5).collect()}
    fewer = {r.x for r in sampling.hash_sample(rows.where(F.col("x").isin(*first) | (F.col("x") > "x5")), "x", 5).collect()}
    assert first == fewer and len(first) == 5


def test_digest_ignores_order_and_tells_null_from_text(spark):
    a = spark.createDataFrame([("x", None), ("y", "n")], "a string, b string")
    b = spark.createDataFrame([("y", "n"), ("x", None)], "a string, b string")
    c = spark.createDataFrame([("x", "n"), ("y", "n")], "a string, b string")
    d = [sampling.table_digest(t).first().digest for t in (a, b, c)]
    assert d[0] == d[1] != d[2]
    assert sampling.floor_breached(100, 49) and not sampling.floor_breached(0, 0) and not sampling.floor_breached(10, 1, 0)


def test_alias_of_two_keys_is_refused(spark):
    surfaces = spark.createDataFrame([("c", "Retry  Cap"), ("d", "other")], "claim_id string, surface string")
    aliases = spark.createDataFrame([("retry cap", "retry.max")], "alias string, key string")
    assert {r.claim_id: r.key for r in conflict.alias_resolve(surfaces, aliases).collect()} == {"c": "retry.max", "d": None}
    with pytest.raises(ValueError):
        conflict.alias_resolve(surfaces, aliases.union(spark.createDataFrame([("Retry Cap", "b")], "alias string, key string")))


def test_population(spark):
    def disjoint(rows):
        return conflict.subject_population(spark.createDataFrame(rows, "uri int, claim_id string, doc_id int, archive_path string")).first().disjoint

    assert disjoint([(1, "a", 1, "p"), (1, "b", 2, "q")])
    assert not disjoint([(1, "a", 1, "p"), (1, "b", 2, "p")])
    assert not disjoint([(1, "a", 1, "p"), (1, "a", 1, "q"), (1, "b", 2, "q"), (1, "b", 2, "r"), (1, "c", 3, "r"), (1, "c", 3, "p")])
    assert not disjoint([(1, "a", 1, "p")])
