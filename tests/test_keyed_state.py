import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators import rationale, trail
from plumbline.sources.keyed import KeyedTable
from plumbline.streaming import trail as streams

SCHEMA = "claim_id string, at timestamp"


def returns(spark, *rows):
    return spark.createDataFrame([(c, dt.datetime(2024, 1, d)) for c, d in rows], SCHEMA)


def rows(df):
    return {(r.claim_id, r.returns, r.last_at.day) for r in df.collect()}


ONE, TWO = [("a", 1), ("a", 3), ("b", 2)], [("a", 2), ("c", 5), ("c", 4)]


def test_batches_make_the_union(spark, tmp_path):
    state, whole = (trail.retrieval_state(spark, f"{tmp_path}/{n}") for n in ("parts", "whole"))
    trail.merge_retrievals(state, returns(spark, *ONE), "1")
    first = state.versions()[-1]
    trail.merge_retrievals(state, returns(spark, *TWO), "2")
    trail.merge_retrievals(whole, returns(spark, *ONE, *TWO), "all")
    assert rows(state.read()) == rows(whole.read()) == {("a", 3, 3), ("b", 1, 2), ("c", 2, 5)}
    before = state.versions()
    assert trail.merge_retrievals(state, returns(spark, ("z", 9)), "2") == before[-1] and state.versions() == before  # a batch that is run again
    pinned = state.read(first)
    state.compact()
    trail.merge_retrievals(state, returns(spark, ("a", 8)), "3")
    assert rows(state.read()) == {("a", 4, 8), ("b", 1, 2), ("c", 2, 5)} and rows(pinned) == rows(state.read(first)) == {("a", 2, 3), ("b", 1, 2)}
    state.expire(1)
    assert len(state.versions()) == 1 and rows(state.read()) == {("a", 4, 8), ("b", 1, 2), ("c", 2, 5)}


def test_the_base_is_not_shuffled(spark, tmp_path):
    state = trail.retrieval_state(spark, str(tmp_path))
    for n in range(3):
        trail.merge_retrievals(state, returns(spark, *ONE, *TWO), str(n))
        if not n:
            state.compact()
    plan = state.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1, "one shuffle, of the deltas"
    assert "Bucketed: true" in plan


def test_another_session_goes_on(spark, tmp_path):
    state = trail.retrieval_state(spark, str(tmp_path))
    trail.merge_retrievals(state, returns(spark, *ONE), "1")
    state.compact()
    for t in spark.catalog.listTables():
        if t.name.startswith("keyed_"):
            spark.sql(f"DROP TABLE {t.name}")  # as if another session had written it
    again = trail.retrieval_state(spark, str(tmp_path))
    trail.merge_retrievals(again, returns(spark, *TWO), "2")
    assert rows(again.read()) == {("a", 3, 3), ("b", 1, 2), ("c", 2, 5)}
    plan = again.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_two_writers_of_one_version(spark, tmp_path):
    state = trail.retrieval_state(spark, str(tmp_path))
    trail.merge_retrievals(state, returns(spark, *ONE), "1")
    known = state.versions
    state.versions = lambda: []  # a writer that looked before the other was done
    with pytest.raises(RuntimeError):
        state._commit(state._manifest(1))
    state.versions = known
    assert rows(state.read()) == {("a", 2, 3), ("b", 1, 2)}
    with pytest.raises(ValueError):
        KeyedTable(spark, f"{tmp_path}/none", ["k"], {"n": "sum"}).read()


def test_last_checks(spark, tmp_path):
    state = trail.check_state(spark, str(tmp_path))
    log = lambda *x: spark.createDataFrame([("u", "v", dt.datetime(2024, 1, d), line, drift) for d, line, drift in x], "uri string, version string, at timestamp, line string, drift string")
    trail.merge_checks(state, log((5, "1", "none"), (2, "2", "benign")), "1")
    trail.merge_checks(state, log((4, "9", "unsupported")), "2")
    assert [(r.last.drift, r.checks) for r in state.read().collect()] == [("none", 3)]
    trail.merge_checks(state, log((5, "3", "unsupported")), "3")
    assert [(r.last.drift, r.checks) for r in state.read().collect()] == [("unsupported", 4)]


def test_a_stream_merges_and_resumes(spark, tmp_path):
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    returns(spark, *ONE).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    assert rows(streams.stream_retrievals(read(), f"{tmp_path}/run")) == {("a", 2, 3), ("b", 1, 2)}
    returns(spark, *TWO).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    returns(spark, ("b", 7)).coalesce(1).write.parquet(f"{tmp_path}/in/3")
    assert rows(streams.stream_retrievals(read(), f"{tmp_path}/run", compact_after=1)) == {("a", 3, 3), ("b", 2, 7), ("c", 2, 5)}
    assert rows(streams.stream_retrievals(read(), f"{tmp_path}/run")) == {("a", 3, 3), ("b", 2, 7), ("c", 2, 5)}


def test_rationales(spark):
    asked = spark.createDataFrame([(0, "State your own reason for this now"), (1, "why is it a good one then"), (2, "too short to prove")], "rank int, phrase string")
    said = [
        (1, "first", "It is fine."), (2, "second", "it  IS fine."), (3, "third", "We say: state your\nown reason for this now!"), (4, "fourth", "reinstate your own reason for this nowhere"), (5, "fifth", "too short to prove"),
        (6, "sixth", "why is it a good one then, state your own reason for this now"), (7, "seventh", " "), (8, "eighth", None), (9, "ninth", "state your own reason for that now"), (10, "tenth", "too short to prove"),
    ]
    out = rationale.unusable_rationales(spark.createDataFrame(said, "line long, label string, rationale string"), asked)
    first = "State your own reason for this now"
    assert {(r.line, r.reason, r.match) for r in out.collect()} == {(2, "prior", "first"), (3, "template", first), (4, "template", first), (6, "template", first), (10, "prior", "fifth")}
    assert rationale.unusable_rationales(spark.createDataFrame(said[:0], "line long, label string, rationale string"), asked).count() == 0
    assert out.where(F.col("reason") == "prior").count() == 2
