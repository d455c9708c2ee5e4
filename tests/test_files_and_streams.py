import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import checks, conflict, graph, trail
from plumbline.sources import files
from plumbline.streaming import trail as streams


def test_read_corpus_files(spark, tmp_path):
    (tmp_path / "c" / "x").mkdir(parents=True)
    whole = {"c/a.md": "---\ntype: Rule\ntitle: A\n---\nBody\n", "c/x/b.md": "no head", "c/x/d.md": "---\ntitle: t\n---\nx", "c/e.md": "---\ntype: Rule\n---\n \n", "c/f.md": "\n", "c/index.md": "---\ntype: Rule\n---\nx", "c/log.md": "x", "c/skip.txt": "x"}
    for name, text in whole.items():
        (tmp_path / name).write_text(text)
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.parse_corpus(files.read_files(spark, str(tmp_path))).collect()}
    assert {k: r.invalid for k, r in rows.items()} == {"a.md": None, "b.md": "no-front-matter", "d.md": "no-type", "e.md": "no-body", "f.md": "empty"}
    assert (rows["a.md"].type, rows["a.md"].title, rows["a.md"].body, rows["a.md"].bytes) == ("Rule", "A", "Body\n", len(whole["c/a.md"]))


def test_jsonl_keeps_malformed_lines(spark):
    lines = spark.createDataFrame([(1, '{"op": "x", "n": 2}'), (2, ""), (3, '{"op": '), (4, "[1]"), (5, '{"n": 3}')], "line long, text string")
    got = {r.line: (r.malformed, r.row and r.row.op) for r in files.parse_jsonl(lines, "op string, n int").collect()}
    assert got[1] == (False, "x") and got[3][0] and got[5] == (False, None) and set(got) == {1, 3, 4, 5}


def test_rebuild_replaces_and_refuses(spark, tmp_path):
    many, few = spark.range(10), spark.range(4)
    first = files.rebuild_index({"docs": many}, str(tmp_path)).first()
    assert first.n == 10 and files.rebuild_index({"docs": many.orderBy(F.desc("id"))}, str(tmp_path)).first().digest == first.digest
    with pytest.raises(ValueError):
        files.rebuild_index({"docs": few}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/docs").count() == 10


def test_export(spark, tmp_path):
    docs = spark.createDataFrame([(1, "c/1.md", "Rule", "A", "", None)], "doc_id long, path string, type string, title string, status string, stale_after date")
    claims = spark.createDataFrame([(1, "1#2", None), (1, "1#1", "x")], "doc_id long, claim_id string, lead string")
    files.export_corpus(docs, claims, f"{tmp_path}/out")
    row = json.loads(spark.read.text(f"{tmp_path}/out").first().value)
    assert row["claims"] == [{"claim_id": "1#1", "lead": "x"}, {"claim_id": "1#2", "lead": None}] and row["invalid"] and row["stale_after"] is None


def events(spark, path, n, rows):
    spark.createDataFrame(rows, "line long, at timestamp, op string, outcome string").coalesce(1).write.parquet(f"{path}/{n}")


def test_late_rows_are_dropped_and_a_stream_resumes(spark, tmp_path):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    read = lambda: spark.readStream.schema("line long, at timestamp, op string, outcome string").parquet(f"{tmp_path}/in/*")
    run = lambda: {(r.day.day, r.op): r.n for r in streams.run_available(streams.trail_counts(read(), "1 day"), "t", ["day", "op"], f"{tmp_path}/run").collect()}
    events(spark, f"{tmp_path}/in", 1, [(1, day(1), "fetch", "ok"), (2, day(1), "fetch", "blocked"), (3, day(20), "fetch", "ok")])
    assert run() == {(1, "fetch"): 1, (20, "fetch"): 1}
    events(spark, f"{tmp_path}/in", 2, [(4, day(2), "fetch", "ok"), (5, day(20), "fetch", "ok"), (6, day(20), "admit", "ok")])
    assert run() == {(1, "fetch"): 1, (20, "fetch"): 2, (20, "admit"): 1}  # day 2 is behind the watermark


def test_interval_pairs(spark):
    rows = [("a", "s", "F", "<=", 3.0), ("b", "s", "F", ">=", 5.0), ("c", "s", "F", "==", 4.0), ("d", "s", "F", "==", 4.0), ("e", "s", "O", ">=", 9.0), ("f", "t", "F", "<=", 1.0), ("g", "t", "F", ">=", 1.0), ("h", "s", "F", "<=", None)]
    bounds = spark.createDataFrame(rows, "claim_id string, subject string, dimension string, op string, value double")
    assert {(r["first"], r["second"]) for r in conflict.interval_conflicts(bounds).collect()} == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d")}


def test_authority(spark):
    rows = [(1, 1, "human:a", "", None), (1, 2, "human:a", "human:b", "check:x"), (1, 3, "human:c", "human:d", "human:e"), (2, 1, "agent:z", None, None)]
    decisions = spark.createDataFrame(rows, "doc_id long, line long, by string, co_signed_by string, verified_by string")
    assert {r.doc_id: (r.humans, r.authority) for r in trail.authority(decisions).collect()} == {1: (5, "quorum"), 2: (0, "sole")}
    assert [(r.line, r.before, r.after) for r in trail.authority_move(decisions).orderBy("line").collect()] == [(2, "sole", "paired"), (3, "paired", "quorum")]


def test_scope_and_signals(spark):
    docs = spark.createDataFrame([(1, "c/3/x", "", "fresh", "human-reviewed"), (2, "c/30/x", "", "fresh", "unverified"), (3, "c/3", "draft", "stale", "machine-confirmed")], "doc_id long, path string, status string, freshness string, trust string")
    at = lambda **scope: [r.doc_id for r in docs.where(graph.in_scope(**scope)).orderBy("doc_id").collect()]
    assert at(prefix="c/3") == [1, 3] and at(status="stable") == [1, 2] and at(trust="machine-confirmed") == [1, 3] and at(fresh=True, prefix="c/3/") == [1]
    texts = spark.createDataFrame([(1, "fine"), (2, "a​b"), (3, "fine"), (4, "fine")], "doc_id long, body string")
    stages = spark.createDataFrame([(1, list(checks.STAGES)), (2, list(checks.STAGES)), (3, ["hidden"])], "doc_id long, stages array<string>")
    assert {r.doc_id: r.state for r in checks.security_signal(texts, stages).collect()} == {1: "pass", 2: "fail", 3: "unchecked", 4: "unchecked"}
