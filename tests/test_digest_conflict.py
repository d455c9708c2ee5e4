import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.operators import claims, conflict, digest

SPEC = "k | v"


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v string").repartition(3)


def root_of(spark, rows, per=4):
    return tuple(digest.root(digest.row_blocks(table(spark, rows), SPEC, per), 2).first())


def test_digest_holds_order_and_cells(spark):
    rows = [(f"k{i:03}", f"v{i % 7}") for i in range(200)] + [("k001", "v1"), (None, "x"), ("", None), ("k", "")]
    same = root_of(spark, rows)
    assert same == root_of(spark, rows[::-1]) and same[0] == 204
    swapped = [*rows[:10], (rows[10][0], rows[11][1]), (rows[11][0], rows[10][1]), *rows[12:]]
    for other in (swapped, rows[1:], [*rows, rows[0]], [*rows[:-2], ("", ""), rows[-1]], [*rows[:-2], (None, None), rows[-1]], [*rows[:-1], ("k", None)]):
        assert root_of(spark, other)[1] != same[1]
    assert root_of(spark, [("a", "bc")])[1] != root_of(spark, [("ab", "c")])[1]
    assert root_of(spark, []) == (0, root_of(spark, [])[1])


def test_a_difference_leads_to_its_block(spark):
    rows = [(f"k{i:04}", "v") for i in range(1000)]
    one, other = (digest.index_blocks({"t": table(spark, r)}, {"t": SPEC}, 16) for r in (rows, [*rows[:500], ("k0500", "changed"), *rows[501:], ("k0100x", "new")]))
    found = digest.differing_blocks(one, other).collect()
    assert 2 <= len({r.first for r in found}) <= 6 and one.count() > 30
    assert any(r.first <= "k0500" for r in found) and all(r.first < "k0101" or "k0400" < r.first < "k0600" for r in found)
    assert digest.differing_blocks(one, one).count() == 0
    names = {"t": SPEC, "u": SPEC}
    whole = [digest.index_digest(digest.index_blocks(t, names, 16), list(names)).where("name = 'index'").first().digest for t in ({"t": table(spark, rows), "u": table(spark, [])}, {"t": table(spark, []), "u": table(spark, rows)})]
    assert whole[0] != whole[1]


def bounds(spark, rows):
    return spark.createDataFrame(rows, "claim_id string, subject string, dimension string, op string, value double")


def interval(op, v):
    return (float("-inf") if op == "<=" else v, float("inf") if op == ">=" else v)


@pytest.mark.parametrize("per_range", [1, 7, 4096])
def test_interval_pairs_equal_brute_force(spark, per_range):
    """One subject has a third of all claims, many with one value; pieces of any size give the same pairs."""
    rng = random.Random(per_range)
    rows = [(f"c{i}", "hot" if i % 3 == 0 else f"s{i % 9}", "d", rng.choice(("<=", ">=", "==")), float(rng.choice((1, 2, 5, 5, 5, rng.randrange(30))))) for i in range(240)] + [("n", "hot", "d", "<=", None)]
    want = Counter()
    for a, b in combinations(rows[:-1], 2):
        (x, y), (z, w) = interval(*a[3:]), interval(*b[3:])
        if a[1] == b[1] and max(x, z) > min(y, w):
            want[a[1], min(a[0], b[0]), max(a[0], b[0])] += 1
    made = conflict.interval_conflicts(bounds(spark, rows), per_range)
    assert Counter((r.subject, r["first"], r["second"]) for r in made.collect()) == want
    counts = {r.subject: r.pairs for r in conflict.conflict_counts(bounds(spark, rows)).collect()}
    assert counts == dict(Counter({s: sum(n for k, n in want.items() if k[0] == s) for s in {k[0] for k in want}}))


def test_no_pair_is_formed_that_is_no_row(spark):
    rows = [(f"c{i}", "hot", "d", (">=", "<=")[i % 2], float(i % 2 * 500 + i // 2)) for i in range(1000)] + [("x", "hot", "d", ">=", 600.5), ("y", "hot", "d", ">=", 700.5)]
    ends = conflict._dealt(bounds(spark, rows).withColumn("at", F.col("value")), ["subject", "dimension"], 16)
    assert ends.groupBy("range").count().agg(F.max("count")).first()[0] <= 20
    made = conflict.interval_conflicts(bounds(spark, rows), 16)
    assert made.count() == sum(1 for a in rows for b in rows if a[3] == ">=" and b[3] == "<=" and a[4] > b[4])


@pytest.mark.parametrize("per_range", [1, 7, 4096])
def test_claims_of_several_bounds_are_one_row_a_pair(spark, per_range):
    """Claims repeat with equal and other bounds, some of which clash with each other; a pair says how many of its bounds don't meet."""
    rng = random.Random(per_range)
    rows = [(f"c{rng.randrange(60) if i % 2 else i}", f"s{i % 3 % 2}", rng.choice("dde"), rng.choice(("<=", ">=", "==")), float(rng.randrange(12))) for i in range(260)]
    odd = [("n", "s0", "d", "<=", None), (None, "s0", "d", "==", 3.0), ("x", None, "d", "==", 3.0), ("y", None, "d", "==", 9.0), ("z", "s0", "d", None, 5.0)]
    want = Counter()
    for a, b in combinations(rows, 2):
        (x, y), (z, w) = interval(*a[3:]), interval(*b[3:])
        if a[0] != b[0] and a[1:3] == b[1:3] and max(x, z) > min(y, w):
            want[(*a[1:3], min(a[0], b[0]), max(a[0], b[0]))] += 1
    made = conflict.interval_conflicts(bounds(spark, rows + odd), per_range).collect()
    assert max(want.values()) > 3 and len(made) == len(want)
    assert {tuple(r)[:4]: r.times for r in made} == dict(want)


def test_pairs_of_claims_are_not_grouped(spark):
    """Bounds are moved, pairs are not: no aggregate or exchange of the query has a pair's claims as its keys."""
    made = entry.queries()["interval_conflict"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Aggregate\(keys=\[|hashpartitioning\()[^\])]*\b(first|second)#", plan)
    assert made.columns == ["subject", "dimension", "first", "second", "times"]


def test_cover_test_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [(s, f"d{d}", f"p{rng.randrange(s + 2)}") for s in range(12) for d in range(rng.randrange(1, 14)) for _ in range(rng.randrange(1, 5))]
    held = spark.createDataFrame(rows, "uri long, doc_id string, archive_path string").distinct()
    paths = {}
    for s, d, p in rows:
        paths.setdefault(s, {}).setdefault(d, set()).add(p)
    want = {s: any(not (a & b) for a, b in combinations(x.values(), 2)) for s, x in paths.items()}
    assert {r.uri: r.apart for r in conflict.cover_test(held).collect()} == want
    claims = held.withColumn("claim_id", F.concat_ws("#", "doc_id", "archive_path"))
    out = conflict.subject_population(claims)
    assert {r.uri: r.disjoint for r in out.collect()} == want
    plan = conflict.cover_test(held)._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_or_agg" in plan and "arrays_overlap" not in plan


def test_pairs_of_claims_with_several_bounds_are_formed_once(spark):
    rows = [("s", "a", True), ("s", "a", False), ("s", "b", True), ("s", "b", False), ("s", "c", True), ("s", "c", True), ("s", "d", None), ("s", "e", False), ("s", "e", False)]
    found = conflict.unseparated_pairs(spark.createDataFrame(rows, "subject string, claim_id string, parsed boolean"))
    want = {(x[1], y[1]) for x in rows for y in rows if x[1] < y[1] and (x[2] is False or (y[2] is False and x[2]))}
    assert sorted((r.first, r.second) for r in found.select("first", "second").collect()) == sorted(want)
    assert found._jdf.queryExecution().executedPlan().toString().count("HashAggregate") == 4  # none after the join


def test_blocks_over_tasks_are_those_of_one(spark):
    rows = [(f"k{i % 50:02}", str(i % 400)) for i in range(3000)]
    blocks = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            found = digest.row_blocks(table(spark, rows), SPEC, 16)
            blocks.append([tuple(r) for r in found.orderBy("block").collect()])
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert blocks[0] == blocks[1] and len(blocks[0]) > 10


def test_claims_get_their_sources_before_they_are_paired(spark):
    """A pair is neither dealt nor sorted: no exchange, aggregate or join has a pair's claims as its keys."""
    rows = [("s", "a", True), ("s", "a", False), ("s", "b", True), ("s", "c", False), ("s", "d", None), ("t", "a", False), ("t", "b", False)]
    cites = spark.createDataFrame([("a", "p2"), ("a", "p1"), ("a", "p0"), ("b", "p2"), ("c", "p0")], "claim_id string, archive_path string")
    records = spark.createDataFrame([("p0", "referenced"), ("p1", "archived"), ("p2", "extracted")], "archive_path string, disposition string")
    made = claims.pair_inputs(spark.createDataFrame(rows, "subject string, claim_id string, parsed boolean"), cites, records)
    ids = {x + y: hashlib.sha256(f"{x}\0{y}".encode()).hexdigest()[:16] for x, y in combinations("abcd", 2)}
    want = [("ab", "p1", "p2"), ("ab", "p1", "p2"), ("ac", "p1", None), ("ad", "p1", None), ("bc", "p2", None), ("cd", None, None)]
    assert sorted(map(str, made.collect())) == sorted(str(Row(pair_id=ids[p], first_source=a, second_source=b, skipped=a is None or b is None)) for p, a, b in want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"(Aggregate\(key(s|)=\[|hashpartitioning\(|Join \[)[^\])]*\b(first|second)#", plan)
