import pytest
from pyspark.sql import functions as F

from plumbline.functions import fixed, markers, numbers
from plumbline.operators import claims


def one(spark, text, of):
    return spark.createDataFrame([(text,)], "t string").select(of(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("x must not y", "must not"), ("It must, never.", "never"), ("You must. Not so.", "must"), ("allow mustard", None), ("all of it", "all"), ("x must\n not   y", "must not"), ("(must)", None), ("", None), (None, None),
    ],
)
def test_strongest(spark, text, want):
    assert one(spark, text, lambda c: markers.strongest(c, fixed.UNIVERSAL)) == want


def test_consume_counts_words_once(spark):
    listed = (("associated with", "association"), ("is associated with", "association"), ("clearly", "assurance"), ("of course", "assurance"))
    got = lambda t: [tuple(m) for m in one(spark, t, lambda c: markers.consume(c, listed))]
    assert got("Load is associated with heat") == [("is associated with", "association")]
    assert got("Load IS  associated with heat, and cold is not associated with it.") == [("associated with", "association"), ("is associated with", "association")]
    assert got("Of course, clearly.") == [("clearly", "assurance"), ("of course", "assurance")]
    assert got("unclearly, clearlyish") == [] and got("") == []
    # what is taken out goes wherever it stands, inside words too
    assert got("of course clearly unclearly") == [("clearly", "assurance"), ("of course", "assurance")]


def test_marked_language(spark):
    docs = spark.createDataFrame([(1, "Clearly, studies show it."), (2, "nothing"), (3, None), (4, "generally so, in some cases.")], "doc_id long, body string")
    rows = {r.doc_id: (r.n, r.message) for r in claims.marked_language(docs).collect()}
    assert rows == {1: (2, '"clearly" (assurance), "studies show" (weasel)'), 4: (2, '"generally" (hedge), "in some cases" (hedge)')}


NUMBERS = {
    "three": 3, "twenty seconds": 20, "thirty five": 35, "thirty-five retries": 35, "one hundred and five.": 105, "two hundred thirty": 230, "three thousand": 3000, "nineteen thousand four hundred and one": 19401,
    "five million and six": 5000006, "two and a half s": 2.5, "eight and three quarters": 8.75, "three quarters": 0.75, "half": 0.5, "two and more": 2, "two and two": 2, "one thousand and two hundred": 1200, "eleven hundred": 1100,
    "5 million": 5000000, "2.5 thousand": 2500, "1,000 per hour": 1000, "99.9%.": 99.9, "400ms": 400, "5MB": 5, "3 retries in 60 seconds": 3, ", 7": 7, ": 7": 7, "-5": -5, "5,": 5, "two thirds": 0.666667, "forty one two": 41, "twenty thirty": 20,
    "1/2": None, "a handful": None, "a half": None, "an hour": None, "v2": None, "many": None, "( 5": None, "and five": None, "": None, "thirty-fivefold": None,
}


@pytest.fixture(scope="module")
def bounds(spark):
    rows = [(k, f"The limit is at most {k}") for k in NUMBERS]
    found = spark.createDataFrame(rows, "k string, t string").select("k", numbers.parse_bound(F.col("t")).alias("b")).collect()
    return {r.k: r.b for r in found}


@pytest.mark.parametrize("text", NUMBERS)
def test_numbers(bounds, text):
    got = bounds[text]
    assert (got and (got.op, got.phrase, got.value)) == (None if NUMBERS[text] is None else ("<=", "at most", NUMBERS[text]))


def test_raw(bounds):
    raws = {"400ms": "400ms", "5MB": "5mb", "99.9%.": "99.9%", "thirty-five retries": "35", "two and a half s": "2.5", "1,000 per hour": "1000", "5 million": "5000000", "two thirds": "0.666667"}
    assert {k: bounds[k].raw for k in raws} == raws


@pytest.mark.parametrize(
    "text,want",
    [
        ("Retries must be no fewer than three.", (">=", 3)), ("Retries should not exceed three.", ("<=", 3)), ("Availability is over 99.9%.", (">=", 99.9)), ("Retries must be no more than three.", ("<=", 3)), ("Retries are at most 1,000 per hour", ("<=", 1000)), ("The timeout must be under 400ms.", ("<=", 400)), ("No more than 3 retries in 60 seconds.", ("<=", 3)), ("The timeout is exactly two and a half s.", ("==", 2.5)), ("The retry budget is 3.", ("==", 3)), ("No more than a handful of retries.", None),
        ("At least an hour of retries.", None), ("Backoff is exponential.", None), ("It is, no less than (5).", None), ("At least two, at most 9.", (">=", 2)), ("No more than 1/2.", None),
    ],
)
def test_bounds(spark, text, want):
    got = one(spark, text, numbers.parse_bound)
    assert (got and (got.op, got.value)) == want


def spell(n):
    small, tens = fixed.SMALL_NUMBERS, fixed.TENS
    if n < 20:
        return small[n]
    if n < 100:
        return tens[n // 10 - 2] + (" " + small[n % 10] if n % 10 else "")
    for value, word in ((10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= value:
            return spell(n // value) + " " + word + (f" {'and ' if n % value < 100 else ''}{spell(n % value)}" if n % value else "")


def test_every_spelled_number_reads_back(spark):
    wanted = [*range(0, 1300), *range(1300, 3_000_000, 7919)]
    rows = spark.createDataFrame([(n, spell(n)) for n in wanted], "n long, w string").select("n", "w", numbers.read_number(F.split("w", " ")).alias("x"))
    assert [(r.n, r.w, r.x) for r in rows.where("x.value IS DISTINCT FROM cast(n AS double) OR x.raw IS DISTINCT FROM cast(n AS string)").collect()] == []


def test_known_phrases_are_looked_for_without_a_lambda_over_the_list(spark):
    """Each phrase is one look in most texts; a filter over the list put every phrase together anew for every row."""
    rows = spark.createDataFrame([("It never must.",), ("all, neverland",), (None,)], "t string")
    made = rows.select(markers.present(F.col("t"), ("never", "all", "must")).alias("p"))
    assert [r.p for r in made.collect()] == [["never", "must"], ["all"], []]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("concat(") == 1  # the blanks around the line
