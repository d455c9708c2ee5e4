"""English claims made from the lineitems, as the given prose has invented words.

Each claim is a sentence or two whose parts are drawn from the word lists by the
columns of its row, so every list and rule has rows to work on.  ``SQL_PROSE``
says the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import ASSOCIATION, BOUNDS, CONCLUSION, CUTS, HEDGED, INTERVENTION, REASON, UNIVERSAL

NOUNS = ("The cache", "The “Queue”", "A worker", "The disk index", "Node A.1", "The log")
OPENERS = ("it", "the limit", "because demand", "this", "then", "the rate", "so that")
NUMBER_KINDS = 5
#: Numbers as written in words, the half of them with what makes them hard; some state none.
WRITTEN = (
    "zero", "three", "twelve", "twenty", "thirty five", "forty-two", "one hundred", "one hundred and five", "two hundred thirty", "three thousand", "two and a half", "three quarters", "half", "a half",
    "1/2", "an hour of", "five million", "one thousand two hundred and six", "nineteen thousand", "ninety-nine and a third", "eleven hundred", "5 million", "two and more", "seven million and twelve", "one hundred and four thousand",
)
UNITS = ("", "ms", "MB", "%", "h", "s")
STRENGTH = ("", *UNIVERSAL, *HEDGED)
RUNGS = ("handles", *INTERVENTION, *ASSOCIATION)
JOINS = (". ", *CUTS)
LEADS = ("", *REASON, *(f"We waited, {x}" for x in CONCLUSION), "Restart it")
PHRASES = tuple(p for p, _ in BOUNDS)


def _pick(words: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))


def statements(lineitem: DataFrame) -> DataFrame:
    """``doc_id, claim_id, pos, uri, text, lead, number, quotes``; claims in position 5 have no lead."""
    order, line, part, supp = (F.col(f"l_{x}").cast("long") for x in ("orderkey", "linenumber", "partkey", "suppkey"))
    q = F.col("l_quantity").cast("int")
    digits, kind = q.cast("string"), line % NUMBER_KINDS
    number = (
        F.when(kind == 0, digits).when(kind == 1, F.concat(F.lit("1,0"), F.lpad(digits, 2, "0"))).when(kind == 2, _pick(WRITTEN, q))
        .when(kind == 3, F.concat(digits, F.lit(".5"))).when(kind == 4, "a handful").otherwise(digits)
    )
    unit = F.when(number.rlike("^[0-9.,]+$"), _pick(UNITS, supp)).otherwise("")
    strength, phrase, join, opener = _pick(STRENGTH, supp), _pick(PHRASES, F.floor(order / 8)), _pick(JOINS, order), _pick(OPENERS, line + part)
    opener = F.when(join == ". ", F.concat(F.upper(F.substring(opener, 1, 1)), F.substring(opener, F.lit(2), F.char_length(opener)))).otherwise(opener)
    verb = F.when(phrase == "is", "").otherwise("is ")
    first = F.concat(_pick(NOUNS, part), F.when(strength == "", "").otherwise(F.concat(F.lit(" "), strength)), F.lit(" "), _pick(RUNGS, F.floor(part / 7)), F.lit(" load"))
    text = F.concat(first, join, opener, F.lit(" "), verb, phrase, F.lit(" "), number, unit, F.lit("."))
    lead = F.when(line != 5, F.trim(F.concat(_pick(LEADS, order + line), F.lit(" "), first)))
    quote = F.concat(_pick(NOUNS, part), F.lit("  "), _pick(RUNGS, supp), F.lit(" load on part "), (part % 50).cast("string"))
    quotes = F.when(line % 4 == 0, F.array().cast("array<string>")).when(line % 4 == 1, F.array(quote)).otherwise(F.array(quote, F.concat(quote, F.lit(" too"))))
    return lineitem.select(
        order.alias("doc_id"), F.concat_ws("#", order, line).alias("claim_id"), line.alias("pos"), part.alias("uri"), text.alias("text"), lead.alias("lead"), F.concat(number, unit).alias("number"), quotes.alias("quotes"),
    )


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_pick(words: tuple[str, ...], by: str) -> str:
    return f"{_list(words)}[({by}) % {len(words)} + 1]"


SQL_PROSE = f"""
drawn AS (SELECT l_orderkey AS o, l_linenumber AS l, l_partkey AS p, l_suppkey AS s, l_quantity::INTEGER AS q, {_sql_pick(STRENGTH, 'l_suppkey')} AS strength, {_sql_pick(PHRASES, 'l_orderkey // 8')} AS phrase, {_sql_pick(JOINS, 'l_orderkey')} AS joined,
  {_sql_pick(OPENERS, 'l_linenumber + l_partkey')} AS opener, {_sql_pick(NOUNS, 'l_partkey')} AS noun, {_sql_pick(RUNGS, 'l_partkey // 7')} AS rung, {_sql_pick(RUNGS, 'l_suppkey')} AS other FROM lineitem),
numbered AS (SELECT *, CASE WHEN l % 5 = 0 THEN q::VARCHAR WHEN l % 5 = 1 THEN '1,0' || lpad(q::VARCHAR, 2, '0') WHEN l % 5 = 2 THEN {_sql_pick(WRITTEN, 'q')} WHEN l % 5 = 3 THEN q || '.5' WHEN l % 5 = 4 THEN 'a handful' ELSE q::VARCHAR END AS n FROM drawn),
united AS (SELECT *, n || CASE WHEN regexp_matches(n, '^[0-9.,]+$') THEN {_sql_pick(UNITS, 's')} ELSE '' END AS number, noun || CASE WHEN strength = '' THEN '' ELSE ' ' || strength END || ' ' || rung || ' load' AS opening FROM numbered),
statements AS (SELECT o AS doc_id, o || '#' || l AS claim_id, l AS pos, p AS uri, number,
  opening || joined || CASE WHEN joined = '. ' THEN upper(opener[1]) || opener[2:] ELSE opener END || ' ' || CASE WHEN phrase = 'is' THEN '' ELSE 'is ' END || phrase || ' ' || number || '.' AS text,
  CASE WHEN l <> 5 THEN trim({_sql_pick(LEADS, 'o + l')} || ' ' || opening) END AS lead,
  CASE WHEN l % 4 = 0 THEN []::VARCHAR[] WHEN l % 4 = 1 THEN [noun || '  ' || other || ' load on part ' || (p % 50)] ELSE [noun || '  ' || other || ' load on part ' || (p % 50), noun || '  ' || other || ' load on part ' || (p % 50) || ' too'] END AS quotes FROM united)
"""
