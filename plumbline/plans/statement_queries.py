"""Queries of words, bounds, quotes and claims over English statements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions import markers as mk
from plumbline.functions import numbers as nb
from plumbline.functions import text as fx
from plumbline.operators import checks, claims, conflict
from plumbline.plans.registry import query

_NORMATIVE = ("1-URGENT", "2-HIGH")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


#: A text folded by the SQL: quotation marks and dashes plain, blanks single.
FOLD = r"""trim(regexp_replace(translate({0}, '‘’“”–—', '''''""--'), '\s+', ' ', 'g'))"""
PAD = r"' ' || lower(" + FOLD + r") || ' '"


def _stands(padded: str) -> str:
    """Whether the word ``x`` stands between blanks, or before a comma or dot."""
    return " OR ".join(f"contains({padded}, ' ' || x || '{end}')" for end in " ,.")


def first_of(padded: str, words) -> str:
    return f"list_filter({_list(words)}, lambda x: {_stands(padded)})"


_MARKS = f"""padded AS (SELECT *, {PAD.format('text')} AS p FROM statements),
marks AS (SELECT *, len({first_of('p', fixed.UNIVERSAL)}) > 0 AS u, len({first_of('p', fixed.HEDGED)}) > 0 AS h, len({first_of('p', fixed.INTERVENTION)}) > 0 AS i, len({first_of('p', fixed.ASSOCIATION)}) > 0 AS a FROM padded)"""


def _longest(words) -> str:
    """SQL list of words by falling length, those of a length in their order."""
    return _list(sorted(words, key=lambda w: -len(w)))


def _longest_of(padded: str, words) -> str:
    return f"list_filter({_longest(words)}, lambda x: {_stands(padded)})[1]"


@query("strength_markers", f"WITH {_MARKS} SELECT claim_id, pos, CASE WHEN u AND h THEN 'both' WHEN u THEN 'universal' WHEN h THEN 'hedged' END AS strength, {_longest_of('p', fixed.UNIVERSAL)} AS marker FROM marks")
def _(c):
    return c.statements().select("claim_id", "pos", claims.strength(F.col("text")).alias("strength"), mk.strongest(F.col("text"), fixed.UNIVERSAL).alias("marker"))


@query("causal_rung", f"WITH {_MARKS} SELECT claim_id, CASE WHEN i THEN 'intervention' WHEN a THEN 'association' END AS rung, coalesce({_longest_of('p', fixed.INTERVENTION)}, {_longest_of('p', fixed.ASSOCIATION)}) AS marker FROM marks")
def _(c):
    marker = F.coalesce(*[mk.strongest(F.col("text"), words) for words in (fixed.INTERVENTION, fixed.ASSOCIATION)])
    return c.statements().select("claim_id", claims.causal_rung(F.col("text")).alias("rung"), marker.alias("marker"))


@query("check_coverage", f"WITH {_MARKS} SELECT claim_id FROM marks WHERE u AND NOT h AND len(quotes) = 1")
def _(c):
    return claims.over_asserted(c.statements())


def _with_any(words) -> str:
    """The quotes of a row that have one of the words."""
    return f"list_filter(quotes, lambda q: len(list_filter({_list(words)}, lambda x: {_stands(PAD.format('q'))})) > 0)"


@query("check_rung", f"WITH {_MARKS}, stated AS (SELECT claim_id, i, len({_with_any(fixed.INTERVENTION)}) AS qi, len({_with_any(fixed.ASSOCIATION)}) AS qa FROM marks) SELECT claim_id FROM stated WHERE i AND qi = 0 AND qa > 0")
def _(c):
    return claims.over_claimed(c.statements())


_LEAD = r"regexp_replace(lower({0}), '[,.]', ' ', 'g') || ' '".format(FOLD.format("lead"))


@query("check_lead", f"""WITH l AS (SELECT claim_id, {_LEAD} AS p FROM statements JOIN docs USING (doc_id) WHERE type IN ('1-URGENT', '2-HIGH') AND lead IS NOT NULL),
f AS (SELECT claim_id, len(list_filter({_list(fixed.REASON)}, lambda x: starts_with(p, x || ' '))) > 0 AS opens, len(list_filter({_list(fixed.CONCLUSION)}, lambda x: contains(p, ' ' || x || ' '))) > 0 AS later FROM l)
SELECT claim_id, CASE WHEN opens THEN 'opens-with-reason' ELSE 'conclusion-later' END AS problem FROM f WHERE opens OR later""")
def _(c):
    normative = c.documents().where(F.col("type").isin(*_NORMATIVE)).select("doc_id")
    rows = c.statements().where(F.col("lead").isNotNull()).join(normative, "doc_id", "left_semi")
    return claims.buried_leads(rows.select("claim_id", F.col("lead").alias("text")))


_TAILS = ("Studies show gains.", "it is generally, of course, fine, and generally so.", "Needless to say: significantly better. Best-in-class.", "Obviously it is industry-leading in some cases.")
_BODIES = f"""prose AS (SELECT doc_id, string_agg(text, ' ' ORDER BY pos, text) || CASE WHEN doc_id % 8 < 4 THEN ' Clearly, ' || {_list(_TAILS)}[doc_id % 8 + 1] ELSE '' END AS body FROM statements GROUP BY doc_id)"""


def bodies(c):
    """Documents' statements one after the other, some with marked phrases."""
    extra = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = c.statements_by("doc_id").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text")))["text"], " ").alias("body"))
    return rows.withColumn("body", F.concat("body", F.when(F.col("doc_id") % 8 < 4, F.concat(F.lit(" Clearly, "), extra)).otherwise("")))


def _consumed_sql(source: str, text: str, markers) -> str:
    """A WITH entry for each marker, longest first: ``left_n`` has the line that is left; ``marked (doc_id, phrase, role)`` what was found."""
    ordered = sorted(markers, key=lambda m: -len(m[0]))
    out = [f"left_0 AS (SELECT doc_id, {PAD.format(text)} AS p FROM {source})"]
    found = []
    for i, (phrase, role) in enumerate(ordered):
        hit = f"regexp_matches(p, {_q(f' {phrase}[ ,.]')})"
        found.append(f"SELECT doc_id, {_q(phrase)} AS phrase, {_q(role)} AS role FROM left_{i} WHERE {hit}")
        out.append(f"left_{i + 1} AS (SELECT doc_id, CASE WHEN {hit} THEN replace(p, {_q(phrase)}, ' ') ELSE p END AS p FROM left_{i})")
    return ", ".join([*out, f"marked AS ({' UNION ALL '.join(found)})"])


#: Marked phrases of a text: the roles of language, and the registers of causation as two more.
_MARKERS = (*fixed.LANGUAGE, *((p, "intervention") for p in fixed.INTERVENTION), *((p, "association") for p in fixed.ASSOCIATION))


@query("phrase_markers", f"WITH {_BODIES}, {_consumed_sql('prose', 'body', _MARKERS)} SELECT doc_id, phrase, role FROM marked")
def _(c):
    return bodies(c).select("doc_id", F.explode(mk.consume(F.col("body"), _MARKERS)).alias("m")).select("doc_id", "m.phrase", "m.role")


@query("check_language", f"""WITH {_BODIES}, {_consumed_sql('prose', 'body', fixed.LANGUAGE)}
SELECT doc_id, count(*)::INTEGER AS n, string_agg('"' || phrase || '" (' || role || ')', ', ' ORDER BY phrase) AS markers FROM marked GROUP BY doc_id""")
def _(c):
    return claims.marked_language(bodies(c), fixed.LANGUAGE).withColumnRenamed("message", "markers")


@query("gate_hedging", f"WITH {_BODIES} SELECT doc_id, CASE WHEN len({first_of(PAD.format('body'), fixed.HEDGED)}) > 3 THEN 'fail' ELSE 'pass' END AS state FROM prose")
def _(c):
    found = F.size(mk.present(F.col("body"), fixed.HEDGED))
    return bodies(c).select("doc_id", checks.ordered_state(found <= 3).alias("state"))


_OPS = "{" + ", ".join(f"{_q(p)}: {_q(op)}" for p, op in fixed.BOUNDS) + "}"
_SPELLED = [w for words in (fixed.SMALL_NUMBERS, fixed.TENS, [w for w, _ in fixed.SCALES], [w for w, _ in fixed.FRACTIONS], ("and", "a")) for w in words]
_FRACTION = "|".join(w for w, _ in fixed.FRACTIONS)
#: Bounds by a table of all numbers below a thousand in words, looked up part by part.
_BOUND = rf"""tens AS (SELECT n, CASE WHEN n < 20 THEN {_list(fixed.SMALL_NUMBERS)}[n + 1] WHEN n % 10 = 0 THEN {_list(fixed.TENS)}[n // 10 - 1] ELSE {_list(fixed.TENS)}[n // 10 - 1] || ' ' || {_list(fixed.SMALL_NUMBERS)}[n % 10 + 1] END AS word FROM (SELECT unnest(range(0, 100)) AS n)),
spelled AS (SELECT n, word FROM tens UNION ALL SELECT h.n * 100, h.word || ' hundred' FROM tens h WHERE h.n BETWEEN 1 AND 19 UNION ALL SELECT h.n * 100 + t.n, h.word || ' hundred ' || j || t.word FROM tens h, tens t, (VALUES (''), ('and ')) v(j) WHERE h.n BETWEEN 1 AND 19 AND t.n > 0),
apart AS (SELECT claim_id, pos, ' ' || trim(regexp_replace(regexp_replace(regexp_replace(lower({FOLD.format('text')}), '([;:!?()\[\]]|[.,]([^0-9]|$)|[.,]$)', ' \1', 'g'), '(^|[^0-9])([.,])', '\1 \2 ', 'g'), '\s+', ' ', 'g')) || ' ' AS t FROM statements),
chosen AS (SELECT *, list_filter({_longest(p for p, _ in fixed.BOUNDS)}, lambda x: contains(t, ' ' || x || ' '))[1] AS phrase FROM apart),
rest AS (SELECT *, ltrim(substr(t, instr(t, ' ' || phrase || ' ') + length(phrase) + 2), ' .,;:%)') AS r FROM chosen WHERE phrase IS NOT NULL),
token AS (SELECT *, string_split(regexp_replace(r, '({"|".join(fixed.TENS)})-', '\1 '), ' ') AS w, regexp_extract(r, '^([0-9][0-9,]*([.][0-9]+)?)([a-z]*%*) ', 1) AS n, regexp_extract(r, '^([0-9][0-9,]*([.][0-9]+)?)([a-z]*%*) ', 3) AS unit FROM rest),
run AS (SELECT *, regexp_replace(array_to_string(w[1:coalesce(list_position(list_transform(w, lambda x, i: i > CASE WHEN n = '' THEN 0 ELSE 1 END AND x NOT IN ({', '.join(map(_q, _SPELLED))})), true), len(w) + 1) - 1], ' '), '( and| and a)$', '') AS run FROM token),
split AS (SELECT *, regexp_extract(run, '^(.*?)(?: and)?(?:^| )(a|one|two|three)? ?({_FRACTION})$', 3) AS f FROM run WHERE run <> '' AND NOT starts_with(run, 'a ')),
cut AS (SELECT *, CASE WHEN f = '' THEN run WHEN contains(run, ' and ') THEN regexp_replace(run, ' and [a-z]+ [a-z]+$', '') WHEN run = f THEN '' ELSE regexp_replace(run, ' [a-z]+$', '') END AS whole, coalesce(nullif(regexp_extract(run, ' and ([a-z]+) [a-z]+$', 1), ''), 'a') AS top, contains(run, ' and ') AS plus FROM split),
scaled AS (SELECT *, regexp_extract(whole, '^(?:(.+?) million)?(?: and)? ?(?:(.+?) thousand)?(?: and)? ?(.*)$', ['m', 'k', 'u']) AS g FROM cut),
worth AS (SELECT s.*, CASE WHEN s.n <> '' AND whole = s.n || unit THEN try_cast(replace(s.n, ',', '') AS DOUBLE) WHEN s.n <> '' AND unit = '' AND whole = s.n || ' million' THEN try_cast(replace(s.n, ',', '') AS DOUBLE) * 1000000
 WHEN whole = '' THEN 1 WHEN (m.n IS NULL AND g.m <> '') OR (k.n IS NULL AND g.k <> '') OR (u.n IS NULL AND g.u <> '') THEN NULL ELSE coalesce(m.n, 0) * 1000000.0 + coalesce(k.n, 0) * 1000.0 + coalesce(u.n, 0) END AS base
 FROM scaled s LEFT JOIN spelled m ON m.word = g.m LEFT JOIN spelled k ON k.word = g.k LEFT JOIN spelled u ON u.word = g.u),
part AS (SELECT *, CASE WHEN f <> '' THEN 1.0 / MAP {{{', '.join(f"{_q(w)}: {n}" for w, n in fixed.FRACTIONS)}}}[f] END AS each, list_position(['a', 'two', 'three'], CASE top WHEN 'one' THEN 'a' ELSE top END) AS times FROM worth),
bound AS (SELECT *, round(CASE WHEN f = '' THEN base WHEN plus THEN base + times * each ELSE base * each END, 6) AS value FROM part)"""


@query("parse_bound", f"""WITH {_BOUND} SELECT claim_id, pos, phrase, element_at(MAP {_OPS}, phrase)[1] AS op, value,
CASE WHEN n <> '' AND run = n || unit THEN replace(n, ',', '') || unit WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE rtrim(value::DECIMAL(18, 6)::VARCHAR, '0') END AS raw FROM bound WHERE value IS NOT NULL""")
def _(c):
    return c.statements().select("claim_id", "pos", nb.parse_bound(F.col("text")).alias("b")).where("b IS NOT NULL").select("claim_id", "pos", "b.phrase", "b.op", "b.value", "b.raw")


@query("written_dimension", f"WITH u AS (SELECT claim_id, pos, number, lower(regexp_extract(number, '[0-9]([^0-9.]*)$', 1)) AS unit FROM statements) SELECT claim_id, pos, number, CASE {' '.join(f'WHEN unit IN ({chr(44).join(map(_q, v))}) THEN {_q(k)}' for k, v in fixed.UNITS.items())} END AS dimension FROM u")
def _(c):
    return c.statements().select("claim_id", "pos", "number", fx.written_dimension(F.col("number")).alias("dimension"))


def _claims_sql(source: str) -> str:
    """Claims of the sentences of ``(id, t)``."""
    cuts = ", ".join(f"{{'at': nullif(instr(lower(s), {_q(x)}), 0), 'rank': {i}, 'size': {len(x)}}}" for i, x in enumerate(fixed.CUTS))
    dependent = "^(" + "|".join(fixed.REASON + fixed.CONCLUSION) + ")([^a-z0-9_-]|$)"
    plain = "lower(trim({0}, ',.;:!?\"'''))"
    subject = f"list_position(list_transform({{0}}[2:], lambda w: {plain.format('w')} IN ({', '.join(map(_q, fixed.COPULAS))})), true)"
    return rf"""line AS (SELECT id, list_filter(string_split(trim(regexp_replace(t, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM {source}),
sent AS (SELECT id, list_filter(list_transform(string_split(array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i] || CASE WHEN regexp_matches(coalesce(w[i + 1], ''), '^\p{{Lu}}')
 AND (regexp_matches(w[i], '[!?]$') OR (regexp_matches(w[i], '[.]$') AND length(w[i]) <> 2 AND NOT contains(substr(w[i], 1, length(w[i]) - 1), '.'))) THEN chr(1) ELSE ' ' END), ''), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM line),
one AS (SELECT id, unnest(ss) AS s, unnest(range(0, len(ss))) AS k FROM sent),
cut AS (SELECT *, list_sort(list_filter([{cuts}], lambda x: x.at IS NOT NULL))[1] AS j FROM one),
side AS (SELECT *, trim(substr(s, 1, j.at - 1)) AS l, trim(substr(s, j.at + j.size)) AS r FROM cut),
word AS (SELECT *, string_split(l, ' ') AS lw, string_split(r, ' ') AS rw FROM side),
judged AS (SELECT *, coalesce({plain.format('rw[1]')} IN ({', '.join(map(_q, fixed.PRONOUNS))}), false) AS pronoun, coalesce({subject.format('lw')}, 0) AS ln, coalesce({subject.format('rw')}, 0) AS rn FROM word),
good AS (SELECT *, j IS NOT NULL AND l <> '' AND r <> '' AND NOT regexp_matches(lower(r), {_q(dependent)}) AND CASE WHEN pronoun THEN ln > 0 ELSE rn > 0 END AS ok,
 CASE WHEN pronoun THEN array_to_string(lw[1:ln], ' ') || ' ' || array_to_string(rw[2:], ' ') ELSE r END AS made FROM judged),
parts AS (SELECT id, k, unnest(CASE WHEN ok THEN [{{'text': l, 'anchor': l, 'substituted': false}}, {{'text': upper(made[1]) || made[2:], 'anchor': r, 'substituted': pronoun}}] ELSE [{{'text': s, 'anchor': s, 'substituted': false}}] END) AS p FROM good)
SELECT id, p.text AS text, p.anchor AS anchor, p.substituted AS substituted FROM parts"""


@query("claims_from_text", f"WITH src AS (SELECT doc_id AS id, body AS t FROM texts), {_claims_sql('src')}")
def _(c):
    return c.texts().select(F.col("doc_id").alias("id"), F.explode(fx.claims_from_text(F.col("body"))).alias("p")).select("id", "p.text", "p.anchor", "p.substituted")


@query("claims_from_statements", f"WITH src AS (SELECT claim_id AS id, text AS t FROM statements), {_claims_sql('src')}")
def _(c):
    return c.statements().select(F.col("claim_id").alias("id"), F.explode(fx.claims_from_text(F.col("text"))).alias("p")).select("id", "p.text", "p.anchor", "p.substituted")


@query("claim_rows", f"""WITH {_BODIES}, a AS (SELECT doc_id, claim_id, pos AS place, CASE WHEN pos % 7 = 0 THEN upper(text) ELSE text END AS anchor, lead FROM statements)
SELECT doc_id, claim_id, place, lead, sha256({FOLD.format('anchor')}) AS anchor_hash, nullif(instr(body, anchor), 0) - 1 AS pos FROM a JOIN prose USING (doc_id)""")
def _(c):
    anchor = F.when(F.col("pos") % 7 == 0, F.upper("text")).otherwise(F.col("text"))
    rows = c.statements().select("doc_id", "claim_id", F.col("pos").alias("place"), "lead", anchor.alias("anchor")).join(bodies(c), "doc_id")
    at = F.nullif(F.expr("instr(body, anchor)"), F.lit(0)) - 1
    return rows.select("doc_id", "claim_id", "place", "lead", F.sha2(fx.fold(F.col("anchor")).cast("binary"), 256).alias("anchor_hash"), at.alias("pos"))


@query("duplicate_evidence", f"""WITH q AS (SELECT DISTINCT doc_id, {FOLD.format('unnest(quotes)')} AS quote FROM statements), k AS (SELECT doc_id, string_agg(quote, chr(0) ORDER BY quote) AS evidence FROM q WHERE quote <> '' GROUP BY 1)
SELECT sha256(evidence) AS evidence, count(*) AS documents, min(doc_id) AS first_doc FROM k GROUP BY evidence HAVING count(*) >= 2""")
def _(c):
    return conflict.duplicate_evidence(c.statements_by("doc_id").select("doc_id", F.explode("quotes").alias("quote")))


@query("anchor_collision", f"SELECT doc_id, {FOLD.format('split_part(text, chr(44), 1)')} AS anchor, count(*) AS claims, string_agg(claim_id, ',' ORDER BY claim_id) AS ids FROM statements GROUP BY 1, 2 HAVING count(*) >= 2")
def _(c):
    return conflict.anchor_collision(c.statements_by("doc_id").select("doc_id", "claim_id", F.substring_index("text", ",", 1).alias("anchor")))


@query("check_anchor_absent", f"WITH {_BODIES}, a AS (SELECT doc_id, claim_id, CASE WHEN pos % 5 = 0 THEN replace(text, 'load', 'loads') ELSE replace(text, ' ', '  ') END AS anchor FROM statements) SELECT claim_id, doc_id FROM a JOIN prose USING (doc_id) WHERE NOT contains({FOLD.format('body')}, {FOLD.format('anchor')})")
def _(c):
    anchor = F.when(F.col("pos") % 5 == 0, F.replace(F.col("text"), F.lit("load"), F.lit("loads"))).otherwise(F.replace(F.col("text"), F.lit(" "), F.lit("  ")))
    return claims.absent_anchors(c.statements_by("doc_id").select("doc_id", "claim_id", anchor.alias("anchor")), bodies(c))


_ARCHIVE = f"""arch AS (SELECT uri AS source, string_agg(quote, ' ' ORDER BY quote) AS text FROM (SELECT DISTINCT uri, unnest(quotes) AS quote FROM statements) WHERE uri % 9 <> 0 GROUP BY 1),
quoted AS (SELECT claim_id, pos, CASE WHEN uri % 4 = 0 THEN uri + 1 ELSE uri END AS source, unnest(CASE WHEN pos = 2 THEN list_append(quotes, 'too short') WHEN pos IN (3, 6) THEN list_append(quotes, quotes[1] || ' … ' || quotes[CASE WHEN pos = 3 THEN 2 ELSE 1 END] || '...') ELSE quotes END) AS quote FROM statements),
pieces AS (SELECT *, list_filter(list_transform(string_split(replace({FOLD.format('quote')}, '...', '…'), '…'), lambda x: trim(x)), lambda x: x <> '') AS p, {FOLD.format('text')} AS t FROM quoted LEFT JOIN arch USING (source)),
stated AS (SELECT claim_id, pos, source, quote, CASE WHEN t IS NULL OR len(list_filter(p, lambda x: len(string_split(x, ' ')) < 6)) > 0 THEN 'unchecked' WHEN contains(t, p[1]) AND (len(p) = 1 OR contains(substr(t, instr(t, p[1]) + length(p[1])), p[2])) THEN 'found' ELSE 'missing' END AS state FROM pieces)"""


def archive(c):
    """Archived text of most sources: the quotes that statements take from them."""
    rows = c.statements_by("uri").where("uri % 9 <> 0").select(F.col("uri").alias("source"), F.explode("quotes").alias("quote")).distinct()
    return rows.groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("quote")), " ").alias("text"))


def quoted(c):
    """Quotes of statements; some look in another source than their own, some are short, some leave out what stands between."""
    first, last = F.get("quotes", F.lit(0)), F.get("quotes", F.when(F.col("pos") == 3, 1).otherwise(0))
    cut = F.concat(first, F.lit(" … "), last, F.lit("..."))
    quotes = F.when(F.col("pos") == 2, F.array_append("quotes", F.lit("too short"))).when(F.col("pos").isin(3, 6), F.array_append("quotes", cut)).otherwise(F.col("quotes"))
    source = F.when(F.col("uri") % 4 == 0, F.col("uri") + 1).otherwise(F.col("uri"))
    return c.statements().select("claim_id", "pos", source.alias("source"), F.explode(quotes).alias("quote"))


@query("quote_check", f"WITH {_ARCHIVE} SELECT claim_id, pos, source, quote, state FROM stated")
def _(c):
    rows = quoted(c).withColumn("quote_id", F.struct("claim_id", "pos", "quote"))
    return checks.quote_check(rows.select("quote_id", "quote", "source"), archive(c)).select("quote_id.claim_id", "quote_id.pos", "source", "quote_id.quote", "state")


@query("check_evidence", f"WITH {_ARCHIVE} SELECT 'error' AS severity, 'evidence' AS category, claim_id AS path, quote AS message FROM stated WHERE state = 'missing'")
def _(c):
    rows = quoted(c).withColumn("quote_id", F.struct("claim_id", "quote"))
    found = checks.quote_check(rows.select("quote_id", "quote", "source"), archive(c)).where("state = 'missing'")
    return checks.finding(found, "error", "evidence", F.col("quote_id.claim_id"), F.col("quote_id.quote"))


_UPSTREAM = f"""old AS (SELECT uri, string_agg(quote, ' ' ORDER BY quote) AS body, list_sort(list(quote)) AS quotes FROM (SELECT DISTINCT uri, unnest(list_append(quotes, CASE WHEN uri % 11 = 0 THEN 'short one' END)) AS quote FROM statements) WHERE quote IS NOT NULL GROUP BY 1),
new AS (SELECT uri, CASE uri % 5 WHEN 0 THEN replace(body, 'handles', 'slows') WHEN 1 THEN NULL WHEN 2 THEN body || ' More.' WHEN 3 THEN replace(body, 'The ', 'One ') ELSE body END AS text FROM old)"""


def upstream(c):
    """Sources with their quotes, and what became of their texts."""
    quotes = F.when(F.col("uri") % 11 == 0, F.array_append("quotes", F.lit("short one"))).otherwise(F.col("quotes"))
    old = c.statements().select("uri", F.explode(quotes).alias("quote")).distinct().groupBy("uri").agg(F.sort_array(F.collect_list("quote")).alias("quotes"))
    old = old.withColumn("body", F.array_join("quotes", " "))
    body, kind = F.col("body"), F.col("uri") % 5
    text = F.when(kind == 0, F.replace(body, F.lit("handles"), F.lit("slows"))).when(kind == 2, F.concat(body, F.lit(" More."))).when(kind == 3, F.replace(body, F.lit("The "), F.lit("One "))).when(kind == 4, body)
    new = old.select("uri", text.alias("text")).withColumn("new_sha", F.sha2(F.col("text").cast("binary"), 256))
    return old.select("uri", F.sha2(body.cast("binary"), 256).alias("old_sha"), "quotes"), new


@query("drift", f"""WITH {_UPSTREAM}, each AS (SELECT uri, quote, CASE WHEN len(string_split({FOLD.format('quote')}, ' ')) < 6 OR text IS NULL THEN 'unchecked' WHEN contains({FOLD.format('text')}, {FOLD.format('quote')}) THEN 'found' ELSE 'missing' END AS state FROM (SELECT uri, unnest(quotes) AS quote FROM old) JOIN new USING (uri)),
f AS (SELECT uri, count(*) FILTER (WHERE state = 'unchecked') AS short, string_agg(DISTINCT quote, '|' ORDER BY quote) FILTER (WHERE state = 'missing') AS gone FROM each GROUP BY 1),
s AS (SELECT uri, gone, CASE WHEN text IS NULL THEN 'unchecked' WHEN text = body THEN 'none' WHEN gone IS NOT NULL THEN 'unsupported' WHEN short > 0 THEN 'unchecked' ELSE 'benign' END AS drift FROM old JOIN new USING (uri) JOIN f USING (uri))
SELECT uri, drift, CASE WHEN drift = 'unsupported' THEN gone ELSE '' END AS missing FROM s""")
def _(c):
    return checks.drift(*upstream(c))


@query("recheck_findings", f"""WITH {_UPSTREAM}, q AS (SELECT uri, unnest(quotes) AS quote, unnest(range(0, len(quotes))) AS pos FROM old)
SELECT uri, pos, quote FROM q JOIN new USING (uri) JOIN old USING (uri) WHERE text <> body AND NOT contains({FOLD.format('text')}, {FOLD.format('quote')})""")
def _(c):
    return claims.lost_quotes(*upstream(c))
