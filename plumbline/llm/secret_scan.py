"""Secret scan over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text.  The ledger
holds one row per (blob, rule version) with that blob's findings, so a run scans
only pairs that the ledger lacks and joins findings back to all paths.  Scanning
uses regular expressions of the SQL engine only.

Offsets come from splitting: the pieces between matches and the matches
themselves add up to the text, so a match starts where they say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch, column, fresh, without


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYWORD = "(" + "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")]) + ")"

#: (kind, pattern, group whose length counts, least length).  Matches of the pattern
#: are leftmost and don't overlap; those with a shorter group are dropped.
RULES = (
    ("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
BASE = ("assign", "access", "hex")
#: Changes whenever RULES does.
RULES_VERSION = "1"

#: What a text must contain for a rule to find anything; quicker than the rule.
_HINT = {"assign": _KEYWORD + r"""["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", "pem": "-----BEGIN ", "jwt": "eyJ[A-Za-z0-9_-]+[.]"}

_SPANS = "array<struct<start:int,kind_rank:int,end:int,kind:string>>"


def rule_spans(text: Column, kind: str) -> Column:
    """``array<struct<start, kind_rank, end, kind>>`` of one rule, in code points, end exclusive."""
    rank, (_, pattern, group, least) = next((i, r) for i, r in enumerate(RULES) if r[0] == kind)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(
        F.zip_with(gaps, whole, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("size"))),
        counted,
        lambda x, c: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.char_length(c).alias("counts")),
    )
    steps = F.filter(steps, lambda x: x["size"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("kind_rank"), end.alias("end"), F.lit(kind).alias("kind"))
        found = F.when(x["counts"] >= least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.when(text.rlike(_HINT[kind]), F.aggregate(steps, start, step, lambda acc: acc["found"])).otherwise(F.array().cast(_SPANS))


def scan_texts(blobs: DataFrame) -> DataFrame:
    """``blob`` with ``spans`` of all rules, by start and then rule."""
    kinds = [r[0] for r in RULES]
    out = blobs.select("blob", *(rule_spans(F.col("text"), kind).alias(kind) for kind in kinds))
    return out.select("blob", F.array_sort(F.concat(*kinds)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules_version: str = RULES_VERSION) -> tuple[DataFrame, DataFrame]:
    """Findings of every row of ``versions``, and the ledger with the new pairs added.

    ``versions`` has ``doc_id`` (the path) and ``text``; all other columns are
    kept and ``blob`` and ``spans`` added (replacing columns of those names).
    ``ledger`` is ``(blob, rules_version, spans)`` of earlier runs.

    One row of each unseen blob is scanned: the one with the least doc_id, found
    by pre-aggregated digests.  Texts move once, by digest and doc_id, so that
    thousands of copies of a text spread over all tasks.  Null text is empty;
    repeated rows and copies share a blob and each get its findings; a null
    doc_id is a path like any other.  Very long texts are scanned whole.  An empty
    table gives no findings and leaves the ledger as it was.
    """
    spark, scratch = versions.sparkSession, Scratch(versions.sparkSession, "secret-scan")
    kept = without(versions.columns, ("blob", "spans"))
    path = fresh([*versions.columns, "blob", "spans"], "path")[0]
    text = F.coalesce("text", F.lit(""))
    paths = versions.select(*map(column, kept), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    unseen = paths.groupBy("blob").agg(F.min(doc).alias(path))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    todo = paths.select("blob", doc.alias(path), text.alias("text")).join(unseen, ["blob", path], "left_semi")
    scanned = scan_texts(todo).select("blob", F.lit(rules_version).alias("rules_version"), "spans")
    # Written before any filter on spans, which would pull the scan below the join and over all texts.
    added = scratch.put(scanned, "scanned").dropDuplicates(["blob"])
    whole = added if ledger is None else ledger.unionByName(added)
    findings = whole.where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).select("blob", "spans")
    out = paths.join(findings, "blob", "left")
    out = out.select(*map(column, kept), "blob", F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"))
    return out, whole


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, _ = scan_versions(docs)
    spans = F.col("spans")
    counts = [F.size(_of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = span_list(_of_kinds(spans, *BASE))
    return out.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(spans).alias("spans"))


def _sql_rule(kind: str) -> str:
    rank, (_, pattern, group, least) = next((i, r) for i, r in enumerate(RULES) if r[0] == kind)
    pattern = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {rank} AS kind_rank, '{kind}' AS kind, s + list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT AS start_at, length(m[i]) AS size
FROM (SELECT doc_id, gaps, m, c, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps, regexp_extract_all(coalesce(text, ''), '{pattern}') AS m,
         regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) AS c FROM documents)),
LATERAL (SELECT coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s) WHERE length(c[i]) >= {least}"""


OP4_SQL = f"""
WITH found AS ({" UNION ALL ".join(_sql_rule(r[0]) for r in RULES)}),
listed AS (SELECT doc_id, kind, kind_rank, start_at, kind || ':' || start_at || ':' || (start_at + size) AS span FROM found),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS a, count(*) FILTER (WHERE kind = 'access') AS c, count(*) FILTER (WHERE kind = 'hex') AS h,
  string_agg(span, ',' ORDER BY start_at, kind_rank) FILTER (WHERE kind_rank < 3) AS base, string_agg(span, ',' ORDER BY start_at, kind_rank) AS spans FROM listed GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""
