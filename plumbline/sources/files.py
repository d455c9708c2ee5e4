"""Reading and writing corpus files: documents with front matter, line-wise JSON logs, index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import sampling

_HEAD = r"(?s)^---\n(.*?\n)?---(\n|$)"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of all markdown files below a folder; Spark gives no row for a file of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def parse_corpus(files: DataFrame) -> DataFrame:
    """``(path, type, title, body, bytes, content_hash, invalid)`` of files ``(path, content)``.

    ``index.md`` and ``log.md`` are no documents.  A bad document stays and
    ``invalid`` says why: no content, no front matter, no type, or no body.
    """
    rows = files.where(~F.col("path").rlike(r"(^|/)(index|log)\.md$"))
    text = F.coalesce("content", F.lit(""))
    headed, body = text.rlike(_HEAD), F.regexp_replace(text, _HEAD, "")
    head = F.when(headed, F.regexp_extract(text, _HEAD, 1)).otherwise("")
    kind = _field(head, "type")
    blank = F.lit(" \t\r\n")
    invalid = F.when(F.btrim(text, blank) == "", "empty").when(~headed, "no-front-matter").when(kind.isNull(), "no-type").when(F.btrim(body, blank) == "", "no-body")
    return rows.select(
        "path", kind.alias("type"), _field(head, "title").alias("title"), body.alias("body"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text.cast("binary"), 256).alias("content_hash"), invalid.alias("invalid"),
    )


def parse_jsonl(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a log ``(line, text)`` by ``schema``; blank lines are skipped, ``malformed`` marks lines that aren't such JSON."""
    rows = lines.where(F.trim("text") != "").withColumn("row", F.from_json("text", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return rows.withColumn("malformed", F.col("row").isNull() | F.col("row._corrupt").isNotNull()).select("line", "malformed", F.col("row").dropFields("_corrupt").alias("row"))


def extract_links(documents: DataFrame, prefix: str) -> DataFrame:
    """Links ``(source_doc, href, target_doc, external)`` in the bodies of ``documents (doc_id, body)``.

    A link is internal iff it starts with ``prefix`` and goes on with a number;
    its target is null if no document has that.
    """
    hrefs = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    rows = documents.select(F.col("doc_id").alias("source_doc"), F.explode(hrefs).alias("href"))
    rows = rows.withColumn("to", F.regexp_extract("href", f"^{prefix}([0-9]+)$", 1).try_cast("long"))
    known = documents.select(F.col("doc_id").alias("target_doc")).distinct()
    return rows.join(known, F.col("to") == F.col("target_doc"), "left").select("source_doc", "href", "target_doc", F.col("to").isNull().alias("external"))


def export_rows(documents: DataFrame, claims: DataFrame) -> DataFrame:
    """``(doc_id, json)``: one JSON row per document, claims nested in order, dates as ``YYYY-MM-DD``."""
    nested = claims.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("claim_id", "lead"))).alias("claims"))
    none = F.array().cast("array<struct<claim_id:string,lead:string>>")
    rows = documents.join(nested, "doc_id", "left").withColumn("claims", F.coalesce("claims", none)).withColumn("stale_after", F.date_format("stale_after", "yyyy-MM-dd"))
    row = F.struct("doc_id", "path", "type", "title", "status", "stale_after", (F.trim("status") == "").alias("invalid"), "claims")
    return rows.select("doc_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def export_corpus(documents: DataFrame, claims: DataFrame, path: str) -> None:
    """Write ``export_rows`` as JSON lines."""
    export_rows(documents, claims).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def rebuild_index(tables: dict[str, DataFrame], folder: str, floor: float = 0.5) -> DataFrame:
    """Replace the derived tables of ``folder``; ``(name, n, digest)`` of what was written.

    Each table goes to a folder beside the old one first.  A table that lost more
    than the floor allows is refused and the old one stays.
    """
    spark, out = next(iter(tables.values())).sparkSession, None
    jvm = spark._jvm
    for name, df in tables.items():
        old, new = f"{folder}/{name}", f"{folder}/{name}.new"
        df.write.mode("overwrite").parquet(new)
        at, fresh = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
        system = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(at):
            if sampling.floor_breached(spark.read.parquet(old).count(), spark.read.parquet(new).count(), floor):
                system.delete(fresh, True)
                raise ValueError(f"{name} lost too many rows")
            system.delete(at, True)
        system.rename(fresh, at)
        digest = sampling.table_digest(spark.read.parquet(old)).select(F.lit(name).alias("name"), "n", "digest")
        out = digest if out is None else out.unionByName(digest)
    return out
