"""The corpus pipeline: five stages, each written as Parquet and read by the next.

Language ID names the language of documents that come without one and drops those
it can't place; SimHash keeps one document of each group of near duplicates; decontamination drops documents with a benchmark
window; mixing takes each document as often as its source's target asks; token
output encodes what is left and describes each document of the shards.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, language_id, mixing, simhash, token_output
from plumbline.llm.scratch import Scratch, column


_USED = ("doc_id", "text", "lang", "source")
#: Rows that reach a worker at a time.
_BATCH_ROWS = 1000


def limit_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to workers in small batches, which bounds the memory of both sides; a lower setting stays.

    The session keeps that setting, as stages run when their rows are asked for.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= _BATCH_ROWS:
        spark.conf.set(name, _BATCH_ROWS)


def with_all_columns(stage: Callable) -> Callable:
    """``stage`` with all columns but those it works on out of the way of the names it adds, and back after."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        limit_batches(spark)
        names = {c: c if c in _USED else f"aside_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[column(c).alias(name) for c, name in names.items()]), sf_dir)
        return out.select(*[column(name).alias(c) for c, name in names.items()])

    return run_stage


@with_all_columns
def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that language ID can't place, and fill in ``lang`` where it is null.

    Those it can't place have a null text or one without a letter.  The model
    learns from this stage's own input.  With no language to learn from, nothing
    can be placed and nothing is dropped.
    """
    model = language_id.train(language_id.training_rows(docs))
    if not model.langs:
        return docs
    named = language_id.identify(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return named.withColumn("lang", F.coalesce("lang", "lang_pred"))


@with_all_columns
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@with_all_columns
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.col("n_hit") == 0)


@with_all_columns
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    return mixed.select(*map(column, docs.columns), F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("copy"))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return token_output.token_output(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: Token ids and language scores are beyond SQL; tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``; a stage's rows are cut from its lineage by a table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.put(docs, name)
    return docs
