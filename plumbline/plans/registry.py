"""Where queries and their SQL are kept by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.bind import SQL_TABLES, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The functions behind the queries, for use on a corpus that is there.
MAKERS: dict[str, Callable[[Corpus], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a ``Corpus``; ``sql`` may use the corpus tables by name."""

    def register(make: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        MAKERS[name] = make
        QUERIES[name] = lambda spark, sf_dir: make(Corpus(spark, sf_dir))
        if sql:
            body = sql.strip()
            ORACLE_SQL[name] = f"WITH {SQL_TABLES}{',' + body[5:] if body.startswith('WITH ') else body}"
        return make

    return register
