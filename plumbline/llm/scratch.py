"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``.  Where that is unset and
Spark runs on one machine, a temporary folder is made once and set for the
session; on a cluster it must be set.  A table written here cuts lineage and
survives the loss of an executor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set to a new local one only if it has none and runs locally."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def column(name: str) -> Column:
    """A column by its exact name, whatever signs that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` before it as it takes to be like none of ``taken`` (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def without(taken: Iterable[str], added: Iterable[str]) -> list[str]:
    """Those of ``taken`` that are like none of ``added`` (in any case)."""
    added = {c.lower() for c in added}
    return [c for c in taken if c.lower() not in added]


class Scratch:
    """Tables of one run under a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, *partition_by: str, **options: str) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back."""
        writer = df.write.mode("overwrite").options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path(name))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
