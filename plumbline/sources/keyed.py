"""A stored table of one row per key that batches are merged into.

The base is bucketed and sorted by key.  A batch is aggregated by key and stored
as a delta; it is known by its id, so that a batch that is
run again changes nothing.  A read adds up the deltas and joins them to the base
bucket by bucket, without a shuffle of the base, and a compaction writes what a read gives as the base of a
new version.  Every change is a new version; a reader that keeps one sees the same
rows whatever is merged meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MERGED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": lambda a, b: F.when(b.isNull() | (a >= b), a).otherwise(b), "min": lambda a, b: F.when(b.isNull() | (a <= b), a).otherwise(b)}
_AGGREGATED = {"sum": F.sum, "max": F.max, "min": F.min}


class KeyedTable:
    """Rows ``(keys, columns)`` in a folder; ``merge`` says how each column's values of one key become one: sum, max or min.

    A column of structs under ``max`` keeps the row that is last by its fields.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merge: dict[str, str], buckets: int = 8):
        self.spark, self.folder, self.keys, self.merge, self.buckets = spark, folder.rstrip("/"), keys, merge, buckets

    # ---- versions

    def _system(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The versions there are, oldest first."""
        at, system = self._system(f"{self.folder}/versions")
        if not system.exists(at):
            return []
        return sorted(int(x.getPath().getName().split("=")[1]) for x in system.listStatus(at) if x.getPath().getName().startswith("v="))

    def _manifest(self, version: int | None) -> dict:
        """What a version is made of: its base and deltas by name, the ids of all batches in it, and the schema."""
        if version is None:
            found = self.versions()
            if not found:
                return {"base": None, "deltas": [], "batches": [], "schema": None}
            version = found[-1]
        return json.loads(self.spark.read.text(f"{self.folder}/versions/v={version}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> int:
        """Publish a version: its folder is written aside and renamed, which only one of two writers can do."""
        version = (self.versions() or [0])[-1] + 1
        aside, target = f"{self.folder}/aside-{uuid.uuid4().hex[:12]}", f"{self.folder}/versions/v={version}"
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(aside)
        (source, system), (to, _) = self._system(aside), self._system(target)
        system.mkdirs(to.getParent())
        if system.exists(to) or not system.rename(source, to):
            raise RuntimeError(f"version {version} was written by another run")
        return version

    # ---- parts

    def _name(self, part: str) -> str:
        return f"keyed_{part.replace('-', '_')}"

    def _write_base(self, rows: DataFrame, part: str) -> None:
        """Store rows of one per key, in buckets."""
        name = self._name(part)
        rows.repartition(self.buckets, *self.keys).write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{part}").saveAsTable(name)

    def _part(self, part: str, schema: str) -> DataFrame:
        """A stored base as a bucketed table; one that another session wrote is made known to this one."""
        name = self._name(part)
        if not self.spark.catalog.tableExists(name):
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(schema)))
            keys = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{part}'")
        return self.spark.table(name)

    def _aggregated(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[_AGGREGATED[how](c).alias(c) for c, how in self.merge.items()])

    def _joined(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Two parts as one, by a merge join of their sorted buckets."""
        other = b.withColumnsRenamed({c: f"_{c}" for c in self.merge})
        both = a.hint("merge").join(other, self.keys, "full_outer")

        def one(c: str, how: str) -> Column:
            mine, new = F.col(c), F.col(f"_{c}")
            return (_MERGED[how](mine, new) if how == "sum" else F.when(mine.isNull(), new).otherwise(_MERGED[how](mine, new))).alias(c)

        return both.select(*self.keys, *[one(c, how) for c, how in self.merge.items()])

    # ---- what one does with it

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        found = self._manifest(version)
        if not found["deltas"] and not found["base"]:
            raise ValueError("nothing was merged yet")
        base = self._part(found["base"], found["schema"]) if found["base"] else None
        if not found["deltas"]:
            return base
        schema = T.StructType.fromJson(json.loads(found["schema"]))
        deltas = self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in found["deltas"]])
        new = self._aggregated(deltas.repartition(self.buckets, *self.keys))
        return self._joined(base, new) if base else new

    def merge_batch(self, rows: DataFrame, batch: str) -> int:
        """Merge ``rows (keys, columns)``, any number per key, as the batch of that id; the version that has it.

        Rows with a null in a key are left out; a batch known by its id is left alone.
        """
        found = self._manifest(None)
        if batch in found["batches"]:
            return self.versions()[-1]
        delta = self._aggregated(rows.dropna(subset=self.keys))
        part = f"delta-{uuid.uuid4().hex[:12]}"
        delta.write.parquet(f"{self.folder}/{part}")
        return self._commit({"base": found["base"], "deltas": [*found["deltas"], part], "batches": [*found["batches"], batch], "schema": found["schema"] or delta.schema.json()})

    def compact(self, most: int = 0) -> int:
        """Write base and deltas as the base of a new version, if there are more than ``most`` deltas."""
        found = self._manifest(None)
        if len(found["deltas"]) <= most:
            return self.versions()[-1]
        part = f"base-{uuid.uuid4().hex[:12]}"
        self._write_base(self.read(), part)
        return self._commit({**found, "base": part, "deltas": []})

    def expire(self, keep: int) -> None:
        """Delete all versions but the last ``keep``, and the parts that only they had."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        parts = lambda vs: {p for m in map(self._manifest, vs) for p in [m["base"], *m["deltas"]] if p}
        gone = parts(old) - parts(kept)
        for version in old:
            at, system = self._system(f"{self.folder}/versions/v={version}")
            system.delete(at, True)
        for part in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(part)}")
            at, system = self._system(f"{self.folder}/{part}")
            system.delete(at, True)
