"""Keyed Parquet tables with last-write-wins upserts.

Parquet has no MERGE, and files in use must not be overwritten.  A table's rows lie in folders that are never changed; a
numbered manifest names the folders of every partition.  An upsert reads the partitions that the batch touches, writes
their merged rows to new folders and then adds a manifest, which one rename makes valid: a run that dies before leaves
the table as it was, and of two runs at the same time the later one fails.  Folders that neither the current nor the
previous manifest names are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import SourceFailure

#: Appended folders of one partition that are merged into one.
MOST_FOLDERS = 32
Manifest = dict[str, list[str]]


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key: the highest ``order`` columns win."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


class KeyedTable:
    """``partition`` is an SQL expression over the key columns whose text names a row's partition."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, keys: list[str], partition: str | None = None) -> None:
        self.spark, self.name, self.schema, self.keys = spark, name, schema, keys
        self.partition = f"coalesce(cast({partition} as string), '')" if partition else "''"
        self.path = f"{root.rstrip('/')}/{name}"

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))  # noqa: SLF001

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _manifest(self, version: int) -> Manifest:
        stream = self._fs().open(self._path("manifests", str(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
        finally:
            stream.close()

    def _current(self) -> tuple[int, Manifest]:
        versions = self.versions()
        if not versions:
            raise SourceFailure(f"there is no table {self.name}")
        return versions[-1], self._manifest(versions[-1])

    def _commit(self, version: int, manifest: Manifest) -> None:
        fs, draft = self._fs(), self._path("manifests", f"draft-{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path("manifests", str(version))
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise SourceFailure(f"another run has changed the table {self.name}")
        self._clean(version)

    def _clean(self, version: int) -> None:
        fs = self._fs()
        for old in self.versions()[:-2]:
            fs.delete(self._path("manifests", str(old)), False)
        used = {f.split("/")[0] for v in self.versions() if v <= version for folders in self._manifest(v).values() for f in folders}
        for folder in self._names("data"):
            if folder not in used:
                fs.delete(self._path("data", folder), True)

    def exists(self) -> bool:
        return bool(self.versions())

    def create(self) -> None:
        """Idempotent."""
        if not self.exists():
            self._commit(0, {})

    def partitions(self) -> list[str]:
        return sorted(self._current()[1])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, partitions: list[str] | None = None) -> DataFrame:
        """All rows, or those of some partitions, whose files alone are read."""
        manifest = self._current()[1]
        return self._read([f for p, folders in sorted(manifest.items()) if partitions is None or p in partitions for f in folders])

    def _write(self, rows: DataFrame) -> Manifest:
        """New folders with ``rows``, by partition."""
        folder = uuid.uuid4().hex
        # Spark escapes a partition's name in a path; its number needs none
        placed = rows.withColumn("_name", F.expr(self.partition))
        names = sorted(r[0] for r in placed.select("_name").distinct().collect())
        numbers = self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "_name string, _part int")
        whole = placed.join(F.broadcast(numbers), "_name").drop("_name")  # as many rows as partitions
        whole.repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/data/{folder}")
        return {n: [f"{folder}/_part={i}"] for i, n in enumerate(names)}

    def append(self, rows: DataFrame) -> None:
        version, manifest = self._current()
        new = self._write(rows.select(self._read([]).columns))
        merged = {p: manifest.get(p, []) + new.get(p, []) for p in manifest.keys() | new.keys()}
        for p, folders in merged.items():
            if len(folders) > MOST_FOLDERS:
                merged[p] = self._write(self._read(folders))[p]
        self._commit(version + 1, merged)

    def upsert(self, rows: DataFrame, *order: str) -> int:
        """Rows written; of rows with the same key in ``rows`` the one with the highest ``order`` is kept."""
        version, manifest = self._current()
        try:
            fresh = latest(rows.select(self._read([]).columns), self.keys, *(order or self.keys))
            new = self._write(fresh)
            if not new:
                return 0
            fresh = self._read([f for folders in new.values() for f in folders])
            old = self._read([f for p in new for f in manifest.get(p, [])])
            kept = old.join(fresh.select(self.keys), self.keys, "left_anti").select(fresh.columns)
            count, merged = fresh.count(), self._write(kept.unionByName(fresh))
            self._commit(version + 1, manifest | merged)
            return count
        except SourceFailure:
            raise
        except Exception as e:
            raise SourceFailure(f"the table {self.name} could not be updated") from e


def verify(tables: list[KeyedTable]) -> DataFrame:
    """name, present of every expected table."""
    return tables[0].spark.createDataFrame([(t.name, t.exists()) for t in tables], "name string, present boolean")
