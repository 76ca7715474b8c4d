"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_path, shared_dir

__all__ = ["dispose", "materialise", "new_path", "reserve", "scope", "shared_dir", "shelter", "small_batches", "sweep"]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


_SCOPES: list[str] = []
_MADE: dict[str, list[DataFrame]] = {}


@contextlib.contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables materialised inside belong to ``name`` and can be swept together."""
    _SCOPES.append(name)
    try:
        yield
    finally:
        _SCOPES.pop()


def sweep(name: str) -> None:
    """Delete the tables of a scope; its results must have been written by now."""
    dispose(*_MADE.pop(name, []))


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files that survive a lost executor, gives the planner real sizes, and lets Spark delete
    the shuffle files of the finished step at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quantspark_path = path  # noqa: SLF001
    if _SCOPES:
        _MADE.setdefault(_SCOPES[-1], []).append(out)
    return out


def shelter(df: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with names that operators use inside out of the way, and the names that lead back; ``added`` go for good."""
    df = reserve(df, *added)
    names = {c: f"own{i}_{c}" for i, c in enumerate(df.columns) if c.lower().startswith("qs_")}
    return df.withColumnsRenamed(names), {v: k for k, v in names.items()}


def reserve(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without its own columns of these names (in any case of letters), which a result is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def dispose(*tables: DataFrame) -> None:
    """Delete materialised tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_quantspark_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def small_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Bound the bytes of an Arrow batch, so that Python workers hold a few megabytes of long texts, not 10,000 of them."""
    spark.conf.set(_BATCH_BYTES, str(megabytes << 20))
