"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in `spark.checkpoint.dir`.

    Only a single machine (master local) may leave it unset, as tests do: a
    folder of this application is used then.  Elsewhere executors would write to
    disks of their own, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_owned: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}
_owner: list[str] = []


@contextmanager
def scratch_owner(owner: str) -> Iterator[None]:
    """Scratch made inside can be given back by `release(spark, owner)`."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def release(spark: SparkSession, owner: str) -> None:
    """Delete the scratch of `owner`: files, and tables with their catalog entries.  Results that were not written yet must not depend on it."""
    for name in _tables.pop(owner, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _owned.pop(owner, []):
        delete_path(spark, path)


@atexit.register
def _drop_tables() -> None:
    """What no owner gave back leaves the catalog when the application ends; its files are deleted with the application's others."""
    spark = SparkSession.getActiveSession()
    if spark is not None and not spark.sparkContext._jsc.sc().isStopped():
        for name in [n for names in _tables.values() for n in names]:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends at the latest."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if _owner:
        _owned.setdefault(_owner[-1], []).append(path)
    return path


def bucketed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """`df` dealt once by `columns` into a bucketed table of the shared folder: later joins on them don't move its rows."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    n = shuffle_partitions(spark)
    df.repartition(n, *columns).write.option("path", scratch_path(spark, name)).bucketBy(n, *columns).saveAsTable(table)
    _tables.setdefault(_owner[-1] if _owner else "", []).append(table)
    return spark.table(table)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it back.

    Survives lost executors, unlike localCheckpoint, and is compressed, unlike
    checkpoint().  `discard` deletes the files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing lazy depends on any more."""
    for df in frames:
        delete_path(df.sparkSession, df.scratch)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once per row (bound as a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def replaced(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """`df` with `outputs` appended; columns of the same name (any case) are replaced."""
    names = {n.lower() for n in outputs}
    kept = [df[f"`{c}`"] for c in df.columns if c.lower() not in names]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
