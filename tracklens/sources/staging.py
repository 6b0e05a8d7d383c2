"""Folders that driver and executors share, for data that queries derive and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes the rows once and reads them back, which also cuts their lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- names and marks in a shared folder, for jobs that go on from where they stopped ------------


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if it is missing."""
    fs, where = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def mark(spark: SparkSession, path: str, text: str = "") -> None:
    """Creates a small file as a whole: it is written beside its place and renamed. It is an error if it is there already."""
    fs, where = _at(spark, path)
    _, beside = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(beside, where):
        fs.delete(beside, False)
        raise FileExistsError(path)


def marked(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder, so that it comes to its place complete."""
    fs, where = _at(spark, old)
    _, to = _at(spark, new)
    fs.mkdirs(to.getParent())
    if not fs.rename(where, to):
        raise FileExistsError(new)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder and what is in it."""
    fs, where = _at(spark, path)
    fs.delete(where, True)
