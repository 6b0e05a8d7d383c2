"""Staging of many input files in parts: a job that died goes on with the parts that are missing.

Each file belongs to one of ``parts`` by the digest of its path. The name of a finished part tells what it was made from:
its number, how many parts there are, and a fingerprint of its files' paths, sizes and times. So a part is made
again exactly if one of its files was changed, added or taken away, or the version of the job or another input is a different one.

Defined results: parts without files are none; no file at all is an error; a part whose rows are all filtered out is an empty part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.sources.staging import moved, names_in

PARTS = 16


def files_in(spark: SparkSession, source: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of all files below a folder; their content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    return found.select("path", "length", "modificationTime")


def _print(version: str = "") -> Column:
    """One fingerprint of a set of files; merged before it moves and the same in any order."""
    each = F.xxhash64("path", "length", "modificationTime")
    return F.substring(F.sha2(F.concat_ws(":", F.bit_xor(each), F.count("*"), F.sum("length"), F.lit(version)), 256), 1, 16)


def stage_parts(
    spark: SparkSession, source: str, path: str, build: Callable[[list[str]], DataFrame], parts: int = PARTS, version: str = "", others: tuple[str, ...] = ()
) -> DataFrame:
    """The rows that ``build`` makes of the files of every part, staged in ``path``; what is there and still right is not made again.

    ``others`` are folders that every part is joined with: when they change, all parts are made again.
    """
    for o in others:
        version += ":" + files_in(spark, o).agg(_print().alias("p")).first()["p"]
    files = files_in(spark, source).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int"))
    wanted = {r["part"]: f"part-{r['part']}-of-{parts}-{r['print']}" for r in files.groupBy("part").agg(_print(version).alias("print")).collect()}  # one row for each part
    if not wanted:
        raise FileNotFoundError(source)
    there = set(names_in(spark, path))
    for part, name in sorted(wanted.items()):
        if name in there:
            continue
        own = sorted(r["path"] for r in files.filter(F.col("part") == part).select("path").collect())  # names of one part's files
        work = f"{path}/.work-{uuid.uuid4().hex}"
        build(own).write.parquet(work)
        moved(spark, work, f"{path}/{name}")
    return spark.read.parquet(*[f"{path}/{n}" for n in sorted(wanted.values())])
