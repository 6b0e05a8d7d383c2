"""Helpers shared by the training-data operators.

* ``map_columns`` runs an Arrow function over named columns and keeps others beside
  its results, whatever those others are called.
* ``staged`` cuts lineage with a written table in the folder that all executors share.
"""

from __future__ import annotations

import atexit
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SHA-256 of nothing, which every digest of an empty list must equal.
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_columns(
    df: DataFrame,
    inputs: list[Column],
    keep: list[str],
    made: T.StructType,
    fn: Callable[[list[pa.Array]], list[pa.Array]],
    setup: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df`` followed by the columns ``made`` that ``fn`` computes.

    ``fn`` gets the Arrow arrays of ``inputs`` for one batch and returns one array per made
    column. With ``setup`` the function is built once per task instead. A kept column whose
    name clashes with a made one gives way to it, as with ``withColumn``.
    """
    names = {f.name.lower() for f in made}
    keep = [c for c in keep if c.lower() not in names]
    wide = df.select(
        *[quoted(c).alias(f"k{i}") for i, c in enumerate(keep)],
        *[c.alias(f"i{i}") for i, c in enumerate(inputs)],
    )
    kept_fields = [T.StructField(c, wide.schema[f"k{i}"].dataType) for i, c in enumerate(keep)]
    schema = T.StructType(kept_fields + list(made))
    n, labels = len(keep), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup() if setup else fn
        for batch in batches:
            new = work(batch.columns[n:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *new], names=labels)

    return wide.mapInArrow(run, schema)


def texts(array: pa.Array) -> list[str]:
    """Null counts as the empty text."""
    return [t or "" for t in array.to_pylist()]


def utf8(array: pa.Array) -> list[bytes]:
    """The same as UTF-8 bytes, without decoding."""
    return [t or b"" for t in array.cast(pa.binary()).to_pylist()]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_tracklens_shared", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._tracklens_shared = found
    return found.rstrip("/")


_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; what is to outlast them must be written to a path made before."""
    mine: list[str] = []
    _scratch.append(mine)
    try:
        yield
    finally:
        _scratch.remove(mine)
        for path in mine:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a staged table; a session that has ended needs no cleaning."""
    if spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: no lineage, no second run."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most so many keys can each hold more than this share of all rows.
HOT_KEYS = 1000


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``left`` with the row of ``right`` for its key; ``right`` has each key once and how often ``left`` has it.

    Keys with more than a thousandth of the ``total`` rows are joined by broadcast: there can be no
    more than ``HOT_KEYS`` of them, whatever the table. All other keys are joined by shuffle,
    where none is large any more. Rows whose key is null or not in ``right`` are left out.
    """
    least = max(1, total // HOT_KEYS)
    hot = F.broadcast(right.filter(F.col(count) > least))
    common = left.join(hot, key)
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(F.col(count) <= least), key)
    return common.unionByName(rest)


#: Elements, and characters, that are gone through one by one; beyond, whole blocks of them are.
BLOCK_ELEMENTS, BLOCK_CHARS = 256, 4096


def before_each(values: Column, first: Column, join: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """For each element of an array, what ``join`` makes of ``first`` and all elements before it: running sums or maxima.

    Appending to an array copies it, so the ends of blocks are found first and each block is then gone through by itself.
    ``values`` should be a column, not an expression, as it is looked at in many places.
    """
    cut = lambda k: F.slice(values, k * BLOCK_ELEMENTS + 1, F.lit(BLOCK_ELEMENTS))
    state = lambda at: F.struct(at.cast(kind).alias("at"), F.array().cast(f"array<{kind}>").alias("done"))
    step = lambda x, now: F.struct(now.cast(kind).alias("at"), F.array_append(x["done"], x["at"]).alias("done"))
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK_ELEMENTS).cast("int")))
    starts = F.aggregate(blocks, state(first), lambda x, k: step(x, F.aggregate(cut(k), x["at"], lambda a, v: join(a, v).cast(kind))), lambda x: x["done"])
    inside = F.transform(starts, lambda at, k: F.aggregate(cut(k), state(at), lambda x, v: step(x, join(x["at"], v)), lambda x: x["done"]))
    return F.flatten(inside)


def text_blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK_CHARS`` code points, for ``piece``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in blocks: the cost does not depend on the place, as it does with a substring of the text."""
    i, j = F.floor(start / BLOCK_CHARS).cast("int"), F.floor(end / BLOCK_CHARS).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    one = F.substring(block(i), start % BLOCK_CHARS + 1, end - start)
    several = F.concat(
        F.substring(block(i), start % BLOCK_CHARS + 1, F.lit(BLOCK_CHARS)), F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(block(j), F.lit(1), end % BLOCK_CHARS)
    )
    return F.when(i == j, one).otherwise(several)
