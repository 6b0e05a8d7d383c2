"""Readers and writers: headerless dumps, feature files, landed lookups, change logs, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.schemas import DUMP_COLUMNS, DUMP_LAST, DUMP_NUMBERS


def leading_int(c: Column) -> Column:
    """The whole number that a text begins with; none is null."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")


def _named(lines: DataFrame, table: str) -> DataFrame:
    """Lines split at tabs; ``\\N`` and empty are null, numbers by their leading digits, short lines go."""
    names, last = DUMP_COLUMNS[table].split(), DUMP_LAST[table]
    fields = lines.select(F.split("value", "\t", -1).alias("f")).filter(F.size("f") > names.index(last))
    text = [F.nullif(F.nullif(F.get("f", F.lit(i)), F.lit("\\N")), F.lit("")) for i in range(len(names))]
    number = lambda n: n in DUMP_NUMBERS and not (table == "isrc" and n == "isrc")
    return fields.select(*[(leading_int(c) if number(n) else c).alias(n) for n, c in zip(names, text, strict=True) if n != "_"])


def read_dump(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return _named(spark.read.text(f"{folder}/{table}"), table)


def read_features_csv(spark: SparkSession, path: str, cols: dict[str, str], key: str = "mbid") -> DataFrame:
    """Columns found by header name (file name to result name); text that is no number is absent.

    ``row`` is the order of rows within the file, for rules where the first row counts.
    """
    raw = spark.read.option("header", True).option("quote", "").csv(path)
    clean = lambda c: F.trim(F.regexp_replace(F.col(f"`{c}`"), '"', ""))
    have = {c.strip().strip('"'): c for c in raw.columns}
    picked = []
    for c, name in cols.items():
        value = clean(have[c])
        number = F.regexp_extract(value, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")
        picked.append((F.nullif(value, F.lit("")) if c.startswith("key") else number).alias(name))
    return raw.select(clean(have[key]).alias("mb_id"), *picked, F.monotonically_increasing_id().alias("row"))


def stage(df: DataFrame, path: str) -> DataFrame:
    """The staged table if a finished one is there, else ``df`` written to it: a re-run goes on from here."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_review(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_review(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def lookup_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Answers of a service that have landed as JSON lines or Parquet."""
    return spark.read.schema(schema).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(schema).parquet(path)


def read_packets(spark: SparkSession, folder: str, table: str, stream: bool = False) -> DataFrame:
    """One file kind of a change log; packets are folders ``folder/<sequence>/<table>``."""
    reader = spark.readStream if stream else spark.read
    return _named(reader.text(f"{folder}/*/{table}"), table)


def read_packet(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One file kind of the packet in ``folder``."""
    return _named(spark.read.text(f"{folder}/{table}"), table)


def packet_numbers(df: DataFrame, file_col: str = "file") -> DataFrame:
    """The highest packet number in the names of packets, which are the last part of their paths: ``3``, ``packet-3.tar.bz2``."""
    name = F.element_at(F.split(F.rtrim(F.col(file_col), F.lit("/")), "/"), -1)
    return df.agg(F.max(F.regexp_extract(name, r"(\d+)(?:\.tar(?:\.\w+)?)?$", 1).try_cast("long")).alias("max_sequence"))


def result_envelope(page: DataFrame, total: DataFrame, number: int, per_page: int) -> DataFrame:
    """One JSON object of a page of rows (at most 200) and its totals."""
    cols = [c for c in page.columns if c not in ("position", "has_more")]
    rows = page.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct(*cols).alias("r")))), lambda x: x["r"]).alias("results"),
        F.coalesce(F.bool_or("has_more"), F.lit(False)).alias("hasMore"),
    )
    both = rows.withColumns({c: total.select(c).scalar() for c in ("total", "capped")})
    return both.select(F.to_json(F.struct("results", "total", "capped", F.lit(number).alias("page"), F.lit(per_page).alias("perPage"), "hasMore")).alias("body"))
