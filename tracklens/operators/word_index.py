"""The word index as a stored table that follows the catalogue.

Postings are laid out by ranges of terms, sorted, so that a term or a prefix is a range of few files and row groups.
Changes come as versions beside them: the new postings of changed rows, and marks that outdate
all older postings of these rows. Reading merges both. ``compact`` writes the ranges anew that changes touch,
and only these; all other files stay as they are.

What belongs to the index at a time is told by a small manifest, written as a whole when everything it names
is there. A reader sees one manifest from beginning to end, and a change that dies half-way is not seen.
"""

from __future__ import annotations

import bisect
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.operators.text import build_postings, doc_stats
from tracklens.sources.staging import mark, marked, names_in

#: Ranges of terms, and parts of a range, so that a term that a third of all rows hold is written by several tasks.
TERM_RANGES, RANGE_PARTS = 32, 4
#: The split points are those of at most so many postings; they only decide how even the ranges are.
SAMPLED = 20_000
POSTINGS, LENGTHS = "doc_id long, col string, pos int, term string", "doc_id long, length long"
_LAST = "\U0010ffff"


def _within(term: Column, terms: list[str] | None, prefixes: list[str]) -> Column:
    """The terms, and all that begin with a prefix: comparisons that the files' statistics answer."""
    found = term.isin(sorted(set(terms or []))) if terms else F.lit(False)
    for p in prefixes:
        found = found | ((term >= p) & (term <= p + _LAST))
    return found


@dataclass(frozen=True)
class StoredIndex:
    """Postings and the number of words of each row, under ``path``."""

    spark: SparkSession
    path: str
    cols: tuple[str, ...]
    stem: bool = True

    # ---- what there is ----

    def manifest(self) -> dict:
        return json.loads(marked(self.spark, f"{self.path}/manifest/{self._last():08d}"))

    def _last(self) -> int:
        return max(int(n) for n in names_in(self.spark, f"{self.path}/manifest") if n.isdigit())

    def _commit(self, found: dict, number: int) -> None:
        mark(self.spark, f"{self.path}/manifest/{number:08d}", json.dumps(found))

    def _table(self, schema: str, base: str, folders: list[str], extra: str = "") -> DataFrame:
        """The folders as one table; ``extra`` are the columns that are folders' names."""
        there = [f for f in folders if f.rpartition("/")[2] in names_in(self.spark, f"{self.path}/{f.rpartition('/')[0]}")]
        if not there:
            return self.spark.createDataFrame([], schema + extra)
        found = self.spark.read.schema(schema + extra).option("basePath", f"{self.path}/{base}").parquet(*[f"{self.path}/{f}" for f in there])
        return found.select(*[c.split()[0] for c in (schema + extra).split(", ")])

    def _range_of(self, splits: list[str]) -> Column:
        """The number of the range of a term."""
        return sum([F.when(F.col("term") >= s, 1).otherwise(0) for s in splits], F.lit(0)).cast("int")

    def _ranges(self, splits: list[str], terms: list[str] | None, prefixes: list[str]) -> list[int]:
        """The ranges that hold any of the terms or prefixes."""
        key = [s.encode() for s in splits]  # terms are ordered by their bytes
        at = lambda t: bisect.bisect_right(key, t.encode())
        found = {at(t) for t in terms or []}
        for p in prefixes:
            found |= set(range(at(p), at(p + _LAST) + 1))
        return sorted(found)

    # ---- reading ----

    def _postings(self, m: dict, ranges: list[int]) -> DataFrame:
        base = self._table(POSTINGS, "postings", [f"postings/generation={m['ranges'][str(r)]}/range={r}" for r in ranges if str(r) in m["ranges"]])
        if not m["versions"]:
            return base
        deltas = self._table(POSTINGS, "deltas", [f"deltas/version={v}/range={r}" for v in m["versions"] for r in ranges], ", version int")
        rows = base.withColumn("version", F.lit(0)).unionByName(deltas)
        return self._alive(rows, m)

    def _alive(self, rows: DataFrame, m: dict) -> DataFrame:
        """Rows ``(doc_id, version)`` that no later version has outdated."""
        marks = self._table("doc_id long", "marks", [f"marks/version={v}" for v in m["versions"]], ", version int")
        newest = marks.groupBy("doc_id").agg(F.max("version").alias("outdated"))
        return rows.join(newest, "doc_id", "left").filter(F.col("version") >= F.coalesce("outdated", F.lit(0))).drop("version", "outdated")

    def postings(self, terms: list[str] | None = None, prefixes: list[str] | tuple[str, ...] = ()) -> DataFrame:
        """All postings, or those of some terms and of all terms with some prefixes: then only their ranges are read."""
        m = self.manifest()
        if terms is None and not prefixes:
            return self._postings(m, list(range(len(m["splits"]) + 1)))
        ranges = self._ranges(m["splits"], terms, list(prefixes))
        return self._postings(m, ranges).filter(_within(F.col("term"), terms, list(prefixes)))

    def lengths(self) -> DataFrame:
        """``(doc_id, length)``."""
        m = self.manifest()
        base = self._table(LENGTHS, "lengths", [f"lengths/generation={m['lengths']}"])
        if not m["versions"]:
            return base
        deltas = self._table(LENGTHS, "delta-lengths", [f"delta-lengths/version={v}" for v in m["versions"]], ", version int")
        return self._alive(base.withColumn("version", F.lit(0)).unionByName(deltas), m)

    # ---- writing ----

    def _write(self, postings: DataFrame, splits: list[str], path: str) -> None:
        dealt = postings.select("doc_id", "col", F.col("pos").cast("int").alias("pos"), "term").withColumn("range", self._range_of(splits))
        dealt = dealt.repartition("range", F.pmod(F.hash("doc_id"), F.lit(RANGE_PARTS))).sortWithinPartitions("range", "term")
        dealt.write.mode("overwrite").partitionBy("range").parquet(f"{self.path}/{path}")

    def create(self, df: DataFrame, id_col: str) -> StoredIndex:
        """Cuts the texts into words once and keeps them with their places."""
        postings = build_postings(df, id_col, list(self.cols), self.stem)
        n = postings.count()
        sampled = postings.select("term").sample(min(1.0, SAMPLED / max(n, 1)), seed=42).orderBy("term").limit(2 * SAMPLED)
        terms = sorted({r[0] for r in sampled.collect()}, key=str.encode)  # some 20,000 words, whatever the table
        splits = sorted({terms[len(terms) * k // TERM_RANGES] for k in range(1, TERM_RANGES)}, key=str.encode) if terms else []
        self._write(postings, splits, "postings/generation=0")
        doc_stats(self._table(POSTINGS, "postings", [f"postings/generation=0/range={r}" for r in range(len(splits) + 1)])).write.mode("overwrite").parquet(f"{self.path}/lengths/generation=0")
        self._commit({"splits": splits, "ranges": {str(r): 0 for r in range(len(splits) + 1)}, "lengths": 0, "versions": [], "last": 0}, 0)
        return self

    def update(self, changed: DataFrame, deleted: DataFrame | None = None, id_col: str = "id") -> None:
        """Takes new and changed rows, and ids of rows that are gone, as the next version."""
        m, at = self.manifest(), self._last()
        v = m["last"] + 1
        ids = changed.select(F.col(id_col).cast("long").alias("doc_id"))
        if deleted is not None:
            ids = ids.unionByName(deleted.select(F.col(id_col).cast("long").alias("doc_id")))
        ids.distinct().write.mode("overwrite").parquet(f"{self.path}/marks/version={v}")
        self._write(build_postings(changed, id_col, list(self.cols), self.stem), m["splits"], f"deltas/version={v}")
        ranges = range(len(m["splits"]) + 1)
        doc_stats(self._table(POSTINGS, "deltas", [f"deltas/version={v}/range={r}" for r in ranges])).write.mode("overwrite").parquet(f"{self.path}/delta-lengths/version={v}")
        self._commit(m | {"versions": [*m["versions"], v], "last": v}, at + 1)

    def compact(self) -> list[int]:
        """Merges all versions into the ranges that they touch and returns those; files of other ranges are not touched."""
        m, at = self.manifest(), self._last()
        if not m["versions"]:
            return []
        every = [int(r) for r in m["ranges"]]
        marks = self._table("doc_id long", "marks", [f"marks/version={v}" for v in m["versions"]])
        base = self._table(POSTINGS, "postings", [f"postings/generation={g}/range={r}" for r, g in m["ranges"].items()], ", range int")
        touched = {r["range"] for r in base.select("doc_id", "range").join(marks.distinct(), "doc_id", "left_semi").select("range").distinct().collect()}  # numbers of ranges
        touched |= {r for v in m["versions"] for r in every if f"range={r}" in names_in(self.spark, f"{self.path}/deltas/version={v}")}
        g = at + 1
        self._write(self._postings(m, sorted(touched)), m["splits"], f"postings/generation={g}")
        self.lengths().write.mode("overwrite").parquet(f"{self.path}/lengths/generation={g}")
        self._commit(m | {"ranges": m["ranges"] | {str(r): g for r in touched}, "lengths": g, "versions": []}, at + 1)
        return sorted(touched)


def store_index(df: DataFrame, id_col: str, cols: list[str], path: str, stem: bool = True) -> StoredIndex:
    return StoredIndex(df.sparkSession, path, tuple(cols), stem).create(df, id_col)


def changed_text(old: DataFrame, new: DataFrame, cols: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows that are new or whose text has changed, and the keys of rows that are gone; changes of other columns are none."""
    before = old.select(F.col(key), F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in cols]).alias("_before"), F.lit(True).alias("_there"))
    after = new.withColumn("_after", F.xxhash64(*[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    changed = after.join(before, key, "left").filter(F.col("_there").isNull() | (F.col("_before") != F.col("_after"))).select(*new.columns)
    return changed, old.select(key).join(new.select(key), key, "left_anti")
