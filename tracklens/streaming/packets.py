"""Change-log packets, taken in the order of their numbers, each exactly once.

The position is the number of the last packet whose results are committed. The first run only
notes where the log stands. Later runs take the packets behind the position one by one and stop at
the first that has not landed. A packet's results are one written folder, and the position advances only when it
is complete: a run that dies half-way leaves a folder nobody reads, which the next run writes anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.functions import expr
from tracklens.operators import filters, relational as rel
from tracklens.sources import dumps
from tracklens.sources.staging import mark, names_in
from tracklens.streaming.ops import run_available

#: New songs wait for their popularity with this priority.
NEW_PRIORITY = 0


def recording_outcomes(pending: DataFrame, data: DataFrame, landed: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each inserted recording of a packet: ``outcome`` (inserted, already_had, no_isrc, refused) and the columns of a track.

    A recording without an answer counts as one without a code; one without a title or a length is refused.
    The catalogue and the answers are first reduced to the packet's recordings, which are few.
    """
    gids = rel.cdc_pair(filters.insert_changes(pending, "recording"), data).select(F.col("gid").alias("mb_id")).distinct()
    had = known.select("mb_id").join(gids, "mb_id", "left_semi").distinct().withColumn("had", F.lit(True))
    answers = landed.withColumnRenamed("id", "mb_id").join(gids, "mb_id", "left_semi").dropDuplicates(["mb_id"])
    credit = F.transform("artist-credit", lambda x: F.struct(x["name"].alias("name"), x["artist"]["name"].alias("artist_name"), x["joinphrase"].alias("joinphrase")))
    first = rel.earliest_dated(F.col("releases"))
    outcome = (
        F.when(F.col("had"), "already_had")
        .when(F.coalesce(F.size("isrcs"), F.lit(0)) <= 0, "no_isrc")
        .when((F.coalesce(F.col("length"), F.lit(0)) <= 0) | (F.coalesce("title", F.lit("")) == ""), "refused")
        .otherwise("inserted")
    )
    return gids.join(had, "mb_id", "left").join(answers, "mb_id", "left").select(
        "mb_id", outcome.alias("outcome"), "title", F.col("length").alias("duration_ms"), F.nullif("disambiguation", F.lit("")).alias("version"),
        expr.credit_string(credit).alias("artist"), F.get("isrcs", F.lit(0)).alias("isrc"), first["title"].alias("album"), expr.year_of(first["date"]).alias("release_year"),
    )


TRACK = ["mb_id", "title", "duration_ms", "version", "artist", "isrc", "album", "release_year"]
_OUTCOMES = "mb_id string, outcome string, title string, duration_ms long, version string, artist string, isrc string, album string, release_year int, packet long"


@dataclass(frozen=True)
class PacketSync:
    """Packets ``folder/<number>`` applied to a catalogue; what is known of them is under ``state``.

    ``landed`` holds the service's answers and ``existing`` the catalogue's ``mb_id``. With ``start`` the first run begins behind
    that number instead of only noting the highest one. A packet's folder must come to its place complete, as by a rename.
    """

    spark: SparkSession
    folder: str
    state: str
    landed: DataFrame
    existing: DataFrame
    start: int | None = None

    def position(self) -> int | None:
        """The last committed number; none before the first run."""
        return max((int(n) for n in names_in(self.spark, f"{self.state}/position") if n.isdigit()), default=None)

    def waiting(self) -> list[int]:
        """The numbers of all packets that have landed."""
        return sorted(int(n) for n in names_in(self.spark, self.folder) if n.isdigit())

    def run(self) -> list[int]:
        """Applies what can be applied; returns the numbers of the packets it took."""
        there, at, done = set(self.waiting()), self.position(), []
        if at is None:
            at = self.start if self.start is not None else max(there, default=None)
            if at is None:
                return done
            mark(self.spark, f"{self.state}/position/{at}")
            if self.start is None:
                return done
        for number in count(at + 1):
            if number not in there:
                return done
            self.apply(number)
            mark(self.spark, f"{self.state}/position/{number}")
            done.append(number)
        return done

    def apply(self, number: int) -> None:
        """Writes the outcomes of one packet; written again, they replace what was there."""
        read = lambda table: dumps.read_packet(self.spark, f"{self.folder}/{number}", table)
        known = self.existing.select("mb_id").unionByName(self.tracks().select("mb_id"))
        rows = recording_outcomes(read("dbmirror_pending"), read("dbmirror_pendingdata"), self.landed, known)
        rows.write.mode("overwrite").parquet(f"{self.state}/outcomes/packet={number}")

    def follow(self, checkpoint: str) -> None:
        """The same as a stream over the folder: whatever lands, in whatever order, lets packets be taken that have become next."""
        landing = dumps.read_packets(self.spark, self.folder, "dbmirror_pending", stream=True)
        run_available(landing, checkpoint, lambda batch, _: self.run())

    def outcomes(self) -> DataFrame:
        """The rows of all committed packets."""
        at = self.position()
        there = [n for n in names_in(self.spark, f"{self.state}/outcomes") if at is not None and int(n.removeprefix("packet=")) <= at]
        if not there:
            return self.spark.createDataFrame([], _OUTCOMES)
        return self.spark.read.schema(_OUTCOMES).option("basePath", f"{self.state}/outcomes").parquet(*[f"{self.state}/outcomes/{n}" for n in there])

    def tracks(self) -> DataFrame:
        return self.outcomes().filter("outcome = 'inserted'").select(*TRACK)

    def queue(self) -> DataFrame:
        """The work-list rows of the new tracks."""
        return self.outcomes().filter("outcome = 'inserted'").select("mb_id", F.lit(NEW_PRIORITY).alias("priority"), "packet")

    def summary(self) -> DataFrame:
        """Rows by outcome for every committed packet that had any."""
        return self.outcomes().groupBy("packet").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "already_had", "no_isrc", "refused")])
