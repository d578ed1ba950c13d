"""Live delay counts: a stream of observations into additive counts by route, day type and hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as X
from .kept import Kept

KEYS = ("route_name", "day_type", "hour")
COUNTS = ("n", "total", *[f"b{i}" for i in range(6)])


def counts(obs: DataFrame) -> DataFrame:
    """Additive counts of observations (route_name, ts, delay_sec)."""
    bucket = X.delay_bucket(F.col("delay_sec"))
    keys = [F.col("route_name"), X.day_class(F.col("ts")).alias("day_type"), F.hour("ts").alias("hour")]
    return obs.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("delay_sec").alias("total"), *[F.count_if(bucket == i).alias(f"b{i}") for i in range(6)])


#: Minutes between polls, and the time zone whose clock names a poll's slot.
POLL_MIN, ZONE = 15, "Europe/Warsaw"


#: How late an observation may come, and after how many batches the kept state is drawn together.
LATE_S, EVERY = 86_400, 8


def slotted(last: DataFrame) -> DataFrame:
    """Observations (poll, route_name, delay_sec) with the local time of their poll as ``ts``."""
    utc = F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, unix_seconds(poll))")
    return last.select("route_name", F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc).alias("ts"), "delay_sec")


def runs_by_poll(obs: DataFrame) -> DataFrame:
    """(poll, route_name, trip_ref, event_id, delay_sec): a run's last observation (by ``event_id``) in each poll.

    A poll is the quarter of an hour in which an observation (route_name, trip_ref, ts, event_id, delay_sec) came in.
    Of a stream this is keyed state: it spans micro-batches and restarts, and lives until the watermark passes the poll.
    """
    last = obs.groupBy(F.window("ts", f"{POLL_MIN} minutes").alias("w"), "route_name", "trip_ref").agg(F.max(F.struct("event_id", "delay_sec")).alias("last"))
    return last.select(F.col("w.start").alias("poll"), "route_name", "trip_ref", "last.event_id", "last.delay_sec")


def polled(obs: DataFrame) -> DataFrame:
    """One observation a run and poll; its time is that of the poll, on the local clock."""
    return slotted(runs_by_poll(obs))


def live(spark: SparkSession, source: str) -> DataFrame:
    """Observations as a stream from the file of events ``source``, whose times are of UTC."""
    schema = spark.read.parquet(source).schema
    # a stream's source is a folder or pattern: the pattern below names just this file
    rows = spark.readStream.schema(schema).parquet(source[:-1] + "[" + source[-1] + "]")
    return rows.select("event_id", F.col("event_type").alias("route_name"), F.col("user_id").alias("trip_ref"), "ts", (F.floor(F.col("value") * 6).cast("int") - 120).alias("delay_sec"))


def at_utc(ts: Column) -> Column:
    """A time without a zone as that moment of UTC, whatever the session's zone."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def histogram_of_stream(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Counts of all observations under ``source`` so far, each by its own time.

    Each micro-batch is counted and kept under its number, so that nothing counts twice if it is run again.
    """
    kept = Kept(spark, folder, summed)
    run = live(spark, source).writeStream.foreachBatch(lambda batch, number: kept.commit(counts(batch), number)).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return kept.rows()


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def latest(rows: DataFrame) -> DataFrame:
    """Of each run and poll the last observation."""
    last = rows.groupBy("poll", "route_name", "trip_ref").agg(F.max(F.struct("event_id", "delay_sec")).alias("last"))
    return last.select("poll", "route_name", "trip_ref", "last.*")


class Polls:
    """Counts by polls, kept in ``folder``: runs of polls that may still change, and the additive counts of closed ones."""

    def __init__(self, spark: SparkSession, folder: str, late_s: int = LATE_S, every: int = EVERY):
        self.late_s, self.folder = late_s, folder
        self.kept = Kept(spark, folder, latest, every, self._close)

    def run(self, obs: DataFrame) -> None:
        """Takes what the stream of observations has, up to now; goes on where the last call or a failure stopped."""
        state = runs_by_poll(obs.withWatermark("ts", f"{self.late_s} seconds"))
        # in update mode a batch brings every run and poll that changed, with its last observation so far
        stream = state.writeStream.outputMode("update").foreachBatch(self.kept.commit)
        stream.option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def histogram(self) -> DataFrame:
        now, closed = counts(slotted(self.kept.rows())), self.kept.closed()
        return now if closed is None else summed(now.unionByName(closed))

    def _close(self, rows: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Rows of open polls, and the counts of the closed: of those ended before the watermark, to which no row comes any more."""
        end = rows.agg((F.unix_timestamp(F.max("poll")) - self.late_s - 60 * POLL_MIN).alias("end"))
        marked = rows.join(F.broadcast(end)).withColumn("shut", F.unix_timestamp("poll") + 60 * POLL_MIN <= F.col("end"))  # one row
        shut = counts(slotted(marked.where("shut")))
        return marked.where("not shut").select(rows.columns), shut if before is None else summed(shut.unionByName(before))
