"""Readers of timetable feeds: comma-separated tables, several feeds side by side, and live updates as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each table that the library reads; all are read as text and cast later.
COLUMNS = {
    "stops": ("stop_id", "stop_name", "stop_lat", "stop_lon", "location_type"),
    "routes": ("route_id", "agency_id", "route_short_name", "route_long_name", "route_type"),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "pickup_type", "drop_off_type"),
    "calendar": ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"),
    "calendar_dates": ("service_id", "date", "exception_type"),
    "frequencies": ("trip_id", "start_time", "end_time", "headway_secs"),
}
#: Schema of one live update, trip-level or by stop.
UPDATE = "routeId string, tripId string, delay int, stops array<struct<arrival:int, departure:int>>"
DEPARTURES = "map<string, array<struct<trip:string, route:string, status:string, delay:int>>>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a feed, all text, with the library's columns in order.

    Columns are found by the header (a byte-order mark or blanks round a name are ignored),
    extra ones are left out, missing ones and missing cells are ''. A missing file gives no
    rows; `stop_times` must exist.
    """
    wanted, path = COLUMNS[name], f"{folder}/{name}.txt"
    if name != "stop_times" and not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted))
    raw = spark.read.csv(path, header=True, quote='"', escape='"', inferSchema=False)
    at = {c.lstrip("﻿").strip(): c for c in raw.columns}
    cell = lambda c: F.coalesce(F.col(f"`{at[c]}`"), F.lit("")) if c in at else F.lit("")
    return raw.select(*[cell(c).alias(c) for c in wanted])


def feeds(spark: SparkSession, folders: list[str], name: str) -> DataFrame:
    """One table of several feeds; ``feed`` (the folder's place) is part of every key."""
    out = None
    for i, folder in enumerate(folders):
        one = table(spark, folder, name).select(F.lit(i).alias("feed"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def update_delay(update: Column) -> Column:
    """A parsed update's delay: the trip's, else the first one that a stop has (arrival before departure)."""
    known = F.filter(F.transform(update["stops"], lambda s: F.coalesce(s["arrival"], s["departure"])), lambda d: d.isNotNull())
    return F.coalesce(update["delay"], F.try_element_at(known, F.lit(1)))


def newest(resources: DataFrame, by: str) -> DataFrame:
    """The newest resource of each ``by``: last modified, else created; the larger id of equals."""
    stamp = F.struct(F.coalesce("last_modified", "created"), "resource_id")
    return resources.groupBy(by).agg(F.max_by("resource_id", stamp).alias("resource_id"))


def kept_agencies(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows (feed, agency, ...) of the agencies that their feed's configuration (feed, keepAgency) keeps; a feed without a list keeps all."""
    kept = feeds.where("keepAgency is not null").select("feed", F.explode("keepAgency").alias("agency")).distinct()
    every = feeds.where("keepAgency is null").select("feed").distinct()
    return rows.join(kept, ["feed", "agency"], "left_semi").unionByName(rows.join(every, "feed", "left_semi"))


def resolved(resources: DataFrame) -> DataFrame:
    """(feed, resource_id): where each feed is to be had, by its kind.

    `ckan-latest`: the newest ZIP (last modified, else created); `max-id`: the file of the
    greatest number; else the address as it is written.
    """
    zips = resources.where((F.col("kind") == "ckan-latest") & F.lower("format").contains("zip"))
    newest_zip = newest(zips, "feed")
    greatest = resources.where(F.col("kind") == "max-id").groupBy("feed").agg(F.max("resource_id").alias("resource_id"))
    written = resources.where(~F.col("kind").isin("ckan-latest", "max-id")).groupBy("feed").agg(F.min("resource_id").alias("resource_id"))
    return newest_zip.unionByName(greatest).unionByName(written)


#: A live update as a line of JSON; a line that is none stands in the last column.
LIVE = f"{UPDATE}, id string, event_id long, ts timestamp, broken string"


def live_updates(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the updates under ``folder``, a folder ``address=...`` an address, a file a poll or part of one.

    A line that is no update has its text in ``broken`` and nothing else; a file that can't be read is left out.
    Neither stops the address's other files or the other addresses; an address without files gives no rows.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreCorruptFiles": "true", "ignoreMissingFiles": "true", "pathGlobFilter": "*.json*", "basePath": folder}
    return spark.readStream.schema(f"{LIVE}, address string").options(**options).json(folder)


def observations(updates: DataFrame) -> DataFrame:
    """(event_id, route_name, trip_ref, ts, delay_sec) of updates that name a line, a time and a delay; a run is known by its address and trip, else by the update's id."""
    delay = update_delay(F.struct("delay", "stops"))
    rows = updates.select("event_id", F.col("routeId").alias("route_name"), F.concat_ws("|", "address", F.coalesce("tripId", "id")).alias("trip_ref"), "ts", delay.alias("delay_sec"), "broken")
    return rows.where("broken is null and route_name is not null and ts is not null and delay_sec is not null").drop("broken")


def faults(updates: DataFrame) -> DataFrame:
    """(address, lines, broken): how many lines each address sent and how many were none."""
    return updates.groupBy("address").agg(F.count("*").alias("lines"), F.count("broken").alias("broken"))
