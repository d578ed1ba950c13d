"""Street and configuration documents (JSON) as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .gtfs import exists

POINT = "struct<lat:double, lon:double>"
ELEMENTS = f"elements array<struct<type:string, id:bigint, nodes:array<bigint>, tags:map<string,string>, geometry:array<{POINT}>, members:array<struct<role:string, geometry:array<{POINT}>>>>>"
CITIES = "map<string, struct<name:string, feeds:array<struct<url:string, keepAgency:array<string>>>, bbox:array<double>>>"
#: Streets that nobody walks along.
NOT_WALKED = ("motorway", "motorway_link", "trunk", "trunk_link", "construction", "proposed", "raceway", "bus_guideway", "escape", "corridor")
#: Ways that are no bridge for walkers, water that is drawn as a line.
NO_BRIDGE, WATERWAYS = ("motorway", "motorway_link", "trunk", "trunk_link"), ("river", "canal")
NO_ACCESS, NO_SERVICE = ("private", "no"), ("driveway", "parking_aisle")


def elements(docs: DataFrame, column: str) -> DataFrame:
    """One row an element of each document."""
    return docs.select(F.explode(F.from_json(column, ELEMENTS)["elements"]).alias("x")).select("x.*")


def walkable(tags: Column) -> Column:
    """A street with no tag that bars walking; a missing tag bars nothing, a missing street type does."""
    bars = lambda key, values: F.coalesce(tags[key].isin(*values), F.lit(False))
    return tags["highway"].isNotNull() & ~bars("highway", NOT_WALKED) & ~bars("foot", ("no",)) & ~bars("access", NO_ACCESS) & ~bars("service", NO_SERVICE)


def city_feeds(docs: DataFrame, column: str) -> DataFrame:
    """(city, feed, url): one row a feed of each city of the configuration."""
    city = docs.select(F.explode(F.from_json(column, CITIES)).alias("city", "c"))
    return city.select("city", F.posexplode("c.feeds").alias("feed", "f")).select("city", "feed", "f.url")


def bridges(rows: DataFrame) -> DataFrame:
    """Elements that walkers may cross water by: ways with a geometry and no street type that bars them."""
    barred = F.coalesce(F.col("tags")["highway"].isin(*NO_BRIDGE), F.lit(False))
    return rows.where((F.col("type") == "way") & (F.size("geometry") >= 1) & ~barred)


def waterways(rows: DataFrame) -> DataFrame:
    """Elements of rivers and canals with a geometry."""
    return rows.where((F.col("type") == "way") & F.col("geometry").isNotNull() & F.col("tags")["waterway"].isin(*WATERWAYS))


def document(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document as one row; none where there is no such file."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).json(path, multiLine=True)


def lines_of(doc: DataFrame, key: str) -> DataFrame:
    """(ring_id, idx, lat, lon): the lines under ``key`` of a document in whole 1e-5 degrees; a missing key has none."""
    line = doc.select(F.posexplode(F.coalesce(key, F.expr("array()"))).alias("ring_id", "line"))
    point = line.select("ring_id", F.posexplode("line").alias("idx", "p"))
    return point.select("ring_id", "idx", (F.col("p")[0] / 1e5).alias("lat"), (F.col("p")[1] / 1e5).alias("lon"))


#: Schemas of the documents of a city.
WATER = "polys array<array<array<bigint>>>, lines array<array<array<bigint>>>"
META = "city string, feedEndDate string, dates map<string,string>, sources array<string>"


def bridge_lines(docs: DataFrame, column: str) -> DataFrame:
    """The documents with ``lines``, their bridges as arrays of points in degrees; null where a document is missing, broken or has none such key."""
    lines = F.from_json(column, "lines array<array<array<bigint>>>")["lines"]
    point = lambda p: F.struct((F.get(p, F.lit(0)) / 1e5).alias("lat"), (F.get(p, F.lit(1)) / 1e5).alias("lon"))
    return docs.select(*[c for c in docs.columns if c != column], F.transform(lines, lambda line: F.transform(line, point)).alias("lines"))
