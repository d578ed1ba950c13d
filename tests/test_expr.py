"""Hand-computed values of the column functions."""

from pyspark.sql import functions as F

from wayspan.functions import expr as X


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_times(spark):
    assert values(spark, [("28:16:30",), ("05:07",), ("",), (None,)], "t string", X.time_to_sec(F.col("t"))) == [101790, 18420, None, None]
    assert values(spark, [(90000,), (59,)], "s long", X.clock(F.col("s"))) == ["01:00", "00:00"]


def test_ladders(spark):
    delays = [(d,) for d in (-61, -60, 59, 60, 179, 180, 599, 600)]
    assert values(spark, delays, "d long", X.delay_bucket(F.col("d"))) == [0, 1, 1, 2, 2, 3, 4, 5]
    assert values(spark, [(600,), (601,), (5401,)], "s long", X.band_minutes(F.col("s"))) == [10, 20, None]


def test_names_and_rounding(spark):
    assert values(spark, [(" Wrzeszcz PKP 03",)], "n string", X.stop_name(F.col("n"))) == ["Wrzeszcz PKP"]
    assert values(spark, [(-2.5,), (2.5,)], "x double", X.js_round(F.col("x"))) == [-2, 3]
