"""Dense numbers in an order, without all rows in one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import staged

#: Bits of a row's place within its partition.
PLACE = 33


def numbered(df: DataFrame, by: list[Column | str], out: str, first: int = 0) -> DataFrame:
    """``df`` with ``out``: the place of each row in the order of ``by``, from ``first`` on; equal rows are numbered in any order.

    Rows are dealt to ranges of the order and sorted there. A row's number is its place in
    its range, and the sizes of the ranges before it: a row a range goes to the driver.
    """
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(placed, "numbered")
    part, place = F.shiftright("__at", PLACE), F.col("__at").bitwiseAND((1 << PLACE) - 1)
    sizes = sorted((r.part, r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before = accumulate((n for _, n in sizes), initial=first)
    starts = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "__part long, __start long")
    return placed.withColumn("__part", part).join(starts, "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + place).alias(out))
