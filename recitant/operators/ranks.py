"""Ranks and running sums within groups that may hold a third of all rows.

A window over a whole group would sort it in one task. Here a group is cut into blocks by ranges of its integer order;
windows run within a block, and each block is shifted by what the blocks before it hold. Only one row a block
meets a window over the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block in units of the order.
BLOCK = 10_000


def _blocked(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds the group as a digest of 128 bits, so that no long key is shuffled, null keys apart from all others, and the block;
    a null order comes first."""
    return df.withColumn("_group", F.md5(F.to_json(F.struct(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)))))).withColumn("_block", F.coalesce(F.floor(F.col(order) / BLOCK), F.lit(-(1 << 62))))


def _shifts(blocks: DataFrame, value: str) -> DataFrame:
    before = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("_group", "_block", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_shift"))


def with_rank(df: DataFrame, keys: list[str], order: str, tie: str, name: str) -> DataFrame:
    """Adds the place of each row in its group, from 1, by ``order`` (an integer column), then ``tie``."""
    cut = _blocked(df, keys, order)
    shifts = _shifts(cut.groupBy("_group", "_block").agg(F.count("*").alias("n")), "n")
    own = cut.withColumn("_own", F.row_number().over(Window.partitionBy("_group", "_block").orderBy(order, tie)))
    return own.join(shifts, ["_group", "_block"]).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).drop("_group", "_block", "_own", "_shift")


def with_sum_before(df: DataFrame, keys: list[str], order: str, tie: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the group before each row."""
    cut = _blocked(df, keys, order)
    shifts = _shifts(cut.groupBy("_group", "_block").agg(F.sum(value).alias("n")), "n")
    before = Window.partitionBy("_group", "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_own", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return own.join(shifts, ["_group", "_block"]).withColumn(name, (F.col("_own") + F.col("_shift")).cast("long")).drop("_group", "_block", "_own", "_shift")
