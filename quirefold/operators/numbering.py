"""Numbering rows of a group in order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values that share a block; a block's rows are numbered by one task.
BLOCK = 4096


def running_before(rows: DataFrame, group: list[str], position: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the sum of ``value`` over the group's rows of smaller ``position``.

    ``position`` must be unique in its group. Sums are first taken by blocks of
    positions, so no task sees all rows of a large group: one sorts its blocks, the
    others a block's rows each.
    """
    at = F.col(position) - F.pmod(F.col(position), F.lit(block))
    sums = rows.groupBy(*group, at.alias("_block")).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_block", at)
        .join(sums, [*group, "_block"])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_before")
    )


def chunk_id(doc_id: Column, index: Column) -> Column:
    """doc_id::cNNNN, at least four digits."""
    return F.format_string("%s::c%04d", doc_id, index)
