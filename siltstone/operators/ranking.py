"""Orders that do not depend on chance, and row numbers that no single task has to give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.scratch import write_table

#: Where a unit stands: its file, its place in it, and its id.
PLACE = ("source_file", "unit_seq", "id")


def place(df: DataFrame) -> list[str]:
    """The columns of PLACE that ``df`` has."""
    return [c for c in PLACE if c in df.columns]


def numbered(rows: DataFrame, by: str, *order: str | Column, name: str = "ord") -> DataFrame:
    """``rows`` with their number from 1 within each value of ``by``, in the given order.

    Rows are dealt in ranges of that order; each range is numbered by itself, and behind the rows of the ranges before,
    whose counts are the only thing that meets in one place."""
    ranged = write_table(rows.repartitionByRange(by, *order).withColumn("__range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(by, "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), before.alias("__before"))
    own = F.row_number().over(Window.partitionBy(by, "__range").orderBy(*order))
    out = ranged.withColumn("__own", own).join(F.broadcast(offsets), (F.col(by) == F.col("__by")) & (F.col("__range") == F.col("__of")))
    return out.withColumn(name, (F.col("__own") + F.col("__before")).cast("int")).drop("__range", "__own", "__by", "__of", "__before")
