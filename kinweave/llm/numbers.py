"""Whole numbers for the rows of a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bits of monotonically_increasing_id() that count the rows of a task.
WITHIN = 33


def numbered(rows: DataFrame, scratch: Scratch, name: str, column: str) -> tuple[DataFrame, int]:
    """rows, written, with their places 0, 1, 2... in column, and their count.

    Rows stand in the order of their partitions; repartitionByRange() and sortWithinPartitions() before it give a sorted
    order. Only a number for each task comes to the driver. Repeated rows have places of their own; no rows, no places.
    """
    written = scratch.save(rows.withColumn("__at", F.monotonically_increasing_id()), name)
    task = F.shiftright("__at", WITHIN)
    firsts, total = [], 0
    for t, n in sorted(map(tuple, written.groupBy(task.alias("t")).agg(F.count("*").alias("n")).collect())):
        firsts.append((t, total))
        total += n
    first = scratch.spark.createDataFrame(firsts, "__task long, __first long")
    place = F.col("__first") + F.col("__at") - F.shiftleft("__task", WITHIN)
    return written.join(F.broadcast(first), task == F.col("__task")).withColumn(column, place).drop("__at", "__task", "__first"), total
