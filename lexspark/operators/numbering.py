"""Positions 1, 2, 3... of all rows in a total order, without a task that sees all rows.

The rows are range-sorted into a table, where a row's place in its partition is
known locally; the sizes of the partitions before it (a prefix sum over a row
per partition) make that its position.  Two levels, no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

PLACE = "_place"
_LOCAL = (1 << 33) - 1  # bits of ``monotonically_increasing_id`` that count within a partition


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` range-sorted, with the column PLACE (partition and place in it).  To be written before it is
    read twice.  Rows that the order ties are spread over partitions too."""
    tie = "_tie"
    keys = [*order, F.col(tie)]
    ordered = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return ordered.drop(tie).withColumn(PLACE, F.monotonically_increasing_id())


def starts(written: DataFrame) -> DataFrame:
    """``_part, _before``: rows in the partitions before each one; a row per partition."""
    sizes = written.groupBy(F.shiftright(PLACE, 33).alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))


def numbered(written: DataFrame, name: str, offsets: DataFrame | None = None, first: int = 0) -> DataFrame:
    """A written table of ``placed`` rows with its dense numbers as column ``name`` instead of PLACE."""
    offsets = F.broadcast(starts(written) if offsets is None else offsets)  # as many rows as partitions
    local = F.col(PLACE).bitwiseAND(F.lit(_LOCAL))
    return (written.withColumn("_part", F.shiftright(PLACE, 33)).join(offsets, "_part")
            .withColumn(name, F.col("_before") + local + first).drop("_part", "_before", PLACE))


def in_order(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` with ``name`` = 1, 2, 3... in the given order."""
    return numbered(materialize(placed(rows, *order), "numbered"), name, first=1)
