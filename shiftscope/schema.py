"""Canonical frames of an event log.

traces  : log_id, trace_idx, case_id and attribute columns or maps (tattrs_str, tattrs_num)
events  : log_id, trace_idx, event_idx, activity, ts and attribute columns or maps (eattrs_str, eattrs_num)
values  : detector, trace_idx, value: one row for each value of an attribute, all attributes in one frame
grid    : region, k, a_start, a_end, b_start, b_end (inclusive trace positions)
series  : detector, pos, x_end, value (NULL: undefined)
points  : detector, change_point
explain : primary_cp, rank, detector, secondary_cp, lag

Positions are 0-based; every algorithm keys on them, so they are columns from the start.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftscope.session import written


@dataclass(frozen=True)
class Attribute:
    """Descriptor of an attribute: level is trace or event, kind is categorical or continuous."""

    name: str
    level: str
    kind: str

    @property
    def detector(self) -> str:
        return f"{self.level}: {self.name}"


def dense_index(rows: DataFrame, order: list, name: str = "trace_idx") -> DataFrame:
    """rows with their 0-based position in the given total order.

    Rows are sorted by range partitions; a position is the place in its partition and the number of rows in those before,
    so no task sees more than its own range and rows are shuffled once. Range bounds come from a sample that differs between
    runs of a plan, so the sorted rows are written once, with their partition and place. There are as many partitions as the
    session's shuffles have, which a session over more data sets higher; callers leave out columns that they do not need.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the number of the partition in the upper bits, that of the row in it in the lower 33
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__place", place)
    table = written(ranged.select("*", F.shiftright("__place", 33).alias("__part"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__local")).drop("__place"), "dense-index")
    counts = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # one row a partition: its number is that of the partitions
    placed = table.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__local"))
    return placed.drop("__part", "__local", "__before")
