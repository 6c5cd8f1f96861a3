"""A stream of finished cases as pane histograms, from which change series are scored as they grow."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.operators.histogram import paired_places

PANES = "detector string, pane long, value string, n long"


def pane_stream(cases: DataFrame, pane: int, watermark: str = "1 day", time: str = "ts") -> DataFrame:
    """(day, detector, pane, value, n) of a streaming (detector, trace_idx, value, ts): state is one counter for each day, pane and value.

    Late cases within the watermark are counted; state of older days is dropped with the day they fall in.
    """
    late = cases.withWatermark(time, watermark)
    return late.groupBy(F.window(time, "1 day").alias("day"), "detector", F.floor(F.col("trace_idx") / pane).alias("pane"), "value").agg(F.count(F.lit(1)).alias("n"))


def counted(cases: DataFrame, pane: int, path: str, watermark: str = "36500 days") -> DataFrame:
    """Runs the stream over what is there, and gives (detector, pane, value, n).

    Each batch writes the counters that it changed to a folder of its own; a batch that runs again writes the same folder
    again. Counters only grow, so the largest of a day, pane and value is the last one.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.col("day.start").alias("day"), "detector", "pane", "value", "n").write.mode("overwrite").parquet(f"{path}/counters/batch={number}")

    stream = pane_stream(cases, pane, watermark).writeStream.outputMode("update").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    stream.foreachBatch(keep).start().awaitTermination()
    rows = cases.sparkSession.read.schema("day timestamp, " + PANES).parquet(f"{path}/counters")
    last = rows.groupBy("day", "detector", "pane", "value").agg(F.max("n").alias("n"))
    return last.groupBy("detector", "pane", "value").agg(F.sum("n").alias("n"))


def paired_from_panes(panes: DataFrame, grid: DataFrame, pane: int) -> DataFrame:
    """Paired histogram (detector, k, x_end, value, o1, o2) from pane counts, as a batch over what a stream has written."""
    return paired_places(panes.withColumnRenamed("pane", "__place"), grid, pane)
