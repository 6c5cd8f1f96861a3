"""Tables as event logs, files by path, and results as CSV."""

import re
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.schema import dense_index

RESULT_SCHEMA = (
    "number_of_correct_detections long, number_of_true_changes long, number_of_detections long, precision double, recall double, f1_score double, "
    "mean_lag double, all_lags string, config_window_generator_type string, config_window_size int, config_threshold double, config_max_distance int, "
    "config_slide_by int, config_proportional_phi double, config_proportional_rho double, experiment string, config_event_log_file_path string, compute_time double"
)


def traces_of(table: DataFrame, order: list[str]) -> DataFrame:
    """A table with one row per case as traces: trace_idx follows the order, which must be total."""
    return dense_index(table, [F.col(c) for c in order])


def events_of(table: DataFrame, case: list[str], activity: str, time: str) -> DataFrame:
    """(trace_idx, event_idx, activity, ts, and the columns): cases are ordered by their first event."""
    from pyspark.sql import Window

    cases = dense_index(table.groupBy(*case).agg(F.min(time).alias("__first")), [F.col("__first"), *[F.col(c) for c in case]]).drop("__first")
    order = Window.partitionBy("trace_idx").orderBy(time)
    return table.join(cases, case).withColumns({"event_idx": F.row_number().over(order) - 1, "activity": F.col(activity), "ts": F.col(time)})


def long_values(traces: DataFrame, columns: list[str], level: str = "trace", kind: str = "string", keep: tuple[str, ...] = ()) -> DataFrame:
    """(detector, trace_idx, value, and the columns to keep): the columns of all attributes one below the other."""
    cells = F.array(*[F.struct(F.lit(f"{level}: {c}").alias("detector"), F.col(c).cast(kind).alias("value")) for c in columns])
    return traces.select("trace_idx", *keep, F.explode(cells).alias("x")).select("x.detector", "trace_idx", "x.value", *keep)


def list_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, through Spark's own file systems."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length").orderBy("path")


def moved_path(path: str, old_base: str, new_base: str, extension: str | None = None) -> str:
    """path below new_base instead of old_base, with another extension if one is given."""
    moved = PurePath(new_base) / PurePath(path).relative_to(old_base)
    return str(moved.with_suffix(extension) if extension else moved)


def append_results(results: DataFrame, path: str, fresh: bool = False) -> None:
    """Adds result rows to a CSV folder, each file with a header; fresh begins anew. Missing columns are NULL."""
    lags = F.concat(F.lit("["), F.array_join(F.col("all_lags").cast("array<string>"), ", "), F.lit("]"))
    have = {f.name: f.dataType for f in T.StructType.fromDDL(RESULT_SCHEMA).fields}
    shown = results.withColumn("all_lags", lags)
    rows = shown.select(*[(F.col(c) if c in shown.columns else F.lit(None)).cast(t).alias(c) for c, t in have.items()])
    rows.write.mode("overwrite" if fresh else "append").option("header", "true").csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", "true").schema(RESULT_SCHEMA).csv(path)
    return rows.withColumn("all_lags", F.from_json("all_lags", "array<bigint>"))


def detector_command(jar: str, log: str, mechanism: str = "runs", window_size: int = 200, adaptive: bool = True, gradual: bool = False) -> list[str]:
    """The command line of an external detector that is given a log file."""
    return ["java", "-jar", jar, "-fp", log, "-ddm", mechanism, "-ws", str(window_size), *([] if adaptive else ["-fwin"]), *(["-gradual"] if gradual else [])]


def detector_points(spark: SparkSession, output: str, name: str = "external") -> DataFrame:
    """The change points in an external detector's output."""
    found = [(name, int(x)) for x in re.findall(r"drift detected at trace: (\d+)", output)]
    return spark.createDataFrame(found, "detector string, change_point long")
