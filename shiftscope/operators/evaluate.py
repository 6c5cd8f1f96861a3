"""Detected against true change points: precision, recall, F1 and lag."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matched(true: DataFrame, detected: DataFrame, tolerance: int, by_detector: bool) -> DataFrame:
    """(true_id, t, lag): each true point with the lag of the first detected point in reach, NULL if there is none.

    Points meet on bins as wide as the tolerance, each true point looking into three.
    """
    width = max(1, tolerance)
    place = F.col("detector") if by_detector else F.lit("")
    t = true.select(F.monotonically_increasing_id().alias("true_id"), F.col("change_point").alias("t"), place.alias("detector"))
    looking = t.select("true_id", "detector", "t", F.explode(F.array(*[F.floor(F.col("t") / width) + i for i in (-1, 0, 1)])).alias("bin"))
    d = detected.select(F.col("change_point").alias("d"), place.alias("detector"), F.floor(F.col("change_point") / width).alias("bin"))
    met = looking.join(d, ["detector", "bin"], "left")
    near = F.when(F.abs(F.col("t") - F.col("d")) <= tolerance, F.col("d"))
    return met.groupBy("true_id", "t").agg((F.min(near) - F.col("t")).alias("lag"))


def evaluate(true: DataFrame, detected: DataFrame, tolerance: int = 0, by_detector: bool = True) -> DataFrame:
    """One row: counts, precision, recall, f1_score, mean_lag, all_lags. A detected point may serve several true ones."""
    found = _matched(true, detected, tolerance, by_detector).agg(
        F.count("lag").alias("correct"), F.count(F.lit(1)).alias("trues"), F.avg("lag").alias("mean_lag"), F.sort_array(F.collect_list(F.struct("t", "lag"))).alias("lags")
    )
    counted = found.crossJoin(detected.agg(F.count(F.lit(1)).alias("detections")))
    rated = counted.withColumns({"precision": F.try_divide("correct", "detections"), "recall": F.try_divide("correct", "trues")})
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 / (1 / F.col("precision") + 1 / F.col("recall")))
    return rated.select(
        F.col("correct").alias("number_of_correct_detections"),
        F.col("trues").alias("number_of_true_changes"),
        F.col("detections").alias("number_of_detections"),
        "precision",
        "recall",
        f1.alias("f1_score"),
        "mean_lag",
        F.transform(F.filter("lags", lambda x: x["lag"].isNotNull()), lambda x: x["lag"]).alias("all_lags"),
    )


def evaluate_single(true: DataFrame, detected: DataFrame, tolerance: int) -> DataFrame:
    """The same without detectors: precision, recall, f1_score, mean_lag."""
    return evaluate(true, detected, tolerance, by_detector=False).select("number_of_correct_detections", "precision", "recall", "f1_score", "mean_lag")


def aggregated(results: DataFrame, keys: list[str]) -> DataFrame:
    """Results added up by keys: counts summed, lags pooled (all_lags, so that sums can be added up again), ratios taken again."""
    sums = results.groupBy(*keys).agg(
        F.sum("number_of_correct_detections").alias("number_of_correct_detections"),
        F.sum("number_of_true_changes").alias("number_of_true_changes"),
        F.sum("number_of_detections").alias("number_of_detections"),
        F.flatten(F.collect_list("all_lags")).alias("all_lags"),
        F.count(F.lit(1)).alias("number_experiments"),
    )
    rated = sums.withColumns({"precision": F.try_divide("number_of_correct_detections", "number_of_detections"), "recall": F.try_divide("number_of_correct_detections", "number_of_true_changes")})
    lag = F.try_divide(F.aggregate("all_lags", F.lit(0).cast("long"), lambda s, x: s + x), F.size("all_lags"))
    f1 = F.when((F.col("precision") > 0) & (F.col("recall") > 0), 2 / (1 / F.col("precision") + 1 / F.col("recall")))
    return rated.withColumns({"f1_score": f1, "mean_lag": lag, "all_lags": F.array_sort("all_lags")})
