"""Seeded synthetic drift: attributes whose distribution changes at a change point, with the truth beside them."""

import re
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.schema import Attribute

#: Hellinger distance of a new distribution at least.
LEAST_DISTANCE = 0.3
#: Mean and deviation of a recurring drift's length, in traces.
RECURRING_LENGTH = (20.0, 4.0)
MAX_TRIES = 100


def similarity_gap(p: np.ndarray, q: np.ndarray) -> float:
    """Hellinger distance."""
    return float(np.sqrt(((np.sqrt(p) - np.sqrt(q)) ** 2).sum()) / np.sqrt(2))


def distribution(rng: np.random.Generator, k: int) -> np.ndarray:
    draws = rng.random(k)
    return draws / draws.sum()


def drifted_pair(rng: np.random.Generator, k: int, change: str | None = None, least: float = LEAST_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Two distributions over k values: a new one altogether, or one with a value that the first does not have."""
    if k < 2:
        raise ValueError("two values at least")
    change = change or str(rng.choice(["new_value", "new_distribution"]))
    if change == "new_value":
        base = np.append(distribution(rng, k - 1), 0.0)
        share = rng.random()
        return base, np.append(base[:-1] * (1 - share), share)
    base = distribution(rng, k)
    for _ in range(MAX_TRIES):
        other = distribution(rng, k)
        if similarity_gap(base, other) >= least:
            return base, other
    raise ValueError(f"no distribution at distance {least} in {MAX_TRIES} tries")


@dataclass(frozen=True)
class Drift:
    name: str
    base: tuple[float, ...]
    drifted: tuple[float, ...] | None = None
    explains: int | None = None
    change_point: int | None = None
    kind: str = "sudden"
    length: int | None = None


def plan(seed: int, change_points: list[int], relevant: int = 5, irrelevant: int = 5, k: int = 3, kind: str = "sudden", jitter: float = 0.0, least: float = LEAST_DISTANCE) -> list[Drift]:
    """Drifts of relevant attributes, one change point each in turn, and attributes without drift."""
    rng, out = np.random.default_rng(seed), []
    for i in range(relevant):
        explains = change_points[i % len(change_points)]
        base, other = drifted_pair(rng, k, None, least)
        at = explains - int(abs(rng.normal(0, jitter))) if jitter else explains
        length = max(1, int(rng.normal(*RECURRING_LENGTH))) if kind == "recurring" else None
        out.append(Drift(f"relevant_attribute_{i + 1:02d}", tuple(base), tuple(other), explains, at, kind, length))
    for i in range(irrelevant):
        out.append(Drift(f"irrelevant_attribute_{i + 1:02d}", tuple(distribution(rng, k))))
    return out


def _sampled(u: Column, shares: tuple[float, ...]) -> Column:
    """value_1 to value_k by cumulative shares."""
    edges = np.cumsum(shares)
    value = F.when(u < float(edges[0]), "value_1")
    for i, edge in enumerate(edges[1:-1], start=2):
        value = value.when(u < float(edge), f"value_{i}")
    last = max(i for i, p in enumerate(shares, start=1) if p > 0)
    return value.otherwise(f"value_{last}")


def with_drifts(traces: DataFrame, drifts: list[Drift], seed: int = 0) -> DataFrame:
    """traces with a column for each drift. A value follows from the seed, the name and trace_idx alone."""
    columns = {}
    for d in drifts:
        u = F.pmod(F.xxhash64(F.lit(seed), F.lit(d.name), F.col("trace_idx")), F.lit(1 << 40)) / F.lit(float(1 << 40))
        value = _sampled(u, d.base)
        if d.drifted:
            end = F.lit(True) if d.length is None else F.col("trace_idx") < d.change_point + d.length
            value = F.when((F.col("trace_idx") >= d.change_point) & end, _sampled(u, d.drifted)).otherwise(value)
        columns[d.name] = value
    return traces.withColumns(columns)


def truth(spark, drifts: list[Drift]) -> DataFrame:
    """(attribute_name, base_distribution, explain_change_point, change_point, drift_type) of all attributes."""
    rows = [(d.name, [float(x) for x in d.base], d.explains, d.change_point, d.kind if d.drifted else None) for d in drifts]
    return spark.createDataFrame(rows, "attribute_name string, base_distribution array<double>, explain_change_point long, change_point long, drift_type string")


def true_explanations(spark, drifts: list[Drift]) -> DataFrame:
    return spark.createDataFrame([(d.explains, f"trace: {d.name}") for d in drifts if d.drifted], "change_point long, detector string")


def descriptors(relevant: int = 5, irrelevant: int = 5) -> list[Attribute]:
    """The attributes of a synthetic log, irrelevant ones first."""
    names = [f"{kind}_attribute_{i + 1:02d}" for kind, n in (("irrelevant", irrelevant), ("relevant", relevant)) for i in range(n)]
    return [Attribute(name, "trace", "categorical") for name in names]


def add_to_traces(traces: DataFrame, drifts: list[Drift], seed: int = 0) -> DataFrame:
    """Canonical traces with the attributes in tattrs_str (and tattrs_type, where there is one)."""
    made = with_drifts(traces, drifts, seed)
    pairs = [x for d in drifts for x in (F.lit(d.name), F.col(d.name))]
    made = made.withColumn("tattrs_str", F.map_concat("tattrs_str", F.create_map(*pairs)))
    if "tattrs_type" in traces.columns:
        made = made.withColumn("tattrs_type", F.map_concat("tattrs_type", F.create_map(*[F.lit(x) for d in drifts for x in (d.name, "string")])))
    return made.select(*traces.columns)


def file_to_file(spark: SparkSession, source: str, target: str, drifts: list[Drift], seed: int = 0) -> None:
    """A XES log with the attributes added, as another."""
    from shiftscope.sources.xes import read_xes, write_xes

    traces, events = read_xes(spark, source)
    write_xes(add_to_traces(traces, drifts, seed), events, target)


_DRIFTS = "array<struct<name:string,base:array<double>,base_last:int,drifted:array<double>,drifted_last:int,change_point:long,stop:long>>"


def _as_data(drifts: list[Drift]) -> list[tuple]:
    """Drifts as rows: the cumulative shares but the last, and the last value that has a share."""
    edges = lambda shares: None if shares is None else [float(x) for x in np.cumsum(shares)[:-1]]
    last = lambda shares: None if shares is None else max(i for i, p in enumerate(shares, start=1) if p > 0)
    stop = lambda d: None if d.length is None or d.change_point is None else d.change_point + d.length
    return [(d.name, edges(d.base), last(d.base), edges(d.drifted), last(d.drifted), d.change_point, stop(d)) for d in drifts]


def drifted_values(seed: Column, drifts: Column, trace_idx: Column) -> Column:
    """with_drifts() where seed and drifts (_DRIFTS) are columns: a map of the attributes' names and values."""

    def value(d: Column) -> Column:
        u = F.pmod(F.xxhash64(seed, d["name"], trace_idx), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sampled = lambda edges, last: F.concat(F.lit("value_"), F.least(F.size(F.filter(edges, lambda e: e <= u)) + 1, last).cast("string"))
        changed = d["drifted"].isNotNull() & (trace_idx >= d["change_point"]) & F.coalesce(trace_idx < d["stop"], F.lit(True))
        return F.when(changed, sampled(d["drifted"], d["drifted_last"])).otherwise(sampled(d["base"], d["base_last"]))

    return F.map_from_entries(F.transform(drifts, lambda d: F.struct(d["name"].alias("key"), value(d).alias("value"))))


def dataset_batch(spark: SparkSession, logs: Mapping[str, int], target: str, configs: Mapping[str, dict], times: int = 2, seed: int = 0) -> DataFrame:
    """Generates each configuration `times` times on each log (path: number of traces): target/config/size/base_id.xes.

    configs maps a name to options of plan(). Returns the truth of all logs, (config, size, path, ...) beside truth()'s
    columns; ids follow from the seed. The logs are read once and all data sets written by one job: a data set's plan is a row
    that its log's traces are joined with.
    """
    from shiftscope.sources.xes import read_xes, write_files

    variants, truths = [], []
    for c, (config, options) in enumerate(configs.items()):
        for b, (source, size) in enumerate(sorted(logs.items())):
            for i in range(times):
                own = seed + 10_007 * c + 101 * b + i
                drifts = plan(own, [int((j + 1) * size / 10) for j in range(9)], **options)
                base = source.rstrip("/").rsplit("/", 1)[-1].split(".")[0]
                path = f"{target.rstrip('/')}/{config}/{size}/{base}_{uuid.UUID(int=np.random.default_rng(own).integers(1 << 62))}.xes"
                variants.append((_plain(source), path, own, _as_data(drifts)))
                truths += [(config, size, path, d.name, [float(x) for x in d.base], d.explains, d.change_point, d.kind if d.drifted else None) for d in drifts]
    # a row a data set
    made = F.broadcast(spark.createDataFrame(variants, f"source string, variant string, seed int, drifts {_DRIFTS}"))
    traces, events = read_xes(spark, sorted(logs))
    of = lambda frame: frame.withColumn("source", F.regexp_replace("log_id", "^file:/+", "/")).join(made, "source")
    added = of(traces).withColumn("__new", drifted_values(F.col("seed"), F.col("drifts"), F.col("trace_idx")))
    added = added.withColumns(
        {
            "tattrs_str": F.map_concat("tattrs_str", "__new"),
            "tattrs_type": F.map_concat("tattrs_type", F.transform_values("__new", lambda k, v: F.lit("string"))),
            "log_id": F.col("variant"),
        }
    )
    write_files(added.select(*traces.columns), of(events).withColumn("log_id", F.col("variant")).select(*events.columns), {v[1]: v[1] for v in variants})
    kind = "config string, size int, path string, attribute_name string, base_distribution array<double>, explain_change_point long, change_point long, drift_type string"
    return spark.createDataFrame(truths, kind)


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)
