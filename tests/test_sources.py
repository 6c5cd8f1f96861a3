"""Logs in XML, ZIP and tables, and results as CSV: round trips."""

import gzip
import zipfile

import pytest
from pyspark.sql import functions as F

from shiftscope.operators import explore, synth
from shiftscope.sources import tables, xes

EVENT = '<event><string key="concept:name" value="{a}"/><date key="time:timestamp" value="2020-01-01T10:0{i}:00.000+00:00"/><int key="cost" value="{i}"/><boolean key="ok" value="true"/><id key="ref" value="r{i}"/></event>'
LOG = """<?xml version="1.0"?>
<log xes.version="1.0">
<trace><string key="concept:name" value="c1"/><int key="size" value="4"/><float key="share" value="0.5"/><boolean key="open" value="false"/><date key="due" value="2020-02-01T00:00:00.000+00:00"/>{first}</trace>
<trace><string key="concept:name" value="c2"/><string key="colour" value="red &amp; blue"/></trace>
</log>
"""


def log(n=2):
    return LOG.format(first="".join(EVENT.format(a="ab"[i % 2], i=i) for i in range(n)))


def shown(traces, events):
    drop = lambda frame: [r.asDict() for r in frame.drop("log_id").collect()]
    return sorted(map(str, drop(traces))), sorted(map(str, drop(events)))


def test_xes_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.xes").write_text(log())
    traces, events = xes.read_xes(spark, f"{tmp_path}/in")
    first = traces.filter("trace_idx = 0").first()
    assert (first.case_id, first.tattrs_num["size"], first.tattrs_type["due"], first.tattrs_str["due"]) == ("c1", 4.0, "date", "2020-02-01T00:00:00.000+00:00")
    assert [(r.event_idx, r.activity, r.eattrs_num["cost"], r.eattrs_num["ok"], r.eattrs_type["ref"]) for r in events.orderBy("event_idx").collect()] == [(0, "a", 0.0, 1.0, "id"), (1, "b", 1.0, 1.0, "id")]
    xes.write_xes(traces, events, f"{tmp_path}/out")
    again = xes.read_xes(spark, f"{tmp_path}/out")
    assert shown(traces, events) == shown(*again)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert '<int key="size" value="4"' in text and '<boolean key="open" value="false"' in text and '<id key="ref" value="r1"' in text
    names = {(r.log_id.rsplit("/", 1)[-1], r.name) for r in explore.trace_attributes(traces).collect()}
    assert names == {("one.xes", x) for x in ("concept:name", "size", "share", "open", "due", "colour")}
    kinds = {r.name: r.kind for r in explore.attribute_catalog(traces, events, ["size", "colour"], ["cost", "none"]).collect()}
    assert kinds == {"size": "continuous", "colour": "categorical", "cost": "continuous"}
    mixed = traces.withColumn("tattrs_str", F.map_concat("tattrs_str", F.create_map(F.lit("size"), F.lit("big"))))
    with pytest.raises(Exception, match="mixed kinds: size"):
        explore.attribute_catalog(mixed, events).collect()


def test_many_logs_and_compression(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.xes").write_text(log(1))
    with gzip.open(tmp_path / "sub" / "b.xes.gz", "wt") as f:
        f.write(log(3))
    traces, events = xes.read_xes(spark, str(tmp_path))
    assert {(r.log_id.rsplit("/", 1)[-1], r.n, r.most) for r in traces.groupBy("log_id").agg(F.count("*").alias("n"), F.max("trace_idx").alias("most")).collect()} == {("a.xes", 2, 1), ("b.xes.gz", 2, 1)}
    assert events.count() == 4
    stats = {r.log_id.rsplit("/", 1)[-1]: (r.traces, r.events, r.trace_attributes, r.event_attributes) for r in explore.log_stats(traces, events).collect()}
    assert stats == {"a.xes": (2, 1, 6, 5), "b.xes.gz": (2, 3, 6, 5)}
    (tmp_path / "two.xes").write_text(log() + log().split("\n", 1)[1])
    with pytest.raises(ValueError, match="holds 2 logs"):
        xes.read_xes(spark, str(tmp_path))


def test_order_over_splits(spark, tmp_path):
    traces = "".join(f'<trace>\n<string key="concept:name" value="{i}"/>\n<string key="pad" value="{"x" * 200}"/>\n</trace>\n' for i in range(2000))
    (tmp_path / "long.xes").write_text(f"<log>\n{traces}</log>\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        placed, _ = xes.read_xes(spark, str(tmp_path))
        assert placed.filter(F.col("case_id") != F.col("trace_idx").cast("string")).count() == 0 and placed.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mxml_mirror(spark, tmp_path):
    entry = "<AuditTrailEntry><WorkflowModelElement>{a}</WorkflowModelElement><EventType>complete</EventType><Timestamp>2020-01-01T10:0{i}:00.000+00:00</Timestamp><Originator>me</Originator></AuditTrailEntry>"
    body = '<WorkflowLog><Process id="p">' + "".join(f'<ProcessInstance id="{c}">' + "".join(entry.format(a=a, i=i) for i, a in enumerate("xy")) + "</ProcessInstance>" for c in ("k1", "k2")) + "</Process></WorkflowLog>"
    source = tmp_path / "in" / "deep"
    source.mkdir(parents=True)
    (source / "log.mxml").write_text(body)
    (tmp_path / "in" / "notes.txt").write_text("as it is")
    assert xes.mirror_mxml(spark, f"{tmp_path}/in", f"{tmp_path}/out") == [f"{tmp_path}/out/deep/log.xes"]
    assert (tmp_path / "out" / "notes.txt").read_text() == "as it is"
    traces, events = xes.read_xes(spark, f"{tmp_path}/out/deep/log.xes")
    assert [r.case_id for r in traces.orderBy("trace_idx").collect()] == ["k1", "k2"]
    assert {(r.activity, r.eattrs_str["org:resource"], r.eattrs_str["lifecycle:transition"]) for r in events.collect()} == {("x", "me", "complete"), ("y", "me", "complete")}


def test_zipped_logs(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "logs.zip", "w") as z:
        z.writestr("d/one.xes", log())
        z.writestr("two.xes", log(1))
    xes.unzip(spark, str(tmp_path), f"{tmp_path}/open")
    traces, events = xes.read_xes(spark, f"{tmp_path}/open")
    assert traces.count() == 4 and events.count() == 3


def test_results_round_trip(spark, tmp_path):
    kind = "number_of_correct_detections long, precision double, all_lags array<bigint>, experiment string, compute_time double"
    rows = spark.createDataFrame([(1, 0.5, [3, -4], "a", 1.5), (0, None, [], "a", 2.0)], kind)
    tables.append_results(rows, f"{tmp_path}/r", fresh=True)
    tables.append_results(rows.limit(1), f"{tmp_path}/r")
    back = tables.read_results(spark, f"{tmp_path}/r")
    assert sorted((r.number_of_correct_detections, r.precision or 0, r.all_lags, r.compute_time) for r in back.collect()) == [(0, 0, [], 2.0), (1, 0.5, [3, -4], 1.5), (1, 0.5, [3, -4], 1.5)]
    assert back.schema["config_window_size"].dataType.simpleString() == "int"


def test_synthetic_files(spark, tmp_path):
    traces = "".join(f'<trace><string key="concept:name" value="{i}"/></trace>\n' for i in range(100))
    (tmp_path / "base.xes").write_text(f"<log>\n{traces}</log>\n")
    truth = synth.dataset_batch(spark, {f"{tmp_path}/base.xes": 100}, f"{tmp_path}/made", {"sudden": {"relevant": 2, "irrelevant": 1}, "recurring": {"kind": "recurring", "relevant": 1, "irrelevant": 0}}, times=2)
    paths = sorted({(r.config, r.path) for r in truth.select("config", "path").collect()})
    assert len(paths) == 4 and all(f"/made/{c}/100/base_" in p for c, p in paths) and truth.count() == 2 * 3 + 2 * 1
    made, _ = xes.read_xes(spark, paths[2][1])
    assert made.count() == 100 and made.filter(F.map_contains_key("tattrs_str", "relevant_attribute_02")).count() == 100


def test_paths_and_detector_output(spark, tmp_path):
    assert tables.moved_path("/a/b/c.mxml", "/a", "/z", ".xes") == "/z/b/c.xes"
    assert tables.detector_command("p.jar", "l.xes", adaptive=False, gradual=True)[-2:] == ["-fwin", "-gradual"]
    assert [r.change_point for r in tables.detector_points(spark, "x drift detected at trace: 510\ny drift detected at trace: 890").orderBy("change_point").collect()] == [510, 890]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "f.txt").write_text("1")
    (tmp_path / "g.txt").write_text("22")
    assert tables.list_files(spark, str(tmp_path)).count() == 2 and tables.list_files(spark, str(tmp_path), recursive=False).count() == 1
