"""All of XES there and back: log level, nested and repeated attributes, numbers as they are written; many logs in one job."""

import json

from pyspark.sql import functions as F

from shiftscope.sources import xes

WHOLE = """<?xml version="1.0" encoding="UTF-8"?>
<log xes.version="1849-2016" xes.features="nested-attributes" xmlns="http://www.xes-standard.org/">
  <extension name="Concept" prefix="concept" uri="http://www.xes-standard.org/concept.xesext"/>
  <global scope="trace"><string key="concept:name" value="none"/></global>
  <global scope="event"><string key="concept:name" value="none"/><date key="time:timestamp" value="1970-01-01T00:00:00.000+00:00"/></global>
  <classifier name="Activity" scope="event" keys="concept:name"/>
  <string key="source" value="a &amp; b"><int key="version" value="7"/></string>
  <int key="size" value="2"/>
  <trace>
    <string key="concept:name" value="c1"/>
    <int key="big" value="9007199254740993"/>
    <float key="share" value="0.50"/>
    <float key="plain" value="1E3"/>
    <string key="twice" value="first"/>
    <string key="twice" value="second"/>
    <string key="address" value="here"><string key="street" value="x &lt; y"/><string key="city" value="z"><int key="zip" value="12"/></string></string>
    <list key="items"><values><string key="item" value="i1"/><string key="item" value="i2"/></values></list>
    <container key="box"><boolean key="open" value="true"/></container>
    <event><string key="concept:name" value="a"/><date key="time:timestamp" value="2020-01-01T10:00:00.123+02:00"/><int key="cost" value="-9223372036854775808"><string key="currency" value="EUR"/></int></event>
    <event/>
  </trace>
  <trace/>
  <trace><string key="concept:name" value="c3&quot;&#10;"/><boolean key="ok" value="false"/></trace>
</log>
"""


def attributes(element):
    """Everything below an element, without the order of siblings of different keys."""
    own = {}
    for child in element:
        own.setdefault(child.get("key"), []).append((child.tag, child.get("value"), attributes(child)))
    return sorted(own.items(), key=str)


def parsed(text):
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    for e in root.iter():
        e.tag = e.tag.rsplit("}", 1)[-1]
    return root


def document(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_round_trip_of_a_whole_log(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "whole.xes").write_text(WHOLE)
    traces, events = xes.read_xes(spark, f"{tmp_path}/in")
    logs = xes.read_xes_logs(spark, f"{tmp_path}/in")
    first = traces.filter("trace_idx = 0").first()
    assert first.tattrs_int["big"] == 9007199254740993 and first.tattrs_num["share"] == 0.5
    assert first.tattrs_str["twice"] == "second" and first.tattrs_type["items"] == "list"
    assert traces.count() == 3 and traces.filter("trace_idx = 1 AND case_id IS NULL").count() == 1
    assert events.filter("event_idx = 1 AND activity IS NULL").count() == 1
    log = logs.first()
    assert (log.version, log.features) == ("1849-2016", "nested-attributes")
    assert [(e.name, e.prefix) for e in log.extensions] == [("Concept", "concept")] and [(c.name, c.scope, c["keys"]) for c in log.classifiers] == [("Activity", "event", "concept:name")]
    assert [(g.scope, [a.key for a in g.attributes]) for g in log.globals] == [("trace", ["concept:name"]), ("event", ["concept:name", "time:timestamp"])]
    assert [(a.key, a.type, a.text) for a in log.attributes] == [("source", "string", "a & b"), ("size", "int", "2")]
    inside = {(r.trace_idx, tuple(r.path), r.type, r.text) for r in xes.nested(traces).collect()}
    assert inside == {
        (0, ("address", "street"), "string", "x < y"),
        (0, ("address", "city"), "string", "z"),
        (0, ("address", "city", "zip"), "int", "12"),
        (0, ("items", "item"), "string", "i1"),
        (0, ("items", "item"), "string", "i2"),
        (0, ("box", "open"), "boolean", "true"),
    }
    assert [(r.event_idx, r.path, r.text) for r in xes.nested(events, "eattrs_more").collect()] == [(0, ["cost", "currency"], "EUR")]

    xes.write_xes(traces, events, f"{tmp_path}/out.xes", logs=logs)
    want, got = parsed(WHOLE), parsed(document(tmp_path / "out.xes"))
    assert got.attrib == want.attrib
    assert [attributes(t) for t in got.findall("trace")] == [attributes(t) for t in want.findall("trace")]
    assert [[attributes(e) for e in t.findall("event")] for t in got.findall("trace")] == [[attributes(e) for e in t.findall("event")] for t in want.findall("trace")]
    for tag in ("extension", "global", "classifier", "string", "int"):
        assert [(e.attrib, attributes(e)) for e in got.findall(tag)] == [(e.attrib, attributes(e)) for e in want.findall(tag)]
    again = xes.read_xes(spark, f"{tmp_path}/out.xes")
    sorted_lists = lambda r: {k: sorted(v, key=str) if isinstance(v, list) else v for k, v in r.asDict(recursive=True).items()}
    rows = lambda frame: sorted(json.dumps(sorted_lists(r), sort_keys=True, default=str) for r in frame.drop("log_id").collect())
    assert rows(again[0]) == rows(traces) and rows(again[1]) == rows(events)
    back = xes.read_xes_logs(spark, f"{tmp_path}/out.xes").first()
    assert (back.extensions, back.globals, back.classifiers, back.attributes) == (log.extensions, log.globals, log.classifiers, log.attributes)


def test_changed_numbers_are_written_as_they_are_now(spark, tmp_path):
    (tmp_path / "one.xes").write_text(WHOLE)
    traces, events = xes.read_xes(spark, f"{tmp_path}/one.xes")
    moved = traces.withColumn("tattrs_num", F.transform_values("tattrs_num", lambda k, v: F.when(k == "share", v + 1).otherwise(v)))
    xes.write_xes(moved, events, f"{tmp_path}/out")
    text = document(tmp_path / "out")
    assert '<float key="share" value="1.5"/>' in text and '<float key="plain" value="1E3"/>' in text and '<int key="big" value="9007199254740993"/>' in text


def test_many_logs_in_one_job(spark, tmp_path):
    entry = "<AuditTrailEntry><WorkflowModelElement>{a}</WorkflowModelElement><EventType>complete</EventType><Timestamp>2020-01-01T10:00:00.000+00:00</Timestamp><Originator>me</Originator></AuditTrailEntry>"
    for i in range(60):
        folder = tmp_path / "in" / f"d{i % 4}"
        folder.mkdir(parents=True, exist_ok=True)
        cases = "".join(f'<ProcessInstance id="k{i}-{c}">{entry.format(a="x")}{entry.format(a="y")}</ProcessInstance>' for c in range(1 + i % 3))
        (folder / f"log{i}.mxml").write_text(f'<WorkflowLog><Process id="p">{cases}</Process></WorkflowLog>')
    tracker = spark.sparkContext.statusTracker()
    seen = set(tracker.getJobIdsForGroup(None))
    made = xes.mirror_mxml(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert len(made) == 60 and len(set(tracker.getJobIdsForGroup(None)) - seen) < 30
    assert (tmp_path / "out" / "d1" / "log1.xes").read_text().startswith("<?xml") and not (tmp_path / "out" / "_logs").exists()
    traces, events = xes.read_xes(spark, f"{tmp_path}/out")
    cases = {(r.log_id.rsplit("/", 1)[-1], r.trace_idx, r.case_id) for r in traces.collect()}
    assert cases == {(f"log{i}.xes", c, f"k{i}-{c}") for i in range(60) for c in range(1 + i % 3)} and events.count() == 2 * len(cases)


def test_logs_in_folders_of_parts(spark, tmp_path):
    for name in ("a", "b"):
        traces = "".join(f'<trace>\n<string key="concept:name" value="{name}{i}"/>\n<string key="pad" value="{"x" * 300}"/>\n</trace>\n' for i in range(400))
        (tmp_path / f"{name}.xes").write_text(f'<log>\n<string key="name" value="{name}"/>\n{traces}</log>\n')
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        traces, events = xes.read_xes(spark, str(tmp_path))
        logs = xes.read_xes_logs(spark, str(tmp_path))
        short = lambda f: f.withColumn("log_id", F.regexp_extract("log_id", r"(\w)\.xes$", 1))
        xes.write_xes(short(traces), short(events), f"{tmp_path}/out", logs=short(logs), by_log=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(len(list((tmp_path / "out" / f"log_id={n}").glob("part-*"))) for n in "ab") > 1
    again, _ = xes.read_xes(spark, f"{tmp_path}/out")
    assert {(r.log_id[-1], r.trace_idx, r.case_id) for r in again.collect()} == {(n, i, f"{n}{i}") for n in "ab" for i in range(400)}
    assert {(r.log_id[-1], r.attributes[0].text) for r in xes.read_xes_logs(spark, f"{tmp_path}/out").collect()} == {("a", "a"), ("b", "b")}
