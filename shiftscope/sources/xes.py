"""Event logs in XML: XES as text by trace and MXML through Spark's reader, to canonical frames and back.

XES files are read as text that ends with each closing trace tag, in splits; one trace at a time is parsed. What stands between
traces is the log's own: extensions, globals, classifiers and attributes. Nothing is lost on the way back:

- tattrs_str, tattrs_num, tattrs_int, tattrs_type : text, numbers as doubles, int also as long, and the XES type of each attribute.
  Of a key that is repeated the last one counts, as with any map.
- tattrs_more : (key, type, text, inner, repeated) of what the maps do not hold: how a number is written, lists and
  containers, the XML inside an attribute (nested ones), and earlier ones of a repeated key.
- the same for events, as eattrs_*.

nested() lists nested attributes by path. A file holds one log; so does a folder of part files, whose parts in the order of their
names are one document. Limits: UTF-8; the closing tag of a trace must not stand in comments or CDATA; names of elements
without prefixes.
"""

import io
import itertools
import re
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.session import ship, written
from shiftscope.sources.tables import list_files

#: Element names of typed XES attributes, of what counts as a number, and of those that only hold others.
TYPES = ("string", "date", "int", "float", "boolean", "id")
NUMBERS = ("int", "float", "boolean")
HOLDERS = ("list", "container")

_ATTRIBUTE = "struct<key:string,type:string,text:string,inner:string,repeated:boolean>"
_PARSED = f"log_id string, file string, split long, gap string, trace array<{_ATTRIBUTE}>, events array<array<{_ATTRIBUTE}>>"
#: What a log holds besides its traces.
LOG_KIND = (
    "log_id string, version string, features string, extensions array<struct<name:string,prefix:string,uri:string>>, "
    f"globals array<struct<scope:string,attributes:array<{_ATTRIBUTE}>>>, classifiers array<struct<name:string,scope:string,keys:string>>, attributes array<{_ATTRIBUTE}>, head string, tail string"
)
_TEXTS = lambda *names: pa.struct([(n, pa.string()) for n in names])
_ARROW = pa.struct([*[(n, pa.string()) for n in ("key", "type", "text", "inner")], ("repeated", pa.bool_())])
_PARSED_ARROW = pa.schema([("log_id", pa.string()), ("file", pa.string()), ("split", pa.int64()), ("gap", pa.string()), ("trace", pa.list_(_ARROW)), ("events", pa.list_(pa.list_(_ARROW)))])
_LOG_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("log_id", "version", "features")],
        ("extensions", pa.list_(_TEXTS("name", "prefix", "uri"))),
        ("globals", pa.list_(pa.struct([("scope", pa.string()), ("attributes", pa.list_(_ARROW))]))),
        ("classifiers", pa.list_(_TEXTS("name", "scope", "keys"))),
        ("attributes", pa.list_(_ARROW)),
        ("head", pa.string()),
        ("tail", pa.string()),
    ]
)
_TRACE = re.compile(r"<trace[\s/>]")


def _attributes(element: ET.Element) -> list[dict]:
    out, last = [], {}
    for child in element:
        if child.tag not in TYPES and child.tag not in HOLDERS:
            continue
        inner = "".join(ET.tostring(c, "unicode").rstrip() for c in child) or None
        last[child.get("key")] = len(out)
        out.append({"key": child.get("key"), "type": child.tag, "text": child.get("value"), "inner": inner, "repeated": True})
    for i in last.values():
        out[i]["repeated"] = False
    return [a for a in out if a["key"] is not None]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each trace, and one for what stands before or after traces, in the order of the text."""
    for batch in batches:
        rows: list[tuple] = []
        for log_id, file, split, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = _TRACE.search(text)
            gap = text[: found.start()] if found else text
            if gap.strip():
                rows.append((log_id, file, split, gap, None, None))
            if found:
                for trace in ET.fromstring(f"<r>{text[found.start() :]}</trace></r>"):
                    rows.append((log_id, file, split, None, _attributes(trace), [_attributes(e) for e in trace if e.tag == "event"]))
        yield _batch(rows, _PARSED_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def numbered(raw: DataFrame, name: str = "trace_idx") -> DataFrame:
    """raw, with its log_id, file and split, and the 0-based place in that log.

    A file is read in splits. Rows are counted by split, so no task numbers more than one; the rows are written once, so
    that both uses see the same splits.
    """
    rows = written(raw.withColumn("__at", F.monotonically_increasing_id()), "xml-rows")
    before = Window.partitionBy("log_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("log_id", "file", "split").agg(F.count(F.lit(1)).alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("log_id", "file", "split").orderBy("__at")) - 1
    return rows.withColumn("__own", own).join(splits, ["log_id", "file", "split"]).withColumn(name, (F.col("__n") + F.col("__own")).cast("long")).drop("file", "split", "__at", "__n", "__own")


def _log_of(file: Column) -> Column:
    """The log that a file belongs to: itself, or the folder of a part file."""
    return F.when(F.regexp_extract(file, "/part-[^/]*$", 0) != "", F.regexp_replace(file, "/part-[^/]*$", "")).otherwise(file)


def _rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Traces and what stands between them, written: the text is read and parsed once. A file of several logs raises an error."""
    ship(spark)
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "</trace>").text(path)
    file = F.col("_metadata.file_path")
    placed = text.select(_log_of(file).alias("log_id"), file.alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    rows = written(placed.mapInArrow(_parsed, _PARSED), "xes-rows")
    opened = F.regexp_count("gap", F.lit(r"<log[\s>]"))
    many = rows.filter("gap IS NOT NULL").groupBy("log_id").agg(F.sum(opened).alias("n")).filter("n > 1").limit(1).collect()
    if many:
        raise ValueError(f"{many[0].log_id} holds {many[0].n} logs")
    return rows


def _maps(prefix: str, attributes: str) -> list[Column]:
    last = F.filter(attributes, lambda a: ~a["repeated"])
    of = lambda *types: F.filter(last, lambda a: a["type"].isin(*types))
    entries = lambda found, value: F.map_from_entries(F.transform(found, lambda a: F.struct(a["key"].alias("key"), value(a).alias("value"))))
    number = lambda a: F.when(a["text"] == "true", 1.0).when(a["text"] == "false", 0.0).otherwise(a["text"].try_cast("double"))
    more = F.filter(attributes, lambda a: a["repeated"] | a["inner"].isNotNull() | a["type"].isin(*NUMBERS, *HOLDERS))
    return [
        entries(of("string", "date", "id"), lambda a: a["text"]).alias(f"{prefix}_str"),
        entries(of(*NUMBERS), number).alias(f"{prefix}_num"),
        entries(of("int"), lambda a: a["text"].try_cast("long")).alias(f"{prefix}_int"),
        entries(last, lambda a: a["type"]).alias(f"{prefix}_type"),
        more.alias(f"{prefix}_more"),
    ]


def read_xes(spark: SparkSession, path: str | list[str], activity: str = "concept:name", time: str = "time:timestamp") -> tuple[DataFrame, DataFrame]:
    """(traces, events) of one or many XES files, plain or gzipped; log_id is the file, or the folder of part files. Traces keep their order.

    A file of several logs raises an error. write_xes() gives back what was read.
    """
    placed = numbered(_rows(spark, path).filter("trace IS NOT NULL"))
    traces = placed.select("log_id", "trace_idx", *_maps("tattrs", "trace"))
    traces = traces.select("log_id", "trace_idx", F.try_element_at("tattrs_str", F.lit("concept:name")).alias("case_id"), *traces.columns[2:])
    exploded = placed.select("log_id", "trace_idx", F.posexplode("events").alias("event_idx", "e"))
    events = exploded.select("log_id", "trace_idx", "event_idx", *_maps("eattrs", "e"))
    own = [F.try_element_at("eattrs_str", F.lit(activity)).alias("activity"), F.try_to_timestamp(F.try_element_at("eattrs_str", F.lit(time))).alias("ts")]
    return traces, events.select("log_id", "trace_idx", "event_idx", *own, *events.columns[3:])


def _log_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    local = lambda tag: tag.rsplit("}", 1)[-1]
    for batch in batches:
        rows = []
        for log_id, head, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            opened = re.search(r"<log[\s>]", head)
            root = ET.fromstring(head[opened.start() :] + (tail if "</log>" in tail or "</log>" not in head else "")) if opened else ET.Element("log")
            for element in root.iter():
                element.tag = local(element.tag)
            rows.append(
                (
                    log_id,
                    root.get("xes.version"),
                    root.get("xes.features"),
                    [{k: e.get(k) for k in ("name", "prefix", "uri")} for e in root.findall("extension")],
                    [{"scope": e.get("scope"), "attributes": _attributes(e)} for e in root.findall("global")],
                    [{k: e.get(k) for k in ("name", "scope", "keys")} for e in root.findall("classifier")],
                    _attributes(root),
                    head,
                    tail,
                )
            )
        yield _batch(rows, _LOG_ARROW)


def read_xes_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log, LOG_KIND: its version, extensions, globals, classifiers and attributes, and head and tail as they stand."""
    gaps = _rows(spark, path).filter("gap IS NOT NULL")
    # a log has few gaps: what stands before its first trace, and what after its last one
    whole = gaps.groupBy("log_id").agg(F.sort_array(F.collect_list(F.struct("file", "split", "gap"))).alias("g"))
    opened = lambda g: g["gap"].rlike(r"<log[\s>]")
    text = lambda found: F.array_join(F.transform(found, lambda g: g["gap"]), "")
    parts = whole.select("log_id", text(F.filter("g", opened)).alias("head"), text(F.filter("g", lambda g: ~opened(g))).alias("tail"))
    return parts.mapInArrow(_log_rows, LOG_KIND)


def nested(frame: DataFrame, more: str = "tattrs_more") -> DataFrame:
    """The keys of frame (log_id, trace_idx, event_idx) and (path, type, text): a row for each attribute inside another, path being the keys from the outermost one."""
    ship(frame.sparkSession)
    keys = [c for c in ("log_id", "trace_idx", "event_idx") if c in frame.columns]
    held = frame.select(*keys, F.explode(more).alias("a")).filter("a.inner IS NOT NULL").select(*keys, "a.key", "a.inner")
    kind = ", ".join(f"{c} {frame.schema[c].dataType.simpleString()}" for c in keys) + ", path array<string>, type string, text string"
    names = [*keys, "path", "type", "text"]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def walk(element: ET.Element, path: list[str]) -> Iterator[tuple]:
            for child in element:
                # the values of a list are one level with it
                own = path if child.get("key") is None else [*path, child.get("key")]
                if child.get("key") is not None:
                    yield own, child.tag, child.get("value")
                yield from walk(child, own)

        for batch in batches:
            rows = []
            for *own, key, inner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(*own, *found) for found in walk(ET.fromstring(f"<r>{inner}</r>"), [key])]
            own = [batch.schema.field(i).type for i in range(len(keys))]
            yield _batch(rows, pa.schema(list(zip(names, [*own, pa.list_(pa.string()), pa.string(), pa.string()], strict=True))))

    return held.mapInArrow(opened, kind)


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _element(kind: Column, key: Column, text: Column, inner: Column) -> Column:
    value = F.when(text.isNull(), "").otherwise(F.concat(F.lit(' value="'), _escaped(text), F.lit('"')))
    end = F.when(inner.isNull(), F.lit("/>")).otherwise(F.concat(F.lit(">"), inner, F.lit("</"), kind, F.lit(">")))
    return F.concat(F.lit("<"), kind, F.lit(' key="'), _escaped(key), F.lit('"'), value, end)


def _shown(prefix: str, frame: DataFrame, types: Column) -> Column:
    """All attributes of a row as XML."""
    kept = F.col(f"{prefix}_more") if f"{prefix}_more" in frame.columns else F.array().cast(f"array<{_ATTRIBUTE}>")
    kept = F.coalesce(kept, F.array().cast(f"array<{_ATTRIBUTE}>"))
    more = lambda key: F.try_element_at(F.filter(kept, lambda a: (a["key"] == key) & ~a["repeated"]), F.lit(1))

    def text(e: Column) -> Column:
        kind = F.coalesce(F.try_element_at(types, e["key"]), F.lit("string"))
        return _element(kind, e["key"], e["value"], more(e["key"])["inner"])

    def number(e: Column) -> Column:
        kind, known = F.coalesce(F.try_element_at(types, e["key"]), F.lit("float")), more(e["key"])
        shown = F.when(kind == "int", e["value"].cast("long").cast("string")).when(kind == "boolean", F.when(e["value"] == 1, "true").otherwise("false")).otherwise(e["value"].cast("string"))
        # as it was written, where it still is that number
        same = F.when(known["text"] == "true", 1.0).when(known["text"] == "false", 0.0).otherwise(known["text"].try_cast("double")).eqNullSafe(e["value"])
        return _element(kind, e["key"], F.when(known.isNotNull() & same, known["text"]).otherwise(shown), known["inner"])

    others = F.filter(kept, lambda a: a["repeated"] | a["type"].isin(*HOLDERS))
    every = F.concat(
        F.transform(others, lambda a: _element(a["type"], a["key"], a["text"], a["inner"])),
        F.transform(F.map_entries(f"{prefix}_str"), text),
        F.transform(F.map_entries(f"{prefix}_num"), number),
    )
    return F.array_join(every, "")


def _with(attributes: str, key: str, value: Column) -> Column:
    """The map with a value under a key, kept as it is if it has one or the value is NULL."""
    have = F.map_contains_key(attributes, key) | value.isNull()
    return F.when(have, F.col(attributes)).otherwise(F.map_concat(attributes, F.map_from_arrays(F.array(F.lit(key)), F.array(value))))


HEAD, TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<log xes.version="1.0">', "</log>"


def write_xes(traces: DataFrame, events: DataFrame, path: str, *, logs: DataFrame | None = None, by_log: bool = False) -> None:
    """Canonical frames as XES: a folder of part files, which in the order of their names are one document; with by_log a folder log_id=... for each log, in one job.

    logs (log_id, head, tail), as of read_xes_logs(), says what stands around the traces of each log. The columns *_type say which
    XES type an attribute has; without them text is `string`, numbers are `float`, and time:timestamp is `date`.
    """
    known = F.create_map().cast("map<string,string>")
    e_types = F.col("eattrs_type") if "eattrs_type" in events.columns else F.create_map(F.lit("time:timestamp"), F.lit("date"))
    t_types = F.col("tattrs_type") if "tattrs_type" in traces.columns else known
    shown = events.withColumn("eattrs_str", _with("eattrs_str", "concept:name", F.col("activity")))
    shown = shown.withColumn("eattrs_str", _with("eattrs_str", "time:timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))
    event = F.struct("event_idx", F.concat(F.lit("<event>"), _shown("eattrs", events, e_types), F.lit("</event>")).alias("x"))
    own = shown.groupBy("log_id", "trace_idx").agg(F.sort_array(F.collect_list(event)).alias("e"))
    joined = traces.withColumn("tattrs_str", _with("tattrs_str", "concept:name", F.col("case_id"))).join(own, ["log_id", "trace_idx"], "left")
    inside = F.array_join(F.coalesce(F.transform("e", lambda x: x["x"]), F.array().cast("array<string>")), "")
    body = joined.select("log_id", F.lit(1).alias("part"), "trace_idx", F.concat(F.lit("<trace>"), _shown("tattrs", traces, t_types), inside, F.lit("</trace>")).alias("value"))
    frame = traces.select("log_id").distinct() if logs is None else logs.select("log_id", "head", "tail")
    if not by_log:
        # one document; with several logs, the first one's head
        frame = frame.orderBy("log_id").limit(1)
    head, tail = (F.lit(HEAD), F.lit(TAIL)) if logs is None else (F.rtrim("head"), F.trim("tail"))
    around = frame.select("log_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), tail.alias("value")))).alias("a"))
    rows = body.unionByName(around.select("log_id", "a.part", F.lit(0).cast("long").alias("trace_idx"), "a.value")).filter("value != ''")
    order = ["log_id", "part", "trace_idx"] if by_log else ["part", "log_id", "trace_idx"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    if by_log:
        placed.select("log_id", "value").write.partitionBy("log_id").mode("overwrite").text(path)
    else:
        placed.select("value").write.mode("overwrite").text(path)


def write_files(traces: DataFrame, events: DataFrame, targets: Mapping[str, str]) -> list[str]:
    """Writes each log to a path of its own, targets being log_id: path, by one job, whatever the number of logs.

    What was one part is moved to a file of that name; a log of several parts becomes a folder, whose parts in order are
    the document. Moves are asked of the file system one by one and do not pass through Spark.
    """
    spark = traces.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    names = sorted(targets)
    # a row a log: logs are numbered in their folders' names
    numbers = spark.createDataFrame([(name, f"{i:08d}") for i, name in enumerate(names)], "log_id string, number string")
    numbered_as = lambda frame: frame.join(numbers, "log_id").drop("log_id").withColumnRenamed("number", "log_id")
    around = numbers.select(F.col("number").alias("log_id"), F.lit(HEAD).alias("head"), F.lit(TAIL).alias("tail"))
    staged = f"{targets[names[0]].rsplit('/', 1)[0]}/_logs-{uuid.uuid4().hex}"
    system = place(staged).getFileSystem(conf)
    write_xes(numbered_as(traces), numbered_as(events), staged, logs=around, by_log=True)
    for i, name in enumerate(names):
        made, target = place(f"{staged}/log_id={i:08d}"), place(targets[name])
        parts = [p.getPath() for p in system.listStatus(made) if p.getPath().getName().startswith("part-")]
        system.mkdirs(target.getParent())
        system.delete(target, True)
        system.rename(parts[0] if len(parts) == 1 else made, target)
    system.delete(place(staged), True)
    return [targets[name] for name in names]


MXML_INSTANCE = T.StructType(
    [
        T.StructField("_id", T.StringType()),
        T.StructField(
            "AuditTrailEntry",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("WorkflowModelElement", T.StringType()),
                        T.StructField("EventType", T.StringType()),
                        T.StructField("Timestamp", T.StringType()),
                        T.StructField("Originator", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_mxml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(traces, events) of MXML files."""
    raw = spark.read.format("xml").option("rowTag", "ProcessInstance").option("recursiveFileLookup", "true").schema(MXML_INSTANCE).option("pathGlobFilter", "*.mxml*").load(path)
    named = raw.select("*", F.input_file_name().alias("log_id"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"))
    placed = numbered(named)
    strings, numbers = F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,double>")
    traces = placed.select("log_id", "trace_idx", F.col("_id").alias("case_id"), strings.alias("tattrs_str"), numbers.alias("tattrs_num"))
    exploded = placed.select("log_id", "trace_idx", F.posexplode("AuditTrailEntry").alias("event_idx", "e"))
    kept = F.map_filter(F.create_map(F.lit("lifecycle:transition"), F.col("e.EventType"), F.lit("org:resource"), F.col("e.Originator")), lambda _, v: v.isNotNull())
    events = exploded.select("log_id", "trace_idx", "event_idx", F.col("e.WorkflowModelElement").alias("activity"), F.to_timestamp("e.Timestamp").alias("ts"), kept.alias("eattrs_str"), numbers.alias("eattrs_num"))
    return traces, events


def mirror_mxml(spark: SparkSession, mxml_path: str, xes_path: str) -> list[str]:
    """Converts all MXML files below a folder to XES below another, at the same places; other files are copied as they are.

    All logs are parsed and written by one job, whatever their number (write_files()). Copies are asked of the file system one by
    one and do not pass through Spark.
    """
    plain = lambda p: re.sub("^file:/+", "/", p)
    files = [r.path for r in list_files(spark, mxml_path).select("path").collect()]
    root, target_root = plain(mxml_path).rstrip("/"), xes_path.rstrip("/")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    logs = sorted(f for f in files if f.lower().endswith(".mxml"))
    system = place(target_root).getFileSystem(conf)
    for f in files:
        if f not in logs:
            source, target = place(f), place(target_root + plain(f)[len(root) :])
            system.mkdirs(target.getParent())
            jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, system, target, False, conf)
    if not logs:
        return []
    traces, events = read_mxml(spark, mxml_path)
    named = lambda frame: frame.withColumn("log_id", F.regexp_replace("log_id", "^file:/+", "/"))
    return write_files(named(traces), named(events), {plain(f): target_root + plain(f)[len(root) : -len(".mxml")] + ".xes" for f in logs})


def unzip(spark: SparkSession, path: str, target: str) -> None:
    """The text files in ZIP archives below a path, as text below target/entry=<archive>!<file>; each archive is opened in a task.

    Gzipped files need no unpacking: the readers take them as they are, one task each.
    """

    def opened(batches):
        for frame in batches:
            for archive, content in zip(frame.path, frame.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as inside:
                    for name in inside.namelist():
                        if not name.endswith("/"):
                            with inside.open(name) as lines:
                                for some in iter(lambda lines=lines: list(itertools.islice(lines, 10_000)), []):
                                    yield pd.DataFrame({"entry": f"{archive.rsplit('/', 1)[-1]}!{name.replace('/', '!')}", "value": [x.decode().rstrip("\r\n") for x in some]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    files.mapInPandas(opened, "entry string, value string").write.partitionBy("entry").text(target)
