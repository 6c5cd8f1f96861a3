"""Secret scans with multipart linking.

Strong spans are reported wherever they stand: assignments to secret names, access keys, long hexadecimal runs. Weak
parts say nothing alone: account identifiers, endpoints, and opaque values. They are linked by an interval join: a
weak part is reported if a complementary part stands within REACH code points of it in the same scope, from the end of
one to the start of the other, scopes being the stretches between blank lines. Complements are: of an opaque value, an
identifier, access key or endpoint; of an identifier, a secret (assignment, hexadecimal run or opaque value); of an
endpoint, both an identifier or access key and a secret. Parts that overlap are no complements of each other, and an
opaque value within a strong span, an identifier or an endpoint is no part of its own. An endpoint ends before `;`, `?`
and `#`, so a signature among a URL's parameters is one. The join runs over sorted ends and sorted starts within a text,
so a text with many parts is not paired with itself.

Cases: null and empty texts have no spans. Offsets are code points, ends exclusive. Repeated rows get equal spans. No
rows: no rows. Texts are taken whole. Other columns pass unchanged; the helper column is
named __secret_spans, and a column that begins with __secret_ is replaced.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import ship

#: Kinds in the order in which spans of one start are listed; the first three are strong.
KINDS = ("assign", "access", "hex", "identifier", "endpoint", "opaque")
REACH = 300

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""\b(?:user(?:_?name)?|login|account|client_?id|access_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9][A-Za-z0-9._@-]{2,})""", re.IGNORECASE | re.ASCII)
_ENDPOINT = re.compile(r"""https?://[^\s"'<>|;?#]{4,}|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:-]{3,}""", re.IGNORECASE | re.ASCII)
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _merged(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the disjoint intervals that the spans cover."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends = np.array(sorted(spans), dtype=np.int64).T
    reached = np.maximum.accumulate(ends)
    first = np.concatenate(([True], starts[1:] >= reached[:-1]))
    return starts[first], reached[np.append(first[1:], True)]


def _overlaps(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span overlaps one of the disjoint intervals."""
    if not len(starts) or not spans:
        return np.zeros(len(spans), bool)
    low, high = np.array(spans, dtype=np.int64).T
    at = np.searchsorted(ends, low, side="right")
    return (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < high)


def _near(places: tuple[np.ndarray, np.ndarray, np.ndarray], of: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether a part of `of` in the same scope lies wholly before or after each place, at most REACH code points away."""
    (starts, ends, scopes), (of_start, of_end, of_scope) = places, of
    if not len(of_start) or not len(starts):
        return np.zeros(len(starts), bool)
    # scopes follow one another; each is moved beyond the reach of the one before it
    width = max(int(of_end.max()), int(ends.max())) + REACH + 1
    left, right = np.sort(of_end + of_scope * width), np.sort(of_start + of_scope * width)
    before = np.searchsorted(left, starts + scopes * width, side="right") - 1
    after = np.searchsorted(right, ends + scopes * width)
    ends_near = (before >= 0) & (left[np.maximum(before, 0)] >= starts - REACH + scopes * width)
    starts_near = (after < len(right)) & (right[np.minimum(after, len(right) - 1)] <= ends + REACH + scopes * width)
    return ends_near | starts_near


def linked_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The weak parts of text that have their complements near."""
    parts = {"identifier": [], "endpoint": [], "opaque": []}
    if "://" in text or ":" in text or "=" in text:
        parts["identifier"] = [m.span() for m in _IDENTIFIER.finditer(text)]
        parts["endpoint"] = [m.span() for m in _ENDPOINT.finditer(text)]
    access = [(a, b) for k, a, b in strong if k == "access"]
    if not (parts["identifier"] or parts["endpoint"] or access):
        return []
    opaque = [m.span() for m in _OPAQUE.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])]
    taken = _overlaps(opaque, *_merged([(a, b) for _, a, b in strong] + parts["identifier"] + parts["endpoint"]))
    parts["opaque"] = [s for s, known in zip(opaque, taken, strict=True) if not known]
    breaks = np.array([m.start() for m in _BLANK.finditer(text)] or [len(text)])

    def places(spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends = np.array(sorted(spans), dtype=np.int64).reshape(-1, 2).T
        return starts, ends, np.searchsorted(breaks, starts)

    names = places(parts["identifier"] + access)
    ends = places(parts["endpoint"])
    secrets = places([(a, b) for k, a, b in strong if k != "access"] + parts["opaque"])
    found = []
    for kind in ("identifier", "endpoint", "opaque"):
        spans = sorted(parts[kind])
        own = places(spans)
        if kind == "identifier":
            near = _near(own, secrets)
        elif kind == "endpoint":
            near = _near(own, secrets) & _near(own, names)
        else:
            near = _near(own, names) | _near(own, ends)
        found += [(kind, *s) for s, ok in zip(spans, near, strict=True) if ok]
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = []
        for text in batch.column(batch.schema.get_field_index("__secret_text")):
            text = text.as_py() or ""
            found = strong_spans(text)
            found += linked_spans(text, found)
            found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        yield batch.set_column(batch.schema.get_field_index("__secret_spans"), "__secret_spans", pa.array(spans, kind))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with __secret_spans: array of (kind, start, end), ordered by start, then kind."""
    ship(docs.sparkSession)
    ready = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if not c.startswith("__secret_")], F.col(text_col).alias("__secret_text"), F.array().cast("array<struct<kind:string,start:long,end:long>>").alias("__secret_spans")
    )
    return ready.mapInArrow(_scan, ready.schema).drop("__secret_text")


def of_kinds(*kinds: str) -> Column:
    return F.filter("__secret_spans", lambda s: s["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
