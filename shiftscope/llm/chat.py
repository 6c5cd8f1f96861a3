"""Chat formatting that is proved by a grammar round trip.

A turn is rendered by itself: a user's as `[INST] text [/INST]`, an assistant's as ` text </s>`, any other role's as
`<< role >> text </s>`. Inside texts and roles a backslash stands behind the first character of each control string,
overlapping ones as well, so that no control string occurs there at all; a strict deterministic parser, which ends a text at
the first control string, reads the rendered turn back. If role, text or end differ from the source, as where the text
holds backslashes of its own, these are doubled as well, and the turn is read again. The
template marks assistant texts as the loss mask. Turns need nothing of each other, so a conversation of any length is
formatted row by row; its output is the segments in order, and no task holds a whole conversation.

Digests read the output of a whole conversation back: segments are joined as they come, sorted by conversation, and the
parser alone decides where a turn ends. What it has read is let go, so memory is bounded by a turn.

Cases: null texts and roles are empty; a null conversation id is a conversation; rows of one turn are ordered by role
and text. Repeated rows are turns of their own. No rows: no rows. Texts of any length are taken whole. Segments have the
other columns; helper columns are named __chat_*, and a column of such a name is replaced.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftscope.llm._cluster import ship

#: Fixed strings of the template. Inside texts the escape stands behind their first character, and before itself.
CONTROLS = ("[INST]", "[/INST]", "</s>", "<<", ">>")
ESCAPE = "\\"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
#: The first character of a control string; the next match may begin within it.
_BEGINS = re.compile(f"(?={_CONTROL.pattern})(.)", re.DOTALL)
_ESCAPED = re.compile(re.escape(ESCAPE) + f"({re.escape(ESCAPE)}?)")


def _broken(text: str) -> str:
    return _BEGINS.sub(lambda m: m[1] + ESCAPE, text)


def _doubled(text: str) -> str:
    return _broken(text.replace(ESCAPE, 2 * ESCAPE))


def unescape(text: str) -> str:
    """text without its escapes: two of them are one character of the text, one by itself is none."""
    return _ESCAPED.sub(lambda m: m[1], text)


def _control(text: str, start: int) -> tuple[str, int]:
    """The first control string from start on, and its place; ("", -1) if none."""
    m = _CONTROL.search(text, start)
    return (m[0], m.start()) if m else ("", -1)


def parse(output: str, start: int = 0) -> tuple[str, int, int, int] | None:
    """(role, first and end place of the text, end of the turn) of the turn that starts at start; None if none does.

    The text ends at the first control string, which must be the one that closes the turn.
    """
    if output.startswith("[INST] ", start):
        role, first, close = "user", start + 7, "[/INST]"
    elif output.startswith("<< ", start):
        control, end = _control(output, start + 3)
        if control != ">>" or end < start + 4 or output[end - 1] != " " or not output.startswith(" ", end + 2):
            return None
        role, first, close = unescape(output[start + 3 : end - 1]), end + 3, "</s>"
    elif output.startswith(" ", start):
        role, first, close = "assistant", start + 1, "</s>"
    else:
        return None
    control, end = _control(output, first)
    if control != close or end < first + 1 or output[end - 1] != " ":
        return None
    return role, first, end - 1, end + len(close)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, first and end place of the text in it)"""
    for escape in (_broken, _doubled):
        escaped = escape(text)
        if role == "user":
            segment = f"[INST] {escaped} [/INST]"
        elif role == "assistant":
            segment = f" {escaped} </s>"
        else:
            segment = f"<< {_doubled(role)} >> {escaped} </s>"
        read = parse(segment)
        if read and read[0] == role and unescape(segment[read[1] : read[2]]) == text and read[3] == len(segment):
            return segment, read[1], read[2]
    raise ValueError("a turn that cannot be read back")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index
        roles, texts = (batch.column(at(f"__chat_{x}")).to_pylist() for x in ("role", "text"))
        made = [render(r, t) for r, t in zip(roles, texts, strict=True)]
        out = batch.set_column(at("__chat_segment"), "__chat_segment", pa.array([m[0] for m in made], pa.string()))
        out = out.set_column(at("__chat_from"), "__chat_from", pa.array([m[1] if r == "assistant" else 0 for m, r in zip(made, roles, strict=True)], pa.int64()))
        yield out.set_column(at("__chat_to"), "__chat_to", pa.array([m[2] if r == "assistant" else 0 for m, r in zip(made, roles, strict=True)], pa.int64()))


def segments(turns: DataFrame, *, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with __chat_segment and its loss mask, code points __chat_from to __chat_to (both 0: none)."""
    ship(turns.sparkSession)
    ready = turns.select(
        *[F.col(f"`{c}`") for c in turns.columns if not c.startswith("__chat_")],
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__chat_role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__chat_text"),
        F.lit("").alias("__chat_segment"),
        F.lit(0).cast("long").alias("__chat_from"),
        F.lit(0).cast("long").alias("__chat_to"),
    )
    return ready.mapInArrow(_render, ready.schema).drop("__chat_role", "__chat_text")


class Reader:
    """Reads a conversation's output back as it comes, and digests its turns and the text under its loss mask."""

    def __init__(self, conv: object):
        self.conv, self.n, self.loss, self.chars = conv, 0, 0, 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()
        self.unread = ""

    def add(self, segment: str, first: int, end: int) -> None:
        masked = unescape(segment[first:end])
        self.loss += len(masked)
        self.masked.update(masked.encode())
        self.chars += len(segment)
        self.unread = self.unread + segment if self.unread else segment
        at = 0
        while read := parse(self.unread, at):
            self.n += 1
            self.turns.update(f"{read[0]}\n{unescape(self.unread[read[1] : read[2]])}\n".encode())
            at = read[3]
        self.unread = self.unread[at:]

    def row(self) -> tuple:
        if self.unread:
            raise ValueError(f"conversation {self.conv} cannot be read back")
        return self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    now: Reader | None = None
    for batch in batches:
        conv_type, done = batch.schema.field(0).type, []
        for conv, segment, first, end in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now is None or now.conv != conv:
                done += [now.row()] if now else []
                now = Reader(conv)
            now.add(segment, first, end)
        if done:
            yield batch_of(done)
    if now:
        yield batch_of([now.row()])


def digests(formatted: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation, read back from the segments of segments()."""
    ordered = formatted.select(
        F.col(conv_col).alias("conv_id"),
        "__chat_segment",
        "__chat_from",
        "__chat_to",
        F.col(turn_col).alias("__chat_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__chat_r"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__chat_t"),
    )
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "__chat_turn", "__chat_r", "__chat_t")
    kind = formatted.schema[conv_col].dataType.simpleString()
    rows = ordered.select("conv_id", "__chat_segment", "__chat_from", "__chat_to")
    return rows.mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
