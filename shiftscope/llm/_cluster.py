"""Where intermediate tables go, and when a side is small enough to broadcast."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftscope.session import mark, release, shared_dir, ship, written

__all__ = ["BROADCAST_BYTES", "aside", "mark", "release", "shared_dir", "ship", "small_side", "written"]

#: A side is broadcast up to this many bytes; larger ones are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: What a row takes in a hash table besides its strings.
ROW_BYTES = 48


def small_side(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint for a written table, if its rows, strings and binaries counted, take `most` bytes at most."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.BinaryType)]
    fixed = ROW_BYTES + 8 * len(df.columns)
    own = sum(texts, F.lit(fixed)).cast("long")
    size = df.agg(F.coalesce(F.sum(own), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most else df


def aside(docs: DataFrame, prefix: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns that are named as helper columns under other names, and the columns that give back docs."""
    names = {c: f"kept_{i}{c}" for i, c in enumerate(docs.columns) if c.startswith(prefix)}
    return docs.withColumnsRenamed(names), [F.col(f"`{names.get(c, c)}`").alias(c) for c in docs.columns]
