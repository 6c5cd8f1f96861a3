"""Labelled samples of bounded size."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows a model is fitted on, in expectation. Below that all are taken.
MAX_LABELLED = 20_000


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def thinned(rows: DataFrame, id_col: str, most: int, seed: int = 31) -> DataFrame:
    """About `most` of the rows, drawn by a hash of the id; all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 62)) < F.lit(int(most / n * (1 << 62))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, id_col: str = "doc_id", text_col: str = "text", modulus: int, held_out: int, most: int = MAX_LABELLED) -> DataFrame:
    """(text, label) of a bounded sample of the labelled documents outside the held-out fold. Other columns stay out."""
    rows = labels.select(id_col, F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(id_col, modulus) != held_out))
    own = F.broadcast(thinned(rows, id_col, most))
    return docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(own, id_col).select("text", "label")
