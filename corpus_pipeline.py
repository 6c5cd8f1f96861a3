"""The corpus pipeline: documents to mixed, shuffled shards in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of docs; the last one adds shard and
slot. Labels and the benchmark are read beside the documents. A document leaves if its quality score is below one
half, if it is a near duplicate of a kept one, or if a twentieth or more of its words are in benchmark phrases. The mix
then repeats or leaves out documents by their source's rate, and the shuffle places the rows.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftscope.llm import decontam, mixing, neardup, quality, sharding
from shiftscope.llm._cluster import aside, mark, release, shared_dir, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality score is one half or more. Null and empty texts are scored as any other, repeated rows alike."""
    docs, back = aside(docs, "__quality_")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.scored(docs, model).filter(F.col("__quality_score") >= 0.5).select(*back)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the rows of its smallest id and a text of the group. Texts without words, and rows
    without an id in groups without one, stay; rows that share an id are decided each by its text."""
    return neardup.deduplicate(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words is in benchmark phrases. Texts without words stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, twice at most; rows that share an id share their draw. A null source is one."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard (0 to 23) and slot (gapless from 0), copies and rows without an id among them."""
    return sharding.shard(docs, 24)


STAGES = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("decontam", decontam_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The discriminant and the signatures are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the written shards. A stage's table is deleted, with what its operator wrote, once the next one is written."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark(spark)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, start, (docs,))
    sharded = STAGES[-1][1](spark, docs, sf_dir)
    path = f"{shared_dir(spark)}/pipeline-shards-{uuid.uuid4().hex}"
    sharding.write_shards(sharded, path)
    release(spark, start)
    return spark.read.schema(sharded.schema).parquet(path).select(*sharded.columns)
