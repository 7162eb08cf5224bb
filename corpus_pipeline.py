"""A corpus pipeline of five stages; each one's result is written as Parquet and read again as the next one's input.

quality: documents that the classifier rejects go. near_duplicates: one document of each group stays. decontaminate:
documents that hold a benchmark window go. mix: documents are repeated by their source's rate. shard: documents get a shard
and a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, neardup, quality, sharding
from tessera.llm.common import read
from tessera.sources.tables import settled


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= quality.CUT).drop("score")


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.first_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return out.where("n_hit = 0").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit(mixing.mix(docs)).select(docs.columns)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs).select(*docs.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_first),
    ("decontaminate", keep_uncontaminated),
    ("mix", mix_sources),
    ("shard", place),
]

#: The classifier has no SQL; tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)  # a stage's own tables go when its result is written
    return docs
