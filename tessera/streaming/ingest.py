"""Incremental ingestion: samples arrive as files, are kept once, and give graphs in small batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.graph import edges_of, facts, nodes_of
from tessera.sources.tables import scratch, settle


def stream_sections(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


def keep_new(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; state older than that is dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def write_graphs(stream: DataFrame, out: str, checkpoint: str, doc: str = "doc"):
    """Graphs of each batch under out/nodes and out/edges by batch; a repeated batch overwrites its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        with scratch():
            graphs = settle(facts(batch, doc), "facts", 8 << 20)
            nodes_of(graphs).write.mode("overwrite").parquet(f"{out}/nodes/batch={number}")
            edges_of(graphs).write.mode("overwrite").parquet(f"{out}/edges/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
