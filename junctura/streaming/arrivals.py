"""Vertices of genomes that arrive over time: each micro-batch's state is kept, and states merge.

A batch is cut into k-mers and aggregated by itself; its state goes to a folder named by the batch, which a
repeated batch overwrites, so every sequence counts once. The whole graph's vertices are the merged states;
compact() replaces many small states by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from junctura.operators import junctions, windows

_STATE = "ck string, n long, ins int, in_n long, outs int, out_n long, batch long"


def start(sequences: DataFrame, k: int, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a query over a streaming table of sequences (seq_id, seq); `trigger` is that of writeStream."""
    windows.check_k(k)

    def add(batch: DataFrame, number: int) -> None:
        found = windows.canonical(windows.definite(windows.kmers(batch, k)))
        junctions.vertex_state(found).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = sequences.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def state(spark: SparkSession, folder: str) -> DataFrame:
    return junctions.merged_state(spark.read.schema(_STATE).parquet(folder))


def vertices(spark: SparkSession, folder: str) -> DataFrame:
    """ck, n, in_degree and out_degree over all that has arrived."""
    return junctions.degrees(state(spark, folder))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Writes the merged state of `folder` as the first batch of another folder."""
    state(spark, folder).write.mode("overwrite").parquet(f"{into}/batch=-1")
