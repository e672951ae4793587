"""Streams of new files: each file once, the gate on availability, nearest events as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from tidegate.functions.expressions import hours_between
from tidegate.operators.gate import as_of


def new_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes what files there are, appends the rows, and remembers the files: a second run reads only new ones."""
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).format("parquet").outputMode("append").start(target).awaitTermination()


def gated(stream: DataFrame, index: DataFrame) -> DataFrame:
    """The gate on a stream: availability decides, so that a late arrival passes exactly if it was available at t0."""
    return as_of(stream, index)


def nearest(stream: DataFrame, index: DataFrame) -> DataFrame:
    """entity_id, source, gap_h: state is one value for each entity and source."""
    j = stream.join(index.select("entity_id", "t0"), "entity_id").withColumn("gap", hours_between("t0", "t_event"))
    return j.groupBy("entity_id", F.col("domain").alias("source")).agg(F.min_by("gap", F.struct(F.abs("gap").alias("a"), F.col("gap").alias("g"))).alias("gap_h"))


def kept(result: DataFrame, target: str, checkpoint: str) -> None:
    """Runs an aggregation over what files there are: its state stays in the checkpoint, from which the next run goes on, and its whole
    result replaces the table at target, written by the executors."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    result.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(write).outputMode("complete").start().awaitTermination()
