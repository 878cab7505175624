"""A perpetual receive loop: images that arrive as files are analysed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.heuristics import Options
from spanloom.operators.metrics import run_summary


def receive(spark: SparkSession, source: str, sink: str, checkpoint: str, options: Options | None = None, once: bool = False) -> StreamingQuery:
    """Reads Parquet files of (image_id, bytes) as they appear below ``source``; appends summaries to ``sink``.

    Each micro-batch writes a folder named by its number, so a batch that is repeated after a failure
    replaces its own output and nothing is counted twice."""
    options = options or Options()

    def handle(batch: DataFrame, number: int) -> None:
        run_summary(batch, options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema("image_id long, bytes binary").parquet(source)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
