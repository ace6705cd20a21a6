"""Sheets as they arrive: a stream of span files, each micro-batch read by the same batch operators. An extension of the batch library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terracut.operators.elevations import CALLOUT, read_elevations

SPANS = "sheet_id string, seq long, text string, x double, y double, role string"


def arriving_spans(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(SPANS).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def stream_elevations(spans: DataFrame, sink: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Appends the callouts of each batch of whole sheets to Parquet in sink/batch=N; a batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        found = read_elevations(batch, F.col("role"))
        found.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if then is not None:
            then(batch.sparkSession.read.schema(CALLOUT).parquet(f"{sink}/batch={number}"), number)

    return spans.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
