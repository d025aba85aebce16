"""New recordings as they arrive: a file stream, a recording at a time, into the processed tracks and the window index."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import Shape, window_index
from ..plans.workloads import processed_tracks
from ..sources.canonical import canonical


def process_new(spark: SparkSession, source: str, tracks_out: str, index_out: str, checkpoint: str, source_hz: float, shape: Shape = Shape()) -> StreamingQuery:
    """Everything that has arrived under source (Parquet with source_file and dataset_name, whole recordings per file), then stop.

    Windows look ahead within a track, so a recording is the unit: files seen before are not read again. A batch's output
    goes to folders of its own number, so that a batch repeated after a failure replaces itself.
    """
    schema = spark.read.parquet(source).schema

    def write(batch, number):
        processed = processed_tracks(canonical(batch), source_hz, shape)
        processed.write.mode("overwrite").parquet(f"{tracks_out}/batch={number}")
        stored = spark.read.parquet(f"{tracks_out}/batch={number}")
        window_index(stored, source_hz, shape).write.mode("overwrite").parquet(f"{index_out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
