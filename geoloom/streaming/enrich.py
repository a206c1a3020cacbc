"""Streams of points located against static place tables: stateless stream-static joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geoloom.operators.grid import points_in_boxes
from geoloom.operators.reverse import reverse


def containing_places(points: DataFrame, places: DataFrame) -> DataFrame:
    """All places around each streamed point (point_id, p_lat, p_lon); needs no state, so it runs in append mode."""
    return points_in_boxes(points, places)


def counts_by_place(points: DataFrame, places: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window, gers_id, n): points of each place in tumbling windows, late ones up to the watermark."""
    return containing_places(points.withWatermark(time, late), places).groupBy(F.window(time, window), "gers_id").agg(F.count(F.lit(1)).alias("n"))


def reverse_stream(points: DataFrame, places: DataFrame, sink_path: str, checkpoint: str) -> StreamingQuery:
    """Reverse-geocode each micro-batch in full (ranking needs the batch) and append it to Parquet; a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        reverse(batch, places).write.mode("overwrite").parquet(f"{sink_path}/batch={epoch}")

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
