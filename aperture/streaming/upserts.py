"""An extension: streams of score rows kept current by block upserts, and windowed counts of late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aperture.sources.sinks import merge_on_write


def upsert_stream(stream: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Every micro-batch replaces the blocks of its keys; a batch that runs again gives the same table."""
    return stream.writeStream.foreachBatch(lambda df, _: merge_on_write(df, path, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
