"""Labelling streams: a model's projection keeps no state, so it holds for a streaming DataFrame as it stands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Model


def labelled_stream(model: Model, stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the labelled rows of a stream to a Parquet folder, exactly once each."""
    writer = model.assign(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
