"""Keeping a chunk index up to date from a stream of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunks


def index_stream(files: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Appends the chunks of every file that arrives to a Parquet index, each file once; runs until what is there is done."""
    return chunks.line_chunks(files).writeStream.format("parquet").option("path", index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
