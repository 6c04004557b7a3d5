"""An extra beside the batch operators: chunk new documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.chunk import chunk_documents


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, key: str = "doc_id"):
    """Append the chunks of a streaming table of documents to out; restarts go on where they stopped."""
    chunks = chunk_documents(docs, key=key).withColumn("chunked_at", F.current_timestamp())
    return chunks.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
