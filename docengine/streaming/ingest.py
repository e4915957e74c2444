"""An extension: files that arrive in a folder are ingested as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine

BINARY_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def ingest_stream(engine: Engine, collection: str, folder: str, checkpoint: str, once: bool = True, strict: bool = False) -> StreamingQuery:
    """Each batch of new files replaces the documents of their names.

    The stream remembers in ``checkpoint`` which files it has had; a batch that is repeated after a failure gives the
    same chunks, as documents are replaced as a whole. Where ``once``, the stream ends when all files there are in.
    """
    found = engine.spark.readStream.format("binaryFile").schema(BINARY_FILES).option("recursiveFileLookup", "true").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        engine.ingest_files(collection, batch.selectExpr("path", "path as name", "content"), strict=strict)

    writer = found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
