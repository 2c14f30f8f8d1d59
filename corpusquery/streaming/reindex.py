"""Documents that arrive as a stream: chunked and indexed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import sparse
from ..operators.chunking import chunk


def start(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """docs: a stream of (source, text). Each batch adds its chunks under path/chunks and a part of its own to the index under
    path/index; statistics are counted from the parts, so a batch costs what it holds. A batch that runs again replaces its
    own part, and readers see only parts that are whole."""

    def batch(rows: DataFrame, number: int) -> None:
        where = f"{path}/chunks/batch={number}"
        chunk(rows, **options).write.mode("overwrite").parquet(where)
        sparse.index(rows.sparkSession.read.parquet(where)).write(f"{path}/index", part=f"batch-{number:012d}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
