"""An addition of this engine: a stream of operations kept as a log, and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import OPS, Store


def read(spark, folder: str) -> DataFrame:
    """A stream of operation files that arrive in a folder."""
    return spark.readStream.schema(OPS).parquet(folder)


def ingest(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch as one transaction; a batch that was written before a failure is not written again."""
    done: set[int] = set()

    def write(batch: DataFrame, number: int) -> None:
        mark = ["__meta", "stream", checkpoint.replace("/", "_")]
        last = store.get(mark)
        if number in done or (last is not None and int(last) >= number):
            return
        marked = batch.select("path", "value", "seq", "is_delete").unionAll(batch.sparkSession.createDataFrame([(mark, str(number), 0, False)], "path array<string>, value string, seq int, is_delete boolean"))
        store.append(marked.withColumn("seq", F.coalesce("seq", F.lit(0))))
        done.add(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
