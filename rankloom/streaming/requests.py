"""A stream of search requests answered from stored or static index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.search import SearchIndex, accepted, answer, items, rejected, validate
from rankloom.runtime import materialize, scratch
from rankloom.schema import REQUESTS

# How long the id of an answered request is remembered.
REMEMBER = "1 day"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """JSON request files as a stream; the number of files per batch bounds a batch."""
    return (
        spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def once_each(stream: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """Of the requests with one id only the first, in whatever batch the others come.

    The ids are the state of the stream, kept for `remember` after their arrival. Requests
    without an id cannot be told apart by it; equal ones are reported once.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in stream.columns]
    own = F.when(F.col("request_id").isNull(), F.sha2(F.concat_ws("\x01", *cells), 256)).otherwise("")
    marked = stream.withColumns({"_received": F.current_timestamp(), "_own": own})
    return (
        marked.withWatermark("_received", remember)
        .dropDuplicatesWithinWatermark(["request_id", "_own"])
        .drop("_received", "_own")
    )


def answer_batch(batch: DataFrame, batch_id: int, index: SearchIndex, out: str) -> None:
    """Answer one micro-batch. A batch that runs again replaces its own output."""
    with scratch(batch.sparkSession):
        # The batch is read once: reading it again would run the stream's state again.
        asked = materialize(batch, "asked")
        if asked.isEmpty():
            return
        checked = materialize(validate(asked, index.options, index.ready), "batch")
        rejected(checked).write.mode("overwrite").parquet(f"{out}/rejected/batch_id={batch_id}")
        ranked = answer(accepted(checked), index)
        rows = items(ranked, index.catalog, index.options)
        rows.write.mode("overwrite").parquet(f"{out}/answers/batch_id={batch_id}")


def serve(
    stream: DataFrame,
    index: SearchIndex | Callable[[], SearchIndex],
    out: str,
    checkpoint: str,
    once: bool = False,
    remember: str = REMEMBER,
) -> StreamingQuery:
    """Start the query. `once` answers what is there and stops. Every id is answered once. An
    index given as a function is resolved anew in every micro-batch, so that a new version is
    taken up between batches and never within one."""

    def each(batch: DataFrame, batch_id: int) -> None:
        answer_batch(batch, batch_id, index() if callable(index) else index, out)

    writer = (
        once_each(stream, remember)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(each)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
