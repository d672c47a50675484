"""Summaries of a running trace: each epoch is analysed once the watermark has passed its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from critpath.config import Config
from critpath.plans.pipeline import Analysis
from critpath.schema import RECORD_COLUMNS


def closed_epochs(stream: DataFrame, window: int, ticks_per_us: int, delay: str = "0 seconds") -> DataFrame:
    """The records of an epoch and worker in one row each, emitted when the epoch is closed; later records are dropped.

    The state is grouped by epoch and worker, and is freed when its epoch closes. The window must be whole microseconds.
    """
    if window % ticks_per_us:
        raise ValueError("a window of whole microseconds is needed")
    at = F.timestamp_micros(F.expr(f"ts div {int(ticks_per_us)}"))
    record = F.struct(*RECORD_COLUMNS)
    timed = stream.withColumn("event_time", at).withWatermark("event_time", delay)
    return timed.groupBy(F.window("event_time", f"{window // ticks_per_us} microseconds").alias("w"), "local_worker").agg(F.collect_list(record).alias("records"))


class Progress(StreamingQueryListener):
    """Rows (batch, watermark, input rows, seconds, finished) of a query's micro-batches: how far epochs are closed and how
    long that took. Register it with spark.streams.addListener."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, str | None, int, float]] = []
        self.ended = False

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.rows.append((p.batchId, p.eventTime.get("watermark"), p.numInputRows, p.durationMs.get("triggerExecution", 0) / 1000))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended = True


def analyse_stream(stream: DataFrame, config: Config, ticks_per_us: int, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "0 seconds", what: Callable[[Analysis], DataFrame] = lambda a: a.summaries, trigger: dict | None = None) -> StreamingQuery:
    """Run the batch plan on the epochs that each micro-batch closes, and give its result to sink(df, batch_id).

    Epochs don't depend on each other (messages between them are cut), so nothing is kept across batches. Message
    delays are matched over the whole trace and can't be clipped in a stream.
    """
    if config.message_delay is not None:
        raise ValueError("message_delay needs the whole trace")
    closed = closed_epochs(stream, config.window, ticks_per_us, delay)

    def each(batch: DataFrame, number: int) -> None:
        trace = batch.select(F.explode("records").alias("r")).select("r.*").persist()
        try:
            sink(what(Analysis.of(trace, config)), number)
        finally:
            trace.unpersist()

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(**trigger) if trigger else writer).start()
