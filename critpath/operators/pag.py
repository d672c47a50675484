"""The program activity graph: timelines, messages and how paths may traverse them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.config import Config
from critpath.operators import messages, prep, timeline
from critpath.schema import BLOCK, PAG_COLUMNS, UNBOUNDED, WAITING


def annotated(edges: DataFrame, waiting_message: int = 0, worker: str = "dst_worker") -> DataFrame:
    """Adds traverse: waiting blocks, and so does a message that took longer than waiting_message unless the receiver
    was waiting for it. At one time a worker's own activity comes before a message. worker: a column like dst_worker, by
    which the rows may lie together already; rows without a dst_ts, and starts, come before all edges."""
    blocks = F.col("edge_type") == WAITING
    if waiting_message > 0:
        is_message = F.col("src_worker") != F.col("dst_worker")
        order = W.partitionBy("epoch", worker).orderBy("dst_ts", is_message, "src_ts", "edge_type")
        waited = F.coalesce(F.lag("edge_type").over(order) == WAITING, F.lit(False))
        blocks = blocks | (is_message & (F.abs(F.col("dst_ts") - F.col("src_ts")) > waiting_message) & ~waited)
    return edges.withColumn("traverse", F.when(blocks, BLOCK).otherwise(UNBOUNDED))


def construct(trace: DataFrame, config: Config) -> DataFrame:
    """The graph of all epochs (PAG_COLUMNS) from trace records: one pairing, one stack, one pass over neighbours.

    Messages and the ends of timelines travel with the records of the worker they arrive at, so the whole graph comes out
    of rows that lie together by (epoch, worker)."""
    trace = prep.with_epoch(prep.clip_message_delay(trace, config.message_delay), config.window)
    parts = timeline.pieces_of(messages.on_timelines(trace, config.window, config.strict), config.window, "window" if config.nested else "auto")
    rows = timeline.graph_rows(parts, config.window, config.threshold, config.insert_waiting)
    return annotated(rows, config.waiting_message, "worker").select(*PAG_COLUMNS)


def edges(pag: DataFrame) -> DataFrame:
    return pag.filter("kind = 'EDGE'")


def start_nodes(pag: DataFrame) -> DataFrame:
    return pag.filter("kind = 'START'")


def end_nodes(pag: DataFrame) -> DataFrame:
    return pag.filter("kind = 'END'")
