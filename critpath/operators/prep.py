"""Operators on plain traces: epochs, message delays, correlators, workers, tickets for data quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.schema import CONTROL_MESSAGE, DATA_MESSAGE, END, RECEIVED, SENT, START

IN_ORDER = ("ts", "seq")


def with_epoch(trace: DataFrame, window: int) -> DataFrame:
    """epoch: the tumbling window of a record."""
    return trace.withColumn("epoch", F.expr(f"ts div {int(window)}"))


def workers(trace: DataFrame) -> DataFrame:
    return trace.select(F.col("local_worker").alias("worker")).distinct()


def communication(trace: DataFrame) -> DataFrame:
    """Messages only."""
    return trace.filter(F.col("activity_type").isin(CONTROL_MESSAGE, DATA_MESSAGE))


def sender() -> Column:
    """The sending worker of a message record; any other event is an error."""
    return F.when(F.col("event_type") == SENT, F.col("local_worker")).when(F.col("event_type") == RECEIVED, F.col("remote_worker")).otherwise(F.raise_error(F.lit("a message record is neither Sent nor Received")).cast("long"))


def clip_message_delay(trace: DataFrame, delay: int | None) -> DataFrame:
    """Receives that are more than delay away from their send are moved to send + delay.

    Of several sends of one key the last in the trace counts, and its first receive alone is moved. One window over
    each key of (sender, receiver, correlator); records that aren't messages don't pass through it.
    """
    if delay is None:
        return trace
    is_message = F.col("event_type").isin(SENT, RECEIVED)
    sent = F.col("event_type") == SENT
    a = F.when(sent, F.col("local_worker")).otherwise(F.col("remote_worker"))
    b = F.when(sent, F.col("remote_worker")).otherwise(F.col("local_worker"))
    # null correlators match each other: all such messages between two workers are one key, as the matching asks for
    key = ["_from", "_to", "correlator_id"]
    so_far = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    marked = trace.filter(is_message).withColumns({"_from": a, "_to": b})
    last = F.last(F.when(sent, F.struct("seq", "ts")), ignorenulls=True).over(so_far)
    earlier = F.last(F.when(~sent, F.col("seq")), ignorenulls=True).over(so_far)
    moved = marked.withColumns({"_sent": last, "_before": earlier}).withColumn(
        "ts",
        F.when(~sent & F.col("_sent").isNotNull() & (F.col("_before").isNull() | (F.col("_before") < F.col("_sent.seq"))) & (F.abs(F.col("ts") - F.col("_sent.ts")) > delay), F.col("_sent.ts") + delay).otherwise(F.col("ts")),
    )
    return trace.filter(~is_message).unionByName(moved.select(*trace.columns))


def infer_correlators(trace: DataFrame) -> DataFrame:
    """Local records without correlator get one: Start and End of one activity share the Start's.

    Pairs nest per (worker, activity), so the Start of an End is the last Start at the same depth. The id is
    the seq of the Start, which is unique in the trace. Records with an id stay as they are.
    """
    own = F.col("event_type").isin(START, END) & F.col("correlator_id").isNull()
    per = W.partitionBy("local_worker", "activity_type").orderBy(*IN_ORDER)
    step = F.when(F.col("event_type") == START, 1).otherwise(-1)
    depth = F.sum(step).over(per.rowsBetween(W.unboundedPreceding, 0))
    level = F.when(F.col("event_type") == START, F.col("_depth")).otherwise(F.col("_depth") + 1)
    at = W.partitionBy("local_worker", "activity_type", "_level").orderBy(*IN_ORDER).rowsBetween(W.unboundedPreceding, 0)
    start = F.last(F.when(F.col("event_type") == START, F.col("seq")), ignorenulls=True).over(at)
    named = trace.filter(own).withColumn("_depth", depth).withColumn("_level", level).withColumn("correlator_id", start)
    return trace.filter(~own).unionByName(named.select(*trace.columns))


def count_by_epoch(rows: DataFrame, name: str = "n") -> DataFrame:
    return rows.groupBy("epoch").agg(F.count("*").alias(name))


def double_starts(trace: DataFrame) -> DataFrame:
    """Records of a (worker, activity) that start twice or end without a start: depth leaves 0 and 1."""
    found = activity_depth(trace)
    return found.filter((F.col("depth") > 1) | (F.col("depth") < 0))


def activity_depth(trace: DataFrame) -> DataFrame:
    """Local records with the number of open activities of their (worker, activity)."""
    local = trace.filter(F.col("event_type").isin(START, END))
    step = F.when(F.col("event_type") == START, 1).otherwise(-1)
    per = W.partitionBy("local_worker", "activity_type").orderBy(*IN_ORDER).rowsBetween(W.unboundedPreceding, 0)
    return local.withColumn("depth", F.sum(step).over(per))


def underflows(trace: DataFrame) -> DataFrame:
    """Records at which an activity ends more often than it started."""
    return activity_depth(trace).filter("depth < 0")


def nesting(trace: DataFrame) -> DataFrame:
    """worker, max_depth, misnested: how deep activities nest over all types, and Ends that aren't of the innermost one.

    Depths by window; a worker that has any misnested End is reported so, its depth follows the count of open activities.
    """
    local = trace.filter(F.col("event_type").isin(START, END))
    is_start = F.col("event_type") == START
    order = W.partitionBy("local_worker").orderBy(*IN_ORDER)
    depth = F.sum(F.when(is_start, 1).otherwise(-1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    found = local.withColumn("_depth", depth).withColumn("_level", F.when(is_start, F.col("_depth")).otherwise(F.col("_depth") + 1))
    at = W.partitionBy("local_worker", "_level").orderBy(*IN_ORDER)
    top = F.last(F.when(is_start, F.col("activity_type")), ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, -1))
    wrong = ~is_start & (top.isNull() | (top != F.col("activity_type")))
    return found.withColumn("_wrong", wrong).groupBy(F.col("local_worker").alias("worker")).agg(F.max("_depth").cast("long").alias("max_depth"), F.sum(F.col("_wrong").cast("long")).alias("misnested"))
