"""Message pairing: edges between workers, and half-edges where the other end lies in another epoch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.operators.prep import communication, sender
from critpath.schema import CONTROL_MESSAGE, DATA_MESSAGE, RECEIVED, SENT


@dataclass
class Paired:
    """edges: epoch, status (matched, send, receive), src_ts, src_worker, dst_ts, dst_worker, edge_type, operator_id;
    halves: records that stand for the missing ends on the other worker's timeline."""

    edges: DataFrame
    halves: DataFrame


def bounds(window: int) -> tuple[Column, Column]:
    """First and last tick of an epoch's slice."""
    return F.col("epoch") * window - 1, (F.col("epoch") + 1) * window


_END = ("ts", "seq", "local_worker", "remote_worker", "activity_type", "operator_id", "correlator_id")


def sided(trace: DataFrame, start: int = SENT, end_event: int = RECEIVED) -> DataFrame:
    """Every send and receive (or any other two events) with its key's ends: epoch, own, s (the key's first send in the
    epoch), r (own, if it is a receive), lone (the first send of a key that has no receive). Keys are (epoch, sender,
    correlator); null correlators match. Both ends of a key meet in one window, so there is one shuffle and no join.
    """
    end = F.struct(*_END)
    is_sent, is_received = F.col("event_type") == start, F.col("event_type") == end_event
    key = W.partitionBy("epoch", "sender", "correlator_id")
    rows = communication(trace).withColumn("sender", sender()).withColumns({"own": end, "s": F.min(F.when(is_sent, end)).over(key), "any": F.max(is_received).over(key)})
    lone = is_sent & ~F.col("any") & (F.col("own.ts") == F.col("s.ts")) & (F.col("own.seq") == F.col("s.seq"))
    return rows.select("epoch", "event_type", "own", "s", F.when(is_received, F.col("own")).alias("r"), lone.alias("lone"))


def outer(trace: DataFrame, start: int = SENT, end_event: int = RECEIVED) -> DataFrame:
    """Sends and receives (or any other two events) of each epoch side by side (s, r): a row for each receive, and one
    for a send that has none. Of several sends with one key in an epoch, the first counts (duplicate_sends has the others).
    """
    return sided(trace, start, end_event).filter(F.col("r").isNotNull() | F.col("lone")).select("epoch", "s", "r")


def _checked(both: DataFrame, strict: bool, check: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """both (s, r), where reading r is an error for a pair that fails."""
    fails = lambda wrong, text: both.withColumn("r", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit(text)).cast(both.schema["r"].dataType)).otherwise(F.col("r")))
    if check is not None:
        holds = F.col("s").isNull() | F.col("r").isNull() | F.coalesce(check(F.col("s"), F.col("r")), F.lit(False))
        both = fails(~holds, "a matched pair fails its check")
    if strict:
        wrong = (F.col("s.activity_type") != F.col("r.activity_type")) | (F.col("s.remote_worker") != F.col("r.local_worker")) | (F.col("s").isNull() & F.col("r.remote_worker").isNull())
        both = fails(wrong, "the two ends of a message differ")
    return both


def pair(trace: DataFrame, window: int, strict: bool = False, check: Callable[[Column, Column], Column] | None = None) -> Paired:
    """Edges of matched messages and of those that leave or enter an epoch; strict: bad pairs are errors; check(sent,
    received): what must hold for a matched pair besides."""
    low, high = bounds(window)
    both = _checked(outer(trace), strict, check)
    status = F.when(F.col("r").isNull(), "send").when(F.col("s").isNull(), "receive").otherwise("matched")
    rows = both.withColumn("status", status).filter((F.col("status") == "matched") | (F.col("s.remote_worker").isNotNull()) | F.col("r.remote_worker").isNotNull())
    known = F.coalesce("s", "r")
    edges = rows.select(
        "epoch", "status",
        F.coalesce("s.ts", low).alias("src_ts"),
        F.coalesce("s.local_worker", "r.remote_worker").alias("src_worker"),
        F.coalesce("r.ts", high).alias("dst_ts"),
        F.coalesce("r.local_worker", "s.remote_worker").alias("dst_worker"),
        known["activity_type"].alias("edge_type"),
        known["operator_id"].alias("operator_id"),
    )
    missing = rows.filter("status <> 'matched'").select(
        "epoch", known["seq"].alias("seq"),
        F.when(F.col("status") == "send", high).otherwise(low).alias("ts"),
        known["remote_worker"].alias("local_worker"),
        known["activity_type"].alias("activity_type"),
        F.when(F.col("status") == "send", SENT).otherwise(RECEIVED).alias("event_type"),
        known["correlator_id"].alias("correlator_id"),
        known["local_worker"].alias("remote_worker"),
        known["operator_id"].alias("operator_id"),
    )
    return Paired(edges, missing)


#: A record on its timeline: rank 0 for those of the trace, 1 for those that stand for a missing end; message is what arrives with it.
MESSAGE = "struct<src_ts:bigint,src_worker:bigint,edge_type:int,operator_id:bigint>"


def on_timelines(trace: DataFrame, window: int, strict: bool = False) -> DataFrame:
    """The records of all timelines (epoch, worker, ts, rank, seq, event_type, activity, operator_id, message), with what
    pair() gives: a message's edge goes along with the record at its receiving end, so that one shuffle by (epoch,
    worker) brings a timeline and the messages to it together. Only messages pass through the pairing."""
    low, high = bounds(window)
    local = trace.filter(~F.coalesce(F.col("activity_type").isin(CONTROL_MESSAGE, DATA_MESSAGE), F.lit(False)))
    rows = local.select("epoch", F.col("local_worker").alias("worker"), "ts", F.lit(0).alias("rank"), "seq", "event_type", F.col("activity_type").alias("activity"), "operator_id", F.lit(None).cast(MESSAGE).alias("message"))
    both = _checked(sided(trace), strict)
    own, received = F.col("own"), F.col("r").isNotNull()
    entering = received & F.col("s").isNull() & F.col("own.remote_worker").isNotNull()
    leaving = F.col("lone") & F.col("own.remote_worker").isNotNull()
    from_send = F.struct(F.col("s.ts").alias("src_ts"), F.col("s.local_worker").alias("src_worker"), F.col("s.activity_type").alias("edge_type"), F.col("s.operator_id").alias("operator_id")).cast(MESSAGE)
    from_bound = F.struct(low.alias("src_ts"), F.col("own.remote_worker").alias("src_worker"), F.col("own.activity_type").alias("edge_type"), F.col("own.operator_id").alias("operator_id")).cast(MESSAGE)
    arrived = F.when(received & F.col("s").isNotNull(), from_send).when(entering, from_bound)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    record = lambda worker, ts, rank, event, message: F.struct(*(v.cast(kinds[n]).alias(n) for n, v in (("worker", worker), ("ts", ts), ("rank", F.lit(rank)), ("seq", own["seq"]), ("event_type", event), ("activity", own["activity_type"]), ("operator_id", own["operator_id"]), ("message", message))))
    real = record(own["local_worker"], own["ts"], 0, F.col("event_type"), arrived)
    made = F.when(leaving, record(own["remote_worker"], high, 1, F.lit(SENT), from_send)).when(entering, record(own["remote_worker"], low, 1, F.lit(RECEIVED), F.lit(None)))
    ends = both.select("epoch", F.explode(F.filter(F.array(real, made), lambda x: x.isNotNull())).alias("e")).select("epoch", "e.*")
    return rows.unionByName(ends)


def duplicate_sends(trace: DataFrame) -> DataFrame:
    """epoch, sender, correlator_id, sends of keys that were sent more than once in an epoch."""
    sent = communication(trace).filter(F.col("event_type") == SENT)
    return sent.groupBy("epoch", F.col("local_worker").alias("sender"), "correlator_id").agg(F.count("*").alias("sends")).filter("sends > 1")


def mismatched(trace: DataFrame) -> DataFrame:
    """Matched messages whose ends differ in type or name another receiver."""
    return outer(trace).filter("s is not null and r is not null and (s.activity_type <> r.activity_type or s.remote_worker <> r.local_worker)")


def delay_histogram(trace: DataFrame, bucket: int) -> DataFrame:
    """bucket, messages: delays of correlators with exactly one Sent and one Received record, in buckets of ticks."""
    known = trace.filter("remote_worker is not null and correlator_id is not null")
    of = lambda e: F.max(F.when(F.col("event_type") == e, F.col("ts")))
    pairs = known.groupBy("correlator_id").agg(F.count("*").alias("n"), of(SENT).alias("s"), of(RECEIVED).alias("r")).filter("n = 2")
    return pairs.select(F.expr(f"(r - s) div {int(bucket)}").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("messages"))
