"""Traces from ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.schema import BUFFER, CONTROL_MESSAGE, DATA_MESSAGE, END, PROCESSING, RECEIVED, RECORD_COLUMNS, SCHEDULING, SENT, SERIALIZATION, START

#: One hour, one minute and ten seconds in ticks of a microsecond.
HOUR, MINUTE, TEN_SECONDS = 3_600_000_000, 60_000_000, 10_000_000


def from_events(events: DataFrame, workers: int = 8, operators: int = 16) -> DataFrame:
    """A trace in microseconds from an events table (event_id, ts, user_id, event_type, value).

    Errors are messages from a user's worker to the next one, as slow as their value says; all others start and end an
    activity of their worker in turn.
    """
    base = events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("user_id") % workers).alias("w"), (F.col("user_id") % operators).alias("op"), "event_type", "value")
    none = F.lit(None).cast("long")
    is_error = F.col("event_type") == "error"
    order = W.partitionBy("w", is_error).orderBy("ts", "event_id")
    own = F.when(F.col("event_type") == "view", PROCESSING).when(F.col("event_type") == "click", BUFFER).when(F.col("event_type") == "purchase", SERIALIZATION).otherwise(SCHEDULING)
    rows = base.filter("event_type is not null").withColumn("activity", own).withColumns({"n": F.row_number().over(order), "before": F.lag(F.struct("activity", "op")).over(order)})
    kinds = {"seq": "long", "ts": "long", "local_worker": "long", "activity_type": "int", "event_type": "int", "correlator_id": "long", "remote_worker": "long", "operator_id": "long"}
    record = lambda **v: F.struct(*(v[n].cast(t).alias(n) for n, t in kinds.items()))
    next_worker = (F.col("w") + 1) % workers
    kind = F.when(F.col("value") < 5, CONTROL_MESSAGE).otherwise(DATA_MESSAGE)
    arrives = F.col("ts") + (F.floor(F.col("value") * 10) + 1) * 1_000_000
    sent = record(seq=F.col("event_id") * 2, ts=F.col("ts"), local_worker=F.col("w"), activity_type=kind, event_type=F.lit(SENT), correlator_id=F.col("event_id"), remote_worker=next_worker, operator_id=none)
    received = record(seq=F.col("event_id") * 2 + 1, ts=arrives, local_worker=next_worker, activity_type=kind, event_type=F.lit(RECEIVED), correlator_id=F.col("event_id"), remote_worker=F.col("w"), operator_id=none)
    odd = F.col("n") % 2 == 1
    of = lambda name, now: F.when(odd, F.col(now)).otherwise(F.col(f"before.{name}"))
    activity = record(seq=F.col("event_id") * 2, ts=F.col("ts"), local_worker=F.col("w"), activity_type=of("activity", "activity"), event_type=F.when(odd, START).otherwise(END), correlator_id=none, remote_worker=none, operator_id=of("op", "op"))
    found = F.when(is_error, F.array(sent, received)).otherwise(F.array(activity))
    return rows.select(F.explode(found).alias("e")).select("e.*").select(*RECORD_COLUMNS)
