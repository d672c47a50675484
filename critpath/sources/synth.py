"""Generated traces: phases in which work passes down a pyramid of workers and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.schema import DATA_MESSAGE, END, PROCESSING, RECEIVED, RECORD_COLUMNS, SENT, START, WAITING

ORIGIN = 1_000_000_000_000_000


@dataclass(frozen=True)
class Pyramid:
    """Activities are codes, None leaves one out; phase is in ticks (ns)."""

    workers: int = 10
    phases: int = 1
    phase: int = 10_000_000
    activity: int | None = PROCESSING
    prefix: int | None = WAITING
    infix: int | None = PROCESSING
    suffix: int | None = WAITING
    send: int | None = DATA_MESSAGE
    receive: int | None = DATA_MESSAGE
    origin: int = ORIGIN


def pyramid(spark: SparkSession, shape: Pyramid) -> DataFrame:
    """A trace of worker-local activities (start and end) and messages (send and receive). Worker w hands work on to
    w + 1 one slot after it began, and gets it back one slot before it ends."""
    k, length = shape.workers, shape.phase
    slot = length // (4 * (k - 1) + 1)
    cells = spark.range(shape.phases * k).select(F.expr(f"id div {k}").alias("phase"), (F.col("id") % k).alias("w"))
    p = F.lit(shape.origin) + F.col("phase") * length
    q, w = p + length - 1, F.col("w")
    start, end = p + (2 * w - 1) * slot, q - (2 * w - 1) * slot
    ms, me = start + slot, end - slot
    none = F.lit(None).cast("long")

    def activity(place: int, kind: int | None, a: Column, b: Column, when: Column) -> list[Column]:
        if kind is None:
            return []
        one = lambda i, t, event: F.when(when, F.struct(F.lit(place + i).alias("place"), t.cast("long").alias("ts"), w.alias("local_worker"), F.lit(kind).alias("activity_type"), F.lit(event).alias("event_type"), none.alias("message"), none.alias("remote_worker"), w.alias("operator_id")))
        return [one(0, a, START), one(1, b, END)]

    def message(place: int, kind: int | None, a: Column, sender: Column, b: Column, receiver: Column, number: int) -> list[Column]:
        if kind is None:
            return []
        one = lambda i, t, own, other, event: F.when(w > 0, F.struct(F.lit(place + i).alias("place"), t.cast("long").alias("ts"), own.cast("long").alias("local_worker"), F.lit(kind).alias("activity_type"), F.lit(event).alias("event_type"), (w * 2 + number).cast("long").alias("message"), other.cast("long").alias("remote_worker"), none.alias("operator_id")))
        return [one(0, a, sender, receiver, SENT), one(1, b, receiver, sender, RECEIVED)]

    inner, leaf, root = (w > 0) & (w < k - 1), (w == k - 1) & (w > 0), w == 0
    several = F.lit(k > 1)
    records = [
        *activity(0, shape.prefix, p, ms, w > 0), *message(2, shape.send, start, w - 1, ms, w, 0),
        *activity(4, shape.activity, ms, ms + slot, inner), *activity(6, shape.infix, ms + slot, me - slot, inner), *activity(8, shape.activity, me - slot, me, inner),
        *activity(4, shape.activity, ms, me, leaf), *message(10, shape.receive, me, w, end, w - 1, 1), *activity(12, shape.suffix, me, q, w > 0),
        *activity(0, shape.activity, p, p + slot, root & several), *activity(2, shape.infix, p + slot, q - slot, root & several), *activity(4, shape.activity, q - slot, q, root & several),
        *activity(0, shape.activity, p, q, root & ~several),
    ]
    rows = cells.select("phase", "w", F.explode(F.filter(F.array(*records), lambda x: x.isNotNull())).alias("r")).select("phase", "w", "r.*")
    # workers 1 to k - 1 are written first, then worker 0; within a phase the order is by time
    order = W.partitionBy("phase").orderBy("ts", F.when(F.col("w") == 0, F.lit(1 << 40)).otherwise(F.col("w")), "place")
    seq = F.col("phase") * (16 * k) + F.row_number().over(order)
    return rows.withColumns({"seq": seq, "correlator_id": F.col("phase") * (2 * k) + F.col("message")}).select(*RECORD_COLUMNS)
