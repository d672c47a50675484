"""The trace and graph schemas, and the names of activities and events (fixed values of the trace format)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The codes of the trace format.
INPUT, BUFFER, SCHEDULING, PROCESSING, BARRIER_PROCESSING = 1, 2, 3, 4, 5
SERIALIZATION, DESERIALIZATION, FAULT_TOLERANCE, CONTROL_MESSAGE, DATA_MESSAGE = 6, 7, 8, 9, 10
UNKNOWN, WAITING, BUSY_WAITING = 11, 12, 13
START, END, SENT, RECEIVED, BOGUS = 1, 2, 3, 4, 5
ACTIVITIES = {
    1: "Input", 2: "Buffer", 3: "Scheduling", 4: "Processing", 5: "BarrierProcessing", 6: "Serialization", 7: "Deserialization",
    8: "FaultTolerance", 9: "ControlMessage", 10: "DataMessage", 11: "Unknown", 12: "Waiting", 13: "BusyWaiting",
}
EVENTS = {1: "Start", 2: "End", 3: "Sent", 4: "Received", 5: "Bogus"}
#: Activities that cross workers.
REMOTE_ACTIVITIES = (FAULT_TOLERANCE, CONTROL_MESSAGE, DATA_MESSAGE)
BLOCK, UNBOUNDED = "Block", "Unbounded"

#: One trace record. Times are ticks of any unit; u32 and u64 values are longs; seq is the place in the trace and breaks ties.
RECORD = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("ts", T.LongType(), False),
    T.StructField("local_worker", T.LongType(), False),
    T.StructField("activity_type", T.IntegerType(), False),
    T.StructField("event_type", T.IntegerType(), False),
    T.StructField("correlator_id", T.LongType(), True),
    T.StructField("remote_worker", T.LongType(), True),
    T.StructField("operator_id", T.LongType(), True),
])
RECORD_COLUMNS = RECORD.fieldNames()
#: One row of the program activity graph: kind is START (into dst), END (out of src) or EDGE.
PAG_COLUMNS = ["epoch", "kind", "src_ts", "src_worker", "dst_ts", "dst_worker", "edge_type", "operator_id", "traverse"]


def is_worker_local(activity: Column | str) -> Column:
    return ~(F.col(activity) if isinstance(activity, str) else activity).isin(*REMOTE_ACTIVITIES)


def named(code: Column, names: dict[int, str]) -> Column:
    """The name of a code, null for an unknown one."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), code)


def activity_code(name: str) -> int | None:
    """The code of an activity's name; None for 'None'; anything else is an error."""
    if name == "None":
        return None
    return {v: k for k, v in ACTIVITIES.items()}[name]
