"""Cluster event logs (one JSON object a line) as traces. Every file is one application; files convert in parallel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.schema import BUFFER, CONTROL_MESSAGE, DATA_MESSAGE, DESERIALIZATION, END, PROCESSING, RECEIVED, RECORD_COLUMNS, SCHEDULING, SENT, SERIALIZATION, START, WAITING

SCHEMA = """Event STRING, `Executor ID` STRING, `Executor Info` STRUCT<`Total Cores`: INT>,
 `Stage Info` STRUCT<`Stage ID`: INT, `Number of Tasks`: INT, `Parent IDs`: ARRAY<INT>, `Submission Time`: BIGINT, `Completion Time`: BIGINT>,
 `Stage ID` INT, `Task Info` STRUCT<`Executor ID`: STRING, `Launch Time`: BIGINT, `Finish Time`: BIGINT, `Getting Result Time`: BIGINT>,
 `Task Metrics` STRUCT<`Executor Deserialize Time`: BIGINT, `Executor Run Time`: BIGINT, `Result Serialization Time`: BIGINT,
  `Shuffle Read Metrics`: STRUCT<`Fetch Wait Time`: BIGINT>, `Shuffle Write Metrics`: STRUCT<`Shuffle Write Time`: BIGINT>>"""
NANOS = 1_000_000
DRIVER = 0


def events(spark: SparkSession, path: str) -> DataFrame:
    """app, pos (the line's place) and the fields of SCHEMA."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("app"), F.monotonically_increasing_id().alias("pos"), F.from_json("value", SCHEMA).alias("e"))
    return lines.select("app", "pos", "e.*")


def tasks(log: DataFrame) -> DataFrame:
    """Finished tasks with all times in ns and the derived durations."""
    info, m = F.col("`Task Info`"), F.col("`Task Metrics`")
    ms = lambda c: F.coalesce(c, F.lit(0)) * NANOS
    rows = log.filter("Event = 'SparkListenerTaskEnd'").select(
        "app", "pos", F.col("`Stage ID`").alias("stage"), info["Executor ID"].alias("executor"),
        ms(info["Launch Time"]).alias("launch"), ms(info["Finish Time"]).alias("finish"),
        F.when(info["Getting Result Time"] > 0, ms(info["Getting Result Time"])).alias("getting_result"),
        ms(m["Executor Deserialize Time"]).alias("deserialize"), ms(m["Executor Run Time"]).alias("run"), ms(m["Result Serialization Time"]).alias("serialize"),
        ms(m["Shuffle Read Metrics"]["Fetch Wait Time"]).alias("shuffle_read"), F.coalesce(m["Shuffle Write Metrics"]["Shuffle Write Time"], F.lit(0)).alias("shuffle_write"),
    )
    result = F.when(F.col("getting_result").isNotNull(), F.col("finish") - F.col("getting_result")).otherwise(F.lit(0))
    return rows.withColumns({"result_duration": result, "duration": F.col("deserialize") + F.col("run") + F.col("serialize")}).withColumns({
        "computing": F.greatest(F.lit(0), F.col("run") - F.col("shuffle_read") - F.col("shuffle_write")),
        "delay": F.col("finish") - F.col("launch") - F.col("duration") - F.col("result_duration"),
    })


def stages(log: DataFrame) -> DataFrame:
    """Completed stages with their batch: stages that were open together, numbered by when none was open."""
    info = F.col("`Stage Info`")
    submitted = F.col("Event") == "SparkListenerStageSubmitted"
    rows = log.filter("Event in ('SparkListenerStageSubmitted', 'SparkListenerStageCompleted')").select(
        "app", "pos", submitted.alias("submitted"), info["Stage ID"].alias("stage"), info["Number of Tasks"].alias("tasks"), info["Parent IDs"].alias("parents"),
        (info["Submission Time"] * NANOS).alias("submission"), (info["Completion Time"] * NANOS).alias("completion"),
    )
    order = W.partitionBy("app").orderBy("pos")
    open_ = rows.withColumn("open", F.sum(F.when(F.col("submitted"), 1).otherwise(-1)).over(order.rowsBetween(W.unboundedPreceding, 0)))
    batch = F.coalesce(F.sum(F.when(F.col("open") == 0, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return open_.withColumn("batch", batch).filter("not submitted").drop("submitted", "open")


def bad_stages(log: DataFrame) -> DataFrame:
    """Stages whose finished tasks aren't as many as the stage declared."""
    counts = tasks(log).groupBy("app", "stage").agg(F.count("*").alias("found"))
    return stages(log).join(counts, ["app", "stage"], "left").filter(F.coalesce("found", F.lit(0)) != F.col("tasks")).select("app", "stage", "tasks", "found")


def threads(log: DataFrame, default_cores: int | None = None) -> DataFrame:
    """app, executor, worker: a worker for each core in order of arrival, from 1. Executors that only tasks name get
    default_cores, or are an error."""
    added = log.filter("Event = 'SparkListenerExecutorAdded'").select("app", "pos", F.col("`Executor ID`").alias("executor"), F.col("`Executor Info`.`Total Cores`").alias("cores"))
    first = tasks(log).groupBy("app", "executor").agg(F.min("pos").alias("pos"))
    cores = F.lit(default_cores).cast("int") if default_cores else F.raise_error(F.concat(F.lit("a task of an unknown executor: "), F.col("executor"))).cast("int")
    unknown = first.join(added.select("app", "executor"), ["app", "executor"], "left_anti").select("app", "pos", "executor", cores.alias("cores"))
    every = added.unionByName(unknown).withColumn("core", F.explode(F.sequence(F.lit(1), F.col("cores"))))
    return every.select("app", "executor", F.row_number().over(W.partitionBy("app").orderBy("pos", "core")).cast("long").alias("worker"))


def scheduled(log: DataFrame, delay_split: float = 0.33, default_cores: int | None = None) -> DataFrame:
    """Tasks with start, stop and worker. A task starts after its share of the scheduler's delay, on the thread of its
    executor that became free last; of several the one added last. No free thread is an error."""
    if not 0 <= delay_split <= 1:
        raise ValueError("delay_split must be within 0 and 1")
    start = F.col("launch") + F.floor(F.lit(float(delay_split)) * F.col("delay"))
    rows = tasks(log).join(stages(log).select("app", "stage", "batch"), ["app", "stage"]).withColumn("start", start).withColumn("stop", F.col("start") + F.col("duration"))
    owned = threads(log, default_cores).groupBy("app", "executor").agg(F.sort_array(F.collect_list("worker")).alias("workers"))
    joined = rows.join(owned, ["app", "executor"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", worker long"
    names = [f.name for f in rows.schema.fields]

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["batch", "launch", "pos"], kind="stable")
        busy = {int(w): 0 for w in pdf["workers"].iloc[0]}
        found = []
        for begin, stop in zip(pdf["start"], pdf["stop"], strict=True):
            free = [(until, w) for w, until in busy.items() if until < begin]
            if not free:
                raise ValueError("tasks overlap on all threads of an executor, try a smaller delay_split")
            found.append(max(free)[1])
            busy[found[-1]] = stop
        out = pdf[names].assign(worker=found)
        out["getting_result"] = out["getting_result"].astype("Int64")
        return out

    return joined.groupBy("app", "executor").applyInPandas(assign, schema)


def driver_states(log: DataFrame) -> DataFrame:
    """app, begin, stop, activity, stage: what the driver did between its tasks' events, Scheduling between batches."""
    rows = tasks(log).join(stages(log).select("app", "stage", "batch"), ["app", "stage"])
    state = lambda place, t, a: F.struct(t.alias("ts"), F.lit(place).alias("place"), F.lit(a).alias("activity"))
    waited = F.array(state(0, F.col("launch"), SCHEDULING), state(1, F.col("getting_result"), WAITING), state(2, F.col("finish"), BUFFER))
    plain = F.array(state(0, F.col("launch"), SCHEDULING), state(1, F.col("finish"), WAITING))
    ends = rows.select("app", "batch", "stage", "launch", "pos", F.explode(F.when(F.col("getting_result").isNotNull(), waited).otherwise(plain)).alias("e"))
    per = W.partitionBy("app", "batch").orderBy("e.ts", "launch", "pos", "e.place")
    after = ends.withColumns({"activity": F.lead("e.activity").over(per), "of": F.lead("stage").over(per)})
    begun = after.select("app", "batch", F.col("e.ts").alias("begin"), F.coalesce("activity", F.lit(SCHEDULING)).alias("activity"), F.coalesce("of", F.lit(0)).alias("stage"), "launch", "pos", F.col("e.place").alias("place"))
    whole = W.partitionBy("app").orderBy("batch", "begin", "launch", "pos", "place")
    return begun.withColumn("stop", F.lead("begin").over(whole)).filter("stop is not null").select("app", "begin", "stop", "activity", F.col("stage").cast("long").alias("stage"))


_PART = "struct<message:boolean,activity:int,operator:bigint,a:bigint,wa:bigint,b:bigint,wb:bigint>"


def _span(activity: int, worker: Column, operator: Column, begin: Column, length: Column) -> Column:
    return F.struct(F.lit(False).alias("message"), F.lit(activity).alias("activity"), operator.cast("long").alias("operator"), begin.alias("a"), worker.cast("long").alias("wa"), (begin + length).alias("b"), worker.cast("long").alias("wb")).cast(_PART)


def _message(activity: int, sender: Column, sent: Column, receiver: Column, received: Column) -> Column:
    return F.struct(F.lit(True).alias("message"), F.lit(activity).alias("activity"), F.lit(None).cast("long").alias("operator"), sent.alias("a"), sender.cast("long").alias("wa"), received.alias("b"), receiver.cast("long").alias("wb")).cast(_PART)


def records_of(parts: DataFrame, drop_own: bool = False) -> DataFrame:
    """Two records for each part (app, p): start and end, or a message's two ends with one correlator; numbered by app.
    drop_own leaves out messages of a worker to itself."""
    parts = parts.filter("not p.message or p.wa <> p.wb") if drop_own else parts
    numbered = parts.withColumn("n", F.row_number().over(W.partitionBy("app").orderBy("p.a", "p.b", "p.wa", "p.wb", "p.activity", "p.operator")))
    m = F.col("p.message")
    one = lambda i, t, own, other, event: F.struct((F.col("n") * 2 + i).cast("long").alias("seq"), t.alias("ts"), own.alias("local_worker"), F.col("p.activity").alias("activity_type"), event.alias("event_type"), F.when(m, F.col("n")).cast("long").alias("correlator_id"), F.when(m, other).alias("remote_worker"), F.col("p.operator").alias("operator_id"))
    a, b, wa, wb = (F.col(f"p.{x}") for x in ("a", "b", "wa", "wb"))
    both = F.array(one(0, a, wa, wb, F.when(m, SENT).otherwise(START)), one(1, b, wb, wa, F.when(m, RECEIVED).otherwise(END)))
    return numbered.select("app", F.explode(both).alias("r")).select("app", *(f"r.{c}" for c in RECORD_COLUMNS))


def to_trace(log: DataFrame, shuffle_edges: bool = False, delay_split: float = 0.33, default_cores: int | None = None) -> DataFrame:
    """app and trace records of event logs: driver states, task messages and activities, shuffle messages if asked for."""
    done = scheduled(log, delay_split, default_cores)
    op, worker, driver = F.col("stage"), F.col("worker"), F.lit(DRIVER)
    read_at = F.col("start") + F.col("deserialize")
    compute_at = read_at + F.col("shuffle_read")
    write_at = compute_at + F.col("computing")
    serialize_at = write_at + F.col("shuffle_write")
    parts = F.array(
        _message(CONTROL_MESSAGE, driver, F.col("launch"), worker, F.col("start")),
        _span(DESERIALIZATION, worker, op, F.col("start"), F.col("deserialize")),
        F.when(F.col("shuffle_read") > 0, _span(BUFFER, worker, op, read_at, F.col("shuffle_read"))),
        _span(PROCESSING, worker, op, compute_at, F.col("computing")),
        F.when(F.col("shuffle_write") > 0, _span(BUFFER, worker, op, write_at, F.col("shuffle_write"))),
        _span(SERIALIZATION, worker, op, serialize_at, F.col("serialize")),
        _message(CONTROL_MESSAGE, worker, F.col("stop"), driver, F.coalesce("getting_result", "finish")),
    )
    of_tasks = done.select("app", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("p"))
    states = driver_states(log)
    spans = F.struct(F.lit(False), F.col("activity"), F.col("stage"), F.col("begin"), F.lit(DRIVER), F.col("stop"), F.lit(DRIVER)).cast(_PART)
    every = of_tasks.unionByName(states.select("app", spans.alias("p")))
    return records_of(every.unionByName(shuffles(log, done)) if shuffle_edges else every)


def shuffles(log: DataFrame, done: DataFrame) -> DataFrame:
    """A data message from each worker of a parent stage to each of a child, from one's completion to the other's
    submission. Parents that never ran here were skipped."""
    own = stages(log)
    used = done.select("app", "stage", "worker").distinct()
    child = own.select("app", F.col("stage").alias("child"), "submission", F.explode("parents").alias("stage"))
    pairs = child.join(own.select("app", "stage", "completion"), ["app", "stage"])
    to = used.select("app", F.col("stage").alias("child"), F.col("worker").alias("receiver"))
    rows = pairs.join(used, ["app", "stage"]).join(to, ["app", "child"])
    return rows.select("app", _message(DATA_MESSAGE, F.col("worker"), F.col("completion"), F.col("receiver"), F.col("submission")).alias("p"))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    return to_trace(events(spark, path), **options)
