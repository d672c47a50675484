"""Outputs: graphs, traces for viewers, text lines. Each is a DataFrame; writers put it into files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.schema import ACTIVITIES, END, EVENTS, RECEIVED, RECORD_COLUMNS, SENT, START, is_worker_local, named

#: Bytes of a viewer's file before the next is begun.
CHUNK_BYTES = 250_000_000


def _node(ts: Column, worker: Column) -> Column:
    return F.concat(F.lit('"'), ts.cast("string"), F.lit("@"), worker.cast("string"), F.lit('"'))


def dot(pag: DataFrame) -> DataFrame:
    """epoch, value: lines of a DOT graph, a cluster for each worker with its edges by time, then the messages.

    Lines are rows in order (epoch, part, worker, k), so no task holds a whole graph."""
    edges = pag.filter("kind = 'EDGE'")
    own = F.col("src_worker") == F.col("dst_worker")
    line = F.concat(_node(F.col("src_ts"), F.col("src_worker")), F.lit(" -> "), _node(F.col("dst_ts"), F.col("dst_worker")), F.lit(' [label="'), named(F.col("edge_type"), ACTIVITIES), F.lit('"];'))
    body = edges.select("epoch", F.when(own, 1).otherwise(2).alias("part"), F.when(own, F.col("src_worker")).otherwise(F.lit(0)).alias("worker"), F.col("src_ts").alias("k"), line.alias("value"))
    clusters = edges.filter(own).select("epoch", "src_worker").distinct()
    mark = lambda k, text: clusters.select("epoch", F.lit(1).alias("part"), F.col("src_worker").alias("worker"), F.lit(k).cast("long").alias("k"), text.alias("value"))
    open_ = mark(-(1 << 62), F.concat(F.lit("subgraph cluster"), F.col("src_worker").cast("string"), F.lit(' { label="w'), F.col("src_worker").cast("string"), F.lit('";')))
    ends = edges.select("epoch").distinct()
    frame = lambda part, text: ends.select("epoch", F.lit(part).alias("part"), F.lit(0).cast("long").alias("worker"), F.lit(0).cast("long").alias("k"), F.lit(text).alias("value"))
    return body.unionByName(open_).unionByName(mark(1 << 62, F.lit("}"))).unionByName(frame(0, "digraph pag {")).unionByName(frame(3, "}"))


def write_dot(pag: DataFrame, path: str) -> None:
    """Graphs as text under path/epoch=N; lines of an epoch are in order."""
    lines = dot(pag).repartition("epoch").sortWithinPartitions("epoch", "part", "worker", "k", "value")
    lines.select("epoch", "value").write.mode("overwrite").partitionBy("epoch").text(path)


def as_trace(pag: DataFrame) -> DataFrame:
    """epoch and trace records of a graph: two for each edge, with a correlator of their own from 1 on in each epoch;
    Sent and Received if the edge's activity crosses workers, else Start and End."""
    order = W.partitionBy("epoch").orderBy("src_ts", "src_worker", "dst_ts", "dst_worker", "edge_type", "operator_id")
    rows = pag.filter("kind = 'EDGE'").withColumn("n", F.row_number().over(order).cast("long"))
    local = is_worker_local("edge_type")
    one = lambda i, t, own, other, event: F.struct((F.col("n") * 2 + i).alias("seq"), t.alias("ts"), own.alias("local_worker"), F.col("edge_type").alias("activity_type"), event.alias("event_type"), F.col("n").alias("correlator_id"), other.alias("remote_worker"), F.col("operator_id").alias("operator_id"))
    a, b, s, d = F.col("src_ts"), F.col("dst_ts"), F.col("src_worker"), F.col("dst_worker")
    both = F.array(one(0, a, s, d, F.when(local, START).otherwise(SENT)), one(1, b, d, s, F.when(local, END).otherwise(RECEIVED)))
    return rows.select("epoch", F.explode(both).alias("r")).select("epoch", *(f"r.{c}" for c in RECORD_COLUMNS))


def summary_lines(summaries: DataFrame) -> DataFrame:
    """SUMMARY epoch,activity,operator,src,dst,crosses,bc,weighted_bc,count,weight"""
    names = ["epoch", "activity", "operator", "src", "dst", "crosses", "bc", "weighted_bc", "count", "weight"]
    whole = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    cells = [whole(c) if c in ("bc", "weighted_bc") else F.col(c).cast("string") for c in names]
    return summaries.select(F.concat(F.lit("SUMMARY "), F.concat_ws(",", *cells)).alias("value"))


def path_summary_lines(rows: DataFrame, index: int = 0) -> DataFrame:
    """SP_SUMMARY epoch index activity operator bc weighted_bc count weight"""
    return rows.select(F.concat_ws(" ", F.lit("SP_SUMMARY"), "epoch", F.lit(index), "activity", "operator", "bc", "weighted_bc", "count", "weight").alias("value"))


def count_lines(counts: dict[str, DataFrame]) -> DataFrame:
    """COUNT epoch 0 name n lines of several stages' rows."""
    out = None
    for name, rows in counts.items():
        part = rows.groupBy("epoch").agg(F.count("*").alias("n")).select(F.concat_ws(" ", F.lit("COUNT"), "epoch", F.lit(0), F.lit(name), "n").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def record_lines(trace: DataFrame) -> DataFrame:
    """seq, value: records as readable text."""
    known = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in ("correlator_id", "remote_worker", "operator_id")]
    return trace.select("seq", F.concat_ws(" ", F.col("ts"), F.col("local_worker"), named(F.col("activity_type"), ACTIVITIES), named(F.col("event_type"), EVENTS), *known).alias("value"))


def chrome_events(trace: DataFrame, ticks_per_us: int = 1000) -> DataFrame:
    """seq, place, ts (us) and the fields of a trace viewer's events: begin and end of activities, and for messages a
    short slice with a flow arrow that starts at the send and ends at the receive."""
    e = F.col("event_type")
    one = lambda place, ph, flow=False: F.struct(F.lit(place).alias("place"), F.lit(ph).alias("ph"), (F.col("correlator_id") if flow else F.lit(None).cast("long")).alias("id"))
    events = (
        F.when(e == START, F.array(one(0, "B"))).when(e == END, F.array(one(0, "E")))
        .when(e == SENT, F.array(one(0, "B"), one(1, "s", True), one(2, "E"))).when(e == RECEIVED, F.array(one(0, "B"), one(1, "t", True), one(2, "E")))
    )
    rows = trace.select("seq", F.expr(f"ts div {int(ticks_per_us)}").alias("ts"), F.lit(0).alias("pid"), F.col("local_worker").alias("tid"), named(F.col("activity_type"), ACTIVITIES).alias("name"), named(e, EVENTS).alias("event"), F.explode(events).alias("v"))
    return rows.select("seq", F.col("v.place").alias("place"), F.col("v.ph").alias("ph"), "name", "ts", "pid", "tid", F.col("v.id").alias("id"), "event")


def chrome_json(trace: DataFrame, ticks_per_us: int = 1000) -> DataFrame:
    """ts, seq, place, value: the events as JSON."""
    rows = chrome_events(trace, ticks_per_us)
    return rows.select("ts", "seq", "place", F.to_json(F.struct("name", "ph", "ts", "pid", "tid", "id", F.struct("event").alias("args"))).alias("value"))


def write_chunked(lines: DataFrame, path: str, order: list[str], chunk_bytes: int = CHUNK_BYTES) -> None:
    """JSON lines sorted over all files; a file has chunk_bytes at most, by the longest line, or one line if that is longer."""
    longest = lines.select(F.max(F.octet_length("value"))).first()[0] or 1
    lines.sort(*order).select("value").write.mode("overwrite").option("maxRecordsPerFile", max(1, chunk_bytes // (longest + 1))).text(path)


def spans(trace: DataFrame, skip: int | None = None, take: int | None = None) -> DataFrame:
    """worker, start, type, corr_id, end, remote of activities and messages whose records share a correlator; an end
    goes with the latest open before it, which may have several ends. skip and take are of records in order of time."""
    rows = trace.select(*RECORD_COLUMNS)
    if skip is not None or take is not None:
        rows = rows.orderBy("ts", "seq")
        rows = rows.offset(skip) if skip else rows
        rows = rows.limit(take) if take is not None else rows
    per = W.partitionBy("correlator_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, -1)
    opens = F.col("event_type").isin(START, SENT)
    open_ = F.last(F.when(opens, F.struct("ts", "local_worker", "activity_type")), ignorenulls=True).over(per)
    known = rows.filter("correlator_id is not null").withColumn("o", open_).filter(F.col("event_type").isin(END, RECEIVED) & F.col("o").isNotNull())
    return known.select(F.col("o.local_worker").alias("worker"), F.col("o.ts").alias("start"), named(F.col("o.activity_type"), ACTIVITIES).alias("type"), F.col("correlator_id").alias("corr_id"), F.col("ts").alias("end"), F.when(F.col("event_type") == RECEIVED, F.col("local_worker")).alias("remote"))
