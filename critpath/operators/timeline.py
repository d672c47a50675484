"""Worker timelines: one chain of activities per epoch and worker, without overlaps or gaps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.operators.messages import MESSAGE, bounds
from critpath.schema import BOGUS, END, RECEIVED, SENT, START, UNKNOWN, WAITING

#: Order within a timeline: real records by their place, then records made for missing ends, then the epoch's bounds.
_ORDER = ("ts", "rank", "seq")
PIECES = f"epoch long, worker long, k1 long, k2 long, place long, is_remote boolean, activity int, operator_id long, event_type int, message {MESSAGE}"
_PIECE_COLUMNS = [x.split()[0] for x in PIECES.split(", ")]


def records(trace: DataFrame, halves: DataFrame) -> DataFrame:
    """The records of all timelines from a trace and the missing ends of its messages (as messages.on_timelines, without what arrives)."""
    own = lambda df, rank: df.select("epoch", F.col("local_worker").alias("worker"), "ts", F.lit(rank).alias("rank"), "seq", "event_type", F.col("activity_type").alias("activity"), "operator_id", F.lit(None).cast(MESSAGE).alias("message"))
    return own(trace, 0).unionByName(own(halves, 1))


def slices(rows: DataFrame, window: int) -> DataFrame:
    """All records of an epoch's timelines, with two bounds for every worker that has a record.

    A timeline's first record brings the bounds along, in the shuffle that the windows after it need anyway.
    """
    fields = ("ts", "rank", "seq", "event_type", "activity", "operator_id", "message")
    low, high = bounds(window)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    bound = lambda t: F.struct(*(v.cast(kinds[n]).alias(n) for n, v in zip(fields, (t, F.lit(2), F.lit(0), F.lit(BOGUS), F.lit(UNKNOWN), F.lit(None), F.lit(None)), strict=True)))
    record = F.struct(*fields)
    first = F.row_number().over(W.partitionBy("epoch", "worker").orderBy(*_ORDER)) == 1
    made = F.when(F.col("first"), F.array(record, bound(low), bound(high))).otherwise(F.array(record))
    return rows.withColumn("first", first).select("epoch", "worker", F.explode(made).alias("r")).select("epoch", "worker", "r.*")


def with_stack(rows: DataFrame) -> DataFrame:
    """Adds prev_ts, depth (open activities before a record), top (the innermost one) and overlap (an End of another)."""
    per = W.partitionBy("epoch", "worker")
    ordered = per.orderBy(*_ORDER)
    so_far = ordered.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == START, 1).when(F.col("event_type") == END, -1).otherwise(0)
    at = W.partitionBy("epoch", "worker", "after").orderBy(*_ORDER).rowsBetween(W.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("event_type") == START, F.struct("activity", "operator_id")), ignorenulls=True).over(at)
    return (
        rows.withColumn("run", F.sum(step).over(so_far))
        .withColumn("after", F.col("run") - F.least(F.lit(0), F.min("run").over(so_far)))
        .withColumn("inner", F.when(F.col("after") > 0, opened))
        .withColumns({"prev_ts": F.lag("ts").over(ordered), "depth": F.coalesce(F.lag("after").over(ordered), F.lit(0)), "top": F.lag("inner").over(ordered)})
        .withColumn("overlap", F.max(((F.col("event_type") == END) & (F.col("depth") > 0) & (F.col("top.activity") != F.col("activity"))).cast("int")).over(per) == 1)
    )


def _element(k1: Column, k2: Column, place: Column, remote: bool, activity: Column, operator: Column) -> Column:
    event = F.col("event_type")
    return F.struct(k1.alias("k1"), k2.alias("k2"), place.alias("place"), F.lit(remote).alias("is_remote"), activity.alias("activity"), operator.cast("long").alias("operator_id"), event.alias("event_type"), (F.col("message") if remote else F.lit(None).cast(MESSAGE)).alias("message"))


def nested_pieces(stacked: DataFrame) -> DataFrame:
    """Local pieces and message points of timelines whose activities nest."""
    start, end, inside = F.col("event_type") == START, F.col("event_type") == END, F.col("depth") > 0
    place = F.row_number().over(W.partitionBy("epoch", "worker").orderBy(*_ORDER)).cast("long")
    ended = _element(F.col("prev_ts"), F.col("ts"), F.col("place"), False, F.col("activity"), F.col("operator_id"))
    below = _element(F.col("prev_ts"), F.col("ts"), F.col("place"), False, F.col("top.activity"), F.col("top.operator_id"))
    local = F.when(end & (~inside | (F.col("prev_ts") < F.col("ts"))), ended).when(~end & inside, below)
    remote = F.when(~start & ~end, _element(F.col("ts"), F.lit(0).cast("long"), F.col("place"), True, F.col("activity"), F.col("operator_id")))
    pieces = F.filter(F.array(local, remote), lambda x: x.isNotNull())
    return stacked.withColumn("place", place).select("epoch", "worker", F.explode(pieces).alias("p")).select("epoch", "worker", "p.*")


#: Epochs of a worker that one call handles, one after the other.
EPOCHS_PER_CALL = 64


def overlapping_pieces(table: pa.Table) -> pa.Table:
    """The same for timelines of one worker with overlaps: an End closes the innermost activity of its type and those
    inside it."""
    table = table.sort_by([(c, "ascending") for c in ("epoch", *_ORDER)])
    out, stack, prev, current, place = [], [], None, None, 0
    for epoch, worker, ts, event, activity, operator, message in zip(*(table[c].to_pylist() for c in ("epoch", "worker", "ts", "event_type", "activity", "operator_id", "message")), strict=True):
        if epoch != current:
            stack, prev, current, place = [], None, epoch, 0
        local = None
        if event == START:
            if stack:
                local = stack[-1]
            stack.append((activity, operator))
        elif event == END:
            held = [i for i, s in enumerate(stack) if s[0] == activity]
            if held:
                del stack[held[-1] :]
            if not held or prev < ts:
                local = (activity, operator)
        elif stack:
            local = stack[-1]
        if local:
            out.append((epoch, worker, prev, ts, place, False, *local, event, None))
        if event not in (START, END):
            out.append((epoch, worker, ts, 0, place, True, activity, operator, event, message))
        prev = ts
        place += 1
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32(), pa.int64(), pa.int32(), table.schema.field("message").type]
    return pa.Table.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=_PIECE_COLUMNS)


def pieces(trace: DataFrame, halves: DataFrame, window: int, mode: str = "auto") -> DataFrame:
    """Pieces of all timelines of a trace and its messages' missing ends."""
    return pieces_of(records(trace, halves), window, mode).drop("message")


def pieces_of(rows: DataFrame, window: int, mode: str = "auto") -> DataFrame:
    """Pieces of all timelines. mode: auto takes the window plan, and the grouped function where activities overlap;
    window and grouped take one of them for all (window is exact for nested activities alone)."""
    stacked = with_stack(slices(rows, window))
    by_window = nested_pieces(stacked if mode == "window" else stacked.filter("not overlap")).select(*_PIECE_COLUMNS)
    if mode == "window":
        return by_window
    # all columns of the stack go along: both branches then read one shuffle
    rest = stacked if mode == "grouped" else stacked.filter("overlap")
    grouped = rest.groupBy(F.expr(f"epoch div {EPOCHS_PER_CALL}"), "worker").applyInArrow(overlapping_pieces, PIECES)
    return grouped if mode == "grouped" else by_window.unionByName(grouped)


def connected(parts: DataFrame, threshold: int, insert_waiting: bool) -> DataFrame:
    """Edges of gap-free chains: small gaps are closed, others become Waiting or Unknown activities."""
    local = graph_rows(parts.withColumn("message", F.lit(None).cast(MESSAGE)), None, threshold, insert_waiting)
    return local.select("epoch", "src_ts", "src_worker", "dst_ts", "dst_worker", "edge_type", "operator_id")


def graph_rows(parts: DataFrame, window: int | None, threshold: int, insert_waiting: bool) -> DataFrame:
    """epoch, worker (whose timeline has it), kind (EDGE, START, END), src_ts, src_worker, dst_ts, dst_worker, edge_type,
    operator_id: the chains' edges, the messages that arrive on them and, with a window, the ends of every timeline.

    What happens between two neighbours depends on them alone, so one pass with lag and lead does it.
    """
    order = W.partitionBy("epoch", "worker").orderBy("k1", "k2", "is_remote", "place")
    begin, stop = F.col("k1"), F.when(F.col("is_remote"), F.col("k1")).otherwise(F.col("k2"))
    rows = parts.withColumn("stop", stop).withColumns({
        "p_remote": F.lag("is_remote").over(order), "p_stop": F.lag("stop").over(order),
        "n_remote": F.lead("is_remote").over(order), "n_begin": F.lead("k1").over(order), "n_event": F.lead("event_type").over(order),
    })
    close_before, close_after = (begin - F.col("p_stop")) < threshold, (F.col("n_begin") - F.col("stop")) < threshold
    middle = lambda a, b: F.shiftright(a + b, 1)
    new_begin = F.when(F.col("p_stop").isNull() | ~close_before, begin).when(F.col("p_remote"), F.col("p_stop")).otherwise(middle(F.col("p_stop"), begin))
    new_stop = F.when(F.col("n_begin").isNull() | ~close_after, F.col("stop")).when(F.col("n_remote"), F.col("n_begin")).otherwise(middle(F.col("stop"), F.col("n_begin")))
    to_receive = F.col("n_remote") & (F.col("n_event") == RECEIVED) & F.lit(insert_waiting)
    waits = to_receive & (~F.col("is_remote") | (F.col("event_type") == SENT))
    here, none = F.col("worker"), F.lit(None)

    def row(kind: str, src_ts: Column, src_worker: Column, dst_ts: Column, dst_worker: Column, edge_type: Column = none, operator: Column = none) -> Column:
        named = (("src_ts", src_ts), ("src_worker", src_worker), ("dst_ts", dst_ts), ("dst_worker", dst_worker), ("edge_type", edge_type), ("operator_id", operator))
        return F.struct(F.lit(kind).alias("kind"), *(v.cast("int" if n == "edge_type" else "long").alias(n) for n, v in named))

    own = F.when(~F.col("is_remote") & (new_begin < new_stop), row("EDGE", new_begin, here, new_stop, here, F.col("activity"), F.col("operator_id")))
    filled = (F.col("stop") < F.col("n_begin")) & (~close_after | (F.col("is_remote") & F.col("n_remote")))
    gap = F.when(filled, row("EDGE", F.col("stop"), here, F.col("n_begin"), here, F.when(waits, WAITING).otherwise(UNKNOWN)))
    made = [own, gap]
    if window is not None:
        low, high = bounds(window)
        sent_at, sender = F.col("message.src_ts"), F.col("message.src_worker")
        made.append(F.when((sender != here) | (sent_at < begin), row("EDGE", sent_at, sender, begin, here, F.col("message.edge_type"), F.col("message.operator_id"))))
        is_bound = F.col("is_remote") & (F.col("event_type") == BOGUS)  # no record of the trace lies on an epoch's bounds
        made.append(F.when(is_bound & (begin == low), row("START", none, none, begin, here)).when(is_bound & (begin == high), row("END", begin, here, none, none)))
    found = rows.select("epoch", "worker", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("e"))
    return found.select("epoch", "worker", "e.*")


def chain_ends(trace: DataFrame, halves: DataFrame, window: int) -> DataFrame:
    """epoch, kind (START, END), ts, worker: both ends of every timeline."""
    low, high = bounds(window)
    own = trace.select("epoch", F.col("local_worker").alias("worker")).unionByName(halves.select("epoch", F.col("local_worker").alias("worker"))).distinct()
    ends = F.array(F.struct(F.lit("START").alias("kind"), low.alias("ts")), F.struct(F.lit("END").alias("kind"), high.alias("ts")))
    return own.select("epoch", "worker", F.explode(ends).alias("e")).select("epoch", "e.kind", "e.ts", "worker")


def broken_chains(edges: DataFrame) -> DataFrame:
    """Local edges that don't begin where the one before ended: none, if all is well."""
    order = W.partitionBy("epoch", "src_worker").orderBy("src_ts", "dst_ts")
    return edges.withColumn("before", F.lag("dst_ts").over(order)).filter("before <> src_ts")
