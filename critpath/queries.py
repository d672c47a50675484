"""The engine's queries over a trace derived from the events table, and their SQL equivalents.

The SQL is written on its own: open activities by the last start or end, edges by neighbours, paths by enumeration.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.operators import messages, pag, prep, rank, summary, timeline
from critpath.plans.pipeline import Analysis
from critpath.plans.sweep import Sweep
from critpath.schema import ACTIVITIES, BARRIER_PROCESSING, END, RECORD_COLUMNS, START, UNKNOWN, WAITING, is_worker_local
from critpath.sources import sinks, svg
from critpath.sources.derived import HOUR, MINUTE, TEN_SECONDS, from_events
from critpath.sources.synth import Pyramid, pyramid

#: from_events makes a worker's activities one after the other, so they nest.
CONFIG = Config(window=HOUR, threshold=MINUTE, waiting_message=TEN_SECONDS, nested=True)
DELAY = 30_000_000
EDGE = ["epoch", "src_ts", "src_worker", "dst_ts", "dst_worker", "edge_type", "operator_id"]


def trace_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.with_epoch(trace_of(spark, sf_dir), HOUR)


def _paired(spark: SparkSession, sf_dir: str) -> messages.Paired:
    return messages.pair(_sliced(spark, sf_dir), HOUR)


def _analysis(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> Analysis:
    return Analysis.of(trace_of(spark, sf_dir), config)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.pieces_of(messages.on_timelines(_sliced(spark, sf_dir), HOUR), HOUR)


def _timeline(spark: SparkSession, sf_dir: str, insert_waiting: bool = True) -> DataFrame:
    return timeline.connected(_pieces(spark, sf_dir), MINUTE, insert_waiting)


def trace_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_of(spark, sf_dir)


def epoch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.count_by_epoch(_sliced(spark, sf_dir))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.workers(trace_of(spark, sf_dir))


def activity_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame(list(ACTIVITIES.items()), "activity_type int, name string")
    rows = trace_of(spark, sf_dir).join(F.broadcast(names), "activity_type")  # thirteen names
    return rows.groupBy("name", is_worker_local("activity_type").alias("local")).agg(F.count("*").alias("n"))


def message_delay_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.clip_message_delay(trace_of(spark, sf_dir), DELAY).select("seq", "ts", "local_worker", "event_type")


def message_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).edges


def message_halfedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).halves


def message_matched_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_edges(spark, sf_dir).filter("status = 'matched'").drop("status")


def message_unmatched_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_edges(spark, sf_dir).filter("status = 'send'").drop("status")


def message_unmatched_recv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_edges(spark, sf_dir).filter("status = 'receive'").drop("status")


def message_latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.delay_histogram(trace_of(spark, sf_dir), 5_000_000)


def duplicate_sends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sends without regard to their correlator, so that an epoch has several with one key."""
    return messages.duplicate_sends(_sliced(spark, sf_dir).withColumn("correlator_id", F.lit(None).cast("long")))


def local_activity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).filter("not is_remote").select("epoch", "worker", F.col("k1").alias("src_ts"), F.col("k2").alias("dst_ts"), "activity", "operator_id")


def local_activity_edges_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = _sliced(spark, sf_dir)
    pieces = timeline.pieces(sliced, messages.pair(sliced, HOUR).halves, HOUR, "grouped")
    return pieces.filter("not is_remote").select("epoch", "worker", F.col("k1").alias("src_ts"), F.col("k2").alias("dst_ts"), "activity", "operator_id")


def worker_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir).select(*EDGE)


def gap_fill_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_timeline(spark, sf_dir).filter(F.col("edge_type").isin(UNKNOWN, WAITING))


def waiting_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker_timeline(spark, sf_dir).filter(F.col("edge_type") == WAITING)


def no_insert_waiting_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(spark, sf_dir, False).groupBy("epoch", "edge_type").agg(F.count("*").alias("n"), F.sum(F.col("dst_ts") - F.col("src_ts")).alias("ticks"))


def start_end_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliced = _sliced(spark, sf_dir)
    return timeline.chain_ends(sliced, messages.pair(sliced, HOUR).halves, HOUR)


def broken_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the activities before gaps are filled, so that there are some; filled timelines have none (a test holds that)."""
    edges = _pieces(spark, sf_dir).filter("not is_remote").select("epoch", F.col("worker").alias("src_worker"), F.col("k1").alias("src_ts"), F.col("k2").alias("dst_ts"))
    return timeline.broken_chains(edges).select("epoch", "src_worker", "src_ts", "dst_ts", "before")


def epochs_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of an epoch's records, applied to every epoch."""

    def shape(records):
        return records.groupby("epoch", as_index=False).agg(records=("seq", "size"), workers=("local_worker", "nunique"), first=("ts", "min"))

    return rank.iterate_epochs(_sliced(spark, sf_dir), shape, "epoch long, records long, workers long, first long")


def count_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.count_lines({"records": _sliced(spark, sf_dir), "messages": message_edges(spark, sf_dir)})


def pag_edges_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pag.edges(_analysis(spark, sf_dir).graph).drop("kind")


def pag_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = _analysis(spark, sf_dir).graph
    return graph.groupBy("epoch").agg(*(F.sum((F.col("kind") == k).cast("long")).alias(n) for k, n in (("START", "forward"), ("END", "backward"), ("EDGE", "edges"))), F.count("*").alias("pag_output"))


def delayed_message_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pag_edges_traversal(spark, sf_dir).filter("traverse = 'Block' and src_worker <> dst_worker")


def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).ranked.select(*EDGE, "bc")


def edge_betweenness_waiting_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.betweenness(_analysis(spark, sf_dir).graph, "waiting_one").select(*EDGE, "bc")


def path_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).paths


def cp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).summaries


def cp_summary_six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with windows whose paths are too many to enumerate."""
    return _analysis(spark, sf_dir, replace(CONFIG, window=6 * HOUR)).summaries


def cp_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).normalised(1_000_000)


def cp_top_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.top_activities(cp_summary(spark, sf_dir), 20)


def cp_by_operator_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.grouped(cp_summary(spark, sf_dir), ["operator", "activity"], ["weighted_bc"], activities=[2, 3, 4, 6], filter_messages=True)
    wide = summary.pivoted(rows, ["operator"], "activity", "weighted_bc", [2, 3, 4, 6])
    return wide.select("operator", *(F.col(str(a)).alias(f"a{a}") for a in (2, 3, 4, 6)))


def cp_mean_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summary.grouped(cp_summary(spark, sf_dir), ["src"], ["bc", "weight"], filter_messages=True, mean_over=["src"])
    return rows.withColumnsRenamed({"bc": "mean_bc", "weight": "mean_weight"})


def waiting_share_per_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.col("dst_ts") - F.col("src_ts")
    waits = F.sum(F.when(F.col("edge_type") == WAITING, length).otherwise(0))
    return worker_timeline(spark, sf_dir).groupBy(F.col("src_worker").alias("worker")).agg(waits.alias("waiting"), F.sum(length).alias("ticks"), (waits / F.sum(length)).alias("share"))


def cdf_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.cdf(worker_timeline(spark, sf_dir).withColumn("w", (F.col("dst_ts") - F.col("src_ts")).cast("double")), "w", ["edge_type"])


def quantile_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = summary.quantiles(worker_timeline(spark, sf_dir).withColumn("w", (F.col("dst_ts") - F.col("src_ts")).cast("double")), "w", ["edge_type"])
    return found.select("edge_type", *(F.round(f"q{i}", 1).alias(f"q{i}") for i in range(3)))


def zero_filled_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worker_timeline(spark, sf_dir).filter(F.col("edge_type") == WAITING).groupBy("epoch", F.col("src_worker").alias("worker")).agg(F.count("*").alias("n"))
    return summary.zero_filled(rows, ["epoch", "worker"], ["n"])


def trace_quality_double_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all workers' records as if they were one worker's, whose activities then start twice."""
    return prep.double_starts(trace_of(spark, sf_dir).withColumn("local_worker", F.lit(0).cast("long"))).select("seq", "local_worker", "activity_type", "depth")


def trace_quality_underflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With starts and ends exchanged, so that activities end before they start."""
    swapped = F.when(F.col("event_type") == START, END).when(F.col("event_type") == END, START).otherwise(F.col("event_type"))
    return prep.underflows(trace_of(spark, sf_dir).withColumn("event_type", swapped)).select("seq", "local_worker", "activity_type", "depth")


def trace_quality_max_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.nesting(trace_of(spark, sf_dir))


def infer_correlators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.infer_correlators(trace_of(spark, sf_dir)).select("seq", "correlator_id")


def chrome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.chrome_events(trace_of(spark, sf_dir), 1)


def span_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.spans(trace_of(spark, sf_dir))


def span_join_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.spans(prep.infer_correlators(trace_of(spark, sf_dir)))


def pag_as_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.as_trace(_analysis(spark, sf_dir).graph).select("epoch", *RECORD_COLUMNS)


def pag_dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.dot(_analysis(spark, sf_dir).graph)


def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.summary_lines(cp_summary(spark, sf_dir))


def single_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.single_path(_analysis(spark, sf_dir).graph, pick="first")


def single_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).path_summaries(pick="first")


def path_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.path_summary_lines(single_path_summary(spark, sf_dir))


def pyramid_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated trace: activities of four workers in three phases, without messages and by worker and time."""
    shape = Pyramid(workers=4, phases=3, phase=130_000, prefix=None, suffix=None, infix=None, send=None, receive=None)
    return pyramid(spark, shape).select("ts", "local_worker", "activity_type", "event_type", "operator_id")


def pyramid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of two generated workers, whose result is known."""
    shape = Pyramid(workers=2, phase=1_000_000_000, infix=BARRIER_PROCESSING)
    return Analysis.of(pyramid(spark, shape), Config(window=1_000_000_000, threshold=1000)).summaries


def sweep_path_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs, nodes and weight of two windows with two thresholds."""
    runs = Sweep(trace_of(spark, sf_dir), CONFIG, (HOUR, 2 * HOUR), (MINUTE, 5 * MINUTE)).summaries()
    return runs.groupBy("window", "threshold").agg(F.countDistinct("epoch").alias("epochs"), F.sum("count").alias("edges"), F.sum("weight").alias("weight"))


def activity_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svg.lanes(trace_of(spark, sf_dir)).select("worker", "lane", "start", "stop", "activity", "operator_id")


QUERIES = {f.__name__: f for f in (
    pyramid_trace, pyramid_summary, sweep_path_totals, activity_lanes,
    trace_records, epoch_counts, workers, activity_dim_join, message_delay_clip, message_edges, message_halfedges, message_matched_only, message_unmatched_send,
    message_unmatched_recv, message_latency_histogram, duplicate_sends, local_activity_edges, local_activity_edges_grouped, worker_timeline, gap_fill_edges, waiting_edges,
    no_insert_waiting_variant, start_end_nodes, broken_chains, pag_edges_traversal, pag_stage_counts, delayed_message_block, edge_betweenness, edge_betweenness_waiting_one, path_counts, cp_summary,
    cp_summary_six_hours, cp_normalized, cp_top_activities, cp_by_operator_pivot, cp_mean_by_worker, waiting_share_per_worker, cdf_weight, quantile_weight, zero_filled_product,
    trace_quality_double_start, trace_quality_underflow, trace_quality_max_nesting, infer_correlators, chrome_events, span_join, span_join_infer, pag_as_trace, pag_dot_lines, summary_text,
    single_path, single_path_summary, path_summary_text, count_text, epochs_mapped,
)}

_W = "3600000000"
_NAMES = "CASE {} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ACTIVITIES.items()) + " END"
_TRACE = """
base AS (SELECT event_id, epoch_us(ts) AS t, user_id % 8 AS w, user_id % 16 AS op, event_type AS kind, value FROM events),
err AS (SELECT *, (w + 1) % 8 AS other, CASE WHEN value < 5 THEN 9 ELSE 10 END AS a FROM base WHERE kind = 'error'),
act AS (SELECT *, CASE kind WHEN 'view' THEN 4 WHEN 'click' THEN 2 WHEN 'purchase' THEN 6 ELSE 3 END AS a, row_number() OVER p AS n FROM base WHERE kind <> 'error' WINDOW p AS (PARTITION BY w ORDER BY t, event_id)),
two AS (SELECT *, lag(a) OVER p AS pa, lag(op) OVER p AS pop FROM act WINDOW p AS (PARTITION BY w ORDER BY t, event_id)),
trace AS (
  SELECT event_id * 2 AS seq, t AS ts, w AS local_worker, a AS activity_type, 3 AS event_type, event_id AS correlator_id, other AS remote_worker, CAST(NULL AS BIGINT) AS operator_id FROM err
  UNION ALL SELECT event_id * 2 + 1, t + CAST(floor(value * 10) + 1 AS BIGINT) * 1000000, other, a, 4, event_id, w, NULL FROM err
  UNION ALL SELECT event_id * 2, t, w, CASE n % 2 WHEN 1 THEN a ELSE pa END, CASE n % 2 WHEN 1 THEN 1 ELSE 2 END, NULL, NULL, CASE n % 2 WHEN 1 THEN op ELSE pop END FROM two),
e AS (SELECT *, ts // W AS epoch FROM trace)"""
_MESSAGES = """,
m AS (SELECT coalesce(s.epoch, r.epoch) AS epoch, CASE WHEN r.seq IS NULL THEN 'send' WHEN s.seq IS NULL THEN 'receive' ELSE 'matched' END AS status,
  coalesce(s.ts, r.epoch * W - 1) AS src_ts, coalesce(s.local_worker, r.remote_worker) AS src_worker, coalesce(r.ts, (s.epoch + 1) * W) AS dst_ts, coalesce(r.local_worker, s.remote_worker) AS dst_worker,
  coalesce(s.activity_type, r.activity_type) AS edge_type, CAST(NULL AS BIGINT) AS operator_id, coalesce(s.seq, r.seq) AS seq, coalesce(s.correlator_id, r.correlator_id) AS correlator_id
  FROM (SELECT * FROM e WHERE event_type = 3) s FULL JOIN (SELECT * FROM e WHERE event_type = 4) r ON s.epoch = r.epoch AND s.local_worker = r.remote_worker AND s.correlator_id = r.correlator_id),
h AS (SELECT epoch, seq, CASE status WHEN 'send' THEN dst_ts ELSE src_ts END AS ts, CASE status WHEN 'send' THEN dst_worker ELSE src_worker END AS local_worker, edge_type AS activity_type,
  CASE status WHEN 'send' THEN 3 ELSE 4 END AS event_type, correlator_id, CASE status WHEN 'send' THEN src_worker ELSE dst_worker END AS remote_worker, operator_id FROM m WHERE status <> 'matched')"""
_PIECES = """,
recs AS (SELECT epoch, local_worker AS worker, ts, 0 AS rank, seq, event_type, activity_type, operator_id FROM e UNION ALL SELECT epoch, local_worker, ts, 1, seq, event_type, activity_type, operator_id FROM h),
who AS (SELECT DISTINCT epoch, worker FROM recs),
rows_ AS (SELECT * FROM recs UNION ALL SELECT epoch, worker, epoch * W - 1, 2, 0, 5, 11, NULL FROM who UNION ALL SELECT epoch, worker, (epoch + 1) * W, 2, 0, 5, 11, NULL FROM who),
st AS (SELECT *, lag(ts) OVER o AS prev, row_number() OVER o AS place,
  coalesce(last_value(CASE WHEN event_type IN (1, 2) THEN event_type END IGNORE NULLS) OVER b, 2) = 1 AS opened,
  last_value(CASE WHEN event_type = 1 THEN activity_type END IGNORE NULLS) OVER b AS top_a, last_value(CASE WHEN event_type = 1 THEN operator_id END IGNORE NULLS) OVER b AS top_op
  FROM rows_ WINDOW o AS (PARTITION BY epoch, worker ORDER BY ts, rank, seq), b AS (PARTITION BY epoch, worker ORDER BY ts, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pieces AS (
  SELECT epoch, worker, prev AS k1, ts AS k2, place, false AS rem, activity_type AS activity, operator_id, event_type FROM st WHERE event_type = 2 AND (NOT opened OR prev < ts)
  UNION ALL SELECT epoch, worker, prev, ts, place, false, top_a, top_op, event_type FROM st WHERE event_type <> 2 AND opened
  UNION ALL SELECT epoch, worker, ts, 0, place, true, activity_type, operator_id, event_type FROM st WHERE event_type NOT IN (1, 2))"""
_TIMELINE = """,
nb AS (SELECT *, CASE WHEN rem THEN k1 ELSE k2 END AS fin, lag(rem) OVER o AS prem, lag(CASE WHEN rem THEN k1 ELSE k2 END) OVER o AS pfin, lead(rem) OVER o AS nrem, lead(k1) OVER o AS nk1, lead(event_type) OVER o AS nev
  FROM pieces WINDOW o AS (PARTITION BY epoch, worker ORDER BY k1, k2, rem, place)),
loc AS (
  SELECT epoch, CASE WHEN pfin IS NULL OR k1 - pfin >= 60000000 THEN k1 WHEN prem THEN pfin ELSE (pfin + k1) // 2 END AS src_ts, worker AS src_worker,
    CASE WHEN nk1 IS NULL OR nk1 - fin >= 60000000 THEN fin WHEN nrem THEN nk1 ELSE (fin + nk1) // 2 END AS dst_ts, worker AS dst_worker, activity AS edge_type, operator_id FROM nb WHERE NOT rem
  UNION ALL SELECT epoch, fin, worker, nk1, worker, CASE WHEN INSERT AND nrem AND nev = 4 AND (NOT rem OR event_type = 3) THEN 12 ELSE 11 END, NULL FROM nb WHERE nk1 IS NOT NULL AND (nk1 - fin >= 60000000 OR (rem AND nrem))),
tl AS (SELECT epoch, src_ts, src_worker, dst_ts, dst_worker, CAST(edge_type AS INTEGER) AS edge_type, CAST(operator_id AS BIGINT) AS operator_id FROM loc WHERE src_ts < dst_ts)"""
_GRAPH = """,
alle AS (SELECT * FROM tl UNION ALL SELECT epoch, src_ts, src_worker, dst_ts, dst_worker, edge_type, operator_id FROM m WHERE src_worker <> dst_worker OR src_ts < dst_ts),
g AS (SELECT *, CASE WHEN edge_type = 12 OR (src_worker <> dst_worker AND dst_ts - src_ts > 10000000 AND coalesce(lag(edge_type) OVER (PARTITION BY epoch, dst_worker ORDER BY dst_ts, src_worker <> dst_worker, src_ts, edge_type), 0) <> 12)
  THEN 'Block' ELSE 'Unbounded' END AS traverse FROM alle)"""
_PATHS = """,
fp AS (SELECT epoch, epoch * W - 1 AS ts, worker FROM who UNION ALL SELECT g.epoch, g.dst_ts, g.dst_worker FROM fp JOIN g ON g.epoch = fp.epoch AND g.src_ts = fp.ts AND g.src_worker = fp.worker AND g.traverse <> 'Block'),
bp AS (SELECT epoch, (epoch + 1) * W AS ts, worker FROM who UNION ALL SELECT g.epoch, g.src_ts, g.src_worker FROM bp JOIN g ON g.epoch = bp.epoch AND g.dst_ts = bp.ts AND g.dst_worker = bp.worker AND g.traverse <> 'Block'),
fc AS (SELECT epoch, ts, worker, count(*) AS n FROM fp GROUP BY ALL), bcn AS (SELECT epoch, ts, worker, count(*) AS n FROM bp GROUP BY ALL),
rk AS (SELECT g.*, CAST(CASE WHEN traverse = 'Block' THEN 0 ELSE coalesce(fc.n, 0) * coalesce(bcn.n, 0) END AS DOUBLE) AS bc FROM g
  LEFT JOIN fc ON fc.epoch = g.epoch AND fc.ts = g.src_ts AND fc.worker = g.src_worker LEFT JOIN bcn ON bcn.epoch = g.epoch AND bcn.ts = g.dst_ts AND bcn.worker = g.dst_worker)"""
#: With waiting_one a path may also begin after, and end before, an edge that blocks; such an edge counts once itself.
_PATHS_ONE = (
    _PATHS.replace("AS ts, worker FROM who UNION ALL SELECT g.epoch, g.dst_ts", "AS ts, worker FROM who UNION ALL SELECT epoch, dst_ts, dst_worker FROM g WHERE traverse = 'Block') UNION ALL SELECT g.epoch, g.dst_ts")
    .replace("AS ts, worker FROM who UNION ALL SELECT g.epoch, g.src_ts", "AS ts, worker FROM who UNION ALL SELECT epoch, src_ts, src_worker FROM g WHERE traverse = 'Block') UNION ALL SELECT g.epoch, g.src_ts")
    .replace("AS (SELECT epoch, epoch * W - 1", "AS ((SELECT epoch, epoch * W - 1").replace("AS (SELECT epoch, (epoch + 1)", "AS ((SELECT epoch, (epoch + 1)").replace("'Block' THEN 0", "'Block' THEN 1")
)
_SUMMARY = """,
sm AS (SELECT epoch, edge_type AS activity, CAST(coalesce(operator_id, 255) % 256 AS INTEGER) AS operator, src_worker AS src, CASE WHEN edge_type IN (8, 9, 10) THEN dst_worker ELSE src_worker END AS dst,
  CASE WHEN src_ts = epoch * W - 1 AND dst_ts = (epoch + 1) * W THEN 'B' WHEN src_ts = epoch * W - 1 THEN 'S' WHEN dst_ts = (epoch + 1) * W THEN 'E' ELSE 'N' END AS crosses,
  sum(bc) AS bc, sum(bc * (dst_ts - src_ts)) AS weighted_bc, count(*) AS count, CAST(sum(dst_ts - src_ts) AS BIGINT) AS weight FROM rk GROUP BY ALL)"""
_PATHCOUNT = """,
pc AS (SELECT who.epoch, CAST(coalesce(sum(rk.bc), 0) AS BIGINT) AS paths FROM who LEFT JOIN rk ON rk.epoch = who.epoch AND rk.src_worker = who.worker AND rk.src_ts = who.epoch * W - 1 GROUP BY who.epoch)"""
_WALK = """,
best AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY epoch, src_ts, src_worker ORDER BY dst_ts, dst_worker, edge_type, operator_id NULLS FIRST) = 1),
walk AS (SELECT best.epoch, CAST(0 AS BIGINT) AS step, best.src_ts, best.src_worker, best.dst_ts, best.dst_worker, best.edge_type, best.operator_id FROM best JOIN (SELECT epoch, min(worker) AS worker FROM who GROUP BY epoch) f ON best.epoch = f.epoch AND best.src_worker = f.worker AND best.src_ts = f.epoch * W - 1
  UNION ALL SELECT best.epoch, walk.step + 1, best.src_ts, best.src_worker, best.dst_ts, best.dst_worker, best.edge_type, best.operator_id FROM walk JOIN best ON best.epoch = walk.epoch AND best.src_ts = walk.dst_ts AND best.src_worker = walk.dst_worker)"""


def _sql(parts: str, select: str, insert: str = "true", window: str = _W, threshold: str = "60000000") -> str:
    body = f"WITH RECURSIVE {parts}\n{select}"
    for name, value in ((" W ", f" {window} "), (" W)", f" {window})"), (" W,", f" {window},"), ("INSERT", insert), (">= 60000000", f">= {threshold}")):
        body = body.replace(name, value)
    return body


_M = _TRACE + _MESSAGES
_P = _M + _PIECES
_T = _P + _TIMELINE
_G = _T + _GRAPH
_R = _G + _PATHS
_S = _R + _SUMMARY
_EDGE = ", ".join(EDGE)
_DEPTH = "sum(CASE event_type WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY local_worker, activity_type ORDER BY ts, seq)"
_SPANS = """SELECT worker, start, type, corr_id, fin AS "end", remote FROM (
  SELECT correlator_id AS corr_id, ts AS fin, event_type, CASE WHEN event_type = 4 THEN local_worker END AS remote,
    last_value(CASE WHEN event_type IN (1, 3) THEN local_worker END IGNORE NULLS) OVER b AS worker, last_value(CASE WHEN event_type IN (1, 3) THEN ts END IGNORE NULLS) OVER b AS start,
    last_value(CASE WHEN event_type IN (1, 3) THEN {name} END IGNORE NULLS) OVER b AS type
  FROM {rows} WHERE correlator_id IS NOT NULL WINDOW b AS (PARTITION BY correlator_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_type IN (2, 4) AND start IS NOT NULL"""
_INFERRED = """,
dd AS (SELECT *, sum(CASE event_type WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY local_worker, activity_type ORDER BY ts, seq) AS d FROM trace WHERE event_type IN (1, 2)),
inf AS (SELECT seq, ts, local_worker, activity_type, event_type, max(CASE event_type WHEN 1 THEN seq END) OVER (PARTITION BY local_worker, activity_type, CASE event_type WHEN 1 THEN d ELSE d + 1 END ORDER BY ts, seq) AS correlator_id FROM dd
  UNION ALL SELECT seq, ts, local_worker, activity_type, event_type, correlator_id FROM trace WHERE event_type IN (3, 4))"""
_NUMBERED = ", ".join(EDGE)

ORACLE_SQL = {
    # slots of 10,000 ticks: worker w is active for a slot after 2w slots and before the last 2w, the last one without a break
    "pyramid_trace": """SELECT t + v.off AS ts, w AS local_worker, 4 AS activity_type, v.e AS event_type, w AS operator_id FROM (
  SELECT 1000000000000000 + p * 130000 AS t, p * 130000 + 1000000000000000 + 129999 AS q, w FROM range(3) a(p), range(4) b(w)) x
  JOIN (VALUES (0, 0, 1), (0, 10000, 2), (0, 119999, 1), (0, 129999, 2), (1, 20000, 1), (1, 30000, 2), (1, 99999, 1), (1, 109999, 2),
    (2, 40000, 1), (2, 50000, 2), (2, 79999, 1), (2, 89999, 2), (3, 60000, 1), (3, 69999, 2)) v(k, off, e) ON v.k = w""",
    "pyramid_summary": """SELECT CAST(1000000 AS BIGINT) AS epoch, CAST(a AS INTEGER) AS activity, CAST(o AS INTEGER) AS operator, CAST(s AS BIGINT) AS src, CAST(d AS BIGINT) AS dst, c AS crosses,
  CAST(b AS DOUBLE) AS bc, CAST(wb AS DOUBLE) AS weighted_bc, CAST(1 AS BIGINT) AS count, CAST(w AS BIGINT) AS weight FROM (VALUES
  (4, 0, 0, 0, 'S', 2, 400000002, 200000001), (4, 0, 0, 0, 'E', 2, 400000002, 200000001), (5, 0, 0, 0, 'N', 1, 599999999, 599999999), (4, 1, 1, 1, 'N', 1, 199999999, 199999999),
  (12, 1, 1, 1, 'S', 0, 0, 400000001), (12, 1, 1, 1, 'E', 0, 0, 400000001), (10, 255, 0, 1, 'N', 1, 200000000, 200000000), (10, 255, 1, 0, 'N', 1, 200000000, 200000000)) t(a, o, s, d, c, b, wb, w)""",
    # a worker's activities never overlap here, so all are in the first lane; the last may be open
    "activity_lanes": _sql(_TRACE, """SELECT local_worker AS worker, CAST(0 AS BIGINT) AS lane, ts AS start, coalesce(stop, fin) AS stop, activity_type AS activity, operator_id FROM (
  SELECT *, lead(ts) OVER (PARTITION BY local_worker ORDER BY ts, seq) AS stop, max(ts) OVER (PARTITION BY local_worker) AS fin FROM trace WHERE event_type IN (1, 2)) WHERE event_type = 1"""),
    "trace_records": _sql(_TRACE, f"SELECT {', '.join(RECORD_COLUMNS)} FROM trace"),
    "epoch_counts": _sql(_TRACE, "SELECT epoch, count(*) AS n FROM e GROUP BY epoch"),
    "workers": _sql(_TRACE, "SELECT DISTINCT local_worker AS worker FROM trace"),
    "activity_dim_join": _sql(_TRACE, f"SELECT {_NAMES.format('activity_type')} AS name, activity_type NOT IN (8, 9, 10) AS local, count(*) AS n FROM trace GROUP BY ALL"),
    "message_delay_clip": _sql(_TRACE, f"SELECT r.seq, CASE WHEN r.event_type = 4 AND abs(r.ts - s.ts) > {DELAY} THEN s.ts + {DELAY} ELSE r.ts END AS ts, r.local_worker, r.event_type FROM trace r LEFT JOIN trace s ON r.event_type = 4 AND s.event_type = 3 AND s.local_worker = r.remote_worker AND s.correlator_id = r.correlator_id"),
    "message_edges": _sql(_M, f"SELECT status, {_EDGE} FROM m"),
    "message_halfedges": _sql(_M, "SELECT * FROM h"),
    "message_matched_only": _sql(_M, f"SELECT {_EDGE} FROM m WHERE status = 'matched'"),
    "message_unmatched_send": _sql(_M, f"SELECT {_EDGE} FROM m WHERE status = 'send'"),
    "message_unmatched_recv": _sql(_M, f"SELECT {_EDGE} FROM m WHERE status = 'receive'"),
    "message_latency_histogram": _sql(_TRACE, "SELECT (r.ts - s.ts) // 5000000 AS bucket, count(*) AS messages FROM trace s JOIN trace r ON s.correlator_id = r.correlator_id AND s.event_type = 3 AND r.event_type = 4 GROUP BY 1"),
    "duplicate_sends": _sql(_TRACE, "SELECT epoch, local_worker AS sender, CAST(NULL AS BIGINT) AS correlator_id, count(*) AS sends FROM e WHERE event_type = 3 GROUP BY epoch, local_worker HAVING count(*) > 1"),
    "local_activity_edges": _sql(_P, "SELECT epoch, worker, k1 AS src_ts, k2 AS dst_ts, activity, operator_id FROM pieces WHERE NOT rem"),
    "local_activity_edges_grouped": _sql(_P, "SELECT epoch, worker, k1 AS src_ts, k2 AS dst_ts, activity, operator_id FROM pieces WHERE NOT rem"),
    "worker_timeline": _sql(_T, f"SELECT {_EDGE} FROM tl"),
    "gap_fill_edges": _sql(_T, f"SELECT {_EDGE} FROM tl WHERE edge_type IN (11, 12)"),
    "waiting_edges": _sql(_T, f"SELECT {_EDGE} FROM tl WHERE edge_type = 12"),
    "no_insert_waiting_variant": _sql(_T, "SELECT epoch, edge_type, count(*) AS n, CAST(sum(dst_ts - src_ts) AS BIGINT) AS ticks FROM tl GROUP BY ALL", "false"),
    "start_end_nodes": _sql(_P, "SELECT epoch, 'START' AS kind, epoch * W - 1 AS ts, worker FROM who UNION ALL SELECT epoch, 'END', (epoch + 1) * W , worker FROM who"),
    "broken_chains": _sql(_P, "SELECT epoch, worker AS src_worker, k1 AS src_ts, k2 AS dst_ts, before FROM (SELECT *, lag(k2) OVER (PARTITION BY epoch, worker ORDER BY k1, k2) AS before FROM pieces WHERE NOT rem) WHERE before <> k1"),
    "pag_edges_traversal": _sql(_G, f"SELECT {_EDGE}, traverse FROM g"),
    "pag_stage_counts": _sql(_G, "SELECT a.epoch, a.n AS forward, a.n AS backward, b.n AS edges, 2 * a.n + b.n AS pag_output FROM (SELECT epoch, count(*) AS n FROM who GROUP BY 1) a JOIN (SELECT epoch, count(*) AS n FROM g GROUP BY 1) b ON a.epoch = b.epoch"),
    "delayed_message_block": _sql(_G, f"SELECT {_EDGE}, traverse FROM g WHERE traverse = 'Block' AND src_worker <> dst_worker"),
    "edge_betweenness": _sql(_R, f"SELECT {_EDGE}, bc FROM rk"),
    "edge_betweenness_waiting_one": _sql(_G + _PATHS_ONE, f"SELECT {_EDGE}, bc FROM rk"),
    "cp_summary_six_hours": _sql(_S, "SELECT * FROM sm", window=str(6 * HOUR)),
    "sweep_path_totals": " UNION ALL ".join(
        "SELECT * FROM (" + _sql(_G, f"SELECT CAST({w} AS BIGINT) AS window, CAST({t} AS BIGINT) AS threshold, count(DISTINCT epoch) AS epochs, count(*) AS edges, CAST(sum(dst_ts - src_ts) AS BIGINT) AS weight FROM g", window=str(w), threshold=str(t)) + ")"
        for w in (HOUR, 2 * HOUR) for t in (MINUTE, 5 * MINUTE)
    ),
    "path_counts": _sql(_R + _PATHCOUNT, "SELECT * FROM pc"),
    "cp_summary": _sql(_S, "SELECT * FROM sm"),
    "cp_normalized": _sql(_S + _PATHCOUNT, f"SELECT sm.epoch - (SELECT min(epoch) FROM pc) AS epoch, activity, operator, src, dst, crosses, bc, weighted_bc, count, weight, paths, CASE WHEN paths > 0 THEN weighted_bc / (paths * CAST({_W} AS DOUBLE)) ELSE 0 END AS normalized_bc, weight / CAST({_W} AS DOUBLE) AS normalized_weight, count / CAST(3600 AS DOUBLE) AS normalized_count FROM sm JOIN pc ON sm.epoch = pc.epoch"),
    "cp_top_activities": _sql(_S, "SELECT activity, operator, src, dst, sum(weighted_bc) AS weighted_bc FROM sm GROUP BY ALL ORDER BY weighted_bc DESC, activity, operator, src, dst LIMIT 20"),
    "cp_by_operator_pivot": _sql(_S, "SELECT operator, " + ", ".join(f"coalesce(sum(weighted_bc) FILTER (activity = {a}), 0) AS a{a}" for a in (2, 3, 4, 6)) + " FROM sm WHERE src = dst AND activity IN (2, 3, 4, 6) GROUP BY operator"),
    "cp_mean_by_worker": _sql(_S, "SELECT src, avg(bc) AS mean_bc, avg(weight) AS mean_weight FROM (SELECT src, epoch, sum(bc) AS bc, sum(weight) AS weight FROM sm WHERE src = dst GROUP BY ALL) GROUP BY src"),
    "waiting_share_per_worker": _sql(_T, "SELECT src_worker AS worker, CAST(coalesce(sum(dst_ts - src_ts) FILTER (edge_type = 12), 0) AS BIGINT) AS waiting, CAST(sum(dst_ts - src_ts) AS BIGINT) AS ticks, CAST(coalesce(sum(dst_ts - src_ts) FILTER (edge_type = 12), 0) AS DOUBLE) / CAST(sum(dst_ts - src_ts) AS DOUBLE) AS share FROM tl GROUP BY src_worker"),
    "cdf_weight": _sql(_T, "SELECT DISTINCT edge_type, CAST(dst_ts - src_ts AS DOUBLE) AS value, cume_dist() OVER (PARTITION BY edge_type ORDER BY dst_ts - src_ts) AS share FROM tl"),
    "quantile_weight": _sql(_T, "SELECT edge_type, " + ", ".join(f"round(quantile_cont(CAST(dst_ts - src_ts AS DOUBLE), {q}), 1) AS q{i}" for i, q in enumerate((0.5, 0.95, 0.99))) + " FROM tl GROUP BY edge_type"),
    "zero_filled_product": _sql(_T, "SELECT a.epoch, b.worker, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT epoch FROM tl WHERE edge_type = 12) a CROSS JOIN (SELECT DISTINCT src_worker AS worker FROM tl WHERE edge_type = 12) b LEFT JOIN (SELECT epoch, src_worker AS worker, count(*) AS n FROM tl WHERE edge_type = 12 GROUP BY ALL) c ON a.epoch = c.epoch AND b.worker = c.worker"),
    "trace_quality_double_start": _sql(_TRACE, "SELECT seq, CAST(0 AS BIGINT) AS local_worker, activity_type, depth FROM (SELECT seq, activity_type, CAST(sum(CASE event_type WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY activity_type ORDER BY ts, seq) AS BIGINT) AS depth FROM trace WHERE event_type IN (1, 2)) WHERE depth NOT IN (0, 1)"),
    "trace_quality_underflow": _sql(_TRACE, "SELECT * FROM (SELECT seq, local_worker, activity_type, CAST(sum(CASE event_type WHEN 2 THEN 1 ELSE -1 END) OVER (PARTITION BY local_worker, activity_type ORDER BY ts, seq) AS BIGINT) AS depth FROM trace WHERE event_type IN (1, 2)) WHERE depth < 0"),
    "trace_quality_max_nesting": _sql(_TRACE, "SELECT local_worker AS worker, CAST(max(d) AS BIGINT) AS max_depth, CAST(0 AS BIGINT) AS misnested FROM (SELECT local_worker, sum(CASE event_type WHEN 1 THEN 1 ELSE -1 END) OVER (PARTITION BY local_worker ORDER BY ts, seq) AS d FROM trace WHERE event_type IN (1, 2)) GROUP BY 1"),
    "infer_correlators": _sql(_TRACE + _INFERRED, "SELECT seq, correlator_id FROM inf"),
    "chrome_events": _sql(_TRACE, f"SELECT seq, v.place, v.ph, {_NAMES.format('activity_type')} AS name, ts, 0 AS pid, local_worker AS tid, CASE WHEN v.ph IN ('s', 't') THEN correlator_id END AS id, CASE event_type WHEN 1 THEN 'Start' WHEN 2 THEN 'End' WHEN 3 THEN 'Sent' ELSE 'Received' END AS event FROM trace JOIN (VALUES (1, 0, 'B'), (2, 0, 'E'), (3, 0, 'B'), (3, 1, 's'), (3, 2, 'E'), (4, 0, 'B'), (4, 1, 't'), (4, 2, 'E')) v(e, place, ph) ON v.e = event_type"),
    "span_join": _sql(_TRACE, _SPANS.format(name=_NAMES.format("activity_type"), rows="trace")),
    "span_join_infer": _sql(_TRACE + _INFERRED, _SPANS.format(name=_NAMES.format("activity_type"), rows="inf")),
    "pag_as_trace": _sql(_G, "SELECT epoch, n * 2 + v.i AS seq, CASE v.i WHEN 0 THEN src_ts ELSE dst_ts END AS ts, CASE v.i WHEN 0 THEN src_worker ELSE dst_worker END AS local_worker, edge_type AS activity_type, CASE WHEN edge_type IN (8, 9, 10) THEN 3 + v.i ELSE 1 + v.i END AS event_type, n AS correlator_id, CASE v.i WHEN 0 THEN dst_worker ELSE src_worker END AS remote_worker, operator_id FROM (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY src_ts, src_worker, dst_ts, dst_worker, edge_type, operator_id NULLS FIRST) AS n FROM g) CROSS JOIN (VALUES (0), (1)) v(i)"),
    "pag_dot_lines": _sql(_G, f"""SELECT epoch, CASE WHEN src_worker = dst_worker THEN 1 ELSE 2 END AS part, CASE WHEN src_worker = dst_worker THEN src_worker ELSE 0 END AS worker, src_ts AS k,
    '"' || src_ts || '@' || src_worker || '" -> "' || dst_ts || '@' || dst_worker || '" [label="' || {_NAMES.format('edge_type')} || '"];' AS value FROM g
  UNION ALL SELECT DISTINCT epoch, 1, src_worker, v.k, CASE WHEN v.k < 0 THEN 'subgraph cluster' || src_worker || ' {{ label="w' || src_worker || '";' ELSE '}}' END FROM g, (VALUES (-4611686018427387904), (4611686018427387904)) v(k) WHERE src_worker = dst_worker
  UNION ALL SELECT DISTINCT epoch, v.part, 0, 0, v.line FROM g, (VALUES (0, 'digraph pag {{'), (3, '}}')) v(part, line)"""),
    "summary_text": _sql(_S, "SELECT 'SUMMARY ' || concat_ws(',', epoch, activity, operator, src, dst, crosses, CAST(bc AS BIGINT), CAST(weighted_bc AS BIGINT), count, weight) AS value FROM sm"),
    "single_path": _sql(_G + _WALK, "SELECT * FROM walk"),
    "single_path_summary": _sql(_G + _WALK, "SELECT epoch, edge_type AS activity, CAST(coalesce(operator_id, 255) % 256 AS INTEGER) AS operator, count(*) AS bc, CAST(sum(dst_ts - src_ts) AS BIGINT) AS weighted_bc, count(*) AS count, CAST(sum(dst_ts - src_ts) AS BIGINT) AS weight FROM walk GROUP BY ALL"),
    "path_summary_text": _sql(_G + _WALK, "SELECT concat_ws(' ', 'SP_SUMMARY', epoch, 0, edge_type, CAST(coalesce(operator_id, 255) % 256 AS INTEGER), count(*), CAST(sum(dst_ts - src_ts) AS BIGINT), count(*), CAST(sum(dst_ts - src_ts) AS BIGINT)) AS value FROM walk GROUP BY epoch, edge_type, CAST(coalesce(operator_id, 255) % 256 AS INTEGER)"),
    "count_text": _sql(_M, "SELECT concat_ws(' ', 'COUNT', epoch, 0, 'records', count(*)) AS value FROM e GROUP BY epoch UNION ALL SELECT concat_ws(' ', 'COUNT', epoch, 0, 'messages', count(*)) FROM m GROUP BY epoch"),
    "epochs_mapped": _sql(_TRACE, "SELECT epoch, count(*) AS records, count(DISTINCT local_worker) AS workers, min(ts) AS first FROM e GROUP BY epoch"),
}
