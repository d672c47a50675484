"""The engine: generated scenarios with known rankings, hand-made edge cases, and window against grouped plans."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.functions.capacity import CAPACITIES, capacity, routing_hash
from critpath.operators import messages, pag, prep, rank, summary, timeline
from critpath.plans.pipeline import Analysis
from critpath.schema import (
    BARRIER_PROCESSING,
    BUFFER,
    CONTROL_MESSAGE,
    DATA_MESSAGE,
    DESERIALIZATION,
    END,
    PROCESSING,
    RECEIVED,
    RECORD,
    SENT,
    SERIALIZATION,
    START,
    UNKNOWN,
    WAITING,
)
from critpath.sources.synth import Pyramid, pyramid

SECOND = 1_000_000_000
CONFIG = Config(window=SECOND, threshold=1000)


def trace(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RECORD)


def ranks(spark, **shape):
    """{epoch: {(activity, operator): bc}} of a generated trace; epochs count from 0."""
    run = Analysis.of(pyramid(spark, Pyramid(**shape)), CONFIG)
    out = {}
    for r in run.summaries.groupBy("epoch", "activity", "operator").agg(F.sum("bc").alias("bc")).collect():
        out.setdefault(r.epoch - 1_000_000, {})[r.activity, r.operator] = r.bc
    return out


def test_golden_summary(spark):
    run = Analysis.of(pyramid(spark, Pyramid(workers=2, phase=SECOND, infix=BARRIER_PROCESSING)), CONFIG)
    rows = sorted(tuple(r)[1:] for r in run.summaries.collect())
    assert rows == sorted([
        (4, 0, 0, 0, "S", 2.0, 400000002.0, 1, 200000001), (4, 0, 0, 0, "E", 2.0, 400000002.0, 1, 200000001), (5, 0, 0, 0, "N", 1.0, 599999999.0, 1, 599999999),
        (4, 1, 1, 1, "N", 1.0, 199999999.0, 1, 199999999), (12, 1, 1, 1, "S", 0.0, 0.0, 1, 400000001), (12, 1, 1, 1, "E", 0.0, 0.0, 1, 400000001),
        (10, 255, 0, 1, "N", 1.0, 200000000.0, 1, 200000000), (10, 255, 1, 0, "N", 1.0, 200000000.0, 1, 200000000),
    ])
    assert run.paths.first().paths == 2


def test_lowest_activity(spark):
    got = ranks(spark, workers=5, phase=998_000_000, send=None, receive=None)[0]
    assert got[PROCESSING, 0] == 3 and all(got[PROCESSING, w] == 0 for w in range(1, 5))


def test_ends_in_a_receive(spark):
    got = ranks(spark, workers=4, phases=2, phase=500_000_000, receive=None, suffix=PROCESSING)[0]
    assert not any(a == UNKNOWN for a, _ in got)


def test_gaps_are_unknown(spark):
    got = ranks(spark, workers=2, phase=SECOND, send=None, receive=None, infix=None)[0]
    assert got[PROCESSING, 0] == 2 and got[UNKNOWN, 255] == 1


def test_one_path(spark):
    got = ranks(spark, workers=5, phase=SECOND, infix=WAITING)[0]
    assert got[PROCESSING, 4] == 1
    assert all(bc == 2 for (a, w), bc in got.items() if a != WAITING and w < 4)


def test_forest(spark):
    got = ranks(spark, workers=5, phases=10, phase=SECOND, infix=BUFFER)
    assert len([e for e in got if 0 <= e < 10]) == 10
    assert all(got[e][PROCESSING, 0] == 10 for e in range(10))


def test_tree(spark):
    got = ranks(spark, workers=5, phase=SECOND, infix=BUFFER)[0]
    assert got[PROCESSING, 4] == 1 and all(got[PROCESSING, w] == 2 * (5 - w) for w in range(4))
    assert all(got[BUFFER, w] == 1 for w in range(4))


@pytest.mark.parametrize("length", [1, 3])
def test_symmetry(spark, length):
    got = ranks(spark, workers=10, phase=length * SECOND, infix=BUFFER, prefix=SERIALIZATION, suffix=DESERIALIZATION)
    first, last = got[0], got[length - 1]
    for w in range(1, 10):
        assert first.get((SERIALIZATION, w), 0) == last.get((DESERIALIZATION, w), 0)


def test_generic_graph(spark):
    rows = [(None, (1, 0)), ((1, 0), (2, 0)), ((2, 0), (3, 1)), ((2, 0), (4, 0)), ((3, 1), (4, 0)), ((4, 0), (5, 0)), ((5, 0), None)]
    schema = "graph int, src struct<id:int,worker:int>, dst struct<id:int,worker:int>"
    got = rank.explore(spark.createDataFrame([(1, a, b) for a, b in rows], schema)).collect()
    assert {(r.src.id, r.dst.id): r.bc for r in got} == {(1, 2): 2, (2, 3): 1, (2, 4): 1, (3, 4): 1, (4, 5): 2}


def test_overlap_goes_to_the_grouped_plan(spark):
    """A[0,2], B[1,3]: when A ends B is dropped, and B's end has no start any more."""
    t = trace(spark, [(100, 0, BUFFER, START, None, None, 1), (200, 0, PROCESSING, START, None, None, 2), (300, 0, BUFFER, END, None, None, 1), (400, 0, PROCESSING, END, None, None, 2)])
    sliced = prep.with_epoch(t, 1000)
    pieces = timeline.pieces(sliced, messages.pair(sliced, 1000).halves, 1000).filter("not is_remote").orderBy("k1").collect()
    assert [(p.k1, p.k2, p.activity, p.operator_id) for p in pieces] == [(100, 200, BUFFER, 1), (200, 300, BUFFER, 1), (300, 400, PROCESSING, 2)]


def random_trace(seed, overlap):
    r, rows, stacks = random.Random(seed), [], {0: [], 1: []}
    for ts in sorted(r.randint(0, 3999) for _ in range(80)):
        w = r.randint(0, 1)
        kind = r.random()
        if kind < 0.4:
            a = r.choice([BUFFER, PROCESSING, SERIALIZATION])
            stacks[w].append(a)
            rows.append((ts, w, a, START, None, None, r.randint(0, 5)))
        elif kind < 0.8:
            a = stacks[w].pop() if stacks[w] and not overlap else r.choice([BUFFER, PROCESSING, SERIALIZATION])
            rows.append((ts, w, a, END, None, None, r.randint(0, 5)))
        else:
            rows.append((ts, w, DATA_MESSAGE, r.choice([SENT, RECEIVED]), r.randint(0, 9), 1 - w, None))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_plans_agree(spark, seed):
    sliced = prep.with_epoch(trace(spark, random_trace(seed, overlap=seed % 2 == 1)), 1000)
    halves = messages.pair(sliced, 1000).halves
    got = {m: sorted(map(str, timeline.pieces(sliced, halves, 1000, m).select("epoch", "worker", "k1", "k2", "is_remote", "activity", "operator_id", "event_type").collect())) for m in ("auto", "grouped")}
    assert got["auto"] == got["grouped"]
    edges = timeline.connected(timeline.pieces(sliced, halves, 1000), 20, True)
    assert timeline.broken_chains(edges).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_makes_the_same_graph_as_its_parts(spark, seed):
    """Chains, messages and ends made one by one and united; every second trace has overlaps."""
    t = trace(spark, random_trace(20 + seed, overlap=seed % 2 == 1))
    sliced = prep.with_epoch(t, 1000)
    paired = messages.pair(sliced, 1000)
    local = timeline.connected(timeline.pieces(sliced, paired.halves, 1000), 20, True)
    remote = paired.edges.drop("status").filter("src_worker <> dst_worker or src_ts < dst_ts")
    graph = pag.construct(t, Config(window=1000, threshold=20, waiting_message=300)).cache()
    got = sorted(map(str, pag.edges(graph).drop("kind").select(*pag.annotated(local, 300).columns).collect()))
    assert got == sorted(map(str, pag.annotated(local.unionByName(remote), 300).collect()))
    ends = sorted((r.epoch, r.kind, r.ts, r.worker) for r in timeline.chain_ends(sliced, paired.halves, 1000).collect())
    found = [(r.epoch, r.kind, r.dst_ts, r.dst_worker) for r in pag.start_nodes(graph).collect()] + [(r.epoch, r.kind, r.src_ts, r.src_worker) for r in pag.end_nodes(graph).collect()]
    assert sorted(found) == ends
    if seed % 2 == 0:
        nested = pag.construct(t, Config(window=1000, threshold=20, waiting_message=300, nested=True))
        assert sorted(map(str, nested.collect())) == sorted(map(str, graph.collect()))


def test_strict_graphs_refuse_bad_messages(spark):
    rows = [(10, 0, DATA_MESSAGE, SENT, 1, 1, None), (20, 1, CONTROL_MESSAGE, RECEIVED, 1, 0, None)]
    with pytest.raises(Exception, match="the two ends of a message differ"):
        pag.construct(trace(spark, rows), Config(window=1000, threshold=1, strict=True)).collect()


def test_paths_into_the_ends_are_as_many(spark):
    graph = pag.construct(trace(spark, random_trace(11, False)), Config(window=1000, threshold=5))
    ranked = rank.betweenness(graph).filter("not isnan(bc)").cache()
    out = graph.filter("kind = 'END'").select("epoch", F.col("src_ts").alias("dst_ts"), F.col("src_worker").alias("dst_worker")).join(ranked, ["epoch", "dst_ts", "dst_worker"]).groupBy("epoch").agg(F.sum("bc").alias("n"))
    into = {r.epoch: r.n for r in out.collect()}
    paths = {r.epoch: r.paths for r in rank.path_counts(rank.betweenness(graph), graph).collect()}
    if rank.unsettled(rank.betweenness(graph)).count() == 0:
        assert {e: n for e, n in paths.items() if n} == {e: n for e, n in into.items() if n}


def test_levels_are_the_same(spark):
    graph = pag.construct(pyramid(spark, Pyramid(workers=3, phase=SECOND, infix=BUFFER)), CONFIG).cache()
    key = lambda r: (r.src_ts, r.src_worker, r.dst_ts, r.dst_worker, r.bc)
    assert sorted(map(key, rank.levels(graph).collect())) == sorted(map(key, rank.betweenness(graph).collect()))


def test_messages(spark):
    rows = [
        (10, 0, DATA_MESSAGE, SENT, 1, 1, 7), (20, 1, DATA_MESSAGE, RECEIVED, 1, 0, None), (30, 2, DATA_MESSAGE, RECEIVED, 1, 0, None),  # a broadcast
        (950, 0, CONTROL_MESSAGE, SENT, 2, 1, None), (1010, 1, CONTROL_MESSAGE, RECEIVED, 2, 0, None),  # across epochs
        (40, 0, DATA_MESSAGE, SENT, 3, None, None),  # to nobody known
        (50, 0, DATA_MESSAGE, SENT, None, 1, None), (60, 1, DATA_MESSAGE, RECEIVED, None, 0, None),  # no correlator
    ]
    sliced = prep.with_epoch(trace(spark, rows), 1000)
    paired = messages.pair(sliced, 1000)
    got = sorted((r.epoch, r.status, r.src_ts, r.src_worker, r.dst_ts, r.dst_worker, r.operator_id) for r in paired.edges.collect())
    assert got == [(0, "matched", 10, 0, 20, 1, 7), (0, "matched", 10, 0, 30, 2, 7), (0, "matched", 50, 0, 60, 1, None), (0, "send", 950, 0, 1000, 1, None), (1, "receive", 999, 0, 1010, 1, None)]
    halves = sorted((r.epoch, r.ts, r.local_worker, r.remote_worker, r.event_type) for r in paired.halves.collect())
    assert halves == [(0, 1000, 1, 0, SENT), (1, 999, 0, 1, RECEIVED)]


def test_bad_messages(spark):
    rows = [(10, 0, DATA_MESSAGE, SENT, 1, 1, None), (11, 0, DATA_MESSAGE, SENT, 1, 1, None), (20, 1, CONTROL_MESSAGE, RECEIVED, 1, 0, None)]
    sliced = prep.with_epoch(trace(spark, rows), 1000)
    assert messages.duplicate_sends(sliced).first().sends == 2
    assert messages.mismatched(sliced).count() == 1
    with pytest.raises(Exception, match="the two ends of a message differ"):
        messages.pair(sliced, 1000, strict=True).edges.collect()


def test_own_checks_of_pairs(spark):
    rows = [(10, 0, DATA_MESSAGE, SENT, 1, 1, None), (20, 1, DATA_MESSAGE, RECEIVED, 1, 0, None), (30, 0, DATA_MESSAGE, SENT, 2, 1, None)]
    sliced = prep.with_epoch(trace(spark, rows), 1000)
    assert messages.pair(sliced, 1000, check=lambda s, r: s["ts"] <= r["ts"]).edges.count() == 2
    with pytest.raises(Exception, match="fails its check"):
        messages.pair(sliced, 1000, check=lambda s, r: s["ts"] > r["ts"]).edges.collect()


def test_capacities(spark):
    rows = spark.createDataFrame([("Block", 5.0), ("Unbounded", 5.0)], "t string, v double")
    got = {n: [r[0] for r in rows.select(capacity(n, F.col("t"), F.col("v"))).collect()] for n in CAPACITIES}
    assert got == {"no_waiting": [0.0, 5.0], "waiting_one": [1.0, 5.0], "unbound": [5.0, 5.0]}
    for n, (factor, plus) in ((n, f(np.array(["Block", "Unbounded"], object))) for n, f in CAPACITIES.items()):
        assert (factor * 5.0 + plus).tolist() == got[n]
    assert rows.select(routing_hash("t")).distinct().count() == 2


def test_received_before_sent_is_reported(spark):
    rows = [(100, 0, PROCESSING, START, None, None, 0), (200, 0, DATA_MESSAGE, RECEIVED, 1, 1, None), (300, 1, DATA_MESSAGE, SENT, 1, 0, None), (250, 0, DATA_MESSAGE, SENT, 2, 1, None), (280, 1, DATA_MESSAGE, RECEIVED, 2, 0, None)]
    ranked = rank.betweenness(pag.construct(trace(spark, rows), Config(window=1000, threshold=0)))
    assert rank.unsettled(ranked).count() > 0
    assert summary.summarise(ranked, 1000).filter("isnan(bc)").count() == 0


@pytest.mark.parametrize(("gap", "threshold", "kinds"), [(5, 5, [UNKNOWN]), (4, 5, []), (0, 5, [])])
def test_gaps_at_the_threshold(spark, gap, threshold, kinds):
    rows = [(-1 + 1, 0, PROCESSING, START, None, None, 0), (100, 0, PROCESSING, END, None, None, 0), (100 + gap, 0, BUFFER, START, None, None, 0), (999, 0, BUFFER, END, None, None, 0)]
    edges = pag.edges(pag.construct(trace(spark, rows), Config(window=1000, threshold=threshold))).filter("src_ts >= 100 and dst_ts <= 105").collect()
    assert [e.edge_type for e in edges if e.edge_type == UNKNOWN] == kinds


def test_late_messages_block_unless_awaited(spark):
    rows = [(10, 0, DATA_MESSAGE, SENT, 1, 1, None), (0, 1, PROCESSING, START, None, None, 0), (100, 1, PROCESSING, END, None, None, 0), (500, 1, DATA_MESSAGE, RECEIVED, 1, 0, None)]
    graph = lambda insert: pag.edges(pag.construct(trace(spark, rows), Config(window=1000, threshold=1, waiting_message=100, insert_waiting=insert))).filter("src_worker <> dst_worker").first().traverse
    assert graph(False) == "Block" and graph(True) == "Unbounded"


def test_clipping_uses_the_last_send_and_its_first_receive(spark):
    rows = [(10, 0, DATA_MESSAGE, SENT, 1, 1, None), (20, 0, DATA_MESSAGE, SENT, 1, 1, None), (500, 1, DATA_MESSAGE, RECEIVED, 1, 0, None), (600, 1, DATA_MESSAGE, RECEIVED, 1, 0, None), (5, 1, PROCESSING, START, None, None, None)]
    got = [r.ts for r in prep.clip_message_delay(trace(spark, rows), 100).orderBy("seq").collect()]
    assert got == [10, 20, 120, 600, 5]


def test_inferred_correlators(spark):
    rows = [(1, 0, BUFFER, START, None, None, None), (2, 0, BUFFER, START, None, None, None), (3, 0, PROCESSING, START, 77, None, None), (4, 0, BUFFER, END, None, None, None), (5, 0, BUFFER, END, None, None, None)]
    got = [r.correlator_id for r in prep.infer_correlators(trace(spark, rows)).orderBy("seq").collect()]
    assert got == [0, 1, 77, 1, 0]


def test_quality(spark):
    good = [(1, 0, BUFFER, START, None, None, None), (2, 0, PROCESSING, START, None, None, None), (3, 0, PROCESSING, END, None, None, None), (4, 0, BUFFER, END, None, None, None)]
    bad = [*good, (5, 0, BUFFER, START, None, None, None), (6, 0, BUFFER, START, None, None, None), (7, 0, PROCESSING, END, None, None, None)]
    assert prep.double_starts(trace(spark, good)).count() == 0 and prep.nesting(trace(spark, good)).first() == Row(worker=0, max_depth=2, misnested=0)
    assert prep.double_starts(trace(spark, bad)).count() == 2 and prep.underflows(trace(spark, bad)).count() == 1
    assert prep.nesting(trace(spark, bad)).first().misnested == 1


def test_empty_trace(spark):
    run = Analysis.of(spark.createDataFrame([], RECORD), CONFIG)
    assert run.summaries.count() == 0 and run.paths.count() == 0 and run.path_summaries().count() == 0


def test_single_path_walks_to_an_end(spark):
    graph = pag.construct(pyramid(spark, Pyramid(workers=4, phase=SECOND, infix=BUFFER)), CONFIG)
    for pick in ("random", "first"):
        steps = rank.single_path(graph, 3, pick).filter("epoch = 1000000").orderBy("step").collect()
        assert all((a.dst_ts, a.dst_worker) == (b.src_ts, b.src_worker) for a, b in zip(steps, steps[1:], strict=False))
        assert steps[-1].dst_ts == 1_000_001 * SECOND
    assert rank.seed_nodes(graph).filter("epoch = 1000000").count() == 1


def test_both_ways_to_normalise(spark):
    run = Analysis.of(trace(spark, random_trace(3, False)), Config(window=1000, threshold=5))
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    once, joined = run.normalised(1000), summary.normalised(run.summaries, run.paths, 1000, 1000)
    assert key(once) == key(joined.select(*once.columns)) and once.count()


def test_analytics(spark):
    rows = spark.createDataFrame([(0, "a", 1.0), (0, "b", None), (1, "a", float("nan")), (1, "a", 3.0)], "epoch long, k string, v double")
    assert [(r.value, r.share) for r in summary.cdf(rows, "v").orderBy("value").collect()] == [(0.0, 0.5), (1.0, 0.75), (3.0, 1.0)]
    full = summary.zero_filled(rows.groupBy("epoch", "k").agg(F.count("*").alias("n")), ["epoch", "k"], ["n"])
    assert sorted(map(tuple, full.collect())) == [(0, "a", 1), (0, "b", 1), (1, "a", 2), (1, "b", 0)]
    both = summary.concatenated({"x": rows, "y": rows.drop("v")})
    assert both.groupBy("experiment").count().count() == 2
    epochs = spark.createDataFrame([("r", 0, 0, 2_000_000_000), ("r", 1, 1, 6_000_000_000)], "run string, epoch long, input long, summary long")
    events = spark.createDataFrame([("r", 0, 30), ("r", 1, 30)], "run string, epoch long, n long")
    assert summary.epoch_latency(epochs).orderBy("epoch").first().delta_t == 2_000_000_000
    t = summary.throughput(epochs, events, ["run"]).first()
    assert (t.median, t["mean"], t["sum"], t.events_per_second) == (3.0, 3.0, 6.0, 10.0)
    named = summary.by_receiver(spark.createDataFrame([(1,), (2,)], "dst long"), spark.createDataFrame([(1, "bolt")], "worker long, component string"))
    assert {r.dst: r.component_dst for r in named.collect()} == {1: "bolt", 2: None}
