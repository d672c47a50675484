"""Ranking: how many paths run through each edge, path counts and single paths.

An epoch is one acyclic graph. Values spread from the start nodes along the edges and from the end nodes against
them; a node passes on the sum of what it got once all its edges have delivered. The number of paths through an edge is
the product of both values. Epochs are independent, so they are the unit of distribution (grouped, in memory as
arrays); levels() does the same with one DataFrame step for each level, for graphs that fit in no one task.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.functions.capacity import CAPACITIES
from critpath.schema import PAG_COLUMNS

_NODES = "epoch long, kind string, src_ts long, src_worker long, dst_ts long, dst_worker long, edge_type int, operator_id long, traverse string"
RANKED = _NODES + ", bc double"


def spread(n: int, src: np.ndarray, dst: np.ndarray, seeds: np.ndarray, factor: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """Value of each edge: factor * (sum at its source) + plus, in topological order. seeds: nodes that get 1 from
    outside, as often as they are listed. Nodes that not all edges reach never pass anything on; their edges get nan."""
    waiting = np.bincount(dst, minlength=n) + np.bincount(seeds, minlength=n)
    total = np.zeros(n)
    value = np.full(len(src), np.nan)
    order = np.argsort(src, kind="stable")
    first = np.searchsorted(src[order], np.arange(n + 1))
    to, f, p, out = dst[order].tolist(), factor[order].tolist(), plus[order].tolist(), order.tolist()
    waiting, total, first = waiting.tolist(), total.tolist(), first.tolist()
    ready = []
    for s in seeds.tolist():
        total[s] += 1.0
        waiting[s] -= 1
        if not waiting[s]:
            ready.append(s)
    while ready:
        node = ready.pop()
        amount = total[node]
        for k in range(first[node], first[node + 1]):
            v = f[k] * amount + p[k]
            value[out[k]] = v
            total[to[k]] += v
            waiting[to[k]] -= 1
            if not waiting[to[k]]:
                ready.append(to[k])
    return value


#: Epochs that one call handles together (as separate parts of one graph), so that small epochs cost little each.
EPOCHS_PER_TASK = 32


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct rows of columns."""
    order = np.lexsort(columns)
    fresh = np.zeros(len(order), bool)
    for c in columns:
        fresh[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def _epochs_ranked(capacity: str):
    def run(group: pa.Table) -> pa.Table:
        kind = group["kind"].to_numpy(zero_copy_only=False)
        is_edge, is_start, is_end = (kind == k for k in ("EDGE", "START", "END"))
        column = lambda name: group[name].fill_null(0).to_numpy()
        epoch, lead, tail = column("epoch"), ~is_start, ~is_end
        # every row that has a source, then every row that has a destination
        node = _numbered(*(np.concatenate((a[lead], b[tail])) for a, b in ((epoch, epoch), (column("src_ts"), column("dst_ts")), (column("src_worker"), column("dst_worker")))))
        src, dst = np.full(len(kind), -1), np.full(len(kind), -1)
        src[lead], dst[tail] = node[: lead.sum()], node[lead.sum() :]
        n = int(node.max(initial=-1)) + 1
        factor, plus = CAPACITIES[capacity](group["traverse"].to_numpy(zero_copy_only=False)[is_edge])
        forward = spread(n, src[is_edge], dst[is_edge], dst[is_start], factor, plus)
        backward = spread(n, dst[is_edge], src[is_edge], src[is_end], factor, plus)
        return group.filter(pa.array(is_edge)).append_column("bc", pa.array(forward * backward, pa.float64(), from_pandas=False))

    return run


def betweenness(pag: DataFrame, capacity: str = "no_waiting") -> DataFrame:
    """The edges with bc, the number of paths through each; nan for edges that paths can't settle (unsettled has them)."""
    return pag.select(*PAG_COLUMNS).groupBy(F.expr(f"epoch div {EPOCHS_PER_TASK}")).applyInArrow(_epochs_ranked(capacity), RANKED)


def unsettled(ranked: DataFrame) -> DataFrame:
    """Edges in cycles or without a way to both ends: messages received before they were sent."""
    return ranked.filter(F.isnan("bc"))


def levels(pag: DataFrame, max_levels: int | None = None) -> DataFrame:
    """The same as betweenness(no_waiting), level by level with DataFrames; each level is stored in the checkpoint folder.

    It goes on until no node is left to settle; more levels than max_levels, if given, are an error."""
    edges = pag.filter("kind = 'EDGE'").withColumn("id", F.xxhash64(*PAG_COLUMNS)).withColumns({"a": F.struct("epoch", F.col("src_ts").alias("ts"), F.col("src_worker").alias("worker")), "b": F.struct("epoch", F.col("dst_ts").alias("ts"), F.col("dst_worker").alias("worker"))})
    _with_checkpoints(pag.sparkSession)
    merged = edges.groupBy("id", "a", "b", "traverse", *[c for c in PAG_COLUMNS if c != "traverse"]).agg(F.count("*").alias("copies")).checkpoint()

    def passed(seed: DataFrame, a: str, b: str) -> DataFrame:
        degree = merged.groupBy(F.col(b).alias("node")).agg(F.sum("copies").alias("n")).unionByName(seed.groupBy("node").agg(F.count("*").alias("n"))).groupBy("node").agg(F.sum("n").alias("need"))
        got = seed.select("node", F.lit(1).cast("long").alias("n"), F.lit(1.0).alias("v"))
        done, found = None, None
        for level in count():
            state = got.groupBy("node").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
            full = state.join(degree, "node").filter("n = need").select("node", "v")
            fresh = (full if done is None else full.join(done, "node", "left_anti")).checkpoint()
            if fresh.isEmpty():
                break
            if level == max_levels:
                raise ValueError(f"the graph has more than {max_levels} levels")
            out = merged.join(fresh, merged[a] == fresh["node"]).select("id", F.col(b).alias("node"), "copies", F.when(F.col("traverse") == "Block", 0.0).otherwise(F.col("v")).alias("v")).checkpoint()
            values = out.select("id", "v")
            found = values if found is None else found.unionByName(values)
            done = fresh.select("node") if done is None else done.unionByName(fresh.select("node")).checkpoint()
            got = state.unionByName(out.select("node", F.col("copies").alias("n"), (F.col("v") * F.col("copies")).alias("v"))).checkpoint()
        return found

    at = lambda c: F.struct("epoch", F.col(f"{c}_ts").alias("ts"), F.col(f"{c}_worker").alias("worker")).alias("node")
    forward = passed(pag.filter("kind = 'START'").select(at("dst")), "a", "b").withColumnRenamed("v", "f")
    backward = passed(pag.filter("kind = 'END'").select(at("src")), "b", "a").withColumnRenamed("v", "g")
    return edges.join(forward, "id", "left").join(backward, "id", "left").select(*PAG_COLUMNS, F.coalesce(F.col("f") * F.col("g"), F.lit(float("nan"))).alias("bc"))


def _with_checkpoints(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))


def path_counts(ranked: DataFrame, pag: DataFrame) -> DataFrame:
    """epoch, paths: whole numbers of paths that leave the start nodes, 0 for epochs without one."""
    first = pag.filter("kind = 'START'").select("epoch", F.col("dst_ts").alias("src_ts"), F.col("dst_worker").alias("src_worker"))
    sums = first.join(ranked.select("epoch", "src_ts", "src_worker", F.nanvl("bc", F.lit(0.0)).cast("long").alias("n")), ["epoch", "src_ts", "src_worker"], "left")
    return sums.groupBy("epoch").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("paths"))


def path_counts_at_start(ranked: DataFrame, window: int) -> DataFrame:
    """The same as path_counts from ranked edges alone: start nodes are at the tick before an epoch, so the graph isn't built again."""
    leaving = F.col("src_ts") == F.col("epoch") * window - 1
    return ranked.groupBy("epoch").agg(F.coalesce(F.sum(F.when(leaving, F.nanvl("bc", F.lit(0.0)).cast("long"))), F.lit(0)).cast("long").alias("paths"))


def seed_nodes(pag: DataFrame, seed: int = 0) -> DataFrame:
    """One start node of each epoch, by hash."""
    node = F.struct(F.col("dst_ts").alias("ts"), F.col("dst_worker").alias("worker"))
    return pag.filter("kind = 'START'").groupBy("epoch").agg(F.min_by(node, F.struct(F.xxhash64(F.lit(seed), "epoch", "dst_ts", "dst_worker").alias("h"), node.alias("n"))).alias("n")).select("epoch", "n.ts", "n.worker")


WALK = "epoch long, step long, src_ts long, src_worker long, dst_ts long, dst_worker long, edge_type int, operator_id long"


def single_path(pag: DataFrame, seed: int = 0, pick: str = "random") -> DataFrame:
    """A walk from one start node of each epoch to where no edge leads on, whatever edges block. pick: random takes
    each edge alike (from the seed and epoch), first takes the least (dst_ts, dst_worker) from the start node of the
    least worker."""

    def walk(epoch: int, starts: list[tuple], out: dict[tuple, list[tuple]], most: int) -> list[tuple]:
        draw = np.random.default_rng([seed, epoch % (1 << 32)])
        starts.sort()
        worker, ts = starts[0] if pick == "first" else starts[int(draw.integers(len(starts)))]
        node, rows = (ts, worker), []
        while (ways := out.get(node)) and len(rows) <= most:
            ways.sort(key=lambda x: (x[0], x[1], x[2], -1 if x[3] is None else x[3]))
            way = ways[0] if pick == "first" else ways[int(draw.integers(len(ways)))]
            rows.append((epoch, len(rows), *node, *way))
            node = way[:2]
        return rows

    def run(group: pa.Table) -> pa.Table:
        starts: dict[int, list[tuple]] = {}
        ways: dict[int, dict[tuple, list[tuple]]] = {}
        for epoch, kind, src_ts, src_worker, dst_ts, dst_worker, edge_type, operator in zip(*(group[c].to_pylist() for c in PAG_COLUMNS[:-1]), strict=True):
            if kind == "START":
                starts.setdefault(epoch, []).append((dst_worker, dst_ts))
            elif kind == "EDGE":
                ways.setdefault(epoch, {}).setdefault((src_ts, src_worker), []).append((dst_ts, dst_worker, edge_type, operator))
        rows = [r for e, s in starts.items() for r in walk(e, s, ways.get(e, {}), sum(map(len, ways.get(e, {}).values())))]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in WALK.split(", ")])

    return pag.select(*PAG_COLUMNS).groupBy(F.expr(f"epoch div {EPOCHS_PER_TASK}")).applyInArrow(run, WALK)


def explore(edges: DataFrame, group: str = "graph", src: str = "src", dst: str = "dst", capacity: str = "unbound") -> DataFrame:
    """Betweenness of any graph: edges with struct or plain columns src and dst, where a null src leads in and a null dst
    leads out, group tells graphs apart, and traverse (Block or Unbounded) is there if the capacity asks for it."""
    rows = edges.withColumns({"_a": F.to_json(F.struct(src)), "_b": F.to_json(F.struct(dst)), "_in": F.col(src).isNull(), "_out": F.col(dst).isNull()})
    if "traverse" not in edges.columns:
        rows = rows.withColumn("traverse", F.lit("Unbounded"))
    schema, names_kept = edges.schema.simpleString()[len("struct<") : -1] + ",bc:double", edges.columns

    def run(table: pa.Table) -> pa.Table:
        a, b = table["_a"].to_pylist(), table["_b"].to_pylist()
        lead_in, lead_out = (np.array(table[c].to_pylist(), bool) for c in ("_in", "_out"))
        strip = lambda x, name: x[len(name) :]
        names: dict[str, int] = {}
        number = lambda x, c: names.setdefault(strip(x, '{"' + c + '":'), len(names))
        inner = ~(lead_in | lead_out)
        s = np.array([number(x, src) for x, k in zip(a, inner, strict=True) if k], np.int64)
        d = np.array([number(x, dst) for x, k in zip(b, inner, strict=True) if k], np.int64)
        first = np.array([number(x, dst) for x, k in zip(b, lead_in, strict=True) if k], np.int64)
        last = np.array([number(x, src) for x, k in zip(a, lead_out, strict=True) if k], np.int64)
        factor, plus = CAPACITIES[capacity](np.array(table["traverse"].to_pylist(), object)[inner])
        bc = spread(len(names), s, d, first, factor, plus) * spread(len(names), d, s, last, factor, plus)
        kept = table.filter(pa.array(inner)).select(names_kept)
        return kept.append_column("bc", pa.array(bc, pa.float64()))

    return rows.groupBy(group).applyInArrow(run, schema)


def iterate_epochs(rows: DataFrame, logic, schema: str) -> DataFrame:
    """A function of one epoch's rows (pandas), applied to every epoch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return logic(pdf)

    return rows.groupBy("epoch").applyInPandas(run, schema)

