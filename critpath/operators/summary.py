"""Summaries of ranked graphs, and the analyses of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from critpath.operators.messages import bounds
from critpath.schema import is_worker_local

#: Operators are shown by their low byte, and as this one if there is none.
NO_OPERATOR = 255


def operator_key(wide: bool = False) -> Column:
    known = F.coalesce("operator_id", F.lit(NO_OPERATOR))
    return known.cast("int") if wide else (known % 256).cast("int")


def crosses(window: int) -> Column:
    """Which bounds of its epoch an edge touches: B both, S the start, E the end, N none."""
    low, high = bounds(window)
    a, b = F.col("src_ts") == low, F.col("dst_ts") == high
    return F.when(a & b, "B").when(a, "S").when(b, "E").otherwise("N")


def weight() -> Column:
    return F.coalesce(F.abs(F.col("dst_ts") - F.col("src_ts")), F.lit(0))


def summarise(ranked: DataFrame, window: int, wide_operators: bool = False, *carry: str) -> DataFrame:
    """epoch, activity, operator, src, dst, crosses with sums of bc, bc * weight, edges and weight; edges that paths
    couldn't settle count with bc 0. carry: columns that are alike within an epoch and stay."""
    bc, local = F.nanvl("bc", F.lit(0.0)), is_worker_local("edge_type")
    rows = ranked.select(
        "epoch", F.col("edge_type").alias("activity"), operator_key(wide_operators).alias("operator"), F.col("src_worker").alias("src"),
        F.when(local, F.col("src_worker")).otherwise(F.col("dst_worker")).alias("dst"), crosses(window).alias("crosses"), bc.alias("bc"), weight().alias("weight"), *carry,
    )
    return rows.groupBy("epoch", "activity", "operator", "src", "dst", "crosses", *carry).agg(
        F.sum("bc").alias("bc"), F.sum(F.col("bc") * F.col("weight")).alias("weighted_bc"), F.count("*").alias("count"), F.sum("weight").alias("weight")
    )


def summarise_path(path: DataFrame) -> DataFrame:
    """epoch, activity, operator of a single path, with its edges and weight."""
    rows = path.select("epoch", F.col("edge_type").alias("activity"), operator_key().alias("operator"), weight().alias("w"))
    return rows.groupBy("epoch", "activity", "operator").agg(F.count("*").alias("bc"), F.sum("w").alias("weighted_bc"), F.count("*").alias("count"), F.sum("w").alias("weight"))


def normalised(summaries: DataFrame, paths: DataFrame, window: int, ticks_per_second: int) -> DataFrame:
    """Summaries with epochs counted from the first, critical participation, and weight and count per window time."""
    base = paths.agg(F.min("epoch").alias("_first"))
    rows = summaries.join(paths, "epoch", "left").crossJoin(F.broadcast(base))  # one row
    return rows.select(
        "*",
        F.when(F.col("paths") > 0, F.col("weighted_bc") / (F.col("paths") * F.lit(float(window)))).otherwise(0.0).alias("normalized_bc"),
        (F.col("weight") / F.lit(float(window))).alias("normalized_weight"),
        (F.col("count") / F.lit(window / ticks_per_second)).alias("normalized_count"),
    ).withColumn("epoch", F.col("epoch") - F.col("_first")).drop("_first")


def normalised_once(ranked: DataFrame, origin: DataFrame, window: int, ticks_per_second: int, wide_operators: bool = False) -> DataFrame:
    """The same as normalised from ranked edges alone: paths are those of the edges that leave an epoch's first tick,
    summed beside the groups, so the ranking runs once. origin: one row, the first epoch."""
    low, _ = bounds(window)
    whole = F.when(F.col("src_ts") == low, F.nanvl("bc", F.lit(0.0)).cast("long")).otherwise(0)
    counted = ranked.withColumn("paths", F.sum(whole).over(W.partitionBy("epoch")))
    rows = summarise(counted, window, wide_operators, "paths").crossJoin(F.broadcast(origin.select(F.col("epoch").alias("_first"))))  # one row
    return rows.select(
        (F.col("epoch") - F.col("_first")).alias("epoch"), *(c for c in rows.columns if c not in ("epoch", "_first")),
        F.when(F.col("paths") > 0, F.col("weighted_bc") / (F.col("paths") * F.lit(float(window)))).otherwise(0.0).alias("normalized_bc"),
        (F.col("weight") / F.lit(float(window))).alias("normalized_weight"),
        (F.col("count") / F.lit(window / ticks_per_second)).alias("normalized_count"),
    )


def grouped(summaries: DataFrame, group: list[str], columns: list[str], workers: list[int] | None = None, operators: list[int] | None = None, activities: list[int] | None = None, filter_messages: bool = False, mean_over: list[str] | None = None) -> DataFrame:
    """Sums of columns by group and epoch after the filters, then if asked their means by mean_over."""
    rows = summaries
    for name, some in (("src", workers), ("operator", operators), ("activity", activities)):
        rows = rows.filter(F.col(name).isin(*some)) if some is not None else rows
    rows = rows.filter("src = dst") if filter_messages else rows
    sums = rows.groupBy(*dict.fromkeys([*group, "epoch"])).agg(*(F.sum(c).alias(c) for c in columns))
    return sums if mean_over is None else sums.groupBy(*mean_over).agg(*(F.avg(c).alias(c) for c in columns))


def pivoted(rows: DataFrame, index: list[str], by: str, column: str, values: list | None = None) -> DataFrame:
    """One column for each value of by, 0 where there is none. Without given values they are looked up first."""
    wide = rows.groupBy(*index).pivot(by, values) if values is not None else rows.groupBy(*index).pivot(by)
    return wide.agg(F.sum(column)).na.fill(0)


def zero_filled(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """All combinations of the keys' values, 0 where rows have none. The product is of distinct keys, as many as asked for."""
    full = None
    for k in keys:
        values = rows.select(k).distinct()
        full = values if full is None else full.crossJoin(values)
    return full.join(rows, keys, "left").na.fill(0, columns)


def concatenated(frames: dict[str, DataFrame], name: str = "experiment") -> DataFrame:
    """Rows of several experiments with the experiment's name."""
    out = None
    for key, df in frames.items():
        part = df.withColumn(name, F.lit(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cdf(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The empirical distribution: value and the share of rows up to each distinct one; nulls and nan count as 0.

    Values are counted first, so the window runs over distinct values.
    """
    by = by or []
    value = F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(0.0)), F.lit(0.0))
    counts = rows.select(*by, value.alias("value")).groupBy(*by, "value").agg(F.count("*").alias("n"))
    part = W.partitionBy(*by)
    upto = part.orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    return counts.select(*by, "value", (F.sum("n").over(upto) / F.sum("n").over(part)).alias("share"))


def quantiles(rows: DataFrame, column: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Linearly interpolated quantiles as columns q0 to qN."""
    found = rows.groupBy(*by).agg(F.percentile(column, F.array(*(F.lit(q) for q in at))).alias("q"))
    return found.select(*by, *(F.col("q")[i].alias(f"q{i}") for i in range(len(at))))


def epoch_latency(epochs: DataFrame) -> DataFrame:
    """delta_t: time from a window's input to its summary."""
    return epochs.withColumn("delta_t", F.col("summary") - F.col("input"))


def throughput(epochs: DataFrame, events: DataFrame, by: list[str], per_second: float = 1e9) -> DataFrame:
    """Events per second, and median, mean, deviation and sum of the times between summaries, for each run."""
    steps = epochs.withColumn("step", (F.col("summary") - F.coalesce(F.lag("summary").over(W.partitionBy(*by).orderBy("summary")), F.col("input"))) / per_second)
    sums = events.groupBy(*by).agg(F.sum("n").alias("events"))
    found = steps.groupBy(*by).agg(F.percentile("step", F.lit(0.5)).alias("median"), F.avg("step").alias("mean"), F.stddev_pop("step").alias("std"), F.sum("step").alias("sum"))
    return found.join(sums, by).withColumn("events_per_second", F.col("events") / F.col("sum"))


def by_receiver(summaries: DataFrame, worker_names: DataFrame) -> DataFrame:
    """Summaries with the component of the receiving worker (dst); worker_names: worker, component."""
    return summaries.join(worker_names.select(F.col("worker").alias("dst"), F.col("component").alias("component_dst")), "dst", "left")


def top_activities(summaries: DataFrame, n: int) -> DataFrame:
    """The n activities, operators and workers with most weighted bc over all epochs (a report)."""
    sums = summaries.groupBy("activity", "operator", "src", "dst").agg(F.sum("weighted_bc").alias("weighted_bc"))
    return sums.orderBy(F.desc("weighted_bc"), "activity", "operator", "src", "dst").limit(n)
