"""Text output of analysis runs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUMMARY_COLUMNS = ["epoch", "activity", "operator", "src", "dst", "crosses", "bc", "weighted_bc", "count", "weight"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("app"), F.col("value").alias("line"))


def epochs(text: DataFrame) -> DataFrame:
    """app, epoch, input, summary (wall times), paths, delta_t from EPOCH and COUNT lines."""
    w = F.split("line", r"\s+")
    timed = text.filter("line like 'EPOCH %'").select("app", w[1].alias("what"), w[2].cast("long").alias("epoch"), w[3].cast("long").alias("v"))
    counted = text.filter("line like 'COUNT %'").select("app", w[3].alias("what"), w[1].cast("long").alias("epoch"), w[4].cast("long").alias("v"))
    of = lambda name: F.max(F.when(F.col("what") == name, F.col("v"))).alias(name)
    rows = timed.unionByName(counted).filter("what in ('input', 'summary', 'paths')").groupBy("app", "epoch").agg(of("input"), of("summary"), of("paths"))
    return rows.withColumn("delta_t", F.col("summary") - F.col("input"))


def summaries(text: DataFrame) -> DataFrame:
    """app and the columns of SUMMARY lines."""
    kinds = dict(crosses="string", bc="double", weighted_bc="double")
    cells = F.split(F.split("line", r"\s+")[1], ",")
    return text.filter("line like 'SUMMARY %'").select("app", *(cells[i].cast(kinds.get(c, "long")).alias(c) for i, c in enumerate(SUMMARY_COLUMNS)))


def components(text: DataFrame, marker: str) -> DataFrame:
    """app, worker, component from the words after a marker in a log line: the first name is worker 0's."""
    at = F.instr("line", marker)
    rest = F.split(F.trim(F.expr("substring(line, at + length(mark))")), r"\s+")
    return text.withColumn("at", at).withColumn("mark", F.lit(marker)).filter("at > 1").select("app", F.posexplode(rest).alias("worker", "component")).withColumn("worker", F.col("worker").cast("long"))
