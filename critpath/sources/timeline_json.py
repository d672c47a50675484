"""Timeline files (one JSON object with an array traceEvents) of dataflow operators as traces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.schema import CONTROL_MESSAGE, DATA_MESSAGE, PROCESSING, RECORD_COLUMNS
from critpath.sources.eventlog import _message, _span, records_of

SCHEMA = "traceEvents ARRAY<STRUCT<ph: STRING, name: STRING, cat: STRING, pid: BIGINT, tid: BIGINT, ts: BIGINT, dur: BIGINT, args: MAP<STRING, STRING>>>"
COMPUTE = " Compute"


def operators(spark: SparkSession, path: str) -> DataFrame:
    """op, id from a dictionary file {name: id}."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, BIGINT>").alias("m"))
    return text.select(F.explode("m").alias("op", "id"))


def number(text: Column) -> Column:
    """An unsigned 32-bit integer that may be written as a string; null if it is none."""
    found = text.try_cast("bigint")
    return F.when(found.between(0, (1 << 32) - 1), found)


def without_port(name: Column) -> Column:
    return F.regexp_replace(name, r":[0-9]+$", "")


def originals(name: Column) -> Column:
    """What a name may have been before duplicates were numbered: each part _N taken away by itself."""
    pieces = F.split(name, "/")
    by_piece = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.array_join(F.transform(pieces, lambda p, k: F.when(k == i, F.regexp_replace(p, r"_[0-9]+$", "")).otherwise(p)), "/"))
    return F.filter(by_piece, lambda x: x != name)


def activities(spark: SparkSession, path: str) -> DataFrame:
    """app, place, output, op, tid, begin, length (ns) and inputs of the operators that ran on compute devices."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    rows = files.select(F.col("_metadata.file_path").alias("app"), F.posexplode("traceEvents").alias("place", "e")).select("app", "place", "e.*")
    devices = rows.filter((F.col("ph") == "M") & F.element_at("args", "name").endswith(COMPUTE)).select("app", "pid", F.element_at("args", "name").alias("device"))
    inputs = F.map_values(F.map_filter("args", lambda k, v: k.rlike(r"^input[0-9]+$")))
    ran = rows.filter("ph = 'X' and cat = 'Op'").join(devices, ["app", "pid"])
    return ran.select("app", "place", F.element_at("args", "name").alias("output"), F.element_at("args", "op").alias("op"), "tid", (F.col("ts") * 1000).alias("begin"), (F.col("dur") * 1000).alias("length"), inputs.alias("inputs"))


def to_trace(ran: DataFrame, dictionary: DataFrame, preserve_timestamps: bool = False, preserve_tid: bool = True) -> DataFrame:
    """app and records: each operator as Processing with its id, and a message from the producer of each input (data, or
    control if the input is written with a caret). Without preserve_timestamps the step is moved so that it begins at
    a thousand times its length; without preserve_tid threads are dealt anew, the one that became free last first."""
    bounds = ran.groupBy("app").agg(F.min("begin").alias("first"), F.max(F.col("begin") + F.col("length")).alias("last"))
    moved = ran.join(bounds, "app")
    if not preserve_timestamps:
        moved = moved.withColumn("begin", F.col("begin") - F.col("first") + (F.col("last") - F.col("first")) * 1000)
    known = moved.drop("first", "last").join(dictionary, "op", "left").withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("an operator that the dictionary lacks: "), F.col("op"))).cast("long")).otherwise(F.col("id")))
    placed = known.withColumn("worker", F.col("tid")) if preserve_tid else _dealt(known)
    made = placed.select(F.col("app").alias("made_in"), F.col("output").alias("producer"), F.col("worker").alias("sender"), (F.col("begin") + F.col("length")).alias("sent"))
    asked = placed.select("app", "place", "worker", "begin", F.posexplode("inputs").alias("k", "input")).withColumn("control", F.col("input").startswith("^"))
    asked = asked.withColumn("wanted", without_port(F.when(F.col("control"), F.expr("substring(input, 2)")).otherwise(F.col("input"))))
    exact = asked.join(made, (F.col("app") == F.col("made_in")) & (F.col("wanted") == F.col("producer")), "left").drop("made_in")
    plain = exact.filter("producer is not null")
    rest = exact.filter("producer is null and not control").drop("producer", "sender", "sent").withColumn("maybe", F.explode(F.array_distinct(originals(F.col("input"))))).withColumn("maybe", without_port(F.col("maybe")))
    guessed = rest.join(made, (F.col("app") == F.col("made_in")) & (F.col("maybe") == F.col("producer"))).groupBy("app", "place", "worker", "begin", "k", "control").agg(F.count("*").alias("n"), F.first("sender").alias("sender"), F.first("sent").alias("sent")).filter("n = 1")
    found = plain.select("app", "worker", "begin", "control", "sender", "sent").unionByName(guessed.select("app", "worker", "begin", "control", "sender", "sent"))
    message = F.when(F.col("control"), _message(CONTROL_MESSAGE, F.col("sender"), F.col("sent"), F.col("worker"), F.col("begin"))).otherwise(_message(DATA_MESSAGE, F.col("sender"), F.col("sent"), F.col("worker"), F.col("begin")))
    spans = placed.select("app", _span(PROCESSING, F.col("worker"), F.col("id"), F.col("begin"), F.col("length")).alias("p"))
    return records_of(spans.unionByName(found.select("app", message.alias("p"))), drop_own=True).select("app", *RECORD_COLUMNS)


def _dealt(known: DataFrame) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in known.schema.fields) + ", worker long"
    names = known.columns

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["begin", "place"], kind="stable")
        busy = dict.fromkeys(range(int(pdf["tid"].max()) + 1), 0)
        found = []
        for begin, length in zip(pdf["begin"], pdf["length"], strict=True):
            free = [(until, w) for w, until in busy.items() if until < begin]
            if not free:
                raise ValueError("no idle thread")
            found.append(max(free)[1])
            busy[found[-1]] = begin + length
        return pdf[names].assign(worker=found)

    return known.groupBy("app").applyInPandas(assign, schema)


def read(spark: SparkSession, path: str, dictionary: str, **options) -> DataFrame:
    return to_trace(activities(spark, path), operators(spark, dictionary), **options)
