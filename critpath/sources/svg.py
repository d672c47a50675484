"""Drawings of a trace: a band for each worker, with a lane for each activity that is open at one time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critpath.schema import ACTIVITIES, END, START, named

#: Ticks (ns) of a pixel, of a mark on the time axis, and the heights of a lane and of a worker's band.
PIXEL, MARK, LANES, LANE_HEIGHT, BAND = 25_000, 10_000_000, 4, 8, 48
SPANS = "worker long, lane long, start long, stop long, activity int, operator_id long"


def lanes(trace: DataFrame) -> DataFrame:
    """Spans of local activities with a lane: the first that is free when they start, kept until they end. What is open
    at a worker's last record ends there; an end without a start is left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        slots: list = []
        rows = []
        worker = int(pdf["local_worker"].iloc[0])
        for ts, activity, event, operator in zip(pdf["ts"], pdf["activity_type"], pdf["event_type"], pdf["operator_id"], strict=True):
            if event == START:
                if None not in slots:
                    slots.append(None)
                slots[slots.index(None)] = (ts, activity, operator)
            else:
                own = [i for i, s in enumerate(slots) if s is not None and s[1] == activity]
                if own:
                    last = max(own, key=lambda i: slots[i][0])
                    rows.append((worker, last, slots[last][0], ts, activity, slots[last][2]))
                    slots[last] = None
        rows += [(worker, i, s[0], int(pdf["ts"].iloc[-1]), s[1], s[2]) for i, s in enumerate(slots) if s is not None]
        frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SPANS.split(", ")])
        frame["operator_id"] = frame["operator_id"].astype("Int64")
        return frame

    local = trace.filter(F.col("event_type").isin(START, END)).select("seq", "ts", "local_worker", "activity_type", "event_type", "operator_id")
    return local.groupBy("local_worker").applyInPandas(run, SPANS)


def drawing(trace: DataFrame, skip_ts: int = 0, take: int = 5000, pixel: int = PIXEL) -> DataFrame:
    """k, value: lines of an SVG of the first `take` records from skip_ts on (a drawing is a limited view)."""
    shown = trace.filter(F.col("ts") >= skip_ts).orderBy("ts", "seq").limit(take)
    spans = lanes(shown).filter(F.col("lane") < LANES)
    first = shown.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("local_worker").alias("workers"))
    x = lambda c: ((F.col(c) - F.col("first")) / pixel).cast("string")
    rows = spans.crossJoin(F.broadcast(first))  # one row
    y = (F.col("worker") * BAND + F.col("lane") * LANE_HEIGHT).cast("string")
    box = F.concat(
        F.lit('<rect x="'), x("start"), F.lit('" y="'), y, F.lit('" width="'), ((F.col("stop") - F.col("start")) / pixel).cast("string"), F.lit(f'" height="{LANE_HEIGHT - 1}" class="a'),
        F.col("activity").cast("string"), F.lit('"><title>'), named(F.col("activity"), ACTIVITIES), F.lit("</title></rect>"),
    )
    width, height = ((F.col("last") - F.col("first")) / pixel).cast("string"), ((F.col("workers") + 1) * BAND).cast("string")
    head = first.filter("first is not null").select(F.lit(0).alias("k"), F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), width, F.lit('" height="'), height, F.lit('">')).alias("value"))
    marks = first.filter("first is not null").select("first", F.explode(F.sequence(F.expr(f"first div {MARK}"), F.expr(f"last div {MARK}"))).alias("m"))
    at = (F.greatest(F.lit(0), F.col("m") * MARK - F.col("first")) / pixel).cast("string")
    axis = marks.select(F.lit(1).alias("k"), F.concat(F.lit('<line x1="'), at, F.lit('" x2="'), at, F.lit('" y1="0" y2="100%" class="mark"/>')).alias("value"))
    tail = head.select(F.lit(3).alias("k"), F.lit("</svg>").alias("value"))
    return head.unionByName(axis).unionByName(rows.select(F.lit(2).alias("k"), box.alias("value"))).unionByName(tail)


def write(trace: DataFrame, path: str, **options) -> None:
    drawing(trace, **options).coalesce(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)
