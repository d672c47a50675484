"""Command line: python -m critpath.plans.cli analyse | generate | convert-log | convert-timeline | draw | chrome | spans | show | verify."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.operators import prep
from critpath.plans.pipeline import Analysis
from critpath.schema import activity_code
from critpath.sources import eventlog, msgpack, sinks, svg, timeline_json
from critpath.sources.synth import Pyramid, pyramid


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else msgpack.read(spark, path)


def save(spark: SparkSession, trace: DataFrame, path: str) -> None:
    if path.rstrip("/").endswith(".parquet"):
        trace.write.mode("overwrite").parquet(path)
    else:
        msgpack.register(spark)
        trace.coalesce(1).sortWithinPartitions("ts", "seq").write.format("msgpack_trace").mode("append").save(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="critpath")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="rank the activities of a trace")
    a.add_argument("input")
    a.add_argument("threshold", type=int, help="gaps below it are closed (ns)")
    a.add_argument("window", type=float, help="seconds of an epoch")
    a.add_argument("--message-delay", type=int)
    a.add_argument("--waiting-message", type=int, default=0)
    a.add_argument("--no-insert-waiting", action="store_true")
    a.add_argument("--no-bc", action="store_true")
    a.add_argument("--no-summary", action="store_true")
    a.add_argument("--bc-dot", help="folder for the ranked graphs")
    a.add_argument("--pag-dot", help="folder for the graphs")
    a.add_argument("--pag-msgpack", help="folder for the graphs as traces")
    a.add_argument("--dump-pag", action="store_true")
    a.add_argument("--output", help="folder for the summary as CSV; else it is printed")
    g = sub.add_parser("generate", help="write a generated trace")
    g.add_argument("output")
    for name, kind, value in (("workers", int, 10), ("phases", int, 1), ("length-ms", int, 10)):
        g.add_argument(f"--{name}", type=kind, default=value)
    for name, value in (("activity", "Processing"), ("prefix", "Waiting"), ("infix", "Processing"), ("suffix", "Waiting"), ("send", "DataMessage"), ("receive", "DataMessage")):
        g.add_argument(f"--{name}", default=value)
    c = sub.add_parser("convert-log", help="cluster event logs to a trace")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("-s", "--shuffle", action="store_true")
    c.add_argument("-e", "--executor-cores", type=int)
    c.add_argument("-d", "--delay-split", type=float, default=0.33)
    t = sub.add_parser("convert-timeline", help="operator timelines to a trace")
    t.add_argument("input")
    t.add_argument("dictionary")
    t.add_argument("output")
    t.add_argument("--reschedule", action="store_true")
    t.add_argument("--preserve-timestamps", action="store_true")
    d = sub.add_parser("draw", help="an SVG of a trace")
    d.add_argument("input")
    d.add_argument("output")
    d.add_argument("--skip-ts", type=int, default=0)
    d.add_argument("--take", type=int, default=5000)
    for name, text in (("chrome", "a trace viewer's JSON"), ("spans", "matched spans as JSON"), ("show", "records as text")):
        c = sub.add_parser(name, help=text)
        c.add_argument("input")
        c.add_argument("output")
    v = sub.add_parser("verify", help="check a trace's nesting")
    v.add_argument("input")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("critpath").getOrCreate()
    if args.command == "generate":
        kinds = {k: activity_code(getattr(args, k)) for k in ("activity", "prefix", "infix", "suffix", "send", "receive")}
        save(spark, pyramid(spark, Pyramid(args.workers, args.phases, args.length_ms * 1_000_000, **kinds)), args.output)
    elif args.command == "convert-log":
        trace = eventlog.read(spark, args.input, shuffle_edges=args.shuffle, delay_split=args.delay_split, default_cores=args.executor_cores)
        save(spark, trace.drop("app"), args.output)
    elif args.command == "convert-timeline":
        save(spark, timeline_json.read(spark, args.input, args.dictionary, preserve_timestamps=args.preserve_timestamps, preserve_tid=not args.reschedule).drop("app"), args.output)
    elif args.command == "draw":
        svg.write(load(spark, args.input), args.output, skip_ts=args.skip_ts, take=args.take)
    elif args.command == "chrome":
        sinks.write_chunked(sinks.chrome_json(load(spark, args.input)), args.output, ["ts", "seq", "place"])
    elif args.command == "spans":
        sinks.spans(load(spark, args.input)).write.mode("overwrite").json(args.output)
    elif args.command == "show":
        sinks.record_lines(load(spark, args.input)).sort("seq").select("value").write.mode("overwrite").text(args.output)
    elif args.command == "verify":
        trace = load(spark, args.input)
        found = {"double starts": prep.double_starts(trace), "underflows": prep.underflows(trace), "misnested": prep.nesting(trace).filter("misnested > 0")}
        bad = {k: n for k, df in found.items() if (n := df.count())}
        print(bad or "the trace is well formed", file=sys.stderr)
        return int(bool(bad))
    else:
        config = Config(int(args.window * 1e9), args.threshold, args.message_delay, args.waiting_message, not args.no_insert_waiting)
        run = Analysis.of(load(spark, args.input), config)
        if args.pag_dot:
            sinks.write_dot(run.graph, args.pag_dot)
        if args.pag_msgpack:
            msgpack.register(spark)
            sinks.as_trace(run.graph).drop("epoch").write.format("msgpack_trace").mode("append").save(args.pag_msgpack)
        if args.dump_pag:
            run.graph.orderBy("epoch", "src_ts", "src_worker").show(1000, truncate=False)
        if not args.no_bc:
            if args.bc_dot:
                sinks.write_dot(run.ranked.filter(F.col("bc") > 0), args.bc_dot)
            if not args.no_summary:
                lines = sinks.summary_lines(run.summaries)
                if args.output:
                    lines.write.mode("overwrite").text(args.output)
                else:
                    for row in lines.toLocalIterator():
                        print(row[0])
    return 0


if __name__ == "__main__":
    sys.exit(main())
