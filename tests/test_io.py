"""Sources, sinks, streaming, command line and the registered queries."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from critpath.config import Config
from critpath.operators import prep
from critpath.plans import cli
from critpath.plans.pipeline import Analysis
from critpath.plans.sweep import Sweep, steps
from critpath.schema import RECORD
from critpath.sources import eventlog, harness_text, msgpack, sinks, svg, timeline_json
from critpath.sources.synth import Pyramid, pyramid
from critpath.streaming.live import Progress, analyse_stream

SECOND = 1_000_000_000
DATA = "/root/testdata/sf0.001"


def test_codec():
    rows = [(124353023, 123, 10, 1, 12, 15, 3), (124353023, 123, 10, 1, None, 16, 3), (124353023, 123, 10, 2, 12, 15, 3), (2**63 + 5, 2**32 - 1, 1, 5, 2**40, None, None)]
    data = b"".join(map(msgpack.encode_record, rows))
    got = list(msgpack.decode_records(data, strict=True))
    assert got[:3] == rows[:3] and got[3][0] == 2**63 + 5 - 2**64 and got[3][4:] == (2**40, None, None)
    assert list(msgpack.decode_records(b"\xc0" + data))[:3] == rows[:3]
    for bad in (data[:-1], b"\xc0"):
        with pytest.raises(msgpack.DecodeError):
            list(msgpack.decode_records(bad, strict=True))
    for x in (0, 127, 128, 255, 256, 65535, 65536, 2**32, 2**63 - 1, -1, -32, -33, -128, -129, -(2**31), -(2**63)):
        assert msgpack.decode_integers(msgpack.encode_integer(x, True), 0, 1)[0] == [x]


def test_trace_files(spark, tmp_path):
    t = pyramid(spark, Pyramid(workers=3, phase=1000))
    msgpack.register(spark)
    t.coalesce(1).sortWithinPartitions("seq").write.format("msgpack_trace").mode("append").save(str(tmp_path / "t"))
    want = sorted(map(tuple, t.drop("seq").collect()), key=str)
    for got in (msgpack.read(spark, str(tmp_path / "t")), spark.read.format("msgpack_trace").load(str(tmp_path / "t"))):
        assert sorted(map(tuple, got.drop("seq").collect()), key=str) == want


def test_files_of_several_workers_are_one_trace(spark, tmp_path):
    """Records have numbers of their own across files, so what is matched by them is the same as in one file."""
    msgpack.register(spark)
    rows = [(w, ts, event) for w in (0, 1, 2) for ts, event in ((0, 1), (100 + w, 2), (200, 1), (320 + w, 2))]
    encoded = {w: b"".join(msgpack.encode_record((ts, v, 4, event, None, None, 7)) for v, ts, event in rows if v == w) for w in (0, 1, 2)}
    for w, data in encoded.items():
        (tmp_path / "many").mkdir(exist_ok=True)
        (tmp_path / "many" / f"worker-{w}").write_bytes(data)
    (tmp_path / "one").write_bytes(b"".join(encoded.values()))
    one = msgpack.read(spark, str(tmp_path / "one"))
    spans = lambda t: sorted(tuple(map(str, r)) for r in sinks.spans(prep.infer_correlators(t)).drop("corr_id").collect())
    for many in (msgpack.read(spark, str(tmp_path / "many")), spark.read.format("msgpack_trace").load(str(tmp_path / "many"))):
        assert many.select("seq").distinct().count() == many.count() == 12
        assert [r.local_worker for r in many.orderBy("seq").collect()] == [0] * 4 + [1] * 4 + [2] * 4
        assert prep.infer_correlators(many).select("correlator_id").distinct().count() == 6
        assert spans(many) == spans(one) and len(spans(one)) == 6


def log_lines(results=False):
    task = lambda stage, ex, launch, finish, grt=0: {"Event": "SparkListenerTaskEnd", "Stage ID": stage, "Task Info": {"Executor ID": ex, "Launch Time": launch, "Finish Time": finish, "Getting Result Time": grt}, "Task Metrics": {"Executor Deserialize Time": 1, "Executor Run Time": 5, "Result Serialization Time": 1, "Shuffle Read Metrics": {"Fetch Wait Time": 1}, "Shuffle Write Metrics": {"Shuffle Write Time": 1000}}}
    stage = lambda event, i, n, parents, a, b: {"Event": f"SparkListenerStage{event}", "Stage Info": {"Stage ID": i, "Number of Tasks": n, "Parent IDs": parents, "Submission Time": a, "Completion Time": b}}
    return [
        {"Event": "SparkListenerExecutorAdded", "Executor ID": "0", "Executor Info": {"Total Cores": 2}},
        stage("Submitted", 0, 2, [], 1000, None), task(0, "0", 1001, 1011), task(0, "0", 1002, 1013, 1012 if results else 0), stage("Completed", 0, 2, [], 1000, 1014),
        stage("Submitted", 1, 1, [0, 9], 1015, None), task(1, "0", 1020, 1030), stage("Completed", 1, 1, [0, 9], 1015, 1031),
    ]


def test_event_log(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("".join(json.dumps(x) + "\n" for x in log_lines()))
    log = eventlog.events(spark, str(path))
    done = eventlog.scheduled(log).orderBy("launch").collect()
    assert [r.worker for r in done] == [2, 1, 1]
    assert done[0].delay == 3_000_000 and done[0].start == 1001_000_000 + 990_000 and done[0].computing == 5_000_000 - 1_000_000 - 1000
    assert eventlog.bad_stages(log).count() == 0
    plain, drawn = eventlog.to_trace(log), eventlog.to_trace(log, shuffle_edges=True)
    # 3 tasks with 5 activities and 2 messages, 5 driver states
    assert plain.count() == 2 * (3 * 7 + 5) and drawn.count() - plain.count() == 2 * 2
    run = Analysis.of(plain.drop("app"), Config(window=SECOND, threshold=1000))
    assert run.paths.first().paths >= 1
    path.write_text("".join(json.dumps(x) + "\n" for x in log_lines(True)))
    states = [(r.activity, r.stage) for r in eventlog.driver_states(eventlog.events(spark, str(path))).orderBy("begin").collect()]
    assert (2, 0) in states  # the driver fetched a result


def test_unknown_executor(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text("".join(json.dumps(x) + "\n" for x in log_lines()[1:]))
    log = eventlog.events(spark, str(path))
    assert eventlog.scheduled(log, default_cores=2).count() == 3
    with pytest.raises(Exception, match="unknown executor"):
        eventlog.scheduled(log).collect()


def test_timeline(spark, tmp_path):
    op = lambda name, kind, tid, ts, **inputs: {"ph": "X", "cat": "Op", "pid": 1, "tid": tid, "ts": ts, "dur": 10, "name": kind, "args": {"name": name, "op": kind, **inputs}}
    process = lambda pid, name: {"ph": "M", "name": "process_name", "pid": pid, "args": {"name": name}}
    events = [process(1, "/cpu:0 Compute"), process(2, "/cpu:0 Tensors"), op("a/x", "Add", 0, 100), op("b", "Mul", 1, 120, input0="a/x:0", input1="^a/x", input2="a/x_1"), {**op("t", "Add", 0, 1), "pid": 2}]
    (tmp_path / "t.json").write_text(json.dumps({"traceEvents": events}))
    (tmp_path / "ops.json").write_text(json.dumps({"Add": 0, "Mul": 7}))
    read = lambda **kw: timeline_json.read(spark, str(tmp_path / "t.json"), str(tmp_path / "ops.json"), **kw)
    rows = read().collect()
    assert sorted(r.activity_type for r in rows) == [4, 4, 4, 4, 9, 9, 10, 10, 10, 10]
    assert min(r.ts for r in rows) == 30_000 * 1000 and {r.operator_id for r in rows} == {0, 7, None}
    assert min(r.ts for r in read(preserve_timestamps=True).collect()) == 100_000
    assert {r.local_worker for r in read(preserve_tid=False).filter("activity_type = 4").collect()} == {1}
    (tmp_path / "ops.json").write_text(json.dumps({"Add": 0}))
    with pytest.raises(Exception, match="dictionary lacks"):
        read().collect()


def test_viewers(spark, tmp_path):
    t = pyramid(spark, Pyramid(workers=2, phase=1_000_000))
    lines = sinks.chrome_json(t)
    assert {json.loads(r.value)["ph"] for r in lines.collect()} == {"B", "E", "s", "t"}
    sinks.write_chunked(lines, str(tmp_path / "chrome"), ["ts", "seq", "place"], chunk_bytes=1000)
    files = [f for f in glob.glob(str(tmp_path / "chrome/part-*"))]
    assert len(files) > 1 and all(os.path.getsize(f) <= 1000 for f in files)
    assert sinks.spans(t, take=0).count() == 0 and sinks.spans(t).count() == 2
    assert sinks.record_lines(t).count() == t.count()
    graph = Analysis.of(t, Config(window=1_000_000, threshold=10)).graph
    sinks.write_dot(graph, str(tmp_path / "dot"))
    text = "".join(open(f).read() for f in glob.glob(str(tmp_path / "dot/epoch=1000000000/*")))
    assert text.startswith("digraph") and text.count("subgraph") == 2 and text.rstrip().endswith("}")


def test_lanes(spark):
    rows = [(0, 10, 0, 2, 1, None, None, 1), (1, 20, 0, 4, 1, None, None, 2), (2, 30, 0, 2, 2, None, None, 1), (3, 40, 0, 6, 1, None, None, 3), (4, 50, 0, 9, 2, None, None, None)]
    got = sorted((r.lane, r.start, r.stop, r.activity) for r in svg.lanes(spark.createDataFrame(rows, RECORD)).collect())
    assert got == [(0, 10, 30, 2), (0, 40, 50, 6), (1, 20, 50, 4)]
    assert svg.drawing(spark.createDataFrame([], RECORD)).count() == 0


def test_sweep(spark):
    sweep = Sweep(pyramid(spark, Pyramid(workers=2, phase=SECOND)), Config(SECOND, 1000), steps(SECOND // 2, SECOND, 2), [1000, 10_000])
    assert sweep.paths().select("window", "threshold").distinct().count() == 4
    assert sweep.normalised(SECOND).filter("normalized_bc < 0 or normalized_bc > 1.01").count() == 0 and sweep.summaries().count() > 0


def test_harness_text(spark, tmp_path):
    (tmp_path / "out").write_text("EPOCH input 3 100\nEPOCH summary 3 170\nCOUNT 3 0 paths 12\nSUMMARY 3,4,0,0,0,S,2,40,1,20\nnoise\n")
    text = harness_text.lines(spark, str(tmp_path / "out"))
    assert tuple(harness_text.epochs(text).drop("app").first()) == (3, 100, 170, 12, 70)
    assert tuple(harness_text.summaries(text).drop("app").first()) == (3, 4, 0, 0, 0, "S", 2.0, 40.0, 1, 20)
    (tmp_path / "log").write_text("x\n12:00 COMPONENTS spout bolt\n")
    got = harness_text.components(harness_text.lines(spark, str(tmp_path / "log")), "COMPONENTS").collect()
    assert [(r.worker, r.component) for r in got] == [(0, "spout"), (1, "bolt")]


def test_stream_is_the_batch(spark, tmp_path):
    t = pyramid(spark, Pyramid(workers=3, phases=4, phase=SECOND))
    config = Config(window=SECOND, threshold=1000)
    for i in range(5):  # files in order of time, the last one closes the others' epochs
        part = t.filter(F.expr(f"ts div {SECOND} = {1_000_000 + i}")) if i < 4 else spark.createDataFrame([(10**6, 1_000_010 * SECOND, 0, 4, 1, None, None, 0)], RECORD)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = []
    stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = Progress()
    spark.streams.addListener(seen)
    query = analyse_stream(stream, config, 1000, lambda df, _: found.extend(map(tuple, df.collect())), str(tmp_path / "cp"), trigger={"availableNow": True})
    query.awaitTermination(120)
    for _ in range(50):  # listeners are told a little later
        if seen.ended:
            break
        time.sleep(0.2)
    spark.streams.removeListener(seen)
    assert sum(r[2] for r in seen.rows) == t.filter(F.expr(f"ts div {SECOND} < 1000004")).count() + 1 and seen.rows[-1][1] > "1970-01-12"
    want = sorted(tuple(r) for r in Analysis.of(t, config).summaries.filter("epoch < 1000004").collect())
    assert sorted(x for x in found if x[0] < 1000004) == want


def test_command_line(spark, tmp_path, capsys):
    out = str(tmp_path / "trace.parquet")
    assert cli.main(["generate", out, "--workers", "2", "--length-ms", "1000", "--infix", "BarrierProcessing"], spark) == 0
    assert cli.main(["verify", out], spark) == 0
    assert cli.main(["analyse", out, "1000", "1.0", "--output", str(tmp_path / "s"), "--pag-msgpack", str(tmp_path / "g")], spark) == 0
    lines = {r.value for r in spark.read.text(str(tmp_path / "s")).collect()}
    assert "SUMMARY 1000000,4,0,0,0,S,2,400000002,1,200000001" in lines
    assert msgpack.read(spark, str(tmp_path / "g")).count() == 16
    for command, mark in (("draw", "<rect"), ("chrome", '"ph":"B"'), ("spans", '"corr_id"'), ("show", "BarrierProcessing Start")):
        assert cli.main([command, out, str(tmp_path / command)], spark) == 0
        assert mark in "".join(open(f).read() for f in glob.glob(str(tmp_path / command / "part-*")))
    with pytest.raises(ValueError, match="within 0 and 1"):
        eventlog.scheduled(None, delay_split=2)


def test_queries_have_the_columns_of_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from critpath import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    for name in ("cp_summary", "path_counts", "single_path_summary", "message_edges", "worker_timeline"):
        df = queries.QUERIES[name](spark, DATA)
        cursor = con.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in cursor.description]
        assert sorted(df.columns) == sorted(columns)
        place = [columns.index(c) for c in sorted(columns)]
        rows = [tuple(r[i] for i in place) for r in cursor.fetchall()]
        assert sorted(map(tuple, df.select(*sorted(columns)).collect()), key=str) == sorted(rows, key=str)
