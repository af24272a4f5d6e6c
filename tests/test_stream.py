import json
from datetime import timedelta

from pyspark.sql import functions as F

from duskwatch.operators import correlate, enrich, export
from duskwatch.operators.detect import detect
from duskwatch.rules import builtin_rules
from duskwatch.schema import EVENT, micros
from duskwatch.streaming import live, replay, stateful

from test_ordered import stream

RULES = builtin_rules()


def noisy(make, n=120):
    rows = stream(21, n, 900)
    for r in rows:
        r["process.start_time_ns"] = 5
        r["process.command_line"] = ["curl a | sh", "whoami", "id", "ps aux"][r["seq"] % 4]
        r["process.name"] = "whoami"
        r["network.dst_ip"] = f"203.0.113.{r['seq'] % 3}" if r["network.dst_port"] else ""
    return make(rows)


def slices(spark, df, path, n=3):
    """Event-time slices written as separate files, read back one file per micro-batch."""
    df = df.withColumn("_n", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy("ts", "seq"))).persist()
    for i in range(1, n + 1):
        df.filter(F.col("_n") == i).drop("_n").coalesce(1).write.mode("append").parquet(path)
    names = df.drop("_n").schema
    return spark.readStream.schema(names).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, out, name, tmp_path, mode="append"):
    query = (out.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(tmp_path / f"ckpt_{name}")).trigger(availableNow=True).start())
    query.awaitTermination(180)
    return spark.table(name)


def test_incidents_as_they_happen(spark, make, tmp_path):
    df = noisy(make)
    got = drain(spark, stateful.stream_incidents(slices(spark, df, str(tmp_path / "in")), RULES, timedelta(seconds=200), 30), "inc", tmp_path)
    want = correlate.incidents_of(correlate.fired_events(df, RULES), timedelta(seconds=200), 30)
    want = want.select("host", "process_key", micros("last_seen"), "seq", micros("first_seen"), "risk_score", "techniques", "rule_ids", "name", "pid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 1


def test_sessions_of_many_processes_share_state_calls():
    class Held:
        value, calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.calls, self.value = self.calls + 1, None

    class Timers(list):
        registerTimer = list.append

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    import pandas as pd

    processor = stateful._Incidents(10_000_000, 50, [("R0", "T0"), ("R1", "")])
    processor.state, processor.handle = Held(), Timers()

    def run(first, at):
        rows = [{"host": "h", "process_key": f"{n}:1", "us": at * 1_000_000 + n, "seq": n, "risk": 30, "ords": [0, 1], "name": "x", "pid": n}
                for n in range(first, 300)]
        (out,) = processor.handleInputRows((0,), iter([pd.DataFrame(rows)]), None)
        return list(out.itertuples(index=False, name=None))

    assert run(0, 0) == [] and processor.state.calls == 2 and processor.handle == [10_001]
    # Half of the processes cross; a third row of one after its incident tells nothing new.
    want = [("h", f"{n}:1", 5_000_000 + n, n, n, 60, ["T0"], ["R0", "R1"], "x", n) for n in range(150, 300)]
    assert run(150, 5) == want and run(150, 6) == [] and processor.state.calls == 6 and len(processor.handle) == 1
    # At 10.001 s only what saw its last row at 0 s goes, and the next timer is for the first of the rest.
    list(processor.handleExpiredTimer((0,), Mark(10_001), None))
    assert [k for k in processor.state.value[1]] == [f"{n}:1" for n in range(150, 300)] and processor.handle[1:] == [16_001]
    list(processor.handleExpiredTimer((0,), Mark(20_000), None))
    assert processor.state.value is None and len(processor.handle) == 2


def test_signals_as_they_happen(spark, make, tmp_path):
    df = noisy(make)
    records = export.flatten_alerts(detect(df, RULES))
    source = slices(spark, records.withColumn("ts", F.col("time")), str(tmp_path / "rec"))
    got = drain(spark, stateful.stream_signals(source.drop("ts"), timedelta(seconds=90), 2), "sig", tmp_path)
    want = correlate.fleet_signals(records, timedelta(seconds=90), 2).select("kind", "key", "hosts", micros("first_seen"), micros("last_seen"))
    assert sorted(map(tuple, got.drop("seq").collect())) == sorted(map(tuple, want.collect())) and want.count() > 2


def test_process_tree_as_it_grows(spark, make, tmp_path):
    df = make(stream(22, 120, 300))
    got = drain(spark, stateful.stream_process_tree(slices(spark, df, str(tmp_path / "t"))), "tree", tmp_path)
    batch = enrich.with_ancestry(enrich.with_start(enrich.with_parent(df)))
    want = {r.seq: r for r in batch.selectExpr("seq", "coalesce(process.parent_name, '') p", "process.start_time_ns s", "process.ancestors a").collect()}
    rows = got.collect()
    assert len(rows) == 120
    for r in rows:
        assert (r.parent_name, r.start_time_ns, r.ancestors) == (want[r.seq].p, want[r.seq].s, want[r.seq].a)


def test_replay_with_a_rule_swap(spark, make, tmp_path):
    df = noisy(make, 40)
    # Both sets fire on these events: each holds every second of the rules that do.
    firing = sorted(r.id for r in detect(df, RULES).selectExpr("rule.id").distinct().collect())
    old, new = ([r for r in RULES if r["id"] in firing[i::2]] for i in (0, 1))
    assert old and new
    current, out, parts = [], str(tmp_path / "swapped"), replay.even_slices(df, F.col("seq"), 2)
    replay.replay(df, parts, str(tmp_path / "swap"), lambda s: live.detect_stream(
        s, lambda: current[0], [lambda b: b.write.mode("append").parquet(out)], str(tmp_path / "swap_c")),
        lambda n: current.__setitem__(slice(None), [new if n else old]))
    want = export.flatten_alerts(detect(df.filter("seq < 20"), old)).unionByName(export.flatten_alerts(detect(df.filter("seq >= 20"), new)))
    got = spark.read.parquet(out)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    # The swap shows: neither rule set alone gives these rows.
    for rules in (old, new):
        assert not export.flatten_alerts(detect(df, rules)).exceptAll(got).isEmpty()


def test_late_rows_are_a_second_output(spark, make, tmp_path):
    times = [0, 100, 400, 30, 350, 380, 10, 500]
    df = make([{"action": "exec", "at": at, "seq": i} for i, at in enumerate(times)]).select("seq", "ts")
    df = df.unionByName(df.limit(1).select(F.lit(8).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("ts")))
    kept, rows = [], []
    collect = lambda into: lambda part: into.extend(r.seq for r in part.collect())
    replay.replay(df, F.floor(F.col("seq") / 3).cast("int"), str(tmp_path), lambda s: live.split_late(
        s, timedelta(seconds=60), collect(kept), collect(rows), str(tmp_path / "c")))
    # The mark after rows 0 to 2 is 340 s; each slice ran as a query of its own from the checkpoint.
    assert sorted(rows) == [3, 6] and sorted(kept) == [0, 1, 2, 4, 5, 7, 8]


def test_replay_of_an_empty_table(spark, make, tmp_path):
    df = make([{"action": "exec"}]).select("seq", "ts").filter("seq < 0")
    kept = []
    replay.replay(df, replay.time_slices(df, 3), str(tmp_path), lambda s: live.split_late(
        s, timedelta(seconds=60), lambda part: kept.extend(part.collect()), lambda part: None, str(tmp_path / "c")))
    assert kept == []


def test_lost_exits_do_not_grow_the_process_tree():
    class Held:
        value = None
        get = lambda self: self.value
        def update(self, value):
            self.value = value

    processor = stateful._ProcessTree(None, 10_000_000)
    processor.live, sizes = Held(), []
    import pandas as pd

    for n in range(50):
        # One process a second that never exits, all children of process 1.
        rows = pd.DataFrame([{"us": n * 1_000_000, "seq": n, "action": "exec", "pid": 100 + n, "ppid": 1, "name": "x", "executable": "/x",
                              "start": 1, "parent_name": "", "parent_executable": ""}])
        if n == 0:
            rows = pd.concat([rows.assign(pid=1, ppid=0, name="init"), rows])
        (out,) = processor.handleInputRows(("h",), iter([rows]), None)
        assert out["parent_name"].iloc[-1] == "init"
        sizes.append(len(processor.live.value[0]))
    assert max(sizes) == 12 and sizes[-1] == 12 and 1 in processor.live.value[0]


def test_replay_equals_batch(spark, make, tmp_path):
    df = noisy(make, 40)
    source = slices(spark, df, str(tmp_path / "d"), 2)
    out = str(tmp_path / "alerts")
    live.run_available(live.detect_stream(source, lambda: RULES, [lambda b: b.write.mode("append").parquet(out)], str(tmp_path / "c")))
    want = export.flatten_alerts(detect(df, RULES))
    got = spark.read.parquet(out)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    tail = live.tail_alerts(got, host="h1", severity="LOW")
    assert tail.count() == want.filter("hostname = 'h1' and severity = 'low'").count() > 0


def test_rates_and_idempotent_append(spark, make, tmp_path):
    df = make([{"action": "exec", "at": 60 * i, "seq": i} for i in range(30)])
    source = slices(spark, df.unionByName(df.filter("seq < 5")), str(tmp_path / "r"))
    once = drain(spark, live.append_once(source), "once", tmp_path)
    assert once.count() == 30
    rates = drain(spark, live.rate_stream(slices(spark, df, str(tmp_path / "q")), timedelta(minutes=5), "1 minute"), "rates", tmp_path)
    closed = rates.collect()
    assert len(closed) >= 4 and all(r.n == 5 for r in closed)
    on_time, late = live.late_rows(df, int(df.agg(micros(F.max("ts"))).collect()[0][0]))
    assert on_time.count() == 1 and late.count() == 29


def test_event_file_stream(spark, tmp_path):
    from duskwatch.sources.events import stream_events

    folder = tmp_path / "ev"
    folder.mkdir()
    (folder / "a.ndjson").write_text(json.dumps({"@timestamp": "2026-01-01T00:00:00Z", "action": "exec"}) + "\n")
    got = drain(spark, stream_events(spark, str(folder)), "raw", tmp_path)
    assert got.columns == EVENT.fieldNames() and got.collect()[0].event_type == 1
