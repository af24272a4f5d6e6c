"""Two-level scans against sequential models on random streams, with buckets small enough to hand state on."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import correlate, enrich, hunt, ordered
from duskwatch.schema import micros

L = lambda field, op, value=None: {"field": field, "op": op, "value": value}


def stream(seed, n=250, span=600, hosts=2, pids=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        action = rng.choice(["exec", "fork", "exit", "open", "connect", "exec_blocked"])
        rows.append({"seq": i, "at": rng.randrange(span), "host": f"h{rng.randrange(hosts)}", "action": action,
                     "process.pid": rng.randrange(1, pids + 1), "process.ppid": rng.randrange(0, pids + 1),
                     "process.name": rng.choice("abc"), "process.executable": rng.choice(["/x", "", None]),
                     "process.start_time_ns": rng.choice([0, 5, 9]), "network.dst_port": rng.choice([0, 22, 4444])})
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r["at"], r["seq"]))


@pytest.mark.parametrize("seed, bucket", [(1, 1), (2, 7), (3, 10_000)])
def test_process_tree(make, seed, bucket):
    rows = stream(seed)
    want, table = {}, {}
    for r in in_order(rows):
        procs = table.setdefault(r["host"], {})
        pid, ppid = r["process.pid"], r["process.ppid"]
        if r["action"] in ("exec", "exec_blocked", "fork"):
            exe = (r["process.executable"] or "") if r["action"] != "fork" else ""
            procs[pid] = (ppid, r["process.name"], exe, r["process.start_time_ns"])
        elif r["action"] == "exit":
            procs.pop(pid, None)
        parent, own, chain, cur = procs.get(ppid), procs.get(pid), [], ppid
        passed = {0, pid}
        while cur not in passed and cur in procs:
            passed.add(cur)
            chain.append(procs[cur][1])
            cur = procs[cur][0]
        start = own[3] if own and r["process.start_time_ns"] == 0 else r["process.start_time_ns"]
        want[r["seq"]] = (parent[1] if parent else None, parent[2] if parent else None, start, chain or None)
    width = timedelta(seconds=bucket)
    df = make(rows)
    full = enrich.with_ancestry(enrich.with_start(enrich.with_parent(df, width), width), bucket=width)
    got = {r.seq: tuple(r)[1:] for r in full.selectExpr(
        "seq", "process.parent_name", "process.parent_executable", "process.start_time_ns", "process.ancestors").collect()}
    # with_start runs first in the model's event, but chains do not depend on it.
    assert got == want


def test_ancestry_looks_up_only_processes_asked_for(make, spark, monkeypatch):
    """A level reads the updates of the processes its rows ask for; a repeated event has one chain."""
    sizes, lookup = [], enrich.process_as_of

    def counted(probes, updates, *rest):
        sizes.append((probes.count(), updates.count()))
        return lookup(probes, updates, *rest)

    monkeypatch.setattr(enrich, "process_as_of", counted)
    # Process n is a child of n - 1; then an event of process 3 twice and one of process 1.
    rows = [{"host": "h", "action": "exec", "process.pid": n, "process.ppid": n - 1, "process.name": f"p{n}", "at": n, "seq": n} for n in range(1, 9)]
    rows += [{"host": "h", "action": "open", "process.pid": p, "process.ppid": p - 1, "at": 20, "seq": 10 + p} for p in (3, 3, 1)]
    events = make(rows).filter("seq < 4 or seq > 10 or seq = 8")
    got = {r.seq: r.ancestors for r in enrich.ancestry(events).collect()}
    assert got == {2: ["p1"], 3: ["p2", "p1"], 13: ["p2", "p1"]} and len(got) == enrich.ancestry(events).count()
    # Asked for: 1, 2 and 7 (which has no update), then 1.
    assert sizes[:2] == [(5, 2), (3, 1)] and len(sizes) == 4
    near = {r.seq: r.ancestors for r in enrich.ancestry(events, 1).collect()}
    assert near == {2: ["p1"], 3: ["p2"], 13: ["p2"]} and enrich.ancestry(events, 0).count() == 0


@pytest.mark.parametrize("seed, bucket, gap", [(4, 3, 30), (5, 20, 10), (6, 10_000, 5)])
def test_incidents(make, spark, seed, bucket, gap):
    rng = random.Random(seed)
    raw = [(f"h{rng.randrange(2)}", f"{rng.randrange(3)}:0", rng.randrange(800) * 1_000_000, i, rng.choice([10, 25, 40]),
            [(o, f"R{o}", rng.choice(["", f"T{o}"])) for o in sorted(rng.sample(range(5), rng.randrange(1, 3)))]) for i in range(220)]
    want, state = [], {}
    for host, key, us, seq, risk, fired in sorted(raw, key=lambda r: (r[2], r[3])):
        s = state.get((host, key))
        if s is None or us - s["last"] > gap * 1_000_000:
            s = state[host, key] = {"first": us, "score": 0, "t": set(), "r": [], "open": False}
        s["score"] += risk
        s["t"] |= {t for _, _, t in fired if t}
        s["r"] += [r for _, r, _ in fired if r not in s["r"]]
        s["last"] = us
        if not s["open"] and s["score"] >= 75:
            s["open"] = True
            want.append((host, key, s["first"], us, s["score"], sorted(s["t"]), list(s["r"])))
    events = spark.createDataFrame([(*r[:5], "n", 1, r[5]) for r in raw],
                                   "host string, process_key string, us long, seq long, risk long, name string, pid long, "
                                   "fired array<struct<ord:int,rule_id:string,technique_id:string>>")
    out = correlate.incidents_of(events, timedelta(seconds=gap), 75, timedelta(seconds=bucket))
    got = [tuple(r) for r in out.select("host", "process_key", micros("first_seen"), micros("last_seen"), "risk_score",
                                        "techniques", "rule_ids").collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("seed, chunk, window", [(7, 1, 20), (8, 3, 9), (9, 16, 60)])
def test_fleet_signals(spark, seed, chunk, window):
    rng = random.Random(seed)
    base = 1_700_000_000
    raw = [(f"k{rng.randrange(3)}", f"h{rng.randrange(5)}", base + rng.randrange(1500), i) for i in range(400)]
    want, state = [], {}
    for key, host, at, seq in sorted(raw, key=lambda r: (r[2], r[3])):
        w = state.get(key)
        if w is None or at - w["first"] > window:
            w = state[key] = {"first": at, "hosts": {}, "fired": False}
        w["hosts"][host] = at
        w["hosts"] = {h: s for h, s in w["hosts"].items() if at - s <= window}
        if not w["fired"] and len(w["hosts"]) >= 3:
            w["fired"] = True
            want.append((key, sorted(w["hosts"]), w["first"], at))
    records = spark.createDataFrame(raw, "technique_id string, hostname string, sec long, seq long") \
        .select("technique_id", "hostname", F.timestamp_seconds("sec").alias("time"), "seq", F.lit("").alias("destination_ip"))
    seen = correlate.sightings(records)
    labelled = correlate.anchored_windows(seen, timedelta(seconds=window), chunk)
    anchors = {}
    for key, _, at, _ in sorted(raw, key=lambda r: (r[2], r[3])):
        last = anchors.setdefault(key, [at])
        if at - last[-1] > window:
            last.append(at)
    got_anchors = {}
    for r in labelled.select("key", "anchor").distinct().collect():
        got_anchors.setdefault(r.key, []).append(r.anchor // 1_000_000)
    assert {k: sorted(v) for k, v in got_anchors.items()} == anchors
    out = correlate.fleet_signals(records, timedelta(seconds=window), 3)
    got = [(r.key, r.hosts, r.f, r.l) for r in out.selectExpr("key", "hosts", "unix_seconds(first_seen) f", "unix_seconds(last_seen) l").collect()]
    assert sorted(got) == sorted(want) and want


@pytest.mark.parametrize("seed, within", [(10, None), (11, 40), (12, 5), (13, None)])
def test_sequences(make, seed, within):
    rows = stream(seed, 160, 300)
    stages = [("exec", L("process.name", "==", "a")), ("any", L("destination.port", "==", 22)), ("connect", None)]
    tests = [lambda r: r["action"] == "exec" and r["process.name"] == "a", lambda r: r["network.dst_port"] == 22,
             lambda r: r["action"] == "connect"]
    want, groups = [], {}
    for r in in_order(rows):
        groups.setdefault(r["host"], []).append(r)
    for group in groups.values():
        open_, done = [], []
        for r in group:
            kept = []
            for p in open_:
                if within and r["at"] - p[0]["at"] > within:
                    continue
                if tests[len(p)](r):
                    p = [*p, r]
                    if len(p) == 3:
                        done.append(p)
                        continue
                kept.append(p)
            open_ = kept + ([[r]] if tests[0](r) else [])
        want += [tuple(r["seq"] for r in p) for p in done]
    out = hunt.sequence(make(rows), stages, "host.name", within and timedelta(seconds=within), timedelta(seconds=11))
    got = [tuple(r) for r in out.select("e0.seq", "e1.seq", "e2.seq").collect()]
    assert sorted(got) == sorted(want) and want


def test_sequence_reads_its_input_once(make):
    """The source is read for the written rows alone; what stays is one scan by bucket and one over bucket summaries."""
    out = hunt.sequence(make(stream(1, 5)), [("exec", None), ("open", None), ("connect", None)], "host.name", timedelta(hours=1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "process.name" not in plan and plan.count("Scan ExistingRDD") <= 2


def test_sequence_over_one_hot_group(make):
    """All hosts in one group and a limit far wider than a bucket: the same chains as a sequential scan finds."""
    rows = in_order(stream(9, 400, span=2000))
    df = make(rows)
    stages = [("exec", None), ("exit", None), ("connect", None)]
    got = sorted(tuple(r) for r in hunt.sequence(df, stages, None, timedelta(seconds=300), timedelta(seconds=20)).select(
        "e0.seq", "e1.seq", "e2.seq").collect())

    def after(i, action):
        return next((j for j in range(i + 1, len(rows)) if rows[j]["action"] == action), None)

    want = []
    for i, r in enumerate(rows):
        if r["action"] == "exec":
            j = after(i, "exit")
            k = after(j, "connect") if j is not None else None
            if k is not None and rows[k]["at"] - r["at"] <= 300:
                want.append((r["seq"], rows[j]["seq"], rows[k]["seq"]))
    assert got == sorted(want) and len(want) > 20


def test_number_rows(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 101).alias("v"))
    got = ordered.number_rows(df, ["v"], F.floor(F.col("v") / 10)).orderBy("number").collect()
    assert [r.number for r in got] == list(range(1, 101)) and [r.v for r in got] == sorted(r.v for r in got)


def test_nearest_forward_inclusive(spark):
    df = spark.createDataFrame([(i, None if i % 3 else i) for i in range(20)], "i long, v long").withColumn("k", F.lit("x"))
    back = {r.i: r.o for r in ordered.nearest(df, ["k"], ["i"], F.col("v"), "o", F.floor(F.col("i") / 4), inclusive=True).collect()}
    ahead = {r.i: r.o for r in ordered.nearest(df, ["k"], ["i"], F.col("v"), "o", F.floor(F.col("i") / 4), forward=True).collect()}
    assert back == {i: i - i % 3 for i in range(20)}
    assert ahead == {i: i - i % 3 + 3 if i - i % 3 + 3 < 20 else None for i in range(20)}
