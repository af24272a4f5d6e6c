import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import audit, investigate, metrics, respond
from duskwatch.rules import builtin_rules

RECORD = ("id string, agent_id string, hostname string, time timestamp, rule_id string, rule_name string, severity string, "
          "technique_id string, technique_name string, pid long, process_name string, process_executable string, "
          "destination_ip string, risk_score long, is_incident boolean, seq long")


def record(spark, rows):
    from event_helpers import BASE
    from datetime import timedelta

    full = [(r.get("id", f"a{i}"), "ag", r.get("host", "h"), BASE + timedelta(minutes=r.get("at", i)), r.get("rule", "R-0001"),
             r.get("name", "n"), r.get("severity", "high"), r.get("technique", ""), r.get("tname", ""), r.get("pid", 1),
             r.get("process", "p"), "", r.get("ip", ""), r.get("risk", 50), r.get("incident", False), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, RECORD)


def test_graph(spark, make):
    df = make([{"host": "h", "action": "exec", "process.pid": 58, "process.ppid": 41, "process.name": "dash", "process.command_line": "dash -c ls",
                "process.parent_name": "ngrok"},
               {"host": "h", "action": "open", "process.pid": 58, "process.name": "other", "file.path": "/srv/ledger"},
               {"host": "h", "action": "connect", "process.pid": 58, "network.dst_ip": "192.0.2.61", "network.dst_port": 7070},
               {"host": "h", "action": "dns", "process.pid": 77, "network.domain": "a.b", "network.dst_ip": "192.0.2.9"},
               {"host": "h", "action": "open", "process.pid": 58, "file.path": "/srv/ledger"}])
    nodes, edges = investigate.graph_nodes(df), investigate.graph_edges(df)
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {
        ("proc:41", "proc:58", "spawned"), ("proc:58", "file:/srv/ledger", "opened"),
        ("proc:58", "net:192.0.2.61:7070", "connected"), ("proc:77", "net:a.b", "resolved")}
    got = {r.id: (r.label, r.detail) for r in nodes.collect()}
    assert got["proc:58"] == ("dash", "dash -c ls") and got["proc:41"] == ("ngrok", "") and got["proc:77"] == ("pid 77", "")
    assert got["file:/srv/ledger"] == ("ledger", "/srv/ledger") and len(got) == 6
    alerts = record(spark, [{"pid": 58, "technique": "T1059", "severity": "high"}, {"pid": 58, "technique": "T1003", "severity": "critical"},
                            {"pid": 999, "technique": "T1"}])
    marked = {r.id: r for r in investigate.annotate(nodes, alerts).collect()}
    assert marked["proc:58"].techniques == ["T1003", "T1059"] and marked["proc:58"].severity == "critical"
    assert not marked["proc:41"].alerting and len(marked) == 6


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_with_cycles(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(14)]
    raw = {(rng.choice(names), rng.choice(names), rng.choice(["spawned", "opened"])) for _ in range(16)} | {("gone", "n03", "opened")}
    parent, touch, layer = {}, {}, {}
    for s, t, k in sorted(raw):
        if k == "spawned":
            parent[t] = s
        else:
            touch.setdefault(t, s)

    def depth(n, seen):
        if n in layer:
            return layer[n]
        if n in seen:
            return 0
        seen.add(n)
        up = parent.get(n, touch.get(n))
        layer[n] = depth(up, seen) + 1 if up in names else 0
        return layer[n]

    for n in names:
        depth(n, set())
    nodes = spark.createDataFrame([("h", n) for n in names], "host string, id string")
    edges = spark.createDataFrame([("h", *e) for e in raw], "host string, source string, target string, kind string")
    assert {r.id: r.layer for r in investigate.graph_layers(nodes, edges).collect()} == layer


@pytest.mark.parametrize("own, severity, ip, response, want", [
    (10, "low", "", "kill", "kill"), (95, "low", "", "", "kill"), (80, "low", "1.1.1.1", "", "network_block"), (80, "low", "", "", "throttle"),
    (60, "low", "", "", "throttle"), (20, "low", "", "", "alert_only"), (0, "critical", "", "", "kill"), (0, "high", "1.1.1.1", "", "network_block"),
    (0, "medium", "", "", "throttle"), (0, "low", "", "", "alert_only")])
def test_response_ladder(spark, own, severity, ip, response, want):
    df = spark.createDataFrame([((own, severity, response), (ip,))],
                               "rule struct<risk_score:int,severity:string,response:string>, network struct<dst_ip:string>")
    assert df.select(respond.response_action()).collect()[0][0] == want


def test_posture_and_playbooks(spark):
    assert respond.clamp_posture("enforce", "dry-run") == "dry-run" and respond.clamp_posture("bogus", "enforce") == "off"
    books = [{"id": "a", "name": "A", "mode": "enforce", "trigger": {"severities": ["HIGH"], "min_risk": 50},
              "steps": [{"type": "quarantine"}, {"type": "run_hunt", "query": "q"}]},
             {"id": "b", "name": "B", "mode": "dry-run", "trigger": {"techniques": ["T1"]}, "steps": [{"type": "kill_process"}, {"type": "run_hunt", "query": "q"}]},
             {"id": "c", "name": "C", "mode": "off", "trigger": {}, "steps": [{"type": "notify"}]},
             {"id": "d", "name": "D", "mode": "enforce", "trigger": {"incidents_only": True}, "steps": [{"type": "open_case"}]}]
    alerts = record(spark, [{"technique": "T1", "pid": 9}, {"severity": "low", "incident": True}, {"risk": 49}])
    runs = respond.expand_steps(respond.match_playbooks(alerts, books)).collect()
    got = {(r.alert_id, r.playbook_id, r.type): (r.detail, r.executed, bool(r.error)) for r in runs}
    assert got == {("a0", "a", "quarantine"): ("quarantine ", False, True), ("a0", "a", "run_hunt"): ("hunt q", True, False),
                   ("a0", "b", "kill_process"): ("would ask h to kill pid 9", False, False), ("a0", "b", "run_hunt"): ("hunt q", True, False),
                   ("a1", "d", "open_case"): ("open case n", True, False)}
    for bad in ({"name": ""}, {"mode": "x"}, {"steps": []}, {"steps": [{"type": "x"}]}, {"steps": [{"type": "run_hunt"}]}):
        with pytest.raises(ValueError):
            respond.check_playbook({**books[0], **bad})


def test_alert_history(spark):
    from event_helpers import BASE
    from datetime import timedelta

    rows = record(spark, [{"host": "a", "severity": "high", "technique": "T1"}, {"host": "b", "severity": "low"}, {"host": "a", "incident": True, "severity": "critical"}])
    n = lambda **k: investigate.query_alerts(rows, **k).count()
    assert [n(host="a"), n(severity="low"), n(technique="T1"), n(incidents_only=True), n(limit=2), n(host="z"),
            n(since=BASE + timedelta(minutes=1)), n(until=BASE + timedelta(minutes=1))] == [2, 1, 1, 1, 2, 0, 2, 2]
    assert [r.seq for r in investigate.query_alerts(rows).collect()] == [2, 1, 0]
    assert investigate.alert_by_id(rows, "a1").count() == 1


def chain(key=None, log="l", n=6):
    rows, prev = [], ""
    for seq in range(1, n + 1):
        body = [str(seq), f"2026-01-01T00:00:0{seq}Z", "op", "act", f"t{seq}", "d", prev]
        digest = hashlib.sha256("\x1f".join(body).encode()).hexdigest()
        sig = hmac.new(key, digest.encode(), hashlib.sha256).hexdigest() if key else ""
        rows.append([log, seq, *body[1:], digest, sig])
        prev = digest
    return rows


@pytest.mark.parametrize("key", [None, b"secret", b"k" * 100])
def test_audit_chain(spark, key, monkeypatch):
    monkeypatch.setattr(audit, "SPAN", 2)
    tampered, forged, dropped = chain(key, "t"), chain(key, "f"), chain(key, "d")
    tampered[3][6] = "changed"
    forged[2][7] = "0" * 64
    del dropped[2]
    unsigned = chain(None, "u")
    rows = chain(key, "ok") + tampered + forged + dropped + unsigned
    df = spark.createDataFrame([tuple(r) for r in rows], "log string, seq long, time string, actor string, action string, target string, "
                                                         "detail string, prev_hash string, hash string, sig string")
    got = {r.log: (r.valid, r.bad_seq, (r.problem or "").split(" (")[0]) for r in audit.verify_chain(df, key).collect()}
    assert got["ok"] == (True, None, "") and got["t"] == (False, 4, "hash mismatch")
    assert got["f"] == (False, 3, "chain broken") and got["d"] == (False, 4, "chain broken")
    assert got["u"] == ((False, 1, "signature mismatch") if key else (True, None, ""))


def test_bucket_quantile(spark):
    df = spark.createDataFrame([(float(v), "x") for v in range(1, 101)], "v double, l string")
    h = metrics.histogram(df, "v", [10, 50, 90], "l")
    assert [(r["le"], r["count"]) for r in h.orderBy("le").collect()] == [(10.0, 10), (50.0, 50), (90.0, 90), (float("inf"), 100)]
    assert metrics.bucket_quantile(h, 0.3).collect()[0].quantile == pytest.approx(30.0)
    assert metrics.bucket_quantile(h, 0.95).collect()[0].quantile == 90.0
    assert len(metrics.LATENCY_BOUNDS) == 11 and len(builtin_rules()) == 53


def test_layers_of_a_long_ring_take_few_jobs(spark):
    """A ring of 100 nodes with a tail: jobs grow with the logarithm, not the length."""
    n = 100
    nodes = spark.createDataFrame([("h", f"r{i:05d}") for i in range(n)] + [("h", "a"), ("h", "b")], "host string, id string")
    edges = spark.createDataFrame([("h", f"r{i:05d}", f"r{(i + 1) % n:05d}", "spawned") for i in range(n)] + [
        ("h", "r00070", "b", "opened"), ("h", "b", "a", "opened")], "host string, source string, target string, kind string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ring", "ring")
    got = {r.id: r.layer for r in investigate.graph_layers(nodes, edges).collect()}
    jobs = len(tracker.getJobIdsForGroup("ring"))
    spark.sparkContext.setJobGroup("rest", "rest")
    entry = got["r00000"]
    assert jobs < 300 and len(got) == n + 2 and sorted(v for k, v in got.items() if k.startswith("r")) == list(range(min(got.values()), min(got.values()) + n))
    assert got["a"] == got["b"] + 1 == got["r00070"] + 2 and entry >= 0
