import json

import pytest

from duskwatch.operators.correlate import correlate, fired_events, incidents_of
from duskwatch.operators.detect import detect, detect_all, rule_frame
from duskwatch.operators.enrich import with_parent
from duskwatch.operators.quality import rule_quality
from duskwatch.rules import builtin_rules, community_rules, load_rule_files, load_rules
from duskwatch.sources.events import read_events

RULES = builtin_rules()

SHADOW = {"id": "R-0002", "name": "Read of the shadow file", "severity": "critical", "risk_score": 70,
          "technique": {"id": "T1003.008", "name": "/etc/shadow", "tactic": "credential-access"},
          "match": {"all": [{"field": "event.type", "op": "eq", "value": "open"},
                            {"field": "file.path", "op": "eq", "value": "/etc/shadow"}]}}


def chain(tmp_path):
    """nginx spawns a socket shell, which calls out and drops a miner from /tmp."""
    def event(second, action, pid, ppid, name, start, **more):
        process = {"pid": pid, "ppid": ppid, "name": name, "start_time_ns": start, **more.pop("process", {})}
        return {"@timestamp": f"2026-01-05T08:00:{second:06.3f}Z", "host": "web-9", "action": action,
                "process": process, "user": {"id": 33, "name": "www"}, **more}

    rows = [
        event(1.1, "exec", 500, 1, "nginx", 10, process={"executable": "/usr/sbin/nginx"}),
        event(2.2, "exec", 510, 500, "bash", 20, process={"executable": "/usr/bin/bash", "command_line": "bash -i", "stdio_socket": True}),
        event(2.5, "open", 510, 500, "bash", 20, file={"path": "/etc/shadow"}),
        event(3.0, "connect", 510, 500, "bash", 20, network={"dst_ip": "203.0.113.9", "dst_port": 4444}),
        event(4.0, "exec", 520, 510, "kworkerx", 30, process={"executable": "/tmp/.y/kworkerx", "command_line": "/tmp/.y/kworkerx -q"}),
        event(4.5, "connect", 520, 510, "kworkerx", 30, network={"dst_ip": "198.51.100.7", "dst_port": 4444}),
        event(5.0, "exec", 530, 510, "ls", 40, process={"executable": "/usr/bin/ls", "command_line": "ls -la"}),
    ]
    path = tmp_path / "chain.ndjson"
    path.write_text("\n".join(json.dumps(r) for r in rows[:3]) + "\n\n" + "\n".join(json.dumps(r) for r in rows[3:]) + "\n")
    return str(path)


def test_kill_chain(spark, tmp_path):
    df = with_parent(read_events(spark, chain(tmp_path)))
    alerts = detect(df, RULES)
    assert sorted((r.seq_, r.id) for r in alerts.selectExpr("process.pid seq_", "rule.id").collect()) == [
        (510, "R-0007"), (510, "R-0008"), (520, "R-0001"), (520, "R-0008")]
    incidents = correlate(alerts).orderBy("process_key").collect()
    assert [(r.process_key, r.risk_score, r.rule_ids) for r in incidents] == [
        ("510:20", 90, ["R-0007"]), ("520:30", 90, ["R-0001", "R-0008"])]
    assert incidents[0].id == "INC-web-9-1767600002200000000"
    assert incidents[1].techniques == ["T1036", "T1571"]
    assert detect(df, load_rules([*RULES, SHADOW])).count() == 5


def test_incident_forms_agree(spark, tmp_path):
    df = with_parent(read_events(spark, chain(tmp_path)))
    a, b = correlate(detect(df, RULES)), incidents_of(fired_events(df, RULES))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


E_ = lambda line, name="x": {"action": "exec", "process.name": name, "process.command_line": line}
SAMPLES = {
    "R-0001": {"action": "exec", "process.executable": "/dev/shm/a"}, "R-0003": {"action": "rename", "file.path": "/etc/cron.d/a"},
    "R-0004": {"action": "open", "file.path": "/lib/systemd/system/a"}, "R-0005": {"action": "open", "file.path": "/h/authorized_keys"},
    "R-0006": {"action": "chmod", "file.path": "/etc/ld.so.preload"},
    "R-0007": {"action": "exec", "process.name": "zsh", "process.parent_name": "java", "process.stdio_socket": True},
    "R-0008": {"action": "connect", "network.dst_port": 31337}, "R-0014": {"action": "unlink", "file.path": "/var/log/a"},
    "R-0015": {"action": "chmod", "file.mode": 2048}, "R-0016": {"action": "unlink", "file.path": "/r/.bash_history"},
    "R-0017": E_("w", "w"), "R-0018": E_("uname -a", "uname"), "R-0019": E_("find / -perm -4000"), "R-0020": E_("getent  passwd"),
    "R-0021": E_("ip neigh"), "R-0022": E_("ip route"), "R-0023": E_("ps -ef"), "R-0024": E_("", "zmap"),
    "R-0025": {"action": "exec", "process.name": "sftp", "process.parent_name": "perl"}, "R-0026": E_("ssh -o BatchMode=yes h"),
    "R-0027": E_("scp a u@h:"), "R-0028": {"action": "connect", "network.dst_port": 3389}, "R-0029": E_("tar c /home", "tar"),
    "R-0030": E_("cat key.pem"), "R-0031": E_("cp a /tmp/b", "cp"), "R-0032": E_("gpg -c f"), "R-0033": E_("nc h 1 < f"),
    "R-0034": E_("curl https://file.io"), "R-0035": E_("curl x -d @f"), "R-0036": {"action": "rename", "file.target": "a.locky"},
    "R-0037": E_("lvremove v"), "R-0038": E_("service a stop"), "R-0039": E_("rm -rf /"), "R-0040": {"action": "open", "process.command_line": "m stratum+ssl://p"},
    "R-0041": E_("init 6"), "R-0042": E_("mkfs.ext4 /dev/sda"), "R-0043": E_("wget a | bash"), "R-0044": E_("python -c 'pty.spawn'"),
    "R-0045": {"action": "connect", "process.command_line": "ssh -D 80 h"}, "R-0046": E_("", "redsocks"),
    "R-0060": {"action": "ptrace", "syscall.request": 16902}, "R-0061": {"action": "module_load"},
    "R-0062": {"action": "bpf", "process.name": "x"}, "R-0063": {"action": "memfd_create"}, "R-0064": {"action": "mmap_exec"},
    "R-0065": {"action": "setuid"}, "R-0066": {"action": "dns", "network.domain": "a" * 50 + ".x"},
    "R-0067": E_("setenforce 0"), "R-0068": E_("echo > /var/log/x"), "R-0069": E_("base64 -d f | sh"), "R-0074": {"action": "tamper"},
}
SILENT = [{"action": "open", "process.name": "nmap", "process.command_line": "rm -rf /"}, {"action": "exec", "process.name": "ls"},
          {"action": "connect", "network.dst_port": 443}, {"action": "chmod", "file.mode": 2047}, {"action": "rename", "file.target": "a.locky\n"},
          {"action": "bpf", "process.name": "bpftool"}, {"action": "setuid", "syscall.new_uid": 5}, {"action": "dns", "network.domain": "a.x"}]


def test_each_rule_fires(make):
    ids = list(SAMPLES)
    df = make([SAMPLES[i] for i in ids] + SILENT)
    fired = {}
    for r in detect(df, RULES).selectExpr("seq", "rule.id").collect():
        fired.setdefault(r.seq, set()).add(r.id)
    assert [i for n, i in enumerate(ids) if i not in fired.get(n, ())] == []
    assert all(n not in fired for n in range(len(ids), len(ids) + len(SILENT)))
    assert {r["id"] for r in RULES} - set(ids) == {"R-0050", "R-0073"}
    assert len(RULES) == 53 and len(community_rules()) == 2


def test_rule_quality_counts(make):
    rows = [{**SAMPLES["R-0061"]}, {**SAMPLES["R-0061"]}, {"action": "exec"}, {"action": "exec"}, {"action": "exec"}]
    from pyspark.sql import functions as F

    tests = [("a", "R-0061", "fire"), ("b", "R-0061", "no-fire"), ("c", "R-0063", "fire"), ("d", "R-0063", "no-fire"), ("e", "R-none", "fire")]
    pick = lambda k: F.element_at(F.array(*[F.lit(t[k]) for t in tests]), F.col("seq").cast("int") + 1)
    fixtures = make(rows).withColumns({"name": pick(0), "test_rule": pick(1), "expect": pick(2)})
    (r,) = rule_quality(RULES, fixtures).collect()
    assert (r.total, r.passed, r.false_positives, r.false_negatives, r.false_positive_rate) == (5, 2, 1, 2, 0.5)
    assert len(r.untested) == 51 and "R-0061" not in r.untested


def test_rule_loading(tmp_path):
    with pytest.raises(ValueError):
        load_rules([RULES[0], RULES[0]])
    with pytest.raises(ValueError):
        load_rules([{**RULES[0], "extra": 1}])
    assert load_rules([{**RULES[0], "enabled": False}]) == []
    path = tmp_path / "r.yaml"
    path.write_text("- id: X-1\n  name: x\n  severity: low\n  match: {field: process.name, op: eq, value: id}\n")
    (rule,) = load_rule_files([str(path)])
    assert rule["risk_score"] == 0 and rule["enabled"]


def test_one_pass_over_events(make):
    plan = detect(make([SAMPLES["R-0001"]]), RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "Union" not in plan and "CartesianProduct" not in plan


def test_indicator_alert_precedence(spark, make):
    from duskwatch.sources.indicators import classify

    feed = classify(spark.createDataFrame([
        ("203.0.113.0/24 # wide", "a.txt", 0), ("203.0.113.9", "b.txt", 1), ("203.0.113.0/28", "c.txt", 2),
        ("2001:db8::/32", "d.txt", 3), ("bad/99", "e.txt", 4), ("EVIL.example", "f.txt", 5), ("ab" * 32, "g.txt", 6),
        ("evil.example", "h.txt", 7)], "value string, source string, ord long"))
    df = make([{"action": "connect", "network.dst_ip": "203.0.113.9", "network.src_ip": "203.0.113.1"},
               {"action": "dns", "network.domain": "Evil.Example", "network.dst_ip": "2001:db8::5"},
               {"action": "exec", "process.sha256": "AB" * 32}, {"action": "connect", "network.dst_ip": "192.0.2.1"}])
    got = {(r.seq, r.id, r.description) for r in detect_all(df, [], feed).selectExpr("seq", "rule.id", "rule.description").collect()}
    say = lambda field, what, source: f'{field} "{what}" matched an indicator from feed {source}'
    assert got == {(0, "INTEL-IP", say("destination.ip", "203.0.113.9", "b.txt")), (0, "INTEL-IP", say("source.ip", "203.0.113.1", "a.txt")),
                   (1, "INTEL-DOMAIN", say("network.domain", "Evil.Example", "h.txt")), (1, "INTEL-IP", say("destination.ip", "2001:db8::5", "d.txt")),
                   (2, "INTEL-HASH", say("process.sha256", "AB" * 32, "g.txt"))}
    assert rule_frame(spark, RULES).count() == 53
