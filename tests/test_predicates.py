import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from duskwatch.functions.ip import MAPPED, in_network, ip_hex
from duskwatch.functions.predicates import check_tree, hunt_predicate, java_regex, rule_predicate
from duskwatch.functions.sigma import Unsupported, sigma_match, sigma_rule
from duskwatch.operators.detect import detect
from duskwatch.operators.hunt import hunt, promote, sequence
from duskwatch.rules import load_rules
from datetime import timedelta

L = lambda field, op, value=None: {"field": field, "op": op, "value": value}


def truth(df, *columns):
    return [tuple(r) for r in df.orderBy("seq").select(*columns).collect()]


def test_absent_fields_differ_by_dialect(make):
    df = make([{"action": "exec"}, {"action": "exec", "user.name": "root", "network.dst_port": 22}])
    got = truth(
        df, rule_predicate(L("user.name", "ne", "root")), hunt_predicate(L("user.name", "!=", "root")),
        rule_predicate(L("destination.port", "not_in", [22])), rule_predicate({"not": L("user.name", "eq", "root")}),
        hunt_predicate({"not": L("user.name", "==", "root")}), rule_predicate(L("user.name", "exists")),
        rule_predicate(L("file.mode", "exists")), rule_predicate(L("user.name", "in", ["root", ""])),
        rule_predicate(L("user.name", "regex", "^$")), rule_predicate(L("user.name", "contains", "")))
    assert got == [(True, False, True, True, True, False, True, False, False, False),
                   (False, False, False, False, False, True, True, True, False, True)]


def test_typed_comparison(make):
    df = make([{"action": "exec", "process.pid": 42, "process.name": "7", "process.stdio_socket": True}])
    got = truth(
        df, rule_predicate(L("process.pid", "eq", "42")), rule_predicate(L("process.pid", "eq", "x")),
        rule_predicate(L("process.pid", "gt", 41.9)), rule_predicate(L("process.name", "gt", 1)),
        hunt_predicate(L("process.name", ">", 5)), hunt_predicate(L("process.pid", "contains", "4")),
        rule_predicate(L("process.pid", "contains", "4")), rule_predicate(L("process.stdio_socket", "eq", "1")),
        hunt_predicate(L("process.stdio_socket", "==", "true")), hunt_predicate(L("process.pid", ">", 41.5)))
    assert got == [(True, False, True, False, True, True, False, True, True, True)]


@pytest.mark.parametrize("bad", [
    {}, {"all": []}, {"all": [L("host.name", "eq", "x")], "not": L("host.name", "eq", "x")}, L("no.such", "eq", 1),
    L("host.name", "like", "x"), {"any": [{"nor": []}]}])
def test_rejected_trees(bad):
    with pytest.raises(ValueError):
        check_tree(bad)


@pytest.mark.parametrize("leaf", [L("host.name", "in", "x"), L("process.pid", "gt", "x"), L("host.name", "regex", "("),
                                  L("source.ip", "cidr", "10.0.0.0")])
def test_rejected_values(spark, leaf):
    with pytest.raises(ValueError):
        rule_predicate(leaf)


def test_regex_spelling(spark):
    rows = spark.createDataFrame([("abc\n",), ("abc",), ("a\x0bb",), ("a b",), ("a\rb",), ("x$y",)], "s string")
    hit = lambda p: [r[0] for r in rows.filter(F.col("s").rlike(java_regex(p))).collect()]
    assert hit("abc$") == ["abc"]
    assert hit(r"a\sb") == ["a b", "a\rb"]
    assert hit("a.b") == ["a\x0bb", "a b", "a\rb"]
    assert hit("x[$]y") == ["x$y"] and hit(r"x\$y") == ["x$y"]
    assert hit("(?P<w>b)c$") == ["abc"]


def test_ip_parsing_matches_model(spark):
    rng = random.Random(3)
    texts = ["10.1.2.3", "010.1.2.3", "1.2.3", "1.2.3.256", "::", "::1", "1::", "1::2::3", ":::", "1:2:3:4:5:6:7::",
             "::2:3:4:5:6:7:8", "1:2:3::4:5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "::ffff:10.1.2.3", "64:ff9b::1.2.3.4",
             "1.2.3.4::", "fe80::1%eth0", "12345::", "abcd::G", "", "1:2:3:4:5:6:7:8:9"]
    for _ in range(60):
        a = ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF << 64]))
        texts.append(rng.choice([a.compressed, a.exploded.upper()]))
    nets = ["10.0.0.0/9", "2001:db8::/33", "::/0", "::/3", "::ffff:0:0/96", "0.0.0.0/0", "8000::/1"]
    df = spark.createDataFrame([(t,) for t in texts], "ip string")
    for row in df.select("ip", ip_hex(F.col("ip")).alias("h"), *[in_network(F.col("ip"), n).alias(n) for n in nets]).collect():
        try:
            a = ipaddress.ip_address(row.ip)
            want = None if "%" in row.ip else (MAPPED + f"{int(a):08x}" if a.version == 4 else f"{int(a):032x}")
        except ValueError:
            want = None
        assert row.h == want, row.ip
        for n in nets:
            inside = False
            if want:
                v4 = want.startswith(MAPPED)
                real = ipaddress.ip_address(int(want[24:], 16)) if v4 else ipaddress.IPv6Address(int(want, 16))
                net = ipaddress.ip_network("0.0.0.0/0" if n == "::ffff:0:0/96" else n)
                inside = real.version == net.version and real in net
            assert bool(row[n]) == inside, (row.ip, n)


@pytest.fixture(scope="module")
def lake(make):
    return make([
        {"action": "exec", "host": "mill", "at": 0, "process.pid": 41, "process.name": "ngrok"},
        {"action": "exec", "host": "mill", "at": 60, "process.pid": 58, "process.name": "dash", "process.parent_name": "ngrok"},
        {"action": "connect", "host": "mill", "at": 120, "network.dst_ip": "203.77.4.18", "network.dst_port": 7070},
        {"action": "exec", "host": "barn", "at": 0, "process.pid": 77, "process.name": "wget"},
        {"action": "connect", "host": "barn", "at": 60, "network.dst_ip": "192.0.2.61", "network.dst_port": 7070}])


@pytest.mark.parametrize("cls, where, limit, want", [
    ("exec", L("process.name", "==", "dash"), None, 1), ("exec", L("process.name", "in", ["dash", "wget"]), None, 2),
    ("exec", L("process.parent.name", "==", "ngrok"), None, 1), ("connect", L("destination.port", "==", 7070), None, 2),
    ("connect", L("destination.port", ">", 4000), 1, 1), ("event", L("host.name", "==", "mill"), None, 3),
    ("any", {"not": L("host.name", "==", "mill")}, None, 2), ("exec", L("process.name", "startswith", "ng"), None, 1),
    ("connect", L("destination.ip", "=~", r"^203\."), None, 1)])
def test_hunts(lake, cls, where, limit, want):
    assert hunt(lake, cls, where, limit=limit).count() == want


def test_hunt_accepts_sql_and_is_newest_first(lake):
    rows = hunt(lake, "any", "process.pid > 0", F.col("host") == "mill").collect()
    assert [r.process.pid for r in rows] == [58, 41]


@pytest.mark.parametrize("seconds, want", [(300, 1), (60, 1), (59, 0), (None, 1)])
def test_sequence_window(lake, seconds, want):
    stages = [("exec", L("process.name", "==", "wget")), ("connect", L("destination.port", "==", 7070))]
    within = None if seconds is None else timedelta(seconds=seconds)
    rows = sequence(lake, stages, "host.name", within).collect()
    assert len(rows) == want and all(r.e0.process.name == "wget" and r.e1.network.dst_port == 7070 for r in rows)


def test_promotion_selects_the_hunts_rows(lake):
    for cls, tree in [("exec", L("process.parent.name", "!=", "x")), ("any", L("user.name", "!=", "root")),
                      ("connect", {"any": [L("destination.port", ">", 4000.0), {"not": L("host.name", "==", "a")}]})]:
        rule = promote(cls, [tree], {"id": "P-1", "name": "p", "severity": "low"})
        fired = detect(lake, load_rules([rule])).select("seq")
        hunted = hunt(lake, cls, tree).select("seq")
        assert fired.exceptAll(hunted).isEmpty() and hunted.exceptAll(fired).isEmpty()
    assert promote("any", [], {"id": "a", "name": "b"})["match"] == {"field": "event.action", "op": "exists"}
    with pytest.raises(ValueError):
        promote("any", [L("process.pid", ">", 3.7)], {"id": "a", "name": "b"})
    with pytest.raises(ValueError):
        promote("any", [], {"id": "", "name": "b"})


@pytest.mark.parametrize("text, op, value", [
    ("/usr/bin/nc", "eq", "/usr/bin/nc"), ("/tmp/*", "startswith", "/tmp/"), ("*/nc", "endswith", "/nc"),
    ("*reverse*", "contains", "reverse"), ("/tmp/*.sh", "regex", r"^/tmp/.*\.sh$"), ("*a*b*", "regex", "^.*a.*b.*$"), ("a?", "regex", "^a.$"), ("*", "contains", "")])
def test_portable_wildcards(text, op, value):
    match = sigma_match({"s": {"Image": text}, "condition": "s"}, "process_creation")
    assert match["all"][1] == {"field": "process.executable", "op": op, "value": value}


@pytest.mark.parametrize("detection, category", [
    ({"s": {"Nope": 1}, "condition": "s"}, "process_creation"), ({"s": ["word"], "condition": "s"}, "process_creation"),
    ({"s": {"Image|base64": "x"}, "condition": "s"}, "process_creation"), ({"s": {"Image": None}, "condition": "s"}, "process_creation"),
    ({"s": {"Image": "x"}, "condition": "s"}, "registry_event")])
def test_portable_unsupported(detection, category):
    with pytest.raises(Unsupported):
        sigma_match(detection, category)


def test_portable_metadata():
    doc = {"title": "T", "id": "9b1d6f44-0c0a-4f3a-9b21-0a1e2f3c4d5e", "level": "high",
           "tags": ["attack.lateral_movement", "attack.t1021.004"], "logsource": {"category": "dns_query"},
           "detection": {"a": {"Query": "x"}, "b": {"User": "y"}, "condition": {"any_of": "them"}}}
    rule = sigma_rule(doc)
    assert (rule["id"], rule["severity"], rule["risk_score"]) == ("SIGMA-9B1D6F44", "high", 70)
    assert rule["technique"] == {"id": "T1021.004", "name": "", "tactic": "lateral-movement"}
    assert rule["match"]["all"][0]["value"] == "dns" and len(rule["match"]["all"][1]["any"]) == 2
