import random
import re

from pyspark.sql import functions as F

from duskwatch.functions.predicates import java_regex, required_literals, rule_predicate
from duskwatch.operators.correlate import fired_events
from duskwatch.operators.detect import detect
from duskwatch.operators.rule_index import clauses_of, collected, exploded
from duskwatch.rules import builtin_rules, community_rules, load_rules

LEAVES = [("process.name", "in", ["sh", "bash", ""]), ("process.name", "eq", "sh"), ("process.name", "not_in", ["sh"]), ("destination.port", "in", [22, "443", "x"]),
          ("destination.port", "eq", 22), ("process.command_line", "regex", r"curl\s+.*\|\s*(ba)?sh\b|wget"), ("process.command_line", "regex", "^$"),
          ("process.command_line", "regex", r"(?i)CURL"), ("process.command_line", "contains", "it's"), ("file.path", "startswith", "/tmp/"), ("user.name", "exists", None),
          ("event.type", "eq", "exec"), ("event.type", "in", ["exec", "connect"]), ("event.action", "ne", "exec"), ("event.type", "eq", ""), ("process.pid", "eq", 7),
          ("process.stdio_socket", "eq", True), ("file.mode", "ge", 2048)]


def tree(rng, depth=0):
    if depth > 2 or rng.random() < 0.4:
        name, op, value = rng.choice(LEAVES)
        return {"field": name, "op": op, "value": value}
    shape = rng.choice(["all", "all", "any", "not"])
    return {"not": tree(rng, depth + 1)} if shape == "not" else {shape: [tree(rng, depth + 1) for _ in range(rng.randrange(1, 4))]}


def rules_of(trees):
    return load_rules([{"id": f"X-{i:04d}", "name": "x", "severity": "low", "match": t} for i, t in enumerate(trees)])


def test_index_against_plain_predicates(spark, make):
    """More rules than one word of bits holds, on absent and empty fields, give what each rule's own predicate gives."""
    rng = random.Random(21)
    some = lambda *v: rng.choice([None, "", *v])
    rows = [{"seq": i, "action": some("exec", "connect", "open"), "process.name": some("sh", "bash", "zsh"), "process.pid": rng.choice([None, 7, 8]),
             "process.command_line": some("curl x | sh", "wget", "CURL", "it's", "curl"), "process.stdio_socket": rng.choice([None, True, False]),
             "network.dst_port": rng.choice([None, 0, 22, 443]), "file.path": some("/tmp/a", "/a"), "file.mode": rng.choice([None, 2048]), "user.name": some("u")}
            for i in range(120)]
    events = make(rows).cache()
    for count in (1, 60, 131):
        rules = rules_of([tree(rng) for _ in range(count)])
        want = {(r.seq, i) for r in events.select("seq", *[rule_predicate(x["match"]).alias(f"r{i}") for i, x in enumerate(rules)]).collect()
                for i in range(count) if r[f"r{i}"]}
        assert want
        assert {(r.seq, r["_rule"]) for r in exploded(events, rules).select("seq", "_rule").collect()} == want
        assert {(r.seq, i) for r in collected(events, rules).select("seq", "_hits").collect() for i in r["_hits"]} == want
        assert {(r.seq, r.ord) for r in detect(events, rules).select("seq", "rule.ord").collect()} == want
        assert {(r.seq, f.ord) for r in fired_events(events, rules).collect() for f in r.fired} == want
    assert detect(events, []).count() == 0 and fired_events(events, []).count() == 0


def test_clauses():
    clauses = clauses_of(builtin_rules())
    shared = [c for c in clauses if c.selector]
    assert {c.selector[0] for c in shared} == {"process.name", "destination.port"} and any(not c.tests for c in shared)
    assert all(c.verbs is None or all(isinstance(v, str) for v in c.verbs) for c in clauses)


def test_required_literals():
    assert required_literals("/etc/passwd|getent\\s+passwd") == ("/etc/passwd", "getent") or required_literals("/etc/passwd|getent\\s+passwd") == ("/etc/passwd", "passwd")
    assert required_literals(r"\barp\b") == ("arp",) and required_literals("(?i)abc") is None and required_literals("[ab]+|cd") is None
    assert required_literals("a?bcd*") == ("bc",) and required_literals("x") is None and required_literals(r"(foo|barbaz)+qu") in (("barbaz", "foo"),)
    rng = random.Random(2)
    alphabet = "abc -|/"
    for rule in [*builtin_rules(), *community_rules()]:
        for pattern in re.findall(r"'op': 'regex', 'value': '((?:[^'\\]|\\.)*)'", repr(rule["match"])):
            pattern = pattern.replace("\\\\", "\\")
            java_regex(pattern)
            literals = required_literals(pattern)
            for _ in range(50):
                text = "".join(rng.choice([*alphabet, *(literals or ()), "curl ", "ssh ", "/var/log", " -R 1"]) for _ in range(8))
                if re.search(pattern, text) and literals:
                    assert any(x in text for x in literals), (pattern, text)
