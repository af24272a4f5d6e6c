"""Small fixed inputs of the registered queries: hunts, feeds, signatures, playbooks."""

from __future__ import annotations

from datetime import timedelta

from ..rules import builtin_rules

RULES = builtin_rules()

L = lambda field, op, value=None: {"field": field, "op": op, "value": value}

# One rule-dialect tree per operator.
RULE_TREES = {
    "exists": L("file.target", "exists"),
    "exists_always": L("file.mode", "exists"),
    "eq": L("process.name", "eq", "bash"),
    "eq_number": L("destination.port", "eq", "4444"),
    "eq_flag": L("process.stdio_socket", "eq", "true"),
    "eq_uncoercible": L("destination.port", "eq", "http"),
    "ne": L("destination.port", "ne", 22),
    "ne_text": L("user.name", "ne", "user7"),
    "in": L("destination.port", "in", [22, "443", 8080.9]),
    "not_in": L("user.name", "not_in", ["user1", "user2"]),
    "contains": L("process.command_line", "contains", "ar"),
    "startswith": L("process.executable", "startswith", "/tmp/"),
    "endswith": L("file.path", "endswith", "authorized_keys"),
    "regex": L("process.command_line", "regex", r"(ba)?sh$|\bpasswd\b"),
    "regex_number": L("process.pid", "regex", "1"),
    "gt": L("process.pid", "gt", 70.9),
    "lt": L("file.mode", "lt", 1),
    "ge": L("destination.port", "ge", 443),
    "le": L("user.id", "le", 10),
    "gt_text": L("process.name", "gt", 1),
    "cidr": L("destination.ip", "cidr", "203.0.1.0/28"),
    "cidr_odd": L("source.ip", "cidr", "10.0.2.64/26"),
    "cidr_v6": L("destination.ip", "cidr", "2001:db8::/32"),
    "all": {"all": [L("event.type", "eq", "exec"), L("process.name", "eq", "curl")]},
    "any": {"any": [L("event.type", "eq", "fork"), L("file.path", "exists")]},
    "not": {"not": L("destination.ip", "eq", "203.0.0.1")},
    "nested": {"all": [{"not": {"any": [L("event.type", "in", ["exec", "fork"]), L("user.name", "ne", "user4")]}},
                       L("process.ppid", "gt", 3)]},
}

# One hunt-dialect tree per operator.
HUNT_TREES = {
    "==": L("process.name", "==", "bash"),
    "==number": L("destination.port", "==", "443"),
    "==flag": L("process.stdio_socket", "==", "true"),
    "!=": L("user.name", "!=", "user7"),
    "!=number": L("destination.port", "!=", 22),
    ">": L("process.pid", ">", 70.5),
    "<": L("file.mode", "<", 1),
    ">=": L("destination.port", ">=", 443),
    "<=": L("user.id", "<=", "10"),
    ">text": L("process.name", ">", 5),
    "contains": L("process.command_line", "contains", "ar"),
    "contains_number": L("process.pid", "contains", "7"),
    "startswith": L("destination.port", "startswith", "4"),
    "endswith": L("process.executable", "endswith", "sh"),
    "=~": L("destination.ip", "=~", r"^203\.0\.[12]\."),
    "in": L("process.name", "in", ["curl", "ssh"]),
    "and": {"all": [L("process.name", "==", "ssh"), L("process.pid", ">", 40)]},
    "or": {"any": [L("event.type", "==", "open"), L("event.type", "==", "chmod")]},
    "not": {"not": L("user.name", "!=", "user7")},
}

PORTABLE = [
    {"title": "Payload piped to a shell", "id": "11112222-aaaa-bbbb-cccc-000000000001", "level": "medium",
     "tags": ["attack.execution", "attack.t1059.004"],
     "logsource": {"category": "process_creation", "product": "linux"},
     "detection": {"tool": {"Image|endswith": ["/curl", "/wget", "/bash"]},
                   "pipe": {"CommandLine|contains": ["| sh", "|sh"]}, "condition": {"and": ["tool", "pipe"]}}},
    {"title": "Wildcards and quantifiers", "level": "high", "tags": ["attack.discovery"],
     "logsource": {"category": "process_creation"},
     "detection": {"sel_path": {"Image": ["/tmp/*", "*/nginx", "*who*"]}, "sel_cmd": {"CommandLine": "c?t /etc/*"},
                   "filter": {"User": ["user1", "user2"], "ProcessId|lt": 60},
                   "condition": {"and": [{"any_of": "sel_*"}, {"not": "filter"}]}}},
    {"title": "Long queries", "level": "informational", "logsource": {"category": "dns_query"},
     "detection": {"a": [{"QueryName|re": "[a-z0-9]{50,}"}, {"QueryName|startswith": "h3", "ProcessId|gte": 20}],
                   "condition": {"any_of": "them"}}},
    {"title": "Odd destinations", "level": "critical", "logsource": {"category": "network_connection"},
     "detection": {"net": {"DestinationIp|cidr": "203.0.2.0/27", "DestinationPort": [4444, 8080]},
                   "text": {"DestinationIp|contains|all": ["203.", ".0."]}, "condition": {"all_of": "them"}}},
]

# (cls, where, within) chains.
TWO_STAGES = [("exec", L("process.name", "==", "curl")), ("connect", L("destination.port", "==", 4444))]
THREE_STAGES = [("exec", L("process.executable", "startswith", "/tmp/")), ("any", L("file.path", "endswith", "x")),
                ("connect", None)]
GLOBAL_STAGES = [("module_load", None), ("exec", None)]
TWO_WITHIN, GLOBAL_WITHIN = timedelta(hours=24), timedelta(hours=1)

PROMOTED = ("connect", [L("destination.port", "!=", 22), {"any": [L("user.name", "!=", "user7"),
                                                                  L("process.pid", ">", 100)]}])

FEED = [  # value, source, ord
    ("203.0.0.7  # known", "feed-a.txt", 0), ("203.0.0.7", "feed-b.txt", 1), ("# comment only", "feed-a.txt", 2),
    ("203.0.1.0/28", "feed-a.txt", 3), ("203.0.1.0/24", "feed-b.txt", 4), ("203.0.0.0/30", "feed-b.txt", 5),
    ("10.0.3.0/25", "feed-c.txt", 6), ("2001:db8::/32", "feed-c.txt", 7), ("300.1.1.1/8", "feed-c.txt", 8),
    ("H3.example.TEST", "feed-a.txt", 9), ("h4.example.test", "feed-a.txt", 10),
    ("203.0.2.0/26", "feed-d.txt", 11), ("203.0.2.9", "feed-d.txt", 12),
]

SIGNATURES = [
    {"name": "two_of", "strings": {"a": {"text": "THE", "nocase": True}, "b": {"text": "und"}, "c": {"text": "que"}},
     "condition": {"of": 2, "ids": "them"}},
    {"name": "bytes", "strings": {"h": {"hex": "74 68 ?? 20"}, "n": {"hex": "C3A9"}},
     "condition": {"any": ["h", {"all": ["n", {"not": "h"}]}]}},
    {"name": "mail", "strings": {"at": {"text": "@"}, "dot": {"text": ".com"}}, "condition": {"of": "all", "ids": "them"}},
]
HTML_SIGNATURES = [
    {"name": "doctype", "strings": {"d": {"hex": "3C 21 44 4F 43 54 59 50 45"}}, "condition": "d"},
    {"name": "script", "strings": {"s": {"text": "<SCRIPT", "nocase": True}, "h": {"hex": "3C 68 ?? 3E"}},
     "condition": {"any": ["s", "h"]}},
    {"name": "plain", "strings": {"t": {"text": "<table"}, "u": {"text": "<ul"}}, "condition": {"not": {"of": "any", "ids": "them"}}},
]

PLAYBOOKS = [
    {"id": "pb-1", "name": "Critical", "mode": "enforce", "trigger": {"severities": ["CRITICAL"], "min_risk": 60},
     "steps": [{"type": "notify"}, {"type": "kill_process"}, {"type": "quarantine"}]},
    {"id": "pb-2", "name": "Ports", "mode": "dry-run", "trigger": {"rule_ids": ["R-0008", "R-0028"], "techniques": ["T1571"]},
     "steps": [{"type": "quarantine"}, {"type": "run_hunt", "query": "port 4444"}, {"type": "open_case"}]},
    {"id": "pb-3", "name": "Off", "mode": "off", "trigger": {}, "steps": [{"type": "notify"}]},
    {"id": "pb-4", "name": "Incidents", "mode": "enforce", "trigger": {"incidents_only": True},
     "steps": [{"type": "open_case"}]},
]

ALLOWED = ["/usr/bin/nginx", "/usr/bin/ssh"]
VALUE_BOUNDS = [1.0, 5.0, 10.0, 20.0, 30.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0]
