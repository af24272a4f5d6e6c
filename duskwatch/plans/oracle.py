"""The same queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations


from ..operators.quality import TACTIC_ORDER
from ..rules import load_rules
from ..functions.sigma import sigma_rule
from . import samples as S
from .telemetry import FIELDS, K

TEL = ("tel AS MATERIALIZED (SELECT " + FIELDS.format(us="epoch_us(ts)", sha0="sha256(", sha1=")")
       + f" FROM (SELECT *, {K} AS k FROM events))")


def _q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


# Field -> (kind, SQL that is NULL when absent).
_TEXT = {"event.type": "action", "event.action": "action", "host.name": "host", "process.name": "name",
         "process.executable": "executable", "process.command_line": "command_line", "process.hash.sha256": "sha256",
         "user.name": "user_name", "file.path": "path", "file.target": "target", "source.ip": "src_ip",
         "destination.ip": "dst_ip", "dns.question.name": "domain", "process.parent.name": "''",
         "process.parent.executable": "''", "container.id": "''", "container.runtime": "''", "yara.matched": "''"}
_LONG = {"process.pid": "pid", "process.ppid": "ppid", "user.id": "uid", "file.mode": "mode", "file.flags": "0",
         "syscall.request": "request", "syscall.new_uid": "new_uid", "anomaly.score": "0",
         "destination.port": "nullif(dst_port, 0)", "source.port": "NULL::BIGINT", "syscall.target_pid": "NULL::BIGINT"}


def _field(name: str) -> tuple[str, str]:
    if name in _TEXT:
        return "string", f"nullif({_TEXT[name]}, '')"
    if name in _LONG:
        return "long", f"({_LONG[name]})"
    return "bool", "stdio_socket"


def _int(value):
    try:
        return None if isinstance(value, bool) else int(float(value)) if not isinstance(value, str) else int(value)
    except ValueError:
        return None


def _eq(kind, col, value) -> str:
    if kind == "long":
        n = _int(value)
        return "false" if n is None else f"{col} = {n}"
    if kind == "bool":
        return f"{col} = {str(value).lower()}"
    return f"{col} = {_q(value)}"


def _v4(net: str) -> tuple[int, int]:
    import ipaddress

    n = ipaddress.ip_network(net, strict=False)
    return int(n.network_address), int(n.broadcast_address)


IPNUM = ("(CAST(split_part({c},'.',1) AS BIGINT)*16777216 + CAST(split_part({c},'.',2) AS BIGINT)*65536 + "
         "CAST(split_part({c},'.',3) AS BIGINT)*256 + CAST(split_part({c},'.',4) AS BIGINT))")


def _cidr(col: str, net: str) -> str:
    if ":" in net:
        return "false"
    low, high = _v4(net)
    return f"{IPNUM.format(c=col)} BETWEEN {low} AND {high}"


def rule_sql(node: dict) -> str:
    if node.get("all") is not None:
        return "(" + " AND ".join(rule_sql(n) for n in node["all"]) + ")"
    if node.get("any") is not None:
        return "(" + " OR ".join(rule_sql(n) for n in node["any"]) + ")"
    if node.get("not") is not None:
        return f"(NOT {rule_sql(node['not'])})"
    kind, col = _field(node["field"])
    op, v = node["op"], node.get("value")
    text = kind == "string"
    absent = "false"
    if op == "exists":
        test = f"{col} IS NOT NULL"
    elif op == "eq":
        test = _eq(kind, col, v)
    elif op == "ne":
        test, absent = f"NOT ({_eq(kind, col, v)})", "true"
    elif op in ("in", "not_in"):
        test = "(" + " OR ".join(_eq(kind, col, x) for x in v) + ")"
        if op == "not_in":
            test, absent = f"NOT {test}", "true"
    elif op == "regex":
        test = f"regexp_matches({col}, {_q(v)})" if text else "false"
    elif op == "cidr":
        test = _cidr(col, v)
    elif op in ("contains", "startswith", "endswith"):
        fn = {"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}[op]
        test = f"{fn}({col}, {_q(v)})" if text else "false"
    else:
        sign = {"gt": ">", "lt": "<", "ge": ">=", "le": "<="}[op]
        test = f"{col} {sign} {_int(v)}" if kind == "long" else "false"
    return f"coalesce({test}, {absent})"


def hunt_sql(node: dict) -> str:
    if node.get("all") is not None:
        return "(" + " AND ".join(hunt_sql(n) for n in node["all"]) + ")"
    if node.get("any") is not None:
        return "(" + " OR ".join(hunt_sql(n) for n in node["any"]) + ")"
    if node.get("not") is not None:
        return f"(NOT {hunt_sql(node['not'])})"
    kind, col = _field(node["field"])
    op, v = node["op"], node.get("value")
    text = f"CAST({col} AS VARCHAR)"
    same = lambda x: f"{col} = {float(x)}" if kind == "long" else f"{text} = {_q(x)}"
    if op == "==":
        test = same(v)
    elif op == "!=":
        test = f"NOT ({same(v)})"
    elif op == "in":
        test = "(" + " OR ".join(same(x) for x in v) + ")"
    elif op in ("contains", "startswith", "endswith"):
        fn = {"contains": "contains", "startswith": "starts_with", "endswith": "ends_with"}[op]
        test = f"{fn}({text}, {_q(v)})"
    elif op == "=~":
        test = f"regexp_matches({text}, {_q(v)})"
    else:
        test = f"TRY_CAST({col} AS DOUBLE) {op} {float(v)}"
    return f"coalesce({test}, false)"


def _rules_cte(rules, name="rules") -> str:
    rows = ",\n".join(
        "(" + ", ".join([str(i), _q(r["id"]), _q(r["name"]), _q(r["severity"]), str(r["risk_score"]),
                         _q(r["technique"]["id"]), _q(r["technique"]["name"]), _q(r["technique"]["tactic"]),
                         _q(r["response"])]) + ")" for i, r in enumerate(rules))
    return (f"{name}(ord, rule_id, rule_name, severity, risk, technique_id, technique_name, tactic, response) AS "
            f"(VALUES {rows})")


def _alerts_cte(rules, source="tel", name="alerts", rule_table="rules") -> str:
    cases = ", ".join(f"CASE WHEN {rule_sql(r['match'])} THEN {_q(r['id'])} END" for r in rules)
    return (f"{name} AS MATERIALIZED (SELECT h.*, r.* FROM (SELECT *, unnest(list_filter([{cases}], "
            f"lambda x: x IS NOT NULL)) AS hit FROM {source}) h JOIN {rule_table} r ON r.rule_id = h.hit)")


RULES_CTE = _rules_cte(S.RULES)
ALERTS = f"{TEL},\n{RULES_CTE},\n{_alerts_cte(S.RULES)}"
RECORDS = ALERTS + """,
records AS MATERIALIZED (SELECT substring(sha256(concat_ws(chr(31), 'alert', host, us, rule_id, action, pid, ppid, name, executable, command_line, path, target, dst_ip, dst_port, domain)), 1, 32) AS id,
  host AS hostname, us, seq, rule_id, rule_name, severity, technique_id, technique_name, pid, name AS process_name,
  executable AS process_executable, dst_ip AS destination_ip, CAST(risk AS BIGINT) AS risk_score, false AS is_incident
  FROM alerts)"""


def _incidents(alerts: str, window_us: int, threshold: int, name: str = "incidents") -> str:
    """Sessions by gap, running risk, first crossing; plain windows."""
    return f"""
ev AS (SELECT host, concat(pid, ':', start_ns) AS process_key, us, seq, sum(risk) AS risk, max(name) AS name,
         max(pid) AS pid FROM {alerts} GROUP BY ALL),
gap AS (SELECT *, CASE WHEN us - lag(us) OVER w > {window_us} THEN 1 ELSE 0 END AS cut FROM ev
        WINDOW w AS (PARTITION BY host, process_key ORDER BY us, seq)),
ses AS (SELECT *, sum(cut) OVER (PARTITION BY host, process_key ORDER BY us, seq) AS sid FROM gap),
run AS (SELECT *, sum(risk) OVER w AS total, min(us) OVER w AS first_us FROM ses
        WINDOW w AS (PARTITION BY host, process_key, sid ORDER BY us, seq)),
cross_at AS (SELECT * FROM run WHERE total >= {threshold} AND total - risk < {threshold}),
seen AS (SELECT c.host, c.process_key, c.seq AS at_seq, a.rule_id, a.technique_id, min((a.us, a.seq, a.ord)) AS first
  FROM cross_at c JOIN {alerts} a ON a.host = c.host AND concat(a.pid, ':', a.start_ns) = c.process_key
    AND a.us >= c.first_us AND (a.us, a.seq) <= (c.us, c.seq) GROUP BY ALL),
lists AS (SELECT host, process_key, at_seq, string_agg(rule_id, ',' ORDER BY first) AS rule_ids,
  array_to_string(list_sort(list_distinct(list(technique_id) FILTER (technique_id <> ''))), ',') AS techniques,
  count(DISTINCT technique_id) FILTER (technique_id <> '') AS n FROM seen GROUP BY ALL),
{name} AS MATERIALIZED (SELECT concat('INC-', c.host, '-', c.first_us, '000') AS id, c.host, c.process_key,
  CAST(c.total AS BIGINT) AS risk_score, coalesce(l.techniques, '') AS techniques, l.rule_ids, c.first_us, c.us AS last_us,
  concat('process ', c.name, ' (pid ', c.pid, ') accumulated risk ', CAST(c.total AS BIGINT), ' across ', l.n, ' techniques') AS summary,
  c.seq FROM cross_at c JOIN lists l ON l.host = c.host AND l.process_key = c.process_key AND l.at_seq = c.seq)"""


INC_COLS = "id, host, process_key, risk_score, techniques, rule_ids, first_us, last_us, summary"
DAY = 86_400_000_000
INCIDENTS = ALERTS + "," + _incidents("alerts", DAY, 75)

_EXACT, _NETS = [], []
for _v, _s, _o in S.FEED:
    _raw = _v.split("#")[0].strip()
    if not _raw:
        continue
    if "/" in _raw:
        try:
            _NETS.append((_raw, _s, _o, *(_v4(_raw) if ":" not in _raw else (-1, -1))))
        except ValueError:
            pass
    else:
        _kind = "ip" if _raw.replace(".", "").isdigit() else "domain"
        _EXACT.append((_kind, _raw if _kind == "ip" else _raw.lower(), _s, _o))
IOC = TEL + f""",
exact AS (SELECT t, v, max_by(s, o) AS src FROM (VALUES {', '.join(f"({_q(t)}, {_q(v)}, {_q(s)}, {o})" for t, v, s, o in _EXACT)}) e(t, v, s, o) GROUP BY ALL),
nets(cidr, src, ord, low, high) AS (VALUES {', '.join(f"({_q(v)}, {_q(s)}, {o}, {lo}, {hi})" for v, s, o, lo, hi in _NETS)}),
probes AS (SELECT seq, 'destination.ip' AS field, 'ip' AS type, dst_ip AS indicator, dst_ip AS k2, 0 AS probe FROM tel WHERE dst_ip <> ''
  UNION ALL SELECT seq, 'source.ip', 'ip', src_ip, src_ip, 1 FROM tel WHERE src_ip <> ''
  UNION ALL SELECT seq, 'network.domain', 'domain', domain, lower(domain), 2 FROM tel WHERE domain <> ''
  UNION ALL SELECT seq, 'process.sha256', 'hash', sha256, lower(sha256), 3 FROM tel WHERE sha256 <> ''),
ips AS (SELECT DISTINCT k2 FROM probes WHERE type = 'ip'),
ranged AS (SELECT k2, min_by(src, ord) AS src, min_by(cidr, ord) AS cidr FROM ips, nets
  WHERE {IPNUM.format(c='k2')} BETWEEN low AND high GROUP BY k2),
hits AS MATERIALIZED (SELECT p.seq, p.indicator, p.type, p.field, coalesce(e.src, r.src) AS source, p.probe FROM probes p
  LEFT JOIN exact e ON e.t = p.type AND e.v = p.k2 LEFT JOIN ranged r ON p.type = 'ip' AND r.k2 = p.k2
  WHERE coalesce(e.src, r.src) IS NOT NULL)"""

_LIFE = """
life AS (SELECT host, pid, us, seq, 0 AS turn, action <> 'exit' AS alive, name,
  CASE WHEN action = 'exec' THEN executable ELSE '' END AS exe, ppid, {start} AS start
  FROM tel WHERE action IN ('exec', 'exec_blocked', 'fork', 'exit'))"""


def _asof(probe_pid: str) -> str:
    """Latest lifecycle row at or before each event under a pid."""
    return f"""SELECT p.*, l.alive, l.name AS up_name, l.exe AS up_exe, l.ppid AS up_ppid, l.start AS up_start FROM probes p
  LEFT JOIN LATERAL (SELECT * FROM life WHERE life.host = p.host AND life.pid = p.{probe_pid} AND
    (life.us, life.seq) <= (p.us, p.seq) ORDER BY life.us DESC, life.seq DESC LIMIT 1) l ON true"""


def _levels(depth: int) -> str:
    """Climb level by level, each an as-of lookup through a window over lifecycle and probes."""
    out = ["l0 AS (SELECT host, us, seq, pid AS own, ppid AS cur, '' AS chain FROM tel)"]
    for i in range(depth):
        out.append(f"""
u{i} AS (SELECT host, cur AS pid, us, seq, 1 AS turn, own, chain, NULL::BOOLEAN AS alive, NULL AS name, NULL::BIGINT AS ppid
    FROM l{i} WHERE cur <> 0 AND cur <> own
  UNION ALL SELECT host, pid, us, seq, 0, NULL, NULL, alive, name, ppid FROM life),
w{i} AS (SELECT *, last_value({{'alive': alive, 'name': name, 'ppid': ppid}}) OVER
    (PARTITION BY host, pid ORDER BY us, seq, turn) AS x, max(CASE WHEN turn = 0 THEN (us, seq) END) OVER
    (PARTITION BY host, pid ORDER BY us, seq, turn) AS pos FROM u{i}),
f{i} AS MATERIALIZED (SELECT w.host, w.us, w.seq, w.own, w.chain, e.alive, e.name, e.ppid FROM w{i} w
  JOIN life e ON e.host = w.host AND e.pid = w.pid AND (e.us, e.seq) = w.pos WHERE w.turn = 1),
l{i + 1} AS MATERIALIZED (SELECT host, us, seq, own, ppid AS cur,
  CASE WHEN chain = '' AND {i} = 0 THEN name ELSE concat(chain, '>', name) END AS chain FROM f{i} WHERE alive)""")
    return ",".join(out)


NODES = """
cand AS (SELECT host, us, seq, 0 AS turn, concat('proc:', pid) AS id, 'process' AS kind, pid,
    CASE WHEN name <> '' THEN name ELSE NULL END AS label, nullif(command_line, '') AS detail FROM tel
  UNION ALL SELECT host, us, seq, 1, concat('proc:', ppid), 'process', ppid, NULL, NULL FROM tel WHERE action IN ('exec', 'fork') AND ppid <> 0
  UNION ALL SELECT host, us, seq, 2, concat('file:', path), 'file', NULL, regexp_extract(path, '[^/]+$'), path FROM tel WHERE path <> ''
  UNION ALL SELECT host, us, seq, 2, concat('net:', domain), 'network', NULL, domain, domain FROM tel
    WHERE path = '' AND action = 'dns' AND domain <> ''
  UNION ALL SELECT host, us, seq, 2, concat('net:', dst_ip, CASE WHEN dst_port <> 0 THEN concat(':', dst_port) ELSE '' END), 'network', NULL,
    concat(dst_ip, CASE WHEN dst_port <> 0 THEN concat(':', dst_port) ELSE '' END),
    concat(dst_ip, CASE WHEN dst_port <> 0 THEN concat(':', dst_port) ELSE '' END) FROM tel
    WHERE path = '' AND NOT (action = 'dns' AND domain <> '') AND dst_ip <> ''),
nodes AS MATERIALIZED (SELECT host, id, max(kind) AS kind, coalesce(arg_min(label, (us, seq, turn)) FILTER (label IS NOT NULL), concat('pid ', max(pid))) AS label,
  coalesce(max(pid), 0) AS pid, coalesce(arg_max(detail, (us, seq, turn)) FILTER (detail IS NOT NULL), '') AS detail FROM cand GROUP BY host, id)"""
EDGES = """
edges AS MATERIALIZED (SELECT DISTINCT * FROM (
  SELECT host, concat('proc:', ppid) AS source, concat('proc:', pid) AS target, 'spawned' AS kind FROM tel WHERE action IN ('exec', 'fork') AND ppid <> 0
  UNION ALL SELECT host, concat('proc:', pid), CASE WHEN path <> '' THEN concat('file:', path)
      WHEN action = 'dns' AND domain <> '' THEN concat('net:', domain)
      ELSE concat('net:', dst_ip, CASE WHEN dst_port <> 0 THEN concat(':', dst_port) ELSE '' END) END,
    CASE WHEN path <> '' THEN CASE action WHEN 'open' THEN 'opened' WHEN 'unlink' THEN 'deleted' WHEN 'rename' THEN 'renamed'
      WHEN 'chmod' THEN 'chmod' ELSE 'accessed' END WHEN action = 'dns' AND domain <> '' THEN 'resolved' ELSE 'connected' END
  FROM tel WHERE path <> '' OR (action = 'dns' AND domain <> '') OR dst_ip <> ''))"""

_CTX = """
recent AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY us DESC, seq DESC, id) AS rn FROM records),
tech AS (SELECT r.hostname, r.technique_id, min(rn) AS rn, arg_min(r.technique_name, rn) AS tname,
  max(t.tactic) AS tactic FROM recent r JOIN (SELECT technique_id AS tid, arg_max(tactic, ord) AS tactic FROM rules GROUP BY 1) t
  ON t.tid = r.technique_id WHERE r.technique_id <> '' GROUP BY ALL),
hosts AS (SELECT hostname, count(*) AS n, count_if(lower(severity) IN ('high', 'critical')) AS high FROM recent GROUP BY 1)"""


def _advice(host: str, process: str, pid: str, tactic: str) -> str:
    return f"""CASE WHEN {tactic} IN ('execution', 'privilege-escalation') THEN concat('Kill the offending process ', {process}, ' (pid ', {pid}, ') and isolate ', {host}, ' from the network.')
  WHEN {tactic} IN ('command-and-control', 'exfiltration') THEN concat('Block egress from ', {host}, ' and capture the destination for threat-intel.')
  WHEN {tactic} = 'credential-access' THEN concat('Rotate credentials exposed on ', {host}, ' and review its authentication logs.')
  WHEN {tactic} = 'persistence' THEN concat('Audit ', {host}, ' for persistence (cron, systemd units, modified binaries).')
  WHEN {tactic} = 'defense-evasion' THEN concat('Preserve forensic state on ', {host}, ' — the actor attempted to evade detection.') END"""


_PAGE = "CASE doc_id % 12 " + " ".join(
    f"WHEN {i} THEN '/{p}/{n}'" for i, (p, n) in enumerate((p, n) for p in ("usr/bin", "tmp") for n in
                                                          ("bash", "nginx", "curl", "whoami", "ssh", "python3"))) + " END"
_FILES = f"files AS (SELECT concat({_PAGE}, '-', doc_id // 12) AS fpath, text AS content FROM documents)"


def _scan(col: str, html: bool = False) -> str:
    low = f"lower({col})"
    has = lambda t, c=col: f"contains({c}, {_q(t)})"
    hexed = f"hex(encode({col}))"
    both = [
        ("EICAR_Test_File", has("EICAR-STANDARD-ANTIVIRUS-TEST-FILE")),
        ("Linux_CoinMiner", "(" + " + ".join(f"CAST({c} AS INT)" for c in (
            has("stratum+tcp://", low), has("--donate-level"), has("cryptonight", low), has("xmrig", low))) + ") >= 2"),
        ("Linux_Reverse_Shell_Binary", f"({has('/bin/sh -i')} OR {has('/bin/bash -i')}) AND ({has('/dev/tcp/')} OR ({has('socket')} AND {has('dup2')}))"),
        ("PHP_Webshell", f"{has('<?php')} AND ({has('system(', low)} OR {has('shell_exec(', low)}) AND ({has('$_POST')} OR {has('$_GET')} OR {has('$_REQUEST')})"),
    ]
    at = lambda pattern: f"regexp_matches({hexed}, {_q('^(?:..)*?' + pattern)})"
    custom = [
        ("two_of", f"(CAST({has('the', low)} AS INT) + CAST({has('und')} AS INT) + CAST({has('que')} AS INT)) >= 2"),
        ("bytes", f"{at('7468..20')} OR ({at('C3A9')} AND NOT {at('7468..20')})"),
        ("mail", f"{has('@')} AND {has('.com')}"),
    ] if not html else [
        ("doctype", has("<!DOCTYPE")),
        ("script", f"{has('<script', low)} OR {at('3C68..3E')}"),
        ("plain", f"NOT ({has('<table')} OR {has('<ul')})"),
    ]
    names = lambda rows: "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN {test} THEN {_q(n)} END" for n, test in rows) + "], lambda x: x IS NOT NULL), ',')"
    return names(both + custom), names(custom)


_PART_RULES = """
prules AS (SELECT DISTINCT concat(p_type, '/', p_brand) AS id, CASE WHEN CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 7 = 0 THEN ''
   ELSE split_part(p_type, ' ', 1) END AS technique_id, [{t}][CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) % 13 + 1] AS tactic FROM part)
""".format(t=", ".join(_q(t) for t in (*TACTIC_ORDER, "")))

_CASES_LOG = RECORDS + """,
main AS (SELECT CAST(conv_id AS VARCHAR) AS case_ref, conv_id * 1000000000 + turn * 1000000 AS us, conv_id * 100000 + turn * 1000 AS seq,
   CASE WHEN turn = 0 THEN 'create' ELSE ['evidence', 'assign', 'comment', 'status'][turn % 4 + 1] END AS kind,
   CASE WHEN conv_id % 29 = 3 THEN ' ' ELSE concat('Case of ', role) END AS title,
   ['high', 'low', 'critical', '', 'bogus', 'info'][conv_id % 6 + 1] AS severity, concat('host-', conv_id % 8) AS host,
   concat('tag, t', conv_id % 3) AS tags, ['triage', 'closed', 'bogus'][conv_id % 3 + 1] AS status,
   concat(role, conv_id % 3) AS assignee, role AS author, text AS body, '' AS alert_id, conv_id, turn FROM conversations),
log AS (SELECT * FROM main UNION ALL
  SELECT m.case_ref, m.us, m.seq + 1 + CAST(substring(r.rule_id, 3, 4) AS BIGINT), 'evidence', m.title, m.severity, m.host, m.tags, m.status,
    m.assignee, m.author, m.body, r.id, m.conv_id, m.turn FROM main m JOIN records r ON r.seq = m.conv_id * 11 + m.turn),
bad AS (SELECT *, CASE WHEN kind = 'create' AND trim(title) = '' THEN 'a case needs a title'
    WHEN kind = 'create' AND severity NOT IN ('', 'info', 'low', 'medium', 'high', 'critical') THEN 'unknown severity'
    WHEN kind = 'status' AND status NOT IN ('open', 'triage', 'closed') THEN 'invalid status (want open|triage|closed)' END AS p0 FROM log),
born AS (SELECT case_ref AS ref, min((us, seq)) AS pos FROM bad WHERE kind = 'create' AND p0 IS NULL GROUP BY 1),
checked AS MATERIALIZED (SELECT b.*, CASE WHEN p0 IS NOT NULL THEN p0 WHEN pos IS NULL OR (us, seq) < pos THEN 'case not found'
    WHEN kind = 'create' AND (us, seq) > pos THEN 'case exists' END AS problem FROM bad b LEFT JOIN born ON ref = case_ref),
good AS (SELECT * FROM checked WHERE problem IS NULL),
cases AS MATERIALIZED (SELECT concat('CASE-', CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END) AS case_id, * FROM (
  SELECT case_ref, max(title) FILTER (kind = 'create') AS title, max(severity) FILTER (kind = 'create') AS severity,
    max(host) FILTER (kind = 'create') AS host, max(tags) FILTER (kind = 'create') AS tags,
    coalesce(arg_max(status, (us, seq)) FILTER (kind = 'status'), 'open') AS status,
    coalesce(arg_max(assignee, (us, seq)) FILTER (kind = 'assign'), '') AS assignee, count_if(kind = 'comment')::BIGINT AS comments,
    min(us) FILTER (kind = 'create') AS created_us, max(us) AS updated_us, min(seq) FILTER (kind = 'create') AS cseq,
    row_number() OVER (ORDER BY min(us) FILTER (kind = 'create'), min(seq) FILTER (kind = 'create')) AS n FROM good GROUP BY case_ref)),
ev AS MATERIALIZED (SELECT c.case_id, g.alert_id AS id, min((g.us, g.seq)) AS ord FROM good g JOIN cases c USING (case_ref)
  WHERE g.alert_id <> '' GROUP BY ALL),
found AS MATERIALIZED (SELECT ev.case_id, ev.ord, r.* FROM ev JOIN records r USING (id))"""

_STAMP = "strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%SZ')"


def _case_report() -> str:
    adv = _advice("host", "proc", "pid", "t.tactic")
    return f"""WITH {_CASES_LOG},
facts AS (SELECT case_id, count(*) AS n, count_if(severity IN ('high', 'critical')) AS high, arg_min(process_name, ord) AS proc,
  arg_min(pid, ord) AS pid, max(risk_score) AS risk FROM found GROUP BY 1),
ctech AS (SELECT case_id, technique_id, min(ord) AS ord, arg_min(technique_name, ord) AS tname, max(tt.tactic) AS tactic FROM found
  JOIN (SELECT technique_id AS tid, arg_max(tactic, ord) AS tactic FROM rules GROUP BY 1) tt ON tid = technique_id GROUP BY ALL),
story AS (SELECT c.case_id, c.host, coalesce(f.n, 0) AS n, coalesce(f.high, 0) AS high, coalesce(nullif(f.proc, ''), 'unknown') AS proc,
  coalesce(f.pid, 0) AS pid, coalesce(f.risk, 0) AS risk, (SELECT count(*) FROM ctech t WHERE t.case_id = c.case_id) AS nt,
  coalesce((SELECT string_agg(concat(technique_id, ' ', tname), ', ' ORDER BY ord) FROM ctech t WHERE t.case_id = c.case_id), 'no mapped technique') AS listed
  FROM cases c LEFT JOIN facts f USING (case_id)),
steps AS (SELECT case_id, step, min(ord) AS ord, false AS last FROM (SELECT s.case_id, {adv} AS step, t.ord FROM story s JOIN ctech t USING (case_id)) WHERE step IS NOT NULL GROUP BY ALL),
numbered AS (SELECT case_id, step, row_number() OVER (PARTITION BY case_id ORDER BY ord) + 2 AS n FROM steps
  UNION ALL SELECT case_id, concat('Snapshot ', host, ' and preserve volatile memory before remediation.'),
   3 + (SELECT count(*) FROM steps s WHERE s.case_id = story.case_id) FROM story),
head AS (SELECT case_id, list_filter([concat('# ', case_id, ' — ', title), '', concat('**Status:** ', status, '  '),
   CASE WHEN severity <> '' THEN concat('**Severity:** ', severity, '  ') END, CASE WHEN assignee <> '' THEN concat('**Assignee:** ', assignee, '  ') END,
   concat('**Host:** ', host, '  '), concat('**Tags:** ', tags, '  '), concat('**Opened:** ', {_STAMP.format(c='created_us')}, '  '),
   concat('**Updated:** ', {_STAMP.format(c='updated_us')}, '  ')], lambda x: x IS NOT NULL) AS lines FROM cases)
SELECT case_id, 0::BIGINT AS section, (generate_subscripts(lines, 1) - 1)::BIGINT AS ord, unnest(lines) AS line FROM head
UNION ALL SELECT case_id, 1, unnest([0, 1, 2, 3]), unnest(['', '## Summary', '', concat('Host ', host, ': process ', proc, ' (pid ', pid,
  ') accumulated risk ', risk, ' across ', nt, ' ATT&CK technique(s) — ', listed, '. ', n, ' detection(s) fired, ', high,
  ' high-or-critical. Review the process tree on ', host, ' and the destinations it contacted before deciding on containment.')]) FROM story
UNION ALL SELECT case_id, 2, unnest([0, 1, 2]), unnest(['', '## Recommended containment', '']) FROM story
UNION ALL SELECT case_id, 2, n, concat('- ', step) FROM numbered
UNION ALL SELECT case_id, 3, unnest([0, 1, 2, 3, 4]), unnest(['', '## Evidence', '', '| Time | Rule | Severity | Technique |', '|---|---|---|---|'])
  FROM (SELECT DISTINCT case_id FROM found)
UNION ALL SELECT case_id, 4, ord[2], concat('| ', {_STAMP.format(c='us')}, ' | ', rule_id, ' ', rule_name, ' | ', severity, ' | ', technique_id, ' |') FROM found
UNION ALL SELECT case_id, 5, unnest([0, 1, 2]), unnest(['', '## Notes', '']) FROM (SELECT DISTINCT case_id FROM good g JOIN cases c USING (case_ref) WHERE g.kind = 'comment')
UNION ALL SELECT c.case_id, 6, g.seq, concat('- **', g.author, '** (', {_STAMP.format(c='g.us')}, '): ', g.body) FROM good g JOIN cases c USING (case_ref) WHERE g.kind = 'comment'"""


def _signals() -> str:
    """Anchored windows as a recursion from opening to opening."""
    w = 6 * 3_600_000_000
    return f"""WITH RECURSIVE {RECORDS},
seen AS MATERIALIZED (SELECT 'lateral-movement' AS kind, technique_id AS key, hostname AS host, us, seq FROM records WHERE technique_id <> ''
  UNION ALL SELECT 'c2-fanin', destination_ip, hostname, us, seq FROM records WHERE destination_ip <> ''),
keys AS (SELECT kind, key FROM seen GROUP BY ALL HAVING count(DISTINCT host) >= 3),
pts AS MATERIALIZED (SELECT DISTINCT kind, key, us FROM seen JOIN keys USING (kind, key)),
nxt AS MATERIALIZED (SELECT p.kind, p.key, p.us, n.us AS nus FROM (SELECT kind, key, us, us + {w} AS lim FROM pts) p
  ASOF LEFT JOIN pts n ON n.kind = p.kind AND n.key = p.key AND n.us > p.lim),
anchors AS (SELECT kind, key, min(us) AS a FROM pts GROUP BY ALL
  UNION ALL SELECT n.kind, n.key, n.nus FROM anchors x JOIN nxt n ON n.kind = x.kind AND n.key = x.key AND n.us = x.a WHERE n.nus IS NOT NULL),
placed AS (SELECT s.kind, s.key, s.host, s.us, s.seq, a.a FROM seen s ASOF JOIN anchors a ON s.kind = a.kind AND s.key = a.key AND s.us >= a.a),
firsts AS (SELECT kind, key, a, host, min((us, seq)) AS pos FROM placed GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY kind, key, a ORDER BY pos) AS n FROM firsts),
fired AS (SELECT kind, key, a, string_agg(host, ',' ORDER BY host) AS hosts, string_agg(host, ', ' ORDER BY host) AS pretty, max(pos) AS pos
  FROM ranked WHERE n <= 3 GROUP BY ALL HAVING count(*) = 3)
SELECT kind, key, hosts, a AS first_us, pos[1] AS last_us, CASE WHEN kind = 'lateral-movement' THEN concat('technique ', key, ' seen on 3 hosts: ', pretty)
  ELSE concat('3 hosts contacted ', key, ': ', pretty) END AS summary FROM fired"""


def _sequence(stages, key: str, within_us: int | None, n: int) -> str:
    """Earliest later match per stage by a window over the next stage's rows."""
    def test(cls, where):
        parts = [] if cls in ("any", "event") else [f"action = {_q(cls)}"]
        if where:
            parts.append(hunt_sql(where))
        return " AND ".join(parts) or "true"

    cols = ", ".join(f"({test(*s)}) AS s{i}" for i, s in enumerate(stages))
    out = [f"WITH {TEL}, r AS MATERIALIZED (SELECT {key} AS key, us, seq, (us, seq) AS pos, {cols} FROM tel)"]
    last = "r"
    for i in range(n - 1, 0, -1):
        ready = f"s{i}" if i == n - 1 else f"s{i} AND n{i + 1} IS NOT NULL"
        out.append(f", x{i} AS MATERIALIZED (SELECT *, min(CASE WHEN {ready} THEN pos END) OVER (PARTITION BY key ORDER BY us, seq "
                   f"ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n{i} FROM {last})")
        last = f"x{i}"
    joins, cols = "", "a.key, a.seq AS s0"
    prev = "a"
    for i in range(1, n):
        joins += f" JOIN {last} b{i} ON b{i}.key = a.key AND b{i}.pos = {prev}.n{i}"
        cols += f", b{i}.seq AS s{i}"
        prev = f"b{i}"
    limit = "" if within_us is None else f" AND {prev}.us - a.us <= {within_us}"
    return "".join(out) + f" SELECT {cols} FROM {last} a{joins} WHERE a.s0{limit}"


def _matrix(trees, lower) -> str:
    rows = " UNION ALL ".join(f"SELECT {_q(n)} AS op, count_if({lower(t)})::BIGINT AS n, coalesce(sum(seq) FILTER ({lower(t)}), 0)::BIGINT AS seqs FROM tel"
                              for n, t in trees.items())
    return f"WITH {TEL} {rows}"


def _response(score: str) -> str:
    return (f"CASE WHEN response <> '' THEN response WHEN {score} >= 90 THEN 'kill' WHEN {score} >= 75 AND dst_ip <> '' THEN 'network_block' "
            f"WHEN {score} >= 50 THEN 'throttle' ELSE 'alert_only' END")


_ECS_CAT = "CASE WHEN action IN ('exec','fork','exit','exec_blocked') THEN 'process' WHEN action IN ('open','unlink','rename','chmod') THEN 'file' WHEN action IN ('connect','accept') THEN 'network' ELSE '' END"
_ECS_TYPE = "CASE WHEN action IN ('exec','fork') THEN 'start' WHEN action = 'exit' THEN 'end' WHEN action = 'exec_blocked' THEN 'denied' WHEN action IN ('open','rename','chmod') THEN 'change' WHEN action = 'unlink' THEN 'deletion' WHEN action IN ('connect','accept') THEN 'connection' ELSE '' END"
_CLASS = "CASE WHEN action IN ('open','unlink','rename','chmod') THEN 1001 WHEN action IN ('connect','accept') THEN 4001 WHEN action = 'dns' THEN 4003 ELSE 1007 END"
_ACT = "CASE action WHEN 'exec' THEN 1 WHEN 'fork' THEN 1 WHEN 'exit' THEN 2 WHEN 'ptrace' THEN 4 WHEN 'setuid' THEN 5 WHEN 'module_load' THEN 99 WHEN 'open' THEN 1 WHEN 'unlink' THEN 4 WHEN 'rename' THEN 5 WHEN 'chmod' THEN 6 ELSE 1 END"
_ACTN = "CASE action WHEN 'exec' THEN 'Launch' WHEN 'fork' THEN 'Launch' WHEN 'exit' THEN 'Terminate' WHEN 'ptrace' THEN 'Inject' WHEN 'setuid' THEN 'Set User ID' WHEN 'module_load' THEN 'Other' WHEN 'open' THEN 'Create' WHEN 'unlink' THEN 'Delete' WHEN 'rename' THEN 'Rename' WHEN 'chmod' THEN 'Set Attributes' WHEN 'dns' THEN 'Query' ELSE 'Open' END"
_BASE = "regexp_extract({c}, '[^/]+$')"
_ISO = "concat(strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S'), CASE WHEN {c} % 1000000 = 0 THEN '' ELSE concat('.', rtrim(lpad(CAST({c} % 1000000 AS VARCHAR), 6, '0'), '0')) END, 'Z')"
_DETAIL = "CASE WHEN action = 'exec' THEN command_line WHEN action IN ('connect', 'accept') THEN concat(src_ip, ':0 -> ', dst_ip, ':', dst_port) WHEN target <> '' THEN concat(path, ' -> ', target) ELSE path END"
_FLAT = "id, hostname, us, rule_id, severity, technique_id, pid, destination_ip, risk_score, is_incident"
_INC_FLAT = "SELECT substring(sha256(concat_ws(chr(31), 'incident', host, process_key, id)), 1, 32), host, last_us, id, 'critical', split_part(techniques, ',', 1), 0, '', risk_score, true FROM incidents"
T0, T1, TRAINED = 1704844800000000, 1705017600000000, 1704153600000000


def _features(where: str = "true") -> str:
    return (f"SELECT seq, 'executable' AS category, executable AS key FROM tel WHERE executable <> '' AND {where} "
            f"UNION ALL SELECT seq, 'parent_child', concat('?>', name) FROM tel WHERE name <> '' AND {where} "
            f"UNION ALL SELECT seq, 'user_process', concat(uid, '>', name) FROM tel WHERE name <> '' AND {where} "
            f"UNION ALL SELECT seq, 'dest_port', CAST(dst_port AS VARCHAR) FROM tel WHERE dst_port <> 0 AND {where}")


_RARITY = f"""{TEL}, base AS (SELECT category, key, count(*) AS n FROM ({_features(f'us < {TRAINED}')}) GROUP BY ALL),
rare AS (SELECT f.seq, max(1.0 / (1.0 + log2(1 + coalesce(b.n, 0)))) AS r FROM ({_features()}) f LEFT JOIN base b USING (category, key) GROUP BY 1),
scored AS (SELECT t.*, coalesce(r, 0.0) AS score FROM tel t LEFT JOIN rare USING (seq))"""


def _entropy(c: str) -> str:
    chars = f"string_split({c}, '')"
    return (f"CASE WHEN {c} = '' THEN 0.0 ELSE list_sum(list_transform(list_distinct({chars}), "
            f"lambda x: -(len(list_filter({chars}, lambda y: y = x)) / len({chars})) * log2(len(list_filter({chars}, lambda y: y = x)) / len({chars})))) END")


_BOUNDS = S.VALUE_BOUNDS
_HIST = ("h AS (SELECT event_type AS label, le, count_if(value <= le)::BIGINT AS count, count(*)::BIGINT AS total, sum(value) AS sum FROM events, (VALUES "
         + ", ".join(f"({b}::DOUBLE)" for b in _BOUNDS) + ", ('inf'::DOUBLE)) b(le) GROUP BY ALL)")
_HEART = "beats AS (SELECT *, CAST(floor(value) AS BIGINT) AS events_processed, k AS alerts, k % 5 AS incidents FROM tel), agents AS (SELECT * FROM beats QUALIFY row_number() OVER (PARTITION BY host ORDER BY us DESC, seq DESC) = 1)"

_SIGMA = load_rules(sigma_rule(d) for d in S.PORTABLE)
_PROMOTED = " AND ".join([f"action = {_q(S.PROMOTED[0])}", *[hunt_sql(t) for t in S.PROMOTED[1]]])
_TEST_IDS = [r["id"] for r in S.RULES[::4]] + ["R-9999"]
_ALLOW = "(" + ", ".join(_q(p) for p in S.ALLOWED) + ")"
TEXT_NAMES, SIG_NAMES = _scan("text")
FILE_NAMES = _scan("content")[1]
HTML_NAMES = _scan("html", True)[0]


def _audit() -> str:
    sealed = ["s AS (SELECT CAST(floor(seq / 4) AS BIGINT) AS log, seq % 4 AS n, CAST(us AS VARCHAR) AS time, name AS actor, action, path AS target, command_line AS detail FROM tel)"]
    ent = lambda i: ", ".join(f"coalesce(max({c}) FILTER (n = {i}), '') AS {c}{i}" for c in ("time", "actor", "action", "target", "detail"))
    sealed.append("w AS (SELECT log, " + ", ".join(ent(i) for i in range(4)) + " FROM s GROUP BY log)")
    prev, src = "''", "w"
    for i in range(4):
        sealed.append(f"h{i}t AS (SELECT *, sha256(concat_ws(chr(31), '{i + 1}', time{i}, actor{i}, action{i}, target{i}, detail{i}, {prev})) AS h{i} FROM {src})")
        prev, src = f"h{i}", f"h{i}t"
    rows = " UNION ALL ".join(f"SELECT log, {i + 1} AS seq, time{i} AS time, actor{i} AS actor, action{i} AS action, target{i} AS target, detail{i} AS detail, {chr(39) * 2 if i == 0 else f'h{i - 1}'} AS prev_hash, h{i} AS hash FROM h3t WHERE time{i} <> ''"
                              for i in range(4))
    sealed.append(f"""lg AS (SELECT log, seq, time, actor, action, target, CASE WHEN seq = 2 AND log % 7 = 3 THEN 'altered' ELSE detail END AS detail,
   CASE WHEN seq = 2 AND log % 11 = 5 THEN '' ELSE prev_hash END AS prev_hash, hash FROM ({rows}) WHERE NOT (seq = 3 AND log % 13 = 1))""")
    sealed.append("""v AS (SELECT *, CASE WHEN prev_hash <> coalesce(lag(hash) OVER (PARTITION BY log ORDER BY seq), '') THEN 'chain broken (prev_hash mismatch)'
   WHEN sha256(concat_ws(chr(31), CAST(seq AS VARCHAR), time, actor, action, target, detail, prev_hash)) <> hash THEN 'hash mismatch (record tampered)' END AS p FROM lg)""")
    return (f"WITH {TEL}, " + ", ".join(sealed) + " SELECT log, count(*)::BIGINT AS entries, count(p) = 0 AS valid, coalesce(min(seq) FILTER (p IS NOT NULL), 0)::BIGINT AS bad_seq, "
            "coalesce(arg_min(p, seq) FILTER (p IS NOT NULL), '') AS problem FROM v GROUP BY log")


def _playbooks() -> str:
    parts = []
    for b in S.PLAYBOOKS:
        if b["mode"] == "off":
            continue
        t, tests = b["trigger"], []
        if t.get("min_risk"):
            tests.append(f"risk_score >= {t['min_risk']}")
        if t.get("incidents_only"):
            tests.append("is_incident")
        for key, col in (("rule_ids", "rule_id"), ("techniques", "technique_id")):
            if t.get(key):
                tests.append(f"{col} IN ({', '.join(map(_q, t[key]))})")
        if t.get("severities"):
            tests.append(f"lower(severity) IN ({', '.join(_q(s.lower()) for s in t['severities'])})")
        for i, step in enumerate(b["steps"]):
            kind, dry = step["type"], b["mode"] != "enforce"
            held = dry and kind != "run_hunt"
            would = {"notify": "concat('would notify on ', rule_id)", "open_case": "concat('would open a case for ', hostname)",
                     "kill_process": "concat('would ask ', hostname, ' to kill pid ', pid)",
                     "quarantine": "concat('would quarantine ', destination_ip, ' on ', hostname)"}
            does = {"notify": "concat('notify ', rule_name, ': risk ', risk_score, ' on ', hostname)", "open_case": "concat('open case ', rule_name)",
                    "run_hunt": _q(f"hunt {step.get('query')}"), "kill_process": "concat('kill pid ', pid)", "quarantine": "concat('quarantine ', destination_ip)"}
            lost = "false" if held or kind != "quarantine" else "destination_ip = ''"
            parts.append(f"SELECT id AS alert_id, seq, {_q(b['id'])} AS playbook_id, {_q(b['mode'])} AS mode, {i}::BIGINT AS position, {_q(kind)} AS type, "
                         f"{would[kind] if held else does[kind]} AS detail, {'false' if held else f'NOT ({lost})'} AS executed, "
                         f"CASE WHEN {lost} THEN 'missing target (no pid or destination on the alert)' ELSE '' END AS error FROM both_r WHERE {' AND '.join(tests) or 'true'}")
    inc = "SELECT substring(sha256(concat_ws(chr(31), 'incident', host, process_key, id)), 1, 32) AS id, host AS hostname, seq, id AS rule_id, summary AS rule_name, 'critical' AS severity, split_part(techniques, ',', 1) AS technique_id, 0 AS pid, '' AS destination_ip, risk_score, true AS is_incident FROM incidents"
    rec = RECORDS + "," + _incidents("alerts", DAY, 75)
    return (f"WITH {rec}, both_r AS (SELECT id, hostname, seq, rule_id, rule_name, severity, technique_id, pid, destination_ip, risk_score, is_incident FROM records UNION ALL {inc}) "
            + " UNION ALL ".join(parts))


def _ioc_alerts() -> str:
    shared = ALERTS + IOC[len(TEL):]
    return (f"WITH {shared}, every_alert AS MATERIALIZED (SELECT seq, us, host, pid, start_ns, name, rule_id, technique_id, risk, ord FROM alerts UNION ALL "
            "SELECT t.seq, t.us, t.host, t.pid, t.start_ns, t.name, concat('INTEL-', upper(h.type)), CASE WHEN h.type IN ('ip', 'domain') THEN 'T1071' ELSE '' END, 60, 1000000 + h.probe "
            "FROM hits h JOIN tel t USING (seq))," + _incidents("every_alert", DAY // 2, 100) + f" SELECT {INC_COLS} FROM incidents")


_PARENT_CTE = TEL + "," + _LIFE.format(start="start_ns") + """,
lookup AS (SELECT host, ppid AS pid, us, seq, 1 AS turn, NULL::BOOLEAN AS alive, NULL AS nm, NULL AS exe FROM tel
  UNION ALL SELECT host, pid, us, seq, 0, alive, name, exe FROM life),
best AS (SELECT *, max(CASE WHEN turn = 0 THEN (us, seq) END) OVER (PARTITION BY host, pid ORDER BY us, seq, turn) AS pos FROM lookup),
parent AS MATERIALIZED (SELECT b.seq, l.name AS pname, l.exe AS pexe FROM best b JOIN life l ON l.host = b.host AND l.pid = b.pid AND (l.us, l.seq) = b.pos
  WHERE b.turn = 1 AND l.alive)"""


def _full_pipeline() -> str:
    rules = _alerts_cte(S.RULES, "tel2")
    for name, col in (("parent_name", "pname"), ("parent_executable", "pexe")):
        pass
    text = _PARENT_CTE + ", tel2 AS MATERIALIZED (SELECT t.*, coalesce(p.pname, '') AS pname, coalesce(p.pexe, '') AS pexe FROM tel t LEFT JOIN parent p USING (seq)), " + RULES_CTE
    saved = dict(_TEXT)
    _TEXT.update({"process.parent.name": "pname", "process.parent.executable": "pexe"})
    try:
        rules = _alerts_cte(S.RULES, "tel2")
    finally:
        _TEXT.clear()
        _TEXT.update(saved)
    return f"WITH {text}, {rules}, {_incidents('alerts', DAY, 75)} SELECT {INC_COLS} FROM incidents"


def build() -> dict[str, str]:
    fmt_event = ("concat(strftime(make_timestamp(us), '%H:%M:%S.'), lpad(CAST((us // 1000) % 1000 AS VARCHAR), 3, '0'), ' ', rpad(action, CAST(greatest(8, length(action)) AS INTEGER), ' '), ' pid=', "
                 f"rpad(CAST(pid AS VARCHAR), 7, ' '), ' ', rpad(name, 16, ' '), ' ', {_DETAIL})")
    return {
        "normalize_events": f"WITH {TEL} SELECT seq, action, CAST(CASE action WHEN 'exec' THEN 1 WHEN 'fork' THEN 2 WHEN 'exit' THEN 3 WHEN 'open' THEN 4 WHEN 'unlink' THEN 5 WHEN 'rename' THEN 6 WHEN 'chmod' THEN 7 WHEN 'connect' THEN 8 WHEN 'accept' THEN 9 WHEN 'ptrace' THEN 11 WHEN 'module_load' THEN 12 WHEN 'setuid' THEN 16 WHEN 'dns' THEN 17 END AS BIGINT) AS event_type, '1.0' AS schema_version FROM tel",
        "field_values": f"WITH {TEL} SELECT seq, nullif(path, '') AS path, nullif(dst_port, 0)::BIGINT AS port, mode::BIGINT AS mode, nullif(user_name, '') AS user_name, stdio_socket AS socket FROM tel",
        "process_keys": f"WITH {TEL} SELECT seq, concat(pid, ':', start_ns) AS process_key FROM tel",
        "search_texts": f"WITH {TEL} SELECT seq, lower(concat(name, ' ', executable, ' ', command_line, ' ', path, ' ', target, ' ', dst_ip, ' ', domain, ' ', host)) AS search FROM tel",
        "event_details": f"WITH {TEL} SELECT seq, {_DETAIL} AS detail FROM tel",
        "rule_operators": _matrix(S.RULE_TREES, rule_sql),
        "hunt_operators": _matrix(S.HUNT_TREES, hunt_sql),
        "portable_rules": f"WITH {TEL}, {_rules_cte(_SIGMA)}, {_alerts_cte(_SIGMA)} SELECT seq, rule_id, severity, risk::BIGINT AS risk_score, technique_id, tactic FROM alerts",
        "detect_alerts": f"WITH {ALERTS} SELECT seq, rule_id, severity, risk::BIGINT AS risk FROM alerts",
        "detect_counts_by_rule": f"WITH {ALERTS} SELECT rule_id, count(*)::BIGINT AS n, count(DISTINCT host)::BIGINT AS hosts FROM alerts GROUP BY 1",
        "flagship_incidents": f"WITH {INCIDENTS} SELECT {INC_COLS} FROM incidents",
        "incidents_from_alerts": _ioc_alerts(),
        "full_pipeline_incidents": _full_pipeline(),
        "fleet_signals": _signals(),
        "hunt_simple": f"WITH {TEL} SELECT us AS time, host, action, pid, name AS process, executable, command_line, '' AS parent, user_name AS \"user\", CASE WHEN dst_port <> 0 THEN concat(dst_ip, ':', dst_port) ELSE dst_ip END AS destination, domain, path AS file FROM tel WHERE action = 'connect' AND dst_port >= 443 AND pid > 20",
        "hunt_newest": f"WITH {TEL} SELECT seq, action, host FROM tel WHERE user_name <> '' AND user_name <> 'user7' ORDER BY us DESC, seq DESC LIMIT 50",
        "hunt_promoted": f"WITH {TEL} SELECT seq, 'H-1' AS rule_id FROM tel WHERE {_PROMOTED}",
        "sequence_by_host": _sequence(S.TWO_STAGES, "host", DAY, 2),
        "sequence_unlimited": _sequence(S.THREE_STAGES, "CAST(pid AS VARCHAR)", None, 3),
        "sequence_global": _sequence(S.GLOBAL_STAGES, "''", DAY // 24, 2),
        "indicator_hits": f"WITH {IOC} SELECT seq, indicator, type, field, source FROM hits",
        "indicator_alerts": f"WITH {IOC} SELECT seq, concat('INTEL-', upper(type)) AS rule_id, concat(field, ' \"', indicator, '\" matched an indicator from feed ', source) AS description, CASE WHEN type IN ('ip', 'domain') THEN 'T1071' ELSE '' END AS technique_id, 60::BIGINT AS risk_score FROM hits",
        "cidr_join": f"WITH {IOC} SELECT t.seq, t.dst_ip AS ip, r.cidr FROM tel t LEFT JOIN ranged r ON r.k2 = t.dst_ip WHERE t.dst_ip <> ''",
        "parent_lookup": f"WITH {_PARENT_CTE} SELECT t.seq, coalesce(p.pname, '') AS parent_name, coalesce(p.pexe, '') AS parent_executable FROM tel t LEFT JOIN parent p USING (seq)",
        "start_stamp": f"WITH {TEL}, {_LIFE.format(start=chr(34) + 'st' + chr(34)).replace('FROM tel', 'FROM tel3')}, best AS (SELECT *, max(CASE WHEN action IN ('exec', 'fork', 'exit') THEN (us, seq) END) OVER (PARTITION BY host, pid ORDER BY us, seq) AS pos FROM tel3) SELECT b.seq, CASE WHEN b.st = 0 AND l.alive THEN l.start ELSE b.st END AS start_ns FROM best b LEFT JOIN life l ON l.host = b.host AND l.pid = b.pid AND (l.us, l.seq) = b.pos".replace(f"WITH {TEL},", f"WITH {TEL}, tel3 AS (SELECT *, CASE WHEN action = 'exec' THEN seq * 1000 + 7 ELSE 0 END AS st FROM tel),"),
        "ancestry_chains": f"WITH {TEL},{_LIFE.format(start='start_ns')},{_levels(16)} SELECT t.seq, coalesce(c.chain, '') AS chain FROM tel t LEFT JOIN (SELECT host, seq, arg_max(chain, length(chain)) AS chain FROM ({' UNION ALL '.join(f'SELECT host, seq, chain FROM l{i}' for i in range(1, 17))}) GROUP BY ALL) c USING (host, seq)",
        "user_names": f"WITH {TEL} SELECT seq, CASE WHEN user_name <> '' THEN user_name ELSE coalesce(n_name, '') END AS user_name FROM tel LEFT JOIN nation ON n_nationkey = uid",
        "container_parse": f"WITH {TEL} SELECT seq, regexp_extract(cgroup, '[0-9a-f]{{64}}|[0-9a-f]{{32}}') AS container_id, CASE WHEN regexp_extract(cgroup, '[0-9a-f]{{64}}|[0-9a-f]{{32}}') = '' THEN '' WHEN contains(cgroup, 'docker') THEN 'docker' WHEN contains(cgroup, 'kubepods') THEN 'containerd' ELSE '' END AS runtime FROM tel",
        "content_hash": "SELECT page_id, sha256(html) AS sha256 FROM pages",
        "executable_hash": f"WITH {TEL}, {_FILES} SELECT seq, CASE WHEN t.sha256 <> '' THEN t.sha256 WHEN action = 'exec' THEN coalesce(sha256(content), '') ELSE '' END AS sha256 FROM tel t LEFT JOIN files ON executable <> '' AND fpath = concat(executable, '-', seq // 120)",
        "content_scan_text": f"SELECT doc_id, {TEXT_NAMES} AS matches FROM documents",
        "content_scan_html": f"SELECT page_id, {HTML_NAMES} AS matches FROM pages",
        "signature_alerts": f"WITH {TEL}, {_FILES} SELECT seq, 'R-0073' AS rule_id, matches FROM tel JOIN (SELECT fpath, {FILE_NAMES} AS matches FROM files) ON executable <> '' AND fpath = concat(executable, '-', seq // 120) WHERE action = 'exec' AND matches <> ''",
        "tactic_lookup": f"WITH {_PART_RULES} SELECT technique_id, arg_max(tactic, id) AS tactic FROM prules WHERE technique_id <> '' GROUP BY 1",
        "allowlist": f"WITH {ALERTS} SELECT seq, rule_id, executable IN {_ALLOW} AS suppressed FROM alerts",
        "baseline": f"WITH {TEL} SELECT category, key, count(*)::BIGINT AS n FROM ({_features()}) GROUP BY ALL",
        "rarity_score": f"WITH {_RARITY} SELECT seq, round(score, 6) AS rarity FROM scored",
        "anomaly_alerts": f"WITH {_RARITY} SELECT seq, 'R-0050' AS rule_id, round(score, 6) AS score FROM scored WHERE action = 'exec' AND floor(score * 100 + 0.5) >= 90",
        "feature_vectors": f"WITH {TEL} SELECT seq, length(name)::DOUBLE AS name_len, length(command_line)::DOUBLE AS cmd_len, 0.0::DOUBLE AS argc, hour(make_timestamp(us))::DOUBLE AS hour, dst_port::DOUBLE AS port, uid::DOUBLE AS uid, (length(executable) - length(replace(executable, '/', '')))::DOUBLE AS depth, round({_entropy('name')}, 6) AS entropy FROM tel",
        "entropy_of_names": f"SELECT p_partkey, round({_entropy('p_name')}, 6) AS entropy FROM part",
        "graph_nodes": f"WITH {TEL},{NODES} SELECT host, id, kind, label, pid::BIGINT AS pid, detail FROM nodes",
        "graph_edges": f"WITH {TEL},{EDGES} SELECT host, source, target, kind FROM edges",
        "graph_alerts": f"WITH {RECORDS},{NODES}, marks AS (SELECT hostname, pid, array_to_string(list_sort(list_distinct(list(technique_id) FILTER (technique_id <> ''))), ',') AS techniques, arg_max(severity, CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 WHEN 'critical' THEN 5 END) AS severity FROM records GROUP BY ALL) SELECT n.host, n.id, m.pid IS NOT NULL AS alerting, coalesce(m.techniques, '') AS techniques, coalesce(m.severity, '') AS severity FROM nodes n LEFT JOIN marks m ON m.hostname = n.host AND n.id = concat('proc:', m.pid)",
        "graph_layers": f"WITH RECURSIVE {TEL},{NODES},{EDGES}, up AS (SELECT host, target AS id, coalesce(max(source) FILTER (kind = 'spawned'), min(source) FILTER (kind <> 'spawned')) AS p FROM edges GROUP BY ALL), link AS MATERIALIZED (SELECT n.host, n.id, u.p FROM nodes n LEFT JOIN (SELECT up.* FROM up JOIN nodes k ON k.host = up.host AND k.id = up.p) u ON u.host = n.host AND u.id = n.id), walk AS (SELECT host, id, 0::BIGINT AS layer FROM link WHERE p IS NULL UNION ALL SELECT l.host, l.id, w.layer + 1 FROM walk w JOIN link l ON l.host = w.host AND l.p = w.id) SELECT host, id, layer FROM walk",
        "triage_reports": f"""WITH {RECORDS},{_CTX}, base AS (SELECT r.*, h.n, h.high FROM records r JOIN hosts h USING (hostname)),
adv AS (SELECT b.seq, b.rule_id, step, min(rn) AS rn FROM (SELECT b.seq, b.rule_id, t.rn, {_advice("b.hostname", "b.process_name", "b.pid", "t.tactic")} AS step FROM base b JOIN tech t ON t.hostname = b.hostname) b WHERE step IS NOT NULL GROUP BY ALL),
lines AS (SELECT seq, rule_id, string_agg(step, '|' ORDER BY rn) AS s FROM adv GROUP BY ALL)
SELECT b.seq, b.rule_id, concat('Host ', b.hostname, ': process ', process_name, ' (pid ', pid, ') accumulated risk ', risk_score, ' across ', (SELECT count(*) FROM tech t WHERE t.hostname = b.hostname), ' ATT&CK technique(s) — ',
 (SELECT string_agg(concat(technique_id, ' ', tname), ', ' ORDER BY rn) FROM tech t WHERE t.hostname = b.hostname), '. ', n, ' detection(s) fired, ', high, ' high-or-critical. Review the process tree on ', b.hostname, ' and the destinations it contacted before deciding on containment.') AS summary,
 concat(coalesce(concat(l.s, '|'), ''), 'Snapshot ', b.hostname, ' and preserve volatile memory before remediation.') AS steps,
 CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 75 THEN 'high' WHEN risk_score >= 50 THEN 'medium' ELSE 'low' END AS severity FROM base b LEFT JOIN lines l USING (seq, rule_id)""",
        "alert_history": f"WITH {RECORDS} SELECT seq, hostname, rule_id, us FROM records WHERE severity = 'high' AND us BETWEEN {T0} AND {T1}",
        "alert_history_page": f"WITH {RECORDS} SELECT seq, rule_id FROM records WHERE rule_id <> 'R-0067' AND hostname = 'host-4' AND technique_id = 'T1489' ORDER BY us DESC, seq DESC LIMIT 20",
        "alert_lookup": f"WITH {RECORDS} SELECT id, seq, rule_id FROM records",
        "host_timeline": f"WITH {RECORDS} SELECT seq, rule_id, concat(process_name, '  ▶ ', technique_id, CASE WHEN destination_ip <> '' THEN concat('  ▶ ', destination_ip) ELSE '' END) AS chain FROM records",
        "live_tail": f"WITH {RECORDS} SELECT seq, rule_id FROM records WHERE hostname = 'host-2' AND severity = 'high'",
        "case_rejects": f"WITH {_CASES_LOG} SELECT case_ref, seq, kind, problem, alert_id FROM checked WHERE problem IS NOT NULL",
        "case_fold": f"WITH {_CASES_LOG} SELECT case_id, case_ref, title, severity, host, status, assignee, comments, created_us, updated_us FROM cases",
        "case_evidence_rows": f"WITH {_CASES_LOG} SELECT case_id, ord[2] AS ord, id, rule_id, severity FROM found",
        "case_report": _case_report(),
        "response_plan": f"WITH {ALERTS}, acted AS (SELECT seq, rule_id, {_response('risk')} AS action_due, executable IN {_ALLOW} AS suppressed FROM alerts) SELECT *, CASE WHEN action_due <> 'alert_only' AND NOT suppressed THEN action_due ELSE '' END AS response_action, CASE WHEN action_due <> 'alert_only' AND NOT suppressed THEN 'dry-run' ELSE '' END AS response_result FROM acted",
        "block_list": f"WITH {IOC} SELECT DISTINCT t.dst_ip AS ip, 'ip' AS family FROM hits JOIN tel t USING (seq) WHERE t.dst_ip <> ''",
        "playbook_runs": _playbooks(),
        "coverage": f"WITH {_PART_RULES}, c AS (SELECT technique_id, count(*)::BIGINT AS score, string_agg(id, ', ' ORDER BY id) AS ids FROM prules WHERE technique_id <> '' GROUP BY 1) SELECT technique_id, score, concat(score, ' rule(s): ', ids) AS comment, greatest(max(score) OVER (), 1)::BIGINT AS max_score FROM c",
        "tactic_matrix": f"WITH {_PART_RULES}, c AS (SELECT CASE WHEN tactic = '' THEN 'uncategorized' ELSE tactic END AS tactic, CASE WHEN technique_id = '' THEN '—' ELSE technique_id END AS technique_id, count(*)::BIGINT AS n FROM prules GROUP BY ALL) SELECT tactic, technique_id, n, CASE WHEN tactic = 'uncategorized' THEN 99 ELSE list_position([{', '.join(map(_q, TACTIC_ORDER))}], tactic) - 1 END::BIGINT AS position, round(0.25 + 0.75 * n / max(n) OVER (), 6) AS shade FROM c",
        "rule_quality": f"""WITH {ALERTS}, fx AS (SELECT *, [{', '.join(map(_q, _TEST_IDS))}][seq % {len(_TEST_IDS)} + 1] AS test_rule, CASE WHEN seq % 2 = 0 THEN 'fire' ELSE 'no-fire' END AS expect FROM tel),
tests AS (SELECT concat(test_rule, '/', seq % 50) AS tname, max(test_rule) AS rule, max(expect) AS expect FROM fx GROUP BY 1),
fired AS (SELECT DISTINCT concat(f.test_rule, '/', f.seq % 50) AS tname FROM fx f JOIN alerts a ON a.seq = f.seq AND a.rule_id = f.test_rule),
res AS (SELECT t.*, f.tname IS NOT NULL AS fired, t.rule <> 'R-9999' AND (f.tname IS NOT NULL) = (expect = 'fire') AS passed FROM tests t LEFT JOIN fired f ON f.tname = t.tname)
SELECT count(*)::BIGINT AS total, count_if(passed)::BIGINT AS passed, count_if(NOT passed AND expect = 'no-fire')::BIGINT AS false_positives, count_if(NOT passed AND expect = 'fire')::BIGINT AS false_negatives,
 round(count_if(NOT passed AND expect = 'no-fire') / count_if(expect = 'no-fire'), 6) AS false_positive_rate, (SELECT string_agg(rule_id, ',' ORDER BY rule_id) FROM rules WHERE rule_id NOT IN (SELECT rule FROM tests)) AS untested FROM res""",
        "value_histogram": f"WITH {_HIST} SELECT label, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, count, total, round(sum, 2) AS sum FROM h",
        "bucket_p95": f"WITH {_HIST}, l AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(count) OVER w, 0) AS below FROM h WINDOW w AS (PARTITION BY label ORDER BY le)), f AS (SELECT * FROM l WHERE count >= total * 0.95 QUALIFY row_number() OVER (PARTITION BY label ORDER BY le) = 1) SELECT label, round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (total * 0.95 - below) / (count - below) END, 6) AS quantile FROM f",
        "event_rate": f"WITH {TEL} SELECT (us // 21600000000) * 21600000000 AS start_us, count(*)::BIGINT AS n, round(count(*) / 21600.0, 9) AS per_second FROM tel GROUP BY 1",
        "alert_counter": f"WITH {RECORDS} SELECT severity AS label, count(*)::BIGINT AS n FROM records GROUP BY 1",
        "latest_heartbeat": f"WITH {TEL}, {_HEART} SELECT host, seq, events_processed, alerts, incidents FROM agents",
        "fleet_tiles": f"WITH {TEL}, {_HEART} SELECT count(*)::BIGINT AS agents, count_if(us >= 1706659200000000 - 21600000000)::BIGINT AS online, sum(events_processed)::BIGINT AS events_processed, sum(alerts)::BIGINT AS alerts, sum(incidents)::BIGINT AS incidents FROM agents",
        "recent_alerts": f"WITH {RECORDS} SELECT seq FROM records ORDER BY us DESC, seq DESC LIMIT 200",
        "lake_filter": f"WITH {TEL} SELECT seq, host FROM tel WHERE action = 'connect' AND us BETWEEN {T0} AND {T1} AND contains(lower(concat(name, ' ', executable, ' ', command_line, ' ', path, ' ', target, ' ', dst_ip, ' ', domain, ' ', host)), 'ssh') ORDER BY us DESC, seq DESC LIMIT 30",
        "lake_ascending": f"WITH {TEL} SELECT seq, action FROM tel WHERE host = 'host-5' AND pid = 40",
        "lake_count": "SELECT count(*)::BIGINT AS n FROM events",
        "alert_retention": f"WITH {RECORDS} SELECT count_if(us >= {T0})::BIGINT AS kept, min(seq) FILTER (us >= {T0}) AS first_seq, count_if(us < {T0})::BIGINT AS pruned FROM records",
        "alert_append": f"WITH {RECORDS} SELECT id, seq, rule_id, risk_score FROM records",
        "retention": f"WITH {TEL} SELECT count_if(us >= {T0})::BIGINT AS kept, min(seq) FILTER (us >= {T0}) AS first_seq, count_if(us < {T0})::BIGINT AS pruned FROM tel",
        "ecs_events": f"WITH {TEL} SELECT seq, {_ISO.format(c='us')} AS stamp, action, {_ECS_CAT} AS category, {_ECS_TYPE} AS type, nullif(executable, '') AS executable, nullif(ppid, 0) AS parent_pid, nullif(target, '') AS target_path, CASE WHEN dst_ip <> '' THEN dst_port::BIGINT END AS port, nullif(domain, '') AS question, 'linux' AS os FROM tel",
        "ecs_alerts": f"WITH {ALERTS} SELECT seq, 'alert' AS kind, rule_id, severity, tactic, risk::BIGINT AS risk_score FROM alerts",
        "record_store": f"WITH {INCIDENTS} SELECT 'incident' AS kind, {_ISO.format(c='last_us')} AS ts, id, host, CAST(risk_score AS VARCHAR) AS risk, nullif(split_part(techniques, ',', 1), '') AS first FROM incidents",
        "ocsf_events": f"WITH {TEL} SELECT seq, us // 1000 AS ms, CASE WHEN {_CLASS} >= 4000 THEN 4 ELSE 1 END::BIGINT AS category_uid, CASE {_CLASS} WHEN 1001 THEN 'File System Activity' WHEN 4001 THEN 'Network Activity' WHEN 4003 THEN 'DNS Activity' ELSE 'Process Activity' END AS class_name, ({_ACT})::BIGINT AS activity_id, {_ACTN} AS activity_name, ({_CLASS} * 100 + {_ACT})::BIGINT AS type_uid, CASE WHEN {_CLASS} = 1007 THEN pid END AS process_pid, CASE WHEN {_CLASS} = 1007 THEN nullif(ppid, 0) ELSE pid END AS actor_pid, CASE WHEN {_CLASS} = 1001 AND path <> '' THEN {_BASE.format(c='path')} END AS file_name, CASE WHEN {_CLASS} = 1001 THEN nullif(target, '') END AS new_path, CASE WHEN {_CLASS} >= 4000 THEN nullif(dst_ip, '') END AS dst_ip, CASE WHEN {_CLASS} >= 4000 THEN nullif(domain, '') END AS hostname FROM tel",
        "ocsf_findings": f"WITH {ALERTS} SELECT seq, rule_id AS uid, CASE severity WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END::BIGINT AS severity_id, concat(upper(severity[1]), severity[2:]) AS severity, 200401::BIGINT AS type_uid, technique_id AS technique, ({_CLASS} * 100 + {_ACT})::BIGINT AS evidence_type, CASE WHEN executable <> '' THEN {_BASE.format(c='executable')} END AS file_name FROM alerts",
        "flat_records": f"WITH {RECORDS},{_incidents('alerts', DAY, 75)} SELECT {_FLAT} FROM records UNION ALL {_INC_FLAT}",
        "pretty_lines": f"WITH {INCIDENTS} SELECT seq, {fmt_event} AS line FROM tel UNION ALL SELECT seq, concat('ALERT [', upper(severity), '] ', rule_id, ' ', rule_name, ' (', technique_id, ' ', technique_name, ') — pid=', pid, ' ', name) FROM alerts UNION ALL SELECT seq, concat('INCIDENT [risk ', risk_score, '] ', id, ' — ', summary, ' (techniques: ', replace(techniques, ',', ', '), ')') FROM incidents",
        "audit_chain": _audit(),
    }
