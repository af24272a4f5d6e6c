"""The registered queries: each operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import event_detail, process_key, search_text
from ..functions.predicates import hunt_predicate, rule_predicate
from ..functions.sigma import sigma_rule
from ..functions.text import entropy
from ..operators import (anomaly, audit, cases, content, correlate, detect, enrich, export, hunt, intel, investigate,
                         metrics, ordered, quality, respond)
from ..rules import load_rules
from ..schema import micros, normalize
from ..sources.indicators import classify
from ..sources.lake import lake_query, retention_report, with_lake_columns
from ..sources.sinks import append_alerts
from ..sources.sinks import records as record_rows
from ..streaming.live import tail_alerts
from ..session import Shelf
from . import samples as S
from .telemetry import flat, table, telemetry

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
DAY = timedelta(days=1)
T0 = datetime(2024, 1, 10, tzinfo=timezone.utc)
T1 = datetime(2024, 1, 12, tzinfo=timezone.utc)
TRAINED = datetime(2024, 1, 2, tzinfo=timezone.utc)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _joined(c: str):
    return F.array_join(c, ",").alias(c)


def _alerts(spark, d) -> DataFrame:
    return detect.detect(telemetry(spark, d), S.RULES)


def _records(spark, d) -> DataFrame:
    return export.flatten_alerts(_alerts(spark, d))


def _written(spark, df: DataFrame) -> DataFrame:
    """``df`` written once, for queries that read it several times."""
    return Shelf(spark).save(df, "rows")


def _incidents(spark, d) -> DataFrame:
    return correlate.incidents_of(correlate.fired_events(telemetry(spark, d), S.RULES), DAY)


def _rule_table(spark) -> DataFrame:
    return detect.rule_frame(spark, S.RULES)


def _feed(spark) -> DataFrame:
    return classify(spark.createDataFrame(S.FEED, "value string, source string, ord long"))


# ---- events, fields, predicates ------------------------------------------------------


@query
def normalize_events(spark, d):
    """B1: half the rows carry only the verb, half only its number."""
    t = telemetry(spark, d)
    half = F.col("seq") % 2 == 0
    df = t.withColumns({"event_type": F.when(half, F.col("event_type")),
                        "action": F.when(~half, F.col("action")), "schema_version": F.lit("")})
    return normalize(df).select("seq", "action", _long("event_type").alias("event_type"), "schema_version")


@query
def field_values(spark, d):
    """B2: presence of absent-able fields."""
    from ..functions.fields import field

    return telemetry(spark, d).select(
        "seq", field("file.path").alias("path"), field("destination.port").alias("port"),
        field("file.mode").alias("mode"), field("user.name").alias("user_name"),
        field("process.stdio_socket").alias("socket"))


@query
def process_keys(spark, d):
    return telemetry(spark, d).select("seq", process_key().alias("process_key"))


@query
def search_texts(spark, d):
    return telemetry(spark, d).select("seq", search_text().alias("search"))


@query
def event_details(spark, d):
    return telemetry(spark, d).select("seq", event_detail().alias("detail"))


def _matrix(df: DataFrame, trees: dict, lower) -> DataFrame:
    """(op, n, seqs) for many predicates in one pass."""
    names = list(trees)
    totals = df.agg(*[F.count_if(lower(trees[n])).alias(f"n{i}") for i, n in enumerate(names)],
                    *[F.sum(F.when(lower(trees[n]), F.col("seq"))).alias(f"s{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("op"), F.col(f"n{i}").alias("n"),
                              F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("long").alias("seqs"))
                     for i, n in enumerate(names)])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


@query
def rule_operators(spark, d):
    """C1-C17."""
    return _matrix(telemetry(spark, d), S.RULE_TREES, rule_predicate)


@query
def hunt_operators(spark, d):
    """C19-C26."""
    return _matrix(telemetry(spark, d), S.HUNT_TREES, hunt_predicate)


@query
def portable_rules(spark, d):
    """C27-C34."""
    rules = load_rules(sigma_rule(doc) for doc in S.PORTABLE)
    return detect.detect(telemetry(spark, d), rules).select(
        "seq", F.col("rule.id").alias("rule_id"), F.col("rule.severity").alias("severity"),
        _long("rule.risk_score").alias("risk_score"), F.col("rule.technique.id").alias("technique_id"),
        F.col("rule.technique.tactic").alias("tactic"))


# ---- detection, hunting, indicators --------------------------------------------------


@query
def detect_alerts(spark, d):
    """D1 over whole tables with every shipped rule."""
    return _alerts(spark, d).select("seq", F.col("rule.id").alias("rule_id"),
                                    F.col("rule.severity").alias("severity"),
                                    _long(detect.alert_risk()).alias("risk"))


@query
def detect_counts_by_rule(spark, d):
    return (_alerts(spark, d).groupBy(F.col("rule.id").alias("rule_id"))
            .agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts")))


@query
def flagship_incidents(spark, d):
    """Which rules fired, on which hosts, and which processes crossed the threshold."""
    return _incident_rows(_incidents(spark, d))


def _incident_rows(df):
    return df.select("id", "host", "process_key", _long("risk_score").alias("risk_score"), _joined("techniques"),
                     _joined("rule_ids"), micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"),
                     "summary")


@query
def incidents_from_alerts(spark, d):
    """G1 fed by alert rows, rules and indicators together."""
    alerts = detect.detect_all(telemetry(spark, d), S.RULES, _feed(spark))
    return _incident_rows(correlate.correlate(alerts, timedelta(hours=12), 100))


@query
def full_pipeline_incidents(spark, d):
    """Process-tree context, then rules that need it, then incidents."""
    df = enrich.with_parent(telemetry(spark, d))
    return _incident_rows(correlate.incidents_of(correlate.fired_events(df, S.RULES), DAY))


@query
def fleet_signals(spark, d):
    """G2."""
    out = correlate.fleet_signals(_records(spark, d), timedelta(hours=6), 3)
    return out.select("kind", "key", _joined("hosts"), micros("first_seen").alias("first_us"),
                      micros("last_seen").alias("last_us"), "summary")


@query
def hunt_simple(spark, d):
    """D3, B6."""
    rows = hunt.hunt(telemetry(spark, d), "connect", S.L("destination.port", ">=", 443), "process.pid > 20")
    return export.hunt_rows(rows).withColumn("time", micros("time"))


@query
def hunt_newest(spark, d):
    """D3 with the last limit, S1: a top-k report."""
    rows = hunt.hunt(telemetry(spark, d), "any", S.L("user.name", "!=", "user7"), limit=50)
    return rows.select("seq", "action", "host")


@query
def hunt_promoted(spark, d):
    """The promoted rule fires exactly on the hunt's rows."""
    cls, filters = S.PROMOTED
    rule = hunt.promote(cls, filters, {"id": "H-1", "name": "promoted", "severity": "high"})
    return detect.detect(telemetry(spark, d), load_rules([rule])).select("seq", F.col("rule.id").alias("rule_id"))


@query
def sequence_by_host(spark, d):
    """G3, two stages within a window."""
    out = hunt.sequence(telemetry(spark, d), S.TWO_STAGES, "host.name", S.TWO_WITHIN)
    return out.select("key", F.col("e0.seq").alias("s0"), F.col("e1.seq").alias("s1"))


@query
def sequence_unlimited(spark, d):
    """G3, three stages per process without a window."""
    out = hunt.sequence(telemetry(spark, d), S.THREE_STAGES, "process.pid")
    return out.select("key", F.col("e0.seq").alias("s0"), F.col("e1.seq").alias("s1"), F.col("e2.seq").alias("s2"))


@query
def sequence_global(spark, d):
    """G3 with no key."""
    out = hunt.sequence(telemetry(spark, d), S.GLOBAL_STAGES, None, S.GLOBAL_WITHIN)
    return out.select("key", F.col("e0.seq").alias("s0"), F.col("e1.seq").alias("s1"))


@query
def indicator_hits(spark, d):
    """D5, A10, E8."""
    return intel.match_indicators(telemetry(spark, d), _feed(spark)).select("seq", "ioc.indicator", "ioc.type",
                                                                           "ioc.field", "ioc.source")


@query
def indicator_alerts(spark, d):
    """D6."""
    hits = intel.match_indicators(telemetry(spark, d), _feed(spark))
    return detect.intel_alerts(hits).select(
        "seq", F.col("rule.id").alias("rule_id"), F.col("rule.description").alias("description"),
        F.col("rule.technique.id").alias("technique_id"), _long("rule.risk_score").alias("risk_score"))


@query
def cidr_join(spark, d):
    """First network in feed order per destination."""
    nets = spark.createDataFrame([(v, o) for v, _, o in S.FEED if "/" in v], "cidr string, ord long")
    df = telemetry(spark, d).filter("network.dst_ip <> ''").select("seq", F.col("network.dst_ip").alias("ip"))
    return intel.join_cidr(df, "ip", nets).select("seq", "ip", F.col("net.cidr").alias("cidr"))


# ---- enrichment ----------------------------------------------------------------------


@query
def parent_lookup(spark, d):
    """E1."""
    return enrich.with_parent(telemetry(spark, d)).select(
        "seq", F.coalesce("process.parent_name", F.lit("")).alias("parent_name"),
        F.coalesce("process.parent_executable", F.lit("")).alias("parent_executable"))


@query
def start_stamp(spark, d):
    """Only exec rows record a start."""
    t = telemetry(spark, d)
    start = F.when(F.col("action") == "exec", F.col("seq") * 1000 + 7).otherwise(0).cast("long")
    blank = t.withColumn("process", F.col("process").withField("start_time_ns", start))
    return enrich.with_start(blank).select("seq", F.col("process.start_time_ns").alias("start_ns"))


@query
def ancestry_chains(spark, d):
    """E3."""
    return enrich.with_ancestry(telemetry(spark, d)).select(
        "seq", F.coalesce(F.array_join("process.ancestors", ">"), F.lit("")).alias("chain"))


@query
def user_names(spark, d):
    """Names of nations by uid."""
    users = table(spark, d, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("user_name"))
    return enrich.with_user(telemetry(spark, d), users).select("seq", F.col("user.name").alias("user_name"))


@query
def container_parse(spark, d):
    """E5."""
    return enrich.with_container(telemetry(spark, d)).select(
        "seq", F.coalesce("container.id", F.lit("")).alias("container_id"),
        F.coalesce("container.runtime", F.lit("")).alias("runtime"))


def _files(spark, d):
    """One file per document: every twelfth document is a version of one executable path."""
    paths = F.array(*[F.lit(f"/{p}/{n}") for p in ("usr/bin", "tmp")
                      for n in ("bash", "nginx", "curl", "whoami", "ssh", "python3")])
    version = F.floor(F.col("doc_id") / 12).cast("string")
    return table(spark, d, "documents").select(
        F.concat(F.get(paths, (F.col("doc_id") % 12).cast("int")), F.lit("-"), version).alias("path"), F.col("text").cast("binary").alias("content"))


def _versioned(spark, d):
    """Events that ran versions of their executables, so that all files are run."""
    e = telemetry(spark, d)
    path = F.when(F.col("process.executable") != "", F.concat("process.executable", F.lit("-"), F.floor(F.col("seq") / 120).cast("string")))
    return e.withColumn("process", F.col("process").withField("executable", F.coalesce(path, F.lit(""))))


@query
def content_hash(spark, d):
    """Whole pages hashed."""
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query
def executable_hash(spark, d):
    """E6."""
    return enrich.with_hash(_versioned(spark, d), _files(spark, d)).select(
        "seq", F.coalesce("process.sha256", F.lit("")).alias("sha256"))


@query
def content_scan_text(spark, d):
    """D10 over whole texts."""
    df = content.scan_content(table(spark, d, "documents"), "text", content.builtin_signatures() + S.SIGNATURES)
    return df.select("doc_id", F.coalesce(F.array_join("matches", ","), F.lit("")).alias("matches"))


@query
def content_scan_html(spark, d):
    df = content.scan_content(table(spark, d, "pages"), "html", content.builtin_signatures() + S.HTML_SIGNATURES)
    return df.select("page_id", F.coalesce(F.array_join("matches", ","), F.lit("")).alias("matches"))


@query
def signature_alerts(spark, d):
    """E7, D11."""
    scanned = content.scan_content(_files(spark, d), "content", S.SIGNATURES)
    df = enrich.with_signatures(_versioned(spark, d), scanned)
    return (detect.detect(df, [r for r in S.RULES if r["id"] == "R-0073"])
            .select("seq", F.col("rule.id").alias("rule_id"), F.array_join("process.yara_matches", ",").alias("matches")))


@query
def tactic_lookup(spark, d):
    """E9 over rules derived from parts."""
    return enrich.tactic_index(_part_rules(spark, d)).select("technique_id", "tactic")


@query
def allowlist(spark, d):
    """E11."""
    allow = spark.createDataFrame([(p,) for p in S.ALLOWED], "executable string")
    return enrich.suppress(_alerts(spark, d), allow).select("seq", F.col("rule.id").alias("rule_id"), "suppressed")


# ---- anomaly -------------------------------------------------------------------------


@query
def baseline(spark, d):
    """F1, F2."""
    return anomaly.build_baseline(telemetry(spark, d))


@query
def rarity_score(spark, d):
    """trained on the first day, scored on the whole month."""
    t = telemetry(spark, d)
    model = anomaly.build_baseline(t.filter(F.col("ts") < F.lit(TRAINED)))
    return anomaly.score_rarity(t, model).select("seq", F.round("rarity", 6).alias("rarity"))


@query
def anomaly_alerts(spark, d):
    """F8 and the rule on the combined score."""
    t = telemetry(spark, d)
    scored = anomaly.score(t, anomaly.build_baseline(t.filter(F.col("ts") < F.lit(TRAINED))))
    return (detect.detect(scored, [r for r in S.RULES if r["id"] == "R-0050"])
            .select("seq", F.col("rule.id").alias("rule_id"), F.round("anomaly_score", 6).alias("score")))


@query
def feature_vectors(spark, d):
    """F4."""
    v = telemetry(spark, d).withColumn("v", anomaly.feature_vector())
    names = ("name_len", "cmd_len", "argc", "hour", "port", "uid", "depth", "entropy")
    return v.select("seq", *[F.round(F.col("v")[i], 6).alias(n) for i, n in enumerate(names)])


@query
def entropy_of_names(spark, d):
    """F5."""
    return table(spark, d, "part").select("p_partkey", F.round(entropy(F.col("p_name")), 6).alias("entropy"))


@query
def forest_scores(spark, d):
    """no SQL form; checked by properties."""
    t = telemetry(spark, d)
    forest = anomaly.fit_iforest(t)
    return anomaly.score_iforest(t, forest).select("seq", F.round("structural", 6).alias("structural"))


# ---- investigation -------------------------------------------------------------------


@query
def graph_nodes(spark, d):
    """H1."""
    return investigate.graph_nodes(telemetry(spark, d)).withColumn("pid", F.coalesce("pid", F.lit(0)))


@query
def graph_edges(spark, d):
    """H2."""
    return investigate.graph_edges(telemetry(spark, d))


@query
def graph_alerts(spark, d):
    """H3."""
    nodes = investigate.graph_nodes(telemetry(spark, d))
    return investigate.annotate(nodes, _records(spark, d)).select(
        "host", "id", "alerting", _joined("techniques"), "severity")


@query
def graph_layers(spark, d):
    """H4."""
    t = telemetry(spark, d)
    return investigate.graph_layers(investigate.graph_nodes(t), investigate.graph_edges(t))


@query
def triage_reports(spark, d):
    """H5, H6, H7 for every alert."""
    records = _written(spark, _records(spark, d))
    context = investigate.triage_context(records, records, _rule_table(spark))
    out = investigate.containment(investigate.triage_summary(context))
    return out.select("seq", "rule_id", "summary", F.array_join("steps", "|").alias("steps"),
                      detect.severity_for_risk(F.col("risk_score")).alias("severity"))


@query
def alert_history(spark, d):
    """H12."""
    out = investigate.query_alerts(_records(spark, d), severity="high", since=T0, until=T1, limit=None)
    return out.select("seq", "hostname", "rule_id", micros("time").alias("us"))


@query
def alert_history_page(spark, d):
    """H12 with a page size, S3: a top-k report."""
    records = _records(spark, d).filter("rule_id <> 'R-0067'")
    return investigate.query_alerts(records, host="host-4", technique="T1489", limit=20).select("seq", "rule_id")


@query
def alert_lookup(spark, d):
    """Every alert found again by its id."""
    records = _written(spark, _records(spark, d))
    return records.join(records.select("id"), "id").select("id", "seq", "rule_id")


@query
def host_timeline(spark, d):
    """H11."""
    return investigate.timeline(_records(spark, d)).select("seq", "rule_id", "chain")


@query
def live_tail(spark, d):
    """N5's filter."""
    return tail_alerts(_records(spark, d), host="host-2", severity="HIGH").select("seq", "rule_id")


def _case_log(spark, d):
    """Conversations as a case log: conversation = case, turn = order, role = actor."""
    c = table(spark, d, "conversations")
    ts = F.timestamp_micros(F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000)
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))
    conv, turn = F.col("conv_id"), F.col("turn")
    kind = F.when(turn == 0, "create").otherwise(pick(["evidence", "assign", "comment", "status"], turn % 4))
    main = c.select(
        conv.cast("string").alias("case_ref"), ts.alias("ts"), (conv * 100000 + turn * 1000).alias("seq"),
        kind.alias("kind"), F.when(conv % 29 == 3, " ").otherwise(F.concat(F.lit("Case of "), "role")).alias("title"),
        pick(["high", "low", "critical", "", "bogus", "info"], conv % 6).alias("severity"),
        F.concat(F.lit("host-"), (conv % 8).cast("string")).alias("host"),
        F.array(F.lit("tag"), F.concat(F.lit("t"), (conv % 3).cast("string"))).alias("tags"),
        pick(["triage", "closed", "bogus"], conv % 3).alias("status"),
        F.concat("role", (conv % 3).cast("string")).alias("assignee"), F.col("role").alias("author"),
        F.col("text").alias("body"), F.lit("").alias("alert_id"), conv, turn)
    # Every turn also files the alerts of one event as evidence.
    ids = (_records(spark, d).select(F.col("seq").alias("_event"), "id", "rule_id"))
    rank = F.substring("rule_id", 3, 4).cast("long")
    filed = (main.withColumn("_event", conv * 11 + turn).join(ids, "_event")
             .withColumns({"kind": F.lit("evidence"), "alert_id": F.col("id"), "seq": F.col("seq") + 1 + rank})
             .select(*main.columns))
    return main.unionByName(filed).drop("conv_id", "turn")


@query
def case_rejects(spark, d):
    """H8: rejected entries with the reason."""
    checked = cases.check_log(_case_log(spark, d))
    return checked.filter("problem is not null").select("case_ref", "seq", "kind", "problem", "alert_id")


@query
def case_fold(spark, d):
    """H8, H9."""
    folded = cases.fold_cases(cases.check_log(_case_log(spark, d)))
    return cases.list_cases(folded).select(
        "case_id", "case_ref", "title", "severity", "host", "status", "assignee", "comments",
        micros("created").alias("created_us"), micros("updated").alias("updated_us"))


@query
def case_evidence_rows(spark, d):
    """H8, E10."""
    checked = cases.check_log(_case_log(spark, d))
    found = enrich.resolve_evidence(cases.case_evidence(checked, cases.fold_cases(checked)), _records(spark, d))
    return found.select("case_id", F.col("ord.seq").alias("ord"), "id", "rule_id", "severity")


@query
def case_report(spark, d):
    """H10."""
    checked = _written(spark, cases.check_log(_case_log(spark, d)))
    folded = _written(spark, cases.fold_cases(checked))
    records = _written(spark, _records(spark, d))
    lines = cases.case_report_lines(folded, cases.case_evidence(checked, folded), cases.case_comments(checked, folded),
                                    records, _rule_table(spark))
    return lines.select("case_id", _long("section").alias("section"), F.col("ord.seq").alias("ord"), "line")


# ---- response ------------------------------------------------------------------------


@query
def response_plan(spark, d):
    """J1, J2."""
    allow = spark.createDataFrame([(p,) for p in S.ALLOWED], "executable string")
    out = respond.plan_response(_alerts(spark, d), "enforce", "dry-run", allow)
    return out.select("seq", F.col("rule.id").alias("rule_id"), "action_due", "suppressed",
                      F.coalesce("response_action", F.lit("")).alias("response_action"),
                      F.coalesce("response_result", F.lit("")).alias("response_result"))


@query
def block_list(spark, d):
    """With indicator alerts raised to the blocking score."""
    hits = detect.intel_alerts(intel.match_indicators(telemetry(spark, d), _feed(spark)))
    raised = hits.withColumn("rule", F.col("rule").withField("risk_score", F.lit(80)))
    return respond.block_list(respond.plan_response(raised, "enforce", "enforce"))


@query
def playbook_runs(spark, d):
    """J4, J5."""
    alerts = _written(spark, _alerts(spark, d))
    records = export.flatten_alerts(alerts).unionByName(export.flatten_incidents(correlate.correlate(alerts, DAY)))
    runs = respond.expand_steps(respond.match_playbooks(records, S.PLAYBOOKS))
    return runs.select("alert_id", "seq", "playbook_id", "mode", _long("position").alias("position"), "type", "detail",
                       "executed", "error")


# ---- quality and metrics -------------------------------------------------------------


def _part_rules(spark, d):
    """A rule catalogue from parts: one rule per (type, brand), technique by type, tactic by brand."""
    words = F.split("p_type", " ")
    tactics = F.array(*[F.lit(t) for t in (*quality.TACTIC_ORDER, "")])
    rows = table(spark, d, "part").select("p_type", "p_brand").distinct()
    number = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long")
    code = F.when(number % 7 == 0, "").otherwise(F.element_at(words, 1))
    return rows.select(
        F.concat_ws("/", "p_type", "p_brand").alias("id"), F.concat_ws("/", "p_type", "p_brand").alias("ord"),
        F.struct(code.alias("id"), F.lit("").alias("name"),
                 F.get(tactics, (number % 13).cast("int")).alias("tactic")).alias("technique"))


@query
def coverage(spark, d):
    """F12."""
    return quality.coverage_layer(_part_rules(spark, d))


@query
def tactic_matrix(spark, d):
    """F13."""
    out = quality.tactic_matrix(_part_rules(spark, d))
    return out.select("tactic", "technique_id", "n", _long("position").alias("position"), F.round("shade", 6).alias("shade"))


@query
def rule_quality(spark, d):
    """every event is part of a test of some rule."""
    ids = [r["id"] for r in S.RULES[::4]] + ["R-9999"]
    t = telemetry(spark, d)
    named = F.get(F.array(*[F.lit(i) for i in ids]), F.pmod(F.col("seq"), F.lit(len(ids))).cast("int"))
    fixtures = t.withColumns({"name": F.concat_ws("/", named, (F.col("seq") % 50).cast("string")), "test_rule": named,
                              "expect": F.when(F.col("seq") % 2 == 0, "fire").otherwise("no-fire")})
    return quality.rule_quality(S.RULES, fixtures).select(
        "total", "passed", "false_positives", "false_negatives",
        F.round("false_positive_rate", 6).alias("false_positive_rate"), _joined("untested"))


@query
def value_histogram(spark, d):
    """F18 with a label."""
    h = metrics.histogram(table(spark, d, "events"), "value", S.VALUE_BOUNDS, "event_type")
    return h.select("label", F.coalesce(F.nullif("le", F.lit(float("inf"))), F.lit(-1.0)).alias("le"), "count", "total",
                    F.round("sum", 2).alias("sum"))


@query
def bucket_p95(spark, d):
    """F19."""
    h = metrics.histogram(table(spark, d, "events"), "value", S.VALUE_BOUNDS, "event_type")
    return metrics.bucket_quantile(h, 0.95).select("label", F.round("quantile", 6).alias("quantile"))


@query
def event_rate(spark, d):
    """F20."""
    out = metrics.rate(telemetry(spark, d), timedelta(hours=6))
    return out.select(micros("start").alias("start_us"), "n", F.round("per_second", 9).alias("per_second"))


@query
def alert_counter(spark, d):
    """F17."""
    return metrics.counter(_records(spark, d), "severity")


def _agents(spark, d):
    """Heartbeats: each event reports its host's running totals."""
    t = flat(spark, d)
    return t.select("host", F.timestamp_micros("us").alias("last_seen"), "seq", _long(F.floor("value")).alias("events_processed"),
                    F.col("k").alias("alerts"), (F.col("k") % 5).alias("incidents"))


@query
def latest_heartbeat(spark, d):
    """G4."""
    return ordered.latest(_agents(spark, d), ["host"], ["last_seen", "seq"]).select(
        "host", "seq", "events_processed", "alerts", "incidents")


@query
def fleet_tiles(spark, d):
    """F14."""
    agents = ordered.latest(_agents(spark, d), ["host"], ["last_seen", "seq"])
    return metrics.fleet_summary(agents, datetime(2024, 1, 31, tzinfo=timezone.utc), timedelta(hours=6))


@query
def recent_alerts(spark, d):
    """A bounded recent history."""
    return ordered.recent_history(_records(spark, d), 200, ts="time").select("seq")


# ---- lake and exports ----------------------------------------------------------------


@query
def lake_filter(spark, d):
    """A3: newest page of a filtered scan, a top-k report."""
    df = with_lake_columns(telemetry(spark, d))
    return lake_query(df, action="connect", since=T0, until=T1, contains="SSH", limit=30).select("seq", "host")


@query
def lake_ascending(spark, d):
    """A3, S2."""
    return lake_query(telemetry(spark, d), host="host-5", pid=40, limit=None, ascending=True).select("seq", "action")


@query
def lake_count(spark, d):
    """A4."""
    return telemetry(spark, d).agg(F.count("*").alias("n"))


@query
def retention(spark, d):
    """A5."""
    return retention_report(telemetry(spark, d), T0)


@query
def alert_retention(spark, d):
    """A5 for the alert history, whose time column is ``time``."""
    return retention_report(_records(spark, d), T0, "time")


@query
def alert_append(spark, d):
    """Alerts appended to a dated table in the shared folder, once more as by a replay, and read back without the doubles."""
    records, path = _written(spark, _records(spark, d)), f"{Shelf(spark).folder}/alerts"
    for _ in range(2):
        append_alerts(records, path)
    kept = spark.read.parquet(path).dropDuplicates(["id"])
    return kept.select("id", "seq", "rule_id", _long("risk_score").alias("risk_score"))


@query
def ecs_events(spark, d):
    """B7."""
    e = export.to_ecs_event(telemetry(spark, d))
    return e.select("seq", F.col("`@timestamp`").alias("stamp"), "event.action", _joined_or("event.category", "category"),
                    _joined_or("event.type", "type"), "process.executable", _long("process.parent.pid").alias("parent_pid"),
                    F.col("file.target_path").alias("target_path"), _long("destination.port").alias("port"),
                    F.col("dns.question.name").alias("question"), F.col("host.os.type").alias("os"))


def _joined_or(c, name):
    return F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ",").alias(name)


@query
def ecs_alerts(spark, d):
    """B8."""
    e = export.to_ecs_alert(_alerts(spark, d))
    return e.select("seq", "event.kind", F.col("edr.rule.id").alias("rule_id"), "edr.severity",
                    F.col("edr.threat.technique.tactic").alias("tactic"), _long("edr.risk_score").alias("risk_score"))


@query
def record_store(spark, d):
    """Incidents as record rows."""
    rows = record_rows(export.to_ecs_incident(_incidents(spark, d)), "incident")
    doc = lambda p: F.get_json_object("doc", p)
    return rows.select("kind", "ts", doc("$.edr.incident.id").alias("id"), doc("$.host.name").alias("host"),
                       doc("$.edr.incident.risk_score").alias("risk"), doc("$.edr.incident.techniques[0]").alias("first"))


@query
def ocsf_events(spark, d):
    """B9."""
    o = export.to_ocsf_event(telemetry(spark, d))
    return o.select("seq", F.col("time").alias("ms"), _long("category_uid").alias("category_uid"), "class_name",
                    _long("activity_id").alias("activity_id"), "activity_name", _long("type_uid").alias("type_uid"),
                    F.col("process.pid").alias("process_pid"), F.col("actor.process.pid").alias("actor_pid"),
                    F.col("file.name").alias("file_name"), "new_path", F.col("dst_endpoint.ip").alias("dst_ip"),
                    F.col("query.hostname").alias("hostname"))


@query
def ocsf_findings(spark, d):
    """B10."""
    o = export.to_ocsf_finding(_alerts(spark, d))
    return o.select("seq", F.col("finding_info.uid").alias("uid"), _long("severity_id").alias("severity_id"), "severity",
                    _long("type_uid").alias("type_uid"), F.col("attacks")[0]["technique"]["uid"].alias("technique"),
                    _long(F.col("evidences")[0]["type_uid"]).alias("evidence_type"), F.col("process.file.name").alias("file_name"))


@query
def flat_records(spark, d):
    """Alerts and incidents as fleet records."""
    alerts = _written(spark, _alerts(spark, d))
    both = export.flatten_alerts(alerts).unionByName(export.flatten_incidents(correlate.correlate(alerts, DAY)))
    return both.select("id", "hostname", micros("time").alias("us"), "rule_id", "severity", "technique_id", "pid",
                       "destination_ip", "risk_score", "is_incident")


@query
def pretty_lines(spark, d):
    """A8, B12."""
    lines = (export.pretty_event(telemetry(spark, d)).unionByName(export.pretty_alert(_alerts(spark, d)))
             .unionByName(export.pretty_incident(_incidents(spark, d))))
    return lines


# ---- audit ---------------------------------------------------------------------------


def _sealed(spark, d):
    """Audit logs of four entries each, sealed from events; some then altered."""
    f = flat(spark, d).select((F.floor(F.col("seq") / 4)).cast("long").alias("log"), (F.col("seq") % 4).alias("n"),
                              F.col("us").cast("string").alias("time"), F.col("name").alias("actor"), "action",
                              F.col("path").alias("target"), F.col("command_line").alias("detail"))
    entry = F.struct("time", "actor", "action", "target", "detail")
    wide = f.groupBy("log").agg(*[F.max(F.when(F.col("n") == i, entry)).alias(f"e{i}") for i in range(4)])
    prev = F.lit("")
    for i in range(4):
        parts = [F.lit(str(i + 1)), *[F.coalesce(F.col(f"e{i}.{c}"), F.lit("")) for c in
                                      ("time", "actor", "action", "target", "detail")], prev]
        wide = wide.withColumn(f"h{i}", F.sha2(F.concat_ws("\x1f", *parts), 256))
        prev = F.col(f"h{i}")
    rows = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("seq"), F.col(f"e{i}").alias("e"),
                              (F.lit("") if i == 0 else F.col(f"h{i - 1}")).alias("prev_hash"), F.col(f"h{i}").alias("hash"))
                     for i in range(4)])
    log = wide.select("log", F.explode(rows).alias("r")).select("log", "r.seq", "r.e.*", "r.prev_hash", "r.hash") \
        .filter("time is not null")
    second = F.col("seq") == 2
    return log.withColumns({
        "detail": F.when(second & (F.col("log") % 7 == 3), "altered").otherwise(F.col("detail")),
        "prev_hash": F.when(second & (F.col("log") % 11 == 5), "").otherwise(F.col("prev_hash"))}) \
        .filter(~((F.col("seq") == 3) & (F.col("log") % 13 == 1)))


@query
def audit_chain(spark, d):
    """K1."""
    return audit.verify_chain(_sealed(spark, d)).select(
        "log", "entries", "valid", F.coalesce("bad_seq", F.lit(0)).alias("bad_seq"),
        F.coalesce("problem", F.lit("")).alias("problem"))
