"""Stateful streaming operators: incidents, fleet signals, process tree.

Each is keyed, keeps only what its next row needs, and lets a timer on event time drop
state once the watermark passes the key's window.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.correlate import MIN_HOSTS, SIGNAL_WINDOW, THRESHOLD, WINDOW, fired_events
from ..operators.ordered import width_us
from ..schema import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State store needed by the operators of this module."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch (bounded by the source's rate limit) in event order."""
    return pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")


def _expire(processor, expired, from_us: int) -> None:
    """Drop a key whose window is over; its one timer moves on where later rows moved the window."""
    end_ms = (int(from_us) + processor.window_us) // 1000 + 1
    if end_ms > expired.getExpiryTimeInMs():
        processor.handle.registerTimer(end_ms)
    else:
        processor.state.clear()


INCIDENT = ("host string, process_key string, us long, seq long, first_us long, risk_score long, "
            "techniques array<string>, rule_ids array<string>, name string, pid long")
#: Keys share state by hash: a call to the state store costs far more than a session does.
BUCKETS = 1024
SESSIONS = ("hosts array<string>, keys array<string>, scores array<long>, firsts array<long>, lasts array<long>, "
            "opened array<boolean>, techniques array<array<string>>, rule_ids array<array<string>>")


class _Incidents(StatefulProcessor):
    def __init__(self, window_us: int, threshold: int, facts: list[tuple[str, str]]):
        self.window_us, self.threshold, self.facts = window_us, threshold, facts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # All open sessions of a bucket as one value: one read and one write a batch, not one a process.
        self.state = handle.getValueState("sessions", SESSIONS)

    def _end_ms(self, session: list) -> int:
        return (session[2] + self.window_us) // 1000 + 1

    def _hold(self, sessions: dict, timer: bool) -> None:
        """Store the sessions; ``timer`` if the bucket has none, which is for the first that ends."""
        if not sessions:
            return self.state.clear()
        if timer:
            self.handle.registerTimer(min(map(self._end_ms, sessions.values())))
        hosts, keys = zip(*sessions)
        self.state.update((list(hosts), list(keys), *(list(c) for c in zip(*sessions.values()))))

    def _held(self) -> dict | None:
        stored = self.state.get()
        return {(host, key): values for host, key, *values in zip(*stored)} if stored else None

    def handleInputRows(self, key, rows, timerValues):
        batch, out = _in_order(rows), []
        held = self._held()
        sessions = held or {}
        columns = ("host", "process_key", "us", "seq", "risk", "ords", "name", "pid")
        for host, process, us, seq, risk, ords, name, pid in zip(*(batch[c].tolist() for c in columns)):
            session = sessions.get((host, process))
            if session is None or us - session[2] > self.window_us:
                session = sessions[host, process] = [0, us, us, False, [], []]
            session[2] = us
            # What comes after the incident only keeps the session going.
            if session[3]:
                continue
            session[0] += risk
            techniques, rules = session[4], session[5]
            for rule, technique in (self.facts[i] for i in ords):
                if technique and technique not in techniques:
                    techniques.append(technique)
                if rule not in rules:
                    rules.append(rule)
            if session[0] >= self.threshold:
                out.append((host, process, us, seq, session[1], session[0], sorted(techniques), rules, name, pid))
                session[3:] = [True, [], []]
        self._hold(sessions, held is None)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in INCIDENT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        self._hold({k: s for k, s in (self._held() or {}).items() if self._end_ms(s) > now}, True)
        yield pd.DataFrame([], columns=[c.split()[0] for c in INCIDENT.split(", ")])

    def close(self) -> None:
        pass


def stream_incidents(events: DataFrame, rules: list[dict], window: timedelta = WINDOW, threshold: int = THRESHOLD,
                     delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """Incidents emitted at the event that crosses the threshold.

    The open sessions of one of ``buckets`` hash groups of processes, and its rows of a micro-batch, fit one task.
    """
    risky = fired_events(events.withWatermark("ts", delay), rules)
    rows = risky.withColumns({"ords": F.transform("fired", lambda f: f["ord"]),
                              "bucket": F.pmod(F.xxhash64("host", "process_key"), F.lit(buckets))}).drop("fired")
    facts = [(r["id"], r["technique"]["id"]) for r in rules]
    return (rows.groupBy("bucket").transformWithStateInPandas(
        _Incidents(width_us(window), threshold, facts), INCIDENT,
        "Append", "EventTime"))


SIGNAL = "kind string, key string, hosts array<string>, first_us long, last_us long, seq long"


class _Signals(StatefulProcessor):
    def __init__(self, window_us: int, min_hosts: int):
        self.window_us, self.min_hosts = window_us, min_hosts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # At most ``min_hosts`` hosts are ever held: past that the window has fired.
        self.state = handle.getValueState("window", "first_us long, fired boolean, hosts array<string>, seen array<long>")

    def handleInputRows(self, key, rows, timerValues):
        batch, out = _in_order(rows), []
        first, fired, hosts = None, False, {}
        held = self.state.get()
        if held:
            first, fired, names, seen = held
            hosts = dict(zip(names, seen))
        for row in batch.itertuples(index=False):
            if first is None or row.us - first > self.window_us:
                first, fired, hosts = row.us, False, {}
            if fired:
                continue
            hosts[row.host] = row.us
            hosts = {h: s for h, s in hosts.items() if row.us - s <= self.window_us}
            if len(hosts) >= self.min_hosts:
                fired = True
                out.append((key[0], key[1], sorted(hosts), first, row.us, row.seq))
        self.state.update((int(first), fired, list(hosts), [int(s) for s in hosts.values()]))
        if held is None:
            self.handle.registerTimer((int(first) + self.window_us) // 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGNAL.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        _expire(self, expiredTimerInfo, self.state.get()[0])
        yield pd.DataFrame([], columns=[c.split()[0] for c in SIGNAL.split(", ")])

    def close(self) -> None:
        pass


def stream_signals(records: DataFrame, window: timedelta = SIGNAL_WINDOW, min_hosts: int = MIN_HOSTS,
                   delay: str = "1 minute") -> DataFrame:
    """Fleet signals from a stream of alert records."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    pairs = F.array(F.struct(F.lit("lateral-movement").alias("kind"), some("technique_id").alias("key")),
                    F.struct(F.lit("c2-fanin").alias("kind"), some("destination_ip").alias("key")))
    seen = (records.withWatermark("time", delay)
            .select("time", "hostname", "seq", F.explode(pairs).alias("p"))
            .select("time", "p.kind", "p.key", F.coalesce("hostname", F.lit("")).alias("host"),
                    micros("time").alias("us"), "seq")
            .filter("key is not null"))
    return seen.groupBy("kind", "key").transformWithStateInPandas(
        _Signals(width_us(window), min_hosts), SIGNAL, "Append", "EventTime")


TREE = ("host string, us long, seq long, pid long, parent_name string, parent_executable string, "
        "start_time_ns long, ancestors array<string>")


TABLE = ("pids array<long>, ppids array<long>, names array<string>, executables array<string>, starts array<long>, "
         "used array<long>")


class _ProcessTree(StatefulProcessor):
    def __init__(self, depth: int | None, keep_us: int | None):
        self.depth, self.keep_us = depth, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        # A host's whole table as one value: one read and one write a batch, not one a process.
        self.live = handle.getValueState("live", TABLE)

    def handleInputRows(self, key, rows, timerValues):
        stored, out = self.live.get(), []
        table = {pid: entry for pid, *entry in zip(*stored)} if stored else {}
        batch = _in_order(rows)

        def entry(pid, us):
            found = table.get(pid)
            if found:
                found[4] = max(found[4], us)
            return found

        for row in batch.itertuples(index=False):
            if row.action in ("exec", "exec_blocked", "fork"):
                executable = row.executable if row.action != "fork" else ""
                table[row.pid] = [row.ppid, row.name, executable, row.start, row.us]
            elif row.action == "exit":
                table.pop(row.pid, None)
            parent, own = entry(row.ppid, row.us), entry(row.pid, row.us)
            chain, current, passed = [], row.ppid, {0, row.pid}
            while current not in passed and (self.depth is None or len(chain) < self.depth):
                passed.add(current)
                info = entry(current, row.us)
                if info is None:
                    break
                chain.append(info[1])
                current = info[0]
            out.append((key[0], row.us, row.seq, row.pid, parent[1] if parent else row.parent_name,
                        parent[2] if parent else row.parent_executable,
                        own[3] if own and row.start == 0 else row.start, chain or None))
        if self.keep_us is not None:
            newest = max((e[4] for e in table.values()), default=0)
            table = {pid: e for pid, e in table.items() if newest - e[4] <= self.keep_us}
        columns = zip(*[(pid, *e) for pid, e in table.items()]) if table else [()] * 6
        self.live.update(tuple([v.item() if hasattr(v, "item") else v for v in c] for c in columns))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TREE.split(", ")])

    def close(self) -> None:
        pass


def stream_process_tree(events: DataFrame, depth: int | None = None, keep: timedelta | None = None) -> DataFrame:
    """Parent, start time and ancestry of each event as it arrives, keyed by host.

    With ``keep``, a process that no event has named for that long before the newest use of its
    host's table, as itself or as an ancestor, is forgotten at the end of a batch, so lost exits do
    not grow the state. Without it every process stays until its exit.

    A host's events must be seen in order by one owner of its process table; the batch
    form (``operators.enrich``) has no such limit.
    """
    text = lambda p: F.coalesce(F.col(p), F.lit(""))
    number = lambda p: F.coalesce(F.col(p), F.lit(0)).cast("long")
    rows = events.select(
        F.coalesce("host", F.lit("")).alias("host"), micros("ts").alias("us"), "seq", "action",
        number("process.pid").alias("pid"), number("process.ppid").alias("ppid"), text("process.name").alias("name"),
        text("process.executable").alias("executable"), number("process.start_time_ns").alias("start"),
        text("process.parent_name").alias("parent_name"), text("process.parent_executable").alias("parent_executable"))
    keep_us = None if keep is None else width_us(keep)
    return rows.groupBy("host").transformWithStateInPandas(_ProcessTree(depth, keep_us), TREE, "Append", "None")
