import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import anomaly, content, enrich, export
from duskwatch.rules import builtin_rules
from duskwatch.sources import events, indicators, lake, sinks
from duskwatch.sources.content import read_content


@pytest.fixture(scope="module")
def three(make):
    return make([{"action": "exec", "host": "mill", "at": 0, "process.pid": 41, "process.name": "a%b"},
                 {"action": "exec", "host": "mill", "at": 60, "process.pid": 58},
                 {"action": "connect", "host": "barn", "at": 120, "process.pid": 77, "network.domain": "evil.example"}])


def at(second):
    return datetime(2024, 5, 1, 0, second // 60, second % 60, tzinfo=timezone.utc)


def test_lake_round_trip(spark, three, tmp_path):
    path = str(tmp_path / "lake")
    lake.write_lake(three, path)
    df = lake.read_lake(spark, path)
    n = lambda **k: lake.lake_query(df, **k).count()
    assert df.count() == 3 and n(action="exec") == 2 and n(host="barn") == 1 and n(pid=58) == 1
    assert n(since=at(30), until=at(90)) == 1 and n(since=at(60), until=at(60)) == 1
    assert n(contains="EVIL") == 1 and n(limit=1) == 1 and n(contains="%") == 1
    assert [r.seq for r in lake.lake_query(df).collect()] == [2, 1, 0]
    assert [r.seq for r in lake.lake_query(df, ascending=True).collect()] == [0, 1, 2]
    plan = lake.lake_query(df, action="exec", since=at(30))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(action" in plan and "PushedFilters: [IsNotNull(ts)" in plan
    assert lake.prune(df, at(90)).count() == 1 and lake.prune(df.withColumnRenamed("ts", "time"), at(90), "time").count() == 1
    assert lake.retention_report(df, at(90)).collect()[0].asDict() == {"kept": 1, "first_seq": 2, "pruned": 2}
    assert lake.prune_lake(spark, path, at(90)) == 2
    assert [r.seq for r in lake.read_lake(spark, path).collect()] == [2]


def test_recorded_events(spark, tmp_path):
    path = tmp_path / "e.ndjson"
    path.write_text('{"@timestamp":"2026-01-01T00:00:00.123456789Z","action":"exec","process":{"pid":7,"name":"x"},"extra":1}\n\n')
    (row,) = events.read_events(spark, str(path)).collect()
    assert row.action == "exec" and row.event_type == 1 and row.schema_version == "1.0" and row.process.pid == 7
    assert row.ts.microsecond == 123456
    path.write_text('{"action":"exec"}\n{broken\n')
    with pytest.raises(Exception):
        events.read_events(spark, str(path)).collect()


def test_ndjson_and_records(spark, three, tmp_path):
    ecs = export.to_ecs_event(three)
    sinks.write_ndjson(ecs, str(tmp_path / "out"), max_records=1)
    docs = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert len(docs) == 3 and all("file" not in d and d["event"]["kind"] == "event" for d in docs)
    assert {d["dns"]["question"]["name"] for d in docs if "dns" in d} == {"evil.example"}
    sinks.write_records(ecs, "event", str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).filter("kind = 'event'").count() == 3


def test_fan_out_joins_errors(three):
    seen = []

    def broken(_):
        raise ValueError("down")

    with pytest.raises(ExceptionGroup) as info:
        sinks.fan_out(three, [broken, lambda df: seen.append(df.count()), broken])
    assert seen == [3] and len(info.value.exceptions) == 2


def test_indicator_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# feed\n198.51.100.7\n10.0.0.0/8 # net\nBad.Example\n" + "AB" * 32 + "\n1/2/3\n2001:db8::1\n")
    rows = indicators.read_indicators(spark, [str(tmp_path / "a.txt")]).orderBy("ord").collect()
    assert [(r.type, r.value) for r in rows] == [("ip", "198.51.100.7"), ("cidr", "10.0.0.0/8"), ("domain", "bad.example"),
                                                 ("hash", "ab" * 32), ("ip", "2001:db8::1")]
    assert {r.source for r in rows} == {"a.txt"}


def test_content_sources_and_signatures(spark, make, tmp_path):
    import hashlib

    files = {"eicar": b"xEICAR-STANDARD-ANTIVIRUS-TEST-FILEx", "miner": b"XMRIG --donate-level 1\xff", "one": b"xmrig",
             "shell": b"/bin/sh -i socket dup2", "php": b"<?php SYSTEM($_GET[0]);", "empty": b"", "bin": b"\x00MZ\n\x90\x00\xff"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    scanned = content.scan_content(read_content(spark, str(tmp_path)), "content", content.builtin_signatures() + [
        {"name": "mz", "strings": {"h": {"hex": "4D 5A ?? 90"}}, "condition": "h"},
        {"name": "not_mz", "strings": {"h": {"hex": "5A4D"}, "i": {"hex": "4D5A"}}, "condition": {"all": [{"not": "h"}, "i"]}}])
    got = {r.path.rsplit("/", 1)[1]: r.matches for r in scanned.collect()}
    assert got == {"eicar": ["EICAR_Test_File"], "miner": ["Linux_CoinMiner"], "one": None, "shell": ["Linux_Reverse_Shell_Binary"],
                   "php": ["PHP_Webshell"], "bin": ["mz", "not_mz"]}
    df = make([{"action": "exec", "process.executable": str(tmp_path / "eicar")}, {"action": "open", "process.executable": str(tmp_path / "eicar")},
               {"action": "exec", "process.executable": "/none"}])
    enriched = enrich.with_signatures(enrich.with_hash(df, read_content(spark, str(tmp_path))), scanned)
    rows = {r.seq: r.process for r in enriched.collect()}
    assert rows[0].sha256 == hashlib.sha256(files["eicar"]).hexdigest() and rows[0].yara_matches == ["EICAR_Test_File"]
    assert rows[1].yara_matches is None and rows[2].yara_matches is None
    capped = {r.path.rsplit("/", 1)[1]: r.content for r in read_content(spark, str(tmp_path), 10).collect()}
    assert {n for n, c in capped.items() if c is not None} == {"one", "bin"} and len(capped) == len(files) - 1
    from duskwatch.operators.detect import detect

    hit = detect(enriched, builtin_rules()).selectExpr("seq", "rule.id").filter("id = 'R-0073'")
    assert [r.seq for r in hit.collect()] == [0]


def test_context_lookups(spark, make):
    df = make([{"action": "exec", "user.id": 0}, {"action": "exec", "user.id": 5}, {"action": "exec", "user.id": 0, "user.name": "kept"}])
    users = spark.createDataFrame([(0, "root")], "uid long, user_name string")
    assert [r.n for r in enrich.with_user(df, users).orderBy("seq").selectExpr("user.name n").collect()] == ["root", "", "kept"]
    paths = ["/docker/" + "a" * 64, "/kubepods/crio-" + "b" * 64, "/user.slice", "/libpod-" + "c" * 32 + "/x", "/x/" + "d" * 32]
    grp = spark.createDataFrame(enumerate(paths), "seq long, cgroup string").join(make([{"action": "exec"}] * 5), "seq")
    got = [(r.i and r.i[0], r.r) for r in enrich.with_container(grp).orderBy("seq").selectExpr("container.id i", "container.runtime r").collect()]
    assert got == [("a", "docker"), ("b", "cri-o"), (None, None), ("c", "podman"), ("d", "")]


def test_rarity_and_forest(spark, make, tmp_path):
    rows = [{"action": "exec", "process.name": "bash", "process.executable": "/bin/bash" if i % 2 else "/usr/bin/bash", "user.id": i % 7,
             "process.command_line": "a" * (i % 30), "network.dst_port": 440 + i % 9, "at": i * 200} for i in range(400)]
    odd = {"action": "exec", "process.name": "zzzzqqqq1234xyz", "process.executable": "/a/b/c/d/e/f/g", "user.id": 60000,
           "process.command_line": "x" * 900, "network.dst_port": 60001}
    df = make(rows)
    baseline, forest = anomaly.build_baseline(df), anomaly.fit_iforest(df, trees=40, sample=64, seed=3)
    anomaly.save_model(baseline, forest, str(tmp_path / "m"))
    baseline, forest = anomaly.load_model(spark, str(tmp_path / "m"))
    probe = make([rows[200], odd, {"action": "exit"}])
    got = [r.anomaly_score for r in anomaly.score(probe, baseline, None).orderBy("seq").collect()]
    assert got[0] == pytest.approx(1 / (1 + __import__("math").log2(45 + 1)), abs=0.05) and got[1:] == [1.0, 0.0]
    structural = [r.structural for r in anomaly.score_iforest(probe, forest).orderBy("seq").collect()]
    assert 0 <= structural[0] < structural[1] <= 1
    again = anomaly.fit_iforest(df, trees=40, sample=64, seed=3)
    assert again.exceptAll(forest).isEmpty() and forest.groupBy("tree_id").count().count() == 40
    assert forest.filter("node_id = 0").agg(F.max("size")).collect()[0][0] == 64
