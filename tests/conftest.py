import os
import sys
from datetime import timedelta

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from event_helpers import BASE, SPARSE  # noqa: E402

from duskwatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from duskwatch.streaming.stateful import use_rocksdb

    session = local_session("8", "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    use_rocksdb(session)
    return session


@pytest.fixture(scope="session")
def make(spark):
    """Events from dicts with dotted keys; ``at`` is seconds after a fixed time."""
    from duskwatch.sources.events import event_frame

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            pick = lambda prefix, names: tuple(row.get(f"{prefix}.{n}") for n in names)
            out.append((row.get("seq", i), BASE + timedelta(seconds=row.get("at", i)), row.get("host"), row.get("action"),
                        pick("process", ("pid", "ppid", "name", "executable", "command_line", "start_time_ns",
                                         "stdio_socket", "parent_name", "sha256")),
                        pick("user", ("id", "name")), pick("file", ("path", "target", "mode")),
                        pick("network", ("src_ip", "dst_ip", "dst_port", "domain")),
                        pick("syscall", ("request", "new_uid"))))
        return event_frame(spark.createDataFrame(out, SPARSE))

    return build
