"""The queries of the live path as DuckDB SQL: what the whole tables give without a stream."""

from __future__ import annotations

from . import live
from .oracle import _LIFE, _PARENT_CTE, ALERTS, INCIDENTS, RECORDS, T0, TEL, _levels, build

DAY_US = 86_400_000_000


def _ids(rules: list[dict]) -> str:
    return ", ".join(f"'{r['id']}'" for r in rules)


def _slices(count: int) -> str:
    """The slice of each event by its number."""
    return (f"bounds AS (SELECT min(seq) AS low, max(seq) AS high FROM tel), "
            f"sliced AS (SELECT tel.*, least({count - 1}, ((seq - low) * {count}) // (high - low + 1)) AS n FROM tel, bounds)")


def live_oracle() -> dict[str, str]:
    batch, last = build(), live.ARRIVALS - 1
    chains = " UNION ALL ".join(f"SELECT host, seq, chain FROM l{i}" for i in range(1, 17))
    return {
        "streamed_incidents": f"WITH {INCIDENTS} SELECT host, process_key, seq, risk_score, first_us, last_us, techniques, rule_ids FROM incidents",
        "streamed_signals": f"SELECT kind, key, hosts, first_us, last_us FROM ({batch['fleet_signals']})",
        "streamed_process_tree": (
            f"WITH {_PARENT_CTE},{_levels(16)}, chains AS (SELECT host, seq, arg_max(chain, length(chain)) AS chain FROM ({chains}) GROUP BY ALL) "
            "SELECT t.seq, coalesce(p.pname, '') AS parent_name, coalesce(p.pexe, '') AS parent_executable, t.start_ns AS start_time_ns, "
            "coalesce(c.chain, '') AS chain FROM tel t LEFT JOIN parent p USING (seq) LEFT JOIN chains c ON c.host = t.host AND c.seq = t.seq"),
        "late_split": (
            f"WITH {TEL}, {_slices(live.ARRIVALS)}, arrived AS (SELECT seq, host, us, least({last}, n + CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END) AS n FROM sliced), "
            "tops AS (SELECT n, max(us) AS top FROM arrived GROUP BY n), "
            "marks AS (SELECT n, max(top) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tops) "
            f"SELECT seq, host, coalesce(us < top - {DAY_US}, false) AS late FROM arrived JOIN marks USING (n)"),
        "append_replays": f"WITH {TEL} SELECT seq, host, action, us FROM tel",
        "rule_swap": (f"WITH {ALERTS}, {_slices(live.SLICES)} SELECT a.seq, a.rule_id, a.host FROM alerts a JOIN sliced s USING (seq) "
                      f"WHERE CASE WHEN s.n = 0 THEN a.rule_id IN ({_ids(live.RULES_BEFORE)}) ELSE a.rule_id IN ({_ids(live.RULES_AFTER)}) END"),
        "replayed_alerts": f"WITH {RECORDS} SELECT id, rule_id, hostname AS host, risk_score FROM records",
        "recorded_events": f"WITH {TEL} SELECT us, host, action, pid, command_line, user_name, domain, path, dst_port, stdio_socket FROM tel",
        "lake_retained": f"WITH {TEL} SELECT seq, host, action, us FROM tel WHERE us >= {T0}",
        "fan_out_sinks": f"WITH {RECORDS} SELECT sink, seq, rule_id FROM records, (VALUES ('{live.SINKS[0]}'), ('{live.SINKS[1]}')) AS s(sink)",
        "alert_found": f"WITH {RECORDS} SELECT id, seq, rule_id, hostname AS host FROM records WHERE id = (SELECT min(id) FROM records)",
        "saved_model_scores": batch["rarity_score"],
    }
