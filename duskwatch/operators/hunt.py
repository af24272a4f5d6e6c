"""Hunting: filtered search, ordered sequences, promotion of a hunt to a rule."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field
from ..functions.predicates import HUNT_OPS, check_tree, event_class, hunt_predicate
from ..schema import micros
from ..session import materialize
from .ordered import BUCKET, nearest, newest_first, time_bucket, width_us


def _as_filter(where) -> Column:
    if where is None:
        return F.lit(True)
    if isinstance(where, dict):
        return hunt_predicate(where)
    return F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))


def hunt(df: DataFrame, cls: str = "any", *where, limit: int | None = None) -> DataFrame:
    """Events of a class passing every filter, newest first.

    A filter is a Column, a Spark SQL predicate or a condition tree.
    """
    rows = df.filter(event_class(cls))
    for part in where:
        rows = rows.filter(_as_filter(part))
    return newest_first(rows, limit if limit and limit > 0 else None)


def _stages(stages: list[tuple]) -> list[Column]:
    if len(stages) < 2:
        raise ValueError("a sequence needs at least two stages")
    return [event_class(s[0]) & _as_filter(s[1] if len(s) > 1 else None) for s in stages]


def sequence(df: DataFrame, stages: list[tuple], by: str | None = None,
             within: timedelta | None = None, bucket: timedelta = BUCKET) -> DataFrame:
    """One row per stage-0 event whose chain of earliest later matches completes.

    Columns ``e0 .. en`` hold the chain's events.  Only events matching some stage are
    shuffled.  Each stage is an exact two-level "next match" scan over time buckets, so a hot key
    (or the one global group) spreads over time; ``within`` then keeps the chains that end in
    time, since no later match ends earlier than the earliest.
    """
    tests = _stages(stages)
    n = len(tests)
    key = F.lit("") if by is None else field(by).cast("string")
    event = F.struct(*[F.col(c) for c in df.columns])
    rows = (df.withColumns({f"_s{i}": t for i, t in enumerate(tests)})
            .filter(reduce(lambda a, b: a | b, [F.col(f"_s{i}") for i in range(n)]))
            .select(key.alias("key"), "ts", "seq", event.alias("_event"), *[f"_s{i}" for i in range(n)])
            .filter("key is not null"))
    found = _chained(rows, n, bucket)
    if within is not None:
        found = found.filter(micros(F.col(_end(n))) - micros("ts") <= width_us(within))
    chain, node = [F.col("_event").alias("e0")], "_next1"
    for i in range(1, n):
        chain.append(F.col(f"{node}.event").alias(f"e{i}"))
        node += ".rest"
    return found.select("key", *chain)


def _link(k: int, n: int) -> Column:
    """What a stage-k match hands to earlier rows: itself and the rest of the chain."""
    parts = [F.col("ts").alias("ts"), F.col("_event").alias("event")]
    ready = F.col(f"_s{k}")
    if k < n - 1:
        parts.append(F.col(f"_next{k + 1}").alias("rest"))
        ready = ready & F.col(f"_next{k + 1}").isNotNull()
    return F.when(ready, F.struct(*parts))


def _end(n: int) -> str:
    return "_next1" + ".rest" * (n - 2) + ".ts"


def _chained(rows: DataFrame, n: int, bucket: timedelta) -> DataFrame:
    """Stage by stage from the last, the next match of every row. A stage reads its rows twice (scan and bucket
    summary), so they are written before it: n stages read n times, not twice for every stage above."""
    for k in range(n - 1, 0, -1):
        rows = nearest(materialize(rows), ["key"], ["ts", "seq"], _link(k, n), f"_next{k}", time_bucket(bucket),
                       forward=True)
    return rows.filter(F.col("_s0") & F.col("_next1").isNotNull())


# Hunt operator -> rule operator.
TO_RULE = {"==": "eq", "!=": "ne", ">": "gt", "<": "lt", ">=": "ge", "<=": "le", "=~": "regex",
           "contains": "contains", "startswith": "startswith", "endswith": "endswith", "in": "in"}


def _whole(op: str, value):
    """Numbers of a hunt may have a fraction, those of a rule may not."""
    if op in ("gt", "lt", "ge", "le") and isinstance(value, float):
        if not value.is_integer():
            raise ValueError(f"{value} has a fraction, which no rule can compare with")
        return int(value)
    return value


def rule_tree(node: dict) -> dict:
    """A hunt's condition tree in the operators of rules."""
    if "op" not in node:
        return {kind: rule_tree(part) if kind == "not" else [rule_tree(p) for p in part] for kind, part in node.items() if part is not None}
    name, op = node["field"], TO_RULE[node["op"]]
    leaf = {"field": name, "op": op, "value": _whole(op, node.get("value"))}
    # Where the field is absent a hunt's != fails and a rule's ne holds.
    return {"all": [{"field": name, "op": "exists"}, leaf]} if op == "ne" else leaf


def promote(cls: str, filters: list[dict], meta: dict) -> dict:
    """A hunt (class plus filter trees) as a rule dict that selects the same events."""
    if not (meta.get("id") and meta.get("name")):
        raise ValueError("give the new rule an id and a name")
    for tree in filters:
        check_tree(tree, HUNT_OPS)
    of_class = {} if cls in ("any", "event") else {"field": "event.type", "op": "eq", "value": cls}
    parts = [p for p in (of_class, *map(rule_tree, filters)) if p] or [{"field": "event.action", "op": "exists"}]
    return {**meta, "match": parts[0] if len(parts) == 1 else {"all": parts}}
