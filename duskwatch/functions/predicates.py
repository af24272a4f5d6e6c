"""Condition trees lowered to two-valued Spark columns, in two dialects.

A tree is ``{"all": [..]}``, ``{"any": [..]}``, ``{"not": ..}`` or a leaf
``{"field": .., "op": .., "value": ..}``.  The dialects differ on absent fields:
a rule's ``ne`` / ``not_in`` is true there, a hunt's ``!=`` is false.
"""

from __future__ import annotations

import functools
import re
import re._parser as _sre
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fields import FIELDS, field, field_kind, plain_text
from .ip import in_network, parse_network

RULE_OPS = ("exists", "eq", "ne", "in", "not_in", "contains", "startswith", "endswith",
            "regex", "gt", "lt", "ge", "le", "cidr")
HUNT_OPS = ("==", "!=", ">", "<", ">=", "<=", "contains", "startswith", "endswith", "=~", "in")
TRUE_WORDS = ("1", "t", "T", "TRUE", "true", "True")
FALSE_WORDS = ("0", "f", "F", "FALSE", "false", "False")
NUMBER = r"\A[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def always(value: bool) -> Column:
    return F.lit(value)


def all_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def any_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def java_regex(pattern: str) -> str:
    """Spell an RE2 pattern for Java: end-of-text ``$``, ``\\s`` without \\v, ``.`` stops at \\n only."""
    space = r"\t\n\f\r "
    out, in_class, i = [], False, 0
    while i < len(pattern):
        ch, pair = pattern[i], pattern[i:i + 2]
        if pair == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif pair == r"\S" and not in_class:
            out.append(f"[^{space}]")
        elif ch == "\\":
            out.append(pair)
        elif ch == "$" and not in_class and "(?m" not in pattern:
            out.append(r"\z")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        else:
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "[" and in_class:
                ch = r"\["
            elif ch == "]" and in_class and i > 0 and pattern[i - 1] != "[" and pattern[i - 2:i] != "[^":
                in_class = False
            out.append(ch)
            i += 1
            continue
        i += 2 if ch == "\\" else 1
    try:
        re.compile(pattern.replace(r"\z", r"\Z"))
    except re.error as error:
        raise ValueError(f"invalid regex {pattern!r}: {error}") from error
    return "(?d)" + "".join(out)


#: A regex is guarded by its literals only if they are this few.
GUARDS = 12


@functools.lru_cache(maxsize=4096)
def required_literals(pattern: str) -> tuple[str, ...] | None:
    """Literals of which every match of the pattern contains one; None where none are known.

    Letters that follow one another, also across word and line edges, form a literal; of the parts of a
    sequence the one with the longest literals is taken, and alternatives need one of each.
    """
    try:
        tree = _sre.parse(pattern)
    except (re.error, OverflowError):
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    found = _literals(tree)
    found = found and {x for x in found if not any(y in x for y in found - {x})}
    return tuple(sorted(found)) if found and len(found) <= GUARDS and min(map(len, found)) > 1 else None


def _literals(sequence) -> set[str] | None:
    options, run = [], ""
    for op, value in [*sequence, (None, None)]:
        if op is _sre.LITERAL:
            run += chr(value)
            continue
        if op is _sre.AT:
            continue
        if run:
            options.append({run})
            run = ""
        if op is _sre.SUBPATTERN and not value[1] & re.IGNORECASE:
            options.append(_literals(value[3]))
        elif op is _sre.BRANCH:
            parts = [_literals(p) for p in value[1]]
            options.append(set().union(*parts) if all(parts) else None)
        elif op in (_sre.MAX_REPEAT, _sre.MIN_REPEAT) and value[0] >= 1:
            options.append(_literals(value[2]))
    return max((o for o in options if o), key=lambda o: (min(map(len, o)), -len(o)), default=None)


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _as_text(value: Any) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _as_int(value: Any) -> int | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return int(value)
    if isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value):
        return int(value)
    return None


def _as_bool(value: Any) -> bool | None:
    if isinstance(value, bool):
        return value
    return True if value in TRUE_WORDS else False if value in FALSE_WORDS else None


def coerced(kind: str, value: Any) -> Any:
    """The value as one of the field's kind, None where it is none."""
    return {"string": _as_text, "long": _as_int, "bool": _as_bool}[kind](value)


def _equals(column: Column, kind: str, value: Any) -> Column:
    """Typed equality after coercing the wanted value; what cannot coerce never equals."""
    want = coerced(kind, value)
    return F.lit(False) if want is None else column == F.lit(want)


def _false_on_empty(op: str, value: Any) -> bool:
    """Whether a text test is false on the empty string by itself."""
    if op == "in":
        return all(_as_text(v) != "" for v in value)
    return op in ("eq", "contains", "startswith", "endswith") and _as_text(value) != ""


def _rule_leaf(name: str, op: str, value: Any) -> Column:
    kind, stored, absent = field_kind(name), plain_text(name), False
    listed = op != "in" or isinstance(value, (list, tuple))
    column = stored if stored is not None and (op == "regex" or listed and _false_on_empty(op, value)) else field(name)
    if op == "exists":
        test = column.isNotNull()
    elif op in ("eq", "ne"):
        test = _equals(column, kind, value)
    elif op in ("in", "not_in"):
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"operator {op} needs a list value")
        coerce = {"string": _as_text, "long": _as_int, "bool": _as_bool}[kind]
        wanted = [w for w in map(coerce, value) if w is not None]
        test = column.isin(wanted) if wanted else F.lit(False)
    elif op in ("contains", "startswith", "endswith"):
        test = getattr(column, op)(F.lit(_as_text(value))) if kind == "string" else F.lit(False)
    elif op == "regex":
        pattern = java_regex(_as_text(value))
        if stored is not None:
            literals = required_literals(_as_text(value))
            held = F.expr(" OR ".join(f"contains({FIELDS[name][1]}, {quoted(x)})" for x in literals)) if literals else stored != ""
            test = held & stored.rlike(pattern)
        else:
            test = column.rlike(pattern) if kind == "string" else F.lit(False)
    elif op in ("gt", "lt", "ge", "le"):
        want = _as_int(value)
        if want is None:
            raise ValueError(f"operator {op} needs a numeric value")
        compare = {"gt": column.__gt__, "lt": column.__lt__, "ge": column.__ge__, "le": column.__le__}[op]
        test = compare(F.lit(want)) if kind == "long" else F.lit(False)
    elif op == "cidr":
        parse_network(_as_text(value))
        test = in_network(column, _as_text(value)) if kind == "string" else F.lit(False)
    else:
        raise ValueError(f"unknown operator {op!r}")
    if op in ("ne", "not_in"):
        test, absent = (~test) | column.isNull(), True
    return F.coalesce(test, F.lit(absent))


def _number_of(column: Column, kind: str) -> Column | None:
    if kind == "long":
        return column.cast("double")
    if kind == "string":
        return F.when(column.rlike(NUMBER), column).try_cast("double")
    return None


def _hunt_number(value: Any) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    return float(value) if isinstance(value, str) and re.fullmatch(NUMBER[2:-2], value) else None


def _hunt_text(value: Any) -> str:
    if isinstance(value, float) and value == int(value):
        value = int(value)
    return _as_text(value)


def _hunt_equals(column: Column, kind: str, value: Any) -> Column:
    if kind == "long":
        number = _hunt_number(value)
        return F.lit(False) if number is None else column.cast("double") == F.lit(number)
    if kind == "bool":
        return column.cast("string") == F.lit(_hunt_text(value))
    return column == F.lit(_hunt_text(value))


def _hunt_leaf(name: str, op: str, value: Any) -> Column:
    kind, column = field_kind(name), field(name)
    text = column.cast("string")
    if op == "==":
        test = _hunt_equals(column, kind, value)
    elif op == "!=":
        test = ~_hunt_equals(column, kind, value) & column.isNotNull()
    elif op == "in":
        test = any_of([_hunt_equals(column, kind, v) for v in value])
    elif op in ("contains", "startswith", "endswith"):
        test = getattr(text, op)(F.lit(_hunt_text(value)))
    elif op == "=~":
        test = text.rlike(java_regex(_hunt_text(value)))
    elif op in (">", "<", ">=", "<="):
        left, right = _number_of(column, kind), _hunt_number(value)
        if left is None or right is None:
            test = F.lit(False)
        else:
            test = {">": left.__gt__, "<": left.__lt__, ">=": left.__ge__, "<=": left.__le__}[op](F.lit(right))
    else:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(test, F.lit(False))


def check_tree(node: Any, ops: tuple[str, ...] = RULE_OPS) -> None:
    """Reject a node that is not exactly one of all / any / not / leaf."""
    if not isinstance(node, dict):
        raise ValueError("a condition must be a mapping")
    shapes = [k for k in ("all", "any", "not", "field") if node.get(k) is not None]
    if len(shapes) != 1:
        raise ValueError("a condition needs exactly one of all, any, not, field")
    unknown = set(node) - {"all", "any", "not", "field", "op", "value"}
    if unknown:
        raise ValueError(f"unknown condition keys {sorted(unknown)}")
    shape = shapes[0]
    if shape in ("all", "any"):
        if not isinstance(node[shape], (list, tuple)) or not node[shape]:
            raise ValueError(f"{shape} needs a non-empty list")
        for child in node[shape]:
            check_tree(child, ops)
    elif shape == "not":
        check_tree(node["not"], ops)
    else:
        field_kind(node["field"])
        if node.get("op") not in ops:
            raise ValueError(f"unknown operator {node.get('op')!r}")


def _lower(node: dict, leaf, ops: tuple[str, ...]) -> Column:
    check_tree(node, ops)

    def walk(n: dict) -> Column:
        if n.get("all") is not None:
            return all_of([walk(c) for c in n["all"]])
        if n.get("any") is not None:
            return any_of([walk(c) for c in n["any"]])
        if n.get("not") is not None:
            return ~walk(n["not"])
        return leaf(n["field"], n["op"], n.get("value"))

    return walk(node)


def rule_predicate(node: dict) -> Column:
    """A rule's match tree as a never-null boolean column."""
    return _lower(node, _rule_leaf, RULE_OPS)


def hunt_predicate(node: dict) -> Column:
    """A hunt's filter tree as a never-null boolean column."""
    return _lower(node, _hunt_leaf, HUNT_OPS)


def event_class(name: str) -> Column:
    """``any`` / ``event`` match every event, else verb equality."""
    if name in ("any", "event"):
        return F.lit(True)
    return F.coalesce(F.col("action") == name, F.lit(False))
