"""Many rules against an event: an index of their leaves.

Each rule is taken apart into clauses (verbs, tests that all have to hold). What clauses share is
looked up once: for every field, the values that ``eq`` and ``in`` leaves ask for lead to the bits of
the rules that ask for them. A clause that wants no more is decided by that lookup; the tests of the
others run only where their verb and their bit hold, and regexes only where a literal that every
match contains is there (``predicates.required_literals``).

Matches are bits of longs, one for each rule, worked out in one projection.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import field, field_kind
from ..functions.predicates import check_tree, coerced, quoted, rule_predicate

#: Rules whose bits one long holds, and how many bits are looked up at once.
WORD, NIBBLE = 60, 4
VERB_FIELDS = ("event.type", "event.action")


@dataclass
class Clause:
    """One way for a rule to match: its verbs (None: any), and the tests that all have to hold."""

    rule: int
    verbs: tuple[str, ...] | None
    tests: list[dict]
    selector: tuple[str, list[Any]] | None = None


def _conjuncts(tree: dict) -> list[dict]:
    return [t for part in tree["all"] for t in _conjuncts(part)] if tree.get("all") is not None else [tree]


def _branches(tree: dict) -> list[list[dict]]:
    """The tree as alternatives of conjunctions, as far as ``any`` stands at its top."""
    return [b for part in tree["any"] for b in _branches(part)] if tree.get("any") is not None else [_conjuncts(tree)]


def _wanted(leaf: dict) -> list[Any] | None:
    """The values an ``eq`` or ``in`` leaf asks for, None if it is another leaf."""
    if leaf.get("field") is None or leaf.get("op") not in ("eq", "in"):
        return None
    values = leaf["value"] if leaf["op"] == "in" else [leaf["value"]]
    kind = field_kind(leaf["field"])
    if kind == "bool" or not isinstance(values, (list, tuple)):
        return None
    own = [coerced(kind, v) for v in values]
    return [v for v in dict.fromkeys(own) if v is not None and v != ""]  # an absent field equals nothing


def clauses_of(rules: list[dict]) -> list[Clause]:
    out = []
    for number, rule in enumerate(rules):
        check_tree(rule["match"])
        indexed: set[str] = set()
        for tests in _branches(rule["match"]):
            clause = Clause(number, None, list(tests))
            for leaf in tests:
                wanted = _wanted(leaf)
                if wanted and leaf["field"] in VERB_FIELDS and clause.verbs is None:
                    clause.verbs = tuple(wanted)
                    clause.tests.remove(leaf)
                # One clause of a rule for each field: its bit then stands for that clause alone.
                elif wanted and leaf["field"] not in VERB_FIELDS and clause.selector is None and leaf["field"] not in indexed:
                    clause.selector = (leaf["field"], wanted)
                    clause.tests.remove(leaf)
                    indexed.add(leaf["field"])
            out.append(clause)
    # A lookup pays where several clauses share a field.
    asked = Counter(c.selector[0] for c in out if c.selector)
    for c in out:
        if c.selector and asked[c.selector[0]] == 1:
            c.tests.insert(0, {"field": c.selector[0], "op": "in", "value": c.selector[1]})
            c.selector = None
    return out


def _bit(rule: int) -> int:
    return 1 << (rule % WORD)


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _long(value: int) -> Column:
    return F.expr(f"{value}L")


def _lookup(name: str, clauses: list[Clause]) -> Column:
    """The bits of the clauses that ask for the field's value."""
    bits: dict[Any, int] = defaultdict(int)
    for c in clauses:
        for v in c.selector[1]:
            bits[v] |= _bit(c.rule)
    column = field(name)
    table = F.expr("map(" + ", ".join(f"{_literal(v)}, {b}L" for v, b in bits.items()) + ")")
    return F.coalesce(F.when(column.isin(list(bits)), F.element_at(table, column)), _long(0))


def _literal(value: str | int) -> str:
    return quoted(value) if isinstance(value, str) else f"{value}L"


def _found(clauses: list[Clause], selected) -> Column:
    """The bits of the clauses that match; an event tests those of its verb."""
    by_verbs: dict[tuple[str, ...] | None, list[Clause]] = defaultdict(list)
    for c in clauses:
        by_verbs[c.verbs].append(c)
    groups = []
    for verbs, own in by_verbs.items():
        parts = []
        for name in dict.fromkeys(c.selector[0] for c in own if c.selector and not c.tests):
            decided = sum(_bit(c.rule) for c in own if c.selector and not c.tests and c.selector[0] == name)
            parts.append(selected(name).bitwiseAND(_long(decided)))
        for c in own:
            tests = [rule_predicate(t) for t in c.tests]
            if c.selector and c.tests:
                tests.insert(0, selected(c.selector[0]).bitwiseAND(_long(_bit(c.rule))) != 0)
            if tests:
                parts.append(F.when(reduce(lambda a, b: a & b, tests), _long(_bit(c.rule))).otherwise(_long(0)))
            elif not c.selector:
                parts.append(_long(_bit(c.rule)))
        mask = _or(parts)
        if verbs is not None:
            mask = F.when(F.col("action").isin(list(verbs)), mask).otherwise(_long(0))
        groups.append(mask)
    return _or(groups)


def _numbers(count: int) -> Column:
    """The numbers of the set bits: four bits at a time are looked up in a table of their sets."""
    parts = []
    for first in range(0, count, NIBBLE):
        own = [", ".join(str(first + i) for i in range(NIBBLE) if value >> i & 1) for value in range(1 << NIBBLE)]
        table = ", ".join(f"array({numbers})" if numbers else "cast(array() AS array<int>)" for numbers in own)
        parts.append(f"get(array({table}), int(shiftright(_w{first // WORD}, {first % WORD}) & {(1 << NIBBLE) - 1}L))")
    return F.expr(f"flatten(array({', '.join(parts)}))")


def match_rules(df: DataFrame, rules: list[dict], words: str = "_w") -> DataFrame:
    """The events that match any rule, with a long of match bits for every ``WORD`` rules. Narrow, so it works on streams."""
    clauses = clauses_of(rules)
    looked_up: dict[tuple[str, int], list[Clause]] = defaultdict(list)
    for c in clauses:
        if c.selector:
            looked_up[c.selector[0], c.rule // WORD].append(c)
    places = {key: f"_k{i}" for i, key in enumerate(looked_up)}
    rows = df.withColumns({places[key]: _lookup(key[0], own) for key, own in looked_up.items()}) if looked_up else df
    by_word: dict[int, list[Clause]] = defaultdict(list)
    for c in clauses:
        by_word[c.rule // WORD].append(c)
    masks = {f"_m{word}": _found(own, lambda name, w=word: F.col(places[name, w])) for word, own in sorted(by_word.items())}
    # An expression that is never fused keeps this projection out of whole-stage code, where it would be one method of a size
    # that the JVM leaves interpreted; alone, it is generated as many small ones.
    rows = rows.withColumns({**masks, "_zero": F.expr("aggregate(array(action), 0L, (a, x) -> 0L)")})
    # The generator keeps what follows from repeating the masks.
    bits = [F.col(m).bitwiseOR(F.col("_zero")).alias(f"{words}{m[2:]}") for m in masks]
    rows = rows.select(*(F.col(f"`{c}`") for c in df.columns), F.inline(F.array(F.struct(*bits))))
    return rows.filter(reduce(lambda a, b: a | b, [F.col(f"{words}{word}") != 0 for word in by_word]))


def exploded(df: DataFrame, rules: list[dict], out: str = "_rule") -> DataFrame:
    """A row for every match, with the rule's number."""
    last = (len(rules) - 1) // WORD
    word = F.expr("_w0" if not last else "CASE " + " ".join(f"WHEN {out} < {(w + 1) * WORD} THEN _w{w}" for w in range(last + 1)) + " END")
    hits = match_rules(df, rules).withColumn(out, F.explode(F.array(*map(F.lit, range(len(rules))))))
    hits = hits.withColumn("_word", word).filter(F.expr(f"shiftright(_word, {out} % {WORD}) & 1L") == 1).drop("_word")
    return hits.drop(*(c for c in hits.columns if c.startswith("_w")))


def collected(df: DataFrame, rules: list[dict], out: str = "_hits") -> DataFrame:
    """The events that match, with the array of their rules' numbers."""
    hits = match_rules(df, rules).withColumn(out, _numbers(len(rules)))
    return hits.drop(*(c for c in hits.columns if c.startswith("_w")))
