"""Content signatures over whole files or texts.

A signature is ``{"name", "strings": {id: {"text"|"hex", "nocase"}}, "condition"}``.
A condition is a string id, ``{"all": [..]}``, ``{"any": [..]}``, ``{"not": ..}`` or
``{"of": n | "all" | "any", "ids": [..] | "them"}``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def builtin_signatures() -> list[dict]:
    # Signature names, patterns and conditions.
    return [
        {"name": "EICAR_Test_File", "strings": {"eicar": {"text": "EICAR-STANDARD-ANTIVIRUS-TEST-FILE"}},
         "condition": "eicar"},
        {"name": "Linux_CoinMiner",
         "strings": {"a": {"text": "stratum+tcp://", "nocase": True}, "b": {"text": "--donate-level"},
                     "c": {"text": "cryptonight", "nocase": True}, "d": {"text": "xmrig", "nocase": True}},
         "condition": {"of": 2, "ids": "them"}},
        {"name": "Linux_Reverse_Shell_Binary",
         "strings": {"sh1": {"text": "/bin/sh -i"}, "sh2": {"text": "/bin/bash -i"}, "tcp": {"text": "/dev/tcp/"},
                     "sock": {"text": "socket"}, "dup": {"text": "dup2"}},
         "condition": {"all": [{"any": ["sh1", "sh2"]}, {"any": ["tcp", {"all": ["sock", "dup"]}]}]}},
        {"name": "PHP_Webshell",
         "strings": {"php": {"text": "<?php"}, "sys": {"text": "system(", "nocase": True},
                     "exec": {"text": "shell_exec(", "nocase": True}, "pass": {"text": "$_POST"},
                     "get": {"text": "$_GET"}, "req": {"text": "$_REQUEST"}},
         "condition": {"all": ["php", {"any": ["sys", "exec"]}, {"any": ["pass", "get", "req"]}]}},
    ]


def _pattern(content: Column, spec: dict) -> Column:
    """One boolean per pattern: binary containment, or a regex over the bytes as Latin-1."""
    if "text" in spec:
        raw = spec["text"].encode("utf-8")
        if not spec.get("nocase"):
            return F.contains(content, F.lit(raw))
        # Java folds ASCII only under (?i), which is the wanted fold.
        body = "(?i)" + "".join(f"\\x{b:02x}" if not chr(b).isalnum() or b > 127 else chr(b) for b in raw)
    else:
        digits = re.sub(r"\s", "", spec["hex"])
        if len(digits) % 2 or not re.fullmatch(r"(?:[0-9A-Fa-f]{2}|\?\?)+", digits):
            raise ValueError(f"bad hex pattern {spec['hex']!r}")
        if "?" not in digits:
            return F.contains(content, F.lit(bytes.fromhex(digits)))
        body = "(?s)" + "".join("." if digits[i] == "?" else f"\\x{digits[i:i + 2]}" for i in range(0, len(digits), 2))
    return F.decode(content, "ISO-8859-1").rlike(body)


def _condition(node, hits: dict[str, Column]) -> Column:
    if isinstance(node, str):
        return hits[node]
    if "all" in node:
        return reduce(lambda a, b: a & b, [_condition(n, hits) for n in node["all"]])
    if "any" in node:
        return reduce(lambda a, b: a | b, [_condition(n, hits) for n in node["any"]])
    if "not" in node:
        return ~_condition(node["not"], hits)
    ids = list(hits) if node["ids"] == "them" else list(node["ids"])
    wanted = {"all": len(ids), "any": 1}.get(node["of"], node["of"])
    return reduce(lambda a, b: a + b, [hits[i].cast("int") for i in ids]) >= wanted


def scan_content(df: DataFrame, column: str, signatures: list[dict] | None = None, out: str = "matches") -> DataFrame:
    """Add the names of matching signatures in their order; null when none matches."""
    signatures = builtin_signatures() if signatures is None else signatures
    content = F.col(column).cast("binary")
    names = []
    for signature in signatures:
        hits = {i: F.coalesce(_pattern(content, spec), F.lit(False)) for i, spec in signature["strings"].items()}
        names.append(F.when(_condition(signature["condition"], hits), F.lit(signature["name"])))
    found = F.array_compact(F.array(*names))
    return df.withColumn(out, found).withColumn(out, F.when(F.size(out) > 0, F.col(out)))
