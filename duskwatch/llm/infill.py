"""Fill-in-the-middle transformation of documents.

A text is a run of units: letters A-Z, a-z together, any other code point alone. One full match of
``(unit)*`` keeps every repetition of its group, so its ends give the number of units and the
character offsets of both cuts without a loop over units. A checksum of the document's id draws the
cuts and the form: prefix, suffix, middle with markers between them (psm), suffix first (spm), or
the text as it is (plain).

Defined cases: null and empty texts are plain, as are texts that hold a marker, since the parts
could not be told apart then; a null id draws as the empty string does; repeated rows give equal
results; a very long text is matched whole (its ends take some bytes for each unit, in one task);
an empty table gives no rows. All columns of the input stay, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, unpacked

UNIT = r"[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, so many get a form; of these, so many the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1:"


@functools.lru_cache(maxsize=1)
def _units():
    import regex

    return regex.compile(f"({UNIT})*")


def draws(doc_id: object, seed: str = SEED) -> list[int]:
    """Four numbers below 2^32 from the id."""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transformed(doc_id: object, text: str, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and of middle, output)."""
    ends = _units().fullmatch(text).ends(1)
    n = len(ends)
    one, two, form, order = draws(doc_id, seed)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or form % 100 >= TRANSFORMED:
        return n, "plain", None, None, text
    first, second = (ends[k - 1] if k else 0 for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if order % 100 < SUFFIX_FIRST:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transform(seed: str):
    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transformed(i, t or "", seed) for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds))],
                                             names=["_row", *(name for name, _ in kinds)])

    return run


def fill_in_middle(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output."""
    small_batches(docs.sparkSession)
    rows = packed(docs, F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(_transform(seed), f"_row {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return unpacked(out, docs.columns, **{c: F.col(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")})


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: no part holds a marker, so the first one of each kind is the one put in."""
    ahead = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    before, after = {}, {}
    for name, left, right in (("psm", PREFIX, SUFFIX), ("spm", SUFFIX, PREFIX)):
        before[name] = F.substring(F.substring_index(ahead, right, 1), len(left) + 1, 2**31 - 1)
        after[name] = F.substring_index(ahead, right, -1)
    return F.when(form == "psm", F.concat(before["psm"], middle, after["psm"])) \
        .when(form == "spm", F.concat(after["spm"], middle, before["spm"])).otherwise(output)
