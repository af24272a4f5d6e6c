import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from text_helpers import CLASHES, LONG, prose  # noqa: E402


@pytest.fixture(scope="session")
def edge_rows():
    """Null, empty, wordless and very long texts, ties and repeated rows, a missing id."""
    rng = random.Random(3)
    same = "One line of words that is here.\nAnother line of words follows it.\nA third line of words ends it."
    rows = [(1, None), (2, ""), (3, " \n\t \n"), (4, LONG), (5, LONG), (6, same), (7, same), (7, same), (8, "word"), (9, "word"),
            (None, same), (10, prose(rng)), (11, "x" * 100_000), (12, "ünï " * 30), (13, same + "\n" + prose(rng))]
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(edge_rows, "doc_id long, text string")
    return frame.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"),
                              **{c: F.lit("mine") for c in CLASHES}})


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
