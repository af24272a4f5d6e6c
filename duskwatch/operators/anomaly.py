"""Rarity against a learned baseline, and an isolation forest."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_length, entropy, path_depth
from .joins import lookup_join

CATEGORIES = ("executable", "parent_child", "user_process", "dest_port")
FEATURES = 8
TREES, SAMPLE = 100, 256
EULER_GAMMA = 0.5772156649015329


def category_keys() -> dict[str, Column]:
    """Up to four categorical keys per event, null where the event has none."""
    some = lambda p: F.nullif(F.col(p), F.lit(""))
    name, port = some("process.name"), F.nullif(F.col("network.dst_port").cast("long"), F.lit(0).cast("long"))
    parent = F.coalesce(some("process.parent_name"), F.lit("?"))
    uid = F.coalesce(F.col("user.id"), F.lit(0)).cast("string")
    return {
        "executable": some("process.executable"),
        "parent_child": F.when(name.isNotNull(), F.concat(parent, F.lit(">"), name)),
        "user_process": F.when(name.isNotNull(), F.concat(uid, F.lit(">"), name)),
        "dest_port": port.cast("string"),
    }


def baseline_features(df: DataFrame) -> DataFrame:
    """(seq, category, key), one row per feature an event carries."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), k.alias("key")) for c, k in category_keys().items()])
    return df.select("seq", F.explode(pairs).alias("f")).filter("f.key is not null").select("seq", "f.*")


def build_baseline(df: DataFrame) -> DataFrame:
    """(category, key, n): how often each feature was seen; counts combine map-side."""
    return baseline_features(df).groupBy("category", "key").agg(F.count("*").alias("n"))


def rarity(n: Column) -> Column:
    return 1.0 / (1.0 + F.log2(1 + F.coalesce(n, F.lit(0)).cast("double")))


def score_rarity(df: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add ``rarity``: the score of the event's rarest feature, 0 without features.

    One lookup per category keeps events in place: where a category's table is small
    enough for Spark to broadcast there is no shuffle at all. Else hot keys spread over salts
    and events without the feature over all tasks.
    """
    keys = category_keys()
    scored = df.withColumns({f"_k_{c}": k for c, k in keys.items()})
    for c in CATEGORIES:
        table = (baseline.filter(F.col("category") == c)
                 .select(F.col("key").alias(f"_k_{c}"), F.col("n").alias(f"_n_{c}")))
        scored = lookup_join(scored, table, [f"_k_{c}"])
    parts = [F.when(F.col(f"_k_{c}").isNotNull(), rarity(F.col(f"_n_{c}"))).otherwise(F.lit(0.0)) for c in CATEGORIES]
    helpers = [f"_{x}_{c}" for c in CATEGORIES for x in "kn"]
    return scored.withColumn("rarity", F.greatest(*parts)).drop(*helpers)


def feature_vector() -> Column:
    """The eight numeric features as an array of doubles."""
    name = F.coalesce(F.col("process.name"), F.lit(""))
    parts = [
        byte_length(F.col("process.name")), byte_length(F.col("process.command_line")),
        F.greatest(F.coalesce(F.size("process.args"), F.lit(0)), F.lit(0)), F.pmod(F.floor(F.unix_seconds("ts") / 3600), F.lit(24)),
        F.coalesce(F.col("network.dst_port"), F.lit(0)), F.coalesce(F.col("user.id"), F.lit(0)),
        path_depth(F.col("process.executable")), entropy(name),
    ]
    return F.array(*[p.cast("double") for p in parts])


def with_vector(df: DataFrame) -> DataFrame:
    """Events that carry any feature, with their numeric ``vector``."""
    present = reduce(lambda a, b: a | b, [k.isNotNull() for k in category_keys().values()])
    return df.filter(present).withColumn("vector", feature_vector())


def _normal_path(n):
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n <= 1, 0.0, 2 * (np.log(safe - 1) + EULER_GAMMA) - 2 * (safe - 1) / safe)


FOREST = ("tree_id int, node_id int, feature int, split double, left int, right int, size long, "
          "sample_size int")


def draw_samples(vectors: DataFrame, trees: int, sample: int, seed: int) -> tuple[DataFrame, int]:
    """``sample`` draws with replacement per tree, reproducible for a seed.

    The pool is the ``trees * sample`` rows with the smallest seeded hash, a distributed
    top-k that is uniform over rows; draws that hit the same row number share a pool row,
    which is exactly sampling with replacement.
    """
    total = vectors.count()
    size = min(sample, total)
    draws_wanted = trees * size
    spark = vectors.sparkSession
    hashed = vectors.select(F.xxhash64(F.lit(seed), "seq").alias("h"), "seq", "vector")
    wanted = min(draws_wanted, total)
    # Only hashes that can be among the smallest go to the top-k: about as many rows as it keeps.
    share = (wanted + 8 * math.sqrt(wanted) + 64) / max(total, 1)
    near = hashed if share >= 1 else hashed.filter(F.col("h") < F.lit(int(-(2**63) + share * 2**64)))
    if share < 1 and near.count() < wanted:
        near = hashed
    pool = near.orderBy("h", "seq").limit(wanted)
    # Both sides below hold at most trees * sample rows.
    ranks = np.random.default_rng(seed).integers(0, total, draws_wanted) if total else np.array([], dtype=int)
    _, slot = np.unique(ranks, return_inverse=True)
    draws = spark.createDataFrame(
        pd.DataFrame({"tree_id": np.arange(draws_wanted) // max(size, 1), "slot": slot.astype(int)}),
        "tree_id int, slot long")
    from pyspark.sql import Window

    numbered = pool.withColumn("slot", (F.row_number().over(Window.orderBy("h", "seq")) - 1).cast("long"))
    return draws.join(numbered, "slot").select("tree_id", "seq", "vector"), size


def fit_iforest(df: DataFrame, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """The forest as a node table; trees grow in parallel, each from its own small sample."""
    samples, size = draw_samples(with_vector(df), trees, sample, seed)
    depth = max(1, math.ceil(math.log2(size))) if size > 1 else 1

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        random = np.random.default_rng([seed, tree])
        data = np.stack(pdf.sort_values("seq")["vector"].to_numpy())
        nodes: list[list] = []

        def add(rows, level):
            me = len(nodes)
            nodes.append([tree, me, -1, 0.0, -1, -1, len(rows), size])
            if level >= depth or len(rows) <= 1:
                return me
            feature = int(random.integers(FEATURES))
            low, high = rows[:, feature].min(), rows[:, feature].max()
            if low == high:
                return me
            split = low + random.random() * (high - low)
            below = rows[:, feature] < split
            nodes[me][2:4] = [feature, float(split)]
            nodes[me][4] = add(rows[below], level + 1)
            nodes[me][5] = add(rows[~below], level + 1)
            return me

        add(data, 0)
        return pd.DataFrame(nodes, columns=["tree_id", "node_id", "feature", "split", "left", "right", "size",
                                            "sample_size"])

    return samples.groupBy("tree_id").applyInPandas(grow, FOREST)


def score_iforest(df: DataFrame, forest: DataFrame) -> DataFrame:
    """Add ``structural``: 0 for average isolation depth or worse, towards 1 for outliers.

    The forest is at most trees * (2 * sample - 1) nodes, so it travels in the closure.
    """
    nodes = forest.toPandas()
    if nodes.empty:
        return df.withColumn("structural", F.lit(0.0))
    sample = int(nodes["sample_size"].iloc[0])
    norm = float(_normal_path(sample))
    packed = [(t["feature"].to_numpy(), t["split"].to_numpy(), t["left"].to_numpy(), t["right"].to_numpy(),
               _normal_path(t["size"].to_numpy()))
              for _, t in nodes.sort_values(["tree_id", "node_id"]).groupby("tree_id")]

    @F.pandas_udf("double")
    def isolation(vectors: pd.Series) -> pd.Series:
        if len(vectors) == 0:
            return pd.Series([], dtype=float)
        data = np.stack(vectors.to_numpy())
        total = np.zeros(len(data))
        for feature, split, left, right, leaf in packed:
            at = np.zeros(len(data), dtype=int)
            level = np.zeros(len(data))
            active = np.flatnonzero(feature[at] >= 0)
            while active.size:
                node = at[active]
                below = data[active, feature[node]] < split[node]
                at[active] = np.where(below, left[node], right[node])
                level[active] += 1
                active = active[feature[at[active]] >= 0]
            total += level + leaf[at]
        mean = total / len(packed)
        score = np.power(2.0, -mean / norm) if norm else np.zeros(len(data))
        return pd.Series(np.maximum((score - 0.5) * 2, 0.0))

    # The one-element explode hands the vector over as a finished column: Spark does not
    # pull a Python function out of an expression that holds lambdas.
    ready = df.withColumn("_vector", F.explode(F.array(feature_vector())))
    return ready.withColumn("structural", isolation("_vector")).drop("_vector")


def score(df: DataFrame, baseline: DataFrame | None = None, forest: DataFrame | None = None) -> DataFrame:
    """Set ``anomaly_score`` to the larger of rarity and structural score."""
    parts = [F.lit(0.0)]
    if baseline is not None:
        df = score_rarity(df, baseline)
        parts.append(F.col("rarity"))
    if forest is not None:
        df = score_iforest(df, forest)
        parts.append(F.col("structural"))
    best = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn("anomaly_score", best).drop("rarity", "structural")


def save_model(baseline: DataFrame, forest: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").parquet(f"{path}/baseline")
    forest.write.mode("overwrite").parquet(f"{path}/forest")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/baseline"), spark.read.parquet(f"{path}/forest")
