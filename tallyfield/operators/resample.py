"""Paired bootstrap over any number of rows.

Rows are hashed into blocks of bounded size by their unique key. How often an iteration
draws from each block follows the exact multinomial law: binomial splits down a binary
tree over the block numbers. The tree's totals are a table, one level to a join, and each
block carries only its own path, so its task derives its draws from the path and the tree
nodes' seeds; the driver knows the number of rows. Each block then draws its own rows with
NumPy and returns sums per iteration; only ``blocks x iterations`` small rows are shuffled.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.evaluation import DEVIANCE_EPSILON, deviance_term
from tallyfield.session import materialize, with_one_row

# Default protocol.
ITERATIONS, SEED, CONFIDENCE = 10_000, 50_000, 0.95


def _draws(path: list[dict], total: int, iterations: int, seed: int) -> np.ndarray:
    """Number of draws that each iteration makes in the block at the end of ``path``."""
    draws = np.full(iterations, total, dtype=np.int64)
    for step in path:
        generator = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 0, step["node"]])))
        in_left = generator.binomial(draws, step["left"] / step["whole"])
        draws = in_left if step["goes_left"] else draws - in_left
    return draws


def block_paths(sizes: DataFrame, blocks: int) -> DataFrame:
    """``_block`` and its ``path``: at each tree node above it the node's number, rows and rows on the left.

    ``sizes`` has one row per block that holds rows. A level's totals are an aggregate of it,
    so every join here is as small as the list of blocks.
    """
    depth = (blocks - 1).bit_length()
    step = "struct<node:bigint,whole:bigint,left:bigint,goes_left:boolean>"
    paths = sizes.select("_block", F.array().cast(f"array<{step}>").alias("path"))
    for level in range(depth):
        below = depth - level - 1
        left = F.shiftright("_block", below).bitwiseAND(F.lit(1)) == 0
        node = F.shiftright("_block", below + 1)
        totals = sizes.groupBy(node.alias("_node")).agg(
            F.sum("size").alias("_whole"), F.coalesce(F.sum(F.when(left, F.col("size"))), F.lit(0)).alias("_left")
        )
        taken = F.struct(
            (F.col("_node") + F.lit(1 << level)).cast("bigint").alias("node"),
            F.col("_whole").alias("whole"),
            F.col("_left").alias("left"),
            left.alias("goes_left"),
        )
        joined = paths.withColumn("_node", node).join(totals, "_node")
        paths = joined.select("_block", F.array_append("path", taken).cast(f"array<{step}>").alias("path"))
    return paths


def resampled_sums(
    rows: DataFrame, keys: list[str], values: dict[str, Column], iterations: int, seed: int, rows_per_block: int = 50_000
) -> DataFrame:
    """Per iteration: number of draws and the sums of ``values`` over the drawn rows."""
    names = list(values)
    base = rows.select(*keys, *[v.cast("double").alias(n) for n, v in values.items()])
    total = base.count()
    blocks = max(1, ceil(total / rows_per_block))
    base = base.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))
    sizes = materialize(base.groupBy("_block").agg(F.count("*").alias("size")))
    paths = materialize(block_paths(sizes, blocks))

    def draw(pdf: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["_block"].iloc[0])
        table = pdf.sort_values(keys)[names].to_numpy()
        counts = _draws(list(path["path"].iloc[0]), total, iterations, seed)
        generator = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, 1, block])))
        sums = np.empty((iterations, len(names)))
        for i in range(iterations):
            picked = generator.integers(0, len(table), size=counts[i])
            sums[i] = np.bincount(picked, minlength=len(table)) @ table
        out = pd.DataFrame(sums, columns=names)
        out.insert(0, "_draws", counts)
        out.insert(0, "iteration", np.arange(iterations))
        return out

    schema = "iteration int, _draws long, " + ", ".join(f"{n} double" for n in names)
    # A block is little data and long work: a stated number of partitions keeps the adaptive
    # planner from putting all blocks into one task, and twice as many let few blocks meet.
    spread = base.repartition(2 * blocks, "_block")
    partial = spread.groupBy("_block").cogroup(paths.groupBy("_block")).applyInPandas(draw, schema)
    return partial.groupBy("iteration").agg(F.sum("_draws").alias("draws"), *[F.sum(n).alias(n) for n in names])


def paired_mae_bootstrap(
    rows: DataFrame,
    keys: list[str],
    reference: str,
    candidate: str | list[str],
    actual: str = "actual",
    iterations: int = ITERATIONS,
    confidence: float = CONFIDENCE,
    seed: int = SEED,
    rows_per_block: int = 50_000,
) -> DataFrame:
    """Improvement of each candidate's absolute error over the reference, with its interval.

    All candidates share the same resamples, so one pass over the rows serves them all.
    """
    candidates = [candidate] if isinstance(candidate, str) else list(candidate)
    loss = {m: F.abs(F.col(actual) - F.col(m)) for m in (reference, *candidates)}
    gains = {f"gain_{i}": loss[reference] - loss[c] for i, c in enumerate(candidates)}
    sums = resampled_sums(rows, keys, gains, iterations, seed, rows_per_block)
    observed = rows.agg(
        F.avg(loss[reference]).alias("_mae"),
        F.count("*").alias("sample_count"),
        *[F.avg(g).alias(n) for n, g in gains.items()],
    )
    tail = (1 - confidence) / 2
    # One value per iteration: a bounded group.
    bounds = F.array(F.lit(tail), F.lit(1 - tail))
    intervals = sums.agg(*[F.percentile(F.col(n) / F.col("draws"), bounds).alias(f"{n}_ci") for n in gains])
    entries = [
        F.struct(F.lit(c).alias("candidate"), F.col(f"gain_{i}").alias("difference"), F.col(f"gain_{i}_ci").alias("_ci"))
        for i, c in enumerate(candidates)
    ]
    both = with_one_row(observed, intervals)
    return both.select("_mae", "sample_count", F.inline(F.array(*entries))).select(
        "candidate",
        "difference",
        F.col("_ci")[0].alias("confidence_lower"),
        F.col("_ci")[1].alias("confidence_upper"),
        F.lit(confidence).alias("confidence_level"),
        F.when(F.col("_mae") > 0, F.col("difference") / F.col("_mae")).otherwise(0.0).alias("effect_size"),
        "sample_count",
        F.lit(iterations).alias("iterations"),
        F.lit(seed).alias("random_seed"),
        (F.col("_ci")[0] > 0).alias("statistically_significant_improvement"),
    )


def paired_metric_bootstrap(
    rows: DataFrame,
    keys: list[str],
    baseline: str,
    learned: str,
    actual: str = "actual",
    iterations: int = ITERATIONS,
    confidence: float = CONFIDENCE,
    seed: int = SEED,
    epsilon: float = DEVIANCE_EPSILON,
    rows_per_block: int = 50_000,
) -> DataFrame:
    """Learned minus baseline for four metrics, all from the same resamples."""
    values = {}
    for side, model in (("b", baseline), ("l", learned)):
        error = F.col(model) - F.col(actual)
        values |= {
            f"{side}_abs": F.abs(error),
            f"{side}_sq": error * error,
            f"{side}_dev": deviance_term(F.col(actual), F.col(model), epsilon),
            f"{side}_err": error,
        }
    sums = resampled_sums(rows, keys, values, iterations, seed, rows_per_block)
    observed = rows.agg(F.count("*").alias("draws"), *[F.sum(v).alias(n) for n, v in values.items()])

    def differences(frame: DataFrame) -> DataFrame:
        mean = lambda c: F.col(c) / F.col("draws")
        parts = {
            "mae": mean("l_abs") - mean("b_abs"),
            "rmse": F.sqrt(mean("l_sq")) - F.sqrt(mean("b_sq")),
            "poisson_deviance": mean("l_dev") - mean("b_dev"),
            "mean_prediction_bias": mean("l_err") - mean("b_err"),
        }
        entries = [F.struct(F.lit(n).alias("metric"), v.alias("difference")) for n, v in parts.items()]
        return frame.select("draws", F.inline(F.array(*entries)))

    tail = (1 - confidence) / 2
    interval = differences(sums).groupBy("metric").agg(
        F.percentile("difference", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci")
    )
    return differences(observed).join(interval, "metric").select(
        "metric",
        "difference",
        F.col("_ci")[0].alias("confidence_lower"),
        F.col("_ci")[1].alias("confidence_upper"),
        F.lit(confidence).alias("confidence_level"),
        F.col("draws").alias("sample_count"),
        F.lit(iterations).alias("iterations"),
        F.lit(seed).alias("random_seed"),
    )
