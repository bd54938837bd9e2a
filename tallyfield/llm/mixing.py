"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a hashed order, each of them twice over. A copy's
virtual finish time is the cumulative tokens of its source divided by the source's target;
the copies of all sources, sorted by finish time, are taken until the total budget is full.
The queue of a source is cut into hash buckets whose totals are summed ahead, so a source
that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import WORD_SQL, store
from tallyfield.llm.prefix import prefix_sums, range_parts

#: Weights of the sources in code point order (null last), repeated.
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2
SEED = "mix-1"
#: Pieces of a source's queue; the totals table has a row for each piece that is not empty.
BUCKETS = 1024


def source_targets(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, copies: int = MOST_COPIES
) -> DataFrame:
    """``_source``, ``_source_size``, ``_target``: one row per source.

    ``docs`` has ``_source`` and ``_size``. Sources share ``budget`` times all sizes by
    weight; a target stops at ``copies`` times its source's size and the excess is shared
    again by weight. The sources that stop are those of the smallest cap per weight, so
    the common level follows from running sums over the sources in that order.
    """
    sizes = docs.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(1))
    capped = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("_source_size") * copies)
    order = every.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0))
    level = (F.sum("_source_size").over(every) * F.lit(float(budget)) - spent) / rest
    # The level when all sources ahead are at their caps. It holds from the first source whose cap
    # it does not exceed; further on it can only fall, so the largest that holds is the common one.
    levels = capped.withColumn("_level", level)
    holds = F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.col("_level"))
    share = F.coalesce(F.max(holds).over(every) * F.col("_weight"), F.col("_cap").cast("double"))
    return levels.select("_source", "_source_size", F.least(F.col("_cap").cast("double"), share).alias("_target"))


def _queued(docs: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """Adds ``_before``, the tokens queued ahead of a document in its source, and the source's figures."""
    keyed = docs.withColumn("_bucket", F.conv(F.substring("_place", 1, 8), 16, 10).cast("long") % buckets)
    totals = keyed.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum"))
    along = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(along), F.lit(0)))
    ahead = ahead.join(targets, ahead["_source"].eqNullSafe(targets["_source"])).select(
        ahead["_source"].alias("_s"), F.col("_bucket").alias("_b"), "_ahead", "_source_size", "_target"
    )
    joined = keyed.join(ahead, keyed["_source"].eqNullSafe(ahead["_s"]) & (F.col("_bucket") == F.col("_b")))
    within = Window.partitionBy("_source", "_bucket").orderBy("_place", "_size")
    running = F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn("_before", F.col("_ahead") + running).drop("_s", "_b", "_ahead", "_bucket")


def _finish(copy: int):
    return F.try_divide(F.col("_source_size") * copy + F.col("_before") + F.col("_size"), F.col("_target"))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """Adds ``_size``, ``_source`` and ``_place``, the position in the hashed order."""
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary"))
    return docs.withColumns(
        {
            "_size": F.coalesce(F.regexp_count("text", F.lit(WORD_SQL)), F.lit(0)).cast("long"),
            "_source": F.col("source"),
            "_place": place,
        }
    )


def _decide(sized: DataFrame, weights: Sequence[int], budget: float, buckets: int) -> tuple[DataFrame, Column]:
    """Targets of the sources, and how often a queued row is taken; ``sized`` is stored."""
    targets = source_targets(sized, weights, budget)
    queue = _queued(sized.filter("_size > 0"), targets, buckets)
    times = F.array(*[F.struct(_finish(c).alias("finish"), F.lit(c).alias("copy")) for c in range(MOST_COPIES)])
    entries = queue.select("_place", "_size", F.explode(times).alias("_entry")).select("_entry.*", "_place", "_size")
    order = [F.col("finish"), F.col("_place"), F.col("copy")]
    parts = range_parts(entries, order)
    total = (sized.agg(F.sum("_size")).first()[0] or 0) * budget
    cut = prefix_sums(parts, order, "_size").filter(F.col("_end") <= total).agg(F.max(F.struct(*order))).first()[0]
    parts.drop()
    finish, at, copy = cut if cut is not None else (-1.0, "", 0)
    last = F.struct(F.lit(finish).alias("finish"), F.lit(at).alias("_place"), F.lit(copy).alias("copy"))
    taken = [
        F.struct(_finish(c).alias("finish"), F.col("_place"), F.lit(c).alias("copy")) <= last
        for c in range(MOST_COPIES)
    ]
    return targets, sum(F.when((F.col("_size") > 0) & t, 1).otherwise(0) for t in taken)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    seed: str = SEED,
    buckets: int = BUCKETS,
) -> DataFrame:
    """All columns of ``docs`` with ``_size``, ``_source_size``, ``_target`` and ``_copies``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``. The size of a document is its number
    of words (null and empty texts: 0, never taken). ``_copies`` is how often the mix takes
    it, at most twice. The order of a source's queue is the MD5 of seed and doc_id, so
    reruns agree; repeated rows queue behind each other, null ids and a null source count
    as values of their own, and an empty table gives no rows.
    """
    sized = _sized(docs, seed)
    # The decision reads three narrow columns several times; the texts are read twice.
    narrow = store(sized.select("_source", "_size", "_place"), "sizes")
    targets, copies = _decide(narrow.df, weights, budget, buckets)
    return _queued(sized, targets, buckets).withColumn("_copies", copies).drop("_before", "_place", "_source")


def taken_words(docs: DataFrame) -> DataFrame:
    """Size, target and taken words of every document; the texts are read once."""
    narrow = store(_sized(docs.select("doc_id", "text", "source"), SEED).drop("text", "source"), "sizes")
    targets, copies = _decide(narrow.df, WEIGHTS, BUDGET, BUCKETS)
    return _queued(narrow.df, targets, BUCKETS).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * copies).cast("long").alias("taken"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it (at most twice).

    Null and empty texts have no words and are never taken; null ids and a null source count as
    values of their own; repeated rows queue behind each other; an empty table gives no rows.
    Rows of one id and one size with different texts share a place in the queue, so which of
    them comes first may differ between runs.
    """
    many = mix(docs.select("doc_id", "text", "source", F.struct("*").alias("_row"))).filter("_copies > 0")
    return many.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")
