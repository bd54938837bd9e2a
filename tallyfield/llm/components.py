"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step keeps connectivity and the number of edges does not grow: an edge set becomes a
forest of stars around the smallest node after O(log^2 n) rounds. Minima are combined on
the map side and stored before the join that hands a node's minimum to its edges: both
sides of that join are scans then, so the adaptive planner can split a node of very many
edges. (A join that reads an aggregate of its own stage cannot be split.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.common import Stored, store

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> Stored:
    """Connect each larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("n"), F.col("a").alias("v"))
    )
    least = store(both.groupBy("n").agg(F.min("v").alias("m")), "least")
    larger = edges.select(F.col("a").alias("n"), F.col("b").alias("v"))
    joined = larger.join(least.df, "n").select(F.least("m", "n").alias("a"), F.col("v").alias("b"))
    found = store(joined.distinct(), "edges")
    least.drop()
    return found


def _small_star(edges: DataFrame) -> Stored:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = store(edges.groupBy("b").agg(F.min("a").alias("m")), "least")
    joined = edges.join(least.df, "b")
    moved = joined.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    found = store(moved.unionByName(least.df.select(F.col("m").alias("a"), "b")).distinct(), "edges")
    least.drop()
    return found


def components(links: DataFrame) -> Stored:
    """Smallest reachable node for every node that has a link.

    ``links`` has long columns ``a`` and ``b`` in any orientation; repeated links, loops and
    links with a null end are allowed and add nothing. Returns a stored table of ``node``
    and ``component``; nodes without a link to another node are not in it. An empty input
    gives an empty table.
    """
    edges = store(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        large = _large_star(edges.df)
        edges.drop()
        edges = _small_star(large.df)
        large.drop()
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.df.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = store(roots.unionByName(edges.df.select(F.col("b").alias("node"), F.col("a").alias("component"))), "components")
    edges.drop()
    return found
