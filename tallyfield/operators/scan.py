"""Ordered per-key computations that stay balanced when a key is hot.

A plain ``Window.partitionBy(key)`` sends each key to one task. Here a key group larger
than ``spark.tallyfield.rowsPerTask`` is cut into consecutive chunks of the order
(range partitions), windows run per chunk, and what a chunk needs from earlier chunks
is carried over through small per-chunk tables:

* bounded look-back (lags, rolling frames): the last rows before the chunk are copied in;
* unbounded look-back (running sums, counts, maxima): totals of the earlier chunks are added.

With no hot key the result is an ordinary window over the key: one shuffle, one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyfield.session import materialize, rows_per_task, with_one_row

#: Hash buckets in which key groups are counted together.
SIZE_BUCKETS = 4096
#: Rows of a piece of a scan that has no key and would be one task otherwise.
KEYLESS_ROWS = 250_000
CHUNK = "_chunk"
_BORROWED = "_borrowed"


def _sort_column(name: str, reverse: bool = False) -> Column:
    descending = name.startswith("-")
    column = F.col(name.lstrip("-"))
    return column.desc() if descending != reverse else column.asc()


def null_safe(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Join condition under which missing key values match each other."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


@dataclass(frozen=True)
class Ordered:
    """A DataFrame with a key, a total order inside the key, and maybe a chunk column."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunked: bool

    def partition(self, by: Sequence[str] = ()) -> list[str]:
        columns = [*([CHUNK] if self.chunked else []), *self.keys, *by]
        return columns

    def window(self, by: Sequence[str] = ()) -> WindowSpec:
        columns = [F.col(c) for c in self.partition(by)] or [F.lit(0)]
        return Window.partitionBy(*columns).orderBy(*[_sort_column(c) for c in self.order])

    def with_df(self, df: DataFrame) -> Ordered:
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK)


def groups_fit(rows: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no key group has more rows than one task may order."""
    limit = rows_per_task(rows.sparkSession)
    return _largest_group(rows, tuple(keys), limit)[0] <= limit


def _largest_group(rows: DataFrame, keys: tuple[str, ...], limit: int) -> tuple[int, int]:
    """Rows of the largest key group, or a bound on it that is within ``limit``; rows in all.

    Keys are counted by a hash first: a bucket holds whole groups, so a few thousand sums are
    shuffled and not the keys. Only keys of buckets above the limit are counted one by one.
    """
    if not keys:
        total = rows.count()
        return total, total
    rows = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(SIZE_BUCKETS)).alias("_bucket"))
    buckets = rows.groupBy("_bucket").count()
    large = F.collect_list(F.when(F.col("count") > limit, F.col("_bucket")))
    most, total, crowded = buckets.agg(F.max("count"), F.sum("count"), large).first()
    if not crowded:
        return most or 0, total or 0
    sizes = rows.filter(F.col("_bucket").isin(crowded)).groupBy(*keys).count()
    return sizes.agg(F.max("count")).first()[0], total


def ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sizes_of: DataFrame | None = None,
    coarse: Sequence[str] = (),
) -> Ordered:
    """Decide, from the largest key group, whether the groups have to be chunked.

    ``order`` holds column names, a leading ``-`` meaning descending; with the keys it
    must be unique, or ties are broken arbitrarily. ``sizes_of`` names a cheaper frame
    with the same key counts (for example the input of one-to-one joins). ``coarse`` names
    cheap columns that a key group shares: if their groups are small, no key is computed.
    """
    keys, order = tuple(keys), tuple(order)
    limit = rows_per_task(df.sparkSession)
    counted = df if sizes_of is None else sizes_of
    if coarse and groups_fit(counted, coarse):
        return Ordered(df, keys, order, False)
    largest, total = _largest_group(counted, keys, limit)
    if not keys:
        limit = min(limit, KEYLESS_ROWS)
    if largest <= limit:
        return Ordered(df, keys, order, False)
    pieces = max(2, ceil(total / limit))
    ranged = df.repartitionByRange(pieces, *[F.col(k) for k in keys], *[_sort_column(c) for c in order])
    return Ordered(materialize(ranged.withColumn(CHUNK, F.spark_partition_id())), keys, order, True)


def look_back(
    scan: Ordered, depth: int, build: Callable[[DataFrame, WindowSpec], DataFrame]
) -> Ordered:
    """Add columns that read at most ``depth`` earlier rows of the same key.

    ``build`` receives the rows and a window specification without a frame.
    """
    if not scan.chunked:
        return scan.with_df(build(scan.df, scan.window()))
    own = scan.df.withColumn(_BORROWED, F.lit(False))
    rows = own.unionByName(_rows_before_chunks(scan, depth).withColumn(_BORROWED, F.lit(True)))
    built = build(rows, scan.window())
    return scan.with_df(built.filter(~F.col(_BORROWED)).drop(_BORROWED))


def _rows_before_chunks(scan: Ordered, depth: int) -> DataFrame:
    """For every chunk of a key, the ``depth`` rows of that key that precede the chunk."""
    names = scan.partition()
    backwards = Window.partitionBy(*names).orderBy(*[_sort_column(c, reverse=True) for c in scan.order])
    tail = scan.df.withColumn("_from_end", F.row_number().over(backwards)).filter(
        F.col("_from_end") <= depth
    )
    # One row per chunk and key; a key has at most as many rows here as there are chunks.
    along = Window.partitionBy(*scan.keys).orderBy(CHUNK) if scan.keys else Window.orderBy(CHUNK)
    sizes = scan.df.groupBy(*names).agg(F.count("*").alias("_size"))
    sizes = sizes.withColumn("_end", F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    later = F.collect_list(F.struct(F.col(CHUNK).alias("target"), (F.col("_end") - F.col("_size")).alias("start")))
    reach = (
        sizes.withColumn("_later", later.over(along.rowsBetween(1, depth)))
        .withColumn("_to", F.explode("_later"))
        .select(*names, F.col("_to.target").alias("_target"), (F.col("_to.start") - F.col("_end")).alias("_between"))
        .filter(F.col("_between") < depth)
    )
    joined = tail.join(reach, null_safe(tail, reach, names)).filter(
        F.col("_from_end") + F.col("_between") <= depth
    )
    columns = [reach["_target"].alias(CHUNK) if c == CHUNK else tail[c] for c in scan.df.columns]
    return joined.select(*columns)


def running(
    scan: Ordered,
    specs: dict[str, tuple[str, Column]],
    by: Sequence[str] = (),
    inclusive: bool = False,
) -> Ordered:
    """Add running ``sum``/``count``/``max``/``min`` columns over all earlier rows of the key.

    ``by`` refines the key (for example a season inside a player's history).
    """
    kinds = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    last = 0 if inclusive else -1
    frame = scan.window(by).rowsBetween(Window.unboundedPreceding, last)
    rows = scan.df.withColumns({n: kinds[k](e).over(frame) for n, (k, e) in specs.items()})
    if not scan.chunked:
        return scan.with_df(rows)
    names = scan.partition(by)
    within = [c for c in names if c != CHUNK]
    along = Window.partitionBy(*within).orderBy(CHUNK) if within else Window.orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    totals = scan.df.groupBy(*names).agg(*[kinds[k](e).alias(n) for n, (k, e) in specs.items()])
    merge = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
    carried = totals.select(
        *[F.col(n).alias(f"_k{i}") for i, n in enumerate(names)],
        *[merge[k](n).over(before).alias(f"_carry_{n}") for n, (k, _) in specs.items()],
    )
    same = reduce(lambda a, b: a & b, [rows[n].eqNullSafe(carried[f"_k{i}"]) for i, n in enumerate(names)])
    joined = rows.join(carried, same, "left")
    combined = {n: _combine(k, F.col(n), F.col(f"_carry_{n}")) for n, (k, _) in specs.items()}
    return scan.with_df(joined.withColumns(combined).select(*rows.columns))


def _combine(kind: str, here: Column, carried: Column) -> Column:
    if kind == "max":
        return F.greatest(here, carried)
    if kind == "min":
        return F.least(here, carried)
    if kind == "count":
        return here + F.coalesce(carried, F.lit(0))
    return F.coalesce(here + carried, here, carried)


def with_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], how: str = "left", nulls_match: bool = False) -> DataFrame:
    """Join one row per key to rows of which very many may share a key.

    The totals are stored first. A join that reads an aggregate of its own stage cannot be
    divided, as the aggregate needs its key in one task; a join of two scans can, and the
    adaptive planner splits the hot key's rows over tasks that each read its one total.
    """
    stored = materialize(totals)
    if not nulls_match:
        return rows.join(stored, list(keys), how)
    added = [c for c in stored.columns if c not in keys]
    joined = rows.join(stored, null_safe(rows, stored, keys), how)
    return joined.select(*[rows[c] for c in rows.columns], *[stored[c] for c in added])


def dealt(left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int) -> list[tuple[DataFrame, DataFrame]]:
    """Both sides of an equi-join in ``parts`` by the hash of their keys; each pair can be joined on its own."""
    if parts == 1:
        return [(left, right)]
    types = [right.schema[c].dataType for c in keys]
    part = F.pmod(F.xxhash64(*[F.col(c).cast(t) for c, t in zip(keys, types, strict=True)]), F.lit(parts))
    return [(left.filter(part == k), right.filter(part == k)) for k in range(parts)]


def exact_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, at position ``(n - 1) p``.

    Equal values are counted first; ranks then come from a running count, so no task
    holds a whole group.
    """
    groups = list(groups)
    # Stored: the group sizes, the ranks and the totals are read from it.
    counts = materialize(df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n")))
    scan = ordered(counts, groups, [value])
    ranked = running(scan, {"_end": ("sum", F.col("_n"))}, inclusive=True).result()
    size = counts.groupBy(*groups).agg(F.sum("_n").alias("_total"))
    if groups:
        both = with_totals(ranked, size, groups, "inner", nulls_match=True)
    else:
        both = with_one_row(ranked, size)
    picks = []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("_end") - F.col("_n") <= rank) & (rank < F.col("_end"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"_{name}_{side}"))
    found = both.groupBy(*groups).agg(F.max("_total").alias("_total"), *picks)
    outputs = []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*groups, *outputs)


#: Rank error of the engine's quantile sketch is one in so many.
_ACCURACY = 10_000


def wide_medians(rows: DataFrame, columns: Sequence[str], exact_below: int = 100_000) -> dict[str, float | None]:
    """Exact median of every column, without a copy of a row for each of them.

    Every pass is one aggregation over all columns. A quantile sketch gives each column a
    bracket that holds its middle ranks; the next pass counts what lies below and inside. A
    bracket of more than ``exact_below`` values is narrowed again, each time ten-thousandfold;
    then its middle ranks are read off exactly. The driver holds a few numbers per column.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    margin = 2 / _ACCURACY
    picks = [F.percentile_approx(value[c], [0.5 - margin, 0.5 + margin], _ACCURACY).alias(f"b{i}") for i, c in enumerate(columns)]
    first = rows.agg(*[F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)], *picks).first()
    size = {c: first[f"n{i}"] for i, c in enumerate(columns)}
    bracket = {c: tuple(first[f"b{i}"]) for i, c in enumerate(columns) if size[c]}
    medians: dict[str, float | None] = {c: None for c in columns if not size[c]}
    narrowest: set[str] = set()  # brackets that the sketch cannot narrow: a few values, often repeated
    while bracket:
        names = list(bracket)
        inside = {c: F.when(value[c].between(*map(F.lit, bracket[c])), value[c]) for c in names}
        counts = rows.agg(
            *[F.count_if(value[c] < F.lit(bracket[c][0])).alias(f"l{i}") for i, c in enumerate(names)],
            *[F.count(inside[c]).alias(f"n{i}") for i, c in enumerate(names)],
        ).first()
        asked, wider = [], {}
        for i, c in enumerate(names):
            low, high = bracket[c]
            ranks = [k - counts[f"l{i}"] for k in ((size[c] - 1) // 2, size[c] // 2)]
            held = counts[f"n{i}"]
            if low == high:
                medians[c] = low
                del bracket[c]
            elif held <= exact_below or c in narrowest:
                asked.append(F.percentile(inside[c], [r / (held - 1) for r in ranks]).alias(c))
                wider[c] = True
            else:
                slack = held // _ACCURACY + 1
                ends = [max(0.0, (ranks[0] - slack) / held), min(1.0, (ranks[1] + 1 + slack) / held)]
                asked.append(F.percentile_approx(inside[c], ends, _ACCURACY).alias(c))
                wider[c] = False
        found = rows.agg(*asked).first() if asked else {}
        for c, done in wider.items():
            if done:
                medians[c] = sum(found[c]) / 2
                del bracket[c]
            else:
                if tuple(found[c]) == bracket[c]:
                    narrowest.add(c)
                bracket[c] = tuple(found[c])
    return medians
