"""Poisson tail, mass, distribution and quantiles as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: counts are looked through up to here; a higher quantile is reported as this one.
QUANTILE_CAP = 1000
#: Lines above this use the running sum, whose plan does not grow with the line.
_UNROLL = 64


def over_fixed_line(rate: Column, line: float) -> Column:
    """P(X > line) for a line known at plan time: a nested product, plain arithmetic."""
    cutoff = int(line // 1)
    if cutoff > _UNROLL:
        return over(rate, F.lit(float(line)))
    series = F.lit(1.0)
    for k in range(cutoff, 0, -1):
        series = 1 + rate / k * series
    return F.when(rate == 0, 0.0).otherwise(_clamp(1 - F.exp(-rate) * series))


def _clamp(p: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))


def _fold(rate: Column, last: Column):
    """Running (log pmf, cdf) over 0..last; logs keep large rates from underflowing."""
    start = F.struct((-rate).alias("lp"), F.exp(-rate).alias("cdf"))
    steps = F.filter(F.sequence(F.lit(0), last.cast("int")), lambda k: k > 0)

    def step(acc, k):
        lp = acc["lp"] + F.ln(rate) - F.ln(k)
        return F.struct(lp.alias("lp"), (acc["cdf"] + F.exp(lp)).alias("cdf"))

    return F.aggregate(steps, start, step)


def cdf(value: Column, rate: Column) -> Column:
    """P(X <= value); zero below zero."""
    total = F.when(rate == 0, 1.0).otherwise(_fold(rate, F.greatest(value, F.lit(0)))["cdf"])
    return F.when(value < 0, 0.0).otherwise(total)


def pmf(value: Column, rate: Column) -> Column:
    mass = F.exp(_fold(rate, F.greatest(value, F.lit(0)))["lp"])
    return F.when(rate == 0, F.when(value == 0, 1.0).otherwise(0.0)).otherwise(mass)


def over(rate: Column, line: Column) -> Column:
    """P(X > line) with the cutoff at the whole part of the line."""
    return _clamp(1 - cdf(F.floor(line), rate))


def quantiles(rate: Column, probabilities: dict[str, float], cap: int = QUANTILE_CAP) -> Column:
    """Struct of the smallest counts whose distribution reaches each probability.

    One pass over the counts up to well above the highest quantile, at most ``cap``; a
    quantile equal to ``cap`` says "this or more".
    """
    last = F.least(F.lit(cap), F.ceil(rate + 10 * F.sqrt(rate) + 20)).cast("int")
    names = list(probabilities)

    def hit(total, p, k, before):
        return F.coalesce(before, F.when(total >= p, k))

    first = F.exp(-rate)
    start = F.struct(
        (-rate).alias("lp"),
        first.alias("cdf"),
        *[hit(first, probabilities[n], F.lit(0), F.lit(None).cast("int")).alias(n) for n in names],
    )
    steps = F.filter(F.sequence(F.lit(0), last), lambda k: k > 0)

    def step(acc, k):
        lp = acc["lp"] + F.ln(rate) - F.ln(k)
        total = acc["cdf"] + F.exp(lp)
        return F.struct(
            lp.alias("lp"), total.alias("cdf"), *[hit(total, probabilities[n], k, acc[n]).alias(n) for n in names]
        )

    found = F.aggregate(steps, start, step)
    return F.struct(*[F.when(rate == 0, 0).otherwise(F.coalesce(found[n], F.lit(cap))).alias(n) for n in names])


def line_scores(rate: Column, line: Column, probabilities: dict[str, float], cap: int = QUANTILE_CAP) -> Column:
    """Struct of ``over``, ``under`` and ``push`` of a line and the quantiles, by one pass over the counts.

    The sums are those of ``cdf``, ``pmf`` and ``quantiles``, for the different pairs of an Arrow
    batch at once. Rates have to be finite and not negative; a null line gives null chances.
    """
    schema = "over double, under double, push double, " + ", ".join(f"{n} int" for n in probabilities)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rates, lines in batches:
            pairs = np.stack([rates.to_numpy(float), lines.to_numpy(float)], axis=1)
            different, place = np.unique(pairs, axis=0, return_inverse=True)
            yield pd.DataFrame(_line_scores(different[:, 0], different[:, 1], probabilities, cap)).take(place.ravel())

    return F.pandas_udf(score, schema)(rate, line)


def _line_scores(rate: np.ndarray, line: np.ndarray, probabilities: dict[str, float], cap: int) -> dict[str, np.ndarray]:
    at = np.floor(line)
    below = np.where(at == line, at - 1, at)
    usable = np.isfinite(rate) & (rate >= 0)
    # A null line asks for nothing, one below zero for no mass.
    up_to, under, push = (np.where(np.isnan(line), np.nan, 0.0) for _ in range(3))
    found = {n: np.full(len(rate), cap, dtype=np.int32) for n in probabilities}
    todo = np.flatnonzero(usable)
    r = rate[todo]
    with np.errstate(divide="ignore", invalid="ignore"):
        step, lp = np.log(r), -r
    last = np.minimum(cap, np.ceil(r + 10 * np.sqrt(r) + 20))
    total, k = np.exp(lp), 0
    met = {n: np.zeros(len(todo), dtype=bool) for n in probabilities}
    while len(todo):
        mass = np.exp(lp)
        # Behind its peak the mass is zero for good once it is: nothing is added any more.
        over = (mass == 0) & (k > r)
        for values, asked in ((up_to, at[todo]), (under, below[todo])):
            here = (asked == k) | (over & (asked > k))
            values[todo[here]] = total[here]
        here = (at[todo] == k) & (at[todo] == line[todo])
        push[todo[here]] = mass[here]
        for n, p in probabilities.items():
            here = ~met[n] & (total >= p) & (k <= last)
            found[n][todo[here]] = k
            met[n] |= here
        stay = (k < last) | (~over & (at[todo] > k))
        if not stay.all():
            todo, r, step, lp, last, total = (v[stay] for v in (todo, r, step, lp, last, total))
            met = {n: v[stay] for n, v in met.items()}
        k += 1
        lp = lp + step - np.log(k)
        total = total + np.exp(lp)
    chances = {"over": np.clip(1 - up_to, 0, 1), "under": under, "push": push}
    return {c: np.where(usable, v, np.nan) for c, v in chances.items()} | found
