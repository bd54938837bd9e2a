"""Count projections: Poisson scores of lines and receptions projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import poisson

# Reported quantiles and label.
QUANTILES = {"floor": 0.10, "median": 0.50, "ceiling": 0.90}
MODEL_LABEL = "Baseline Poisson WR receptions model (not production-grade)"
INPUTS = ["projected_team_pass_attempts", "route_participation", "targets_per_route_run", "catch_probability"]


def score_lines(rows: DataFrame, rate: str = "rate", line: str = "line") -> DataFrame:
    """Over, under and push probability and the three quantiles of each rate and line.

    Every row is scored where it lies; a null rate or line gives null scores, and so does a
    rate that is none (negative or not finite).
    """
    r, at = F.col(rate).cast("double"), F.col(line).cast("double")
    usable = (r >= 0) & (r < float("inf"))
    scored = rows.withColumn("_s", poisson.line_scores(r, at, QUANTILES))
    return scored.select(
        "*",
        *[F.when(usable & at.isNotNull(), F.col(f"_s.{c}")).alias(f"{c}_probability") for c in ("over", "under", "push")],
        *[F.when(usable, F.col(f"_s.{n}")).alias(n) for n in QUANTILES],
    ).drop("_s")


def projection_rules() -> dict[str, Column]:
    """Violating conditions of projection inputs."""
    share = lambda c: ~F.col(c).between(0, 1)
    return {
        "attempts_negative": F.col(INPUTS[0]) < 0,
        **{f"{c}_out_of_range": share(c) for c in INPUTS[1:]},
        "line_negative": F.col("line") < 0,
        "multiplier_not_positive": F.exists(F.map_values("contextual_multipliers"), lambda v: v <= 0),
    }


def project_receptions(rows: DataFrame) -> DataFrame:
    """Projected targets and receptions with line probabilities and the inputs used."""
    context = F.aggregate(F.map_values("contextual_multipliers"), F.lit(1.0), lambda a, v: a * v)
    targets = F.col(INPUTS[0]) * F.col(INPUTS[1]) * F.col(INPUTS[2]) * F.coalesce(context, F.lit(1.0))
    base = F.create_map(*[v for c in INPUTS for v in (F.lit(c), F.col(c).cast("double"))])
    used = F.map_concat(base, F.coalesce("contextual_multipliers", F.create_map().cast("map<string,double>")))
    rows = rows.withColumns({"projected_targets": targets, "assumptions_used": used, "model_label": F.lit(MODEL_LABEL)})
    rows = rows.withColumn("projected_receptions", F.col("projected_targets") * F.col(INPUTS[3]))
    return score_lines(rows, "projected_receptions", "line")
