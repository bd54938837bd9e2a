"""Governed evaluations: baselines, one learned model, expanding windows.

Baselines are computed once as columns of the feature table; cohorts, windows and scores
are filters, tags and aggregates on that one table.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import evaluation as ev
from tallyfield.operators import poisson_model as pm
from tallyfield.operators import resample
from tallyfield.plans.registry import FEATURE_NAMES
from tallyfield.session import materialize, with_one_row

LEARNED = "learned"
#: What baselines, cohorts and scores read of a feature table, and what the failure report adds.
SCORED_INPUTS = (*ev.KEY, "kickoff", "actual_receptions", "receptions_season_mean", "receptions_lag1", "receptions_roll3", "receptions_roll5")
REPORT_INPUTS = ("team", "opponent", "is_home", "game_week", "games_played_before", "targets_roll5", "rest_days")


@dataclass(frozen=True)
class Window:
    window_id: str
    start: datetime
    end: datetime


def check_windows(training_start: datetime, windows: list[Window]) -> None:
    if not windows or len({w.window_id for w in windows}) != len(windows):
        raise ValueError("windows must exist and have unique ids")
    previous = None
    for w in windows:
        if training_start >= w.start or w.end < w.start or (previous is not None and previous >= w.start):
            raise ValueError("windows must be ordered, not overlap, and start after the training start")
        previous = w.end


def rows_to_windows(rows: DataFrame, training_start: datetime, windows: list[Window]) -> DataFrame:
    """Tag each row with every (window, role) it belongs to.

    The windows are a configured list, so membership is a filter on a literal array inside
    the row: no join and no shuffle.
    """
    check_windows(training_start, windows)
    kind = rows.schema["kickoff"].dataType
    at = lambda v: F.lit(v).cast(kind)
    members = []
    for order, w in enumerate(windows):
        for role, low, high in (
            ("training", training_start, w.start - timedelta(microseconds=1)),
            ("held_out", w.start, w.end),
        ):
            members.append(
                F.when(
                    F.col("kickoff").between(at(low), at(high)),
                    F.struct(
                        F.lit(w.window_id).alias("window_id"), F.lit(order).alias("window_order"), F.lit(role).alias("role")
                    ),
                )
            )
    return rows.select("*", F.inline(F.array_compact(F.array(*members))))


def with_baselines_of(features: DataFrame, *others: str) -> DataFrame:
    """Baselines beside the columns that an evaluation reads; the others of a wide table are not carried along.

    Rows that have their baselines already, as those shared by several evaluations, keep them.
    """
    names = dict.fromkeys([*SCORED_INPUTS, *others])
    if "baselines" in features.columns:
        return features.select(*names, "baselines")
    return ev.with_baselines(features.select(*names)).select(*names, "baselines")


def _pivot_predictions(cohort: DataFrame) -> DataFrame:
    """Actual and one column per baseline."""
    pick = lambda n: F.filter("baselines", lambda b: b["baseline"] == n)[0]["prediction"]
    return cohort.select(
        *ev.KEY, F.col("actual_receptions").cast("double").alias("actual"), *[pick(n).alias(n) for n in ev.BASELINES]
    )


def evaluate_baselines(
    features: DataFrame,
    validation: tuple[datetime, datetime],
    evaluation_keys: DataFrame | None = None,
    iterations: int = resample.ITERATIONS,
    seed: int = resample.SEED,
    based: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Metrics, calibration, strongest baseline, comparisons and failure report.

    ``based`` names the same rows with their baselines, where they are known already.
    """
    based = with_baselines_of(features if based is None else based, *REPORT_INPUTS)
    held_out = ev.period_filter(based, *validation)
    if evaluation_keys is not None:
        held_out = ev.restrict_to_keys(held_out, evaluation_keys)
    held_out = materialize(held_out)
    cohort = ev.shared_cohort(held_out)
    scored = ev.scored(cohort)
    metrics = materialize(
        ev.regression_metrics(scored, ["model"]).join(
            ev.coverage(held_out).select(F.col("baseline").alias("model"), "coverage"), "model"
        )
    )
    strongest = ev.strongest_baseline(metrics).first()["strongest_baseline"]
    if strongest is None:
        raise ValueError("no row is covered by every baseline")
    others = [n for n in ev.BASELINES if n != strongest]
    errors = ev.errors_of(cohort, F.lit(strongest))
    status = (
        F.when(F.col("model") == strongest, "STRONGEST_BASELINE")
        .when(F.col("model") == "career_average", "DIAGNOSTIC")
        .otherwise("REFERENCE")
    )
    return {
        "metrics": metrics.withColumn("status", status),
        "calibration": ev.calibration_table(scored, ["model"]),
        "comparisons": resample.paired_mae_bootstrap(
            _pivot_predictions(cohort), ev.KEY, strongest, others, iterations=iterations, seed=seed
        ).withColumn("reference", F.lit(strongest)),
        "segments": ev.segment_metrics(errors),
        "bias": ev.group_bias(errors),
        "largest_errors": ev.largest_errors(errors),
        "missing_features": ev.missing_feature_rates(features, FEATURE_NAMES),
        "decision": metrics.sparkSession.createDataFrame([("RESEARCH", strongest)], "decision string, strongest_baseline string"),
    }


def evaluate_rolling(
    features: DataFrame,
    training_start: datetime,
    windows: list[Window],
    config: pm.PoissonConfig = pm.PoissonConfig(),
    iterations: int = resample.ITERATIONS,
    seed: int = resample.SEED,
) -> dict[str, DataFrame]:
    """Fit every window, score it on the shared cohort, pool the held-out rows.

    All windows share each Newton step, each metric pass and the pooled resamples.
    """
    tagged = rows_to_windows(with_baselines_of(features, config.target, *config.features), training_start, windows)
    tagged = materialize(tagged)
    complete = ev.complete_cases(tagged, config.features)
    models = pm.with_fingerprint(pm.fit_poisson(complete.filter(F.col("role") == "training"), config))
    models = materialize(models)
    held_out = tagged.filter(F.col("role") == "held_out")
    cohort = ev.shared_cohort(ev.complete_cases(held_out, config.features))
    # A window's rows are scored by its own model; one model row per window.
    predicted = materialize(pm.predict_poisson(cohort, models, config))
    scored = ev.scored(predicted, ["window_id"]).unionByName(
        predicted.select(
            *ev.KEY,
            "window_id",
            F.col("actual_receptions").cast("double").alias("actual"),
            F.lit(LEARNED).alias("model"),
            F.col("learned").alias("prediction"),
        )
    )
    metrics = materialize(ev.regression_metrics(scored, ["window_id", "model"]))
    strongest = materialize(ev.strongest_baseline(metrics, ["window_id"]))
    # One row per configured window.
    named = predicted.join(F.broadcast(strongest), "window_id")
    chosen = F.filter("baselines", lambda b: b["baseline"] == F.col("strongest_baseline"))[0]["prediction"]
    aligned = materialize(
        named.select(
            *ev.KEY,
            "window_id",
            F.col("actual_receptions").cast("double").alias("actual"),
            "learned",
            chosen.alias("baseline"),
        )
    )
    pair = aligned.select(
        "window_id",
        "actual",
        F.inline(
            F.array(
                F.struct(F.lit("learned").alias("model"), F.col("learned").alias("prediction")),
                F.struct(F.lit("baseline").alias("model"), F.col("baseline").alias("prediction")),
            )
        ),
    )
    by_window = ev.regression_metrics(pair, ["window_id", "model"])
    pooled = ev.regression_metrics(pair, ["model"])
    coverage = held_out.groupBy("window_id").agg(F.count("*").alias("held_out_rows"))
    order = models.sparkSession.createDataFrame(
        [(w.window_id, i) for i, w in enumerate(windows)], "window_id string, window_order int"
    )
    coefficients = pm.raw_coefficients(models)
    duplicates = aligned.groupBy(*ev.KEY).agg(F.count("*").alias("rows")).filter("rows > 1")
    if duplicates.take(1):
        raise ValueError("held-out rows belong to more than one window")
    return {
        "models": models,
        "window_metrics": by_window.join(coverage, "window_id").join(strongest, "window_id"),
        "pooled_metrics": pooled.withColumn("coverage", F.lit(1.0)),
        "window_differences": ev.metric_differences(by_window, ["window_id"], "learned", "baseline"),
        "pooled_differences": ev.metric_differences(pooled, [], "learned", "baseline"),
        "residuals": ev.residual_summary(pair, ["window_id", "model"]),
        "bias": ev.prediction_bias(by_window, ["window_id"], "learned", "baseline"),
        "intervals": resample.paired_metric_bootstrap(
            aligned, ev.KEY, "baseline", "learned", iterations=iterations, seed=seed
        ),
        "stability": ev.coefficient_stability(coefficients.join(F.broadcast(order), "window_id")),
        "aligned": aligned,
    }


def evaluate_learned(
    features: DataFrame,
    training: tuple[datetime, datetime],
    validation: tuple[datetime, datetime],
    config: pm.PoissonConfig = pm.PoissonConfig(),
    iterations: int = resample.ITERATIONS,
    seed: int = resample.SEED,
) -> dict[str, DataFrame]:
    """One model against the strongest baseline on identical rows, with the four gates."""
    rows = materialize(with_baselines_of(features, config.target, *config.features))
    fit_rows, held_out = ev.chronological_split(rows, training, validation)
    fit_rows = ev.complete_cases(fit_rows, config.features).withColumn("window_id", F.lit("all"))
    models = materialize(pm.with_fingerprint(pm.fit_poisson(fit_rows, config)))
    cohort = ev.shared_cohort(ev.complete_cases(held_out, config.features)).withColumn("window_id", F.lit("all"))
    predicted = materialize(pm.predict_poisson(cohort, models, config))
    base_metrics = materialize(ev.regression_metrics(ev.scored(predicted), ["model"]))
    strongest = ev.strongest_baseline(base_metrics).first()["strongest_baseline"]
    if strongest is None:
        raise ValueError("the learned model has no rows in the shared cohort")
    chosen = F.filter("baselines", lambda b: b["baseline"] == strongest)[0]["prediction"]
    aligned = materialize(
        predicted.select(
            *ev.KEY, F.col("actual_receptions").cast("double").alias("actual"), "learned", chosen.alias("baseline")
        )
    )
    learned = ev.regression_metrics(
        aligned.select("actual", F.col("learned").alias("prediction"), F.lit(LEARNED).alias("model")), ["model"]
    )
    total = held_out.agg(F.count("*").alias("_all"))
    learned = with_one_row(learned, total).withColumn("coverage", F.col("sample_count") / F.col("_all")).drop("_all")
    # One row; the gates read it too, and without a copy the resamples would be drawn again for them.
    comparison = materialize(
        resample.paired_mae_bootstrap(aligned, ev.KEY, "baseline", "learned", iterations=iterations, seed=seed)
    )
    base = base_metrics.filter(F.col("model") == strongest).select(
        F.col("mae").alias("b_mae"), F.col("calibration_error").alias("b_ece"), F.col("poisson_deviance").alias("b_dev")
    )
    both = with_one_row(with_one_row(learned, base), comparison.select("statistically_significant_improvement"))
    gates = both.select(
        (F.col("mae") < F.col("b_mae")).alias("lower_mae"),
        F.col("statistically_significant_improvement").alias("statistically_significant_mae_improvement"),
        (F.col("calibration_error") <= F.col("b_ece")).alias("equal_or_better_calibration"),
        (F.col("poisson_deviance") < F.col("b_dev")).alias("improved_poisson_deviance"),
        F.lit("RESEARCH").alias("decision"),
        F.lit(strongest).alias("strongest_baseline"),
    )
    return {
        "models": models,
        "metrics": base_metrics.unionByName(learned, allowMissingColumns=True),
        "comparison": comparison,
        "gates": gates,
        "aligned": aligned,
    }
