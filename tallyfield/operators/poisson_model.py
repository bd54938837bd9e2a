"""Penalised Poisson regression, fitted for all windows at once by distributed Newton steps."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.digests import row_digest
from tallyfield.session import materialize

# Default model.
MODEL_FEATURES = ("receptions_roll3", "targets_roll3", "home_indicator", "games_played_before")


class ModelFitError(RuntimeError):
    """The solver cannot produce a safe, converged fit."""


@dataclass(frozen=True)
class PoissonConfig:
    features: tuple[str, ...] = MODEL_FEATURES
    target: str = "actual_receptions"
    l2_penalty: float = 1.0
    max_iterations: int = 100
    tolerance: float = 1e-10
    linear_limit: float = 20.0
    epsilon: float = 1e-10
    minimum_rows: int = 4


@dataclass
class _Fit:
    rows: int
    means: np.ndarray
    scales: np.ndarray
    beta: np.ndarray
    start: object = None
    end: object = None
    iterations: int = 0
    converged: bool = False
    stats: dict = field(default_factory=dict)


MODEL_SCHEMA = (
    "window_id string, features array<string>, feature_means array<double>, feature_scales array<double>, "
    "intercept double, coefficients array<double>, training_rows long, period_start timestamp_ntz, "
    "period_end timestamp_ntz, iterations int, converged boolean"
)


def moments(rows: DataFrame, config: PoissonConfig, window: str = "window_id") -> DataFrame:
    """Population mean and deviation per window and feature, target mean, rows and period."""
    return rows.groupBy(window).agg(
        F.count("*").alias("rows"),
        F.avg(config.target).alias("target_mean"),
        F.min("kickoff").alias("start"),
        F.max("kickoff").alias("end"),
        *[f(c).alias(f"{c}:{n}") for c in config.features for n, f in (("mean", F.avg), ("scale", F.stddev_pop))],
    )


def standardize(rows: DataFrame, config: PoissonConfig, window: str = "window_id") -> DataFrame:
    """Scaled features; a nearly constant feature keeps scale one."""
    facts = moments(rows, config, window)
    joined = rows.join(F.broadcast(facts.drop("start", "end")), window)  # one row per window

    def scaled(c):
        scale = F.col(f"`{c}:scale`")
        return (F.col(c) - F.col(f"`{c}:mean`")) / F.when(scale > config.epsilon, scale).otherwise(1.0)

    return joined.select(*rows.columns, *[scaled(c).alias(f"{c}_z") for c in config.features])


def _states(spark: SparkSession, window: str, parameters: dict[str, tuple[_Fit, np.ndarray]]) -> DataFrame:
    """One small row per window: offset and slopes on the raw features."""
    out = []
    for key, (fit, beta) in parameters.items():
        slopes = beta[1:] / fit.scales
        out.append((key, float(beta[0] - slopes @ fit.means), slopes.tolist(), fit.means.tolist(), fit.scales.tolist()))
    schema = f"`{window}` string, _offset double, _slopes array<double>, _means array<double>, _scales array<double>"
    return F.broadcast(spark.createDataFrame(out, schema))


def _pass(data: DataFrame, window: str, config: PoissonConfig, parameters) -> dict[str, dict]:
    """Objective, gradient, Hessian and largest linear predictor per window; one aggregation."""
    d = len(config.features)
    rows = data.join(_states(data.sparkSession, window, parameters), window)
    eta = F.col("_offset") + sum(F.col(c) * F.col("_slopes")[i] for i, c in enumerate(config.features))
    z = [F.lit(1.0)] + [
        (F.col(c) - F.col("_means")[i]) / F.col("_scales")[i] for i, c in enumerate(config.features)
    ]
    rows = rows.select(window, F.col(config.target).alias("_y"), eta.alias("_eta"), *[v.alias(f"_z{i}") for i, v in enumerate(z)])
    rows = rows.withColumn("_mu", F.exp(F.least("_eta", F.lit(700.0))))
    sums = [
        F.max("_eta").alias("eta"),
        F.count_if(F.isnan("_eta")).alias("bad"),
        F.sum(F.col("_mu") - F.col("_y") * F.col("_eta")).alias("objective"),
    ]
    for i in range(d + 1):
        sums.append(F.sum(F.col(f"_z{i}") * (F.col("_y") - F.col("_mu"))).alias(f"g{i}"))
        for j in range(i, d + 1):
            sums.append(F.sum(F.col(f"_z{i}") * F.col(f"_z{j}") * F.col("_mu")).alias(f"h{i}_{j}"))
    found = {}
    for row in rows.groupBy(window).agg(*sums).collect():  # one row per configured window
        beta = parameters[row[window]][1]
        gradient = np.array([row[f"g{i}"] for i in range(d + 1)])
        hessian = np.empty((d + 1, d + 1))
        for i in range(d + 1):
            for j in range(i, d + 1):
                hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"]
        safe = row["bad"] == 0 and row["eta"] <= config.linear_limit
        objective = row["objective"] + 0.5 * config.l2_penalty * float(beta[1:] @ beta[1:])
        found[row[window]] = {
            "gradient": gradient,
            "hessian": hessian,
            "safe": safe,
            "objective": objective if safe else math.inf,
        }
    return found


def _newton_step(fit: _Fit, config: PoissonConfig) -> np.ndarray:
    d = len(config.features)
    gradient = fit.stats["gradient"] - config.l2_penalty * np.concatenate([[0.0], fit.beta[1:]])
    ridge = np.full(d + 1, config.l2_penalty)
    ridge[0] = config.epsilon
    hessian = fit.stats["hessian"] + np.diag(ridge)
    if np.linalg.cond(hessian) > 1 / np.finfo(float).eps:
        raise ModelFitError("singular Hessian")
    return np.linalg.solve(hessian, gradient)


def fit_poisson(rows: DataFrame, config: PoissonConfig = PoissonConfig(), window: str = "window_id") -> DataFrame:
    """One model row per window.

    Every Newton step is one aggregation over all windows. A full step is evaluated
    together with the next gradient; only when the objective rises are halved steps tried.
    """
    spark = rows.sparkSession
    kept = [window, "kickoff", config.target, *config.features]
    data = materialize(
        rows.select(
            F.col(window).cast("string").alias(window),
            "kickoff",
            *[F.col(c).cast("double").alias(c) for c in kept[2:]],
        )
    )
    fits: dict[str, _Fit] = {}
    for row in moments(data, config, window).collect():  # one row per configured window
        if row["rows"] < config.minimum_rows:
            raise ModelFitError(f"window {row[window]}: only {row['rows']} training rows")
        scales = np.array([row[f"{c}:scale"] for c in config.features])
        beta = np.zeros(len(config.features) + 1)
        beta[0] = math.log(max(row["target_mean"], config.epsilon))
        if beta[0] > config.linear_limit:
            raise ModelFitError("initial linear predictor exceeds the safe limit")
        means = np.array([row[f"{c}:mean"] for c in config.features])
        scales = np.where(scales > config.epsilon, scales, 1.0)
        fits[row[window]] = _Fit(row["rows"], means, scales, beta, row["start"], row["end"])
    if not fits:
        raise ModelFitError("no training rows")
    first = _pass(data, window, config, {k: (f, f.beta) for k, f in fits.items()})
    for key, fit in fits.items():
        fit.stats = first[key]
    for iteration in range(1, config.max_iterations + 1):
        active = {k: f for k, f in fits.items() if not f.converged}
        if not active:
            break
        if any(not f.stats["safe"] for f in active.values()):
            raise ModelFitError("unsafe linear predictor")
        steps = {k: _newton_step(f, config) for k, f in active.items()}
        size, waiting = 1.0, dict(active)
        while waiting:
            tried = {k: (f, f.beta + size * steps[k]) for k, f in waiting.items()}
            results = _pass(data, window, config, tried)
            for key in list(waiting):
                fit, result = waiting[key], results[key]
                if result["objective"] <= fit.stats["objective"] or (
                    # Sums arrive in varying order: a last-digit rise at the optimum is no rise.
                    np.max(np.abs(size * steps[key])) <= 1e-7
                    and result["objective"] <= fit.stats["objective"] * (1 + 1e-12) + 1e-9
                ):
                    fit.beta, fit.stats, fit.iterations = tried[key][1], result, iteration
                    fit.converged = bool(np.max(np.abs(size * steps[key])) <= config.tolerance)
                    del waiting[key]
            size /= 2
            if waiting and size < config.epsilon:
                raise ModelFitError("no stable update")
    if not all(f.converged for f in fits.values()):
        raise ModelFitError(f"no convergence within {config.max_iterations} iterations")
    out = [
        (
            key,
            list(config.features),
            f.means.tolist(),
            f.scales.tolist(),
            float(f.beta[0]),
            f.beta[1:].tolist(),
            f.rows,
            f.start,
            f.end,
            f.iterations,
            f.converged,
        )
        for key, f in sorted(fits.items())
    ]
    return spark.createDataFrame(out, MODEL_SCHEMA)


def with_fingerprint(models: DataFrame) -> DataFrame:
    return models.withColumn("fingerprint", row_digest([c for c in models.columns if c != "fingerprint"]))


def verify_models(models: DataFrame) -> DataFrame:
    """Model rows whose stored fingerprint does not match their content."""
    again = row_digest([c for c in models.columns if c != "fingerprint"])
    return models.filter(~again.eqNullSafe(F.col("fingerprint")))


def predict_poisson(rows: DataFrame, models: DataFrame, config: PoissonConfig = PoissonConfig(), window: str = "window_id") -> DataFrame:
    """Expected counts; null where a feature is missing. Models are one row per window."""
    states = F.broadcast(
        models.select(
            F.col("window_id").alias("_w"),
            F.col("feature_means").alias("_m"),
            F.col("feature_scales").alias("_s"),
            F.col("intercept").alias("_i"),
            F.col("coefficients").alias("_c"),
        )
    )
    joined = rows.join(states, F.col(window).cast("string") == F.col("_w"))
    eta: Column = F.col("_i")
    for i, c in enumerate(config.features):
        eta = eta + F.col("_c")[i] * (F.col(c).cast("double") - F.col("_m")[i]) / F.col("_s")[i]
    joined = joined.withColumn("_eta", eta)
    capped = F.when(F.col("_eta") > config.linear_limit, config.linear_limit).otherwise(F.col("_eta"))
    return joined.withColumn("learned", F.exp(capped)).drop("_w", "_m", "_s", "_i", "_c", "_eta")


def optimality(rows: DataFrame, models: DataFrame, config: PoissonConfig = PoissonConfig(), window: str = "window_id") -> DataFrame:
    """Certificate of a fit: per window and term the penalised gradient and curvature at the model.

    The objective is convex, so a zero gradient with positive curvature says that the stored
    coefficients are the optimum, whoever found them. One aggregation over the training rows.
    """
    predicted = predict_poisson(rows, models, config, window)
    facts = models.select(F.col("window_id").alias("_w"), "feature_means", "feature_scales", "coefficients")
    joined = predicted.join(F.broadcast(facts), F.col(window).cast("string") == F.col("_w"))  # one row per window
    residual, entries = F.col(config.target) - F.col("learned"), []
    for i, name in enumerate(("intercept", *config.features)):
        z = F.lit(1.0) if i == 0 else (F.col(name).cast("double") - F.col("feature_means")[i - 1]) / F.col("feature_scales")[i - 1]
        penalty, beta = (F.lit(0.0), F.lit(0.0)) if i == 0 else (F.lit(config.l2_penalty), F.col("coefficients")[i - 1])
        mean, scale = (F.lit(0.0), F.lit(1.0)) if i == 0 else (F.col("feature_means")[i - 1], F.col("feature_scales")[i - 1])
        entries.append(
            F.struct(
                F.lit(name).alias("term"), (z * residual).alias("g"), (z * z * F.col("learned")).alias("h"),
                (penalty * beta).alias("p"), penalty.alias("ridge"), mean.alias("mean"), scale.alias("scale"),
            )
        )
    terms = joined.select(F.col("_w").alias("window_id"), F.inline(F.array(*entries)))
    return terms.groupBy("window_id", "term").agg(
        F.count("*").alias("training_rows"),
        F.first("mean").alias("mean"),
        F.first("scale").alias("scale"),
        (F.sum("g") - F.first("p")).alias("gradient"),
        (F.sum("h") + F.first("ridge")).alias("curvature"),
    )


def raw_coefficients(models: DataFrame) -> DataFrame:
    """One row per window and feature: standardised and raw-scale coefficient."""
    zipped = F.arrays_zip("features", "coefficients", "feature_scales")
    return models.select("window_id", F.posexplode(zipped).alias("position", "_z")).select(
        "window_id",
        "position",
        F.col("_z.features").alias("feature_name"),
        F.col("_z.coefficients").alias("standardized"),
        (F.col("_z.coefficients") / F.col("_z.feature_scales")).alias("raw_scale"),
    )
