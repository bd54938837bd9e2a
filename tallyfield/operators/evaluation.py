"""Baseline forecasts and their evaluation: cohorts, metrics, calibration, residuals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.poisson import over_fixed_line
from tallyfield.operators.scan import exact_quantiles, ordered, running, wide_medians
from tallyfield.session import with_one_row

KEY = ["source_player_id", "game_id"]
# Baselines with level and distribution; the career mean is not governed.
BASELINES = {
    "league_mean": ("L0", "point"),
    "previous_game": ("L1", "point"),
    "rolling_3": ("L2", "point"),
    "rolling_5": ("L3", "point"),
    "season_to_date": ("L4", "point"),
    "career_average": ("L4", "point"),
    "poisson": ("L5", "poisson"),
}
GOVERNED = tuple(n for n in BASELINES if n != "career_average")
IMPLEMENTATION_VERSION = "1.0.0"
# Evaluation defaults.
CALIBRATION_LINE, CALIBRATION_BINS, DEVIANCE_EPSILON = 4.5, 10, 1e-12
ROOKIE_GAMES, HIGH_VOLUME_TARGETS, EARLY_WEEKS, BYE_REST_DAYS = 16, 7.0, 8, 13.0
SEGMENTS = (
    "rookies",
    "veterans",
    "low_volume",
    "high_volume",
    "early_season",
    "late_season",
    "home",
    "away",
    "after_bye",
)


def league_means(features: DataFrame) -> DataFrame:
    """Mean and count of all player-games in earlier games, one row per game.

    Games are summed first; the running total then runs over games, not over rows.
    """
    games = features.groupBy("kickoff", "game_id").agg(
        F.count("*").alias("_n"), F.sum("actual_receptions").cast("double").alias("_sum")
    )
    scan = running(
        ordered(games, [], ["kickoff", "game_id"]),
        {"league_count": ("sum", F.col("_n")), "_total": ("sum", F.col("_sum"))},
    )
    return scan.result().select(
        "kickoff",
        "game_id",
        F.coalesce("league_count", F.lit(0)).alias("league_count"),
        (F.col("_total") / F.col("league_count")).alias("league_mean"),
    )


def career_means(features: DataFrame) -> DataFrame:
    """Add the player's mean and count over earlier rows of this table."""
    scan = ordered(features, ["source_player_id"], ["kickoff", "game_id"])
    scan = running(
        scan,
        {"career_count": ("count", F.lit(1)), "_total": ("sum", F.col("actual_receptions").cast("double"))},
    )
    return scan.result().withColumn("career_mean", F.col("_total") / F.col("career_count")).drop("_total")


def with_baselines(features: DataFrame) -> DataFrame:
    """Add ``baselines``: one struct (name, prediction, history_count, eligible) per baseline."""
    rows = career_means(features).join(league_means(features), ["kickoff", "game_id"])
    career, league = F.col("career_count"), F.col("league_count")
    season, roll5 = F.col("receptions_season_mean"), F.col("receptions_roll5")
    has = lambda c: c.isNotNull().cast("long")
    values = {
        "league_mean": (F.col("league_mean"), league),
        "previous_game": (F.col("receptions_lag1"), career),
        "rolling_3": (F.col("receptions_roll3"), career),
        "rolling_5": (roll5, career),
        "season_to_date": (season, career),
        "career_average": (F.col("career_mean"), career),
        "poisson": (
            F.coalesce(season, roll5, F.col("career_mean"), F.col("league_mean")),
            F.greatest(career, has(season), has(roll5), league),
        ),
    }
    entries = []
    for name, (prediction, history) in values.items():
        eligible = prediction.isNotNull() & (history >= 1)
        entries.append(
            F.struct(
                F.lit(name).alias("baseline"),
                F.when(eligible, prediction.cast("double")).alias("prediction"),
                history.cast("long").alias("history_count"),
                eligible.alias("eligible"),
            )
        )
    return rows.withColumn("baselines", F.array(*entries))


def baseline_predictions(features: DataFrame, baselines=tuple(BASELINES)) -> DataFrame:
    """Long form: one row per player-game and baseline, without looking at the outcome."""
    level = F.create_map(*[F.lit(v) for n, (lv, _) in BASELINES.items() for v in (n, lv)])
    kind = F.create_map(*[F.lit(v) for n, (_, d) in BASELINES.items() for v in (n, d)])
    rows = with_baselines(features).select(*KEY, "season", "kickoff", "actual_receptions", F.inline("baselines"))
    if set(baselines) != set(BASELINES):
        rows = rows.filter(F.col("baseline").isin(*baselines))
    return rows.select(
        *KEY,
        "season",
        "kickoff",
        F.col("actual_receptions").cast("double").alias("actual_receptions"),
        "baseline",
        level[F.col("baseline")].alias("baseline_level"),
        F.lit(IMPLEMENTATION_VERSION).alias("implementation_version"),
        kind[F.col("baseline")].alias("distribution"),
        "prediction",
        "history_count",
        "eligible",
        F.when(~F.col("eligible"), "insufficient_history").alias("exclusion_reason"),
    )


# --- cohorts --------------------------------------------------------------------------


def period_filter(rows: DataFrame, start, end, column: str = "kickoff") -> DataFrame:
    """Rows inside the inclusive period, bounds read in UTC."""
    kind = rows.schema[column].dataType.simpleString()
    return rows.filter(F.col(column).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def chronological_split(rows: DataFrame, training: tuple, evaluation: tuple) -> tuple[DataFrame, DataFrame]:
    """Training and evaluation rows of two periods that must not overlap."""
    if not training[0] <= training[1] < evaluation[0] <= evaluation[1]:
        raise ValueError("the training period must end before the evaluation period starts")
    return period_filter(rows, *training), period_filter(rows, *evaluation)


def complete_cases(rows: DataFrame, features) -> DataFrame:
    return rows.dropna(subset=list(features))


def restrict_to_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys.select(*KEY), KEY, "left_semi")


def shared_cohort(wide: DataFrame) -> DataFrame:
    """Rows on which every baseline is eligible: a row-local test, no shuffle."""
    return wide.filter(F.forall("baselines", lambda b: b["eligible"]))


def coverage(wide: DataFrame) -> DataFrame:
    """Share of rows each baseline covers."""
    long = wide.select(F.inline("baselines"))
    return long.groupBy("baseline").agg(
        (F.count_if("eligible") / F.count("*")).alias("coverage"), F.count_if("eligible").alias("eligible_rows")
    )


def shared_cohort_of_predictions(predictions: DataFrame, names=tuple(BASELINES)) -> DataFrame:
    """Keys of long-form predictions on which all named baselines are eligible."""
    chosen = predictions.filter(F.col("baseline").isin(*names))
    counted = chosen.groupBy(*KEY).agg(F.count_if("eligible").alias("_n"))
    return counted.filter(F.col("_n") == len(names)).select(*KEY)


def scored(cohort: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Long form of a cohort: actual and prediction per baseline."""
    return cohort.select(
        *KEY, *extra, F.col("actual_receptions").cast("double").alias("actual"), F.inline("baselines")
    ).select(*KEY, *extra, "actual", F.col("baseline").alias("model"), "prediction")


# --- metrics --------------------------------------------------------------------------


def deviance_term(actual: Column, prediction: Column, epsilon: float = DEVIANCE_EPSILON) -> Column:
    mu = F.greatest(prediction, F.lit(epsilon))
    return F.when(actual == 0, 2 * mu).otherwise(2 * (actual * F.ln(actual / mu) - (actual - mu)))


def calibration_table(
    rows: DataFrame, groups: list[str], line: float = CALIBRATION_LINE, bins: int = CALIBRATION_BINS
) -> DataFrame:
    """Fixed-width bins of P(count > line), empty bins included."""
    p = over_fixed_line(F.col("prediction"), line)
    binned = rows.select(
        *groups,
        p.alias("_p"),
        F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"),
        (F.col("actual") > line).cast("double").alias("_hit"),
    )
    filled = binned.groupBy(*groups, "bin").agg(
        F.count("*").alias("count"), F.avg("_p").alias("mean_probability"), F.avg("_hit").alias("observed_rate")
    )
    # The group list follows from the filled bins, so the rows are not read again.
    packed = filled.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("count", "mean_probability", "observed_rate")))).alias("_b")
    )
    every = packed.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    found = F.try_element_at(F.col("_b"), F.col("bin"))
    return every.select(
        *groups,
        "bin",
        (F.col("bin") / bins).alias("lower"),
        ((F.col("bin") + 1) / bins).alias("upper"),
        F.coalesce(found["count"], F.lit(0)).alias("count"),
        found["mean_probability"].alias("mean_probability"),
        found["observed_rate"].alias("observed_rate"),
        F.abs(found["mean_probability"] - found["observed_rate"]).alias("gap"),
    )


def regression_metrics(
    rows: DataFrame,
    groups: list[str],
    line: float = CALIBRATION_LINE,
    bins: int = CALIBRATION_BINS,
    epsilon: float = DEVIANCE_EPSILON,
) -> DataFrame:
    """MAE, RMSE, bias, prediction variance, Poisson deviance and calibration error per group.

    Rows collapse to (group, probability bin) first; every metric is a sum over bins, so
    the input is aggregated exactly once.
    """
    error = F.col("prediction") - F.col("actual")
    p = over_fixed_line(F.col("prediction"), line)
    cells = rows.select(
        *groups,
        error.alias("_e"),
        F.col("prediction").alias("_y"),
        deviance_term(F.col("actual"), F.col("prediction"), epsilon).alias("_d"),
        p.alias("_p"),
        F.least(F.floor(p * bins), F.lit(bins - 1)).alias("_bin"),
        (F.col("actual") > line).cast("double").alias("_hit"),
    )
    per_bin = cells.groupBy(*groups, "_bin").agg(
        F.count("*").alias("_n"),
        F.sum(F.abs("_e")).alias("_abs"),
        F.sum(F.col("_e") * F.col("_e")).alias("_sq"),
        F.sum("_e").alias("_err"),
        F.avg("_y").alias("_my"),
        F.var_pop("_y").alias("_vy"),
        F.sum("_d").alias("_dev"),
        F.avg("_p").alias("_mp"),
        F.avg("_hit").alias("_mh"),
    )
    n = F.sum("_n")
    mean = F.sum(F.col("_n") * F.col("_my")) / n
    second = F.sum(F.col("_n") * (F.col("_vy") + F.col("_my") * F.col("_my"))) / n
    return per_bin.groupBy(*groups).agg(
        n.alias("sample_count"),
        (F.sum("_abs") / n).alias("mae"),
        F.sqrt(F.sum("_sq") / n).alias("rmse"),
        (F.sum("_err") / n).alias("bias"),
        (second - mean * mean).alias("prediction_variance"),
        (F.sum("_dev") / n).alias("poisson_deviance"),
        (F.sum(F.col("_n") * F.abs(F.col("_mp") - F.col("_mh"))) / n).alias("calibration_error"),
    )


def residual_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mean, extremes, exact quantiles and mean absolute residual per group."""
    residuals = rows.select(*groups, (F.col("prediction") - F.col("actual")).alias("residual"))
    basics = residuals.groupBy(*groups).agg(
        F.count("*").alias("sample_count"),
        F.avg("residual").alias("mean"),
        F.min("residual").alias("minimum"),
        F.max("residual").alias("maximum"),
        F.avg(F.abs("residual")).alias("mean_absolute"),
    )
    wanted = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    shape = exact_quantiles(residuals, groups, "residual", wanted)
    return basics.join(shape, groups) if groups else with_one_row(basics, shape)


def prediction_bias(metrics: DataFrame, groups: list[str], learned: str, baseline: str) -> DataFrame:
    """Learned against baseline mean bias from metric rows (column ``model``)."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("bias")))
    both = metrics.groupBy(*groups).agg(pick(learned).alias("learned_mean_bias"), pick(baseline).alias("baseline_mean_bias"))
    lb, bb = F.col("learned_mean_bias"), F.col("baseline_mean_bias")
    return both.withColumns(
        {
            "absolute_learned_bias": F.abs(lb),
            "absolute_baseline_bias": F.abs(bb),
            "signed_difference": lb - bb,
            "absolute_bias_difference": F.abs(lb) - F.abs(bb),
        }
    )


def metric_differences(metrics: DataFrame, groups: list[str], learned: str, baseline: str) -> DataFrame:
    """Learned minus baseline for MAE, RMSE, deviance and bias, one row per metric."""
    names = ["mae", "rmse", "poisson_deviance", "bias"]
    sign = F.when(F.col("model") == learned, 1).when(F.col("model") == baseline, -1)
    wide = metrics.groupBy(*groups).agg(*[F.sum(sign * F.col(n)).alias(n) for n in names])
    entries = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("difference")) for n in names]
    return wide.select(*groups, F.inline(F.array(*entries)))


def strongest_baseline(metrics: DataFrame, groups: list[str] = (), governed=GOVERNED) -> DataFrame:
    """Governed baseline with the lowest MAE, ties by name."""
    eligible = metrics.filter(F.col("model").isin(*governed))
    return eligible.groupBy(*groups).agg(F.min_by("model", F.struct("mae", "model")).alias("strongest_baseline"))


# --- failure report -------------------------------------------------------------------


def errors_of(cohort: DataFrame, model: str | Column) -> DataFrame:
    """Actual, prediction and error of one baseline with the game context beside it."""
    chosen = F.filter("baselines", lambda b: b["baseline"] == model)[0]["prediction"]
    return cohort.withColumns(
        {"actual": F.col("actual_receptions").cast("double"), "prediction": chosen}
    ).withColumn("error", F.col("prediction") - F.col("actual"))


def segment_column() -> Column:
    """Names of all (overlapping) segments a row belongs to."""
    games, targets, week = F.col("games_played_before"), F.col("targets_roll5"), F.col("game_week")
    member = {
        "rookies": games <= ROOKIE_GAMES,
        "veterans": games > ROOKIE_GAMES,
        "low_volume": targets < HIGH_VOLUME_TARGETS,
        "high_volume": targets >= HIGH_VOLUME_TARGETS,
        "early_season": week <= EARLY_WEEKS,
        "late_season": week > EARLY_WEEKS,
        "home": F.col("is_home") == 1,
        "away": F.col("is_home") != 1,
        "after_bye": F.col("rest_days") >= BYE_REST_DAYS,
    }
    return F.array_compact(F.array(*[F.when(member[s], s) for s in SEGMENTS]))


def segment_metrics(errors: DataFrame) -> DataFrame:
    """Metrics per segment; an empty segment keeps a zero count and a warning."""
    tagged = errors.select("actual", "prediction", F.explode(segment_column()).alias("segment"))
    found = regression_metrics(tagged, ["segment"])
    spark = errors.sparkSession
    names = spark.createDataFrame([(s,) for s in SEGMENTS], "segment string")
    listed = names.join(found, "segment", "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    warning = F.when(
        F.col("sample_count") == 0, F.concat(F.lit("Segment "), F.col("segment"), F.lit(" has no evaluable rows."))
    )
    return listed.withColumn("warning", warning)


def group_bias(errors: DataFrame) -> DataFrame:
    """Mean error by player, team and opponent through grouping sets."""
    columns = ["source_player_id", "team", "opponent"]
    sets = errors.select(*columns, "error").groupingSets([[c] for c in columns], *columns)
    grouped = sets.agg(F.avg("error").alias("bias"), *[F.grouping(c).alias(f"_g_{c}") for c in columns])
    dimension = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, c) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in columns])
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "bias")


def largest_errors(errors: DataFrame, limit: int = 10) -> DataFrame:
    """Top over- and under-predictions; a bounded top-k per direction."""
    columns = [*KEY, "team", "opponent", "actual", "prediction", "error"]
    parts = []
    for direction, wrong, by in (
        ("over", F.col("error") > 0, F.col("error").desc()),
        ("under", F.col("error") < 0, F.col("error").asc()),
    ):
        top = errors.filter(wrong).orderBy(by, "game_id", "source_player_id").limit(limit)
        parts.append(top.select(F.lit(direction).alias("direction"), *columns))
    return parts[0].unionByName(parts[1])


def missing_feature_rates(rows: DataFrame, features) -> DataFrame:
    """Share of missing values per feature; one scan."""
    wide = rows.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in features])
    entries = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_rate")) for c in features]
    return wide.select(F.inline(F.array(*entries)))


# --- audit ----------------------------------------------------------------------------


def history_tier(games: Column) -> Column:
    return (
        F.when(games == 0, "rookie_or_no_history")
        .when(games < 3, "one_to_two")
        .when(games < 6, "three_to_five")
        .otherwise("six_plus")
    )


def audit_features(rows: DataFrame, features) -> DataFrame:
    """Per feature: missing rate, extremes, mean, exact median and first game with a value.

    All features are columns of one-row aggregates, so no row is copied.
    """
    features = list(features)
    medians, facts = wide_medians(rows, features), []
    for i, c in enumerate(features):
        value = F.col(c).cast("double")
        first = F.min(F.when(value.isNotNull(), F.struct("kickoff", "game_id", "source_player_id")))
        facts.append(
            F.struct(
                F.avg(value.isNull().cast("double")).alias("null_rate"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                F.avg(value).alias("mean"),
                first["game_id"].alias("first_available_game"),
            ).alias(f"_f{i}")
        )
    wide = rows.agg(*facts)
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(f"_f{i}").alias("f"), F.lit(medians[c]).cast("double").alias("median"))
        for i, c in enumerate(features)
    ]
    return wide.select(F.inline(F.array(*entries))).select("feature", "f.*", "median", F.lit("NOT_RUN").alias("leakage_status"))


def rows_by_season(rows: DataFrame) -> DataFrame:
    return rows.groupBy("season").agg(F.count("*").alias("rows"))


def rows_by_tier(rows: DataFrame) -> DataFrame:
    return rows.groupBy(history_tier(F.col("games_played_before")).alias("history_tier")).agg(F.count("*").alias("rows"))


def coefficient_stability(coefficients: DataFrame) -> DataFrame:
    """Spread and sign changes of coefficients across windows (one row per window and feature)."""
    columns = ["standardized", "raw_scale"]
    # Windows are a configured list, so a feature's array has one entry per window.
    grouped = coefficients.groupBy("feature_name").agg(
        F.count("*").alias("window_count"),
        *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("minimum", F.min), ("maximum", F.max), ("mean", F.avg))],
        F.array_sort(F.collect_list(F.struct("window_order", F.signum("standardized").alias("sign")))).alias("_s"),
    )
    signs = F.transform("_s", lambda s: s["sign"])
    pairs = F.zip_with(
        F.slice(signs, 1, F.size("_s") - 1), F.slice(signs, 2, F.size("_s")), lambda a, b: (a != b).cast("int")
    )
    changes = F.aggregate(pairs, F.lit(0), lambda total, x: total + x)
    return grouped.select(
        "feature_name",
        "window_count",
        *[f"{c}_{n}" for c in columns for n in ("minimum", "maximum", "mean")],
        *[(F.col(f"{c}_maximum") - F.col(f"{c}_minimum")).alias(f"{c}_range") for c in columns],
        changes.alias("sign_change_count"),
    )
