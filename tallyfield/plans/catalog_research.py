"""Registered queries of the research half."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.operators import evaluation as ev
from tallyfield.operators import history, quality, resample
from tallyfield.operators import poisson_model as pm
from tallyfield.plans import evaluate, training
from tallyfield.plans.catalog import query, rounded
from tallyfield.plans.oracles_research import CONTEXT_NAMES, FEATURE_SLICES
from tallyfield.plans.registry import FEATURE_NAMES, TABLE_COLUMNS
from tallyfield.session import materialize, shared_dir, with_one_row
from tallyfield.sources import datasets, tables

KEY = ev.KEY
TRAIN = (datetime(2024, 1, 1), datetime(2024, 1, 15, 23, 59, 59))
VALID = (datetime(2024, 1, 16), datetime(2024, 1, 30, 23, 59, 59))
WINDOWS = [
    evaluate.Window("w1", datetime(2024, 1, 12), datetime(2024, 1, 17, 23, 59, 59)),
    evaluate.Window("w2", datetime(2024, 1, 18), datetime(2024, 1, 23, 23, 59, 59)),
    evaluate.Window("w3", datetime(2024, 1, 24), datetime(2024, 1, 30, 23, 59, 59)),
]
START = datetime(2024, 1, 1)


def games(spark, sf) -> DataFrame:
    """The box-score table, derived once per query because several inputs come from it."""
    return materialize(tables.player_games(spark, sf))


def inputs(spark, sf):
    g = games(spark, sf)
    stats = tables.player_stats(g)
    table = training.build_training_table(stats, tables.schedules(g), strict=False)
    return table, stats, tables.snap_counts(g)


def features(spark, sf) -> DataFrame:
    table, stats, snaps = inputs(spark, sf)
    return history.build_feature_table(table, stats, snaps, strict=False)


#: What the baselines read, and what a failure report shows beside them.
BASELINE_INPUTS = [*KEY, "kickoff", "actual_receptions", "receptions_season_mean", "receptions_lag1", "receptions_roll3", "receptions_roll5"]
ERROR_CONTEXT = ["team", "opponent", "is_home", "game_week", "games_played_before", "targets_roll5", "rest_days"]


def held_out(spark, sf, columns=None) -> DataFrame:
    """Held-out rows with baselines; of the features only ``columns`` are computed, where they are named."""
    rows = features(spark, sf)
    rows = materialize(rows if columns is None else rows.select(*columns))
    return materialize(ev.period_filter(ev.with_baselines(rows), *VALID))


def scored(spark, sf) -> DataFrame:
    return ev.scored(ev.shared_cohort(held_out(spark, sf, BASELINE_INPUTS)))


def strongest_errors(spark, sf) -> DataFrame:
    cohort = ev.shared_cohort(held_out(spark, sf, [*BASELINE_INPUTS, *ERROR_CONTEXT]))
    best = ev.strongest_baseline(ev.regression_metrics(ev.scored(cohort), ["model"])).first()[0]
    return ev.errors_of(cohort, F.lit(best))


METRICS = ["mae", "rmse", "bias", "prediction_variance", "poisson_deviance", "calibration_error"]


# --- training table -------------------------------------------------------------------


@query
def filter_position_regular(spark, sf):
    stats = tables.player_stats(tables.player_games(spark, sf))
    return training.regular_receivers(stats).select("player_id", "season", "week", "receptions")


@query
def kickoff_expr(spark, sf):
    s = tables.schedules(tables.player_games(spark, sf))
    return s.select("game_id", training.kickoff(F.col("gameday"), F.col("gametime")).alias("kickoff"))


@query
def team_schedule_unpivot(spark, sf):
    return training.team_schedule(tables.schedules(tables.player_games(spark, sf)))


@query
def project_training(spark, sf):
    stats = training.with_team(tables.player_stats(tables.player_games(spark, sf)))
    return training.project_training(training.regular_receivers(stats))


@query
def attach_schedule(spark, sf):
    return inputs(spark, sf)[0]


@query
def canonical_order(spark, sf):
    return inputs(spark, sf)[0].select(*KEY, "kickoff").orderBy("kickoff", *reversed(KEY))


@query
def union_all(spark, sf):
    s = tables.schedules(games(spark, sf))
    sides = [s.select("season", "week", "game_id", F.col(c).alias("team")) for c in ("home_team", "away_team")]
    return sides[0].unionByName(sides[1])


@query
def distinct(spark, sf):
    return inputs(spark, sf)[0].select("season", "week", "game_id", "kickoff", "team", "opponent").dropDuplicates()


def _teams_without_passer(spark, sf):
    g = games(spark, sf)
    schedule = training.team_schedule(tables.schedules(g))
    passers = training.with_team(tables.player_stats(g)).filter("position = 'QB'")
    return training.unmatched(schedule, passers.select("season", "week", "team")).select("season", "week", "team")


query(_teams_without_passer, "except")


@query
def first_example(spark, sf):
    return _teams_without_passer(spark, sf).orderBy("season", "week", "team").limit(5)


# --- checks ---------------------------------------------------------------------------


@query
def check_contract(spark, sf):
    from tallyfield.sources.contracts import CONTRACTS

    g = tables.player_games(spark, sf)
    found = {"player_stats": tables.player_stats(g), "schedules": tables.schedules(g)}
    checked = {"player_stats": "player_stats", "schedules": "schedules", "rosters": "player_stats", "injuries": "schedules"}
    rows = []
    for name, frame in checked.items():
        contract = CONTRACTS[name]
        rows.append((name, ",".join(quality.missing_columns(found[frame], contract.required, contract.any_of))))
    verdicts = spark.createDataFrame(rows, "contract string, missing string")
    sizes = g.agg(F.count("*").alias("rows"))
    return with_one_row(verdicts, sizes)


@query
def check_season(spark, sf):
    facts = quality.check_season(tables.player_games(spark, sf), [1972, 1973, 1974, 1975])
    return facts.withColumn("seasons", F.array_join(F.col("seasons").cast("array<string>"), ","))


@query
def check_unique_key(spark, sf):
    return quality.unique_key_violations(tables.player_games(spark, sf), ["team", "season"])


@query
def check_row_rules(spark, sf):
    g = tables.player_games(spark, sf)
    g = g.withColumn("attempts", F.when(F.col("receptions") % 5 != 4, F.col("attempts") - 3))
    rules = quality.passing_rules()
    rules["receptions_above_targets"] = quality.usage_rules()["receptions_above_targets"]
    rules["target_not_whole"] = quality.target_rules("snap_share")["target_not_whole"]
    return quality.rule_violations(g, rules)


@query
def validate_feature_table(spark, sf):
    from tallyfield.plans.registry import table_schema

    rows = features(spark, sf)
    differences = quality.schema_differences(rows, table_schema())
    facts = quality.rule_violations(rows, {"kickoff_missing": F.col("kickoff").isNull()})
    repeated = quality.unique_key_violations(rows, KEY).agg(F.lit("key").alias("rule"), F.count("*").alias("violations"))
    return facts.unionByName(repeated).withColumn("schema_differences", F.lit(len(differences)))


@query
def check_input_identity(spark, sf):
    """The recorded table passes the check against its manifest; one altered row or registry does not."""
    rows = materialize(features(spark, sf))
    path = datasets.write_feature_dataset(rows, f"{shared_dir(spark)}/identity", {})
    manifest = datasets.read_manifest(spark, path).first()
    first = rows.select("source_player_id", "game_id").orderBy("source_player_id", "game_id").first()
    touched = (F.col("source_player_id") == first[0]) & (F.col("game_id") == first[1])
    altered = rows.withColumn("actual_receptions", F.col("actual_receptions") + F.when(touched, 1).otherwise(0))
    cases = (
        ("recorded", rows, manifest.registry_digest),
        ("altered row", altered, manifest.registry_digest),
        ("other registry", rows, "none"),
    )
    found = []
    for name, table, registry in cases:
        try:
            datasets.check_input_identity(table, manifest.digest, registry)
            found.append((name, True))
        except quality.ContractError:
            found.append((name, False))
    outcome = spark.createDataFrame(found, "case string, identical boolean")
    return with_one_row(outcome, rows.agg(F.count("*").alias("rows")))


@query
def leakage_probe(spark, sf):
    table, stats, _ = inputs(spark, sf)
    build = lambda t, s: history.build_feature_table(t, s, strict=False)
    return history.leakage_probe(build, table, stats, datetime(2024, 1, 20)).select(*KEY)


# --- features -------------------------------------------------------------------------


def _joined(spark, sf):
    table, stats, _ = inputs(spark, sf)
    prepared = history.prepared_stats(stats)
    return history.attach_stats(table, prepared), prepared


@query
def attach_stats(spark, sf):
    return _joined(spark, sf)[0].select(*KEY, "receptions", "targets", "receiving_yards")


@query
def team_game_totals(spark, sf):
    return history.team_game_totals(history.prepared_stats(tables.player_stats(tables.player_games(spark, sf))))


@query
def team_game_calendar(spark, sf):
    rows = history.team_games(*_joined(spark, sf))
    return rows.select("season", "week", "game_id", "kickoff", "team", "opponent", "attempts", "completions")


@query
def target_concentration(spark, sf):
    rows = history.team_games(*_joined(spark, sf))
    names = ["team_target_concentration", "team_completion_rate"]
    return rounded(rows.select("game_id", "team", *names), *names)


@query
def allowed_by_defense(spark, sf):
    return history.allowed_by_defense(_joined(spark, sf)[0])


@query
def optional_usage_lookup(spark, sf):
    table, _, snaps = inputs(spark, sf)
    rows = history.optional_usage(history.optional_usage(table, snaps, "snap_share"), None, "route_participation")
    return rounded(rows.select(*KEY, "snap_share", "route_participation"), "snap_share")


def _slice(names):
    def run(spark, sf):
        return rounded(features(spark, sf).select(*KEY, *names), *names)

    return run


query(_slice(CONTEXT_NAMES), "context_lookup")
for _name, _columns in FEATURE_SLICES.items():
    query(_slice(_columns), _name)


def _rounded_features(rows):
    return rounded(rows, *FEATURE_NAMES)


@query
def feature_table(spark, sf):
    return _rounded_features(features(spark, sf))


@query
def write_training_dataset(spark, sf):
    path = datasets.write_training_dataset(inputs(spark, sf)[0], f"{shared_dir(spark)}/training", "driver-tables")
    return spark.read.parquet(f"{path}/data")


@query
def write_feature_dataset(spark, sf):
    path = datasets.write_feature_dataset(
        materialize(features(spark, sf)), f"{shared_dir(spark)}/features", {"events": "driver-tables"}
    )
    return _rounded_features(spark.read.parquet(f"{path}/data"))


@query
def load_and_validate_features(spark, sf):
    path = datasets.write_feature_dataset(
        materialize(features(spark, sf)), f"{shared_dir(spark)}/features", {"events": "driver-tables"}
    )
    return _rounded_features(datasets.load_feature_dataset(spark, path))


@query
def season_list(spark, sf):
    return features(spark, sf).agg(
        F.count("*").alias("rows"),
        F.array_join(F.sort_array(F.collect_set("season")).cast("array<string>"), ",").alias("seasons"),
    )


@query
def row_count(spark, sf):
    return features(spark, sf).agg(F.count("*").alias("rows"))


@query
def audit_features(spark, sf):
    audit = ev.audit_features(materialize(features(spark, sf)), FEATURE_NAMES)
    return rounded(audit, "null_rate", "min", "max", "mean", "median")


@query
def audit_rows_by_season(spark, sf):
    return ev.rows_by_season(features(spark, sf))


@query
def history_tier(spark, sf):
    return ev.rows_by_tier(features(spark, sf))


@query
def missing_feature_rates(spark, sf):
    return rounded(ev.missing_feature_rates(features(spark, sf), FEATURE_NAMES), "missing_rate")


# --- baselines and cohorts ------------------------------------------------------------


@query
def league_mean_before(spark, sf):
    return rounded(ev.league_means(inputs(spark, sf)[0]), "league_mean")


@query
def career_mean_before(spark, sf):
    rows = ev.career_means(inputs(spark, sf)[0])
    return rounded(rows.select(*KEY, "career_count", "career_mean"), "career_mean")


@query
def baseline_predictions(spark, sf):
    return rounded(ev.baseline_predictions(materialize(features(spark, sf))), "prediction")


@query
def period_filter(spark, sf):
    return ev.period_filter(inputs(spark, sf)[0], *VALID).select(*KEY, "kickoff")


@query
def chronological_split(spark, sf):
    parts = ev.chronological_split(inputs(spark, sf)[0], TRAIN, VALID)
    named = [p.select(F.lit(n).alias("part"), "kickoff") for p, n in zip(parts, ("training", "evaluation"))]
    return named[0].unionByName(named[1]).groupBy("part").agg(
        F.count("*").alias("rows"), F.min("kickoff").alias("first_kickoff"), F.max("kickoff").alias("last_kickoff")
    )


@query
def complete_case_filter(spark, sf):
    return ev.complete_cases(features(spark, sf), ["receptions_roll3", "targets_roll3"]).select(*KEY)


@query
def restrict_to_keys(spark, sf):
    rows = materialize(features(spark, sf))
    return ev.restrict_to_keys(rows, rows.filter("targets_roll3 >= 2")).select(*KEY)


@query
def shared_cohort_and_coverage(spark, sf):
    return rounded(ev.coverage(held_out(spark, sf)), "coverage")


@query
def intersect(spark, sf):
    long = held_out(spark, sf).select(*KEY, F.inline("baselines"))
    return ev.shared_cohort_of_predictions(long)


@query
def error_context(spark, sf):
    rows = strongest_errors(spark, sf).select(
        *KEY, "team", "opponent", "is_home", "game_week", "games_played_before", "targets_roll5", "rest_days",
        "actual", "prediction", "error",
    )
    return rounded(rows, "targets_roll5", "rest_days", "prediction", "error")


@query
def segment_predicates(spark, sf):
    return strongest_errors(spark, sf).select(*KEY, F.explode(ev.segment_column()).alias("segment"))


# --- metrics --------------------------------------------------------------------------


@query
def regression_metrics(spark, sf):
    return rounded(ev.regression_metrics(scored(spark, sf), ["model"]), *METRICS)


@query
def poisson_deviance(spark, sf):
    term = ev.deviance_term(F.col("actual"), F.col("prediction"))
    return scored(spark, sf).groupBy("model").agg(F.round(F.avg(term), 6).alias("poisson_deviance"))


@query
def calibration_table(spark, sf):
    table = ev.calibration_table(scored(spark, sf), ["model"])
    return rounded(table, "mean_probability", "observed_rate", "gap")


@query
def residual_summary(spark, sf):
    names = ["mean", "minimum", "maximum", "mean_absolute", "q10", "q25", "median", "q75", "q90"]
    return rounded(ev.residual_summary(scored(spark, sf), ["model"]), *names)


@query
def prediction_bias(spark, sf):
    metrics = ev.regression_metrics(scored(spark, sf), ["model"])
    bias = ev.prediction_bias(metrics, [], "poisson", "league_mean")
    return rounded(bias, *bias.columns)


@query
def metric_differences(spark, sf):
    metrics = ev.regression_metrics(scored(spark, sf), ["model"])
    return rounded(ev.metric_differences(metrics, [], "poisson", "league_mean"), "difference")


@query
def strongest_baseline(spark, sf):
    return ev.strongest_baseline(ev.regression_metrics(scored(spark, sf), ["model"]))


@query
def group_bias(spark, sf):
    return rounded(ev.group_bias(strongest_errors(spark, sf)), "bias")


@query
def largest_errors(spark, sf):
    return rounded(ev.largest_errors(strongest_errors(spark, sf)), "prediction", "error")


@query
def segment_metrics(spark, sf):
    return rounded(ev.segment_metrics(strongest_errors(spark, sf)), *METRICS)


# --- resampling and models ------------------------------------------------------------


def _pairs(spark, sf):
    return materialize(evaluate._pivot_predictions(ev.shared_cohort(held_out(spark, sf, BASELINE_INPUTS))))


def _without_draws(intervals: DataFrame, *columns) -> DataFrame:
    """What a bootstrap table says whatever was drawn, and whether its intervals hold the differences."""
    covers = F.col("difference").between(F.col("confidence_lower"), F.col("confidence_upper"))
    return intervals.select(*columns, "sample_count", "iterations", covers.alias("covers"))


@query
def paired_mae_bootstrap(spark, sf):
    rows = resample.paired_mae_bootstrap(_pairs(spark, sf), KEY, "league_mean", ["poisson", "rolling_5"])
    return rounded(_without_draws(rows, "candidate", "difference", "effect_size"), "difference", "effect_size")


@query
def paired_metric_bootstrap(spark, sf):
    rows = resample.paired_metric_bootstrap(_pairs(spark, sf), KEY, "league_mean", "poisson")
    return rounded(_without_draws(rows, "metric", "difference"), "difference")


@query
def bootstrap_constant_gain(spark, sf):
    """A candidate that is better by a quarter on every row: both ends of its interval are a quarter."""
    off = F.abs(F.col("league_mean") - F.col("actual"))
    pairs = _pairs(spark, sf).select(*KEY, "actual", (F.col("actual") + off).alias("near"), (F.col("actual") + off + 0.25).alias("far"))
    rows = resample.paired_mae_bootstrap(pairs, KEY, "far", "near", rows_per_block=300)
    columns = ["candidate", "difference", "confidence_lower", "confidence_upper", "sample_count", "statistically_significant_improvement"]
    return rounded(rows.select(*columns), "difference", "confidence_lower", "confidence_upper")


@query
def bootstrap_draws(spark, sf):
    """Draws of 200 iterations over many blocks: every iteration draws as many rows as there are."""
    sums = resample.resampled_sums(_pairs(spark, sf), KEY, {"one": F.lit(1.0)}, 200, resample.SEED, rows_per_block=100)
    return sums.select("iteration", "draws", "one")


@query
def standardize(spark, sf):
    config = pm.PoissonConfig()
    rows = ev.complete_cases(features(spark, sf), config.features).withColumn("window_id", F.lit("all"))
    names = [f"{c}_z" for c in config.features]
    return rounded(pm.standardize(materialize(rows), config).select(*KEY, *names), *names)


@query
def rows_to_windows(spark, sf):
    tagged = evaluate.rows_to_windows(features(spark, sf), START, WINDOWS)
    return tagged.select("window_id", "role", *KEY)


def _windows(spark, sf):
    config = pm.PoissonConfig()
    tagged = evaluate.rows_to_windows(materialize(features(spark, sf)), START, WINDOWS)
    return ev.complete_cases(tagged, config.features)


def _fitted(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Complete rows of all windows, and the model that was fitted in each."""
    rows = materialize(_windows(spark, sf))
    return rows, materialize(pm.fit_poisson(rows.filter("role = 'training'")))


@query
def fit_poisson(spark, sf):
    """Certificate that each window's coefficients are the optimum: gradient zero, curvature positive."""
    rows, models = _fitted(spark, sf)
    terms = pm.optimality(rows.filter("role = 'training'"), models)
    terms = terms.select("window_id", "term", "training_rows", "mean", "scale", "gradient", (F.col("curvature") > 0).alias("curved"))
    # Adding zero turns a rounded minus zero into zero.
    return rounded(rounded(terms, "mean", "scale").withColumn("gradient", F.round("gradient", 4) + 0.0), "gradient")


@query
def model_table(spark, sf):
    """Fingerprints of the stored models on load: as written, and with one coefficient altered."""
    models = materialize(pm.with_fingerprint(_fitted(spark, sf)[1]))
    altered = models.withColumn("intercept", F.col("intercept") + F.when(F.col("window_id") == "w2", 1e-9).otherwise(0.0))
    cases = [
        table.agg(F.count("*").alias("models")).select(F.lit(name).alias("case"), "models").join(
            pm.verify_models(table).agg(F.count("*").alias("violations"), F.max("window_id").alias("window_id")), how="cross"
        )
        for name, table in (("stored", models), ("altered", altered))
    ]
    return cases[0].unionByName(cases[1])


@query
def predict_poisson(spark, sf):
    """Expected counts add up to the counts of the training rows in every window, as the intercept is free."""
    rows, models = _fitted(spark, sf)
    predicted = pm.predict_poisson(rows, models)
    totals = predicted.groupBy("window_id", "role").agg(
        F.count("*").alias("rows"),
        F.round(F.sum(F.when(F.col("role") == "training", F.col("learned"))), 3).alias("training_total"),
        F.bool_and(F.col("learned") > 0).alias("positive"),
    )
    return totals


@query
def raw_coefficients(spark, sf):
    """Raw and standardised coefficients tell the same slope on the scale of the training rows."""
    _, models = _fitted(spark, sf)
    scales = models.select("window_id", F.posexplode("feature_scales").alias("position", "scale"))
    rows = pm.raw_coefficients(models).join(scales, ["window_id", "position"])
    same = F.abs(F.col("raw_scale") * F.col("scale") - F.col("standardized")) < 1e-12
    return rounded(rows.select("window_id", "position", "feature_name", "scale", same.alias("same_slope")), "scale")


@query
def coefficient_stability(spark, sf):
    """Spread of the coefficients over the windows, as relations that hold for any fit."""
    _, models = _fitted(spark, sf)
    order = F.substring("window_id", 2, 1).cast("int").alias("window_order")
    rows = ev.coefficient_stability(pm.raw_coefficients(models).withColumn("window_order", order))
    ok = F.lit(True)
    for c in ("standardized", "raw_scale"):
        low, high, mean = (F.col(f"{c}_{n}") for n in ("minimum", "maximum", "mean"))
        ok &= (low <= mean + 1e-12) & (mean <= high + 1e-12) & (F.col(f"{c}_range") == high - low)
    crosses = (F.col("standardized_minimum") < 0) & (F.col("standardized_maximum") > 0)
    ok &= (F.col("sign_change_count") > 0) == crosses
    return rows.select("feature_name", "window_count", ok.alias("consistent"))


def _baselines(spark, sf) -> dict[str, DataFrame]:
    return evaluate.evaluate_baselines(materialize(features(spark, sf)), VALID)


def _learned(spark, sf) -> dict[str, DataFrame]:
    return evaluate.evaluate_learned(materialize(features(spark, sf)), TRAIN, VALID)


def _rolling(spark, sf) -> dict[str, DataFrame]:
    return evaluate.evaluate_rolling(materialize(features(spark, sf)), START, WINDOWS)


@query
def evaluate_baselines(spark, sf):
    return rounded(_baselines(spark, sf)["metrics"], *METRICS, "coverage")


@query
def evaluate_learned(spark, sf):
    return _learned(spark, sf)["gates"]


@query
def evaluate_rolling(spark, sf):
    return _rolling(spark, sf)["window_metrics"]


@query
def cohort_alignment(spark, sf):
    rows = _rolling(spark, sf)["aligned"]
    return rounded(rows.select(*KEY, "window_id", "actual", "baseline", (F.col("learned") > 0).alias("has_learned")), "baseline")


#: The other result tables of the three evaluations, each a query of its own.
EVALUATION_TABLES = {
    "learned_comparison": (_learned, "comparison"),
    "learned_metrics": (_learned, "metrics"),
    "rolling_pooled_metrics": (_rolling, "pooled_metrics"),
    "rolling_window_differences": (_rolling, "window_differences"),
    "rolling_intervals": (_rolling, "intervals"),
    "rolling_stability": (_rolling, "stability"),
    "rolling_residuals": (_rolling, "residuals"),
}

for _name, (_evaluate, _table) in EVALUATION_TABLES.items():
    query(lambda spark, sf, run=_evaluate, table=_table: run(spark, sf)[table], _name)


@query
def baseline_comparisons(spark, sf):
    rows = _baselines(spark, sf)["comparisons"]
    kept = rows.select("reference", "candidate", "difference", "effect_size", "sample_count", "iterations")
    return rounded(kept, "difference", "effect_size")


@query
def baseline_largest_errors(spark, sf):
    return rounded(_baselines(spark, sf)["largest_errors"], "prediction", "error")


@query
def baseline_decision(spark, sf):
    return _baselines(spark, sf)["decision"]


@query
def write_scorecard(spark, sf):
    """Three scorecards published and read back whole, beside one whose writer was lost before its end."""
    rows, root = materialize(features(spark, sf)), f"{shared_dir(spark)}/scorecards-{uuid.uuid4().hex}"
    # The three evaluations read the same few columns and baselines.
    read = (*evaluate.REPORT_INPUTS, *pm.MODEL_FEATURES)
    based = materialize(evaluate.with_baselines_of(rows, *read))
    runs = {
        "baselines": evaluate.evaluate_baselines(rows, VALID, based=based),
        "learned": evaluate.evaluate_learned(based, TRAIN, VALID),
        "rolling": evaluate.evaluate_rolling(based, START, WINDOWS),
    }
    for name, tables_of in runs.items():
        datasets.write_scorecard(tables_of, f"{root}/{name}")
    runs["learned"]["gates"].write.json(f"{root}/learned/version=lost/gates")
    found = None
    for name in runs:
        listed = datasets.published(spark, f"{root}/{name}")
        (path,) = [r.path for r in listed.select("path").distinct().collect()]  # one version was published
        datasets.read_scorecard(spark, path)  # whole, with the rows and digests of the marker
        listed = listed.select(F.lit(name).alias("scorecard"), "table", "rows")
        found = listed if found is None else found.unionByName(listed)
    return found
