import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.functions import digests, poisson
from tallyfield.operators import evaluation, poisson_model, resample
from tallyfield.operators.poisson_model import ModelFitError, PoissonConfig


def rows(spark, actual, predicted):
    return spark.createDataFrame(
        [("m", float(a), float(p)) for a, p in zip(actual, predicted)], "model string, actual double, prediction double"
    )


def test_metrics(spark):
    got = evaluation.regression_metrics(rows(spark, [1, 3, 5], [2, 3, 4]), ["model"]).first()
    assert got.mae == pytest.approx(2 / 3) and got.rmse == pytest.approx(math.sqrt(2 / 3))
    assert got.bias == pytest.approx(0) and got.sample_count == 3
    assert got.prediction_variance == pytest.approx(2 / 3)


def test_residuals(spark):
    got = evaluation.residual_summary(rows(spark, [1, 2, 3, 4], [0, 2, 4, 6]), ["model"]).first()
    assert (got.mean, got.minimum, got.median, got.maximum, got.mean_absolute) == (0.5, -1, 0.5, 2, 1)
    alone = evaluation.residual_summary(rows(spark, [1, 2, 3, 4], [0, 2, 4, 6]), []).first()
    assert alone.median == 0.5


def reference_over(rate, line):
    return 1 - sum(math.exp(-rate) * rate**k / math.factorial(k) for k in range(math.floor(line) + 1))


def test_poisson_functions(spark):
    df = spark.createDataFrame([(0.0, 4.5), (4.0, 4.5), (0.3, 0.0), (12.5, 9.0)], "r double, l double")
    got = df.select(
        "r",
        "l",
        poisson.over(F.col("r"), F.col("l")).alias("over"),
        poisson.over_fixed_line(F.col("r"), 4.5).alias("fixed"),
        poisson.pmf(F.floor("l"), F.col("r")).alias("pmf"),
        poisson.quantiles(F.col("r"), {"a": 0.1, "b": 0.5, "c": 0.9}).alias("q"),
    ).collect()
    for row in got:
        assert row.over == pytest.approx(reference_over(row.r, row.l), abs=1e-12)
        assert row.fixed == pytest.approx(reference_over(row.r, 4.5), abs=1e-12)
        k = math.floor(row.l)
        assert row.pmf == pytest.approx(math.exp(-row.r) * row.r**k / math.factorial(k), abs=1e-12)
        for p, q in zip((0.1, 0.5, 0.9), row.q):
            cdf = lambda n: 1 - reference_over(row.r, n) if n >= 0 else 0
            assert cdf(q) >= p and cdf(q - 1) < p
    assert got[1].over == pytest.approx(0.371163, abs=1e-6)


def test_calibration_keeps_empty_bins(spark):
    table = evaluation.calibration_table(rows(spark, [1, 9, 5], [2, 9, 4]), ["model"]).orderBy("bin").collect()
    assert len(table) == 10 and sum(r["count"] for r in table) == 3
    assert all(r.gap is None for r in table if r["count"] == 0)


def paired(spark, n=300):
    rng = np.random.default_rng(7)
    actual = rng.poisson(5, n)
    return spark.createDataFrame(
        [(i, float(a), float(a + rng.normal(0, 2)), float(a + rng.normal(0, 1))) for i, a in enumerate(actual)],
        "id int, actual double, reference double, candidate double",
    )


def test_constant_improvement_has_a_point_interval(spark):
    df = spark.range(40).select(
        "id", (F.col("id") % 5).cast("double").alias("actual"), ((F.col("id") % 5) + 3).cast("double").alias("reference"),
        (F.col("id") % 5).cast("double").alias("candidate"),
    )
    got = resample.paired_mae_bootstrap(df, ["id"], "reference", "candidate", iterations=50, rows_per_block=7).first()
    assert (got.difference, got.confidence_lower, got.confidence_upper, got.effect_size) == (3, 3, 3, 1)
    assert got.statistically_significant_improvement


def test_bootstrap_matches_plain_resampling(spark):
    df = paired(spark)
    pdf = df.toPandas()
    gain = (pdf.actual - pdf.reference).abs() - (pdf.actual - pdf.candidate).abs()
    rng = np.random.default_rng(1)
    means = [gain.to_numpy()[rng.integers(0, len(gain), len(gain))].mean() for _ in range(2000)]
    want = np.quantile(means, [0.025, 0.975])
    for block in (23, 10_000):
        got = resample.paired_mae_bootstrap(
            df.repartition(5), ["id"], "reference", "candidate", iterations=2000, rows_per_block=block
        ).first()
        assert got.difference == pytest.approx(gain.mean())
        width = want[1] - want[0]
        assert abs(got.confidence_lower - want[0]) < 0.15 * width
        assert abs(got.confidence_upper - want[1]) < 0.15 * width


def test_bootstrap_is_deterministic_and_draws_n_rows(spark):
    df = paired(spark, 100)
    sums = lambda d: resample.resampled_sums(d, ["id"], {"a": F.col("actual")}, 30, 5, 11).orderBy("iteration").collect()
    first = sums(df)
    assert {r.draws for r in first} == {100}
    again = sums(df.repartition(9))
    assert [r.a for r in again] == pytest.approx([r.a for r in first])


def test_metric_bootstrap_brackets_the_difference(spark):
    got = resample.paired_metric_bootstrap(
        paired(spark).withColumns({c: F.abs(c) for c in ("reference", "candidate")}), ["id"], "reference", "candidate", iterations=300
    ).collect()
    assert {r.metric for r in got} == {"mae", "rmse", "poisson_deviance", "mean_prediction_bias"}
    assert all(r.confidence_lower <= r.difference <= r.confidence_upper for r in got)


def model_frame(spark, window="w"):
    start = datetime(2024, 1, 1)
    data = [
        (window, start + timedelta(days=i), f"G{i:03d}", f"P{i % 5}", 1.0 + i % 7, 3.0 + i % 9, float(i % 2), float(i // 5), 1.0 + (3 * i) % 8)
        for i in range(30)
    ]
    return spark.createDataFrame(
        data,
        "window_id string, kickoff timestamp_ntz, game_id string, source_player_id string, receptions_roll3 double, "
        "targets_roll3 double, home_indicator double, games_played_before double, actual_receptions double",
    )


def test_poisson_fit_known_coefficients(spark):
    both = model_frame(spark, "a").unionByName(model_frame(spark, "b").filter("game_id < 'G025'"))
    models = poisson_model.fit_poisson(both)
    fitted = {r.window_id: r for r in models.collect()}
    assert fitted["a"].intercept == pytest.approx(1.496661, abs=1e-6)
    assert fitted["a"].coefficients == pytest.approx([0.017966, -0.032110, 0.090353, 0.067101], abs=1e-6)
    assert fitted["b"].training_rows == 25 and fitted["b"].converged
    predictions = poisson_model.predict_poisson(model_frame(spark, "a"), models)
    total = predictions.agg(F.sum("learned"), F.sum("actual_receptions")).first()
    assert total[0] == pytest.approx(total[1], rel=1e-6)
    raw = poisson_model.raw_coefficients(models.filter("window_id = 'a'")).orderBy("position").collect()
    assert raw[2].raw_scale == pytest.approx(0.090353 / 0.5, abs=1e-5)
    marked = poisson_model.with_fingerprint(models)
    assert poisson_model.verify_models(marked).count() == 0
    assert poisson_model.verify_models(marked.withColumn("intercept", F.col("intercept") + 1e-9)).count() == 2


def test_poisson_fit_errors(spark):
    with pytest.raises(ModelFitError):
        poisson_model.fit_poisson(model_frame(spark).limit(3))
    with pytest.raises(ModelFitError):
        poisson_model.fit_poisson(model_frame(spark), PoissonConfig(max_iterations=1))


def test_coefficient_stability(spark):
    data = [(i, "x", v, v / 2) for i, v in enumerate([1.0, -2.0, -1.0, 3.0])]
    got = evaluation.coefficient_stability(
        spark.createDataFrame(data, "window_order int, feature_name string, standardized double, raw_scale double")
    ).first()
    assert (got.sign_change_count, got.standardized_range, got.raw_scale_mean) == (2, 5.0, 0.125)


def test_digests_ignore_order_and_see_changes(spark):
    df = paired(spark, 50)
    one = digests.table_digest(df).first()
    assert digests.table_digest(df.repartition(7).select(*reversed(df.columns))).first() == one
    assert digests.table_digest(df.withColumn("actual", F.col("actual") + (F.col("id") == 3).cast("int"))).first() != one
    assert digests.table_digest(df.unionAll(df.limit(1))).first() != one
    assert digests.table_digest(df.limit(0)).first().rows == 0
