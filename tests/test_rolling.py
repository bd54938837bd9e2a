from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfield.operators import evaluation as ev
from tallyfield.operators import poisson_model as pm
from tallyfield.plans import evaluate

START = datetime(2024, 1, 1)
FEATURES = ("receptions_roll3", "targets_roll3", "home_indicator", "games_played_before")


@pytest.fixture(scope="module")
def table(spark):
    """A small feature table in which every player has one row per day."""
    rng = np.random.default_rng(11)
    rows, past = [], {}
    for day in range(40):
        for p in range(6):
            seen = past.setdefault(p, [])
            mean = lambda k: float(np.mean(seen[-k:])) if seen else None  # noqa: E731, B023
            y = int(rng.poisson(2 + p))
            rows.append(
                (f"P{p}", f"G{day:03d}", 2024, START + timedelta(days=day), y, float(seen[-1]) if seen else None, mean(3), mean(5), mean(99), mean(3), mean(5), p % 2, len(seen), f"T{p % 3}", f"T{(p + 1) % 3}", p % 2, day % 17 + 1, 1.0)
            )
            seen.append(y)
    schema = (
        "source_player_id string, game_id string, season int, kickoff timestamp_ntz, actual_receptions long, receptions_lag1 double, "
        "receptions_roll3 double, receptions_roll5 double, receptions_season_mean double, targets_roll3 double, targets_roll5 double, "
        "home_indicator int, games_played_before long, team string, opponent string, is_home int, game_week int, rest_days double"
    )
    return spark.createDataFrame(rows, schema).cache()


WINDOWS = [
    evaluate.Window("w1", START + timedelta(days=20), START + timedelta(days=27)),
    evaluate.Window("w2", START + timedelta(days=28), START + timedelta(days=39)),
]


def newton(x, y):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-10, scale, 1.0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    beta[0] = np.log(y.mean())
    ridge = np.diag([1e-10] + [1.0] * x.shape[1])
    for _ in range(50):
        mu = np.exp(z @ beta)
        step = np.linalg.solve(z.T @ (z * mu[:, None]) + ridge, z.T @ (y - mu) - np.concatenate([[0], beta[1:]]))
        beta = beta + step
    return mean, scale, beta


def by_hand(pdf, window):
    pdf = pdf.dropna(subset=list(FEATURES))
    train = pdf[pdf.kickoff < window.start]
    test = pdf[(pdf.kickoff >= window.start) & (pdf.kickoff <= window.end)]
    mean, scale, beta = newton(train[list(FEATURES)].to_numpy(float), train.actual_receptions.to_numpy(float))
    eta = beta[0] + ((test[list(FEATURES)].to_numpy(float) - mean) / scale) @ beta[1:]
    return beta, np.abs(np.exp(eta) - test.actual_receptions).mean(), len(test)


def test_rolling_equals_plain_newton(table):
    result = evaluate.evaluate_rolling(table, START, WINDOWS, iterations=50)
    pdf = table.toPandas()
    models = {r.window_id: r for r in result["models"].collect()}
    metrics = {(r.window_id, r.model): r for r in result["window_metrics"].collect()}
    total = 0.0
    for w in WINDOWS:
        beta, mae, n = by_hand(pdf, w)
        assert [models[w.window_id].intercept, *models[w.window_id].coefficients] == pytest.approx(list(beta), abs=1e-7)
        learned = metrics[w.window_id, "learned"]
        assert learned.mae == pytest.approx(mae, abs=1e-7) and learned.sample_count == n
        total += mae * n
    pooled = {r.model: r for r in result["pooled_metrics"].collect()}
    assert pooled["learned"].mae == pytest.approx(total / pooled["learned"].sample_count, abs=1e-7)
    assert pooled["learned"].coverage == 1.0
    differences = {r.metric: r.difference for r in result["pooled_differences"].collect()}
    assert differences["mae"] == pytest.approx(pooled["learned"].mae - pooled["baseline"].mae)
    intervals = {r.metric: r for r in result["intervals"].collect()}
    assert intervals["mae"].difference == pytest.approx(differences["mae"])
    assert result["stability"].count() == len(FEATURES) and pm.verify_models(result["models"]).count() == 0


def test_learned_gates_follow_the_metrics(table):
    result = evaluate.evaluate_learned(
        table, (START, START + timedelta(days=19)), (START + timedelta(days=20), START + timedelta(days=39)), iterations=50
    )
    gates = result["gates"].first()
    metrics = {r.model: r for r in result["metrics"].collect()}
    learned, base = metrics["learned"], metrics[gates.strongest_baseline]
    assert gates.lower_mae == (learned.mae < base.mae) and gates.decision == "RESEARCH"
    assert gates.improved_poisson_deviance == (learned.poisson_deviance < base.poisson_deviance)
    assert learned.coverage == 1.0 and learned.sample_count == 120


def test_baseline_scorecard_and_segments(table):
    result = evaluate.evaluate_baselines(table.withColumns({c: F.lit(None).cast("double") for c in evaluate.FEATURE_NAMES if c not in table.columns}), (START, START + timedelta(days=39)), iterations=20)
    metrics = {r.model: r for r in result["metrics"].collect()}
    best = min((m.mae, n) for n, m in metrics.items() if n != "career_average")[1]
    assert metrics[best].status == "STRONGEST_BASELINE" and metrics["career_average"].status == "DIAGNOSTIC"
    assert result["comparisons"].count() == 6
    segments = {r.segment: r for r in result["segments"].collect()}
    assert segments["after_bye"].sample_count == 0 and segments["after_bye"].warning == "Segment after_bye has no evaluable rows."
    assert segments["home"].sample_count + segments["away"].sample_count == metrics[best].sample_count


def test_window_rules():
    bad = [WINDOWS[1], WINDOWS[0]]
    with pytest.raises(ValueError):
        evaluate.check_windows(START, bad)
    with pytest.raises(ValueError):
        evaluate.check_windows(START + timedelta(days=25), WINDOWS)
    with pytest.raises(ValueError):
        ev.chronological_split(None, (START, START + timedelta(days=9)), (START + timedelta(days=9), START + timedelta(days=12)))


def test_simultaneous_games_and_first_game(table):
    league = {r.game_id: r for r in ev.league_means(table).collect()}
    assert league["G000"].league_count == 0 and league["G000"].league_mean is None
    first = ev.baseline_predictions(table).filter("game_id = 'G000'")
    assert first.filter("eligible").count() == 0
    assert {r.exclusion_reason for r in first.collect()} == {"insufficient_history"}
