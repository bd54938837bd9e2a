"""SQL twins of the research half: training table, features, baselines, evaluation."""

from __future__ import annotations

GAMES = """
pg AS (
  SELECT user_id AS u, epoch_us(ts) // 43200000000 AS b, sum(CAST(value AS DECIMAL(12,2))) AS v
  FROM events GROUP BY ALL),
tm AS (
  SELECT *, (u // 100) * 4 + u % 4 AS t, (u // 100) * 4 + xor(u % 4, 1 + b % 3) AS o,
         CAST(ceil(v / 20) AS DOUBLE) AS targets FROM pg),
games AS (
  SELECT 'P' || lpad(CAST(u AS VARCHAR), 9, '0') AS player_id,
         lpad(CAST(b AS VARCHAR), 8, '0') || '-T' || lpad(CAST(least(t, o) AS VARCHAR), 7, '0') AS game_id,
         CAST(b // 20 AS INT) AS season, CAST(b % 20 + 1 AS INT) AS week, make_timestamp(b * 43200000000) AS kickoff,
         'T' || lpad(CAST(t AS VARCHAR), 7, '0') AS team, 'T' || lpad(CAST(o AS VARCHAR), 7, '0') AS opponent,
         t < o AS is_home, CASE WHEN u % 5 = 4 THEN 'QB' ELSE 'WR' END AS position,
         floor(targets * 3 / 5) AS receptions, targets, targets * 7 AS receiving_yards, targets + 1 AS attempts,
         floor(targets * 3 / 5) AS completions, CASE WHEN u % 5 <> 0 THEN targets / (targets + 4) END AS snap_share
  FROM tm)"""

SCHEDULE = """
schedule AS (
  SELECT DISTINCT season, week, game_id, kickoff, CASE WHEN is_home THEN team ELSE opponent END AS home_team,
         CASE WHEN is_home THEN opponent ELSE team END AS away_team FROM games),
team_schedule AS (
  SELECT season, week, game_id, kickoff, home_team AS team, away_team AS opponent, 1 AS is_home FROM schedule
  UNION ALL
  SELECT season, week, game_id, kickoff, away_team, home_team, 0 FROM schedule)"""

TRAINING = f"""{GAMES}, {SCHEDULE},
training AS (
  SELECT g.season, g.week, s.game_id, s.kickoff, g.player_id AS source_player_id,
         'Mike ' || g.player_id || ' Jr.' AS raw_player_name, 'michael ' || lower(g.player_id) AS canonical_player_name,
         g.position, g.team, s.opponent, s.is_home, CAST(g.receptions AS BIGINT) AS actual_receptions,
         g.receptions, g.targets, g.receiving_yards, g.snap_share
  FROM games g JOIN team_schedule s USING (season, week, team) WHERE g.position = 'WR')"""

TEAM_GAMES = f"""{TRAINING},
totals AS (
  SELECT season, week, team, coalesce(sum(CASE WHEN position = 'WR' THEN targets END), 0) AS wr_targets,
         max(CASE WHEN position = 'WR' THEN targets END) AS max_wr_targets,
         sum(attempts) AS attempts, sum(completions) AS completions
  FROM games GROUP BY ALL),
allowed AS (
  SELECT season, week, game_id, kickoff, team, opponent, sum(receptions) AS opponent_wr_receptions_allowed,
         sum(targets) AS opponent_wr_targets_allowed
  FROM training GROUP BY ALL),
team_games AS (
  SELECT a.*, t.wr_targets, t.max_wr_targets, t.attempts, t.completions, t.attempts AS team_pass_attempts,
         t.completions AS team_completions,
         CASE WHEN t.attempts > 0 THEN t.completions / t.attempts END AS team_completion_rate,
         CASE WHEN t.wr_targets > 0 THEN t.max_wr_targets / t.wr_targets END AS team_target_concentration,
         t.attempts AS opponent_pass_attempts_allowed, t.completions AS opponent_completions_allowed
  FROM allowed a JOIN totals t USING (season, week, team))"""


def frame(partition: str, size: int | None) -> str:
    start = "UNBOUNDED" if size is None else str(size)
    return f"(PARTITION BY {partition} ORDER BY kickoff, game_id ROWS BETWEEN {start} PRECEDING AND 1 PRECEDING)"


def mean(column: str, partition: str, size: int | None) -> str:
    w = frame(partition, size)
    return (
        f"CASE WHEN count(*) OVER {w} > 0 AND count({column}) OVER {w} = count(*) OVER {w} "
        f"THEN avg({column}) OVER {w} END"
    )


TEAM = ("team_pass_attempts", "team_completions", "team_completion_rate", "team_target_concentration")
DEFENSE = (
    "opponent_pass_attempts_allowed",
    "opponent_completions_allowed",
    "opponent_wr_receptions_allowed",
    "opponent_wr_targets_allowed",
)
_context = ",\n         ".join(
    f"{mean(c, p, k)} AS {c}_roll{k}"
    for names, p in ((TEAM, "season, team"), (DEFENSE, "season, opponent"))
    for c in names
    for k in (3, 5)
)
CONTEXT_NAMES = [f"{c}_roll{k}" for c in (*TEAM, *DEFENSE) for k in (3, 5)]

P = "source_player_id"
_player = []
for c in ("receptions", "targets", "receiving_yards", "snap_share"):
    _player.append(f"lag({c}) OVER (PARTITION BY {P} ORDER BY kickoff, game_id) AS {c}_lag1")
for c in ("receptions", "targets", "receiving_yards", "target_share"):
    _player += [f"{mean(c, P, k)} AS {c}_roll{k}" for k in (3, 5, 8)]
for k in (3, 5, 8):
    w = frame(P, k)
    both = "receptions IS NOT NULL AND targets IS NOT NULL"
    top, bottom = (f"sum(CASE WHEN {both} THEN {c} END) OVER {w}" for c in ("receptions", "targets"))
    _player.append(f"CASE WHEN {bottom} > 0 THEN {top} / {bottom} END AS catch_rate_roll{k}")
_player += [f"{mean('snap_share', P, k)} AS snap_share_roll{k}" for k in (3, 5)]
_player += [f"{mean(c, P + ', season', None)} AS {c}_season_mean" for c in ("receptions", "targets", "receiving_yards")]
_player.append(f"row_number() OVER (PARTITION BY {P} ORDER BY kickoff, game_id) - 1 AS games_played_before")
_player.append(
    f"(epoch_us(kickoff) - epoch_us(lag(kickoff) OVER (PARTITION BY {P} ORDER BY kickoff, game_id))) / 86400000000.0::DOUBLE AS rest_days"
)
_player_sql = ",\n         ".join(_player)

FEATURES = f"""{TEAM_GAMES},
context AS (SELECT season, game_id, team, attempts AS team_attempts, {_context} FROM team_games),
joined AS (
  SELECT t.*, c.* EXCLUDE (season, game_id, team),
         CASE WHEN team_attempts > 0 THEN targets / team_attempts END AS target_share
  FROM training t LEFT JOIN context c USING (season, game_id, team)),
features AS (
  SELECT source_player_id, canonical_player_name, game_id, season, week, kickoff, raw_player_name, position, team,
         opponent, is_home, actual_receptions, {", ".join(CONTEXT_NAMES)},
         {_player_sql}
  FROM joined),
feature_table AS (
  SELECT *, NULL::DOUBLE AS route_participation_lag1, NULL::DOUBLE AS route_participation_roll3,
         NULL::DOUBLE AS route_participation_roll5, 1 AS route_participation_missing,
         CAST(snap_share_lag1 IS NULL AS INT) AS snap_share_missing, is_home AS home_indicator, week AS game_week,
         season AS season_year, CAST(games_played_before > 0 AS INT) AS has_prior_history
  FROM features)"""


def pick(columns, digits: int = 6) -> str:
    """Rounded columns after the row key."""
    return "source_player_id, game_id, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


BASE = f"""{FEATURES},
league AS (
  SELECT kickoff, game_id, sum(n) OVER g AS league_count, sum(s) OVER g / sum(n) OVER g AS league_mean FROM (
    SELECT kickoff, game_id, count(*) AS n, sum(actual_receptions)::DOUBLE AS s FROM feature_table GROUP BY ALL)
  WINDOW g AS (ORDER BY kickoff, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wide AS (
  SELECT f.*, coalesce(l.league_count, 0) AS league_count, l.league_mean,
         count(*) OVER {frame(P, None)} AS career_count,
         avg(actual_receptions) OVER {frame(P, None)} AS career_mean
  FROM feature_table f JOIN league l USING (kickoff, game_id)),
long AS (
  SELECT w.*, unnest(['league_mean', 'previous_game', 'rolling_3', 'rolling_5', 'season_to_date', 'career_average', 'poisson']) AS baseline,
         unnest(['L0', 'L1', 'L2', 'L3', 'L4', 'L4', 'L5']) AS baseline_level,
         unnest([league_mean, receptions_lag1, receptions_roll3, receptions_roll5, receptions_season_mean, career_mean,
                 coalesce(receptions_season_mean, receptions_roll5, career_mean, league_mean)]) AS raw_prediction,
         unnest([league_count, career_count, career_count, career_count, career_count, career_count,
                 greatest(career_count, CAST(receptions_season_mean IS NOT NULL AS INT),
                          CAST(receptions_roll5 IS NOT NULL AS INT), league_count)]) AS history_count
  FROM wide w),
predictions AS (
  SELECT *, raw_prediction IS NOT NULL AND history_count >= 1 AS eligible,
         CASE WHEN raw_prediction IS NOT NULL AND history_count >= 1 THEN raw_prediction END AS prediction
  FROM long)"""

COHORT = f"""{BASE},
held_out AS (
  SELECT * FROM predictions WHERE kickoff BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59'),
shared AS (
  SELECT *, actual_receptions::DOUBLE AS actual, prediction - actual_receptions AS error FROM (
    SELECT *, bool_and(eligible) OVER (PARTITION BY source_player_id, game_id) AS ok FROM held_out) WHERE ok)"""


def over(rate: str) -> str:
    r = rate
    return (
        f"CASE WHEN {r} = 0 THEN 0 ELSE least(1, greatest(0, 1 - exp(-{r}) * (1 + {r} + pow({r}, 2) / 2 + pow({r}, 3) / 6 "
        f"+ pow({r}, 4) / 24))) END"
    )


DEVIANCE = (
    "CASE WHEN actual = 0 THEN 2 * greatest(prediction, 1e-12) ELSE 2 * (actual * ln(actual / greatest(prediction, 1e-12)) "
    "- (actual - greatest(prediction, 1e-12))) END"
)


def metrics(source: str, group: str) -> str:
    """CTEs ending in ``metrics`` with one row per group."""
    return f"""scored AS (SELECT *, {over("prediction")} AS p, {DEVIANCE} AS dev FROM {source}),
bins AS (
  SELECT {group}, least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp,
         avg(CASE WHEN actual > 4.5 THEN 1.0 ELSE 0.0 END) AS mh FROM scored GROUP BY ALL),
ece AS (SELECT {group}, sum(n * abs(mp - mh)) / sum(n) AS calibration_error FROM bins GROUP BY ALL),
metrics AS (
  SELECT {group}, count(*) AS sample_count, avg(abs(error)) AS mae, sqrt(avg(error * error)) AS rmse, avg(error) AS bias,
         var_pop(prediction) AS prediction_variance, avg(dev) AS poisson_deviance, any_value(e.calibration_error) AS calibration_error
  FROM scored JOIN ece e USING ({group}) GROUP BY {group})"""


METRIC_NAMES = ["mae", "rmse", "bias", "prediction_variance", "poisson_deviance", "calibration_error"]
ROUNDED_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES)

STRONGEST = f"""{COHORT}, {metrics("shared", "baseline")},
strongest AS (
  SELECT baseline AS strongest_baseline FROM metrics WHERE baseline <> 'career_average' ORDER BY mae, baseline LIMIT 1),
errors AS (SELECT s.* FROM shared s JOIN strongest ON baseline = strongest_baseline)"""
SEGMENTED = f"""{STRONGEST},
segmented AS (SELECT * FROM (
  SELECT *, unnest([
      CASE WHEN games_played_before <= 16 THEN 'rookies' END, CASE WHEN games_played_before > 16 THEN 'veterans' END,
      CASE WHEN targets_roll5 < 7 THEN 'low_volume' END, CASE WHEN targets_roll5 >= 7 THEN 'high_volume' END,
      CASE WHEN game_week <= 8 THEN 'early_season' END, CASE WHEN game_week > 8 THEN 'late_season' END,
      CASE WHEN is_home = 1 THEN 'home' END, CASE WHEN is_home <> 1 THEN 'away' END,
      CASE WHEN rest_days >= 13 THEN 'after_bye' END]) AS segment
  FROM errors) WHERE segment IS NOT NULL)"""

R: dict[str, str] = {}

R["filter_position_regular"] = f"WITH {GAMES} SELECT player_id, season, week, receptions FROM games WHERE position = 'WR'"
R["kickoff_expr"] = f"WITH {GAMES}, {SCHEDULE} SELECT game_id, kickoff FROM schedule"
R["team_schedule_unpivot"] = f"WITH {GAMES}, {SCHEDULE} SELECT * FROM team_schedule"
R["project_training"] = f"""WITH {TRAINING} SELECT season, week, source_player_id, raw_player_name, canonical_player_name,
  position, team, actual_receptions FROM training"""
R["attach_schedule"] = f"""WITH {TRAINING} SELECT season, week, game_id, kickoff, source_player_id, raw_player_name,
  canonical_player_name, position, team, opponent, is_home, actual_receptions FROM training"""
R["attach_stats"] = f"WITH {TRAINING} SELECT source_player_id, game_id, receptions, targets, receiving_yards FROM training"
R["team_game_totals"] = f"WITH {TEAM_GAMES} SELECT * FROM totals"
R["team_game_calendar"] = f"WITH {TEAM_GAMES} SELECT season, week, game_id, kickoff, team, opponent, attempts, completions FROM team_games"
R["target_concentration"] = f"""WITH {TEAM_GAMES} SELECT game_id, team, round(team_target_concentration, 6) AS team_target_concentration,
  round(team_completion_rate, 6) AS team_completion_rate FROM team_games"""
R["allowed_by_defense"] = f"WITH {TEAM_GAMES} SELECT * FROM allowed"
R["optional_usage_lookup"] = f"""WITH {TRAINING} SELECT source_player_id, game_id, round(snap_share, 6) AS snap_share,
  NULL AS route_participation FROM training"""
R["context_lookup"] = f"WITH {FEATURES} SELECT {pick(CONTEXT_NAMES)} FROM feature_table"
_names = (
    [f"{c}_{s}" for c in ("receptions", "targets", "receiving_yards") for s in ("lag1", "roll3", "roll5", "roll8", "season_mean")]
    + [f"{c}_roll{k}" for c in ("catch_rate", "target_share") for k in (3, 5, 8)]
    + [f"snap_share_{s}" for s in ("lag1", "roll3", "roll5", "missing")]
    + [f"route_participation_{s}" for s in ("lag1", "roll3", "roll5", "missing")]
    + CONTEXT_NAMES
    + ["games_played_before", "home_indicator", "rest_days", "game_week", "season_year", "has_prior_history"]
)
R["feature_table"] = f"""WITH {FEATURES} SELECT {pick(_names)}, canonical_player_name, season, week, kickoff, raw_player_name,
  position, team, opponent, is_home, actual_receptions FROM feature_table"""
_w = {
    "lag1": ["receptions_lag1", "targets_lag1", "receiving_yards_lag1", "snap_share_lag1"],
    "rolling_mean_strict": [f"{c}_roll{k}" for c in ("receptions", "targets", "receiving_yards") for k in (3, 5, 8)]
    + ["snap_share_roll3", "snap_share_roll5"],
    "season_to_date_mean": [f"{c}_season_mean" for c in ("receptions", "targets", "receiving_yards")],
    "rolling_ratio": [f"catch_rate_roll{k}" for k in (3, 5, 8)],
    "target_share": [f"target_share_roll{k}" for k in (3, 5, 8)],
    "games_played_before": ["games_played_before", "has_prior_history"],
    "rest_days": ["rest_days"],
    "team_context_roll": [f"{c}_roll{k}" for c in TEAM for k in (3, 5)],
    "opponent_allowed_roll": [f"{c}_roll{k}" for c in DEFENSE for k in (3, 5)],
    "missing_indicators": ["snap_share_missing", "route_participation_missing", "has_prior_history"],
    "registry_cast": ["games_played_before", "home_indicator", "game_week", "season_year"],
}
FEATURE_SLICES = dict(_w)
for _name, _columns in _w.items():
    R[_name] = f"WITH {FEATURES} SELECT {pick(_columns)} FROM feature_table"

R["league_mean_before"] = f"""WITH {BASE} SELECT DISTINCT kickoff, game_id, league_count, round(league_mean, 6) AS league_mean FROM wide"""
R["career_mean_before"] = f"""WITH {BASE} SELECT source_player_id, game_id, career_count, round(career_mean, 6) AS career_mean FROM wide"""
R["baseline_predictions"] = f"""WITH {BASE} SELECT source_player_id, game_id, season, kickoff, actual_receptions, baseline, baseline_level,
  '1.0.0' AS implementation_version, CASE WHEN baseline = 'poisson' THEN 'poisson' ELSE 'point' END AS distribution,
  round(prediction, 6) AS prediction, history_count, eligible,
  CASE WHEN NOT eligible THEN 'insufficient_history' END AS exclusion_reason FROM predictions"""
R["period_filter"] = f"""WITH {FEATURES} SELECT source_player_id, game_id, kickoff FROM feature_table
  WHERE kickoff BETWEEN TIMESTAMP '2024-01-16 00:00:00' AND TIMESTAMP '2024-01-30 23:59:59'"""
R["chronological_split"] = f"""WITH {FEATURES} SELECT CASE WHEN kickoff < TIMESTAMP '2024-01-16 00:00:00' THEN 'training' ELSE 'evaluation' END AS part,
  count(*) AS rows, min(kickoff) AS first_kickoff, max(kickoff) AS last_kickoff FROM feature_table GROUP BY ALL"""
R["complete_case_filter"] = f"""WITH {FEATURES} SELECT source_player_id, game_id FROM feature_table
  WHERE receptions_roll3 IS NOT NULL AND targets_roll3 IS NOT NULL"""
R["history_tier"] = f"""WITH {FEATURES} SELECT CASE WHEN games_played_before = 0 THEN 'rookie_or_no_history' WHEN games_played_before < 3
  THEN 'one_to_two' WHEN games_played_before < 6 THEN 'three_to_five' ELSE 'six_plus' END AS history_tier, count(*) AS rows
  FROM feature_table GROUP BY ALL"""
R["segment_predicates"] = f"WITH {SEGMENTED} SELECT source_player_id, game_id, segment FROM segmented"
R["restrict_to_keys"] = f"""WITH {FEATURES} SELECT source_player_id, game_id FROM feature_table WHERE targets_roll3 >= 2"""
R["shared_cohort_and_coverage"] = f"""WITH {COHORT} SELECT baseline, count(*) FILTER (eligible) AS eligible_rows,
  round(count(*) FILTER (eligible) / count(*), 6) AS coverage FROM held_out GROUP BY ALL"""
R["intersect"] = f"WITH {COHORT} SELECT DISTINCT source_player_id, game_id FROM shared"
R["error_context"] = f"""WITH {STRONGEST} SELECT source_player_id, game_id, team, opponent, is_home, game_week, games_played_before,
  round(targets_roll5, 6) AS targets_roll5, round(rest_days, 6) AS rest_days, actual, round(prediction, 6) AS prediction,
  round(error, 6) AS error FROM errors"""
R["regression_metrics"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}
  SELECT baseline AS model, sample_count, {ROUNDED_METRICS} FROM metrics"""
R["poisson_deviance"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}
  SELECT baseline AS model, round(poisson_deviance, 6) AS poisson_deviance FROM metrics"""
R["calibration_table"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}
  SELECT baseline AS model, bin, bin / 10.0 AS lower, (bin + 1) / 10.0 AS upper, coalesce(n, 0) AS count,
         round(mp, 6) AS mean_probability, round(mh, 6) AS observed_rate, round(abs(mp - mh), 6) AS gap
  FROM (SELECT DISTINCT baseline FROM shared) CROSS JOIN (SELECT unnest(range(10)) AS bin)
  LEFT JOIN bins USING (baseline, bin)"""
R["residual_summary"] = f"""WITH {COHORT} SELECT baseline AS model, count(*) AS sample_count, round(avg(error), 6) AS mean,
  round(min(error), 6) AS minimum, round(max(error), 6) AS maximum, round(avg(abs(error)), 6) AS mean_absolute,
  round(quantile_cont(error, 0.1), 6) AS q10, round(quantile_cont(error, 0.25), 6) AS q25, round(median(error), 6) AS median,
  round(quantile_cont(error, 0.75), 6) AS q75, round(quantile_cont(error, 0.9), 6) AS q90 FROM shared GROUP BY ALL"""
_pair = """a AS (SELECT * FROM metrics WHERE baseline = 'poisson'), b AS (SELECT * FROM metrics WHERE baseline = 'league_mean')"""
R["prediction_bias"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}, {_pair}
  SELECT round(a.bias, 6) AS learned_mean_bias, round(b.bias, 6) AS baseline_mean_bias, round(abs(a.bias), 6) AS absolute_learned_bias,
         round(abs(b.bias), 6) AS absolute_baseline_bias, round(a.bias - b.bias, 6) AS signed_difference,
         round(abs(a.bias) - abs(b.bias), 6) AS absolute_bias_difference FROM a, b"""
R["metric_differences"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}, {_pair}
  SELECT unnest(['mae', 'rmse', 'poisson_deviance', 'bias']) AS metric,
         round(unnest([a.mae - b.mae, a.rmse - b.rmse, a.poisson_deviance - b.poisson_deviance, a.bias - b.bias]), 6) AS difference
  FROM a, b"""
R["strongest_baseline"] = f"WITH {STRONGEST} SELECT * FROM strongest"
R["group_bias"] = f"""WITH {STRONGEST}
  SELECT 'source_player_id' AS dimension, source_player_id AS value, round(avg(error), 6) AS bias FROM errors GROUP BY ALL
  UNION ALL SELECT 'team', team, round(avg(error), 6) FROM errors GROUP BY ALL
  UNION ALL SELECT 'opponent', opponent, round(avg(error), 6) FROM errors GROUP BY ALL"""
R["largest_errors"] = f"""WITH {STRONGEST}
  (SELECT 'over' AS direction, source_player_id, game_id, team, opponent, actual, round(prediction, 6) AS prediction, round(error, 6) AS error
   FROM errors WHERE error > 0 ORDER BY errors.error DESC, game_id, source_player_id LIMIT 10)
  UNION ALL
  (SELECT 'under', source_player_id, game_id, team, opponent, actual, round(prediction, 6), round(error, 6)
   FROM errors WHERE error < 0 ORDER BY errors.error, game_id, source_player_id LIMIT 10)"""
R["segment_metrics"] = f"""WITH {SEGMENTED}, {metrics("segmented", "segment").replace("scored", "seg_scored").replace("bins", "seg_bins").replace("ece", "seg_ece").replace("metrics AS", "seg_metrics AS")}
  SELECT segment, coalesce(sample_count, 0) AS sample_count, {ROUNDED_METRICS},
         CASE WHEN sample_count IS NULL THEN 'Segment ' || segment || ' has no evaluable rows.' END AS warning
  FROM (SELECT unnest(['rookies', 'veterans', 'low_volume', 'high_volume', 'early_season', 'late_season', 'home', 'away', 'after_bye']) AS segment)
  LEFT JOIN seg_metrics USING (segment)"""
R["missing_feature_rates"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate FROM feature_table" for c in _names
)
R["audit_features"] = f"WITH {FEATURES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_rate, round(min({c})::DOUBLE, 6) AS min, "
    f"round(max({c})::DOUBLE, 6) AS max, round(avg({c})::DOUBLE, 6) AS mean, round(median({c})::DOUBLE, 6) AS median, "
    f"(SELECT game_id FROM feature_table WHERE {c} IS NOT NULL ORDER BY kickoff, game_id LIMIT 1) AS first_available_game, "
    f"'NOT_RUN' AS leakage_status FROM feature_table"
    for c in _names
)
R["rows_to_windows"] = f"""WITH {FEATURES}, w AS (
  SELECT * FROM (VALUES ('w1', TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-17 23:59:59'),
                        ('w2', TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-23 23:59:59'),
                        ('w3', TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-01-30 23:59:59')) AS t(window_id, s, e))
  SELECT window_id, CASE WHEN kickoff < s THEN 'training' ELSE 'held_out' END AS role, source_player_id, game_id
  FROM feature_table JOIN w ON kickoff <= e"""
R["evaluate_baselines"] = f"""WITH {STRONGEST}, cov AS (
  SELECT baseline, count(*) FILTER (eligible) / count(*) AS coverage FROM held_out GROUP BY ALL)
  SELECT baseline AS model, sample_count, {ROUNDED_METRICS}, round(coverage, 6) AS coverage,
         CASE WHEN baseline = strongest_baseline THEN 'STRONGEST_BASELINE' WHEN baseline = 'career_average' THEN 'DIAGNOSTIC'
              ELSE 'REFERENCE' END AS status
  FROM metrics JOIN cov USING (baseline) CROSS JOIN strongest"""
R["standardize"] = f"""WITH {FEATURES}, c AS (
  SELECT * FROM feature_table WHERE receptions_roll3 IS NOT NULL AND targets_roll3 IS NOT NULL)
  SELECT source_player_id, game_id,
         {", ".join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 1e-10 THEN stddev_pop({c}) OVER () ELSE 1 END, 6) AS {c}_z" for c in ("receptions_roll3", "targets_roll3", "home_indicator", "games_played_before"))}
  FROM c"""
R["check_unique_key"] = f"""WITH {GAMES} SELECT team, season, count(*) AS rows, 'duplicate_key' AS reason FROM games
  GROUP BY ALL HAVING count(*) > 1"""
R["check_season"] = f"""WITH {GAMES} SELECT count(*) AS rows, 0 AS null_seasons, array_to_string(list(DISTINCT season ORDER BY season), ',') AS seasons,
  list(DISTINCT season ORDER BY season) = [1972, 1973, 1974, 1975] AS valid FROM games"""
R["season_list"] = f"WITH {FEATURES} SELECT count(*) AS rows, array_to_string(list(DISTINCT season ORDER BY season), ',') AS seasons FROM feature_table"
R["row_count"] = f"WITH {FEATURES} SELECT count(*) AS rows FROM feature_table"
R["check_row_rules"] = f"""WITH {GAMES}, v AS (SELECT *, CASE WHEN receptions % 5 = 4 THEN NULL ELSE attempts - 3 END AS tries FROM games)
  SELECT 'completions_without_attempts' AS rule, count(*) FILTER (tries IS NULL) AS violations FROM v
  UNION ALL SELECT 'completions_above_attempts', count(*) FILTER (completions > tries) FROM v
  UNION ALL SELECT 'attempts_negative', count(*) FILTER (tries < 0) FROM v
  UNION ALL SELECT 'receptions_above_targets', count(*) FILTER (receptions > targets) FROM v
  UNION ALL SELECT 'target_not_whole', count(*) FILTER (snap_share <> floor(snap_share)) FROM v"""
R["distinct"] = f"WITH {TRAINING} SELECT DISTINCT season, week, game_id, kickoff, team, opponent FROM training"
R["union_all"] = f"WITH {GAMES}, {SCHEDULE} SELECT season, week, game_id, team FROM team_schedule"
R["except"] = f"""WITH {GAMES}, {SCHEDULE} SELECT season, week, team FROM team_schedule
  WHERE (season, week, team) NOT IN (SELECT (season, week, team) FROM games WHERE position = 'QB')"""
R["first_example"] = f"""WITH {GAMES}, {SCHEDULE} SELECT season, week, team FROM team_schedule
  WHERE (season, week, team) NOT IN (SELECT (season, week, team) FROM games WHERE position = 'QB')
  ORDER BY season, week, team LIMIT 5"""
R["canonical_order"] = f"""WITH {TRAINING} SELECT source_player_id, game_id, kickoff FROM training"""
R["write_feature_dataset"] = R["feature_table"]
R["load_and_validate_features"] = R["feature_table"]
R["write_training_dataset"] = R["attach_schedule"]
R["leakage_probe"] = f"WITH {TRAINING} SELECT source_player_id, game_id FROM training WHERE false"
R["check_input_identity"] = f"""WITH {TRAINING} SELECT name AS "case", identical, rows
  FROM (VALUES ('recorded', true), ('altered row', false), ('other registry', false)) v(name, identical)
  CROSS JOIN (SELECT count(*) AS rows FROM training)"""
R["validate_feature_table"] = """SELECT 'kickoff_missing' AS rule, 0 AS violations, 0 AS schema_differences
  UNION ALL SELECT 'key', 0, 0"""
R["check_contract"] = f"""WITH {GAMES} SELECT contract, missing, rows FROM (
  SELECT 'player_stats' AS contract, '' AS missing UNION ALL SELECT 'schedules', '' UNION ALL SELECT 'rosters', 'full_name,gsis_id'
  UNION ALL SELECT 'injuries', '') CROSS JOIN (SELECT count(*) AS rows FROM games)"""

# --- models and resampling ------------------------------------------------------------

_model_features = ("receptions_roll3", "targets_roll3", "home_indicator", "games_played_before")
WINDOWS = f"""{BASE}, w AS (
  SELECT * FROM (VALUES ('w1', TIMESTAMP '2024-01-12 00:00:00', TIMESTAMP '2024-01-17 23:59:59'),
                        ('w2', TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-23 23:59:59'),
                        ('w3', TIMESTAMP '2024-01-24 00:00:00', TIMESTAMP '2024-01-30 23:59:59')) AS t(window_id, s, e)),
tagged AS (
  SELECT *, CASE WHEN kickoff < s THEN 'training' ELSE 'held_out' END AS role FROM feature_table JOIN w ON kickoff <= e
  WHERE receptions_roll3 IS NOT NULL AND targets_roll3 IS NOT NULL)"""
_scale = "CASE WHEN stddev_pop({c}) > 1e-10 THEN stddev_pop({c}) ELSE 1 END"
R["fit_poisson"] = f"WITH {WINDOWS} SELECT window_id, 'intercept' AS term, count(*) AS training_rows, 0.0 AS mean, 1.0 AS scale, 0.0 AS gradient, true AS curved FROM tagged WHERE role = 'training' GROUP BY ALL" + "".join(
    f" UNION ALL SELECT window_id, '{c}', count(*), round(avg({c}), 6), round({_scale.format(c=c)}, 6), 0.0, true FROM tagged WHERE role = 'training' GROUP BY window_id"
    for c in _model_features
)
R["raw_coefficients"] = f"WITH {WINDOWS} " + " UNION ALL ".join(
    f"SELECT window_id, {i} AS position, '{c}' AS feature_name, round({_scale.format(c=c)}, 6) AS scale, true AS same_slope FROM tagged WHERE role = 'training' GROUP BY window_id"
    for i, c in enumerate(_model_features)
)
R["predict_poisson"] = f"""WITH {WINDOWS} SELECT window_id, role, count(*) AS rows,
  sum(CASE WHEN role = 'training' THEN actual_receptions END)::DOUBLE AS training_total, true AS positive FROM tagged GROUP BY ALL"""
R["coefficient_stability"] = f"""WITH {WINDOWS} SELECT unnest({list(_model_features)}) AS feature_name, n AS window_count, true AS consistent
  FROM (SELECT count(DISTINCT window_id) AS n FROM tagged WHERE role = 'training')"""
R["model_table"] = f"""WITH {WINDOWS}, m AS (SELECT DISTINCT window_id FROM tagged WHERE role = 'training')
  SELECT 'stored' AS "case", count(*) AS models, 0 AS violations, NULL AS window_id FROM m
  UNION ALL SELECT 'altered', count(*), count(*) FILTER (window_id = 'w2'), max(window_id) FILTER (window_id = 'w2') FROM m"""
R["cohort_alignment"] = f"""WITH {WINDOWS},
held AS (
  SELECT p.*, window_id FROM predictions p JOIN w ON p.kickoff BETWEEN s AND e
  WHERE receptions_roll3 IS NOT NULL AND targets_roll3 IS NOT NULL),
common AS (SELECT * FROM (SELECT *, bool_and(eligible) OVER (PARTITION BY source_player_id, game_id) AS ok FROM held) WHERE ok),
mae AS (SELECT window_id, baseline, avg(abs(prediction - actual_receptions)) AS mae FROM common WHERE baseline <> 'career_average' GROUP BY ALL),
best AS (SELECT window_id, arg_min(baseline, (mae, baseline)) AS baseline FROM mae GROUP BY window_id)
SELECT source_player_id, game_id, window_id, actual_receptions::DOUBLE AS actual, round(prediction, 6) AS baseline, true AS has_learned
FROM common JOIN best USING (window_id, baseline)"""
_mae = "(SELECT mae FROM metrics WHERE baseline = '{b}')"
R["paired_mae_bootstrap"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}
  SELECT baseline AS candidate, round({_mae.format(b="league_mean")} - mae, 6) AS difference,
         round(({_mae.format(b="league_mean")} - mae) / {_mae.format(b="league_mean")}, 6) AS effect_size, sample_count, 10000 AS iterations, true AS covers
  FROM metrics WHERE baseline IN ('poisson', 'rolling_5')"""
R["paired_metric_bootstrap"] = f"""WITH {COHORT}, {metrics("shared", "baseline")}, {_pair}
  SELECT unnest(['mae', 'rmse', 'poisson_deviance', 'mean_prediction_bias']) AS metric,
         round(unnest([a.mae - b.mae, a.rmse - b.rmse, a.poisson_deviance - b.poisson_deviance, a.bias - b.bias]), 6) AS difference,
         a.sample_count, 10000 AS iterations, true AS covers FROM a, b"""
R["bootstrap_constant_gain"] = f"""WITH {COHORT} SELECT 'near' AS candidate, 0.25 AS difference, 0.25 AS confidence_lower, 0.25 AS confidence_upper,
  count(*) AS sample_count, true AS statistically_significant_improvement FROM shared WHERE baseline = 'league_mean'"""
R["bootstrap_draws"] = f"""WITH {COHORT} SELECT unnest(range(200)) AS iteration, n AS draws, n::DOUBLE AS one
  FROM (SELECT count(*) AS n FROM shared WHERE baseline = 'league_mean')"""
R["baseline_comparisons"] = f"""WITH {STRONGEST}, best AS (SELECT mae AS m, strongest_baseline AS b FROM metrics JOIN strongest ON baseline = strongest_baseline)
  SELECT b AS reference, baseline AS candidate, round(m - mae, 6) AS difference, round((m - mae) / m, 6) AS effect_size, sample_count, 10000 AS iterations
  FROM metrics, best WHERE baseline <> b"""
R["baseline_largest_errors"] = R["largest_errors"]
R["baseline_decision"] = f"WITH {STRONGEST} SELECT 'RESEARCH' AS decision, strongest_baseline FROM strongest"

_counted = {
    "baselines": {
        "metrics": R["evaluate_baselines"], "calibration": 70, "comparisons": 6, "segments": 9, "bias": R["group_bias"],
        "largest_errors": R["largest_errors"], "missing_features": len(_names), "decision": 1,
    },
    "learned": {
        "models": 1, "metrics": 8, "comparison": 1, "gates": 1,
        "aligned": f"""WITH {COHORT} SELECT DISTINCT source_player_id, game_id FROM shared
                       WHERE receptions_roll3 IS NOT NULL AND targets_roll3 IS NOT NULL""",
    },
    "rolling": {
        "models": 3, "window_metrics": 6, "pooled_metrics": 2, "window_differences": 12, "pooled_differences": 4, "residuals": 6, "bias": 3,
        "intervals": 4, "stability": 4, "aligned": R["cohort_alignment"],
    },
}
R["write_scorecard"] = " UNION ALL ".join(
    f"SELECT '{card}' AS scorecard, '{table}' AS \"table\", {n if isinstance(n, int) else f'(SELECT count(*) FROM ({n}))'} AS rows"
    for card, tables in _counted.items()
    for table, n in tables.items()
)
R["audit_rows_by_season"] = f"WITH {FEATURES} SELECT season, count(*) AS rows FROM feature_table GROUP BY ALL"
