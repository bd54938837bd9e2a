"""Point-in-time features: every value comes from games before the current one.

Histories are ``ROWS`` frames that end one row before the current game. Rolling means are
strict: one missing value inside the frame makes the mean missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tallyfield.operators import quality
from tallyfield.operators.scan import look_back, ordered, running
from tallyfield.plans.registry import ENABLED, TABLE_COLUMNS, Feature
from tallyfield.session import materialize

GAME_ORDER = ["kickoff", "game_id"]
PLAYER = "source_player_id"


def finite(column: Column) -> Column:
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator)


def _before(window: WindowSpec, rows: int) -> WindowSpec:
    return window.rowsBetween(-rows, -1)


def windowed(feature: Feature, window: WindowSpec) -> Column:
    """Bounded look-back expression of one registered feature."""
    frame = _before(window, feature.window)
    source = F.col(feature.source) if feature.kind != "ratio" else None
    if feature.kind == "lag":
        return F.lag(source).over(window)
    if feature.kind == "mean":
        present, size = F.count(source).over(frame), F.count(F.lit(1)).over(frame)
        return F.when((size > 0) & (present == size), F.avg(source).over(frame))
    if feature.kind == "ratio":
        top, bottom = (F.col(c) for c in feature.source.split("/"))
        both = top.isNotNull() & bottom.isNotNull()
        return ratio(F.sum(F.when(both, top)).over(frame), F.sum(F.when(both, bottom)).over(frame))
    if feature.kind == "rest":
        micros = F.unix_micros(source.cast("timestamp"))
        return (micros - F.lag(micros).over(window)) / F.lit(86_400_000_000.0)
    raise ValueError(feature.kind)


def _select(scope: str) -> list[Feature]:
    return [f for f in ENABLED if f.scope == scope and f.window]


def _add(features: list[Feature]):
    return lambda df, window: df.withColumns({f.name: windowed(f, window) for f in features})


def prepared_stats(player_stats: DataFrame) -> DataFrame:
    """Regular-season rows with one name for the player and the team column."""
    rows = player_stats
    if "season_type" in rows.columns:
        rows = rows.filter(F.col("season_type") == "REG")
    player = "player_id" if "player_id" in rows.columns else PLAYER
    team = "team" if "team" in rows.columns else "recent_team"
    optional = [c for c in ("attempts", "completions") if c in rows.columns]
    if optional == ["completions"]:
        raise quality.ContractError("completions need attempts")
    numbers = ["receptions", "targets", "receiving_yards", *optional]
    return rows.select(
        F.col(player).cast("string").alias(PLAYER),
        F.col("season").cast("int").alias("season"),
        F.col("week").cast("int").alias("week"),
        F.col(team).cast("string").alias("team"),
        F.upper("position").alias("position"),
        *[F.col(c).try_cast("double").alias(c) for c in numbers],
        *[F.lit(None).cast("double").alias(c) for c in ("attempts", "completions") if c not in optional],
    )


def receiver_stats(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("position") == "WR").select(
        PLAYER, "season", "week", "team", "receptions", "targets", "receiving_yards"
    )


def attach_stats(training: DataFrame, stats: DataFrame) -> DataFrame:
    """Box score of each training row."""
    return training.join(receiver_stats(stats), [PLAYER, "season", "week", "team"], "left")


def team_game_totals(stats: DataFrame) -> DataFrame:
    """Per team and week over all positions: receiver targets, attempts, completions."""
    receiver = F.when(F.col("position") == "WR", F.coalesce("targets", F.lit(0.0)))
    return stats.groupBy("season", "week", "team").agg(
        F.coalesce(F.sum(receiver), F.lit(0.0)).alias("wr_targets"),
        F.max(receiver).alias("max_wr_targets"),
        F.sum("attempts").alias("attempts"),
        F.sum("completions").alias("completions"),
    )


def allowed_by_defense(joined: DataFrame) -> DataFrame:
    """Calendar of team games with the receiver production in each of them.

    Read per ``opponent`` it is what that defence allowed. Distinct games and sums come
    from the same shuffle.
    """
    return joined.groupBy("season", "week", "game_id", "kickoff", "team", "opponent").agg(
        F.sum("receptions").alias("opponent_wr_receptions_allowed"),
        F.sum("targets").alias("opponent_wr_targets_allowed"),
    )


def team_games(joined: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per team and game with offence and allowed totals."""
    table = allowed_by_defense(joined).join(team_game_totals(stats), ["season", "week", "team"])
    return table.withColumns(
        {
            "team_pass_attempts": finite(F.col("attempts")),
            "team_completions": finite(F.col("completions")),
            "team_completion_rate": ratio(F.col("completions"), F.col("attempts")),
            "team_target_concentration": ratio(F.col("max_wr_targets"), F.col("wr_targets")),
            "opponent_pass_attempts_allowed": finite(F.col("attempts")),
            "opponent_completions_allowed": finite(F.col("completions")),
        }
    )


def team_context(games: DataFrame) -> DataFrame:
    """Rolling means per team and per opposing defence, both inside the season."""
    offence = look_back(ordered(games, ["season", "team"], GAME_ORDER), 5, _add(_select("team"))).result()
    defence = ordered(offence, ["season", "opponent"], GAME_ORDER, sizes_of=games)
    both = look_back(defence, 5, _add(_select("opponent"))).result()
    names = [f.name for f in _select("team") + _select("opponent")]
    return both.select("season", "game_id", "team", F.col("attempts").alias("_attempts"), *names)


def optional_usage(rows: DataFrame, usage: DataFrame | None, value: str) -> DataFrame:
    """Attach an optional usage share by player and game; absent input means missing."""
    if usage is None:
        return rows.withColumn(value, F.lit(None).cast("double"))
    player = PLAYER if PLAYER in usage.columns else "player_id"
    shares = usage.select(
        F.col(player).cast("string").alias(PLAYER), F.col("game_id").cast("string").alias("game_id"),
        F.col(value).try_cast("double").alias(value),
    )
    return rows.join(shares, [PLAYER, "game_id"], "left")


def usage_violations(usage: DataFrame, value: str) -> DataFrame:
    return quality.nullable_float_violations(usage, {value: (0.0, 1.0)})


def player_history(rows: DataFrame, sizes_of: DataFrame) -> DataFrame:
    """Lags, rolling means, ratios, season means and counts along each player's games."""
    scan = ordered(rows, [PLAYER], GAME_ORDER, sizes_of=sizes_of)
    scan = look_back(scan, 8, _add(_select("player")))
    scan = running(scan, {"games_played_before": ("count", F.lit(1))})
    season = [f for f in ENABLED if f.scope == "player_season"]
    totals = {"_games": ("count", F.lit(1))}
    for f in season:
        totals[f"_n_{f.source}"] = ("count", F.col(f.source))
        totals[f"_sum_{f.source}"] = ("sum", F.col(f.source))
    scan = running(scan, totals, by=["season"])
    complete = {
        f.name: F.when(
            (F.col("_games") > 0) & (F.col(f"_n_{f.source}") == F.col("_games")),
            F.col(f"_sum_{f.source}") / F.col("_games"),
        )
        for f in season
    }
    return scan.result().withColumns(complete)


def row_features(rows: DataFrame) -> DataFrame:
    """Pregame facts and missing-value indicators."""
    out = {}
    for f in ENABLED:
        if f.scope != "row":
            continue
        source = F.col(f.source)
        out[f.name] = {"copy": source, "missing": source.isNull(), "positive": source > 0}[f.kind].cast(f.dtype)
    return rows.withColumns(out)


def registry_cast(rows: DataFrame) -> DataFrame:
    """Registered types and column order."""
    types = {f.name: f.dtype for f in ENABLED}
    types |= {"season": "int", "week": "int", "is_home": "byte"}
    return rows.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in TABLE_COLUMNS])


def build_feature_table(
    training: DataFrame,
    player_stats: DataFrame,
    snap_counts: DataFrame | None = None,
    participation: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """The 63-column feature table. ``strict`` raises on input violations first."""
    stats = prepared_stats(player_stats)
    if strict:
        check_inputs(training, stats, snap_counts, participation)
    joined = attach_stats(training, stats)
    # One small row per team and game; both context windows read it.
    context = team_context(materialize(team_games(joined, stats)))
    rows = joined.join(context, ["season", "game_id", "team"], "left")
    rows = optional_usage(rows, snap_counts, "snap_share")
    rows = optional_usage(rows, participation, "route_participation")
    rows = rows.withColumns(
        {
            "target_share": ratio(finite(F.col("targets")), finite(F.col("_attempts"))),
            **{
                c: finite(F.col(c))
                for c in ("receptions", "targets", "receiving_yards", "snap_share", "route_participation")
            },
        }
    )
    return registry_cast(row_features(player_history(rows, training)))


def check_inputs(training, stats, snap_counts=None, participation=None) -> None:
    receivers = receiver_stats(stats)
    quality.require(quality.unique_key_violations(training, [PLAYER, "game_id"]), "training_table", "rows")
    quality.require(
        quality.rule_violations(training, {"kickoff_missing": F.col("kickoff").isNull()}), "training_table"
    )
    quality.require(quality.unique_key_violations(receivers, [PLAYER, "season", "week", "team"]), "player_stats", "rows")
    quality.require(quality.rule_violations(receivers, quality.usage_rules()), "player_stats")
    quality.require(quality.rule_violations(stats, quality.passing_rules()), "player_stats")
    lost = training.join(receivers, [PLAYER, "season", "week", "team"], "left_anti")
    if lost.take(1):
        raise quality.ContractError(f"no statistics for {lost.take(1)}")
    games = training.select("season", "week", "game_id", "kickoff", "team", "opponent").dropDuplicates()
    quality.require(quality.unique_key_violations(games, ["season", "week", "team"]), "training calendar", "rows")
    for usage, value in ((snap_counts, "snap_share"), (participation, "route_participation")):
        if usage is None:
            continue
        player = PLAYER if PLAYER in usage.columns else "player_id"
        quality.require(quality.unique_key_violations(usage, [player, "game_id"]), value, "rows")
        bad = usage_violations(usage, value)
        total = F.col("not_numeric") + F.col("not_finite") + F.col("below_minimum") + F.col("above_maximum")
        quality.require(bad.withColumn("violations", total), value)


def leakage_probe(build, training: DataFrame, stats: DataFrame, cut) -> DataFrame:
    """Rows before ``cut`` whose features change when outcomes from ``cut`` on are altered.

    Rebuilds the table from mutated inputs; an empty result means no leakage.
    """
    stats = prepared_stats(stats)
    late = training.filter(F.col("kickoff") >= F.lit(cut)).select("season", "week", "team").dropDuplicates()
    altered = stats.join(late.withColumn("_late", F.lit(True)), ["season", "week", "team"], "left")
    bump = F.when(F.col("_late"), 1).otherwise(0)
    changed = altered.withColumns(
        {c: F.col(c) + bump for c in ("receptions", "targets", "receiving_yards", "attempts", "completions")}
    ).drop("_late")
    before = lambda df: df.filter(F.col("kickoff") < F.lit(cut)).drop("actual_receptions")
    return before(build(training, changed)).exceptAll(before(build(training, stats)))


