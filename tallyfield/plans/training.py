"""Training table: one row per receiver and game, from season statistics and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.names import normalize_name
from tallyfield.operators import quality
from tallyfield.sources.contracts import CONTRACTS

# Column order of the training table.
TRAINING_COLUMNS = (
    "season",
    "week",
    "game_id",
    "kickoff",
    "source_player_id",
    "raw_player_name",
    "canonical_player_name",
    "position",
    "team",
    "opponent",
    "is_home",
    "actual_receptions",
)


def with_team(stats: DataFrame) -> DataFrame:
    return stats if "team" in stats.columns else stats.withColumnRenamed("recent_team", "team")


def regular_receivers(stats: DataFrame) -> DataFrame:
    """Receivers only, regular season only where the column exists."""
    rows = stats.filter(F.upper("position") == "WR")
    return rows.filter(F.col("season_type") == "REG") if "season_type" in stats.columns else rows


def kickoff(day: Column, time: Column) -> Column:
    """Lenient kickoff timestamp; a missing time counts as midnight."""
    text = F.concat_ws(" ", day.cast("string"), F.coalesce(time.cast("string"), F.lit("00:00")))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")


def team_schedule(schedules: DataFrame) -> DataFrame:
    """Two rows per game, one per team, in a single scan."""
    games = schedules.filter(F.col("game_type") == "REG") if "game_type" in schedules.columns else schedules
    time = F.col("gametime") if "gametime" in games.columns else F.lit(None).cast("string")
    sides = [
        F.struct(F.col(a).alias("team"), F.col(b).alias("opponent"), F.lit(home).cast("byte").alias("is_home"))
        for a, b, home in (("home_team", "away_team", 1), ("away_team", "home_team", 0))
    ]
    return games.withColumn("kickoff", kickoff(F.col("gameday"), time)).select(
        "season", "week", "game_id", "kickoff", F.inline(F.array(*sides))
    )


def project_training(stats: DataFrame) -> DataFrame:
    """Identity, normalised name and integer target of each receiver row."""
    return stats.select(
        "season",
        "week",
        F.col("player_id").cast("string").alias("source_player_id"),
        F.col("player_display_name").alias("raw_player_name"),
        normalize_name(F.col("player_display_name")).alias("canonical_player_name"),
        "position",
        "team",
        F.col("receptions").cast("long").alias("actual_receptions"),
    )


def unmatched(rows: DataFrame, schedule: DataFrame) -> DataFrame:
    return rows.join(schedule, ["season", "week", "team"], "left_anti")


def build_training_table(player_stats: DataFrame, schedules: DataFrame, strict: bool = True) -> DataFrame:
    """Receiver rows joined to their game. ``strict`` raises on any contract violation."""
    stats, calendar = CONTRACTS["player_stats"], CONTRACTS["schedules"]
    missing = quality.missing_columns(player_stats, stats.required, stats.any_of)
    missing += quality.missing_columns(schedules, calendar.required, calendar.any_of)
    if missing:
        raise quality.ContractError(f"missing columns: {missing}")
    receivers = regular_receivers(with_team(player_stats))
    schedule = team_schedule(schedules)
    if strict:
        quality.require(quality.rule_violations(receivers, quality.training_rules()), "player_stats")
        quality.require(quality.unique_key_violations(schedule, ["season", "week", "team"]), "schedules", "rows")
    rows = project_training(receivers)
    table = rows.join(schedule, ["season", "week", "team"], "left").select(*TRAINING_COLUMNS)
    if strict:
        examples = unmatched(rows, schedule).select("season", "week", "team").take(5)
        if examples:
            raise quality.ContractError(f"no scheduled game for {examples}")
        quality.require(quality.unique_key_violations(table, ["source_player_id", "game_id"]), "training", "rows")
    return table
