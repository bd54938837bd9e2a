"""Feature registry: the definitions that drive the history windows and the table layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Feature:
    """``scope`` is the history it reads; ``kind`` and ``window`` how; ``source`` from what."""

    name: str
    scope: str
    kind: str
    source: str
    window: int = 0
    dtype: str = "double"
    enabled: bool = True


def _player_box_score() -> list[Feature]:
    out = []
    for source in ("receptions", "targets", "receiving_yards"):
        out.append(Feature(f"{source}_lag1", "player", "lag", source, 1))
        out += [Feature(f"{source}_roll{k}", "player", "mean", source, k) for k in (3, 5, 8)]
    for k in (3, 5, 8):
        out.append(Feature(f"catch_rate_roll{k}", "player", "ratio", "receptions/targets", k))
        out.append(Feature(f"target_share_roll{k}", "player", "mean", "target_share", k))
    out += [
        Feature(f"{source}_season_mean", "player_season", "mean", source)
        for source in ("receptions", "targets", "receiving_yards")
    ]
    return out


def _usage(source: str) -> list[Feature]:
    return [
        Feature(f"{source}_lag1", "player", "lag", source, 1),
        Feature(f"{source}_roll3", "player", "mean", source, 3),
        Feature(f"{source}_roll5", "player", "mean", source, 5),
        Feature(f"{source}_missing", "row", "missing", f"{source}_lag1", dtype="byte"),
    ]


def _context(scope: str, names: tuple[str, ...]) -> list[Feature]:
    return [Feature(f"{n}_roll{k}", scope, "mean", n, k) for n in names for k in (3, 5)]


# Source columns of the team and opponent context, in table order.
TEAM_CONTEXT = ("team_pass_attempts", "team_completions", "team_completion_rate", "team_target_concentration")
OPPONENT_CONTEXT = (
    "opponent_pass_attempts_allowed",
    "opponent_completions_allowed",
    "opponent_wr_receptions_allowed",
    "opponent_wr_targets_allowed",
)

FEATURES: tuple[Feature, ...] = (
    *_player_box_score(),
    Feature("games_played_before", "player", "count", "game_id", dtype="long"),
    *_usage("snap_share"),
    *_usage("route_participation"),
    *_context("team", TEAM_CONTEXT),
    *_context("opponent", OPPONENT_CONTEXT),
    Feature("home_indicator", "row", "copy", "is_home", dtype="byte"),
    Feature("rest_days", "player", "rest", "kickoff", 1),
    Feature("game_week", "row", "copy", "week", dtype="int"),
    Feature("season_year", "row", "copy", "season", dtype="int"),
    Feature("has_prior_history", "row", "positive", "games_played_before", dtype="byte"),
    Feature("team_plays_roll3", "team", "mean", "plays", 3, enabled=False),
    Feature("team_plays_roll5", "team", "mean", "plays", 5, enabled=False),
    Feature("player_age", "row", "copy", "birth_date", enabled=False),
    Feature("prior_injury_designation", "row", "copy", "report_status", dtype="string", enabled=False),
    Feature("same_game_targets", "row", "copy", "targets", enabled=False),
)
ENABLED = tuple(f for f in FEATURES if f.enabled)
FEATURE_NAMES = tuple(f.name for f in ENABLED)

IDENTIFIERS = ("source_player_id", "canonical_player_name", "game_id")
METADATA = ("season", "week", "kickoff", "raw_player_name", "position", "team", "opponent", "is_home")
TARGET = "actual_receptions"
TABLE_COLUMNS = (*IDENTIFIERS, *METADATA, *FEATURE_NAMES, TARGET)


def table_schema() -> T.StructType:
    fixed = {"season": "int", "week": "int", "kickoff": "timestamp_ntz", "is_home": "tinyint", TARGET: "bigint"}
    typed = {f.name: {"byte": "tinyint", "long": "bigint"}.get(f.dtype, f.dtype) for f in ENABLED}
    return T.StructType.fromDDL(", ".join(f"{c} {typed.get(c, fixed.get(c, 'string'))}" for c in TABLE_COLUMNS))
