"""Contracts of the raw season datasets."""

from __future__ import annotations

from dataclasses import dataclass

from tallyfield.operators.quality import ContractError, missing_columns


@dataclass(frozen=True)
class Contract:
    name: str
    required: tuple[str, ...]
    any_of: tuple[tuple[str, ...], ...] = ()
    sort_keys: tuple[str, ...] = ()
    has_season: bool = True

    def check(self, df) -> None:
        missing = missing_columns(df, self.required, self.any_of)
        if missing:
            raise ContractError(f"{self.name}: missing {missing}")


# Required columns and sort keys per dataset.
CONTRACTS = {
    c.name: c
    for c in (
        Contract(
            "player_stats",
            ("season", "week", "player_id", "player_display_name", "position", "receptions"),
            (("team",), ("recent_team",)),
            ("season", "week", "player_id"),
        ),
        Contract("pbp", ("season", "week", "game_id", "play_id"), (), ("season", "week", "game_id", "play_id")),
        Contract(
            "schedules",
            ("season", "week", "game_id", "gameday", "home_team", "away_team"),
            (),
            ("season", "week", "game_id"),
        ),
        Contract("rosters", ("season", "gsis_id", "full_name", "position"), (), ("season", "gsis_id")),
        Contract(
            "weekly_rosters",
            ("season", "week", "gsis_id", "full_name", "position"),
            (),
            ("season", "week", "gsis_id"),
        ),
        Contract("snap_counts", ("season", "week", "game_id"), (), ("season", "week", "game_id", "pfr_player_id")),
        Contract("participation", ("nflverse_game_id", "play_id"), (), ("nflverse_game_id", "play_id"), False),
        Contract("injuries", ("season", "week"), (), ("season", "week", "gsis_id", "full_name")),
        Contract(
            "depth_charts",
            ("gsis_id",),
            (("season", "week"), ("dt", "team")),
            ("season", "week", "dt", "team", "gsis_id"),
        ),
    )
}
