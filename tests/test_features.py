"""Feature table against plain loops over a small invented league."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import same_rows
from pyspark.sql import functions as F

from tallyfield.operators import history, quality
from tallyfield.plans.registry import ENABLED, TABLE_COLUMNS, table_schema
from tallyfield.plans.training import build_training_table
from tallyfield.session import ROWS_PER_TASK

STATS = (
    "season int, week int, season_type string, player_id string, player_display_name string, position string, "
    "recent_team string, receptions double, targets double, receiving_yards double, attempts double, completions double"
)
SCHEDULE = (
    "season int, week int, game_type string, game_id string, gameday string, gametime string, "
    "home_team string, away_team string"
)
TEAMS = ["AUR", "BOR", "CYG", "DRA"]
#: Every round pairs the four teams anew; the gap before a round is in days.
ROUNDS = [(0, 1, 2, 3, 7), (0, 2, 3, 1, 6), (3, 0, 1, 2, 8), (1, 0, 3, 2, 20), (2, 0, 1, 3, 7), (0, 3, 2, 1, 5), (1, 3, 0, 2, 9)]


def league():
    """Games as (season, week, id, kickoff, home, away) and box scores as plain dicts."""
    pick, games, boxes = random.Random(77), [], []
    for season, start in ((2031, datetime(2031, 3, 2, 15, 30)), (2032, datetime(2032, 2, 29, 18, 0))):
        at = start
        for week, (a, b, c, d, gap) in enumerate(ROUNDS, start=3):
            at += timedelta(days=gap)
            for home, away in ((a, b), (c, d)):
                games.append((season, week, f"g{season % 100}{week:02d}{home}", at + timedelta(hours=home), TEAMS[home], TEAMS[away]))
    for number, (season, week, gid, at, home, away) in enumerate(games):
        for team in (home, away):
            boxes.append(dict(season=season, week=week, gid=gid, pid=f"thrower-{team}", pos="QB", team=team, rec=0, tgt=0, yds=0, att=pick.randint(18, 44), cmp=pick.randint(9, 18)))
            for slot in range(3):
                pid = f"{team.lower()}-{slot}"
                if slot == 2 and number < 9:
                    continue  # joins late
                if pid == "bor-1" and season == 2032:
                    pid = "aur-9"  # the place goes to another
                if pid == "dra-0" and week == 5:
                    continue  # misses a round
                tgt = 0 if (pid == "cyg-0" and number < 6) else pick.randint(0, 12)
                boxes.append(dict(season=season, week=week, gid=gid, pid=pid, pos="WR", team=team, rec=pick.randint(0, tgt), tgt=tgt, yds=pick.randint(0, 130), att=0, cmp=0))
    # One receiver changes teams between the seasons.
    for box in boxes:
        if box["pid"] == "aur-0" and box["season"] == 2032:
            box["pid"] = "moved-aur"
        if box["pid"] == "dra-1" and box["season"] == 2032:
            box["pid"] = "aur-0"
    return games, boxes


GAMES, BOXES = league()


def frames(spark, boxes=BOXES):
    stats = [
        (b["season"], b["week"], "REG", b["pid"], f"Name of {b['pid']}", b["pos"], b["team"], *(float(b[c]) for c in ("rec", "tgt", "yds", "att", "cmp")))
        for b in boxes
    ]
    schedule = [(s, w, "REG", g, f"{at:%Y-%m-%d}", f"{at:%H:%M}", h, a) for s, w, g, at, h, a in GAMES]
    return spark.createDataFrame(stats, STATS), spark.createDataFrame(schedule, SCHEDULE)


def mean(values):
    return sum(values) / len(values) if values else None


def by_hand(boxes=BOXES):
    """(player, game) -> some features, by loops over everything that came before."""
    when = {g: at for _, _, g, at, _, _ in GAMES}
    sides = {(g, h): a for _, _, g, _, h, a in GAMES} | {(g, a): h for _, _, g, _, h, a in GAMES}
    attempts = {(b["gid"], b["team"]): b for b in boxes if b["pos"] == "QB"}
    targets = {}
    for b in boxes:
        if b["pos"] == "WR":
            targets[b["gid"], b["team"]] = targets.get((b["gid"], b["team"]), 0) + b["tgt"]
    season_of = {g: s for s, _, g, _, _, _ in GAMES}
    out = {}
    for b in (b for b in boxes if b["pos"] == "WR"):
        now = when[b["gid"]]
        past = sorted((o for o in boxes if o["pid"] == b["pid"] and when[o["gid"]] < now), key=lambda o: when[o["gid"]])
        own = [o for o in past if o["season"] == b["season"]]

        def games_of(team, now=now, season=b["season"]):
            ids = [g for (g, t) in sides if t == team and when[g] < now and season_of[g] == season]
            return sorted(ids, key=when.get)

        team, foe = games_of(b["team"])[-3:], games_of(sides[b["gid"], b["team"]])[-3:]
        other = sides[b["gid"], b["team"]]
        out[b["pid"], b["gid"]] = {
            "receptions_lag1": past[-1]["rec"] if past else None,
            "receptions_roll3": mean([o["rec"] for o in past[-3:]]),
            "targets_roll5": mean([o["tgt"] for o in past[-5:]]),
            "receptions_season_mean": mean([o["rec"] for o in own]),
            "games_played_before": len(past),
            "has_prior_history": int(bool(past)),
            "rest_days": (now - when[past[-1]["gid"]]) / timedelta(days=1) if past else None,
            "target_share_roll3": mean([o["tgt"] / attempts[o["gid"], o["team"]]["att"] for o in past[-3:]]),
            "catch_rate_roll3": (
                sum(o["rec"] for o in past[-3:]) / sum(o["tgt"] for o in past[-3:]) if sum(o["tgt"] for o in past[-3:]) else None
            ),
            "team_pass_attempts_roll3": mean([attempts[g, b["team"]]["att"] for g in team]),
            "team_completion_rate_roll3": mean([attempts[g, b["team"]]["cmp"] / attempts[g, b["team"]]["att"] for g in team]),
            "opponent_pass_attempts_allowed_roll3": mean([attempts[g, sides[g, other]]["att"] for g in foe]),
            "opponent_wr_targets_allowed_roll3": mean([targets[g, sides[g, other]] for g in foe]),
        }
    return out


@pytest.fixture(scope="module")
def built(spark):
    stats, schedules = frames(spark)
    training = build_training_table(stats, schedules)
    return training, stats, history.build_feature_table(training, stats)


def test_features_equal_loops(built):
    got = {(r.source_player_id, r.game_id): r for r in built[2].collect()}
    want = by_hand()
    assert set(got) == set(want)
    for key, values in want.items():
        for name, value in values.items():
            assert got[key][name] == (value if value is None else pytest.approx(value)), (key, name)


def test_the_league_has_the_cases_that_matter():
    want = by_hand()
    assert any(v["catch_rate_roll3"] is None and v["games_played_before"] >= 3 for v in want.values())
    assert any(v["receptions_season_mean"] is None and v["receptions_lag1"] is not None for v in want.values())
    assert any(v["rest_days"] and v["rest_days"] > 19 for v in want.values())
    assert len({b["team"] for b in BOXES if b["pid"] == "aur-0"}) == 2


def test_layout(built):
    assert len(ENABLED) == 51 and len(TABLE_COLUMNS) == 63
    assert quality.schema_differences(built[2], table_schema()) == []


def test_one_missing_usage_value_empties_the_means_that_hold_it(built, spark):
    training, stats, _ = built
    own = [r.game_id for r in training.filter("source_player_id = 'cyg-1'").orderBy("kickoff").collect()]
    shares = [0.25, 0.5, None, 1.0, 0.75, 0.125]
    usage = spark.createDataFrame(
        [("cyg-1", g, s) for g, s in zip(own, shares, strict=False)], "source_player_id string, game_id string, snap_share double"
    )
    table = history.build_feature_table(training, stats, snap_counts=usage)
    rows = {r.game_id: r for r in table.filter("source_player_id = 'cyg-1'").collect()}
    expected = [None, 0.25, 0.375, None, None, None, (1.0 + 0.75 + 0.125) / 3]
    assert [rows[g].snap_share_roll3 for g in own[:7]] == expected
    assert rows[own[4]].snap_share_lag1 == 1.0


def test_split_groups_and_input_order_do_not_matter(built, spark):
    training, stats, table = built
    spark.conf.set(ROWS_PER_TASK, "3")
    try:
        again = history.build_feature_table(training.orderBy(F.rand(1)), stats.orderBy(F.rand(2)), strict=False)
        same_rows(again, table)
    finally:
        spark.conf.unset(ROWS_PER_TASK)


def test_no_leakage_and_a_leaking_build_is_caught(built):
    training, stats, _ = built
    cut = GAMES[7][3]
    build = lambda t, s: history.build_feature_table(t, s, strict=False)
    assert history.leakage_probe(build, training, stats, cut).count() == 0

    def leaking(t, s):
        later = s.groupBy(F.col("source_player_id")).agg(F.sum("targets").alias("all_targets"))
        return build(t, s).join(later, "source_player_id", "left")

    assert history.leakage_probe(leaking, training, stats, cut).count() > 0


def test_contract_errors(built, spark):
    training, stats, _ = built
    raised = pytest.raises(quality.ContractError)
    with raised:
        history.build_feature_table(training.unionAll(training.limit(1)), stats)
    with raised:
        history.build_feature_table(training, stats.withColumn("receptions", F.col("targets") + 2))
    with raised:
        history.build_feature_table(training, stats.filter("player_id <> 'bor-0'"))
    other, schedules = frames(spark)
    with raised:
        build_training_table(other.drop("receptions"), schedules)
    with raised:
        build_training_table(other, schedules.filter("week <> 6"))
    usage = spark.createDataFrame([("bor-0", GAMES[0][2], -0.25)], "source_player_id string, game_id string, snap_share double")
    with raised:
        history.build_feature_table(training, stats, snap_counts=usage)
