from datetime import datetime, timedelta

import pytest

from tallyfield.operators import feeds, market

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "quote_id string, batch string, event_id int, player_id string, book_id string, market string, side string, line double, "
    "american_odds int, captured_at timestamp_ntz"
)


def quotes(spark, rows):
    return spark.createDataFrame(
        [(f"q{i}", r.get("batch", "b"), 1, r.get("player", "P"), r["book"], "player_receptions", r.get("side", "over"), r["line"], r["odds"], T0 + timedelta(hours=r.get("at", i))) for i, r in enumerate(rows)],
        SCHEMA,
    )


def test_ranking_of_four_offers(spark):
    df = quotes(
        spark,
        [dict(book="FanDuel", line=6.5, odds=-118), dict(book="BetMGM", line=7.5, odds=110), dict(book="DraftKings", line=6.5, odds=-105), dict(book="Caesars", line=6.5, odds=-110)],
    )
    ranked = market.rank_offers(df, player="p", side="over").orderBy("rank").collect()
    assert [r.book_id for r in ranked] == ["DraftKings", "Caesars", "FanDuel", "BetMGM"]
    assert (ranked[0].decimal_odds, ranked[0].implied_probability) == (1.9524, 0.5122)
    best = market.best_line(df).first()
    assert best.book_id == "DraftKings" and best.reason.startswith("Selected the lowest OVER line")


def test_best_line_sides_and_filters(spark):
    df = quotes(
        spark,
        [dict(book="a", line=6.5, odds=-110, side="under"), dict(book="b", line=7.5, odds=-130, side="under"), dict(book="b", line=5.5, odds=-110, side="under", at=9), dict(book="c", line=None, odds=120, side="yes"), dict(book="d", line=None, odds=130, side="yes")],
    )
    best = {r.side: r for r in market.best_line(df).collect()}
    assert best["under"].line == 7.5 and best["yes"].american_odds == 130
    assert best["yes"].reason == "Selected the best available price for this binary market."
    assert {r.side: r.line for r in market.best_line(df, latest_only=True).collect()}["under"] == 6.5
    assert market.best_line(df, as_of=T0).count() == 1


def test_movement_and_consensus(spark):
    df = quotes(spark, [dict(book="one", line=6.5, odds=-105), dict(book="two", line=7.5, odds=110), dict(book="one", line=7.0, odds=100)])
    rows = {r.book_id: r for r in market.movement_summary(df).collect()}
    one = rows["one"]
    assert (one.first_line, one.latest_line, one.moved_first, one.consensus_line, one.books_contributing) == (6.5, 7.0, "one", 7.25, 2)
    directed = market.movement_direction(df)
    assert [r.direction for r in directed.orderBy("captured_at").collect()] == ["INITIAL", "INITIAL", "UP"]
    pages = market.movement_pages(market.movement_points(directed), 1).filter("book_id = 'one'").orderBy("page_no").collect()
    assert [p.points[0].direction for p in pages] == ["INITIAL", "UP"]


def test_summary_holds_the_points_of_its_series(spark):
    steps = [(6.5, -105), (6.5, -105), (7.0, -105), (None, -110), (7.0, -110), (6.0, 100)]
    df = quotes(spark, [dict(book="one", line=line, odds=odds) for line, odds in steps] + [dict(book="two", line=None, odds=110)])
    rows = {r.book_id: r for r in market.movement_summary(df.repartition(3)).collect()}
    got = [(p.line, p.american_odds, p.direction) for p in rows["one"].movements]
    assert got == [(6.5, -105, "INITIAL"), (7.0, -105, "UP"), (None, -110, "PRICE_DOWN"), (6.0, 100, "DOWN")]
    assert [p.captured_at for p in rows["one"].movements] == sorted(p.captured_at for p in rows["one"].movements)
    assert rows["one"].movement_points == len(got) and [p.direction for p in rows["two"].movements] == ["INITIAL"]


def test_consensus_needs_two_books_with_lines(spark):
    df = quotes(spark, [dict(book="a", line=5.5, odds=-110), dict(book="b", line=6.5, odds=110)])
    assert market.consensus(df).first().consensus_line == 6.0
    df = quotes(spark, [dict(book="a", line=5.5, odds=-110), dict(book="b", line=None, odds=110)])
    assert market.consensus(df).first().consensus_line is None


def test_direction_by_price_when_a_line_is_missing(spark):
    df = quotes(spark, [dict(book="a", line=None, odds=-110), dict(book="a", line=5.5, odds=-105), dict(book="a", line=5.5, odds=-105), dict(book="a", line=5.5, odds=-120)])
    got = [r.direction for r in market.movement_direction(df).orderBy("captured_at").collect()]
    assert got == ["INITIAL", "PRICE_UP", "UNCHANGED", "PRICE_DOWN"]


def test_vig_only_for_one_opposing_pair(spark):
    df = quotes(
        spark,
        [dict(book="a", line=5.5, odds=-110), dict(book="a", line=5.5, odds=-110, side="under"), dict(book="b", line=5.5, odds=-110), dict(book="b", line=5.5, odds=-120), dict(book="c", line=None, odds=100, side="yes"), dict(book="c", line=None, odds=-300, side="no"), dict(book="d", line=5.5, odds=100)],
    )
    got = {r.quote_id: r.fair_market_probability for r in market.vig_removal(df).collect()}
    assert got["q0"] == pytest.approx(0.5) and got["q4"] == pytest.approx(0.4)
    assert [got[q] for q in ("q2", "q3", "q6")] == [None, None, None]


def test_alias_tiers(spark):
    offers = spark.createDataFrame(
        [("p", "Mike Evans"), ("p", "A.J. Brown"), ("p", "Old Name Jr."), ("p", "New Guy"), ("q", "New Guy Jr."), ("p", "Twin"), ("p", "!!")], "provider string, raw_name string"
    )
    players = spark.createDataFrame([(7, "Old Name")], "player_id long, name string")
    aliases = spark.createDataFrame(
        [("p", "michael evans", 1), ("z", "michael evans", 9), ("z", "aj brown", 2), ("y", "twin", 3), ("z", "twin", 4)], "provider string, normalized_alias string, player_id long"
    )
    rows = {(r.provider, r.raw_name): r for r in feeds.resolve_alias(offers, players, aliases).collect()}
    tiers = {k[1]: r.tier for k, r in rows.items()}
    assert tiers == {"Mike Evans": "PROVIDER_ALIAS", "A.J. Brown": "GLOBAL_ALIAS", "Old Name Jr.": "PLAYER_NAME", "New Guy": "NEW", "New Guy Jr.": "NEW", "Twin": "CONFLICT", "!!": "INVALID"}
    assert rows["p", "New Guy"].player_id == rows["q", "New Guy Jr."].player_id == 10  # the highest id so far is 9
    assert rows["p", "Mike Evans"].player_id == 1 and rows["p", "Twin"].player_id is None


def test_allocated_ids_are_dense_and_the_same_again(spark, split_groups):
    names = spark.createDataFrame([(f"n{i % 40:02d}",) for i in range(120)], "normalized string")
    taken = spark.createDataFrame([(5,), (41,)], "id long")
    first = {r.normalized: r.new_id for r in feeds.allocate_ids(names, taken).collect()}
    assert first == {f"n{i:02d}": 42 + i for i in range(40)}
    assert {r.normalized: r.new_id for r in feeds.allocate_ids(names.repartition(7), taken).collect()} == first
    assert [r.new_id for r in feeds.allocate_ids(names.limit(1), taken.limit(0)).collect()] == [1]
