"""SQL twins of the catalog queries, over the same tables."""

from __future__ import annotations

QUOTES = """
quotes AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS quote_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS batch,
         l_partkey // 40 AS event_id, l_partkey // 10 AS player_id, l_suppkey % 8 AS book_id,
         CASE l_returnflag WHEN 'A' THEN 'player_receptions' WHEN 'N' THEN 'player_pass_yds'
              ELSE 'player_pass_tds' END AS market,
         CASE WHEN l_linestatus = 'O' THEN 'over' ELSE 'under' END AS side,
         CASE WHEN l_linenumber % 7 <> 0 THEN CAST(ceil(l_quantity / 10) - 0.5 AS DOUBLE) END AS line,
         CASE WHEN l_discount < 0.05 THEN -(110 + CAST(round(l_discount * 1000) AS INT))
              ELSE 100 + CAST(round(l_discount * 1000) AS INT) END AS american_odds,
         l_shipdate AS captured_at
  FROM lineitem),
priced AS (
  SELECT *, CASE WHEN american_odds > 0 THEN 1 + american_odds / 100.0::DOUBLE
                 ELSE 1 + 100.0::DOUBLE / -american_odds END AS decimal_odds,
         CASE WHEN american_odds > 0 THEN 100.0::DOUBLE / (american_odds + 100)
              ELSE -american_odds / (100.0::DOUBLE - american_odds) END AS implied_probability,
         CASE WHEN line IS NULL THEN 0 WHEN side = 'over' THEN -line ELSE line END AS score
  FROM quotes)"""

ORACLES: dict[str, str] = {}

ORACLES["price_quotes"] = f"""
WITH {QUOTES}
SELECT quote_id, american_odds, round(decimal_odds, 6) AS decimal_odds,
       round(implied_probability, 6) AS implied_probability FROM priced"""

ORACLES["best_line"] = f"""
WITH {QUOTES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, player_id, market, side
                               ORDER BY score DESC, decimal_odds DESC, quote_id) AS rn FROM priced)
SELECT event_id, player_id, market, side, quote_id, book_id, line, american_odds, captured_at,
       CASE WHEN line IS NULL THEN 'Selected the best available price for this binary market.'
            WHEN side = 'over' THEN 'Selected the lowest OVER line; price breaks ties between equal lines.'
            ELSE 'Selected the highest UNDER line; price breaks ties between equal lines.' END AS reason
FROM ranked WHERE rn = 1"""

ORACLES["latest_per_key"] = f"""
WITH {QUOTES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, player_id, market, side, book_id
                               ORDER BY captured_at DESC, quote_id DESC) AS rn FROM quotes)
SELECT event_id, player_id, market, side, book_id, quote_id, line, american_odds, captured_at
FROM ranked WHERE rn = 1"""

ORACLES["rank_offers"] = f"""
WITH {QUOTES}
SELECT quote_id, player_id, market, side, line, american_odds, round(decimal_odds, 4) AS decimal_odds,
       round(implied_probability, 4) AS implied_probability,
       row_number() OVER (PARTITION BY player_id, market, side
                          ORDER BY score DESC, decimal_odds DESC, quote_id) AS rank
FROM priced"""

ORACLES["vig_removal"] = f"""
WITH {QUOTES}, g AS (
  SELECT *, count(*) OVER k AS n, min(side) OVER k AS a, max(side) OVER k AS b,
         sum(implied_probability) OVER k AS total
  FROM priced WINDOW k AS (PARTITION BY batch, event_id, player_id, book_id, market, line))
SELECT quote_id, round(implied_probability, 6) AS implied_probability,
       CASE WHEN n = 2 AND a <> b THEN round(implied_probability / total, 6) END AS fair_market_probability,
       n = 2 AND a <> b AS vig_removed
FROM g"""

DIRECTED = f"""{QUOTES}, lagged AS (
  SELECT *, lag(line) OVER s AS pl, lag(american_odds) OVER s AS po FROM quotes
  WINDOW s AS (PARTITION BY event_id, player_id, market, side, book_id ORDER BY captured_at, quote_id)),
directed AS (
  SELECT *, CASE WHEN po IS NULL THEN 'INITIAL' WHEN line > pl THEN 'UP' WHEN line < pl THEN 'DOWN'
                 WHEN american_odds > po THEN 'PRICE_UP' WHEN american_odds < po THEN 'PRICE_DOWN'
                 ELSE 'UNCHANGED' END AS direction FROM lagged)"""

ORACLES["movement_direction"] = f"""
WITH {DIRECTED} SELECT quote_id, direction FROM directed"""

ORACLES["movement_points"] = f"""
WITH {DIRECTED}
SELECT event_id, player_id, market, side, book_id, quote_id, captured_at, line, american_odds, direction,
       row_number() OVER (PARTITION BY event_id, player_id, market, side, book_id
                          ORDER BY captured_at, quote_id) AS point_no
FROM directed WHERE direction <> 'UNCHANGED'"""

SUMMARY = f"""{DIRECTED}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY event_id, player_id, market, side, book_id
                               ORDER BY captured_at, quote_id) AS up,
            row_number() OVER (PARTITION BY event_id, player_id, market, side, book_id
                               ORDER BY captured_at DESC, quote_id DESC) AS down FROM directed),
summary AS (
  SELECT event_id, player_id, market, side, book_id,
         max(CASE WHEN up = 1 THEN line END) AS first_line, max(CASE WHEN up = 1 THEN american_odds END) AS first_odds,
         max(CASE WHEN down = 1 THEN line END) AS latest_line, max(CASE WHEN down = 1 THEN american_odds END) AS latest_odds,
         min(line) AS minimum_line, max(line) AS maximum_line,
         min(american_odds) AS minimum_odds, max(american_odds) AS maximum_odds,
         min(CASE WHEN direction NOT IN ('INITIAL', 'UNCHANGED') THEN captured_at END) AS first_move_at,
         min(captured_at) AS seen_at, max(CASE WHEN up = 1 THEN quote_id END) AS seen_id,
         count(*) FILTER (direction <> 'UNCHANGED') AS movement_points
  FROM numbered GROUP BY ALL),
first_book AS (
  SELECT event_id, player_id, market, side, book_id AS moved_first FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, player_id, market, side
                                 ORDER BY first_move_at, seen_at, seen_id) AS rn
    FROM summary WHERE first_move_at IS NOT NULL) WHERE rn = 1),
agreed AS (
  SELECT event_id, player_id, market, side,
         CASE WHEN count(*) >= 2 AND count(latest_line) >= 2 THEN median(latest_line) END AS consensus_line,
         CASE WHEN count(*) >= 2 AND count(latest_line) >= 2 THEN
           median(CASE WHEN latest_odds > 0 THEN 100.0::DOUBLE / (latest_odds + 100)
                       ELSE -latest_odds / (100.0::DOUBLE - latest_odds) END) END AS consensus_probability,
         CASE WHEN count(*) >= 2 AND count(latest_line) >= 2 THEN count(*) END AS books_contributing
  FROM summary GROUP BY ALL)"""

ORACLES["consensus"] = f"""
WITH {SUMMARY}
SELECT event_id, player_id, market, side, round(consensus_line, 6) AS consensus_line,
       round(consensus_probability, 6) AS consensus_probability, books_contributing FROM agreed"""

ORACLES["moved_first"] = f"WITH {SUMMARY} SELECT * FROM first_book"

ORACLES["movement_summary"] = f"""
WITH {SUMMARY},
points AS (
  SELECT event_id, player_id, market, side, book_id,
         string_agg(concat_ws('|', epoch_us(captured_at), coalesce(CAST(line AS VARCHAR), '-'), american_odds, direction), ';'
                    ORDER BY captured_at, quote_id) AS movements
  FROM directed WHERE direction <> 'UNCHANGED' GROUP BY ALL),
series AS (
  SELECT s.*, p.movements FROM summary s JOIN points p
    ON (s.event_id, s.player_id, s.market, s.side, s.book_id) IS NOT DISTINCT FROM (p.event_id, p.player_id, p.market, p.side, p.book_id))
SELECT s.* EXCLUDE (first_move_at, seen_at, seen_id), moved_first, round(consensus_line, 6) AS consensus_line,
       round(consensus_probability, 6) AS consensus_probability, books_contributing
FROM series s LEFT JOIN first_book USING (event_id, player_id, market, side)
               LEFT JOIN agreed USING (event_id, player_id, market, side)"""
