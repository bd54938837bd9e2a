"""SQL twins of the market half: sources, quality, paper bets, logs, streams."""

from __future__ import annotations

from tallyfield.plans.oracles import ORACLES, QUOTES
from tallyfield.plans.oracles_research import GAMES, SCHEDULE, over

M: dict[str, str] = {}

# --- sources --------------------------------------------------------------------------

_stats = "player_id, season, week, team AS recent_team, receptions, targets"
M["fetch_or_cache"] = f"WITH {GAMES} SELECT {_stats} FROM games"
M["read_season_parquet"] = f"WITH {GAMES} SELECT {_stats} FROM games WHERE season IN (1973, 1974)"
M["read_csv_inferred"] = f"""WITH {GAMES}, {SCHEDULE} SELECT season, week, game_id, CAST(kickoff AS DATE) AS gameday, home_team, away_team
  FROM schedule WHERE season IN (1973, 1974)"""
M["union_schema_drift"] = f"""WITH {GAMES} SELECT player_id, season, week, team AS recent_team, receptions,
  CASE WHEN season > 1973 THEN targets END AS targets FROM games"""
M["build_file_manifest"] = f"""WITH {GAMES} SELECT 'player_stats' AS dataset, season, count(*) AS rows, true AS reproduced, true AS whole,
  'week;season_type;player_id;player_display_name;position;recent_team;receptions;targets;receiving_yards;attempts;completions;season' AS columns
  FROM games GROUP BY ALL"""
M["verify_manifest"] = "SELECT 'player_stats' AS dataset, 1974 AS season"

OFFERS = f"""{QUOTES}, offers AS (
  SELECT quote_id, 'E' || event_id AS event_id, 'A' || event_id % 31 || ' at H' || event_id % 32 AS event_name,
         captured_at AS commence_time, CASE WHEN book_id = 0 THEN 'book_0' ELSE 'Book ' || book_id END AS bookmaker,
         market, 'Player ' || player_id AS player, side, line, american_odds FROM quotes)"""
M["flatten_odds_json"] = f"WITH {OFFERS} SELECT * FROM offers"
M["append_snapshot_jsonl"] = M["flatten_odds_json"]

RESOLVED = f"""{QUOTES}, n AS (SELECT DISTINCT p_partkey // 10 AS n FROM part),
resolved AS (
  SELECT player_id AS n, 'feed' AS provider, 'Player ' || player_id || ' Jr.' AS raw_name, 'player ' || player_id AS normalized,
         CASE WHEN player_id % 3 = 0 THEN 'PROVIDER_ALIAS' WHEN player_id % 35 = 0 THEN 'CONFLICT'
              WHEN player_id % 5 = 0 THEN 'GLOBAL_ALIAS' WHEN player_id % 2 = 0 THEN 'PLAYER_NAME' ELSE 'NEW' END AS tier
  FROM (SELECT DISTINCT player_id FROM quotes)),
players AS (
  SELECT n, provider, raw_name, normalized, tier,
         CASE tier WHEN 'PROVIDER_ALIAS' THEN n + 1000000 WHEN 'GLOBAL_ALIAS' THEN n + 2000000 WHEN 'PLAYER_NAME' THEN n
              WHEN 'NEW' THEN (SELECT max(k.n) FROM n k WHERE k.n % 35 = 0) + 3000000 + dense_rank() OVER (PARTITION BY tier ORDER BY normalized) END AS player_id
  FROM resolved)"""
M["resolve_alias"] = f"WITH {RESOLVED} SELECT provider, raw_name, normalized, tier, player_id FROM players"
M["persist_offers"] = f"""WITH {RESOLVED}, f AS (
  SELECT quote_id, p.player_id, 'book-' || book_id AS book_id, market, side, line, american_odds, batch, event_id,
         CASE WHEN american_odds > 0 THEN 100.0::DOUBLE / (american_odds + 100)
              ELSE -american_odds / (100.0::DOUBLE - american_odds) END AS pr
  FROM quotes q JOIN players p ON q.player_id = p.n WHERE p.player_id IS NOT NULL)
  SELECT quote_id, player_id, book_id, market, side, line,
         CASE WHEN count(*) OVER k = 2 AND min(side) OVER k <> max(side) OVER k THEN round(pr / sum(pr) OVER k, 6) END AS fair_market_probability
  FROM f WINDOW k AS (PARTITION BY batch, event_id, player_id, book_id, market, line)"""

M["persisted_players"] = f"WITH {RESOLVED} SELECT DISTINCT player_id, raw_name AS name FROM players WHERE tier = 'NEW'"
M["persisted_aliases"] = f"""WITH {RESOLVED} SELECT provider, raw_name AS raw_alias, normalized AS normalized_alias, player_id
  FROM players WHERE tier IN ('GLOBAL_ALIAS', 'PLAYER_NAME', 'NEW')"""
M["persisted_books"] = f"WITH {QUOTES} SELECT DISTINCT 'book-' || book_id AS book_id, 'Book ' || book_id AS name FROM quotes"
M["persisted_events"] = f"""WITH {QUOTES} SELECT 'E' || event_id AS event_id, 'game' AS name, min(captured_at) AS commence_time
  FROM quotes GROUP BY event_id"""
M["refused_offers"] = f"""WITH {RESOLVED} SELECT quote_id AS offer_id, provider, raw_name, tier AS violation
  FROM quotes q JOIN players p ON q.player_id = p.n WHERE p.player_id IS NULL"""

STAR = f"""{QUOTES}, star AS (
  SELECT quote_id, e.p_brand AS event_name, p.p_name AS player_name, s_name AS book_name, market, side, line, american_odds, captured_at
  FROM quotes JOIN part p ON p.p_partkey = player_id * 10 JOIN part e ON e.p_partkey = event_id * 40
  JOIN supplier ON s_suppkey = book_id)"""
M["star_join"] = f"WITH {STAR} SELECT * FROM star"
M["list_quotes"] = f"WITH {STAR} SELECT * FROM star WHERE side = 'under' ORDER BY captured_at DESC, quote_id DESC LIMIT 100"
M["quote_history"] = f"""WITH {STAR} SELECT * FROM star WHERE market = 'player_receptions' AND side = 'over'
  ORDER BY captured_at DESC, quote_id DESC LIMIT 200"""
M["limit_page"] = f"WITH {QUOTES} SELECT quote_id, captured_at FROM quotes ORDER BY captured_at DESC, quote_id DESC LIMIT 500"

ATTEMPTS = """attempts AS (
  SELECT 'feed-' || user_id AS provider, event_id AS attempt_id, ts AS ended_at, event_type <> 'error' AS ok, value AS latency_ms,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS records FROM events)"""
M["list_jobs"] = f"WITH {ATTEMPTS} SELECT provider, attempt_id, ended_at, latency_ms FROM attempts WHERE NOT ok ORDER BY ended_at DESC, attempt_id DESC LIMIT 100"
HEALTH = f"""{ATTEMPTS}, marked AS (
  SELECT *, max(CASE WHEN ok THEN ended_at END) OVER (PARTITION BY provider) AS last_ok,
         row_number() OVER (PARTITION BY provider, ok ORDER BY ended_at DESC, attempt_id DESC) AS rn FROM attempts),
facts AS (
  SELECT provider, count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok AND (last_ok IS NULL OR ended_at > last_ok)) AS fails,
         avg(CASE WHEN ok THEN latency_ms END) AS mean_latency, max(CASE WHEN NOT ok AND rn = 1 THEN latency_ms END) AS fail_latency,
         max(CASE WHEN ok AND rn = 1 THEN records END) AS records_returned,
         max(CASE WHEN ok THEN ended_at END) AS last_successful_fetch, max(CASE WHEN NOT ok THEN ended_at END) AS last_failed_fetch
  FROM marked GROUP BY provider)
SELECT provider, CASE WHEN fails >= 3 THEN 'DOWN' WHEN fails > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status,
       good AS successful_fetches, fails AS consecutive_failures, round(coalesce(mean_latency, fail_latency), 6) AS average_latency_ms,
       records_returned, last_successful_fetch, last_failed_fetch FROM facts"""
for _n in ("provider_health", "list_health", "stream_provider_health"):
    M[_n] = f"WITH {HEALTH}"

# --- quality --------------------------------------------------------------------------

M["normalize_nullable_float"] = """WITH v AS (
  SELECT CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN 'Infinity' ELSE json_extract_string(props, '$.k') END AS share, value
  FROM events), d AS (SELECT share, TRY_CAST(share AS DOUBLE) AS x, value FROM v)
  SELECT 'share' AS "column", count(*) FILTER (share IS NOT NULL AND x IS NULL) AS not_numeric, count(*) FILTER (isinf(x)) AS not_finite,
         count(*) FILTER (NOT isinf(x) AND x < 5) AS below_minimum, count(*) FILTER (NOT isinf(x) AND x > 90) AS above_maximum FROM d
  UNION ALL SELECT 'value', 0, 0, count(*) FILTER (value < 0), 0 FROM d"""

RAW = f"""{QUOTES}, split AS (SELECT *, CAST(split_part(quote_id, '-', 4) AS BIGINT) AS number FROM quotes),
raw AS (
  SELECT strftime(batch, '%Y-%m') AS payload_id, quote_id AS record_index, 'E' || event_id AS event_id, captured_at AS commence_time,
         'book ' || book_id AS book, CASE WHEN number % 29 = 0 THEN 'player_rush_yds' ELSE market END AS market,
         CASE WHEN number % 31 = 0 THEN ' ' WHEN right(quote_id, 1) = '3' THEN 'MIKE O''Player ' || player_id
              ELSE 'Michael O.Player ' || player_id || ' III' END AS player,
         CASE WHEN number % 31 = 0 THEN '' ELSE 'michael o player ' || player_id END AS normalized_name, side,
         CASE WHEN number % 37 = 0 THEN -line ELSE line END AS line, CASE WHEN number % 41 = 0 THEN 50 ELSE american_odds END AS american_odds
  FROM split)"""
FLAGGED = f"""{RAW}, first_rule AS (
  SELECT *, CASE WHEN market = 'player_rush_yds' THEN 'UNSUPPORTED_MARKET' WHEN trim(player) = '' THEN 'MISSING_PLAYER_NAME'
                 WHEN abs(american_odds) < 100 THEN 'INVALID_ODDS' WHEN line < 0 THEN 'IMPOSSIBLE_LINE' END AS rule FROM raw),
valid AS (
  SELECT *, coalesce(lag(player) OVER (PARTITION BY payload_id, normalized_name ORDER BY record_index) <> player, false) AS alias_changed,
         row_number() OVER (PARTITION BY payload_id, event_id, book, market, normalized_name, side, line ORDER BY record_index) > 1 AS again
  FROM first_rule WHERE rule IS NULL),
flagged AS (
  SELECT payload_id, record_index, normalized_name, rule AS reject_category, '' AS warnings FROM first_rule WHERE rule IS NOT NULL
  UNION ALL
  SELECT payload_id, record_index, normalized_name, CASE WHEN again THEN 'DUPLICATE_CONTRACT' END,
         concat_ws(';', CASE WHEN commence_time < TIMESTAMP '1997-12-31 18:00:00' THEN 'STALE_EVENT' END,
                   CASE WHEN alias_changed THEN 'PLAYER_ALIAS_VARIATION' END)
  FROM valid)"""
M["flag_offers"] = f"WITH {FLAGGED} SELECT * FROM flagged"
M["quality_flags"] = f"""WITH {FLAGGED} SELECT payload_id, record_index, 'STALE_EVENT' AS category FROM flagged WHERE contains(warnings, 'STALE')
  UNION ALL SELECT payload_id, record_index, 'PLAYER_ALIAS_VARIATION' FROM flagged WHERE contains(warnings, 'ALIAS')
  UNION ALL SELECT payload_id, record_index, reject_category FROM flagged WHERE reject_category IS NOT NULL"""
M["dedupe_contracts"] = f"WITH {FLAGGED} SELECT payload_id, record_index FROM flagged WHERE reject_category IS NULL"
M["alias_variation"] = f"""WITH {RAW} SELECT payload_id, record_index,
  coalesce(lag(player) OVER (PARTITION BY payload_id, normalized_name ORDER BY record_index) <> player, false) AS alias_changed FROM raw"""
M["snapshot_unique"] = f"""WITH {QUOTES} SELECT DISTINCT 1 AS event_id, player_id % 5 AS player_id, book_id, market, side, line,
  american_odds, captured_at FROM quotes"""
_ascii = "regexp_replace(strip_accents({0}), '[^\\x00-\\x7f]', '', 'g')"
M["normalize_entities"] = f"""WITH words AS (
  SELECT unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents),
tokens AS (
  SELECT regexp_extract_all(lower({_ascii.format("word")}), '[a-z0-9]+') AS t, count(*) AS n FROM words GROUP BY word),
cut AS (
  SELECT CASE WHEN len(t) > 0 AND t[len(t)] IN ('jr', 'sr', 'ii', 'iii', 'iv', 'v') THEN t[1:len(t) - 1] ELSE t END AS t, n FROM tokens),
merged AS (
  SELECT CASE WHEN len(t) >= 3 AND len(t[1]) = 1 AND len(t[2]) = 1 THEN list_concat([t[1] || t[2]], t[3:]) ELSE t END AS t, n FROM cut),
named AS (
  SELECT CASE t[1] WHEN 'gabe' THEN list_concat(['gabriel'], t[2:]) WHEN 'mike' THEN list_concat(['michael'], t[2:])
                   WHEN 'will' THEN list_concat(['william'], t[2:]) ELSE t END AS t, n FROM merged)
SELECT array_to_string(t, ' ') AS normalized, sum(n) AS occurrences FROM named GROUP BY 1"""
M["normalize_names"] = """SELECT c_custkey, 'jr customer ' || split_part(c_name, '#', 2) AS normalized,
  'j.-r.-' || lower(c_name) || CASE WHEN c_custkey % 2 = 0 THEN '-jr.' ELSE '-iii' END AS book_key FROM customer"""
M["redact_secrets"] = """SELECT event_id, 'GET /odds?API-KEY=[REDACTED]&user=' || user_id || ' props ' || props AS message FROM events"""
M["side_market_maps"] = f"""WITH {RAW} SELECT CASE WHEN market <> 'player_rush_yds' THEN market END AS market, side, count(*) AS offers
  FROM raw GROUP BY ALL"""

# --- projections and recommendations --------------------------------------------------

REQUESTS = f"""{QUOTES}, parts AS (
  SELECT *, CAST(split_part(quote_id, '-', 1) AS BIGINT) AS p1, CAST(split_part(quote_id, '-', 2) AS BIGINT) AS p2,
         CAST(split_part(quote_id, '-', 3) AS BIGINT) AS p3, CAST(split_part(quote_id, '-', 4) AS BIGINT) AS p4 FROM quotes),
requests AS (
  SELECT quote_id AS request_id, event_id, player_id, market, side, american_odds AS own_odds, captured_at AS own_captured,
         0.2::DOUBLE + (p3 % 61) / 100.0::DOUBLE AS model_probability, captured_at - to_minutes(p1 % 120) AS input_captured_at,
         captured_at + to_minutes(p3 % 7) AS decided_at,
         ((0.3::DOUBLE + (p1 % 71) / 100.0::DOUBLE) * 0.25::DOUBLE + (0.3::DOUBLE + (p3 % 71) / 100.0::DOUBLE) * 0.20::DOUBLE
          + (0.3::DOUBLE + (p4 % 71) / 100.0::DOUBLE) * 0.15::DOUBLE + (0.3::DOUBLE + (p1 % 53) / 100.0::DOUBLE) * 0.15::DOUBLE
          + (0.3::DOUBLE + (p3 % 53) / 100.0::DOUBLE) * 0.10::DOUBLE + (0.3::DOUBLE + (p4 % 53) / 100.0::DOUBLE) * 0.15::DOUBLE)
         / (0.25::DOUBLE + 0.20::DOUBLE + 0.15::DOUBLE + 0.15::DOUBLE + 0.10::DOUBLE + 0.15::DOUBLE) AS conf
  FROM parts)"""


def decide(source: str) -> str:
    """CTEs ending in ``decided``; ``source`` has odds ``american_odds`` and ``quote_captured_at``."""
    return f"""valued AS (
  SELECT *, CASE WHEN american_odds > 0 THEN 100.0::DOUBLE / (american_odds + 100) ELSE -american_odds / (100.0::DOUBLE - american_odds) END AS ip,
         model_probability * CASE WHEN american_odds > 0 THEN 1 + american_odds / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / -american_odds END - 1 AS ev,
         greatest(0, CAST(epoch(decided_at) - epoch(least(quote_captured_at, input_captured_at)) AS BIGINT)) AS age
  FROM {source}),
reasons AS (
  SELECT *, concat_ws(';', CASE WHEN ev < 0 THEN printf('Expected return %.2f%% is below the minimum edge threshold.', ev * 100) END,
                   CASE WHEN conf < 0.5 THEN printf('Overall confidence %.1f%% is below the minimum confidence threshold.', conf * 100) END,
                   CASE WHEN age > 3600 THEN printf('Input data is stale at %d seconds old.', age) END) AS fails,
         concat_ws(';', CASE WHEN ev < 0.05 THEN printf('Expected return %.2f%% is below the BET threshold.', ev * 100) END,
                   CASE WHEN conf < 0.7 THEN printf('Overall confidence %.1f%% is below the BET threshold.', conf * 100) END,
                   CASE WHEN age > 900 THEN printf('Input data is borderline at %d seconds old.', age) END) AS doubts
  FROM valued),
decided AS (
  SELECT *, CASE WHEN fails <> '' THEN 'PASS' WHEN doubts <> '' THEN 'WATCH' ELSE 'BET' END AS rating,
         CASE WHEN fails <> '' THEN fails ELSE doubts END AS rejection_reasons FROM reasons)"""


DECIDED = """request_id, american_odds, round(ip, 6) AS implied_probability, round(ev, 6) AS expected_return, round(conf, 6) AS overall_confidence,
  age AS data_age_seconds, rating, rejection_reasons,
  printf('%s: model probability %.1f%%, market implied probability %.1f%%, expected return %.2f%% per dollar. Paper recommendation only.',
         rating, model_probability * 100, ip * 100, ev * 100) AS rationale"""
M["recommend"] = f"""WITH {REQUESTS}, own AS (SELECT *, own_odds AS american_odds, own_captured AS quote_captured_at FROM requests),
  {decide("own")} SELECT {DECIDED} FROM decided"""
_best = """best AS (
  SELECT event_id, player_id, market, side, quote_id AS best_quote_id, american_odds, captured_at AS quote_captured_at FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id, player_id, market, side
                                 ORDER BY score DESC, decimal_odds DESC, quote_id) AS rn FROM priced) WHERE rn = 1)"""
M["project_and_recommend"] = f"""WITH {REQUESTS}, {_best},
  asked AS (SELECT * FROM requests JOIN best USING (event_id, player_id, market, side)), {decide("asked")},
  filled AS (SELECT *, CASE WHEN rating = 'BET' THEN 5 ELSE 0 END AS want,
                    sum(CASE WHEN rating = 'BET' THEN 5 ELSE 0 END) OVER (PARTITION BY date_trunc('week', decided_at) ORDER BY decided_at, request_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM decided)
  SELECT {DECIDED}, best_quote_id, CAST(least(50, c) - least(50, c - want) AS DECIMAL(10,2)) AS recommended_stake FROM filled"""
M["expected_value"] = f"""WITH {QUOTES}, v AS (
  SELECT quote_id, (player_id % 100) / 100.0::DOUBLE AS model_probability, (player_id % 100) / 100.0::DOUBLE * decimal_odds - 1 AS ev FROM priced)
  SELECT quote_id, model_probability, round(ev, 6) + 0.0::DOUBLE AS expected_return,
         CASE WHEN ev >= 0.05 THEN 'BET' WHEN ev >= 0 THEN 'WATCH' ELSE 'PASS' END AS rating FROM v"""
M["confidence"] = f"WITH {REQUESTS} SELECT request_id, round(conf, 6) AS overall_confidence FROM requests"
M["stale_gate"] = f"""WITH {QUOTES}, a AS (SELECT quote_id, epoch(TIMESTAMP '1998-01-01 00:50:00') - epoch(captured_at) AS age FROM quotes)
  SELECT quote_id, CAST(greatest(0, age) AS BIGINT) AS data_age_seconds,
         CASE WHEN age > 3600 THEN 'STALE' WHEN age > 900 THEN 'BORDERLINE' ELSE 'FRESH' END AS freshness FROM a"""


def poisson_tables(source: str, rate: str) -> str:
    """CTEs ``cum`` (rate, k, pmf, cdf) and ``q`` (quantiles) for the distinct rates."""
    return f"""rates AS (SELECT DISTINCT {rate} AS r FROM {source}),
masses AS (SELECT r, k, CASE WHEN r = 0 THEN CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE 0 END ELSE exp(-r + k * ln(CASE WHEN r = 0 THEN 1 ELSE r END) - lgamma(k + 1)) END AS pmf
  FROM rates, (SELECT unnest(range(0, 80)) AS k)),
cum AS (SELECT r, k, pmf, sum(pmf) OVER (PARTITION BY r ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM masses),
q AS (SELECT r, min(k) FILTER (cdf >= 0.1) AS floor, min(k) FILTER (cdf >= 0.5) AS median, min(k) FILTER (cdf >= 0.9) AS ceiling FROM cum GROUP BY r)"""


def line_scores(rate: str) -> str:
    return f"""round(least(1, greatest(0, 1 - c.cdf)), 6) AS over_probability,
  round(CASE WHEN line = floor(line) THEN coalesce(b.cdf, 0) ELSE c.cdf END, 6) AS under_probability,
  round(CASE WHEN line = floor(line) THEN c.pmf ELSE 0 END, 6) AS push_probability, q.floor, q.median, q.ceiling
  FROM s JOIN q ON q.r = {rate} JOIN cum c ON c.r = {rate} AND c.k = floor(line) LEFT JOIN cum b ON b.r = {rate} AND b.k = floor(line) - 1"""


_line = "l_linenumber - CASE WHEN l_partkey % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS line"
M["score_count_lines"] = f"""WITH s AS (SELECT l_orderkey, l_partkey, l_quantity / 7 AS rate, {_line} FROM lineitem), {poisson_tables("s", "rate")}
  SELECT l_orderkey, l_partkey, round(rate, 6) AS rate, line, {line_scores("rate")}"""
M["project_receptions"] = f"""WITH s AS (
  SELECT l_orderkey, l_partkey, {_line},
         (25 + l_linenumber)::DOUBLE * (l_discount + 0.5::DOUBLE) * (l_tax + 0.15::DOUBLE) * 0.75::DOUBLE AS targets,
         (25 + l_linenumber)::DOUBLE * (l_discount + 0.5::DOUBLE) * (l_tax + 0.15::DOUBLE) * 0.75::DOUBLE * 0.65::DOUBLE AS recs
  FROM lineitem), {poisson_tables("s", "recs")}
  SELECT l_orderkey, l_partkey, line, round(targets, 6) AS projected_targets, round(recs, 6) AS projected_receptions, {line_scores("recs")}"""

M["poisson_over"] = f"""SELECT l_quantity AS quantity, count(*) AS rows, round(avg({over("(l_quantity / 7)")}), 6) AS over_probability
  FROM lineitem GROUP BY 1"""
M["data_age_seconds"] = f"""WITH {REQUESTS} SELECT request_id,
  greatest(0, CAST(epoch(decided_at) - epoch(input_captured_at) AS BIGINT)) AS data_age_seconds FROM requests"""

# --- paper bets -----------------------------------------------------------------------

M["opening_quote"] = f"""WITH {QUOTES} SELECT quote_id, first_value(line) OVER s AS opening_line, first_value(american_odds) OVER s AS opening_odds
  FROM quotes WINDOW s AS (PARTITION BY event_id, player_id, market, side, book_id ORDER BY captured_at, quote_id)"""

BETS = """bets AS (
  SELECT o_orderkey AS bet_id, o_custkey AS player_id, o_custkey // 4 AS event_id, o_orderkey % 8 AS book_id, o_orderpriority AS market,
         CASE WHEN (o_orderkey // 2) % 2 = 0 THEN 'over' ELSE 'under' END AS side,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % 9 + 0.5::DOUBLE END AS line,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100 + o_orderkey % 150 ELSE -(100 + o_orderkey % 50) END AS INT) AS american_odds,
         CAST(floor(o_totalprice / 100) / 100.0::DOUBLE AS DECIMAL(10,2)) AS stake, (o_orderkey % 41 - 20) / 100.0::DOUBLE AS expected_value,
         CASE WHEN o_orderkey % 3 = 0 THEN 'WATCH' ELSE 'BET' END AS rating,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN 'SETTLED' WHEN o_orderkey % 2 = 0 THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
         CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'WIN' WHEN o_orderstatus = 'F' THEN 'LOSS'
              WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'PUSH' WHEN o_orderstatus = 'P' THEN 'LOSS' END AS outcome,
         o_orderdate AS placed_at,
         CASE WHEN (o_orderstatus IN ('F', 'P') OR o_orderkey % 2 = 0) AND o_orderkey % 11 <> 0
              THEN o_orderkey % 9 + 0.5::DOUBLE + o_orderkey % 3 - 1 END AS closing_line,
         CASE WHEN o_orderstatus IN ('F', 'P') OR o_orderkey % 2 = 0 THEN
              CAST(CASE WHEN o_orderkey % 4 = 0 THEN 100 + o_orderkey % 90 ELSE -(100 + o_orderkey % 70) END AS INT) END AS closing_odds,
         CASE WHEN o_orderstatus IN ('F', 'P') THEN o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) END AS settled_at
  FROM orders),
book AS (
  SELECT *, CASE WHEN american_odds > 0 THEN 1 + american_odds / 100.0::DOUBLE ELSE 1 + 100.0::DOUBLE / -american_odds END AS bd,
         CASE WHEN closing_odds > 0 THEN 1 + closing_odds / 100.0::DOUBLE WHEN closing_odds < 0 THEN 1 + 100.0::DOUBLE / -closing_odds END AS cd,
         CAST(round(stake * 100) AS HUGEINT) AS cents, abs(american_odds) AS a FROM bets),
scaled AS (
  SELECT *, cents * CASE WHEN american_odds > 0 THEN american_odds * CAST('10000000000000000000000000' AS HUGEINT)
                         ELSE CAST('100000000000000000000000000000' AS HUGEINT) // a
                              + CASE WHEN 2 * (CAST('100000000000000000000000000000' AS HUGEINT) % a) >= a THEN 1 ELSE 0 END END AS raw
  FROM book),
cut AS (
  SELECT *, CASE WHEN american_odds > 0 THEN CAST(1 AS HUGEINT)
                 ELSE CAST('1' || repeat('0', greatest(0, CAST(length(CAST(raw AS VARCHAR)) AS INT) - 28)) AS HUGEINT) END AS step FROM scaled),
kept AS (
  SELECT *, (raw // step + CASE WHEN 2 * (raw % step) > step OR (2 * (raw % step) = step AND (raw // step) % 2 = 1) THEN 1 ELSE 0 END) * step AS p,
         CAST('1000000000000000000000000000' AS HUGEINT) AS unit FROM cut),
done AS (
  SELECT *, CASE WHEN outcome = 'LOSS' THEN -stake WHEN outcome = 'PUSH' THEN 0 WHEN outcome = 'WIN' THEN
              CAST(CAST(p // unit + CASE WHEN 2 * (p % unit) > unit OR (2 * (p % unit) = unit AND (p // unit) % 2 = 1) THEN 1 ELSE 0 END AS BIGINT)
                   / 100.0::DOUBLE AS DECIMAL(12,2)) END AS net_profit,
         CASE WHEN side = 'over' AND line <> closing_line THEN line < closing_line WHEN side = 'under' AND line <> closing_line THEN line > closing_line
              ELSE bd > cd END AS beat FROM kept)"""
M["list_recommendations"] = f"""WITH {BETS} SELECT bet_id, player_id, market, expected_value, placed_at FROM bets WHERE rating = 'WATCH'
  ORDER BY placed_at DESC, bet_id DESC LIMIT 100"""
M["list_bets"] = f"""WITH {BETS} SELECT bet_id, player_id, stake, status, placed_at FROM bets WHERE status = 'CLOSED'
  ORDER BY placed_at DESC, bet_id DESC LIMIT 100"""
FRESH = f"""{BETS}, fresh AS (SELECT bet_id AS request_id, * FROM bets WHERE status = 'ACTIVE'),
open_bets AS (SELECT * FROM bets WHERE status = 'CLOSED')"""
M["duplicate_open_bet"] = f"""WITH {FRESH} SELECT request_id FROM fresh f WHERE EXISTS (
  SELECT 1 FROM open_bets o WHERE o.player_id = f.player_id AND o.event_id = f.event_id AND o.market = f.market AND o.side = f.side)"""
M["correlation_flags"] = f"""WITH {FRESH} SELECT request_id, concat_ws(';',
  CASE WHEN player_id IN (SELECT player_id FROM open_bets) THEN 'CORRELATED_SAME_PLAYER' END,
  CASE WHEN event_id IN (SELECT event_id FROM open_bets) THEN 'CORRELATED_SAME_EVENT' END) AS correlation_flags FROM fresh"""
M["exposure_rejections"] = f"""WITH {FRESH}, p AS (SELECT player_id, sum(stake) AS po FROM open_bets GROUP BY 1),
  e AS (SELECT event_id, sum(stake) AS eo FROM open_bets GROUP BY 1),
  w AS (SELECT date_trunc('week', placed_at) AS wk, sum(stake) AS ws FROM bets WHERE status <> 'ACTIVE' GROUP BY 1),
  x AS (SELECT request_id, CAST(round(stake * 100 / 10) AS DECIMAL(12,2)) / 100 * 4 AS st, coalesce(po, 0) AS po, coalesce(eo, 0) AS eo,
               coalesce(ws, 0) AS ws
        FROM fresh LEFT JOIN p USING (player_id) LEFT JOIN e USING (event_id) LEFT JOIN w ON wk = date_trunc('week', placed_at))
  SELECT request_id, concat_ws(';', CASE WHEN st > 10 THEN 'Exceeds maximum single stake of $10.' END,
    CASE WHEN ws + st > 50 THEN 'Exceeds maximum weekly exposure of $50.' END,
    CASE WHEN po + st > 15 THEN 'Exceeds maximum player exposure of $15.' END,
    CASE WHEN eo + st > 20 THEN 'Exceeds maximum event exposure of $20.' END) AS rejections FROM x"""
M["exposures"] = f"""WITH {BETS}
  SELECT 'week' AS scope, strftime(date_trunc('week', placed_at), '%Y-%m-%d') AS key, CAST(sum(stake) AS DECIMAL(20,2)) AS exposure FROM bets GROUP BY ALL
  UNION ALL SELECT 'player', CAST(player_id AS VARCHAR), CAST(sum(CASE WHEN status IN ('ACTIVE', 'CLOSED') THEN stake ELSE 0 END) AS DECIMAL(20,2)) FROM bets GROUP BY ALL
  UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), CAST(sum(CASE WHEN status IN ('ACTIVE', 'CLOSED') THEN stake ELSE 0 END) AS DECIMAL(20,2)) FROM bets GROUP BY ALL"""
M["stake_allocation"] = f"""WITH {BETS}, w AS (SELECT *, CASE WHEN rating = 'BET' THEN least(stake, 10) ELSE 0 END AS want FROM bets),
  c AS (SELECT *, sum(want) OVER (PARTITION BY date_trunc('week', placed_at) ORDER BY placed_at, bet_id ROWS UNBOUNDED PRECEDING) AS c FROM w)
  SELECT bet_id, CAST(least(50, c) - least(50, c - want) AS DECIMAL(10,2)) AS recommended_stake FROM c"""
M["clv"] = f"""WITH {BETS} SELECT bet_id, round(closing_line - line, 6) AS line_movement, round(bd - cd, 6) AS price_movement, beat AS beat_closing_line,
  CASE WHEN line IS NOT DISTINCT FROM closing_line THEN round(bd / cd - 1, 6) END AS clv_percentage FROM done WHERE closing_odds IS NOT NULL"""
M["settle_book"] = f"WITH {BETS} SELECT bet_id, outcome, net_profit FROM done WHERE outcome IS NOT NULL"
M["bet_state"] = f"""WITH {BETS} SELECT bet_id, status, concat_ws(';', CASE WHEN closing_odds IS NOT NULL AND bet_id % 13 = 0 THEN 'CLOSING_ALREADY_RECORDED' END,
  CASE WHEN outcome IS NOT NULL AND bet_id % 17 = 0 THEN 'ALREADY_SETTLED' END) AS violations FROM bets"""
_money = """count(*) AS bets, CAST(coalesce(sum(CASE WHEN outcome IS NOT NULL THEN stake END), 0) AS DECIMAL(20,2)) AS amount_risked,
  CAST(coalesce(sum(net_profit), 0) AS DECIMAL(20,2)) AS net_profit,
  round(coalesce(CAST(sum(net_profit) AS DOUBLE) / CAST(sum(CASE WHEN outcome IS NOT NULL THEN stake END) AS DOUBLE), 0), 6) AS roi"""
M["performance_total"] = f"""WITH {BETS} SELECT {_money.replace("count(*) AS bets", "count(*) AS total_bets")},
  count(*) FILTER (outcome = 'WIN') AS wins, count(*) FILTER (outcome = 'LOSS') AS losses, count(*) FILTER (outcome = 'PUSH') AS pushes,
  round(avg(expected_value), 6) AS average_expected_value,
  round(avg(CASE WHEN closing_odds IS NOT NULL AND line IS NOT DISTINCT FROM closing_line THEN bd / cd - 1 END), 6) AS average_clv,
  round(avg(CASE WHEN closing_odds IS NOT NULL THEN CAST(beat AS INT) END), 6) AS clv_hit_rate FROM done"""
M["performance_by"] = f"""WITH {BETS}
  SELECT 'market' AS dimension, market AS value, {_money} FROM done GROUP BY market
  UNION ALL SELECT 'book', CAST(book_id AS VARCHAR), {_money} FROM done GROUP BY book_id
  UNION ALL SELECT 'rating', rating, {_money} FROM done GROUP BY rating
  UNION ALL SELECT 'total', 'all', {_money} FROM done"""
M["max_drawdown"] = f"""WITH {BETS}, r AS (
  SELECT settled_at, placed_at, bet_id, sum(net_profit) OVER (ORDER BY settled_at, placed_at, bet_id ROWS UNBOUNDED PRECEDING) AS run
  FROM done WHERE outcome IS NOT NULL),
  k AS (SELECT run, greatest(0, max(run) OVER (ORDER BY settled_at, placed_at, bet_id ROWS UNBOUNDED PRECEDING)) AS peak FROM r)
  SELECT CAST(max(peak - run) AS DECIMAL(20,2)) AS maximum_drawdown FROM k"""

# --- logs -----------------------------------------------------------------------------

M["namespaced_digest"] = "SELECT event_id, sha256('events.v1' || chr(10) || props) AS digest FROM events"
M["duplicate_batch"] = """WITH b AS (
  SELECT 'feed-' || user_id AS provider, event_id AS batch_id, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type, false) AS duplicate_suppressed,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT provider, batch_id, duplicate_suppressed, CASE WHEN duplicate_suppressed THEN 0 ELSE k END AS row_count FROM b"""
M["stream_suppress_unchanged"] = M["duplicate_batch"]
M["versioned_log"] = """WITH e AS (
  SELECT user_id AS stream, event_type || '-' || CAST(floor(value) AS BIGINT) AS idempotency_key, sha256(event_type || event_id % 2) AS content_digest,
         ts, event_id AS entry_id FROM events),
  f AS (SELECT *, first_value(entry_id) OVER k AS first_id, first_value(content_digest) OVER k AS first_digest FROM e
        WINDOW k AS (PARTITION BY stream, idempotency_key ORDER BY ts, entry_id)),
  v AS (SELECT stream, idempotency_key, row_number() OVER (PARTITION BY stream ORDER BY ts, entry_id) AS version FROM f WHERE entry_id = first_id)
  SELECT entry_id, stream, idempotency_key, content_digest, version,
         CASE WHEN entry_id = first_id THEN 'APPENDED' WHEN content_digest = first_digest THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome
  FROM f JOIN v USING (stream, idempotency_key)"""
CANDIDATES = f"""{QUOTES}, parts AS (
  SELECT *, CAST(split_part(quote_id, '-', 1) AS BIGINT) AS p1, CAST(split_part(quote_id, '-', 2) AS BIGINT) AS p2,
         CAST(split_part(quote_id, '-', 3) AS BIGINT) AS p3, CAST(split_part(quote_id, '-', 4) AS BIGINT) AS p4 FROM quotes),
c AS (
  SELECT *, p1 AS request_id, quote_id AS worker_id, concat_ws(';',
     CASE WHEN p4 % 23 = 0 THEN 'CONTRADICTORY_EVIDENCE' END, CASE WHEN p3 % 13 = 0 THEN 'HARD_POLICY_EVIDENCE_UNAVAILABLE' END,
     CASE WHEN p3 % 13 <> 0 AND p3 % 7 = 0 THEN 'HARD_POLICY_FILTERED' END, CASE WHEN p4 % 11 = 0 THEN 'ORGANIZATION_OR_WORKLOAD_MISMATCH' END,
     CASE WHEN captured_at < TIMESTAMP '1996-01-01' THEN 'READINESS_EXPIRED' END, CASE WHEN p2 = 5 THEN 'REQUIRED_CAPABILITY_MISSING' END,
     CASE WHEN p3 % 5 = 0 THEN 'WORKER_NOT_READY' END) AS exclusion_reasons,
     (p1 * 7919 + p3) % 10000000 AS a, (p3 * 104729 + p4) % 10000000 AS b
  FROM parts),
s AS (
  SELECT *, exclusion_reasons = '' AS eligible,
     (40 * (a // 10 + CASE WHEN a % 10 > 5 OR (a % 10 = 5 AND (a // 10) % 2 = 1) THEN 1 ELSE 0 END)
      + 15 * (b // 10 + CASE WHEN b % 10 > 5 OR (b % 10 = 5 AND (b // 10) % 2 = 1) THEN 1 ELSE 0 END) + 5000000) / 1000000.0::DOUBLE AS total FROM c)"""
M["score_candidates"] = f"""WITH {CANDIDATES} SELECT request_id, worker_id, eligible, exclusion_reasons, CASE WHEN eligible THEN round(total, 6) END AS score,
  CASE WHEN eligible THEN row_number() OVER (PARTITION BY request_id, eligible ORDER BY total DESC, date_trunc('month', captured_at), worker_id) END AS rank
  FROM s"""
OUTCOMES = f"""{CANDIDATES}, outcomes AS (
  SELECT request_id, count(*) FILTER (eligible) AS candidates, count(*) FILTER (NOT eligible) AS excluded,
         CASE WHEN count(*) FILTER (eligible) > 0 THEN 'CANDIDATE_FOUND' WHEN bool_or(contains(exclusion_reasons, 'CONTRADICTORY')) THEN 'INDETERMINATE'
              WHEN bool_or(contains(exclusion_reasons, 'UNAVAILABLE')) THEN 'EVIDENCE_UNAVAILABLE'
              WHEN bool_and(exclusion_reasons = 'HARD_POLICY_FILTERED') THEN 'POLICY_FILTERED'
              WHEN bool_or(contains(exclusion_reasons, 'MISMATCH') OR contains(exclusion_reasons, 'EXPIRED') OR contains(exclusion_reasons, 'CAPABILITY'))
              THEN 'EVIDENCE_UNAVAILABLE' ELSE 'NO_ELIGIBLE_WORKERS' END AS outcome
  FROM s GROUP BY request_id)"""
M["selection_outcomes"] = f"WITH {OUTCOMES} SELECT * FROM outcomes"
M["replay_verify"] = f"""WITH {OUTCOMES} SELECT request_id, request_id % 7 = 0 AS missing FROM outcomes WHERE request_id % 7 = 0 OR request_id % 11 = 0"""
M["validity_gate"] = """WITH l AS (
  SELECT c_custkey AS k, c_custkey % 19 <> 0 AS bounded, TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 500 AS INT)) AS eff,
         TIMESTAMP '1995-01-01' + to_days(CAST(500 + c_custkey % 2000 AS INT)) AS expi, c_custkey % 29 = 0 AS revoked FROM customer),
  r AS (SELECT o_custkey AS k, min(o_orderdate + to_days(1500)) AS re, bool_or(o_orderkey % 97 = 0) AS sup FROM orders GROUP BY 1),
  x AS (SELECT o_orderkey AS request_id, concat_ws(';', CASE WHEN o_orderdate > expi THEN 'LEASE_EXPIRED' END,
          CASE WHEN NOT bounded OR o_orderdate < eff THEN 'LEASE_INAPPLICABLE' END, CASE WHEN revoked THEN 'LEASE_REVOKED' END,
          CASE WHEN o_orderdate > re THEN 'READINESS_EXPIRED' END, CASE WHEN sup THEN 'READINESS_SUPERSEDED' END) AS reasons
        FROM orders JOIN l ON l.k = o_custkey JOIN r ON r.k = o_custkey)
  SELECT request_id, CASE WHEN reasons = '' THEN 'APPROVED' ELSE 'DENIED' END AS outcome,
         CASE WHEN reasons = '' THEN 'OFFER_APPROVED' ELSE reasons END AS reasons FROM x"""
M["evidence_reference_check"] = """SELECT o_orderkey AS request_id, concat_ws(';',
  CASE WHEN o_orderkey % 10 <> 3 AND o_orderkey % 17 = 0 THEN 'PLAN_DIGEST_MISMATCH' END,
  CASE WHEN o_orderkey % 10 = 3 THEN 'PLAN_REFERENCE_MISSING' END,
  CASE WHEN o_orderkey % 23 <> 0 AND o_orderkey % 100 = 19 THEN 'SELECTION_REFERENCE_AMBIGUOUS' END,
  CASE WHEN o_orderkey % 23 = 0 THEN 'SELECTION_REFERENCE_MISSING' END) AS violations FROM orders"""

# --- streams --------------------------------------------------------------------------

M["stream_movement"] = ORACLES["movement_direction"]
POLLS = f"""{QUOTES}, p AS (
  SELECT quote_id AS poll_id, 'feed-' || player_id AS provider, captured_at, market, side, american_odds,
         CAST(split_part(quote_id, '-', 4) AS BIGINT) AS number, CASE WHEN number % 37 = 0 THEN -1.0::DOUBLE ELSE line END AS line FROM quotes),
usable AS (
  SELECT *, lag(concat_ws('|', market, side, coalesce(CAST(line AS VARCHAR), '-'), american_odds)) OVER (PARTITION BY provider ORDER BY captured_at, poll_id)
         IS NOT DISTINCT FROM concat_ws('|', market, side, coalesce(CAST(line AS VARCHAR), '-'), american_odds) AS again
  FROM p WHERE number % 41 <> 0 AND number % 37 <> 0)"""
M["stream_offers"] = f"WITH {POLLS} SELECT poll_id, market, side, line, american_odds FROM usable WHERE NOT again"
M["ingest_audit"] = f"""WITH {POLLS} SELECT p.poll_id, p.provider,
  CASE WHEN u.again IS NULL THEN 'FAILED' WHEN u.again THEN 'DUPLICATE_SUPPRESSED' ELSE 'SUCCESS' END AS status,
  CASE WHEN p.number % 41 = 0 THEN 'TIMEOUT' WHEN u.again IS NULL THEN 'DATA_QUALITY' END AS error_category,
  CASE WHEN p.number % 41 = 0 THEN 'deadline api_key=[REDACTED] passed' WHEN u.again IS NULL THEN 'Provider payload contained no valid offers.' END AS error_message,
  CASE WHEN u.again = false THEN 1 ELSE 0 END AS row_count
  FROM p LEFT JOIN usable u USING (poll_id)"""
M["movement_pages"] = ORACLES["movement_points"].replace("SELECT event_id", ", points AS (SELECT event_id").rstrip() + """)
  SELECT event_id, player_id, market, side, book_id, CAST((point_no - 1) // 5 AS INT) AS page_no, count(*) AS points,
         string_agg(direction, ';' ORDER BY point_no) AS directions FROM points GROUP BY ALL"""

# Admission one request after the other: every step looks for the next request that all caps let through.
ADMISSION = f"""RECURSIVE {FRESH.removeprefix("WITH ")},
r AS MATERIALIZED (
  SELECT f.request_id, f.player_id, f.event_id, f.market, f.side, f.placed_at, CAST(round(f.stake * 100 / 10) AS DECIMAL(12,2)) / 100 AS st,
         coalesce((SELECT sum(stake) FROM open_bets o WHERE o.player_id = f.player_id), 0) AS po,
         coalesce((SELECT sum(stake) FROM open_bets o WHERE o.event_id = f.event_id), 0) AS eo,
         EXISTS (SELECT 1 FROM open_bets o WHERE o.player_id = f.player_id AND o.event_id = f.event_id AND o.market = f.market AND o.side = f.side) AS dup,
         row_number() OVER (ORDER BY placed_at, request_id) AS slot
  FROM fresh f),
w0 AS (SELECT coalesce(sum(stake), 0) AS week FROM bets WHERE status <> 'ACTIVE' AND placed_at >= TIMESTAMP '2001-07-30'),
possible AS MATERIALIZED (SELECT r.* FROM r, w0 WHERE NOT dup AND st <= 50 AND week + st <= 800 AND po + st <= 70 AND eo + st <= 90),
steps AS (
  SELECT 0::BIGINT AS slot, [] :: STRUCT(slot BIGINT, p BIGINT, e BIGINT, c VARCHAR, st DOUBLE)[] AS acc, 0::BIGINT AS n
  UNION ALL
  SELECT min(q.slot), list_append(any_value(s.acc), min_by({{'slot': q.slot, 'p': q.player_id, 'e': q.event_id::BIGINT, 'c': concat_ws('|', q.player_id, q.event_id, q.market, q.side), 'st': q.st::DOUBLE}}, q.slot)), any_value(s.n) + 1
  FROM steps s, possible q, w0
  WHERE q.slot > s.slot
    AND week + q.st + coalesce(list_sum(list_transform(s.acc, lambda x: x.st)), 0) <= 800.001
    AND q.po + q.st + coalesce(list_sum(list_transform(list_filter(s.acc, lambda x: x.p = q.player_id), lambda x: x.st)), 0) <= 70.001
    AND q.eo + q.st + coalesce(list_sum(list_transform(list_filter(s.acc, lambda x: x.e = q.event_id), lambda x: x.st)), 0) <= 90.001
    AND NOT list_contains(list_transform(s.acc, lambda x: x.c), concat_ws('|', q.player_id, q.event_id, q.market, q.side))
  HAVING count(*) > 0),
acc AS MATERIALIZED (SELECT unnest(acc, recursive := true) FROM (SELECT acc FROM steps ORDER BY n DESC LIMIT 1))"""
M["place_bets"] = f"""WITH {ADMISSION},
m AS (
  SELECT r.*, week + coalesce((SELECT sum(a.st) FROM acc a WHERE a.slot < r.slot), 0) AS w,
         po + coalesce((SELECT sum(a.st) FROM acc a WHERE a.slot < r.slot AND a.p = r.player_id), 0) AS p,
         eo + coalesce((SELECT sum(a.st) FROM acc a WHERE a.slot < r.slot AND a.e = r.event_id), 0) AS e,
         po > 0 OR EXISTS (SELECT 1 FROM acc a WHERE a.slot < r.slot AND a.p = r.player_id) AS same_player,
         eo > 0 OR EXISTS (SELECT 1 FROM acc a WHERE a.slot < r.slot AND a.e = r.event_id) AS same_event,
         dup OR EXISTS (SELECT 1 FROM acc a WHERE a.slot < r.slot AND a.c = concat_ws('|', player_id, event_id, market, side)) AS twice,
         EXISTS (SELECT 1 FROM acc a WHERE a.slot = r.slot) AS accepted
  FROM r, w0)
SELECT request_id, accepted, CASE WHEN twice THEN 'Duplicate active paper bet rejected.' ELSE concat_ws(';',
    CASE WHEN st > 50 THEN 'Exceeds maximum single stake of $50.' END,
    CASE WHEN w + st > 800.001 THEN 'Exceeds maximum weekly exposure of $800.' END,
    CASE WHEN p + st > 70.001 THEN 'Exceeds maximum player exposure of $70.' END,
    CASE WHEN e + st > 90.001 THEN 'Exceeds maximum event exposure of $90.' END) END AS rejections,
  CASE WHEN accepted THEN concat_ws(';', CASE WHEN same_player THEN 'CORRELATED_SAME_PLAYER' END, CASE WHEN same_event THEN 'CORRELATED_SAME_EVENT' END) END AS flags
FROM m"""
M["bet_rows"] = f"""WITH {ADMISSION},
q AS (SELECT player_id, event_id, market, CASE WHEN bet_id % 3 = 0 THEN 'none' ELSE side END AS side, book_id,
             arg_min({{'l': line - 1}}, (placed_at, bet_id)).l AS opening_line FROM bets WHERE status <> 'SETTLED' GROUP BY ALL)
SELECT r.request_id, r.st AS stake, b.line, b.american_odds,
       CASE WHEN q.player_id IS NULL THEN b.line ELSE q.opening_line END AS opening_line,
       CASE WHEN q.player_id IS NULL THEN b.american_odds ELSE 120 END AS opening_odds, 'ACTIVE' AS status
FROM acc JOIN r USING (slot) JOIN bets b ON b.bet_id = r.request_id
LEFT JOIN q ON q.player_id = b.player_id AND q.event_id = b.event_id AND q.market = b.market AND q.side = b.side AND q.book_id = b.book_id"""
LOG = """e AS (
  SELECT user_id AS stream, event_type || '-' || CAST(floor(value) AS BIGINT) AS idempotency_key, sha256(event_type || event_id % 3) AS digest,
         ts, event_id AS entry_id, event_id % 2 AS batch FROM events)"""
M["append_log"] = f"""WITH {LOG},
f AS (SELECT *, first_value(entry_id) OVER k AS first_id, first_value(digest) OVER k AS first_digest FROM e
      WINDOW k AS (PARTITION BY stream, idempotency_key ORDER BY batch, ts, entry_id)),
v AS (SELECT stream, idempotency_key, row_number() OVER (PARTITION BY stream ORDER BY batch, ts, entry_id) AS version FROM f WHERE entry_id = first_id)
SELECT entry_id, stream, idempotency_key,
       CASE WHEN entry_id = first_id THEN 'APPENDED' WHEN digest = first_digest THEN 'EXISTING' ELSE 'CONFLICT' END AS outcome, version
FROM f JOIN v USING (stream, idempotency_key)"""
M["log_gaps"] = f"""WITH {LOG},
n AS (SELECT stream, count(DISTINCT idempotency_key) AS n FROM e GROUP BY stream),
v AS (SELECT stream, unnest(range(1, n + 1)) AS version FROM n),
kept AS (SELECT *, lag(version, 1, 0) OVER (PARTITION BY stream ORDER BY version) AS before FROM v WHERE version % 7 <> 3 AND version % 11 <> 4)
SELECT stream, before + 1 AS missing_from, version - 1 AS missing_to FROM kept WHERE version - before > 1"""
M["stream_snapshot_unique"] = f"WITH {QUOTES} SELECT DISTINCT event_id, player_id, book_id, market, side, line, american_odds, captured_at FROM quotes"
