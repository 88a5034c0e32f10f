"""SQL twins of the derived tables in ``sources.derived``."""

from __future__ import annotations

from terrace.sources.derived import CODES


def club(key: str) -> str:
    return f"'T' || lpad(CAST(({key}) % 8 * 100 + ({key}) // 8 % 20 AS VARCHAR), 4, '0')"


_STAT_SQL = {
    "shots": "CAST(l_quantity AS BIGINT)",
    "shots_on_target": "l_linenumber",
    "corners": "CAST(l_quantity AS BIGINT) % 7",
    "fouls": "CAST(l_quantity AS BIGINT) % 11",
    "yellow": "l_linenumber % 3",
    "red": "l_linenumber // 5",
}
_stat_aggs = ",\n".join(
    f"CAST(sum({expr}) FILTER (WHERE l_returnflag = '{flag}') AS INTEGER) AS {side}_{name}"
    for name, expr in _STAT_SQL.items()
    for side, flag in (("home", "R"), ("away", "A"))
)
_stat_cols = ", ".join(f"{side}_{name}" for name in _STAT_SQL for side in ("home", "away"))
_codes = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"

MATCHES = f"""
line_scores AS (
  SELECT l_orderkey AS match_id,
    CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS INTEGER) AS hs,
    CAST(count(*) FILTER (WHERE l_returnflag = 'A') AS INTEGER) AS aws,
    {_stat_aggs}
  FROM lineitem GROUP BY l_orderkey),
fixtures AS (
  SELECT o_orderkey AS match_id, o_orderkey AS match_seq, CAST(o_orderdate AS DATE) AS match_date,
    {_codes}[o_orderkey % 8 + 1] AS competition,
    'T' || lpad(CAST(o_orderkey % 8 * 100 + (o_custkey + o_orderkey // 8) % 20 AS VARCHAR), 4, '0') AS home_team,
    'T' || lpad(CAST(o_orderkey % 8 * 100
        + ((o_custkey + o_orderkey // 8) % 20 + 1 + (o_orderkey // 8) % 19) % 20 AS VARCHAR), 4, '0') AS away_team
  FROM orders),
matches AS (
  SELECT f.*, coalesce(s.hs, 0) AS home_score, coalesce(s.aws, 0) AS away_score,
    CAST(sign(coalesce(s.hs, 0) - coalesce(s.aws, 0)) AS INTEGER) AS result,
    coalesce(s.hs, 0) + coalesce(s.aws, 0) AS total_goals,
    coalesce(s.hs, 0) - coalesce(s.aws, 0) AS goal_diff,
    {_stat_cols}
  FROM fixtures f LEFT JOIN line_scores s USING (match_id))"""

LONG = """
long_form AS (
  SELECT match_id, match_seq, match_date, competition, 'H' AS venue, home_team AS team, away_team AS opponent,
    home_score AS gs, away_score AS gc, goal_diff AS gd, result AS side_result,
    CASE result WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 0 END AS points,
    coalesce(home_shots, 0) AS shots_for, coalesce(away_shots, 0) AS shots_against,
    coalesce(home_shots_on_target, 0) AS sot_for, coalesce(away_shots_on_target, 0) AS sot_against,
    coalesce(home_corners, 0) AS corners_for, coalesce(away_corners, 0) AS corners_against,
    coalesce(home_yellow, 0) + coalesce(home_red, 0) AS cards_for,
    coalesce(away_yellow, 0) + coalesce(away_red, 0) AS cards_against
  FROM matches
  UNION ALL
  SELECT match_id, match_seq, match_date, competition, 'A', away_team, home_team,
    away_score, home_score, -goal_diff, -result,
    CASE result WHEN -1 THEN 3 WHEN 0 THEN 1 ELSE 0 END,
    coalesce(away_shots, 0), coalesce(home_shots, 0),
    coalesce(away_shots_on_target, 0), coalesce(home_shots_on_target, 0),
    coalesce(away_corners, 0), coalesce(home_corners, 0),
    coalesce(away_yellow, 0) + coalesce(away_red, 0),
    coalesce(home_yellow, 0) + coalesce(home_red, 0)
  FROM matches)"""


def probs(key: str = "match_id", names: tuple[str, str, str] = ("p_home", "p_draw", "p_away")) -> str:
    wh, wd, wa = f"(20 + ({key} * 31) % 97)", f"(20 + ({key} * 17) % 53)", f"(20 + ({key} * 43) % 89)"
    total = f"CAST({wh} + {wd} + {wa} AS DOUBLE)"
    return ", ".join(f"{w} / {total} AS {n}" for w, n in zip((wh, wd, wa), names))


def probs2(key: str = "match_id") -> str:
    wh, wd, wa = f"(10 + ({key} * 13) % 71)", f"(10 + ({key} * 29) % 37)", f"(10 + ({key} * 7) % 61)"
    total = f"CAST({wh} + {wd} + {wa} AS DOUBLE)"
    return f"{wh} / {total} AS q_home, {wd} / {total} AS q_draw, {wa} / {total} AS q_away"


OUTCOMES = f"""
outcomes AS (
  SELECT match_id, match_date, match_seq, competition, result AS y, {probs()}, {probs2()} FROM matches)"""

FORECASTS = f"""
forecasts AS (
  SELECT match_id, match_date, competition, home_team, away_team, home_score, away_score,
    round(p_home, 4) AS p_home, round(p_draw, 4) AS p_draw, round(p_away, 4) AS p_away,
    CASE WHEN o_orderstatus = 'F' THEN 'settled' ELSE 'pending' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN CASE result WHEN 1 THEN 'Home Win' WHEN 0 THEN 'Draw' ELSE 'Away Win' END END AS actual,
    CASE WHEN o_orderstatus = 'F' THEN match_date + 1 END AS settled_at
  FROM (SELECT m.*, o.o_orderstatus, {probs('m.match_id')}
        FROM matches m JOIN orders o ON o.o_orderkey = m.match_id))"""

VALUATIONS = f"""
valuations AS (
  SELECT CAST(o_orderdate AS DATE) AS valued_on, o_custkey AS player_id, CAST(o_totalprice AS DECIMAL(18,2)) AS value_eur,
    {club('o_custkey + year(o_orderdate)')} AS club_id, o_orderkey AS seq
  FROM orders)"""

APPEARANCES = f"""
appearances AS (
  SELECT {club('l_suppkey')} AS club_id, l_orderkey AS game_id, CAST(l_shipdate AS DATE) AS played_on,
    l_linenumber % 3 AS goals, l_partkey % 2 AS assists, l_linenumber % 2 AS yellow_cards,
    CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END AS red_cards
  FROM lineitem)"""

RATINGS = f"""
snapshots AS (
  SELECT {club('l_suppkey')} AS club_id, strftime(l_shipdate, '%Y-%m') AS month,
    floor(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 30.0 * 100.0) / 100.0 AS elo
  FROM lineitem GROUP BY 1, 2)"""


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select.strip()
