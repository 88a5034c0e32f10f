"""Queries over the registry, set operations, fixtures lists and source preference."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.operators import dims, feeds, forecast_log, match_rows, tables
from terrace.plans.catalogue import query
from terrace.plans.sql import LONG, MATCHES, with_ctes
from terrace.sources import derived

_LEAGUES = f"leagues AS ({V.values_sql(V.league_rows(), V.LEAGUE_COLUMNS, spark=False)})"
_CUPS = f"cups AS ({V.values_sql(V.CUPS, ['code', 'cup_name'], spark=False)})"
_CONFEDS = f"confeds AS ({V.values_sql(V.confederation_rows(), V.CONFEDERATION_COLUMNS, spark=False)})"
_CODE_SQL = "CASE WHEN match_id % 50 = 0 THEN 'CL' WHEN match_id % 51 = 0 THEN '' ELSE competition END"


def _coded(spark, sf_dir):
    k = F.col("match_id")
    code = F.when(k % 50 == 0, "CL").when(k % 51 == 0, "").otherwise(F.col("competition"))
    return derived.fixtures(spark, sf_dir).select("match_id", "home_team", code.alias("competition"))


@query(
    "join_registry",
    with_ctes(
        MATCHES, _LEAGUES, _CUPS, f"coded AS (SELECT match_id, {_CODE_SQL} AS code FROM fixtures)",
        select="""
SELECT match_id, coalesce(l.league_name, c.cup_name, nullif(f.code, ''), 'Other') AS league_name, CAST(coalesce(l.league_rank, 999) AS INTEGER) AS league_rank,
  coalesce(l.calendar_year, false) AS calendar_year
FROM coded f LEFT JOIN leagues l USING (code) LEFT JOIN cups c ON c.code = f.code""",
    ),
)
def join_registry(spark, sf_dir):
    return dims.with_registry(_coded(spark, sf_dir)).select("match_id", "league_name", "league_rank", "calendar_year")


@query(
    "join_cup_union",
    with_ctes(
        MATCHES, _LEAGUES, _CUPS,
        f"coded AS (SELECT match_id, {_CODE_SQL} AS code FROM fixtures)",
        select="""
SELECT code, name, count(match_id) AS matches FROM (
  SELECT code, league_name AS name FROM leagues WHERE live_api UNION ALL SELECT code, cup_name FROM cups) LEFT JOIN coded USING (code) GROUP BY 1, 2""",
    ),
)
def join_cup_union(spark, sf_dir):
    counts = _coded(spark, sf_dir).groupBy(F.col("competition").alias("code")).agg(F.count("*").alias("matches"))
    listed = dims.fixture_leagues(spark).select("code", "name")
    return listed.join(counts, "code", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


@query(
    "join_confed_labels",
    with_ctes(
        MATCHES, _LEAGUES, _CONFEDS,
        select="""
SELECT match_id, coalesce(c.top_label, 'UCL') AS top_label, coalesce(c.second_label, 'UEL') AS second_label
FROM fixtures f LEFT JOIN leagues l ON l.code = f.competition LEFT JOIN confeds c USING (country)""",
    ),
)
def join_confed_labels(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir).select("match_id", "competition")
    return dims.with_tier_labels(f).select("match_id", "top_label", "second_label")


_PRETTY = "pretty AS (SELECT DISTINCT home_team AS team, 'FC ' || home_team AS display FROM fixtures WHERE match_id % 8 < 3)"


def _pretty(f):
    return f.filter("match_id % 8 < 3").select(F.col("home_team").alias("team"), F.concat(F.lit("FC "), F.col("home_team")).alias("display")).distinct()


@query(
    "join_display_name",
    with_ctes(
        MATCHES, _PRETTY,
        select="SELECT match_id, home_team AS team, coalesce(p.display, home_team) AS display FROM fixtures f LEFT JOIN pretty p ON p.team = f.home_team",
    ),
)
def join_display_name(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir)
    return dims.with_display_name(f.select("match_id", F.col("home_team").alias("team")), _pretty(f)).select("match_id", "team", "display")


@query(
    "join_round_robin",
    with_ctes(
        "mine AS (SELECT DISTINCT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS league, c_name AS team FROM customer WHERE c_acctbal > 0)",
        select="""
SELECT a.league, a.team AS home_team, b.team AS away_team FROM mine a JOIN mine b ON b.league = a.league AND b.team <> a.team
WHERE a.league IN (SELECT league FROM mine GROUP BY 1 HAVING count(*) >= 4)""",
    ),
)
def join_round_robin(spark, sf_dir):
    c = derived.table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    teams = c.select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("league"), F.col("c_name").alias("team"))
    return tables.round_robin(teams)


@query(
    "join_standings_fixtures",
    with_ctes(
        MATCHES, LONG,
        """
table_ AS (SELECT competition, year(match_date) AS season, team, CAST(sum(points) AS INTEGER) AS points FROM long_form WHERE month(match_date) < 7 GROUP BY 1, 2, 3)""",
        select="""
SELECT f.match_id, h.points AS home_points, a.points AS away_points FROM fixtures f
JOIN table_ h ON h.competition = f.competition AND h.season = year(f.match_date) AND h.team = f.home_team
JOIN table_ a ON a.competition = f.competition AND a.season = year(f.match_date) AND a.team = f.away_team
WHERE month(f.match_date) >= 7""",
    ),
)
def join_standings_fixtures(spark, sf_dir):
    m = derived.matches(spark, sf_dir).withColumn("season", F.year("match_date"))
    played = match_rows.team_rows(m.filter("month(match_date) < 7")).withColumn("season", F.year("match_date"))
    table = tables.league_table(played, ["competition", "season"])
    rest = m.filter("month(match_date) >= 7").select("match_id", "competition", "season", "home_team", "away_team")
    return tables.remaining_fixtures(rest, table, ["competition", "season"]).select("match_id", "home_points", "away_points")


@query(
    "join_membership_update",
    with_ctes(
        "mine AS (SELECT c_custkey AS team, c_mktsegment AS league FROM customer)",
        "member AS (SELECT o_custkey AS team, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS lg FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)",
        select="SELECT team, coalesce(lg, league) AS league, coalesce(lg <> league, false) AS moved FROM mine LEFT JOIN member USING (team)",
    ),
)
def join_membership_update(spark, sf_dir):
    mine = derived.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("team"), F.col("c_mktsegment").alias("league"))
    o = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    member = o.select(F.col("o_custkey").alias("team"), F.col("o_orderpriority").alias("league"), F.struct("o_orderdate", "o_orderkey").alias("position"))
    return dims.reassign_leagues(mine, member).select("team", "league", "moved")


@query(
    "agg_team_listing",
    with_ctes(
        MATCHES, LONG, _LEAGUES, _PRETTY,
        "st AS (SELECT team, arg_max(competition, (match_date, match_seq)) AS code, 1400 + CAST(sum(points) AS BIGINT) % 337 AS elo FROM long_form GROUP BY 1)",
        select="""
SELECT st.team, coalesce(p.display, st.team) AS display, round(elo::DOUBLE, 1) AS elo, CASE WHEN elo >= 1650 THEN 'Elite' WHEN elo >= 1560 THEN 'Strong' WHEN elo >= 1470 THEN 'Mid-table' ELSE 'Underdog' END AS tier,
  l.code AS league, l.league_name, CAST(l.league_rank AS INTEGER) AS league_rank FROM st JOIN leagues l USING (code) LEFT JOIN pretty p USING (team)""",
    ),
)
def agg_team_listing(spark, sf_dir):
    m = derived.matches(spark, sf_dir)
    state = match_rows.team_rows(m).groupBy("team").agg(
        F.max_by("competition", F.struct("match_date", "match_seq")).alias("league"),
        (1400 + F.sum("points") % 337).cast("double").alias("elo"),
        F.count("*").alias("matches_played"),
    )
    return dims.team_listing(state, _pretty(m))


# --- set operations and source preference -----------------------------------

_FEEDS = """
feeds AS (
  SELECT match_id, competition, CAST(year(match_date) AS INTEGER) AS season, match_date, CAST(s AS INTEGER) AS priority, home_team
  FROM fixtures, range(3) t(s) WHERE (match_id + s) % 3 <> 1 AND NOT (s = 0 AND year(match_date) % 2 = 0))"""


def _three_feeds(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir).withColumn("season", F.year("match_date"))
    out = []
    for s in range(3):
        part = f.filter((F.col("match_id") + s) % 3 != 1)
        if s == 0:
            part = part.filter("season % 2 <> 0")
        out.append(part.select("match_id", "competition", "season", "match_date", F.lit(s).alias("priority"), "home_team"))
    return out


@query(
    "src_preference",
    with_ctes(
        MATCHES, _FEEDS,
        "seen AS (SELECT competition, season, priority FROM feeds UNION SELECT DISTINCT competition, CAST(year(match_date) AS INTEGER), 0 FROM fixtures WHERE year(match_date) = 1996 AND competition = 'PL'),"
        "best AS (SELECT competition, season, min(priority) AS priority FROM seen GROUP BY 1, 2)",
        select="SELECT f.match_id, f.competition, f.season, f.priority FROM feeds f JOIN best USING (competition, season, priority)",
    ),
)
def src_preference(spark, sf_dir):
    """The main feed wins for PL 1996 because its file exists, although it has no rows."""
    rows = feeds.union_feeds(_three_feeds(spark, sf_dir))
    f = derived.fixtures(spark, sf_dir).filter("year(match_date) = 1996 and competition = 'PL'")
    present = f.select("competition", F.year("match_date").alias("season"), F.lit(0).alias("priority")).distinct()
    kept = feeds.prefer_sources(rows, ["competition", "season"], present=present)
    return kept.select("match_id", "competition", "season", "priority")


@query(
    "src_union_all",
    with_ctes(
        MATCHES, _FEEDS,
        select="SELECT match_id, priority, row_number() OVER (ORDER BY match_date, season, competition, priority, match_id) - 1 AS match_seq FROM feeds",
    ),
)
def src_union_all(spark, sf_dir):
    rows = feeds.union_feeds(_three_feeds(spark, sf_dir))
    out = feeds.with_sequence(rows, ["match_date", "season", "competition", "priority", "match_id"])
    return out.select("match_id", "priority", "match_seq")


@query(
    "set_union_feeds",
    with_ctes(MATCHES, _FEEDS, select="SELECT competition, season, priority, count(*) AS matches FROM feeds GROUP BY 1, 2, 3"),
)
def set_union_feeds(spark, sf_dir):
    rows = feeds.union_feeds(_three_feeds(spark, sf_dir))
    return rows.groupBy("competition", "season", "priority").agg(F.count("*").alias("matches"))


@query(
    "set_split_season",
    with_ctes(
        MATCHES,
        select="""
SELECT 'A+B' AS code, CAST(year(match_date) AS INTEGER) AS season, count(*) AS matches, count(*) FILTER (WHERE month(match_date) <= 6) AS first_half
FROM fixtures WHERE competition IN ('NOR1', 'BSA') GROUP BY 2""",
    ),
)
def set_split_season(spark, sf_dir):
    """Two half-season codes that make one season."""
    f = derived.fixtures(spark, sf_dir).filter(F.col("competition").isin("NOR1", "BSA")).withColumn("season", F.year("match_date"))
    halves = [f.filter("month(match_date) <= 6").withColumn("half", F.lit("A")), f.filter("month(match_date) > 6").withColumn("half", F.lit("B"))]
    season = feeds.union_feeds(halves)
    return season.groupBy(F.lit("A+B").alias("code"), "season").agg(
        F.count("*").alias("matches"), F.count(F.when(F.col("half") == "A", 1)).alias("first_half")
    )


_STATUS = """
polled AS (
  SELECT match_id, 0 AS priority, 'SCHEDULED' AS status, match_date FROM fixtures WHERE match_id % 3 <> 0
  UNION ALL SELECT match_id, 1, 'TIMED', match_date + 1 FROM fixtures WHERE match_id % 2 = 0)"""


def _polled(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir)
    first = f.filter("match_id % 3 <> 0").select("match_id", F.lit(0).alias("priority"), F.lit("SCHEDULED").alias("status"), "match_date")
    second = f.filter("match_id % 2 = 0").select(
        "match_id", F.lit(1).alias("priority"), F.lit("TIMED").alias("status"), F.date_add("match_date", 1).alias("match_date")
    )
    return first, second


_FIRST = "firsts AS (SELECT * FROM polled QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY priority) = 1)"


@query("set_union_status", with_ctes(MATCHES, _STATUS, _FIRST, select="SELECT match_id, status FROM firsts"))
def set_union_status(spark, sf_dir):
    return forecast_log.first_per_match(feeds.union_feeds(list(_polled(spark, sf_dir)))).select("match_id", "status")


@query("win_dedupe_first", with_ctes(MATCHES, _STATUS, _FIRST, select="SELECT match_id, status, match_date FROM firsts"))
def win_dedupe_first(spark, sf_dir):
    return forecast_log.first_per_match(feeds.union_feeds(list(_polled(spark, sf_dir)))).select("match_id", "status", "match_date")


_WARM = f"warm AS ({V.values_sql(list(V.WARMUP_LEAGUES.items()), ['feed_code', 'code'], spark=False)})"


@query(
    "set_codes",
    with_ctes(
        MATCHES, _LEAGUES, _WARM,
        "codes AS (SELECT code, true AS top_flight FROM leagues UNION ALL SELECT code, false FROM warm)",
        select="SELECT code, top_flight, count(match_id) AS matches FROM codes LEFT JOIN fixtures ON competition = code GROUP BY 1, 2",
    ),
)
def set_codes(spark, sf_dir):
    rated = V.league_dim(spark).select("code", F.lit(True).alias("top_flight"))
    warm = V.literal_table(spark, list(V.WARMUP_LEAGUES.items()), ["feed_code", "code"]).select("code", F.lit(False).alias("top_flight"))
    n = derived.fixtures(spark, sf_dir).groupBy(F.col("competition").alias("code")).agg(F.count("*").alias("matches"))
    return rated.unionByName(warm).join(n, "code", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


@query(
    "set_except_logged",
    with_ctes(MATCHES, select="SELECT match_id, home_team FROM fixtures WHERE match_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"),
)
def set_except_logged(spark, sf_dir):
    log = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    return derived.fixtures(spark, sf_dir).join(log, "match_id", "left_anti").select("match_id", "home_team")


@query(
    "src_injury_rollup",
    """
WITH hurt AS (
  SELECT user_id AS team, CASE event_type WHEN 'error' THEN 'Missing Fixture' WHEN 'click' THEN 'Questionable' ELSE 'Other' END AS kind FROM events)
SELECT team, round(sum(CASE WHEN contains(kind, 'Missing') THEN 1.0 WHEN contains(kind, 'Questionable') THEN 0.5 ELSE 0.0 END)::DOUBLE, 1) AS key_absences,
  round(least(0.5, sum(CASE WHEN contains(kind, 'Missing') THEN 1.0 WHEN contains(kind, 'Questionable') THEN 0.5 ELSE 0.0 END)::DOUBLE / 25.0), 3) AS value_out_fraction
FROM hurt GROUP BY team""",
)
def src_injury_rollup(spark, sf_dir):
    from terrace.sources.side_json import injury_rollup

    e = derived.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "Missing Fixture").when(F.col("event_type") == "click", "Questionable").otherwise("Other")
    return injury_rollup(e.select(F.col("user_id").alias("team"), kind.alias("kind")))
