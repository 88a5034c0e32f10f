"""Queries over the season projection tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.operators import dims, scenario
from terrace.plans.catalogue import query
from terrace.plans.sql import MATCHES, probs, with_ctes
from terrace.sources import derived

N_SIMS = 20
SEED = 42
KEYS = ["competition", "season"]

_PRICED = f"""
priced AS (
  SELECT match_id, competition, CAST(year(match_date) AS INTEGER) AS season, home_team, away_team, {probs()},
    CAST(0.5 + (match_id * 11) % 23 / 10.0 AS DOUBLE) AS eh, CAST(0.4 + (match_id * 7) % 19 / 10.0 AS DOUBLE) AS ea FROM fixtures),
cells AS (
  SELECT match_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i > j THEN 1 WHEN i = j THEN 0 ELSE -1 END AS outcome,
    exp(-eh) * pow(eh, i) / factorial(CAST(i AS INTEGER)) * exp(-ea) * pow(ea, j) / factorial(CAST(j AS INTEGER))
    * CASE WHEN i = 0 AND j = 0 THEN 1 + eh * ea * 0.1 WHEN i = 0 AND j = 1 THEN greatest(1 - eh * 0.1, 0)
        WHEN i = 1 AND j = 0 THEN greatest(1 - ea * 0.1, 0) WHEN i = 1 AND j = 1 THEN 1.1 ELSE 1 END AS w
  FROM priced, range(9) a(i), range(9) b(j)),
cdfs AS (
  SELECT match_id, outcome, i, j, sum(w) OVER (PARTITION BY match_id, outcome ORDER BY i, j ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY match_id, outcome) AS cdf FROM cells)"""


def _u(*keys: str, part: int = 0) -> str:
    text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in (str(SEED), *keys))
    return f"('0x' || substr(md5({text}), {1 + 8 * part}, 8))::UBIGINT / 4294967296.0::DOUBLE"


_DRAWN = f"""
draws AS (
  SELECT p.*, CAST(sim AS INTEGER) AS sim, {_u('sim', 'match_id')} AS u1, {_u('sim', 'match_id', part=1)} AS u2 FROM priced p, range({N_SIMS}) t(sim)),
outcomes AS (SELECT *, CASE WHEN u1 < p_home THEN 1 WHEN u1 < p_home + p_draw THEN 0 ELSE -1 END AS outcome FROM draws),
sampled AS (
  SELECT o.competition, o.season, o.match_id, o.home_team, o.away_team, o.sim, o.outcome, c.cell.i AS hg, c.cell.j AS ag
  FROM outcomes o JOIN (SELECT match_id, outcome, list({{'i': i, 'j': j, 'cdf': cdf}} ORDER BY i, j) AS l FROM cdfs GROUP BY 1, 2) d USING (match_id, outcome),
  LATERAL (SELECT coalesce(list_filter(d.l, lambda x: x.cdf >= o.u2)[1], d.l[-1]) AS cell) c)"""
_TABLES = """
sides AS (
  SELECT competition, season, sim, home_team AS team, CASE outcome WHEN 1 THEN 3 WHEN 0 THEN 1 ELSE 0 END AS points, hg - ag AS gd, hg AS gf,
    CASE WHEN hg > 0 AND ag > 0 THEN 1 ELSE 0 END AS btts, CASE WHEN hg + ag > 2 THEN 1 ELSE 0 END AS over25 FROM sampled
  UNION ALL
  SELECT competition, season, sim, away_team, CASE outcome WHEN -1 THEN 3 WHEN 0 THEN 1 ELSE 0 END, ag - hg, ag,
    CASE WHEN hg > 0 AND ag > 0 THEN 1 ELSE 0 END, CASE WHEN hg + ag > 2 THEN 1 ELSE 0 END FROM sampled),
tables AS (
  SELECT competition, season, sim, team, CAST(sum(points) AS INTEGER) AS points, CAST(sum(gd) AS INTEGER) AS gd, CAST(sum(gf) AS INTEGER) AS gf,
    CAST(sum(btts) AS INTEGER) AS btts, CAST(sum(over25) AS INTEGER) AS over25, CAST(count(*) AS INTEGER) AS played FROM sides GROUP BY 1, 2, 3, 4)"""
_RANKED = f"""
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY competition, season, sim ORDER BY points DESC, gd DESC, gf DESC, {_u('sim', 'team')} DESC, team) AS INTEGER) AS position FROM tables)"""
_UP_TO_TABLES = (MATCHES, _PRICED, _DRAWN, _TABLES)
_UP_TO_RANKED = (*_UP_TO_TABLES, _RANKED)


def _fixtures(spark, sf_dir):
    f = derived.expected_goals(derived.probabilities(derived.fixtures(spark, sf_dir)))
    return f.withColumn("season", F.year("match_date"))


def _expanded(spark, sf_dir):
    return scenario.expand(_fixtures(spark, sf_dir), KEYS, N_SIMS, SEED)


def _positions(spark, sf_dir):
    return scenario.ranked(scenario.simulated_tables(_expanded(spark, sf_dir), KEYS), KEYS, SEED)


@query(
    "scn_grid",
    with_ctes(
        MATCHES, _PRICED,
        select="SELECT match_id, i, j, round(w / sum(w) OVER (PARTITION BY match_id), 8) AS p FROM cells",
    ),
)
def scn_grid(spark, sf_dir):
    return scenario.grid_rows(_fixtures(spark, sf_dir)).withColumn("p", F.round("p", 8))


@query(
    "scn_conditional_cdf",
    with_ctes(MATCHES, _PRICED, select="SELECT match_id, outcome, i, j, round(cdf, 8) AS cdf FROM cdfs"),
)
def scn_conditional_cdf(spark, sf_dir):
    return scenario.cdf_rows(_fixtures(spark, sf_dir)).withColumn("cdf", F.round("cdf", 8))


@query("scn_expand", with_ctes(MATCHES, _PRICED, _DRAWN, select="SELECT match_id, sim, outcome, hg, ag FROM sampled"))
def scn_expand(spark, sf_dir):
    return _expanded(spark, sf_dir).select("match_id", "sim", "outcome", "hg", "ag")


_START = "start AS (SELECT competition, CAST(season AS INTEGER) AS season, team, CAST(count(*) AS INTEGER) AS s FROM (SELECT competition, year(match_date) AS season, home_team AS team FROM fixtures) GROUP BY 1, 2, 3)"


@query(
    "scn_table",
    with_ctes(
        *_UP_TO_TABLES, _START,
        select="""
SELECT t.competition, t.season, t.sim, t.team, t.points + coalesce(s.s, 0) AS points, t.gd, t.gf + coalesce(s.s, 0) AS gf, t.played
FROM tables t LEFT JOIN start s USING (competition, season, team)""",
    ),
)
def scn_table(spark, sf_dir):
    f = _fixtures(spark, sf_dir)
    n = F.count("*").cast("int")
    start = f.groupBy("competition", "season", F.col("home_team").alias("team")).agg(n.alias("points"), F.lit(0).alias("gd"), n.alias("gf"))
    return scenario.simulated_tables(scenario.expand(f, KEYS, N_SIMS, SEED), KEYS, start).drop("block", "btts", "over25")


@query("scn_rank", with_ctes(*_UP_TO_RANKED, select="SELECT competition, season, sim, team, position FROM ranked"))
def scn_rank(spark, sf_dir):
    return _positions(spark, sf_dir).select(*KEYS, "sim", "team", "position")


@query(
    "win_rank_table",
    with_ctes(
        *_UP_TO_TABLES,
        select=f"""
SELECT competition, season, sim, team, CAST(row_number() OVER (PARTITION BY competition, season, sim ORDER BY points DESC, {_u('sim', 'team')} DESC, team) AS INTEGER) AS position FROM tables""",
    ),
)
def win_rank_table(spark, sf_dir):
    """The points-only ranking."""
    t = scenario.simulated_tables(_expanded(spark, sf_dir), KEYS)
    return scenario.ranked(t, KEYS, SEED, points_only=True).select(*KEYS, "sim", "team", "position")


@query(
    "scn_position_matrix",
    with_ctes(
        *_UP_TO_RANKED,
        select=f"SELECT competition, season, team, position, round(count(*) / {N_SIMS}.0::DOUBLE, 6) AS share FROM ranked GROUP BY 1, 2, 3, 4",
    ),
)
def scn_position_matrix(spark, sf_dir):
    m = scenario.position_matrix(_positions(spark, sf_dir), KEYS, N_SIMS)
    return m.withColumn("share", F.round("share", 6))


_RULES = f"""
rules AS ({V.values_sql(V.rule_rows(), V.RULE_COLUMNS, spark=False)}),
sizes AS (SELECT competition, season, count(DISTINCT team) AS n_teams FROM (SELECT competition, CAST(year(match_date) AS INTEGER) AS season, unnest([home_team, away_team]) AS team FROM fixtures) GROUP BY 1, 2),
s1 AS (
  SELECT z.*, least(coalesce(r.cl_slots, 4), greatest(1, n_teams // 3)) AS cl_slots, coalesce(r.uel_slots, 2) AS u, coalesce(r.relegation_slots, 3) AS rel, coalesce(r.playoff_slots, 0) AS play
  FROM sizes z LEFT JOIN rules r ON r.code = z.competition),
s2 AS (SELECT *, least(u, greatest(0, n_teams - cl_slots - 2)) AS uel_slots FROM s1),
slots AS (
  SELECT competition, season, n_teams, CAST(cl_slots AS INTEGER) AS cl_slots, CAST(uel_slots AS INTEGER) AS uel_slots,
    CAST(least(rel, greatest(1, n_teams - cl_slots - uel_slots - 1)) AS INTEGER) AS relegation_slots,
    CAST(CASE WHEN n_teams >= 8 THEN least(play, 1) ELSE 0 END AS INTEGER) AS playoff_slots FROM s2)"""


def _rules(spark, sf_dir):
    f = _fixtures(spark, sf_dir)
    teams = f.select(*KEYS, F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    return dims.league_rules(teams.groupBy(*KEYS).agg(F.count("*").alias("n_teams")))


@query("scn_rules", with_ctes(MATCHES, _RULES, select="SELECT * FROM slots"))
def scn_rules(spark, sf_dir):
    return _rules(spark, sf_dir)


_TIERS = """
tiers AS (
  SELECT competition, season, team, avg(CASE WHEN position = 1 THEN 1.0::DOUBLE ELSE 0 END) AS title, avg(CASE WHEN position <= cl_slots THEN 1.0::DOUBLE ELSE 0 END) AS ucl,
    avg(CASE WHEN position > cl_slots AND position <= cl_slots + uel_slots THEN 1.0::DOUBLE ELSE 0 END) AS uel,
    avg(CASE WHEN position > n_teams - relegation_slots - playoff_slots AND position <= n_teams - relegation_slots THEN 1.0::DOUBLE ELSE 0 END) AS playoff,
    avg(CASE WHEN position > n_teams - relegation_slots THEN 1.0::DOUBLE ELSE 0 END) AS rel, avg(CASE WHEN position <= 4 THEN 1.0::DOUBLE ELSE 0 END) AS top4
  FROM ranked JOIN slots USING (competition, season) GROUP BY 1, 2, 3)"""


@query(
    "scn_tiers",
    with_ctes(
        *_UP_TO_RANKED, _RULES, _TIERS,
        select="""
SELECT competition, season, team, round(title, 6) AS title_prob, round(ucl, 6) AS ucl_prob, round(uel, 6) AS uel_prob, round(playoff, 6) AS playoff_prob,
  round(rel, 6) AS relegation_prob, round(top4, 6) AS top4_prob FROM tiers""",
    ),
)
def scn_tiers(spark, sf_dir):
    t = scenario.tier_shares(_positions(spark, sf_dir), _rules(spark, sf_dir), KEYS, N_SIMS)
    cols = ["title_prob", "ucl_prob", "uel_prob", "playoff_prob", "relegation_prob", "top4_prob"]
    return t.select(*KEYS, "team", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "scn_stderr",
    with_ctes(
        *_UP_TO_RANKED, _RULES, _TIERS,
        select=f"""
SELECT competition, season, team, round(sqrt(greatest(title * (1 - title), 0) / {N_SIMS}), 6) AS title_se, round(sqrt(greatest(ucl * (1 - ucl), 0) / {N_SIMS}), 6) AS ucl_se,
  round(sqrt(greatest(rel * (1 - rel), 0) / {N_SIMS}), 6) AS relegation_se FROM tiers""",
    ),
)
def scn_stderr(spark, sf_dir):
    t = scenario.tier_shares(_positions(spark, sf_dir), _rules(spark, sf_dir), KEYS, N_SIMS)
    return t.select(*KEYS, "team", *[F.round(f"{c}_se", 6).alias(f"{c}_se") for c in ("title", "ucl", "relegation")])


@query(
    "scn_summary",
    with_ctes(
        *_UP_TO_RANKED,
        select="""
SELECT competition, season, team, round(avg(points), 9) AS expected_points, round(avg(gf), 9) AS expected_gf, round(avg(gd), 9) AS expected_gd, round(avg(gf) - avg(gd), 9) AS expected_ga,
  round(avg(position), 9) AS mean_position, round(quantile_cont(points::DOUBLE, 0.1), 9) AS points_p10, round(quantile_cont(points::DOUBLE, 0.9), 9) AS points_p90,
  round(sum(btts) / sum(played)::DOUBLE, 9) AS btts_pct, round(sum(over25) / sum(played)::DOUBLE, 9) AS over25_pct
FROM ranked GROUP BY 1, 2, 3""",
    ),
)
def scn_summary(spark, sf_dir):
    s = scenario.summary(_positions(spark, sf_dir), KEYS)
    return s.select(*KEYS, "team", *[F.round(c, 9).alias(c) for c in s.columns if c not in (*KEYS, "team")])


@query(
    "scn_exact_expectation",
    with_ctes(
        MATCHES, _PRICED,
        select="""
SELECT competition, season, team, round(sum(e), 6) AS expected_points FROM (
  SELECT competition, season, home_team AS team, 3 * p_home + p_draw AS e FROM priced UNION ALL SELECT competition, season, away_team, 3 * p_away + p_draw FROM priced)
GROUP BY 1, 2, 3""",
    ),
)
def scn_exact_expectation(spark, sf_dir):
    return scenario.expected_points(_fixtures(spark, sf_dir), KEYS).withColumn("expected_points", F.round("expected_points", 6))
