"""Queries over dated values, ratings, player output and entity resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions import text
from terrace.operators import asof, match_rows, resolve, squad_values
from terrace.plans.catalogue import query
from terrace.plans.sql import APPEARANCES, LONG, MATCHES, RATINGS, VALUATIONS, club, with_ctes
from terrace.sources import derived

_MONTHS = """
month_starts AS (
  SELECT unnest(generate_series(date_trunc('month', (SELECT min(valued_on) FROM valuations)),
    date_trunc('month', (SELECT max(valued_on) FROM valuations)) + INTERVAL 1 MONTH, INTERVAL 1 MONTH))::DATE AS m),
held AS (
  SELECT s.m, p.player_id, v.value_eur, v.club_id
  FROM (SELECT DISTINCT player_id FROM valuations) p CROSS JOIN month_starts s
  ASOF JOIN (SELECT DISTINCT ON (player_id, valued_on) * FROM valuations ORDER BY player_id, valued_on, seq DESC) v
    ON v.player_id = p.player_id AND s.m > v.valued_on),
club_months AS (
  SELECT c.club_id, s.m, coalesce(t.total, 0) AS total
  FROM (SELECT club_id, min(valued_on) AS first_seen FROM valuations GROUP BY 1) c JOIN month_starts s ON s.m > c.first_seen
  LEFT JOIN (SELECT club_id, m, sum(value_eur) AS total FROM held GROUP BY 1, 2) t ON t.club_id = c.club_id AND t.m = s.m),
squad_months AS (
  SELECT club_id, m, total FROM (SELECT *, lag(total) OVER (PARTITION BY club_id ORDER BY m) AS b FROM club_months)
  WHERE b IS NULL OR b <> total)"""


@query(
    "agg_squad_months",
    with_ctes(VALUATIONS, _MONTHS, select="SELECT club_id, strftime(m, '%Y-%m') AS month, CAST(total AS DOUBLE) AS value_eur FROM squad_months"),
)
def agg_squad_months(spark, sf_dir):
    return squad_values.month_snapshots(derived.valuations(spark, sf_dir))


@query(
    "agg_squad_current",
    f"""
SELECT {club('c_custkey')} AS club_id, CAST(sum(CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END) AS DOUBLE) AS value_eur,
  count(*) AS squad_size FROM customer GROUP BY 1""",
)
def agg_squad_current(spark, sf_dir):
    c = derived.table(spark, sf_dir, "customer")
    players = c.select(
        derived.club_of(F.col("c_custkey")).alias("club_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)")).alias("value_eur"),
    )
    return squad_values.current_values(players)


_SIDE_ASOF = """
SELECT m.match_id, h.{v} AS home_{n}, a.{v} AS away_{n} FROM keyed m
ASOF LEFT JOIN {t} h ON h.club_id = m.home_team AND m.mk >= h.month
ASOF LEFT JOIN {t} a ON a.club_id = m.away_team AND m.mk >= a.month"""
_KEYED = "keyed AS (SELECT *, strftime(match_date, '%Y-%m') AS mk FROM fixtures)"


@query(
    "join_asof_value",
    with_ctes(
        MATCHES,
        VALUATIONS,
        _MONTHS,
        _KEYED,
        "snaps AS (SELECT club_id, strftime(m, '%Y-%m') AS month, CAST(total AS DOUBLE) AS value_eur FROM squad_months)",
        select=_SIDE_ASOF.format(v="value_eur", n="value_eur", t="snaps"),
    ),
)
def join_asof_value(spark, sf_dir):
    m = derived.fixtures(spark, sf_dir).withColumn("month", F.date_format("match_date", "yyyy-MM"))
    snaps = squad_values.month_snapshots(derived.valuations(spark, sf_dir)).withColumnRenamed("club_id", "team")
    out = asof.asof_both_sides(m, snaps, "team", "month", {"value_eur": ("home_value_eur", "away_value_eur")})
    return out.select("match_id", "home_value_eur", "away_value_eur")


@query("join_asof_rating", with_ctes(MATCHES, RATINGS, _KEYED, select=_SIDE_ASOF.format(v="elo", n="club_rating", t="snapshots")))
def join_asof_rating(spark, sf_dir):
    m = derived.fixtures(spark, sf_dir).withColumn("month", F.date_format("match_date", "yyyy-MM"))
    snaps = derived.rating_snapshots(spark, sf_dir).withColumnRenamed("club_id", "team")
    out = asof.asof_both_sides(m, snaps, "team", "month", {"elo": ("home_club_rating", "away_club_rating")})
    return out.select("match_id", "home_club_rating", "away_club_rating")


_GAMES = """
games AS (
  SELECT club_id, game_id, min(played_on) AS played_on, CAST(sum(goals) AS BIGINT) AS goals, CAST(sum(assists) AS BIGINT) AS assists,
    CAST(sum(yellow_cards + red_cards) AS BIGINT) AS cards FROM appearances GROUP BY 1, 2)"""


@query("agg_appearances", with_ctes(APPEARANCES, _GAMES, select="SELECT * FROM games"))
def agg_appearances(spark, sf_dir):
    return squad_values.club_games(derived.appearances(spark, sf_dir))


@query(
    "join_asof_playerform",
    with_ctes(
        MATCHES,
        APPEARANCES,
        _GAMES,
        """
rolled AS (
  SELECT club_id, played_on, game_id, count(*) OVER w AS n, sum(goals + assists) OVER w / count(*) OVER w AS ga, sum(cards) OVER w / count(*) OVER w AS cards
  FROM games WINDOW w AS (PARTITION BY club_id ORDER BY played_on, game_id ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
days AS (
  SELECT DISTINCT ON (club_id, played_on) club_id, played_on, CASE WHEN n >= 10 THEN ga END AS ga, CASE WHEN n >= 10 THEN cards END AS cards
  FROM rolled ORDER BY club_id, played_on, game_id DESC)""",
        select="""
SELECT m.match_id, round(h.ga, 6) AS home_ga, round(h.cards, 6) AS home_cards, round(a.ga, 6) AS away_ga, round(a.cards, 6) AS away_cards FROM fixtures m
ASOF LEFT JOIN days h ON h.club_id = m.home_team AND m.match_date > h.played_on
ASOF LEFT JOIN days a ON a.club_id = m.away_team AND m.match_date > a.played_on""",
    ),
)
def join_asof_playerform(spark, sf_dir):
    m = derived.fixtures(spark, sf_dir)
    form = squad_values.player_form(squad_values.club_games(derived.appearances(spark, sf_dir)))
    form = form.select(F.col("club_id").alias("team"), F.col("played_on").alias("match_date"), "ga_per_game", "cards_per_game")
    out = asof.asof_both_sides(
        m,
        form,
        "team",
        "match_date",
        {"ga_per_game": ("home_ga", "away_ga"), "cards_per_game": ("home_cards", "away_cards")},
        strict=True,
    )
    return out.select("match_id", *[F.round(c, 6).alias(c) for c in ("home_ga", "home_cards", "away_ga", "away_cards")])


@query(
    "agg_team_league",
    with_ctes(
        MATCHES,
        LONG,
        f"moved AS (SELECT team, match_date, match_seq, {['PL', 'PD', 'BL1', 'SA', 'NOR1', 'BSA', 'ELC', 'ZZ1', 'ZZ2']}[(match_id + year(match_date)) % 9 + 1] AS comp FROM long_form)",
        select=f"""
SELECT team, coalesce(arg_max(comp, (match_date, match_seq)) FILTER (WHERE comp NOT IN ('ZZ1', 'ZZ2')), arg_max(comp, (match_date, match_seq))) AS league
FROM moved GROUP BY team""",
    ),
)
def agg_team_league(spark, sf_dir):
    codes = F.array(*[F.lit(c) for c in [*derived.CODES, "ZZ2"]])
    rows = match_rows.team_rows(derived.matches(spark, sf_dir))
    pos = ((F.col("match_id") + F.year("match_date")) % 9 + 1).cast("int")
    rows = rows.withColumn("competition", F.element_at(codes, pos))
    return resolve.latest_covered_league(rows, list(V.LEAGUE_VALUE_COMP))


@query(
    "src_club_season_values",
    with_ctes(
        VALUATIONS,
        """
yearly AS (SELECT club_id, year(valued_on) AS y, CAST(sum(value_eur) AS DOUBLE) AS v FROM valuations GROUP BY 1, 2)""",
        select="""
SELECT club_id, count(*) AS seasons, coalesce(max(v) FILTER (WHERE y = 2000), arg_max(v, y)) AS current_eur FROM yearly GROUP BY club_id""",
    ),
)
def src_club_season_values(spark, sf_dir):
    v = derived.valuations(spark, sf_dir)
    yearly = v.groupBy("club_id", F.year("valued_on").alias("year")).agg(F.sum("value_eur").cast("double").alias("value_eur"))
    return squad_values.season_values(yearly, 2000)


# --- entity resolution over supplier (candidate) and customer (our) names -----

_BASE = "translate(substr(md5(CAST({0} AS VARCHAR)), 1, 14), '0123456789', 'ghijklmnop')"
_NAMES_SQL = f"""
clubs AS (
  SELECT s_suppkey AS cid, 'B' || CAST(s_suppkey % 8 AS VARCHAR) AS block,
    CASE WHEN s_suppkey % 2 = 0 THEN 'FC ' || translate({_BASE.format('s_suppkey')}, 'ae', 'áé') ELSE {_BASE.format('s_suppkey')} || ' Town' END AS name
  FROM supplier),
our AS (
  SELECT c_custkey, c_custkey // 8 AS j, c_custkey % 8 AS v, {_BASE.format('c_custkey // 8')} AS b FROM customer),
teams AS (
  SELECT j, 'B' || CAST(j % 8 AS VARCHAR) AS block,
    CASE v WHEN 0 THEN 'AFC ' || upper(b) WHEN 1 THEN b || '-United' WHEN 2 THEN substr(b, 1, 9) WHEN 3 THEN substr(b, 1, 13) || 'z'
      WHEN 4 THEN 'Manual ' || CAST(j AS VARCHAR) WHEN 5 THEN 'Gone ' || CAST(j AS VARCHAR) WHEN 6 THEN 'xq' || reverse(b) ELSE b END AS team, v
  FROM our),
manual AS (
  SELECT DISTINCT t.team, CASE WHEN t.j % 3 = 0 THEN 'Nobody ' || CAST(t.j AS VARCHAR)
    WHEN t.j % 2 = 0 THEN 'FC ' || translate({_BASE.format('t.j')}, 'ae', 'áé') ELSE {_BASE.format('t.j')} || ' Town' END AS target
  FROM teams t WHERE v = 4),
absent AS (SELECT DISTINCT team FROM teams WHERE v = 5),
norm_clubs AS (
  SELECT *, regexp_replace(regexp_replace(replace(replace(replace(lower(translate(name, 'áé', 'ae')), '&', ' and '), '-', ' '), '.', ' '), '{V.CLUB_DROP_TOKENS}', ' ', 'g'), '[^a-z0-9]', '', 'g') AS nn FROM clubs),
norm_teams AS (
  SELECT DISTINCT block, team, regexp_replace(regexp_replace(replace(replace(replace(lower(translate(team, 'áé', 'ae')), '&', ' and '), '-', ' '), '.', ' '), '{V.CLUB_DROP_TOKENS}', ' ', 'g'), '[^a-z0-9]', '', 'g') AS n FROM teams)"""
_TIERS_SQL = """
exact AS (SELECT t.block, t.team, min(cid) AS cid FROM norm_teams t JOIN norm_clubs c ON c.block = t.block AND c.nn = t.n GROUP BY 1, 2 HAVING count(*) = 1),
inside AS (
  SELECT t.block, t.team, min(cid) AS cid FROM norm_teams t JOIN norm_clubs c ON c.block = t.block
    AND t.n <> '' AND c.nn <> '' AND (contains(c.nn, t.n) OR contains(t.n, c.nn)) GROUP BY 1, 2 HAVING count(*) = 1),
by_hand AS (
  SELECT t.block, t.team, min(c.cid) AS cid FROM norm_teams t JOIN manual m USING (team) LEFT JOIN clubs c ON c.block = t.block AND c.name = m.target GROUP BY 1, 2),
resolved AS (
  SELECT t.block, t.team, CASE WHEN h.team IS NOT NULL THEN 'manual' WHEN a.team IS NOT NULL THEN 'absent' WHEN e.team IS NOT NULL THEN 'exact'
      WHEN i.team IS NOT NULL THEN 'contains' ELSE 'none' END AS tier,
    CASE WHEN h.team IS NOT NULL THEN h.cid WHEN a.team IS NOT NULL THEN NULL ELSE coalesce(e.cid, i.cid) END AS cid
  FROM norm_teams t LEFT JOIN by_hand h USING (block, team) LEFT JOIN absent a ON a.team = t.team
    LEFT JOIN exact e ON e.block = t.block AND e.team = t.team LEFT JOIN inside i ON i.block = t.block AND i.team = t.team)"""


def _base(key):
    return F.translate(F.substring(F.md5(key.cast("string")), 1, 14), "0123456789", "ghijklmnop")


def _club_name(key):
    b = _base(key)
    return F.when(key % 2 == 0, F.concat(F.lit("FC "), F.translate(b, "ae", "áé"))).otherwise(F.concat(b, F.lit(" Town")))


def _block(key):
    return F.concat(F.lit("B"), (key % 8).cast("string"))


def name_fixture(spark, sf_dir):
    """(teams, clubs, manual, absent) derived from customer and supplier keys."""
    s = F.col("s_suppkey")
    clubs = derived.table(spark, sf_dir, "supplier").select(s.alias("cid"), _block(s).alias("block"), _club_name(s).alias("name"))
    c = F.col("c_custkey")
    our = derived.table(spark, sf_dir, "customer").select(F.floor(c / 8).alias("j"), (c % 8).alias("v"))
    j, v, b = F.col("j"), F.col("v"), _base(F.col("j"))
    js = j.cast("string")
    name = (
        F.when(v == 0, F.concat(F.lit("AFC "), F.upper(b)))
        .when(v == 1, F.concat(b, F.lit("-United")))
        .when(v == 2, F.substring(b, 1, 9))
        .when(v == 3, F.concat(F.substring(b, 1, 13), F.lit("z")))
        .when(v == 4, F.concat(F.lit("Manual "), js))
        .when(v == 5, F.concat(F.lit("Gone "), js))
        .when(v == 6, F.concat(F.lit("xq"), F.reverse(b)))
        .otherwise(b)
    )
    teams = our.select("j", "v", _block(j).alias("block"), name.alias("team"))
    target = F.when(j % 3 == 0, F.concat(F.lit("Nobody "), js)).otherwise(_club_name(j))
    manual = teams.filter("v = 4").select("team", target.alias("target")).distinct()
    absent = teams.filter("v = 5").select("team").distinct()
    return teams, clubs, manual, absent


@query(
    "fn_normalize_name",
    with_ctes(_NAMES_SQL, select="SELECT cid, name, nn AS norm FROM norm_clubs"),
)
def fn_normalize_name(spark, sf_dir):
    _, clubs, _, _ = name_fixture(spark, sf_dir)
    return clubs.select("cid", "name", text.normalize_name(F.col("name")).alias("norm"))


def _sides_of(spark, sf_dir):
    teams, clubs, manual, absent = name_fixture(spark, sf_dir)
    names = resolve._names(teams, V.CLUB_DROP_TOKENS)
    return names, resolve._clubs(clubs, V.CLUB_DROP_TOKENS), manual, absent


@query(
    "join_er_manual",
    with_ctes(_NAMES_SQL, _TIERS_SQL, select="SELECT block, team, CAST(cid AS DOUBLE) AS manual_cid FROM by_hand"),
)
def join_er_manual(spark, sf_dir):
    names, clubs, manual, _ = _sides_of(spark, sf_dir)
    return resolve.manual_hits(names, clubs, manual).withColumn("manual_cid", F.col("manual_cid").cast("double"))


@query(
    "join_er_absent",
    with_ctes(_NAMES_SQL, select="SELECT block, team FROM norm_teams WHERE team NOT IN (SELECT team FROM absent)"),
)
def join_er_absent(spark, sf_dir):
    names, _, _, absent = _sides_of(spark, sf_dir)
    return names.join(absent, "team", "left_anti").select("block", "team")


@query("join_er_exact", with_ctes(_NAMES_SQL, _TIERS_SQL, select="SELECT block, team, cid FROM exact"))
def join_er_exact(spark, sf_dir):
    names, clubs, _, _ = _sides_of(spark, sf_dir)
    return resolve.exact_hits(names, clubs)


@query("join_er_contains", with_ctes(_NAMES_SQL, _TIERS_SQL, select="SELECT block, team, cid FROM inside"))
def join_er_contains(spark, sf_dir):
    names, clubs, _, _ = _sides_of(spark, sf_dir)
    return resolve.containment_hits(names, clubs)


@query("join_er_similarity")
def join_er_similarity(spark, sf_dir):
    names, clubs, _, _ = _sides_of(spark, sf_dir)
    hits = resolve.similarity_hits(names, clubs)
    return hits.select("block", "team", "cid", F.round("score", 6).alias("score"))


@query(
    "join_er_tiers",
    with_ctes(_NAMES_SQL, _TIERS_SQL, select="SELECT block, team, tier, CAST(cid AS DOUBLE) AS cid FROM resolved"),
)
def join_er_tiers(spark, sf_dir):
    teams, clubs, manual, absent = name_fixture(spark, sf_dir)
    r = resolve.resolve_names(teams, clubs, manual, absent, similarity=False)
    return r.select("block", "team", "tier", F.col("cid").cast("double").alias("cid"))


_POOLS = V.values_sql([(lg, "|".join(p), c) for lg, p in V.LEAGUE_VALUE_POOL.items() for c in p], ["league", "pool", "comp"], spark=False)


def _pool_dim(spark):
    return V.literal_table(spark, [(lg, "|".join(p), c) for lg, p in V.LEAGUE_VALUE_POOL.items() for c in p], ["league", "pool", "comp"])


@query(
    "join_er_blocking",
    with_ctes(
        _NAMES_SQL,
        f"pools AS ({_POOLS})",
        select="""
SELECT t.team, t.league, p.pool, count(c.cid) AS candidates
FROM (SELECT DISTINCT team, ['ELC', 'ELC2', 'PD2', 'PL'][j % 4 + 1] AS league FROM teams) t
JOIN (SELECT DISTINCT league, pool FROM pools) p USING (league)
LEFT JOIN (SELECT cid, ['GB2', 'GB3', 'GB4', 'ES2'][cid % 4 + 1] AS comp FROM clubs) c
  ON list_contains(string_split(p.pool, '|'), c.comp)
GROUP BY 1, 2, 3""",
    ),
)
def join_er_blocking(spark, sf_dir):
    """Candidates per team when leagues of one country share a pool."""
    teams, clubs, _, _ = name_fixture(spark, sf_dir)
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key % 4 + 1).cast("int"))
    t = teams.select("team", pick(["ELC", "ELC2", "PD2", "PL"], F.col("j")).alias("league")).distinct()
    dim = _pool_dim(spark)
    comps = clubs.select("cid", pick(["GB2", "GB3", "GB4", "ES2"], F.col("cid")).alias("comp"))
    sizes = comps.join(dim.select("pool", "comp").distinct(), "comp").groupBy("pool").agg(F.count("*").alias("candidates"))
    out = t.join(dim.select("league", "pool").distinct(), "league").join(sizes, "pool", "left")
    return out.select("team", "league", "pool", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(
    "join_er_rating_name",
    with_ctes(
        _NAMES_SQL.replace(V.CLUB_DROP_TOKENS, V.RATING_DROP_TOKENS),
        """
keys AS (SELECT DISTINCT block, nn FROM norm_clubs WHERE nn <> ''),
hand AS (
  SELECT t.block, t.team, k.nn FROM norm_teams t JOIN manual m USING (team)
  JOIN norm_clubs c ON c.block = t.block AND c.name = m.target JOIN keys k ON k.block = t.block AND k.nn = c.nn),
same AS (SELECT t.block, t.team, k.nn FROM norm_teams t JOIN keys k ON k.block = t.block AND k.nn = t.n),
held AS (
  SELECT t.block, t.team, min(k.nn) AS nn FROM norm_teams t JOIN keys k ON k.block = t.block AND t.n <> '' AND (contains(k.nn, t.n) OR contains(t.n, k.nn))
  GROUP BY 1, 2 HAVING count(*) = 1)""",
        select="""
SELECT t.block, t.team, coalesce(h.nn, s.nn, c.nn) AS rating_key FROM norm_teams t
LEFT JOIN hand h USING (block, team) LEFT JOIN same s USING (block, team) LEFT JOIN held c USING (block, team)""",
    ),
)
def join_er_rating_name(spark, sf_dir):
    teams, clubs, manual, _ = name_fixture(spark, sf_dir)
    norm = lambda c: text.normalize_name(F.col(c), V.RATING_DROP_TOKENS)
    keys = clubs.select("block", norm("name").alias("name")).distinct().filter("name <> ''").withColumn("cid", F.col("name"))
    by_key = manual.withColumn("target", norm("target"))
    r = resolve.resolve_names(teams, keys, by_key, None, V.RATING_DROP_TOKENS, similarity=False, manual_falls_through=True)
    return r.select("block", "team", F.col("cid").alias("rating_key"))


@query(
    "agg_coverage",
    with_ctes(
        _NAMES_SQL,
        _TIERS_SQL,
        select="""
SELECT coalesce(t.league, '') AS league, count(*) AS teams, count(r.cid) AS mapped, count(*) FILTER (WHERE t.block IS NOT NULL AND r.cid IS NULL) AS mismatch,
  count(*) FILTER (WHERE t.block IS NULL) AS structural
FROM (SELECT DISTINCT team, 'L' || CAST(j % 8 AS VARCHAR) AS league, CASE WHEN j % 8 <> 7 THEN block END AS block FROM teams) t
LEFT JOIN resolved r ON r.block = t.block AND r.team = t.team GROUP BY 1""",
    ),
)
def agg_coverage(spark, sf_dir):
    teams, clubs, manual, absent = name_fixture(spark, sf_dir)
    r = resolve.resolve_names(teams, clubs, manual, absent, similarity=False)
    ours = teams.select(
        "team", F.concat(F.lit("L"), (F.col("j") % 8).cast("string")).alias("league"), F.when(F.col("j") % 8 != 7, F.col("block")).alias("block")
    ).distinct()
    return resolve.coverage(ours, r)


@query(
    "join_alias",
    with_ctes(
        _NAMES_SQL,
        """
known AS (SELECT DISTINCT name AS team FROM clubs),
aliases AS (SELECT lower(translate(team, 'áé', 'ae')) AS alias, target FROM manual),
ext AS (SELECT j, v, CASE WHEN v % 2 = 0 THEN upper(team) ELSE team END AS name, (SELECT any_value(name) FROM clubs WHERE cid = j) AS short FROM teams)""",
        select="""
SELECT e.name, coalesce(k1.team, a1.target, k2.team, a2.target) AS team FROM ext e
LEFT JOIN known k1 ON k1.team = e.name
LEFT JOIN (SELECT a.* FROM aliases a JOIN known k ON k.team = a.target) a1 ON a1.alias = trim(lower(translate(e.name, 'áé', 'ae')))
LEFT JOIN known k2 ON k2.team = e.short
LEFT JOIN (SELECT a.* FROM aliases a JOIN known k ON k.team = a.target) a2 ON a2.alias = trim(lower(translate(e.short, 'áé', 'ae')))""",
    ),
)
def join_alias(spark, sf_dir):
    teams, clubs, manual, _ = name_fixture(spark, sf_dir)
    known = clubs.select(F.col("name").alias("team")).distinct()
    aliases = manual.select(F.lower(text.fold_ascii(F.col("team"))).alias("alias"), "target")
    ext = teams.join(clubs.select(F.col("cid").alias("j"), F.col("name").alias("short")), "j", "left")
    ext = ext.select(F.when(F.col("v") % 2 == 0, F.upper("team")).otherwise(F.col("team")).alias("name"), "short")
    return resolve.alias_lookup(ext, known, aliases, ["name", "short"]).select("name", "team")


@query(
    "join_value_fill",
    with_ctes(
        _NAMES_SQL,
        _TIERS_SQL,
        """
mine AS (SELECT DISTINCT block, team, v, j, CASE WHEN j % 5 = 0 THEN 1000000.0::DOUBLE END AS value_eur FROM teams)""",
        select="""
SELECT m.block, m.team, round(coalesce(m.value_eur, CASE WHEN r.cid IS NOT NULL THEN s.s_acctbal * 1000 END, x.value_eur), 2) AS value_eur
FROM mine m LEFT JOIN resolved r USING (block, team) LEFT JOIN supplier s ON s.s_suppkey = r.cid
LEFT JOIN (SELECT DISTINCT team, 77.0::DOUBLE AS value_eur FROM teams WHERE v = 6) x ON x.team = m.team""",
    ),
)
def join_value_fill(spark, sf_dir):
    teams, clubs, manual, absent = name_fixture(spark, sf_dir)
    mine = teams.select("block", "team", F.when(F.col("j") % 5 == 0, F.lit(1000000.0)).alias("value_eur")).distinct()
    r = resolve.resolve_names(teams, clubs, manual, absent, similarity=False).filter("cid is not null")
    current = derived.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cid"), (F.col("s_acctbal") * 1000).alias("value_eur"))
    pooled = r.join(current, "cid").select("team", "value_eur")
    exact = teams.filter("v = 6").select("team", F.lit(77.0).alias("value_eur")).distinct()
    out = squad_values.fill_missing_values(mine, pooled, exact)
    return out.select("block", "team", F.round("value_eur", 2).alias("value_eur"))
