"""Queries over row-wise projections and feature blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions import dates, goals
from terrace.operators import blocks, match_rows
from terrace.plans.catalogue import query
from terrace.plans.sql import LONG, MATCHES, probs, with_ctes
from terrace.sources import derived

def _k():
    return F.col("match_id")


def _rounded(df, keys, cols, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(n) for n, c in cols.items()])


@query(
    "prj_result",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, result, total_goals, goal_diff,
  CASE WHEN home_score > away_score THEN 'Home Win' WHEN home_score < away_score THEN 'Away Win' ELSE 'Draw' END AS label
FROM matches""",
    ),
)
def prj_result(spark, sf_dir):
    m = match_rows.with_outcome(derived.matches(spark, sf_dir).select("match_id", "home_score", "away_score"))
    label = match_rows.result_label(F.col("home_score"), F.col("away_score"))
    return m.select("match_id", "result", "total_goals", "goal_diff", label.alias("label"))


@query(
    "prj_finished",
    with_ctes(
        MATCHES,
        select="""
SELECT m.match_id, m.home_score, m.away_score FROM matches m JOIN orders o ON o.o_orderkey = m.match_id
WHERE o.o_orderstatus = 'F' AND m.match_id % 13 <> 0""",
    ),
)
def prj_finished(spark, sf_dir):
    state = derived.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"),
        F.when(F.col("o_orderstatus") == "F", "FINISHED").otherwise("SCHEDULED").alias("status"),
    )
    m = derived.matches(spark, sf_dir).join(state, "match_id")
    m = m.withColumn("home_score", F.when(_k() % 13 != 0, F.col("home_score")))
    return match_rows.finished(m).select("match_id", "home_score", "away_score")


@query(
    "prj_dates",
    with_ctes(
        MATCHES,
        select="SELECT match_id, CASE WHEN match_id % 11 = 0 THEN NULL ELSE match_date END AS match_date FROM matches",
    ),
)
def prj_dates(spark, sf_dir):
    d = F.col("match_date")
    text = (
        F.when(_k() % 11 == 0, F.lit("31/31/2020"))
        .when(_k() % 4 == 0, F.date_format(d, "dd/MM/yy"))
        .when(_k() % 4 == 1, F.date_format(d, "d/M/yyyy"))
        .when(_k() % 4 == 2, F.concat(F.lit(" "), F.date_format(d, "yyyy-MM-dd")))
        .otherwise(F.date_format(d, "E MMM d yyyy"))
    )
    return derived.fixtures(spark, sf_dir).select("match_id", dates.parse_match_date(text).alias("match_date"))


@query(
    "prj_score_text",
    with_ctes(
        MATCHES,
        select="SELECT match_id, home_score, away_score FROM matches WHERE match_id % 7 NOT IN (0, 1)",
    ),
)
def prj_score_text(spark, sf_dir):
    h, a = F.col("home_score").cast("string"), F.col("away_score").cast("string")
    text = F.when(_k() % 7 == 0, F.lit("?")).when(_k() % 7 == 1, F.concat_ws("-", h, a, a)).otherwise(F.concat_ws("-", h, a))
    m = derived.matches(spark, sf_dir).select("match_id", text.alias("ft"))
    home, away = match_rows.split_score(F.col("ft"))
    parsed = m.select("match_id", home.alias("home_score"), away.alias("away_score"))
    return parsed.dropna(subset=["home_score", "away_score"])


@query(
    "prj_stats",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, CAST(CASE WHEN match_id % 9 <> 0 THEN home_shots END AS DOUBLE) AS home_shots, CAST(away_corners AS DOUBLE) AS away_corners,
  coalesce(CASE WHEN match_id % 9 <> 0 THEN home_shots END, 0) AS home_shots_avg_input
FROM matches""",
    ),
)
def prj_stats(spark, sf_dir):
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    raw = derived.matches(spark, sf_dir).select(
        "match_id", F.when(_k() % 9 == 0, F.lit("n/a")).otherwise(text("home_shots")).alias("HS"), text("away_corners").alias("AC")
    )
    hs, ac = F.trim("HS").try_cast("int"), F.trim("AC").try_cast("int")
    return raw.select(
        "match_id", hs.cast("double").alias("home_shots"), ac.cast("double").alias("away_corners"), F.coalesce(hs, F.lit(0)).alias("home_shots_avg_input")
    )


_LEAGUES = V.values_sql(V.league_rows(), V.LEAGUE_COLUMNS, spark=False)


@query(
    "prj_season_codes",
    with_ctes(
        MATCHES,
        f"leagues AS ({_LEAGUES})",
        """
dated AS (
  SELECT f.match_id, coalesce(l.calendar_year, false) AS cal, f.match_date,
    CASE WHEN coalesce(l.calendar_year, false) OR month(f.match_date) >= 7 THEN year(f.match_date) ELSE year(f.match_date) - 1 END AS y0,
    CASE WHEN month(f.match_date) >= 7 THEN year(f.match_date) ELSE year(f.match_date) - 1 END AS split
  FROM fixtures f LEFT JOIN leagues l ON l.code = f.competition),
coded AS (
  SELECT *, CAST(split AS VARCHAR) || '-' || lpad(CAST((split + 1) % 100 AS VARCHAR), 2, '0') AS season FROM dated)""",
        select="""
SELECT match_id, season, CAST(y0 AS INTEGER) AS date_season, substr(season, 3, 2) || substr(season, 6, 2) AS compact,
  CASE WHEN cal THEN substr(season, 1, 2) || substr(season, 6, 2)
    ELSE substr(season, 1, 4) || '/' || substr(season, 1, 2) || substr(season, 6, 2) END AS feed_label,
  CAST(CASE WHEN cal THEN split + 1 ELSE split END AS INTEGER) AS start_id
FROM coded""",
    ),
)
def prj_season_codes(spark, sf_dir):
    dim = V.league_dim(spark).select(F.col("code").alias("competition"), "calendar_year")
    f = derived.fixtures(spark, sf_dir).join(dim, "competition", "left")
    f = f.withColumn("cal", F.coalesce("calendar_year", F.lit(False)))
    f = f.withColumn("season", dates.season_code(dates.season_of_date(F.col("match_date"), F.lit(False))))
    return f.select(
        "match_id",
        "season",
        dates.season_of_date(F.col("match_date"), F.col("cal")).alias("date_season"),
        dates.compact_season(F.col("season")).alias("compact"),
        dates.long_season(F.col("season"), F.col("cal")).alias("feed_label"),
        dates.season_start_id(F.col("season"), F.col("cal")).alias("start_id"),
    )


@query(
    "prj_trailing_year",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, CASE WHEN match_id % 5 = 0 THEN NULL ELSE CAST(year(match_date) AS VARCHAR) END AS season_year FROM fixtures""",
    ),
)
def prj_trailing_year(spark, sf_dir):
    y = F.year("match_date")
    label = (
        F.when(_k() % 5 == 0, F.lit("unknown"))
        .when(_k() % 2 == 0, F.concat((y - 1).cast("string"), F.lit("/"), y.cast("string"), F.lit(" ")))
        .otherwise(y.cast("string"))
    )
    return derived.fixtures(spark, sf_dir).select("match_id", dates.trailing_year(label).alias("season_year"))


def name_canon_expr(col):
    """Replace the known duplicate spellings."""
    out = col
    for old, new in V.NAME_CANON.items():
        out = F.when(F.trim(col) == old, F.lit(new)).otherwise(out)
    return out


@query(
    "prj_name_canon",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, CASE match_id % 10 WHEN 0 THEN 'HamKam' WHEN 1 THEN 'Colon Santa Fe' ELSE home_team END AS home_team FROM fixtures""",
    ),
)
def prj_name_canon(spark, sf_dir):
    raw = F.when(_k() % 10 == 0, "Ham-Kam").when(_k() % 10 == 1, "Colon Santa FE").otherwise(F.col("home_team"))
    named = derived.fixtures(spark, sf_dir).select("match_id", raw.alias("raw"))
    return named.select("match_id", name_canon_expr(F.col("raw")).alias("home_team"))


@query(
    "prj_points",
    with_ctes(MATCHES, LONG, select="SELECT match_id, venue, points FROM long_form"),
)
def prj_points(spark, sf_dir):
    return match_rows.team_rows(derived.matches(spark, sf_dir)).select("match_id", "venue", "points")


@query(
    "prj_long_form",
    with_ctes(
        MATCHES,
        LONG,
        select="""
SELECT match_id, venue, team, opponent, gs, gc, gd, side_result, points, shots_for, shots_against, sot_for, sot_against,
  corners_for, corners_against, cards_for, cards_against FROM long_form""",
    ),
)
def prj_long_form(spark, sf_dir):
    return match_rows.team_rows(derived.matches(spark, sf_dir)).drop("match_seq", "match_date", "competition")


@query(
    "prj_evenness",
    with_ctes(
        MATCHES,
        """
rated AS (
  SELECT match_id, 1400 + (match_id * 7) % 311 AS he, 1400 + (match_id * 11) % 293 AS ae,
    0.5 + (match_id * 11) % 23 / 10.0 AS eh, 0.4 + (match_id * 7) % 19 / 10.0 AS ea,
    home_score / 3.0 AS hf, away_score / 3.0 AS af, home_score / 7.0 AS hp, away_score / 7.0 AS ap FROM matches)""",
        select="""
SELECT match_id, round(CAST(he - ae AS DOUBLE), 6) AS elo_diff, round(CAST(abs(he - ae) AS DOUBLE), 6) AS abs_elo_diff,
  round(CAST(abs(eh - ea) AS DOUBLE), 6) AS abs_dc_exp_goals_diff, round(CAST(abs(hf - af) AS DOUBLE), 6) AS abs_form_diff,
  round(CAST(abs(hp - ap) AS DOUBLE), 6) AS abs_ppf_10_diff FROM rated""",
    ),
)
def prj_evenness(spark, sf_dir):
    m = derived.expected_goals(derived.matches(spark, sf_dir))
    m = m.select(
        "match_id",
        (1400 + (_k() * 7) % 311).cast("double").alias("home_elo"),
        (1400 + (_k() * 11) % 293).cast("double").alias("away_elo"),
        F.col("exp_home").alias("dc_home_exp_goals"),
        F.col("exp_away").alias("dc_away_exp_goals"),
        (F.col("home_score") / 3.0).alias("home_overall_form"),
        (F.col("away_score") / 3.0).alias("away_overall_form"),
        (F.col("home_score") / 7.0).alias("home_ppf_10"),
        (F.col("away_score") / 7.0).alias("away_ppf_10"),
    )
    e = match_rows.evenness(m)
    cols = ["elo_diff", "abs_elo_diff", "abs_dc_exp_goals_diff", "abs_form_diff", "abs_ppf_10_diff"]
    return _rounded(e, ["match_id"], {c: F.col(c) for c in cols})


_VALUES = """
valued AS (
  SELECT match_id, CASE WHEN match_id % 5 = 0 THEN NULL WHEN match_id % 7 = 0 THEN 0.0 ELSE (match_id * 7919) % 900000000 END::DOUBLE AS h,
    CASE WHEN match_id % 9 = 0 THEN NULL ELSE (match_id * 104729) % 700000000 + 1 END::DOUBLE AS a FROM fixtures)"""


@query(
    "prj_squad_block",
    with_ctes(
        MATCHES,
        _VALUES,
        "flagged AS (SELECT *, coalesce(h <> 0 AND a <> 0, false) AS ok, ln(1 + coalesce(h, 0) / 1e6) AS lh, ln(1 + coalesce(a, 0) / 1e6) AS la FROM valued)",
        select="""
SELECT match_id, round(CASE WHEN ok THEN lh ELSE 0.0 END, 6) AS home_squad_value, round(CASE WHEN ok THEN la ELSE 0.0 END, 6) AS away_squad_value,
  round(CASE WHEN ok THEN lh - la ELSE 0.0 END, 6) AS squad_value_diff, round(CASE WHEN ok THEN abs(lh - la) ELSE 0.0 END, 6) AS abs_squad_value_diff,
  CASE WHEN ok THEN 1.0 ELSE 0.0 END::DOUBLE AS has_squad_value FROM flagged""",
    ),
)
def prj_squad_block(spark, sf_dir):
    h = F.when(_k() % 5 == 0, None).when(_k() % 7 == 0, 0.0).otherwise(((_k() * 7919) % 900000000).cast("double"))
    a = F.when(_k() % 9 == 0, None).otherwise(((_k() * 104729) % 700000000 + 1).cast("double"))
    return _rounded(derived.fixtures(spark, sf_dir), ["match_id"], blocks.squad_block(h, a))


@query(
    "prj_draw_signal",
    with_ctes(
        MATCHES,
        f"sig AS (SELECT match_id, {probs()}, 0.5 + (match_id * 11) % 23 / 10.0 AS eh, 0.4 + (match_id * 7) % 19 / 10.0 AS ea, match_id % 41 AS ed, home_score / 3.0 - away_score / 3.0 AS fd FROM matches)",
        select="""
SELECT match_id, round(-(p_home * ln(p_home) + p_draw * ln(p_draw) + p_away * ln(p_away)), 6) AS dc_entropy,
  round(CAST(eh + ea AS DOUBLE), 6) AS dc_total_exp_goals, round(CAST((1.0 / (1.0 + abs(ed))) * (1.0 / (1.0 + abs(fd))) AS DOUBLE), 6) AS tightness FROM sig""",
    ),
)
def prj_draw_signal(spark, sf_dir):
    m = derived.expected_goals(derived.probabilities(derived.matches(spark, sf_dir)))
    gap = F.col("home_score") / 3.0 - F.col("away_score") / 3.0
    c = F.col
    return _rounded(
        m, ["match_id"], blocks.draw_signal(c("p_home"), c("p_draw"), c("p_away"), c("exp_home"), c("exp_away"), _k() % 41, gap)
    )


_SIDES = """
sides AS (
  SELECT match_id, CASE WHEN match_id % 5 <> 0 THEN CAST(1300 + (match_id * 13) % 700 AS DOUBLE) END AS h,
    CASE WHEN match_id % 7 <> 0 THEN CAST(1300 + (match_id * 17) % 700 AS DOUBLE) END AS a,
    match_id % 9 AS hg, match_id % 6 AS ag FROM fixtures)"""


def _sides(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir)
    h = F.when(_k() % 5 != 0, (1300 + (_k() * 13) % 700).cast("double"))
    a = F.when(_k() % 7 != 0, (1300 + (_k() * 17) % 700).cast("double"))
    return f.select("match_id", h.alias("h"), a.alias("a"), (_k() % 9).alias("hg"), (_k() % 6).alias("ag"))


def _gated(pairs: dict[str, str], flag: str, ok: str) -> str:
    cols = [f"round(CAST(CASE WHEN {ok} THEN {e} ELSE 0.0 END AS DOUBLE), 6) AS {n}" for n, e in pairs.items()]
    return "SELECT match_id, " + ", ".join(cols) + f", CASE WHEN {ok} THEN 1.0 ELSE 0.0 END::DOUBLE AS {flag}"


_BOTH = "h IS NOT NULL AND a IS NOT NULL"


@query(
    "prj_clubrating_block",
    with_ctes(
        MATCHES,
        _SIDES,
        select=_gated({"home_clubelo": "h", "away_clubelo": "a", "clubelo_diff": "h - a"}, "has_clubelo", _BOTH)
        + f", round(CASE WHEN {_BOTH} THEN 1.0 / (1.0 + pow(10, -(h - a) / 400.0)) ELSE 0.5 END, 6) AS clubelo_expected FROM sides",
    ),
)
def prj_clubrating_block(spark, sf_dir):
    return _rounded(_sides(spark, sf_dir), ["match_id"], blocks.rating_block(F.col("h"), F.col("a")))


_PI_OK = _BOTH + " AND hg >= 4 AND ag >= 4"
_PI_GAP = "greatest(least((CASE WHEN h >= 1650 THEN 1.0 ELSE -1.0 END) * (pow(10, abs((h - 1650) / 250.0) / 3.0) - 1) - (CASE WHEN a >= 1650 THEN 1.0 ELSE -1.0 END) * (pow(10, abs((a - 1650) / 250.0) / 3.0) - 1), 8.0), -8.0)"


@query(
    "prj_pi_block",
    with_ctes(
        MATCHES,
        _SIDES,
        select=_gated(
            {
                "home_pi": "(h - 1650) / 250.0",
                "away_pi": "(a - 1650) / 250.0",
                "pi_diff": "(h - 1650) / 250.0 - (a - 1650) / 250.0",
                "pi_expected_gd": _PI_GAP,
            },
            "has_pi",
            _PI_OK,
        )
        + " FROM sides",
    ),
)
def prj_pi_block(spark, sf_dir):
    h, a = (F.col("h") - 1650) / 250.0, (F.col("a") - 1650) / 250.0
    return _rounded(_sides(spark, sf_dir), ["match_id"], blocks.pi_block(h, a, F.col("hg"), F.col("ag")))


@query(
    "prj_player_block",
    with_ctes(
        MATCHES,
        _SIDES,
        select=_gated(
            {
                "home_ga_per_game": "h / 1000",
                "away_ga_per_game": "a / 1000",
                "ga_per_game_diff": "h / 1000 - a / 1000",
                "home_cards_per_game": "hg / 3.0",
                "away_cards_per_game": "ag / 3.0",
            },
            "has_player_stats",
            _BOTH,
        )
        + " FROM sides",
    ),
)
def prj_player_block(spark, sf_dir):
    c = F.col
    return _rounded(
        _sides(spark, sf_dir), ["match_id"], blocks.player_block(c("h") / 1000, c("hg") / 3.0, c("a") / 1000, c("ag") / 3.0)
    )


@query(
    "prj_availability_block",
    with_ctes(
        MATCHES,
        _SIDES,
        select=_gated(
            {
                "home_value_out_frac": "h / 4000",
                "away_value_out_frac": "a / 4000",
                "availability_edge": "a / 4000 - h / 4000",
                "home_key_absences": "hg",
                "away_key_absences": "ag",
            },
            "has_player_data",
            _BOTH,
        )
        + " FROM sides",
    ),
)
def prj_availability_block(spark, sf_dir):
    c = F.col
    return _rounded(
        _sides(spark, sf_dir),
        ["match_id"],
        blocks.availability_block(c("h") / 4000, c("hg").cast("double"), c("a") / 4000, c("ag").cast("double")),
    )


@query(
    "prj_style_block",
    with_ctes(
        MATCHES,
        _SIDES,
        select=_gated(
            {
                "home_directness": "h / 2000",
                "away_directness": "a / 2000",
                "home_pressing": "hg / 10.0",
                "away_pressing": "ag / 10.0",
                "home_tempo": "0.0",
                "away_tempo": "0.0",
                "home_possession": "0.5",
                "away_possession": "0.5",
            },
            "has_style",
            _BOTH,
        )
        + " FROM sides",
    ),
)
def prj_style_block(spark, sf_dir):
    def profile(v, g):
        axes = F.create_map(
            F.lit("directness"), v / 2000, F.lit("pressing"), g / 10.0, F.lit("possession"), F.lit(0.5)
        )
        return F.when(v.isNotNull(), axes)

    s = _sides(spark, sf_dir)
    return _rounded(
        s, ["match_id"], blocks.style_block(profile(F.col("h"), F.col("hg")), profile(F.col("a"), F.col("ag")))
    )


@query(
    "prj_availability_nudge",
    with_ctes(
        MATCHES,
        f"""
priced AS (
  SELECT match_id, {probs()}, CASE WHEN match_id % 6 <> 0 THEN (match_id % 50) / 100.0 END AS ho, (match_id % 37) / 60.0 AS ao FROM fixtures),
shifted AS (SELECT *, coalesce(greatest(least(0.5 * (ao - ho), 0.15), -0.15), 0) AS s FROM priced)""",
        select="""
SELECT match_id, round(p_home + CASE WHEN s > 0 THEN least(s, p_away) ELSE 0 END - CASE WHEN s < 0 THEN least(-s, p_home) ELSE 0 END, 6) AS p_home,
  round(p_draw, 6) AS p_draw,
  round(p_away - CASE WHEN s > 0 THEN least(s, p_away) ELSE 0 END + CASE WHEN s < 0 THEN least(-s, p_home) ELSE 0 END, 6) AS p_away
FROM shifted""",
    ),
)
def prj_availability_nudge(spark, sf_dir):
    f = derived.probabilities(derived.fixtures(spark, sf_dir))
    ho, ao = F.when(_k() % 6 != 0, (_k() % 50) / 100.0), (_k() % 37) / 60.0
    return _rounded(f, ["match_id"], blocks.availability_nudge(F.col("p_home"), F.col("p_draw"), F.col("p_away"), ho, ao))


@query(
    "prj_tier_conf",
    with_ctes(
        MATCHES,
        f"priced AS (SELECT match_id, {probs()}, 1400 + (match_id * 7) % 311 AS elo FROM fixtures)",
        select="""
SELECT match_id, CASE WHEN elo >= 1650 THEN 'Elite' WHEN elo >= 1560 THEN 'Strong' WHEN elo >= 1470 THEN 'Mid-table' ELSE 'Underdog' END AS tier,
  CASE WHEN greatest(p_home, p_draw, p_away) >= 0.55 THEN 'High' WHEN greatest(p_home, p_draw, p_away) >= 0.42 THEN 'Moderate' ELSE 'Low' END AS confidence
FROM priced""",
    ),
)
def prj_tier_conf(spark, sf_dir):
    f = derived.probabilities(derived.fixtures(spark, sf_dir))
    top = F.greatest("p_home", "p_draw", "p_away")
    return f.select(
        "match_id", blocks.elo_tier(1400 + (_k() * 7) % 311).alias("tier"), blocks.confidence_label(top).alias("confidence")
    )


@query(
    "prj_devig",
    with_ctes(
        MATCHES,
        f"""
priced AS (SELECT match_id, {probs()} FROM fixtures),
odds AS (SELECT match_id, CASE WHEN match_id % 17 = 0 THEN 0.0 ELSE floor(95.0::DOUBLE / p_home) / 100.0 END AS oh, floor(95.0::DOUBLE / p_draw) / 100.0 AS od, floor(95.0::DOUBLE / p_away) / 100.0 AS oa FROM priced)""",
        select="""
SELECT match_id, round(1 / oh / (1 / oh + 1 / od + 1 / oa), 6) AS p_home, round(1 / od / (1 / oh + 1 / od + 1 / oa), 6) AS p_draw,
  round(1 / oa / (1 / oh + 1 / od + 1 / oa), 6) AS p_away FROM odds WHERE oh <> 0""",
    ),
)
def prj_devig(spark, sf_dir):
    f = derived.probabilities(derived.fixtures(spark, sf_dir))
    o = f.select(
        "match_id",
        F.when(_k() % 17 == 0, 0.0).otherwise((F.floor(95.0 / F.col("p_home")) / 100.0)).alias("oh"),
        (F.floor(95.0 / F.col("p_draw")) / 100.0).alias("od"),
        (F.floor(95.0 / F.col("p_away")) / 100.0).alias("oa"),
    )
    out = _rounded(o, ["match_id"], blocks.devig(F.col("oh"), F.col("od"), F.col("oa")))
    return out.dropna(subset=["p_home"])


@query(
    "prj_training_filter",
    with_ctes(
        MATCHES,
        select="""
SELECT match_id, competition, result FROM matches
WHERE competition NOT IN ('ELC') AND home_shots IS NOT NULL AND away_corners IS NOT NULL
  AND (home_score <> 0 OR away_score <> 0 OR home_shots <> 0)""",
    ),
)
def prj_training_filter(spark, sf_dir):
    m = derived.matches(spark, sf_dir)
    kept = match_rows.training_rows(m, ["home_score", "away_score", "home_shots"], ["away_corners"], warmup=["ELC"])
    return kept.select("match_id", "competition", "result")


@query(
    "fn_poisson_grid",
    with_ctes(
        MATCHES,
        """
lam AS (SELECT match_id, CAST(0.5 + (match_id * 11) % 23 / 10.0 AS DOUBLE) AS lh, CAST(0.4 + (match_id * 7) % 19 / 10.0 AS DOUBLE) AS la FROM fixtures),
cells AS (
  SELECT match_id, i, j, exp(-lh) * pow(lh, i) / factorial(CAST(i AS INTEGER)) * exp(-la) * pow(la, j) / factorial(CAST(j AS INTEGER))
    * CASE WHEN i = 0 AND j = 0 THEN 1 + lh * la * 0.1 WHEN i = 0 AND j = 1 THEN greatest(1 - lh * 0.1, 0)
        WHEN i = 1 AND j = 0 THEN greatest(1 - la * 0.1, 0) WHEN i = 1 AND j = 1 THEN 1.1 ELSE 1 END AS p
  FROM lam, range(9) a(i), range(9) b(j))""",
        select="""
SELECT match_id, round(sum(p) FILTER (WHERE i > j) / sum(p), 6) AS p_home, round(sum(p) FILTER (WHERE i = j) / sum(p), 6) AS p_draw,
  round(sum(p) FILTER (WHERE i < j) / sum(p), 6) AS p_away FROM cells GROUP BY match_id""",
    ),
)
def fn_poisson_grid(spark, sf_dir):
    f = derived.expected_goals(derived.fixtures(spark, sf_dir))
    ph, pd_, pa = goals.outcome_probabilities(F.col("exp_home"), F.col("exp_away"))
    return _rounded(f, ["match_id"], {"p_home": ph, "p_draw": pd_, "p_away": pa})


@query(
    "fn_month_keys",
    with_ctes(
        MATCHES,
        """
spans AS (SELECT competition, min(match_date) AS lo, max(match_date) AS hi FROM fixtures GROUP BY 1),
months AS (SELECT competition, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM spans)""",
        select="SELECT competition, strftime(m, '%Y-%m') AS month, strftime(m + INTERVAL 1 MONTH, '%Y-%m') AS next_month FROM months",
    ),
)
def fn_month_keys(spark, sf_dir):
    spans = derived.fixtures(spark, sf_dir).groupBy("competition").agg(F.min("match_date").alias("lo"), F.max("match_date").alias("hi"))
    months = spans.select("competition", F.explode(dates.month_range(F.col("lo"), F.col("hi"))).alias("m"))
    return months.select("competition", dates.month_key(F.col("m")).alias("month"), dates.next_month_key(F.col("m")).alias("next_month"))
