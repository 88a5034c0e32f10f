"""Queries over metrics, sweeps, splits and the forecast log."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from terrace.operators import blocks, forecast_log, match_rows, metrics, splits, sweeps, tables
from terrace.plans.catalogue import query
from terrace.plans.sql import FORECASTS, LONG, MATCHES, OUTCOMES, with_ctes
from terrace.sources import derived

_ARG = "CASE WHEN p_away >= p_draw AND p_away >= p_home THEN -1 WHEN p_draw >= p_home THEN 0 ELSE 1 END"
_RPS = "(pow(p_away - CASE WHEN y = -1 THEN 1 ELSE 0 END, 2) + pow(p_away + p_draw - CASE WHEN y <= 0 THEN 1 ELSE 0 END, 2)) / 2"
_LL = "-ln(least(greatest(CASE y WHEN -1 THEN p_away WHEN 0 THEN p_draw ELSE p_home END, 1e-15), 1.0))"
_BR = "pow(p_away - CASE WHEN y = -1 THEN 1 ELSE 0 END, 2) + pow(p_draw - CASE WHEN y = 0 THEN 1 ELSE 0 END, 2) + pow(p_home - CASE WHEN y = 1 THEN 1 ELSE 0 END, 2)"
_ACC = "avg(CASE WHEN pred = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _f1(pred: str = "pred", y: str = "y", w: str = "1") -> str:
    parts = []
    for c in (-1, 0, 1):
        tp = f"sum(CASE WHEN {pred} = {c} AND {y} = {c} THEN {w} ELSE 0 END)"
        size = f"(sum(CASE WHEN {pred} = {c} THEN {w} ELSE 0 END) + sum(CASE WHEN {y} = {c} THEN {w} ELSE 0 END))"
        parts.append(f"coalesce(2.0::DOUBLE * {tp} / nullif({size}, 0), 0.0)")
    return "(" + " + ".join(parts) + ") / 3.0"


_RECALL = "sum(CASE WHEN pred = 0 AND y = 0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END), 0)"
_SCORED = f"scored AS (SELECT *, {_ARG} AS pred, {_RPS} AS rps, {_LL} AS ll, {_BR} AS br FROM outcomes)"


def _outcomes(spark, sf_dir):
    return derived.outcome_rows(spark, sf_dir)


def _y():
    return F.col("y")


@query(
    "agg_class_distribution",
    with_ctes(
        MATCHES,
        "c AS (SELECT result AS y, count(*) AS n FROM matches GROUP BY 1)",
        select="SELECT y, n, round(n / sum(n) OVER (), 6) AS share, y = (SELECT arg_max(y, (n, y)) FROM c) AS majority FROM c",
    ),
)
def agg_class_distribution(spark, sf_dir):
    return metrics.class_distribution(_outcomes(spark, sf_dir).select("y"))


@query(
    "agg_accuracy_f1_recall",
    with_ctes(
        MATCHES, OUTCOMES, _SCORED,
        select=f"SELECT count(*) AS n, round({_ACC}, 6) AS accuracy, round({_f1()}, 6) AS macro_f1, round({_RECALL}, 6) AS draw_recall FROM scored",
    ),
)
def agg_accuracy_f1_recall(spark, sf_dir):
    s = metrics.summary(_outcomes(spark, sf_dir), _y(), metrics.argmax_class(), digits=6)
    return s.select("n", "accuracy", "macro_f1", "draw_recall")


@query(
    "agg_confusion",
    with_ctes(
        MATCHES, OUTCOMES, _SCORED,
        """
cells AS (SELECT y AS actual, count(*) FILTER (WHERE pred = -1) AS pred_away, count(*) FILTER (WHERE pred = 0) AS pred_draw,
  count(*) FILTER (WHERE pred = 1) AS pred_home, count(*) AS support FROM scored GROUP BY 1),
predicted AS (SELECT pred AS actual, count(*) AS pp FROM scored GROUP BY 1),
hits AS (SELECT c.*, coalesce(p.pp, 0) AS pp, CASE actual WHEN -1 THEN pred_away WHEN 0 THEN pred_draw ELSE pred_home END AS tp FROM cells c LEFT JOIN predicted p USING (actual))""",
        select="""
SELECT actual, pred_away, pred_draw, pred_home, support, round(coalesce(tp / nullif(pp, 0), 0.0), 6) AS precision, round(tp / support, 6) AS recall,
  round(2.0::DOUBLE * tp / (pp + support), 6) AS f1 FROM hits""",
    ),
)
def agg_confusion(spark, sf_dir):
    return metrics.confusion(_outcomes(spark, sf_dir), _y(), metrics.argmax_class())


def _mean_query(name: str, columns: dict[str, str], sql: str):
    @query(name, with_ctes(MATCHES, OUTCOMES, _SCORED, select=f"SELECT competition, count(*) AS n, {sql} FROM scored GROUP BY competition"))
    def run(spark, sf_dir):
        s = metrics.summary(_outcomes(spark, sf_dir), _y(), metrics.argmax_class(), ["competition"], digits=6)
        return s.select("competition", "n", *[F.col(src).alias(n) for n, src in columns.items()])

    return run


_mean_query("agg_rps", {"rps": "rps"}, "round(avg(rps), 6) AS rps")
_mean_query("agg_log_loss", {"log_loss": "log_loss"}, "round(avg(ll), 6) AS log_loss")
_mean_query("agg_brier", {"brier": "brier", "brier_sum": "brier_sum"}, "round(avg(br) / 3.0, 6) AS brier, round(avg(br), 6) AS brier_sum")


@query(
    "agg_auc_ovr",
    with_ctes(
        MATCHES, OUTCOMES,
        """
long_p AS (SELECT y, -1 AS cls, p_away AS score FROM outcomes UNION ALL SELECT y, 0, p_draw FROM outcomes UNION ALL SELECT y, 1, p_home FROM outcomes),
g AS (SELECT cls, score, count(*) FILTER (WHERE y = cls) AS pos, count(*) FILTER (WHERE y <> cls) AS neg FROM long_p GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)""",
        select="SELECT cls, round(sum(pos * (below + neg / 2.0))::DOUBLE / (sum(pos) * sum(neg))::DOUBLE, 6) AS auc FROM r GROUP BY cls",
    ),
)
def agg_auc_ovr(spark, sf_dir):
    return metrics.auc_ovr(_outcomes(spark, sf_dir))


_LEAGUE_KEY = "competition || '-' || CASE WHEN year(match_date) < 2001 THEN strftime(match_date, '%Y') ELSE strftime(match_date, '%Y-%m-%d') END"


@query(
    "agg_league_breakdown",
    with_ctes(
        MATCHES, OUTCOMES, _SCORED,
        f"""
keyed AS (SELECT *, {_LEAGUE_KEY} AS lg FROM scored),
sized AS (SELECT *, count(*) OVER (PARTITION BY lg) AS size FROM keyed),
pool AS (SELECT count(DISTINCT lg) AS k FROM sized WHERE size < 100)""",
        select=f"""
SELECT CASE WHEN size >= 100 THEN lg ELSE '(pooled: ' || (SELECT k FROM pool) || ' leagues under 100 matches)' END AS league, count(*) AS matches,
  round({_ACC}, 4) AS accuracy, round({_f1()}, 4) AS macro_f1, round({_RECALL}, 4) AS draw_recall,
  round(avg(CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS home_win_rate, size < 100 AS pooled
FROM sized GROUP BY 1, size < 100""",
    ),
)
def agg_league_breakdown(spark, sf_dir):
    span = F.when(F.year("match_date") < 2001, F.date_format("match_date", "yyyy")).otherwise(F.date_format("match_date", "yyyy-MM-dd"))
    df = _outcomes(spark, sf_dir).withColumn("league", F.concat_ws("-", "competition", span))
    return metrics.league_breakdown(df, "league", _y(), metrics.argmax_class())


@query(
    "agg_reliability",
    with_ctes(
        MATCHES, OUTCOMES, _SCORED,
        "conf AS (SELECT *, greatest(p_home, p_draw, p_away) AS c FROM scored),"
        "binned AS (SELECT *, (SELECT count(*) FROM range(1, 10) t(i) WHERE c >= i * 0.1::DOUBLE) AS b FROM conf)",
        select=f"""
SELECT round(b * 0.1::DOUBLE, 2) AS bin_low, round((b + 1) * 0.1::DOUBLE, 2) AS bin_high, count(*) AS n, round(avg(c), 4) AS mean_confidence,
  round({_ACC}, 4) AS observed_accuracy FROM binned GROUP BY b""",
    ),
)
def agg_reliability(spark, sf_dir):
    return metrics.reliability(_outcomes(spark, sf_dir), _y())


_PICK = "CASE WHEN p_home >= p_draw AND p_home >= p_away THEN 'Home Win' WHEN p_draw >= p_away THEN 'Draw' ELSE 'Away Win' END"
_TRACK = f"""
track AS (
  SELECT *, {_PICK} AS pick, greatest(p_home, p_draw, p_away) AS conf, CASE actual WHEN 'Home Win' THEN 1 WHEN 'Draw' THEN 0 WHEN 'Away Win' THEN -1 END AS y
  FROM forecasts),
done AS (SELECT *, {_RPS} AS rps, {_LL} AS ll, {_BR} AS br FROM track WHERE status = 'settled' AND actual IS NOT NULL)"""


@query(
    "agg_confidence_bands",
    with_ctes(
        MATCHES, FORECASTS, _TRACK,
        select="""
SELECT CASE WHEN conf < 0.4 THEN '0–40%' WHEN conf < 0.5 THEN '40–50%' WHEN conf < 0.6 THEN '50–60%' WHEN conf < 0.7 THEN '60–70%' WHEN conf < 0.8 THEN '70–80%' ELSE '80–100%' END AS band,
  round(avg(conf) * 100, 1) AS predicted, round(avg(CASE WHEN pick = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 1) AS actual, count(*) AS n
FROM done GROUP BY 1""",
    ),
)
def agg_confidence_bands(spark, sf_dir):
    return metrics.confidence_bands(derived.forecast_log(spark, sf_dir))


@query(
    "agg_track_score",
    with_ctes(
        MATCHES, FORECASTS, _TRACK,
        select="""
SELECT (SELECT count(*) FROM track) AS n_logged, (SELECT count(*) FROM track WHERE status = 'pending') AS n_pending, count(*) AS n_settled,
  round(avg(CASE WHEN pick = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS accuracy, round(avg(CASE WHEN actual = 'Home Win' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS baseline_acc,
  round(avg(rps), 4) AS rps, round(avg(ll), 4) AS log_loss, round(avg(br), 4) AS brier FROM done""",
    ),
)
def agg_track_score(spark, sf_dir):
    return metrics.track_score(derived.forecast_log(spark, sf_dir))


@query(
    "agg_track_league",
    with_ctes(
        MATCHES, FORECASTS, _TRACK,
        select="SELECT competition, count(*) AS n, round(avg(CASE WHEN pick = actual THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 3) AS accuracy, round(avg(rps), 4) AS rps FROM done GROUP BY 1",
    ),
)
def agg_track_league(spark, sf_dir):
    return metrics.track_by_league(derived.forecast_log(spark, sf_dir))


@query(
    "agg_threshold_sweep",
    with_ctes(
        MATCHES, OUTCOMES,
        f"""
halved AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY match_date, match_seq) <= (SELECT count(*) // 2 FROM outcomes) THEN 'tune' ELSE 'test' END AS half, {_ARG} AS best FROM outcomes),
grid AS (SELECT CASE WHEN i < 0 THEN NULL ELSE round(0.20 + 0.01 * i, 2)::DOUBLE END AS threshold FROM range(-1, 31) t(i)),
applied AS (
  SELECT half, threshold, y, CASE WHEN threshold IS NULL THEN best WHEN p_draw >= threshold THEN 0 WHEN p_away >= p_home THEN -1 ELSE 1 END AS pred FROM halved, grid),
rows_ AS (SELECT half, threshold, round({_ACC}, 4) AS accuracy, round({_f1()}, 4) AS macro_f1, round({_RECALL}, 4) AS draw_recall FROM applied GROUP BY 1, 2),
judged AS (
  SELECT r.*, coalesce(r.threshold IS NOT NULL AND r.accuracy >= b.accuracy - 0.04 AND r.macro_f1 > b.macro_f1, false) AS viable
  FROM rows_ r JOIN rows_ b ON b.half = r.half AND b.threshold IS NULL),
pick AS (SELECT threshold FROM judged WHERE half = 'tune' AND viable ORDER BY macro_f1 DESC, threshold LIMIT 1)""",
        select="""
SELECT half, threshold, accuracy, macro_f1, draw_recall, coalesce(threshold = (SELECT threshold FROM pick), false) AS chosen,
  coalesce(threshold = (SELECT threshold FROM pick), false) AND viable AND half = 'test' AS holds_up FROM judged""",
    ),
)
def agg_threshold_sweep(spark, sf_dir):
    return sweeps.draw_threshold_sweep(sweeps.with_half(_outcomes(spark, sf_dir), ["match_date", "match_seq"]))


_BLENDED = """
weights AS (SELECT i / 10.0::DOUBLE AS weight FROM range(6) t(i)),
mixed AS (
  SELECT weight, y, (1 - weight) * p_away + weight * q_away AS p_away, (1 - weight) * p_draw + weight * q_draw AS p_draw, (1 - weight) * p_home + weight * q_home AS p_home
  FROM outcomes, weights)"""


@query(
    "agg_blend_grid",
    with_ctes(
        MATCHES, OUTCOMES, _BLENDED,
        f"judged AS (SELECT *, {_ARG} AS pred, {_RPS} AS rps, {_LL} AS ll, {_BR} AS br FROM mixed)",
        select=f"SELECT weight, round(avg(rps), 6) AS rps, round(avg(ll), 6) AS log_loss, round(avg(br) / 3.0, 6) AS brier, round({_f1()}, 6) AS macro_f1 FROM judged GROUP BY weight",
    ),
)
def agg_blend_grid(spark, sf_dir):
    return sweeps.blend_grid(_outcomes(spark, sf_dir), metrics.PROBS, ("q_away", "q_draw", "q_home"))


@query(
    "ml_dc_blend",
    with_ctes(
        MATCHES, OUTCOMES,
        select="""
SELECT match_id, round(0.7 * p_away + 0.3 * q_away, 10) AS p_away, round(0.7 * p_draw + 0.3 * q_draw, 10) AS p_draw, round(0.7 * p_home + 0.3 * q_home, 10) AS p_home FROM outcomes""",
    ),
)
def ml_dc_blend(spark, sf_dir):
    probs = sweeps.blend(0.3, metrics.PROBS, ("q_away", "q_draw", "q_home"))
    return _outcomes(spark, sf_dir).select("match_id", *[F.round(p, 10).alias(n) for n, p in zip(metrics.PROBS, probs)])


@query(
    "ml_draw_rule",
    with_ctes(
        MATCHES, OUTCOMES, _SCORED,
        select="""
SELECT match_id, CASE WHEN p_draw >= 0.29 THEN 0 WHEN p_away >= p_home THEN -1 ELSE 1 END AS prediction, pred AS argmax_prediction,
  (CASE WHEN p_draw >= 0.29 THEN 0 WHEN p_away >= p_home THEN -1 ELSE 1 END) <> pred AS threshold_applied FROM scored""",
    ),
)
def ml_draw_rule(spark, sf_dir):
    ruled, best = metrics.draw_rule(0.29), metrics.argmax_class()
    return _outcomes(spark, sf_dir).select(
        "match_id", ruled.alias("prediction"), best.alias("argmax_prediction"), (ruled != best).alias("threshold_applied")
    )


@query(
    "agg_market_benchmark",
    with_ctes(
        MATCHES, OUTCOMES,
        f"""
odds AS (SELECT y, CASE WHEN match_id % 17 = 0 THEN 0.0 ELSE floor(95.0::DOUBLE / p_home) / 100.0 END AS oh, floor(95.0::DOUBLE / p_draw) / 100.0 AS od, floor(95.0::DOUBLE / p_away) / 100.0 AS oa FROM outcomes),
fair AS (SELECT y, 1 / oh / (1 / oh + 1 / od + 1 / oa) AS p_home, 1 / od / (1 / oh + 1 / od + 1 / oa) AS p_draw, 1 / oa / (1 / oh + 1 / od + 1 / oa) AS p_away FROM odds WHERE oh <> 0),
judged AS (SELECT *, {_ARG} AS pred, {_RPS} AS rps, {_LL} AS ll FROM fair)""",
        select=f"SELECT count(*) AS n, round(avg(rps), 6) AS rps, round(avg(ll), 6) AS log_loss, round({_ACC}, 6) AS accuracy FROM judged",
    ),
)
def agg_market_benchmark(spark, sf_dir):
    odd = lambda c: F.floor(95.0 / F.col(c)) / 100.0
    o = _outcomes(spark, sf_dir).select(
        "y", F.when(F.col("match_id") % 17 == 0, 0.0).otherwise(odd("p_home")).alias("oh"), odd("p_draw").alias("od"), odd("p_away").alias("oa")
    )
    fair = o.select("y", *[c.alias(n) for n, c in blocks.devig(F.col("oh"), F.col("od"), F.col("oa")).items()]).dropna(subset=["p_home"])
    s = metrics.summary(fair, _y(), metrics.argmax_class(), digits=6)
    return s.select("n", "rps", "log_loss", "accuracy")


@query(
    "agg_goal_lines",
    with_ctes(
        MATCHES, LONG,
        select="""
SELECT team, count(*) AS matches, round(avg(CASE WHEN gs > 0 AND gc > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS btts_pct,
  round(avg(CASE WHEN gs + gc > 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS over25_pct FROM long_form GROUP BY team""",
    ),
)
def agg_goal_lines(spark, sf_dir):
    r = tables.goal_line_rates(match_rows.team_rows(derived.matches(spark, sf_dir)), ["team"])
    return r.select("team", "matches", F.round("btts_pct", 6).alias("btts_pct"), F.round("over25_pct", 6).alias("over25_pct"))


@query(
    "agg_league_table",
    with_ctes(
        MATCHES, LONG,
        """
t AS (SELECT competition, year(match_date) AS season, team, CAST(sum(points) AS INTEGER) AS points, CAST(sum(gd) AS INTEGER) AS gd, CAST(sum(gs) AS INTEGER) AS gf, CAST(count(*) AS INTEGER) AS played
  FROM long_form GROUP BY 1, 2, 3)""",
        select="SELECT *, CAST(row_number() OVER (PARTITION BY competition, season ORDER BY points DESC, gd DESC, gf DESC, team) AS INTEGER) AS position FROM t",
    ),
)
def agg_league_table(spark, sf_dir):
    rows = match_rows.team_rows(derived.matches(spark, sf_dir)).withColumn("season", F.year("match_date"))
    return tables.league_table(rows, ["competition", "season"])


# --- splits and weights -----------------------------------------------------

ORDER = ["match_date", "match_seq"]


@query(
    "win_recency_weight",
    with_ctes(
        MATCHES,
        "d AS (SELECT match_id, CASE WHEN match_id % 97 <> 0 THEN match_date END AS dt FROM fixtures)",
        select="SELECT match_id, round(pow(0.5, greatest((SELECT max(dt) FROM d) - coalesce(dt, (SELECT min(dt) FROM d)), 0) / 540.0), 6) AS recency_weight FROM d",
    ),
)
def win_recency_weight(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir).select("match_id", F.when(F.col("match_id") % 97 != 0, F.col("match_date")).alias("dt"))
    return splits.recency_weight(f, "dt", 540).select("match_id", F.round("recency_weight", 6).alias("recency_weight"))


@query(
    "win_class_weights",
    with_ctes(
        MATCHES,
        """
r AS (SELECT match_id, result AS y, pow(0.5, greatest((SELECT max(match_date) FROM matches) - match_date, 0) / 540.0) AS w FROM matches)""",
        select="""
SELECT match_id, round(count(*) OVER () / (SELECT count(DISTINCT y) FROM r)::DOUBLE / count(*) OVER (PARTITION BY y), 6) AS balanced,
  round(w * (count(*) OVER () / (SELECT count(DISTINCT y) FROM r)::DOUBLE) / sum(w) OVER (PARTITION BY y), 6) AS sample_weight FROM r""",
    ),
)
def win_class_weights(spark, sf_dir):
    m = splits.recency_weight(derived.matches(spark, sf_dir).select("match_id", "match_date", F.col("result").alias("y")), "match_date", 540)
    plain = splits.class_weight(m).withColumnRenamed("sample_weight", "balanced")
    both = splits.class_weight(plain, recency="recency_weight")
    return both.select("match_id", F.round("balanced", 6).alias("balanced"), F.round("sample_weight", 6).alias("sample_weight"))


_NUMBERED = "numbered AS (SELECT match_id, row_number() OVER (ORDER BY match_date, match_seq) - 1 AS rn, count(*) OVER () AS n FROM fixtures)"


@query(
    "win_purged_folds",
    with_ctes(
        MATCHES, _NUMBERED,
        "folds AS (SELECT k, n // 6 * k AS train_end, n // 6 * k + 50 AS lo, least(n // 6 * k + 50 + n // 6, n) AS hi FROM (SELECT DISTINCT n FROM numbered), range(1, 6) t(k))",
        select="""
SELECT match_id, CAST(min(k) FILTER (WHERE rn >= lo AND rn < hi) AS DOUBLE) AS test_fold, CAST(min(k) FILTER (WHERE rn < train_end) AS DOUBLE) AS train_from
FROM numbered, folds GROUP BY match_id""",
    ),
)
def win_purged_folds(spark, sf_dir):
    f = splits.purged_folds(derived.fixtures(spark, sf_dir), ORDER, 5, 50)
    return f.select("match_id", F.col("test_fold").cast("double").alias("test_fold"), F.col("train_from").cast("double").alias("train_from"))


@query(
    "win_holdout_split",
    with_ctes(
        MATCHES, _NUMBERED,
        "sized AS (SELECT *, greatest(n // 5, 1) AS h, greatest(n // 5, 1) - greatest(n // 5, 1) // 2 AS t FROM numbered)",
        select="SELECT match_id, CASE WHEN rn < n - h THEN 'train' WHEN rn < n - t THEN 'calibrate' ELSE 'test' END AS role FROM sized",
    ),
)
def win_holdout_split(spark, sf_dir):
    return splits.holdout_split(derived.fixtures(spark, sf_dir), ORDER).select("match_id", "role")


@query("top_tail_cap", with_ctes(MATCHES, _NUMBERED, select="SELECT match_id FROM numbered WHERE rn >= n - 25000"))
def top_tail_cap(spark, sf_dir):
    return splits.newest_rows(derived.fixtures(spark, sf_dir), ORDER, 25_000).select("match_id")


# --- forecast log -----------------------------------------------------------


@query(
    "join_settle",
    with_ctes(
        MATCHES, FORECASTS,
        """
results AS (SELECT match_id, CASE WHEN match_id % 12 <> 0 THEN home_score END AS h, away_score AS a FROM matches WHERE match_id % 3 = 0),
graded AS (SELECT f.*, r.h, r.a, f.status = 'pending' AND r.h IS NOT NULL AS now FROM forecasts f LEFT JOIN results r USING (match_id))""",
        select="""
SELECT match_id, CASE WHEN now THEN 'settled' ELSE status END AS status,
  CASE WHEN now THEN CASE WHEN h > a THEN 'Home Win' WHEN h < a THEN 'Away Win' ELSE 'Draw' END ELSE actual END AS actual,
  CASE WHEN now THEN h || '-' || a END AS actual_score, CASE WHEN now THEN DATE '2001-08-15' ELSE settled_at END AS settled_at FROM graded""",
    ),
)
def join_settle(spark, sf_dir):
    log = derived.forecast_log(spark, sf_dir).withColumn("actual_score", F.lit(None).cast("string"))
    k = F.col("match_id")
    results = derived.matches(spark, sf_dir).filter(k % 3 == 0).select("match_id", F.when(k % 12 != 0, F.col("home_score")).alias("home_score"), "away_score")
    out = forecast_log.settle(log.drop("home_score", "away_score"), results, date(2001, 8, 15))
    return out.select("match_id", "status", "actual", "actual_score", "settled_at")


_KNOWN = "known AS (SELECT home_team AS team FROM fixtures WHERE match_date < DATE '1995-03-01')"


@query(
    "join_new_fixtures",
    with_ctes(
        MATCHES, _KNOWN,
        select="""
SELECT match_id FROM fixtures WHERE match_date <= DATE '2000-01-01' + 10 AND match_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
  AND home_team IN (SELECT team FROM known) AND away_team IN (SELECT team FROM known)""",
    ),
)
def join_new_fixtures(spark, sf_dir):
    f = derived.fixtures(spark, sf_dir)
    log = derived.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("match_id"))
    known = f.filter("match_date < date'1995-03-01'").select(F.col("home_team").alias("team"))
    return forecast_log.new_fixtures(f, log, known, date(2000, 1, 1), 10).select("match_id")


@query(
    "snk_prediction_log",
    with_ctes(MATCHES, OUTCOMES, select="SELECT match_id, round(p_home, 4) AS p_home FROM outcomes WHERE match_id % 4 <> 0"),
)
def snk_prediction_log(spark, sf_dir):
    """Rows to append when a quarter is already logged and every forecast arrives twice."""
    f = derived.probabilities(derived.fixtures(spark, sf_dir)).select("match_id", F.round("p_home", 4).alias("p_home"))
    log = f.filter("match_id % 4 = 0")
    return forecast_log.append_new(log, f.unionByName(f))


@query(
    "top_recent",
    with_ctes(
        MATCHES, FORECASTS, _TRACK,
        select="SELECT match_id, home_team, away_team, pick, actual, pick = actual AS correct, settled_at FROM done ORDER BY settled_at DESC, match_id DESC LIMIT 20",
    ),
)
def top_recent(spark, sf_dir):
    r = forecast_log.recent(derived.forecast_log(spark, sf_dir))
    pick = metrics.pick_label()
    return r.select("match_id", "home_team", "away_team", pick.alias("pick"), "actual", (pick == F.col("actual")).alias("correct"), "settled_at")


