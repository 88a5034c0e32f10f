"""Point-in-time windows: every frame ends at the previous match of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.scale import KeyedWindow, max_rows_per_group, hot_keys  # noqa: F401

ORDER = ["match_date", "match_seq"]
STAT_PAIRS = ["shots", "sot", "corners", "cards"]


def _mean(col, w):
    return F.coalesce(F.avg(col).over(w), F.lit(0.0))


def team_windows(long: DataFrame, max_rows: int | None = None, ewma_mode: str = "reference") -> DataFrame:
    """All any-venue features of one team row; unused columns are pruned by Catalyst.

    ``ewma_mode='reference'`` weights the oldest match most (the published
    behaviour); ``'recent'`` weights the newest match most.
    """
    k = KeyedWindow(long, ["team"], ORDER, halo=20 if ewma_mode == "reference" else 64, max_rows=max_rows)
    w5, w10, w20 = k.trailing(5), k.trailing(10), k.trailing(20)
    last = k.ordered()
    share = lambda cond, w: _mean(F.when(cond, 1.0).otherwise(0.0), w)
    gs, gc, gd = F.col("gs"), F.col("gc"), F.col("gd")
    cols = {
        "overall_form": _mean("points", w5),
        "overall_goals_scored_avg": _mean("gs", w5),
        "overall_goals_conceded_avg": _mean("gc", w5),
        "gd_10": _mean("gd", w5),
        "ppf_10": _mean("points", w10),
        "ppf_20": _mean("points", w20),
        "cs_rate_5": share(gc == 0, w5),
        "cs_rate_10": share(gc == 0, w10),
        "btts_rate_5": share((gs > 0) & (gc > 0), w5),
        "o25_rate_5": share((gd != 0) & (gs + gc > 2.5), w5),
        "last_date": F.lag("match_date").over(last),
        "_prev_points": F.lag("points").over(last),
    }
    for s in STAT_PAIRS:
        cols[f"{s}_avg"] = _mean(f"{s}_for", w5)
        cols[f"{s}_against_avg"] = _mean(f"{s}_against", w5)
    k.with_columns(cols)
    k.with_running({"prior_matches": ("count", F.lit(1))})
    n = F.col("prior_matches")
    # Terms past the 600th underflow to zero, so the exponent is capped there.
    weight = F.when(n < 600, F.pow(F.lit(V.EWMA_ALPHA), n.cast("double"))).otherwise(0.0)
    broke = F.col("_prev_points").isNull() | (F.col("_prev_points") != F.col("points"))
    specs = {"_run_start": ("max", F.when(broke, n))}
    if ewma_mode == "reference":
        specs["_w"] = ("sum", weight)
        for c in ("points", "gs", "gc"):
            specs[f"_w_{c}"] = ("sum", weight * F.col(c))
    k.with_running(specs)
    if ewma_mode != "reference":
        # Newest-first weights: past the 64th match they are below the precision of doubles.
        recent = {}
        for name, c in (("form", "points"), ("gs", "gs"), ("gc", "gc")):
            vals = F.collect_list(F.col(c).cast("double")).over(k.trailing(64))
            num = F.aggregate(vals, F.lit(0.0), lambda a, x: a * V.EWMA_ALPHA + x)
            recent[f"_e_{name}"] = num / F.aggregate(vals, F.lit(0.0), lambda a, x: a * V.EWMA_ALPHA + 1.0)
        k.with_columns(recent)
    df = k.result()
    out = {
        "season_matches": n + 1,
        "rest_days": F.least(F.coalesce(F.datediff("match_date", "last_date"), F.lit(7)), F.lit(30)),
        "streak": F.when(F.coalesce("_prev_points", F.lit(0)) == 0, 0)
        .when(F.col("_prev_points") == 3, n - F.col("_run_start"))
        .otherwise(F.col("_run_start") - n)
        .cast("int"),
    }
    if ewma_mode == "reference":
        for name, c in (("form", "points"), ("gs", "gs"), ("gc", "gc")):
            out[f"ewma_{name}"] = F.when(n > 0, F.col(f"_w_{c}") / F.col("_w")).otherwise(0.0)
    else:
        for name in ("form", "gs", "gc"):
            out[f"ewma_{name}"] = F.when(n > 0, F.col(f"_e_{name}")).otherwise(0.0)
    return df.withColumns(out).drop("_prev_points", "_run_start", "_w", "_w_points", "_w_gs", "_w_gc", "_e_form", "_e_gs", "_e_gc")


def venue_windows(long: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Last-five and last-ten features at this venue only."""
    k = KeyedWindow(long, ["team", "venue"], ORDER, halo=10, max_rows=max_rows)
    w5, w10 = k.trailing(5), k.trailing(10)
    k.with_columns(
        {
            "form": _mean("points", w5),
            "goals_scored_avg": _mean("gs", w5),
            "goals_conceded_avg": _mean("gc", w5),
            "matches_played": F.count("points").over(w5).cast("int"),
            "gd_5": F.coalesce(F.sum("gd").over(w5), F.lit(0)).cast("int"),
            "venue_ppf_10": _mean("points", w10),
        }
    )
    return k.result()


def pair_windows(matches: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Last five meetings of the unordered pair; wins count for the host of each meeting."""
    df = matches.withColumns({"pair_a": F.least("home_team", "away_team"), "pair_b": F.greatest("home_team", "away_team")})
    k = KeyedWindow(df, ["pair_a", "pair_b"], ORDER, halo=5, max_rows=max_rows)
    w = k.trailing(5)
    hits = lambda r: F.count(F.when(F.col("result") == r, 1)).over(w).cast("int")
    k.with_columns(
        {
            "h2h_matches": F.count("result").over(w).cast("int"),
            "h2h_home_wins": hits(1),
            "h2h_draws": hits(0),
            "h2h_away_wins": hits(-1),
        }
    )
    return k.result()


def league_baseline(matches: DataFrame, min_matches: int = V.BASELINE_MIN_MATCHES) -> DataFrame:
    """Expanding goal means of the competition before each match.

    Competitions are few and large, so the running sums go over daily totals
    first; only the matches of one competition-day share a window.
    """
    by_day = matches.groupBy("competition", "match_date").agg(
        F.count("*").alias("n"), F.sum("home_score").alias("hg"), F.sum("away_score").alias("ag")
    )
    before = Window.partitionBy("competition").orderBy("match_date").rowsBetween(Window.unboundedPreceding, -1)
    day_start = by_day.select(
        "competition", "match_date", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "hg", "ag")]
    )
    k = KeyedWindow(matches, ["competition", "match_date"], ["match_seq"], halo=1)
    k.with_running({"_dn": ("count", F.lit(1)), "_dhg": ("sum", F.col("home_score")), "_dag": ("sum", F.col("away_score"))})
    df = k.result().join(day_start, ["competition", "match_date"])
    n = F.col("_n") + F.col("_dn")
    mean = lambda c, base: F.when(n >= min_matches, (F.col(f"_{c}") + F.col(f"_d{c}")) / n).otherwise(F.lit(base))
    return df.withColumns(
        {
            "league_matches": n,
            "league_base_home_goals": mean("hg", V.BASE_HOME_GOALS),
            "league_base_away_goals": mean("ag", V.BASE_AWAY_GOALS),
        }
    ).drop("_n", "_hg", "_ag", "_dn", "_dhg", "_dag")


def season_progress(home_matches, away_matches):
    """Combined matches so far, this one included, saturating at 40."""
    return F.least((home_matches + away_matches) / 40.0, F.lit(1.0))
