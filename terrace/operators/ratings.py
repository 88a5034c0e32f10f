"""Ordered ratings: Elo, attack/defense and venue-split ratings, strictly pre-match.

Ratings couple both sides of a match, so the unit of order is a connected
component of the team graph.  Each component is folded in date order by a grouped
task that returns only rating columns; every derived probability is computed
afterwards with native columns.  A component larger than the row limit is folded
in bounded time chunks: the state after a chunk (one row per team) is checkpointed
and handed to the next, so no task holds more than the limit and a lost executor
costs one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log10

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions import goals
from terrace.operators import blocks
from terrace.operators.components import team_components
from terrace.operators.windows import league_baseline
from terrace.scale import checkpoint, hot_keys, max_rows_per_group, number_rows, release
from terrace.streaming.replay import delete_folder, work_folder


@dataclass(frozen=True)
class RatingParams:
    """Constants of the three rating systems."""

    elo_k: float = V.ELO_K
    elo_home_adv: float = V.ELO_HOME_ADV
    elo_pull: float = V.ELO_GAP_PULL
    dc_k: float = V.DC_K
    dc_rho: float = V.DC_RHO
    pi_lambda: float = V.PI_LAMBDA
    pi_gamma: float = V.PI_GAMMA


INPUTS = ["match_id", "match_date", "match_seq", "home_team", "away_team", "home_score", "away_score"]
BASES = ["league_base_home_goals", "league_base_away_goals"]
RATED = [
    "home_elo", "away_elo", "home_sos", "away_sos",
    "home_attack", "home_defense", "away_attack", "away_defense",
    "home_pi_rating", "away_pi_rating", "home_pi_games", "away_pi_games",
    "home_elo_post", "away_elo_post",
    "home_dc_attack_post", "home_dc_defense_post", "away_dc_attack_post", "away_dc_defense_post",
    "home_pi_home_post", "home_pi_away_post", "away_pi_home_post", "away_pi_away_post",
]
# The baselines a match was rated with travel along, so nothing downstream computes them again.
EMITTED = RATED + BASES
EMITTED_DDL = ", ".join(f"{c} double" for c in EMITTED)
# One folded match costs about this many plain rows of memory and time.
FOLD_WEIGHT = 8
STATE = ["team", "elo", "attack", "defense", "pi_home", "pi_away", "games", "last_day", "opponents"]
STATE_DDL = (
    "team string, elo double, attack double, defense double, pi_home double, pi_away double, "
    "games double, last_day double, opponents array<string>"
)

# Positions inside one team's state list.
_ELO, _ATT, _DEF, _PIH, _PIA, _GAMES, _DAY, _OPP = range(8)


def _fresh() -> list:
    return [V.ELO_START, V.DC_START, V.DC_START, V.PI_START, V.PI_START, 0, None, ()]


def _goals_of(rating: float) -> float:
    return (1.0 if rating >= 0 else -1.0) * (10.0 ** (abs(rating) / V.PI_C) - 1.0)


def _bounded(x: float, lo: float, hi: float) -> float:
    return lo if x < lo else hi if x > hi else x


def rate_one(state: dict, day: int, home: str, away: str, hs: int, as_: int, bh: float, ba: float, p: RatingParams) -> list:
    """Ratings before one match, then the update; ``state`` maps team -> list."""
    h, a = state.get(home), state.get(away)
    h = state.setdefault(home, _fresh()) if h is None else h
    a = state.setdefault(away, _fresh()) if a is None else a
    sos = [sum(state[o][_ELO] for o in s[_OPP]) / len(s[_OPP]) if s[_OPP] else V.ELO_START for s in (h, a)]
    for s in (h, a):
        if s[_DAY] is not None and day - s[_DAY] > V.ELO_GAP_DAYS:
            s[_ELO] = V.ELO_START + (s[_ELO] - V.ELO_START) * (1 - p.elo_pull)
    before = [h[_ELO], a[_ELO], *sos, h[_ATT], h[_DEF], a[_ATT], a[_DEF], h[_PIH], a[_PIA], float(h[_GAMES]), float(a[_GAMES])]

    exp_h, exp_a = bh * h[_ATT] * a[_DEF], ba * a[_ATT] * h[_DEF]
    up_h, up_a = p.dc_k * ((hs - exp_h) / max(bh, 1e-6)), p.dc_k * ((as_ - exp_a) / max(ba, 1e-6))
    h[_ATT], a[_DEF] = _bounded(h[_ATT] + up_h, V.DC_LOW, V.DC_HIGH), _bounded(a[_DEF] + up_h, V.DC_LOW, V.DC_HIGH)
    a[_ATT], h[_DEF] = _bounded(a[_ATT] + up_a, V.DC_LOW, V.DC_HIGH), _bounded(h[_DEF] + up_a, V.DC_LOW, V.DC_HIGH)

    miss = (hs - as_) - (_goals_of(h[_PIH]) - _goals_of(a[_PIA]))
    move = p.pi_lambda * (V.PI_C * log10(1.0 + abs(miss))) * ((miss > 0) - (miss < 0))
    for s, own, other, d in ((h, _PIH, _PIA, move), (a, _PIA, _PIH, -move)):
        s[own] = _bounded(s[own] + d, -V.PI_CLIP, V.PI_CLIP)
        s[other] = _bounded(s[other] + p.pi_gamma * d, -V.PI_CLIP, V.PI_CLIP)
        s[_GAMES] += 1

    edge = p.elo_home_adv * ((bh / max(ba, 1e-6)) / (V.BASE_HOME_GOALS / V.BASE_AWAY_GOALS))
    expected = 1.0 / (1.0 + 10 ** ((a[_ELO] - (h[_ELO] + edge)) / 400.0))
    margin = abs(hs - as_)
    weight = 1.0 if margin <= 1 else 1.5 if margin == 2 else (11 + margin) / 8.0
    actual = 1.0 if hs > as_ else 0.5 if hs == as_ else 0.0
    delta = p.elo_k * weight * (actual - expected)
    h[_ELO], a[_ELO] = h[_ELO] + delta, a[_ELO] - delta
    for s, opp in ((h, away), (a, home)):
        s[_DAY] = day
        s[_OPP] = (*s[_OPP][-4:], opp)
    return before + [h[_ELO], a[_ELO], h[_ATT], h[_DEF], a[_ATT], a[_DEF], h[_PIH], h[_PIA], a[_PIH], a[_PIA]]


def fold_frame(pdf: pd.DataFrame, state: dict, p: RatingParams) -> pd.DataFrame:
    """Fold one ordered batch of matches; returns match_id and the rating columns."""
    pdf = pdf.sort_values(["match_date", "match_seq"], kind="stable")
    days = (pd.to_datetime(pdf["match_date"]) - pd.Timestamp("1970-01-01")).dt.days
    cols = [days, *[pdf[c] for c in ("home_team", "away_team", "home_score", "away_score", *BASES)]]
    rated = np.empty((len(pdf), len(RATED)))
    for i, vals in enumerate(zip(*[c.tolist() for c in cols])):
        rated[i] = rate_one(state, *vals, p)
    out = pd.DataFrame(rated, columns=RATED)
    out[BASES] = pdf[BASES].to_numpy()
    out.insert(0, "match_id", pdf["match_id"].to_numpy())
    return out


def state_to_frame(state: dict) -> pd.DataFrame:
    rows = [[t, *s[:_GAMES], float(s[_GAMES]), None if s[_DAY] is None else float(s[_DAY]), list(s[_OPP])] for t, s in state.items()]
    return pd.DataFrame(rows, columns=STATE)


def frame_to_state(pdf: pd.DataFrame) -> dict:
    out = {}
    for team, *v in pdf[STATE].itertuples(index=False, name=None):
        out[team] = [*v[:_GAMES], int(v[_GAMES]), None if v[_DAY] != v[_DAY] or v[_DAY] is None else int(v[_DAY]), tuple(v[_OPP])]
    return out


def rating_inputs(matches: DataFrame, comp: DataFrame) -> DataFrame:
    """Fold inputs: matches with their pre-match league baselines and component (of the ``home_team``)."""
    base = league_baseline(matches.select("competition", *INPUTS)).select("competition", *INPUTS, *BASES)
    return base.join(comp, "home_team")


def _crossed(inputs: DataFrame, grid: list[RatingParams]) -> DataFrame:
    return inputs.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])).alias("setting"))


def _fold_once(inputs: DataFrame, grid: list[RatingParams]) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return fold_frame(pdf, {}, grid[int(key[0])]).assign(setting=key[0])

    if len(grid) == 1:
        return inputs.groupBy("component").applyInPandas(lambda pdf: run((0,), pdf), f"match_id long, {EMITTED_DDL}, setting int")
    return _crossed(inputs, grid).groupBy("setting", "component").applyInPandas(run, f"match_id long, {EMITTED_DDL}, setting int")


def _write_chunks(inputs: DataFrame, limit: int, folder: str) -> int:
    """Time chunks of at most ``limit`` matches per component as folders of one table; returns the number of the last."""
    cols = ["component", *INPUTS, *BASES]
    numbered = number_rows(inputs.select(*cols), ["match_date", "match_seq"], "_rn", ["component"])
    numbered.select(*cols, F.floor(F.col("_rn") / limit).alias("_chunk")).write.partitionBy("_chunk").parquet(folder)
    return (inputs.groupBy("component").count().agg(F.max("count")).first()[0] - 1) // limit


def _fold_chunks(inputs: DataFrame, grid: list[RatingParams], limit: int) -> DataFrame:
    """Fold time chunks of at most ``limit`` matches per component, handing state on.

    Chunks are folders of one written table, so each step reads its own rows only and drops them when its
    result is written; all settings of ``grid`` are folded side by side.
    """
    spark = inputs.sparkSession
    kind = inputs.select("component", *INPUTS, *BASES).schema
    folder, rated = work_folder(spark, "rating-chunks"), work_folder(spark, "rated")
    last = _write_chunks(inputs, limit, folder)
    del inputs
    release(spark)  # the inputs and their numbering
    keys = ["setting", "component"]
    state = spark.createDataFrame([], f"setting int, component string, {STATE_DDL}")
    schema = f"setting int, component string, match_id long, {EMITTED_DDL}, {STATE_DDL}"

    def run(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        teams = frame_to_state(held)
        rated = fold_frame(rows, teams, grid[int(key[0])]) if len(rows) else pd.DataFrame(columns=["match_id", *EMITTED])
        both = pd.concat([rated.assign(team=None, opponents=None), state_to_frame(teams)], ignore_index=True)
        both["setting"], both["component"] = key[0], key[1]
        return both[[*keys, "match_id", *EMITTED, *STATE]].astype({"match_id": "Int64"})

    for chunk in range(last + 1):
        part = f"{folder}/_chunk={chunk}"
        rows = _crossed(spark.read.schema(kind).parquet(part), grid)
        rows.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(run, schema).write.parquet(f"{rated}/chunk={chunk}")
        state = spark.read.schema(schema).parquet(f"{rated}/chunk={chunk}").filter(F.col("team").isNotNull()).select(*keys, *STATE)
        delete_folder(spark, part)
    return spark.read.schema(schema).parquet(rated).filter(F.col("match_id").isNotNull()).select("match_id", *EMITTED, "setting")


def rate_matches(matches: DataFrame, params: RatingParams | None = None, max_rows: int | None = None) -> DataFrame:
    """(match_id, pre-match and post-match ratings, baselines used) for every match."""
    return rate_grid(matches, [params or RatingParams()], max_rows).drop("setting")


def rate_grid(matches: DataFrame, grid: list[RatingParams], max_rows: int | None = None) -> DataFrame:
    """The same fold under several constant settings, one task per (setting, component)."""
    comp = team_components(matches).withColumnRenamed("team", "home_team")
    if hot_keys(matches.select("home_team").join(comp, "home_team"), ["component"], max_rows, FOLD_WEIGHT) is None:
        return _fold_once(rating_inputs(matches, comp), grid)
    # matches and inputs are written once each: baselines, numbering and counts all read them
    limit = max_rows or max(max_rows_per_group(matches.sparkSession) // FOLD_WEIGHT, 1)
    return _fold_chunks(checkpoint(rating_inputs(checkpoint(matches.select("competition", *INPUTS)), comp)), grid, limit)


def dixon_coles_columns(df: DataFrame, rho: float | Column = V.DC_RHO) -> DataFrame:
    """Expected goals and outcome probabilities from pre-match attack/defense."""
    c = F.col
    eh, ea = goals.expected_goals(c("home_attack"), c("home_defense"), c("away_attack"), c("away_defense"), c(BASES[0]), c(BASES[1]))
    df = df.withColumns({"dc_home_exp_goals": eh, "dc_away_exp_goals": ea})
    ph, pd_, pa = goals.outcome_probabilities(c("dc_home_exp_goals"), c("dc_away_exp_goals"), rho)
    return df.withColumns({"dc_home_prob": ph, "dc_draw_prob": pd_, "dc_away_prob": pa})


def pi_columns(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(blocks.pi_block(c("home_pi_rating"), c("away_pi_rating"), c("home_pi_games"), c("away_pi_games")))
