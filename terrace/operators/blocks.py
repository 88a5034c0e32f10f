"""Feature blocks that need both sides known, as dictionaries of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions.goals import entropy3, logistic10, rating_to_goals


def _gate(both: Column, cols: dict[str, Column], flag: str, otherwise: float = 0.0) -> dict[str, Column]:
    out = {n: F.when(both, c).otherwise(F.lit(otherwise)) for n, c in cols.items()}
    out[flag] = F.when(both, 1.0).otherwise(0.0)
    return out


def squad_block(home_eur: Column, away_eur: Column) -> dict[str, Column]:
    """log1p of millions; a zero value counts as unknown."""
    both = F.coalesce((home_eur != 0) & (away_eur != 0), F.lit(False))
    log = lambda v: F.when(v > 0, F.log1p(v / 1e6)).otherwise(0.0)
    h, a = log(home_eur.cast("double")), log(away_eur.cast("double"))
    return _gate(
        both,
        {"home_squad_value": h, "away_squad_value": a, "squad_value_diff": h - a, "abs_squad_value_diff": F.abs(h - a)},
        "has_squad_value",
    )


def draw_signal(ph: Column, pd_: Column, pa: Column, eh: Column, ea: Column, elo_diff: Column, form_diff: Column) -> dict[str, Column]:
    return {
        "dc_entropy": entropy3(ph, pd_, pa),
        "dc_total_exp_goals": eh + ea,
        "tightness": (1.0 / (1.0 + F.abs(elo_diff))) * (1.0 / (1.0 + F.abs(form_diff))),
    }


def rating_block(home: Column, away: Column) -> dict[str, Column]:
    both = home.isNotNull() & away.isNotNull()
    out = _gate(both, {"home_clubelo": home, "away_clubelo": away, "clubelo_diff": home - away}, "has_clubelo")
    out["clubelo_expected"] = F.when(both, logistic10(home - away)).otherwise(0.5)
    return out


def pi_block(home: Column, away: Column, home_games: Column, away_games: Column) -> dict[str, Column]:
    both = (
        home.isNotNull()
        & away.isNotNull()
        & (F.coalesce(home_games, F.lit(0)) >= V.PI_MIN_GAMES)
        & (F.coalesce(away_games, F.lit(0)) >= V.PI_MIN_GAMES)
    )
    gap = rating_to_goals(home) - rating_to_goals(away)
    clipped = F.greatest(F.least(gap, F.lit(8.0)), F.lit(-8.0))
    return _gate(both, {"home_pi": home, "away_pi": away, "pi_diff": home - away, "pi_expected_gd": clipped}, "has_pi")


def player_block(home_ga: Column, home_cards: Column, away_ga: Column, away_cards: Column) -> dict[str, Column]:
    both = home_ga.isNotNull() & away_ga.isNotNull()
    return _gate(
        both,
        {
            "home_ga_per_game": home_ga,
            "away_ga_per_game": away_ga,
            "ga_per_game_diff": home_ga - away_ga,
            "home_cards_per_game": home_cards,
            "away_cards_per_game": away_cards,
        },
        "has_player_stats",
    )


def availability_block(home_out: Column, home_abs: Column, away_out: Column, away_abs: Column) -> dict[str, Column]:
    both = home_out.isNotNull() & away_out.isNotNull()
    return _gate(
        both,
        {
            "home_value_out_frac": home_out,
            "away_value_out_frac": away_out,
            "availability_edge": away_out - home_out,
            "home_key_absences": home_abs,
            "away_key_absences": away_abs,
        },
        "has_player_data",
    )


def style_block(home: Column, away: Column) -> dict[str, Column]:
    """``home`` and ``away`` are map<string,double> columns over the style axes."""
    both = (F.coalesce(F.size(home), F.lit(0)) > 0) & (F.coalesce(F.size(away), F.lit(0)) > 0)
    axes = {}
    for axis in V.STYLE_AXES:
        axes[f"home_{axis}"] = F.coalesce(F.try_element_at(home, F.lit(axis)), F.lit(0.0))
        axes[f"away_{axis}"] = F.coalesce(F.try_element_at(away, F.lit(axis)), F.lit(0.0))
    return _gate(both, axes, "has_style")


def availability_nudge(p_home: Column, p_draw: Column, p_away: Column, home_out: Column, away_out: Column) -> dict[str, Column]:
    """Move at most 0.15 of win probability towards the less depleted side."""
    shift = F.coalesce(F.greatest(F.least(0.5 * (away_out - home_out), F.lit(0.15)), F.lit(-0.15)), F.lit(0.0))
    to_home = F.when(shift > 0, F.least(shift, p_away)).otherwise(0.0)
    to_away = F.when(shift < 0, F.least(-shift, p_home)).otherwise(0.0)
    return {"p_home": p_home + to_home - to_away, "p_draw": p_draw, "p_away": p_away - to_home + to_away}


def elo_tier(elo: Column) -> Column:
    return F.when(elo >= 1650, "Elite").when(elo >= 1560, "Strong").when(elo >= 1470, "Mid-table").otherwise("Underdog")


def confidence_label(top: Column) -> Column:
    return F.when(top >= 0.55, "High").when(top >= 0.42, "Moderate").otherwise("Low")


def devig(odds_home: Column, odds_draw: Column, odds_away: Column) -> dict[str, Column]:
    """Implied probabilities with the margin removed; null when unusable."""
    inv = [1.0 / F.nullif(o, F.lit(0.0)) for o in (odds_home, odds_draw, odds_away)]
    total = inv[0] + inv[1] + inv[2]
    ok = total > 0
    return {n: F.when(ok, i / total) for n, i in zip(("p_home", "p_draw", "p_away"), inv)}
