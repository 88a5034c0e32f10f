"""Poisson scorelines with the low-score correlation correction."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from terrace import fixed_values as V


def expected_goals(home_attack, home_defense, away_attack, away_defense, base_home, base_away) -> tuple[Column, Column]:
    return base_home * home_attack * away_defense, base_away * away_attack * home_defense


def low_score_factors(lh: Column, la: Column, rho: Column) -> dict[tuple[int, int], Column]:
    """Factor of the four corrected cells, floored at zero."""
    floor = lambda c: F.greatest(c, F.lit(0.0))
    return {
        (0, 0): floor(1 - lh * la * rho),
        (0, 1): floor(1 + lh * rho),
        (1, 0): floor(1 + la * rho),
        (1, 1): floor(1 - rho),
    }


def outcome_probabilities(lh: Column, la: Column, rho: Column | float = V.DC_RHO, goals: int = V.MAX_GOALS) -> tuple[Column, Column, Column]:
    """(p_home, p_draw, p_away) of the capped, corrected, normalised grid.

    The exp(-lambda) factors cancel in the normalisation, so the grid sums reduce
    to products of power series: plain arithmetic, inside codegen.
    """
    rho = rho if isinstance(rho, Column) else F.lit(rho)
    lh, la = F.greatest(lh, F.lit(0.0)), F.greatest(la, F.lit(0.0))
    fact = [float(math.factorial(k)) for k in range(goals + 1)]
    term = lambda lam, k: F.lit(1.0) if k == 0 else F.pow(lam, F.lit(float(k))) / fact[k]
    h = F.array(*[term(lh, k) for k in range(goals + 1)])
    a = F.array(*[term(la, k) for k in range(goals + 1)])
    start = F.struct(F.lit(0.0).alias("home"), F.lit(0.0).alias("draw"), F.lit(0.0).alias("away"), F.lit(0.0).alias("ch"), F.lit(0.0).alias("ca"))

    def step(acc, pair):
        x, y = pair["h"], pair["a"]
        return F.struct(
            (acc["home"] + x * acc["ca"]).alias("home"),
            (acc["draw"] + x * y).alias("draw"),
            (acc["away"] + y * acc["ch"]).alias("away"),
            (acc["ch"] + x).alias("ch"),
            (acc["ca"] + y).alias("ca"),
        )

    pairs = F.zip_with(h, a, lambda x, y: F.struct(x.alias("h"), y.alias("a")))
    t = low_score_factors(lh, la, rho)

    def finish(acc):
        home = acc["home"] + lh * (t[(1, 0)] - 1)
        draw = acc["draw"] + (t[(0, 0)] - 1) + lh * la * (t[(1, 1)] - 1)
        away = acc["away"] + la * (t[(0, 1)] - 1)
        total = home + draw + away
        share = lambda p: F.when(total > 0, p / total).otherwise(1.0 / 3)
        return F.struct(share(home).alias("home"), share(draw).alias("draw"), share(away).alias("away"))

    probs = F.aggregate(pairs, start, step, finish)
    return probs["home"], probs["draw"], probs["away"]


# Cells of the grid in row order, split by outcome: home win, draw, away win.
CELLS = [(i, j) for i in range(V.MAX_GOALS + 1) for j in range(V.MAX_GOALS + 1)]
OUTCOME_CELLS = {
    1: [c for c in CELLS if c[0] > c[1]],
    0: [c for c in CELLS if c[0] == c[1]],
    -1: [c for c in CELLS if c[0] < c[1]],
}


def _grid(lh: np.ndarray, la: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Normalised grids, one row of 81 cells per fixture."""
    k = np.arange(V.MAX_GOALS + 1)
    fact = np.array([math.factorial(int(x)) for x in k], dtype="float64")
    pmf = lambda lam: np.exp(-lam)[:, None] * np.power(lam[:, None], k) / fact
    lh, la = np.maximum(lh, 1e-6), np.maximum(la, 1e-6)
    g = pmf(lh)[:, :, None] * pmf(la)[:, None, :]
    g[:, 0, 0] *= np.maximum(1 - lh * la * rho, 0)
    g[:, 0, 1] *= np.maximum(1 + lh * rho, 0)
    g[:, 1, 0] *= np.maximum(1 + la * rho, 0)
    g[:, 1, 1] *= np.maximum(1 - rho, 0)
    flat = g.reshape(len(g), -1)
    return flat / flat.sum(axis=1, keepdims=True)


def _as_lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype="int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def _numpy(*cols: pa.Array) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype("float64") for c in cols]


@F.arrow_udf(ArrayType(DoubleType()))
def score_grid(lh: pa.Array, la: pa.Array, rho: pa.Array) -> pa.Array:
    """The whole grid of a fixture, row by row, on Arrow batches."""
    return _as_lists(_grid(*_numpy(lh, la, rho)))


# Where each outcome's cells start in the joint cumulative table, and how many there are.
CDF_START = {1: 0, 0: len(OUTCOME_CELLS[1]), -1: len(OUTCOME_CELLS[1]) + len(OUTCOME_CELLS[0])}


@F.arrow_udf(ArrayType(DoubleType()))
def score_cdfs(lh: pa.Array, la: pa.Array, rho: pa.Array) -> pa.Array:
    """Cumulative cell probabilities given a home win, a draw and an away win, one after the other."""
    g = _grid(*_numpy(lh, la, rho))
    parts = []
    for outcome in (1, 0, -1):
        part = np.cumsum(g[:, [CELLS.index(c) for c in OUTCOME_CELLS[outcome]]], axis=1)
        total = part[:, -1:]
        # An impossible outcome falls back to its first cell (1-0, 0-0, 0-1).
        parts.append(np.where(total > 0, part / np.where(total > 0, total, 1.0), 1.0))
    return _as_lists(np.concatenate(parts, axis=1))


def entropy3(p1: Column, p2: Column, p3: Column) -> Column:
    """Shannon entropy of three probabilities, floored at 1e-9 and renormalised."""
    q = [F.greatest(p, F.lit(1e-9)) for p in (p1, p2, p3)]
    total = q[0] + q[1] + q[2]
    parts = [x / total for x in q]
    return -(parts[0] * F.ln(parts[0]) + parts[1] * F.ln(parts[1]) + parts[2] * F.ln(parts[2]))


def rating_to_goals(rating: Column, c: float = V.PI_C) -> Column:
    sign = F.when(rating >= 0, 1.0).otherwise(-1.0)
    return sign * (F.pow(F.lit(10.0), F.abs(rating) / c) - 1.0)


def logistic10(diff: Column) -> Column:
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -diff / 400.0))
