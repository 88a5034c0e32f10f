"""Season projection as tables: sampled scorelines, simulated tables, position shares.

Draws are hashes of (seed, sim, fixture), so a projection does not depend on how the
rows are partitioned.  Simulations are expanded in blocks; fixtures are shuffled
once by (league keys, block) before the expansion, and the per-simulation table and
ranking reuse that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions.goals import CDF_START, OUTCOME_CELLS, score_cdfs, score_grid
from terrace.scale import hot_keys

SIM_BLOCK = 1000
SALTS = 64


def draw_hash(seed: int, *keys: Column | str) -> Column:
    """Hex digest of (seed, keys); different slices of it are independent uniforms."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return F.md5(text)


def uniform(digest: Column, part: int = 0) -> Column:
    """A uniform in [0, 1) from eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("double") / 4294967296.0


def _lambdas(rho: float) -> list[Column]:
    return [F.col("exp_home"), F.col("exp_away"), F.lit(float(rho))]


def grid_rows(fixtures: DataFrame, rho: float = V.DC_RHO) -> DataFrame:
    """(match_id, i, j, p): every scoreline of every fixture."""
    side = V.MAX_GOALS + 1
    cells = fixtures.select("match_id", F.posexplode(score_grid(*_lambdas(rho))).alias("pos", "p"))
    return cells.select("match_id", F.expr(f"pos div {side}").cast("int").alias("i"), (F.col("pos") % side).alias("j"), "p")


def with_conditional_cdf(fixtures: DataFrame, rho: float = V.DC_RHO) -> DataFrame:
    """Cumulative scoreline tables given a home win, a draw and an away win, end to end in one array."""
    return fixtures.withColumn("cdf", score_cdfs(*_lambdas(rho)))


def cell_goals(outcome: Column, idx: Column) -> tuple[Column, Column]:
    """Home and away goals of the idx-th scoreline of an outcome."""

    def lookup(k: int) -> Column:
        table = lambda o: F.array(*[F.lit(c[k]) for c in OUTCOME_CELLS[o]])
        return (
            F.when(outcome == 1, F.get(table(1), idx)).when(outcome == 0, F.get(table(0), idx)).otherwise(F.get(table(-1), idx))
        )

    return lookup(0), lookup(1)


def cdf_rows(fixtures: DataFrame) -> DataFrame:
    """(match_id, outcome, i, j, cdf) of the conditional tables."""
    rows = with_conditional_cdf(fixtures).select("match_id", F.posexplode("cdf").alias("pos", "cdf"))
    outcome = F.when(F.col("pos") < CDF_START[0], 1).when(F.col("pos") < CDF_START[-1], 0).otherwise(-1)
    rows = rows.withColumn("outcome", outcome)
    i, j = cell_goals(F.col("outcome"), F.col("pos") - _first_cell(F.col("outcome")))
    return rows.select("match_id", "outcome", i.alias("i"), j.alias("j"), "cdf")


def _first_cell(outcome: Column) -> Column:
    return F.when(outcome == 1, CDF_START[1]).when(outcome == 0, CDF_START[0]).otherwise(CDF_START[-1])


def expand(
    fixtures: DataFrame, keys: list[str], n_sims: int, seed: int = 42, block: int = SIM_BLOCK, max_rows: int | None = None
) -> DataFrame:
    """One row per (fixture, simulation) with the sampled outcome and scoreline.

    Bare fixtures are shuffled by (keys, block), so the simulated tables need no
    second shuffle.  When a league is too large for that they are salted by fixture
    instead and the tables are combined map-side first.  Either way the cumulative
    tables are built after the shuffle, and a draw finds its cell by counting the table entries below it.
    """
    blocks = fixtures.select(*keys, "match_id", "home_team", "away_team", "p_home", "p_draw", "exp_home", "exp_away")
    blocks = blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((n_sims - 1) // block))))
    hot = hot_keys(fixtures, keys, max_rows, weight=min(block, n_sims)) is not None
    salt = [F.pmod(F.xxhash64("match_id"), F.lit(SALTS))] if hot else []
    blocks = blocks.repartition(*keys, "block", *salt)
    blocks = with_conditional_cdf(blocks).drop("exp_home", "exp_away")
    first = F.col("block") * block
    drawn = blocks.withColumn("sim", F.explode(F.sequence(first, F.least(first + block, F.lit(n_sims)) - 1)))
    drawn = drawn.withColumn("hash", draw_hash(seed, "sim", "match_id"))
    drawn = drawn.withColumns({"u1": uniform(F.col("hash"), 0), "u2": uniform(F.col("hash"), 1)})
    drawn = drawn.withColumn(
        "outcome", F.when(F.col("u1") < F.col("p_home"), 1).when(F.col("u1") < F.col("p_home") + F.col("p_draw"), 0).otherwise(-1)
    )
    o = F.col("outcome")
    drawn = drawn.withColumns({"start": _first_cell(o), "last": F.when(o == 0, len(OUTCOME_CELLS[0]) - 1).otherwise(len(OUTCOME_CELLS[1]) - 1)})
    # The last cell needs no test: whatever lies beyond the others falls into it.
    table = F.slice("cdf", F.col("start") + 1, F.col("last"))
    below = F.size(F.filter(table, lambda c: c < F.col("u2")))
    # u2 is named twice so that its digest arithmetic is not inlined into the lambda.
    drawn = drawn.withColumn("idx", F.when(F.col("u2") >= 0.0, below))
    hg, ag = cell_goals(o, F.col("idx"))
    return drawn.select(*keys, "match_id", "home_team", "away_team", "block", "sim", "outcome", hg.alias("hg"), ag.alias("ag"))


def simulated_tables(expanded: DataFrame, keys: list[str], start: DataFrame | None = None) -> DataFrame:
    """Points, goal difference, goals and goal-line counts per simulation and team."""
    c = F.col
    both = F.when((c("hg") > 0) & (c("ag") > 0), 1).otherwise(0)
    over = F.when(c("hg") + c("ag") > 2, 1).otherwise(0)

    def side(team: str, mine: str, theirs: str, sign: int) -> Column:
        pts = F.when(c("outcome") * sign == 1, 3).when(c("outcome") == 0, 1).otherwise(0)
        return F.struct(
            c(team).alias("team"), pts.alias("points"), (c(mine) - c(theirs)).alias("gd"), c(mine).alias("gf"), both.alias("btts"), over.alias("over25")
        )

    sides = expanded.select(
        *keys, "block", "sim", F.explode(F.array(side("home_team", "hg", "ag", 1), side("away_team", "ag", "hg", -1))).alias("s")
    ).select(*keys, "block", "sim", "s.*")
    sums = [F.sum(x).cast("int").alias(x) for x in ("points", "gd", "gf", "btts", "over25")]
    out = sides.groupBy(*keys, "block", "sim", "team").agg(*sums, F.count("*").cast("int").alias("played"))
    if start is not None:
        s = start.select(*keys, "team", *[F.col(x).alias(f"_{x}") for x in ("points", "gd", "gf")])
        out = out.join(s, [*keys, "team"], "left")
        out = out.withColumns({x: F.col(x) + F.coalesce(F.col(f"_{x}"), F.lit(0)) for x in ("points", "gd", "gf")}).drop("_points", "_gd", "_gf")
    return out


def ranked(tables: DataFrame, keys: list[str], seed: int = 42, points_only: bool = False) -> DataFrame:
    """Positions within each simulation; exact ties fall to a hash of (seed, sim, team)."""
    by = [F.desc("points")] if points_only else [F.desc("points"), F.desc("gd"), F.desc("gf")]
    w = Window.partitionBy(*keys, "block", "sim").orderBy(*by, F.desc(uniform(draw_hash(seed, "sim", "team"))), "team")
    return tables.withColumn("position", F.row_number().over(w))


def position_matrix(positions: DataFrame, keys: list[str], n_sims: int) -> DataFrame:
    """Share of simulations in which a team finishes at each position."""
    return positions.groupBy(*keys, "team", "position").agg((F.count("*") / F.lit(float(n_sims))).alias("share"))


def stderr(p: Column, n: int) -> Column:
    return F.sqrt(F.greatest(p * (1.0 - p), F.lit(0.0)) / max(n, 1))


def tier_shares(positions: DataFrame, rules: DataFrame, keys: list[str], n_sims: int) -> DataFrame:
    """Title, continental, playoff and relegation shares under the league's rules."""
    pos, n = F.col("position"), F.col("n_teams")
    cl, uel, play = F.col("cl_slots"), F.col("uel_slots"), F.col("playoff_slots")
    cut = n - F.col("relegation_slots")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    out = positions.join(rules, keys).groupBy(*keys, "team").agg(
        share(pos == 1).alias("title_prob"),
        share(pos <= cl).alias("ucl_prob"),
        share((pos > cl) & (pos <= cl + uel)).alias("uel_prob"),
        share((pos > cut - play) & (pos <= cut)).alias("playoff_prob"),
        share(pos > cut).alias("relegation_prob"),
        share(pos <= 4).alias("top4_prob"),
    )
    return out.withColumns({f"{t}_se": stderr(F.col(f"{t}_prob"), n_sims) for t in ("title", "ucl", "relegation")})


def summary(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Expected points and goals, mean position, goal-line rates and the 10-90 points band."""
    gf, gd = F.avg("gf"), F.avg("gd")
    return positions.groupBy(*keys, "team").agg(
        F.avg("points").alias("expected_points"),
        gf.alias("expected_gf"),
        gd.alias("expected_gd"),
        (gf - gd).alias("expected_ga"),
        F.avg("position").alias("mean_position"),
        F.percentile("points", 0.1).alias("points_p10"),
        F.percentile("points", 0.9).alias("points_p90"),
        (F.sum("btts") / F.sum("played")).alias("btts_pct"),
        (F.sum("over25") / F.sum("played")).alias("over25_pct"),
    )


def expected_points(fixtures: DataFrame, keys: list[str]) -> DataFrame:
    """Closed-form expected points per team: 3 * P(win) + P(draw) over its fixtures."""
    side = lambda team, win: F.struct(F.col(team).alias("team"), (3.0 * F.col(win) + F.col("p_draw")).alias("e"))
    rows = fixtures.select(*keys, F.explode(F.array(side("home_team", "p_home"), side("away_team", "p_away"))).alias("s"))
    return rows.groupBy(*keys, F.col("s.team").alias("team")).agg(F.sum("s.e").alias("expected_points"))
