"""Ratings kept up to date by arriving results.

State per component: one map entry per team and a buffer of results newer than the
watermark.  Results are folded in (date, sequence) order once the watermark passes
them, so the stream gives the batch ratings.  A result that arrives after its day was
folded is not lost: it comes out at once, marked ``late`` and without ratings, for a
side table from which a batch rebuild picks it up.
"""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from terrace import fixed_values as V
from terrace.operators.ratings import RATED, STATE_DDL, RatingParams, rate_one

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
_DAY_MS = 86_400_000
_TEAM_VALUE = STATE_DDL.split(",", 1)[1].strip()
_ROW = "competition string, home_team string, away_team string, home_score int, away_score int"
OUTPUT = StructType(
    [
        StructField("component", StringType()),
        StructField("match_id", LongType()),
        StructField("late", BooleanType()),
        *[StructField(c, DoubleType()) for c in RATED],
    ]
)
_DAY = "result_day"
#: Buffered results that are sorted in memory at a time, read back from a sorted run at a time, and rows of an output frame.
RUN_ROWS, BLOCK_ROWS, FRAME_ROWS = 50_000, 200, 10_000


@contextmanager
def state_store(spark: SparkSession):
    """Run streams with the state store the ratings need; the caller's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER_CONF, None)
    spark.conf.set(PROVIDER_CONF, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER_CONF) if before is None else spark.conf.set(PROVIDER_CONF, before)


def in_order(items: Iterator[tuple], run_rows: int = RUN_ROWS) -> Iterator[tuple]:
    """``items`` sorted with about ``run_rows`` of them in memory: more go through sorted runs in one temporary file."""
    run = sorted(islice(items, run_rows))
    if len(run) < run_rows:
        yield from run
        return
    with tempfile.TemporaryFile() as file:

        def blocks(starts: list[int]) -> Iterator[tuple]:
            for start in starts:
                file.seek(start)
                yield from pickle.load(file)

        runs = []
        while run:
            starts = []
            for low in range(0, len(run), BLOCK_ROWS):
                starts.append(file.tell())
                pickle.dump(run[low : low + BLOCK_ROWS], file, pickle.HIGHEST_PROTOCOL)
            runs.append(starts)
            run = sorted(islice(items, run_rows))
        yield from heapq.merge(*map(blocks, runs))


class RatingsProcessor(StatefulProcessor):
    """Folds results of one component as the watermark releases them."""

    def __init__(self, params: RatingParams | None = None):
        self.params = params or RatingParams()

    def init(self, handle) -> None:
        self.handle = handle
        self.teams = handle.getMapState("teams", "team string", _TEAM_VALUE)
        self.leagues = handle.getMapState("leagues", "competition string", "n long, hg long, ag long")
        self.buffer = handle.getMapState("buffer", "day long, seq long, match_id long", _ROW)

    def _team(self, cache: dict, team: str) -> list | None:
        if team not in cache and self.teams.containsKey((team,)):
            elo, att, dfn, pih, pia, games, day, opp = self.teams.getValue((team,))
            cache[team] = [elo, att, dfn, pih, pia, int(games), None if day is None else int(day), tuple(opp)]
        return cache.get(team)

    def _release(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        ready = ((tuple(k), tuple(v)) for k, v in self.buffer.iterator() if k[0] * _DAY_MS < watermark_ms)
        cache: dict = {}
        goals: dict = {}
        rows: list = []
        columns = ["component", "match_id", "late", *RATED]
        for (day, seq, match_id), (comp, home, away, hs, as_) in in_order(ready):
            for team in (home, away):
                known = self._team(cache, team)
                for opp in known[-1] if known else ():
                    self._team(cache, opp)
            if comp not in goals:
                goals[comp] = list(self.leagues.getValue((comp,))) if self.leagues.containsKey((comp,)) else [0, 0, 0]
            n, hg, ag = goals[comp]
            warm = n >= V.BASELINE_MIN_MATCHES
            bh, ba = (hg / n, ag / n) if warm else (V.BASE_HOME_GOALS, V.BASE_AWAY_GOALS)
            rows.append([key[0], match_id, False, *rate_one(cache, day, home, away, hs, as_, bh, ba, self.params)])
            goals[comp] = [n + 1, hg + hs, ag + as_]
            self.buffer.removeKey((day, seq, match_id))
            if len(rows) == FRAME_ROWS:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        for team, s in cache.items():
            self.teams.updateValue((team,), (*s[:5], float(s[5]), None if s[6] is None else float(s[6]), list(s[7])))
        for comp, g in goals.items():
            self.leagues.updateValue((comp,), tuple(g))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        newest, late = None, []
        marked = lambda: pd.DataFrame(late, columns=OUTPUT.names).astype({c: "float64" for c in RATED})
        for pdf in rows:
            cols = [pdf[c].tolist() for c in (_DAY, "match_seq", "match_id", "competition", "home_team", "away_team", "home_score", "away_score")]
            for day, seq, mid, *rest in zip(*cols):
                if day * _DAY_MS < watermark:
                    late.append([key[0], mid, True, *[None] * len(RATED)])
                    continue
                self.buffer.updateValue((day, seq, mid), (*rest[:3], int(rest[3]), int(rest[4])))
                newest = day if newest is None else max(newest, day)
            if len(late) >= FRAME_ROWS:
                yield marked()
                late = []
        if late:
            yield marked()
        if newest is not None:
            self.handle.registerTimer((newest + 1) * _DAY_MS)
        yield from self._release(key, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def streaming_ratings(results: DataFrame, components: DataFrame, delay: str = "1 day", params: RatingParams | None = None) -> DataFrame:
    """Ratings per match of a results stream with a ``match_time`` column.

    ``components`` has one row per team, from the batch job.  All competitions of a
    component share its state, as in the batch fold.  A team that is not in it belongs
    to the component of its opponent; two such teams that meet begin a component of
    their own, which a stream can't join to another one later.

    The output holds one row per result: its ratings, or ``late`` and no ratings (see
    ``on_time`` and ``late_results``).  Run the stream within ``state_store``.
    """
    timed = results.withWatermark("match_time", delay).withColumn(_DAY, F.unix_date(F.to_date("match_time")).cast("long"))
    for side in ("home", "away"):
        known = components.select(F.col("team").alias(f"{side}_team"), F.col("component").alias(f"{side}_component"))
        timed = timed.join(known, f"{side}_team", "left")
    component = F.coalesce("home_component", "away_component", F.least("home_team", "away_team"))
    # Without its event time a row can't be dropped for being late; the processor sees it and marks it.
    keyed = timed.withColumn("component", component).drop("match_time", "home_component", "away_component")
    return keyed.groupBy("component").transformWithStateInPandas(
        RatingsProcessor(params), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime"
    )


def on_time(rated: DataFrame) -> DataFrame:
    """The rated results of the output of ``streaming_ratings``."""
    return rated.filter(~F.col("late")).drop("late")


def late_results(rated: DataFrame) -> DataFrame:
    """(component, match_id) of the results that came after their day was folded."""
    return rated.filter("late").select("component", "match_id")
