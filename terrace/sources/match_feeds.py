"""Match feeds as canonical match rows.

Each parser takes rows with a header -> value map plus ``season`` and ``feed_code``
columns, and keeps whatever further columns the rows carry.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import fixed_values as V
from terrace.functions.dates import long_season, parse_match_date, trailing_year
from terrace.functions.text import to_double, to_int
from terrace.operators.match_rows import finished, split_score, with_outcome
from terrace.sources.headed_csv import has, value

MIRROR_HEADER = r"(^|,)Team 1(,|$)"
RESULTS_HEADER = r"(^|,)HomeTeam(,|$)"
HISTORY_HEADER = r"^Country,League,Season,"
ANY_HEADER = rf"{MIRROR_HEADER}|{RESULTS_HEADER}|{HISTORY_HEADER}"
KEYS = ("row", "value")


def competition_of(feed_code: Column) -> Column:
    """Our code of a feed code; the feed code itself when it is not registered."""
    known = {row[3]: row[0] for row in V.LEAGUES} | V.WARMUP_LEAGUES
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(table, feed_code), feed_code)


def _stat_values() -> Column:
    """The optional statistics of a row as one array, in the order of the fixed column table."""
    names = F.array(*[F.lit(c) for c in V.STAT_COLUMNS.values()])
    return F.transform(names, lambda c: to_int(F.coalesce(F.try_element_at(F.col("row"), c), F.lit(""))))


def _records(df: DataFrame, fields: dict[str, Column], ok: Callable[[Column], Column]) -> DataFrame:
    """Parse each row once and keep it when ``ok`` holds for the parsed record.

    Written as an explode of a zero-or-one element array: an ordinary filter would be
    pushed below the parse and repeat it for every condition.
    """
    record = F.struct(*[c.alias(n) for n, c in fields.items()])
    carried = [c for c in df.columns if c not in (*KEYS, *fields)]
    kept = df.select(*carried, F.explode(F.filter(F.array(record), ok)).alias("_r"))
    return kept.select(*carried, *[F.col(f"_r.{n}").alias(n) for n in fields if n != "_keep"])


def _canonical(df: DataFrame, day: Column, home: Column, away: Column, hs: Column, as_: Column, stats: bool, keep: Column) -> DataFrame:
    fields = {
        "match_date": day,
        "home_team": home,
        "away_team": away,
        "home_score": hs,
        "away_score": as_,
        "competition": competition_of(F.col("feed_code")),
        "_stats": _stat_values() if stats else F.lit(None).cast("array<int>"),
        "_keep": keep,
    }

    def ok(m: Column) -> Column:
        full = m["match_date"].isNotNull() & m["home_score"].isNotNull() & m["away_score"].isNotNull()
        return m["_keep"] & (m["home_team"] != "") & (m["away_team"] != "") & full

    out = with_outcome(_records(df, fields, ok))
    return out.withColumns({n: F.get("_stats", F.lit(i)) for i, n in enumerate(V.STAT_COLUMNS)}).drop("_stats")


def parse_mirror(rows: DataFrame) -> DataFrame:
    """``Date,Team 1,FT,HT,Team 2`` rows."""
    hs, as_ = split_score(value("FT"))
    return _canonical(rows, parse_match_date(value("Date")), value("Team 1"), value("Team 2"), hs, as_, False, F.lit(True))


def parse_results(rows: DataFrame) -> DataFrame:
    """Main results rows; a blank score reads as zero, the result letter decides whether the match counts."""
    score = lambda c: F.when(value(c) == "", 0).otherwise(to_int(value(c)))
    return _canonical(
        rows, parse_match_date(value("Date")), value("HomeTeam"), value("AwayTeam"), score("FTHG"), score("FTAG"), True,
        value("FTR").isin("H", "D", "A"),
    )


def _canonical_name(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in V.NAME_CANON.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name), name)


def parse_history(rows: DataFrame) -> DataFrame:
    """Whole-history rows, kept when their season label is the row's ``season``.

    Calendar-year leagues match on the label's trailing year.
    """
    calendar = F.col("feed_code").isin(*[row[3] for row in V.LEAGUES if row[4] == "fdnew" and row[6]])
    label = long_season(F.col("season"), calendar)
    same = F.when(calendar, trailing_year(value("Season")) == label).otherwise(value("Season") == label)
    keep = F.coalesce(same, F.lit(False)) & value("Res").isin("H", "D", "A")
    return _canonical(
        rows, parse_match_date(value("Date"), ("dmy4", "dmy2")), _canonical_name(value("Home")), _canonical_name(value("Away")),
        to_int(value("HG")), to_int(value("AG")), False, keep,
    )


def season_slots(rows: DataFrame, seasons: list[str]) -> DataFrame:
    """Pair whole-history rows with every requested season; the parser keeps the right one."""
    return rows.withColumn("season", F.explode(F.array(*[F.lit(s) for s in seasons])))


def parse_any(rows: DataFrame) -> DataFrame:
    """Mixed mirror and results files: the header decides the parser."""
    mirror = has("Team 1") & has("FT") & has("Team 2")
    return parse_mirror(rows.filter(mirror)).unionByName(parse_results(rows.filter(~mirror)))


MATCH_JSON_SCHEMA = """
struct<id:bigint,status:string,utcDate:string,homeTeam:struct<name:string>,awayTeam:struct<name:string>,
  score:struct<fullTime:struct<home:int,away:int>>,competition:struct<code:string>,season:string,league_code:string,stats:map<string,int>>
"""


def flatten_matches(df: DataFrame, doc: str = "doc", keep: list[str] | None = None) -> DataFrame:
    """Nested match documents as finished canonical rows."""
    d = df.select(
        *(keep or []), F.col(f"{doc}.status").alias("status"), F.to_date(F.substring(f"{doc}.utcDate", 1, 10)).alias("match_date"),
        F.coalesce(f"{doc}.competition.code", F.lit("")).alias("competition"),
        F.col(f"{doc}.homeTeam.name").alias("home_team"), F.col(f"{doc}.awayTeam.name").alias("away_team"),
        F.col(f"{doc}.score.fullTime.home").alias("home_score"), F.col(f"{doc}.score.fullTime.away").alias("away_score"),
        *[F.try_element_at(F.col(f"{doc}.stats"), F.lit(s)).alias(s) for s in V.STAT_COLUMNS],
    )
    return with_outcome(finished(d)).drop("status")


def parse_odds(rows: DataFrame) -> DataFrame:
    """De-vigged probabilities and outcome; each file uses the first odds triple it has whole."""
    from terrace.operators.blocks import devig

    chosen: list[Column | None] = [None, None, None]
    for triple in V.ODDS_TRIPLES:
        whole = has(triple[0]) & has(triple[1]) & has(triple[2])
        for i, c in enumerate(triple):
            odd = to_double(value(c))
            chosen[i] = F.when(whole, odd) if chosen[i] is None else chosen[i].when(whole, odd)
    y = F.when(value("FTR") == "H", 1).when(value("FTR") == "D", 0).when(value("FTR") == "A", -1)
    fields = dict(zip(("y", "_oh", "_od", "_oa"), (y, *chosen)))
    raw = _records(rows, fields, lambda m: m["y"].isNotNull() & m["_oh"].isNotNull() & m["_od"].isNotNull() & m["_oa"].isNotNull())
    fair = raw.withColumns(devig(F.col("_oh"), F.col("_od"), F.col("_oa")))
    return fair.dropna(subset=["p_home", "p_draw", "p_away"]).drop("_oh", "_od", "_oa")


def parse_valuations(rows: DataFrame) -> DataFrame:
    """Dated valuations; rows with a blank or a non-number are dropped."""
    fields = {
        "valued_on": parse_match_date(value("date"), ("iso",)),
        "player_id": value("player_id"),
        "value_eur": to_double(value("market_value_in_eur")).cast("decimal(18,2)"),
        "club_id": F.nullif(value("current_club_id"), F.lit("")),
    }
    return _records(rows, fields, lambda m: m["valued_on"].isNotNull() & m["value_eur"].isNotNull() & m["club_id"].isNotNull())


def parse_appearances(rows: DataFrame) -> DataFrame:
    num = lambda c: F.when(value(c) == "", 0.0).otherwise(to_double(value(c)))
    fields = {
        "club_id": F.nullif(value("player_club_id"), F.lit("")),
        "game_id": F.nullif(value("game_id"), F.lit("")),
        "played_on": parse_match_date(value("date"), ("iso",)),
        **{c: num(c) for c in ("goals", "assists", "yellow_cards", "red_cards")},
    }
    return _records(rows, fields, lambda m: m["club_id"].isNotNull() & m["game_id"].isNotNull() & m["played_on"].isNotNull())


def parse_rating_snapshots(rows: DataFrame, month: Column | None = None) -> DataFrame:
    """(country, norm_name, month, elo); the month comes from the file name by default."""
    from terrace.functions.text import normalize_name

    month = F.regexp_extract("file", r"(\d{4}-\d{2})", 1) if month is None else month
    fields = {
        "country": value("Country"),
        "norm_name": normalize_name(value("Club"), V.RATING_DROP_TOKENS),
        "month": month,
        "elo": to_double(value("Elo")),
    }
    return _records(rows, fields, lambda m: (m["country"] != "") & (m["norm_name"] != "") & m["elo"].isNotNull())
