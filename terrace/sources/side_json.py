"""Side inputs held as JSON: standings, availability and style files, injuries, team statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import to_int

SQUAD_DENOMINATOR = 25.0

STANDINGS_SCHEMA = """
struct<season:struct<id:bigint,startDate:string>,
  standings:array<struct<type:string,table:array<struct<
    position:int,team:struct<id:bigint,name:string,shortName:string>,playedGames:int,points:int,goalDifference:int,goalsFor:int>>>>>
"""
AVAILABILITY_SCHEMA = """
struct<availability:map<string,struct<value_out_fraction:double,key_absences:double>>,style:map<string,map<string,double>>>
"""
_TOTAL = "struct<total:int>"
STATISTICS_SCHEMA = f"""
struct<fixtures:struct<played:struct<total:int>>,lineups:array<struct<formation:string,played:int>>,
  cards:struct<yellow:map<string,{_TOTAL}>,red:map<string,{_TOTAL}>>,
  goals:struct<for:struct<minute:map<string,{_TOTAL}>>>>
"""


def standings_rows(df: DataFrame, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    """TOTAL table rows of standings documents."""
    keep = keep or []
    doc = df.select(*keep, F.from_json(json, STANDINGS_SCHEMA).alias("d"))
    total = doc.select(*keep, "d.season", F.explode("d.standings").alias("s")).filter("s.type = 'TOTAL'")
    rows = total.select(*keep, F.col("season.id").alias("season_id"), F.explode("s.table").alias("r")).filter("r.team.id is not null")
    zero = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0))
    return rows.select(
        *keep, "season_id", F.col("r.team.id").alias("team_id"), F.col("r.team.name").alias("name"), F.col("r.team.shortName").alias("short_name"),
        zero("position").alias("position"), zero("playedGames").alias("played"), zero("points").alias("points"),
        zero("goalDifference").alias("gd"), zero("goalsFor").alias("gf"),
    )


def availability_rows(df: DataFrame, json: str = "json") -> DataFrame:
    """(club, value_out_fraction, key_absences) from availability documents."""
    m = df.select(F.explode(F.from_json(json, AVAILABILITY_SCHEMA)["availability"]).alias("club", "a"))
    return m.select("club", F.col("a.value_out_fraction").alias("value_out_fraction"), F.col("a.key_absences").alias("key_absences"))


def style_rows(df: DataFrame, json: str = "json") -> DataFrame:
    """(club, style map) from the same documents."""
    return df.select(F.explode(F.from_json(json, AVAILABILITY_SCHEMA)["style"]).alias("club", "style"))


def injury_rollup(injuries: DataFrame, team: str = "team", kind: str = "kind") -> DataFrame:
    """Weighted absences per team and the share of squad value they stand for."""
    weight = F.when(F.col(kind).contains("Missing"), 1.0).when(F.col(kind).contains("Questionable"), 0.5).otherwise(0.0)
    total = injuries.groupBy(team).agg(F.sum(weight).alias("w"))
    return total.select(
        team,
        F.round("w", 1).alias("key_absences"),
        F.round(F.least(F.lit(0.5), F.col("w") / SQUAD_DENOMINATOR), 3).alias("value_out_fraction"),
    )


def _sum_totals(m: Column) -> Column:
    return F.aggregate(F.map_values(m), F.lit(0), lambda acc, v: acc + F.coalesce(v["total"], F.lit(0)))


def style_metrics(df: DataFrame, json: str = "json", keep: list[str] | None = None) -> DataFrame:
    """Back-line shape, cards per game and share of late goals from team statistics."""
    keep = keep or []
    d = df.select(*keep, F.from_json(json, STATISTICS_SCHEMA).alias("d"))
    games = F.col("d.fixtures.played.total")
    d = d.filter(F.coalesce(games, F.lit(0)) > 0)
    most = F.array_max(F.transform("d.lineups", lambda x: F.coalesce(x["played"], F.lit(0))))
    primary = F.try_element_at(F.filter("d.lineups", lambda x: F.coalesce(x["played"], F.lit(0)) == most), F.lit(1))["formation"]
    shape = F.coalesce(to_int(F.element_at(F.split(F.coalesce(primary, F.lit("")), "-"), 1)), F.lit(4))
    block = lambda c: F.coalesce(_sum_totals(F.col(c)), F.lit(0))
    minute = F.col("d.goals.for.minute")
    late = F.lit(0)
    for span in ("76-90", "91-105"):
        late = late + F.coalesce(F.try_element_at(minute, F.lit(span))["total"], F.lit(0))
    scored = block("d.goals.for.minute")
    return d.select(
        *keep,
        shape.alias("def_shape"),
        F.round((block("d.cards.yellow") + block("d.cards.red")) / games, 3).alias("cards_pg"),
        F.when(scored > 0, F.round(late / scored, 3)).otherwise(0.0).alias("late_share"),
    )
