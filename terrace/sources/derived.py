"""A dated match table, and side tables, derived from the star-schema tables.

One order is one match: returned / accepted line counts are the scores, the order
key fixes competition and teams, and the order date is the match date.  Every
formula is integer arithmetic, so the SQL twin in ``plans.sql`` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = ["PL", "PD", "BL1", "SA", "NOR1", "BSA", "ELC", "ZZ1"]
STATS = ["shots", "shots_on_target", "corners", "fouls", "yellow", "red"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def team_name(comp: Column, idx: Column) -> Column:
    return F.concat(F.lit("T"), F.lpad((comp * 100 + idx).cast("string"), 4, "0"))


def club_of(key: Column) -> Column:
    """Team of a customer / supplier key."""
    return team_name(key % 8, F.floor(key / 8) % 20)


def _line_scores(lineitem: DataFrame) -> DataFrame:
    home, away = F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"
    qty, no = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    stat = {
        "shots": qty,
        "shots_on_target": no,
        "corners": qty % 7,
        "fouls": qty % 11,
        "yellow": no % 3,
        "red": F.floor(no / 5),
    }
    aggs = [F.count(F.when(home, 1)).cast("int").alias("home_score"), F.count(F.when(away, 1)).cast("int").alias("away_score")]
    for name in STATS:
        aggs.append(F.sum(F.when(home, stat[name])).cast("int").alias(f"home_{name}"))
        aggs.append(F.sum(F.when(away, stat[name])).cast("int").alias(f"away_{name}"))
    return lineitem.groupBy(F.col("l_orderkey").alias("match_id")).agg(*aggs)


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who plays whom and when, from orders alone."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    comp = k % 8
    slot = (cust + F.floor(k / 8)) % 20
    other = (slot + 1 + F.floor(k / 8) % 19) % 20
    return table(spark, sf_dir, "orders").select(
        k.alias("match_id"),
        k.alias("match_seq"),
        F.to_date("o_orderdate").alias("match_date"),
        F.element_at(F.array(*[F.lit(c) for c in CODES]), (comp + 1).cast("int")).alias("competition"),
        team_name(comp, slot).alias("home_team"),
        team_name(comp, other).alias("away_team"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical match table: fixtures joined to their line counts."""
    scores = _line_scores(table(spark, sf_dir, "lineitem"))
    hs, aw = F.coalesce("home_score", F.lit(0)), F.coalesce("away_score", F.lit(0))
    joined = fixtures(spark, sf_dir).join(scores, "match_id", "left")
    return joined.withColumns({"home_score": hs, "away_score": aw}).withColumns(
        {
            "result": F.signum(F.col("home_score") - F.col("away_score")).cast("int"),
            "total_goals": F.col("home_score") + F.col("away_score"),
            "goal_diff": F.col("home_score") - F.col("away_score"),
        }
    )


def probabilities(df: DataFrame, key: str = "match_id") -> DataFrame:
    """A probability triple per row from fixed integer weights of its key."""
    k = F.col(key)
    wh, wd, wa = 20 + (k * 31) % 97, 20 + (k * 17) % 53, 20 + (k * 43) % 89
    total = (wh + wd + wa).cast("double")
    return df.withColumns({"p_away": wa / total, "p_draw": wd / total, "p_home": wh / total})


def second_probabilities(df: DataFrame, key: str = "match_id") -> DataFrame:
    """A second triple (used as the blended-in distribution)."""
    k = F.col(key)
    wh, wd, wa = 10 + (k * 13) % 71, 10 + (k * 29) % 37, 10 + (k * 7) % 61
    total = (wh + wd + wa).cast("double")
    return df.withColumns({"q_away": wa / total, "q_draw": wd / total, "q_home": wh / total})


def expected_goals(df: DataFrame, key: str = "match_id") -> DataFrame:
    k = F.col(key)
    return df.withColumns({"exp_home": 0.5 + (k * 11) % 23 / 10.0, "exp_away": 0.4 + (k * 7) % 19 / 10.0})


def valuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated player valuations; a player changes club with the year."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.to_date("o_orderdate").alias("valued_on"),
        F.col("o_custkey").alias("player_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("value_eur"),
        club_of(F.col("o_custkey") + F.year("o_orderdate")).alias("club_id"),
        F.col("o_orderkey").alias("seq"),
    )


def appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        club_of(F.col("l_suppkey")).alias("club_id"),
        F.col("l_orderkey").alias("game_id"),
        F.to_date("l_shipdate").alias("played_on"),
        (F.col("l_linenumber") % 3).alias("goals"),
        (F.col("l_partkey") % 2).alias("assists"),
        (F.col("l_linenumber") % 2).alias("yellow_cards"),
        F.when(F.col("l_quantity") > 48, 1).otherwise(0).alias("red_cards"),
    )


def rating_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.sum(F.col("l_extendedprice").cast("decimal(18,2)"))
    return (
        li.groupBy(club_of(F.col("l_suppkey")).alias("club_id"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
        .agg(cents.alias("s"), F.count("*").alias("n"))
        .select("club_id", "month", (F.floor(F.col("s").cast("double") / F.col("n") / 30.0 * 100.0) / 100.0).alias("elo"))
    )


def outcome_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with labels and two probability triples, ready for scoring."""
    m = matches(spark, sf_dir).select("match_id", "match_date", "match_seq", "competition", F.col("result").alias("y"))
    return second_probabilities(probabilities(m))


def forecast_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forecast log: orders that are finished (F) are settled, the rest pending."""
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), "o_orderstatus")
    m = matches(spark, sf_dir).select(
        "match_id", "match_date", "competition", "home_team", "away_team", "home_score", "away_score", "result"
    )
    rounded = {c: F.round(c, 4) for c in ("p_home", "p_draw", "p_away")}
    log = probabilities(m.join(status, "match_id")).withColumns(rounded)
    settled = F.col("o_orderstatus") == "F"
    label = F.when(F.col("result") == 1, "Home Win").when(F.col("result") == 0, "Draw").otherwise("Away Win")
    return log.withColumns(
        {
            "status": F.when(settled, "settled").otherwise("pending"),
            "actual": F.when(settled, label),
            "settled_at": F.when(settled, F.date_add("match_date", 1)),
        }
    ).drop("o_orderstatus", "result")
