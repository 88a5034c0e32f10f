"""Connected components of the team-opponent graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.scale import checkpoint


def team_components(matches: DataFrame) -> DataFrame:
    """(team, component): the smallest team name reachable through matches.

    Min-label propagation with pointer jumping over distinct pairings.  Labels are
    checkpointed each round, so lost executors never replay earlier rounds.
    """
    both = F.explode(
        F.array(
            F.struct(F.col("home_team").alias("team"), F.col("away_team").alias("opponent")),
            F.struct(F.col("away_team").alias("team"), F.col("home_team").alias("opponent")),
        )
    )
    edges = checkpoint(matches.select("home_team", "away_team").distinct().select(both.alias("e")).select("e.*").distinct())
    labels = edges.groupBy("team").agg(F.least(F.col("team"), F.min("opponent")).alias("component"))
    while True:
        heard = (
            edges.join(labels.withColumnRenamed("team", "opponent"), "opponent")
            .groupBy("team")
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(heard, "team", "left").select(
            "team", F.col("component").alias("old"), F.least("component", "heard").alias("near")
        )
        roots = lower.select(F.col("team").alias("near"), F.col("near").alias("root"))
        stepped = lower.join(roots, "near").select(
            "team", F.least("near", "root").alias("component"), (F.col("old") != F.least("near", "root")).alias("moved")
        )
        stepped = checkpoint(stepped)
        labels = stepped.select("team", "component")
        if stepped.filter("moved").isEmpty():
            return labels
