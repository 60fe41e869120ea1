"""Set operations over match tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def team_table(matches: DataFrame) -> DataFrame:
    """team, confederation and rank of each raw team: of its last appearance, an away side counting as later than any home side. Names are resolved after this, so two aliases of a team leave two rows."""
    sides = F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"{s}_team").alias("team"), F.col(f"{s}_confederation").alias("confederation"), F.col(f"{s}_fifa_rank").alias("rank")) for i, s in enumerate(("home", "away"))))
    long = matches.select("date", "match_id", F.explode(sides).alias("s")).select("date", "match_id", "s.*")
    return long.groupBy("team").agg(F.max_by(F.struct("confederation", "rank"), F.struct("side", "date", "match_id")).alias("l")).select("team", "l.confederation", "l.rank")


def coverage_sets(expected: DataFrame, present: DataFrame) -> DataFrame:
    """team and status: present or missing, for every expected team."""
    found = expected.select("team").intersect(present.select("team")).withColumn("status", F.lit("present"))
    return found.unionByName(expected.select("team").exceptAll(present.select("team").distinct()).distinct().withColumn("status", F.lit("missing")))


def new_rows_only(incoming: DataFrame, stored: DataFrame, key: tuple = ("date", "home_team", "away_team")) -> DataFrame:
    return incoming.join(stored.select(*key), list(key), "left_anti")


def upsert_rankings(old: DataFrame, new: DataFrame) -> DataFrame:
    """team, rank and changed after new(team, rank) is laid over old(team, rank)."""
    joined = old.withColumnRenamed("rank", "old").join(new.withColumnRenamed("rank", "new"), "team", "full_outer")
    return joined.select("team", F.coalesce("new", "old").alias("rank"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def find_duplicate_ids(players: DataFrame, key: str, name: str) -> DataFrame:
    """Ids shared by several names, with their number."""
    return players.groupBy(key).agg(F.countDistinct(name).alias("n_names"), F.count("*").alias("n_rows")).where("n_names > 1")


def dedup_in_position(players: DataFrame, group: tuple = ("team", "position"), key: tuple = ("name", "player_id"), order: str = "ordinal") -> DataFrame:
    """players with one row, the first by order, for each key within a group."""
    by = [*group, *key]
    first = F.min_by(F.struct(*(c for c in players.columns if c not in by)), order).alias("_r")
    return players.groupBy(*by).agg(first).select(*(F.col(c) if c in by else F.col(f"_r.{c}").alias(c) for c in players.columns))
