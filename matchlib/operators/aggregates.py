"""Grouped rates, squad aggregates and outcome tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import result_label
from .joins import active_roster, rated_and_healthy


def _shares(label: str = "target"):
    return [F.round(F.avg((F.col(label) == x).cast("int")), 6).alias(x.lower()) for x in ("H", "D", "A")]


def tier_base_rates(matches: DataFrame) -> DataFrame:
    """competition_weight (null: overall), n and the shares h, d and a."""
    labelled = matches.withColumn("target", result_label(F.col("home_score"), F.col("away_score")))
    return labelled.rollup("competition_weight").agg(F.count("*").alias("n"), *_shares())


def class_prior(rows: DataFrame, label: str = "target") -> DataFrame:
    """One row: shares of H, D and A, and the most frequent (A before D before H on ties)."""
    return rows.agg(*_shares(label)).withColumn("most_frequent", F.when((F.col("a") >= F.col("d")) & (F.col("a") >= F.col("h")), "A").when(F.col("d") >= F.col("h"), "D").otherwise("H"))


def balanced_weights(rows: DataFrame, label: str = "target", by_stage: bool = True) -> DataFrame:
    """rows with sample_weight = n / (classes * n of the class), times stage_weight and rescaled to mean 1 if by_stage."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    weighted = rows.join(F.broadcast(counts.crossJoin(F.broadcast(total))), label)  # a row for each class
    weight = F.col("_n") / (F.col("_k") * F.col("_c"))
    if not by_stage:
        return weighted.withColumn("sample_weight", weight).drop("_c", "_n", "_k")
    weighted = weighted.withColumn("_w", weight * F.col("stage_weight"))
    return weighted.crossJoin(F.broadcast(weighted.agg(F.avg("_w").alias("_m")))).withColumn("sample_weight", F.col("_w") / F.col("_m")).drop("_c", "_n", "_k", "_w", "_m")


def global_goal_rates(matches: DataFrame) -> DataFrame:
    return matches.agg(F.avg("home_score").alias("home_rate"), F.avg("away_score").alias("away_rate"))


def score_model_params(rows: DataFrame) -> DataFrame:
    """One row: base rates, home factor (from 20 matches not on neutral ground on; 1 to 1.5), mean attack and defense of both sides."""
    own = ~F.col("neutral")
    one = rows.agg(
        F.avg("home_score").alias("base_home"), F.avg("away_score").alias("base_away"), F.count_if(own).alias("_n"),
        F.avg(F.when(own, F.col("home_score"))).alias("_h"), F.avg(F.when(own, F.col("away_score"))).alias("_a"),
        ((F.avg("home_attack") + F.avg("away_attack")) / 2).alias("mean_attack"), ((F.avg("home_defense") + F.avg("away_defense")) / 2).alias("mean_defense"),
    )
    factor = F.greatest(F.lit(1.0), F.least(F.lit(1.5), F.sqrt(F.col("_h") / F.nullif(F.col("_a"), F.lit(0.0)))))
    return one.withColumn("home_factor", F.when(F.col("_n") >= 20, F.coalesce(factor, F.lit(1.0))).otherwise(1.0)).drop("_n", "_h", "_a")


def squad_features(fixtures: DataFrame, rosters: DataFrame, ratings: DataFrame, injuries: DataFrame, players: DataFrame, lineups: DataFrame) -> DataFrame:
    """Per (team, match_id) of fixtures(team, match_id, date): ratings of the squad as of the date, and who is missing.

    The squad is the starters if the match has a lineup, else the active roster.
    Overall rating and the top three include injured players, position means only
    healthy ones (70 for the unrated); without a squad all is default.
    """
    started = fixtures.join(lineups.where("is_starter").select("team", "match_id", "player_id"), ["team", "match_id"]).withColumn("starter", F.lit(True))
    rest = fixtures.join(started.select("team", "match_id").distinct(), ["team", "match_id"], "left_anti")
    squad = started.unionByName(active_roster(rest, rosters).withColumn("starter", F.lit(False)))
    rated = rated_and_healthy(squad, ratings, injuries).join(players.select("player_id", "position"), "player_id", "left")
    top = Window.partitionBy("team", "match_id").orderBy(F.col("overall_rating").desc_nulls_last(), "player_id")
    rated = rated.withColumn("_top", (F.row_number().over(top) <= 3) & F.col("overall_rating").isNotNull())
    filled = F.coalesce("overall_rating", F.lit(70.0))
    at = lambda p: F.round(F.coalesce(F.avg(F.when(F.col("healthy") & (F.col("position") == p), filled)), F.lit(70.0)), 6)
    out = rated.groupBy("team", "match_id").agg(
        F.round(F.coalesce(F.avg("overall_rating"), F.lit(70.0)), 6).alias("squad_overall_rating"),
        F.round(F.coalesce(F.avg(F.when(F.col("healthy") & F.col("starter"), F.col("overall_rating"))), F.lit(70.0)), 6).alias("starting_xi_rating"),
        at("GK").alias("gk_rating"), at("FWD").alias("attack_player_rating"), at("DEF").alias("defense_player_rating"),
        F.count_if(F.col("_top") & ~F.col("healthy")).alias("missing_top3_count"), F.round(F.avg(F.col("healthy").cast("int")), 6).alias("squad_continuity"),
        F.max(F.col("starter").cast("int")).alias("has_lineup_data"), F.max(F.col("overall_rating").isNotNull().cast("int")).alias("has_rating_data"),
    )
    defaults = {**{c: 70.0 for c in ("squad_overall_rating", "starting_xi_rating", "gk_rating", "attack_player_rating", "defense_player_rating")}, "missing_top3_count": 0, "squad_continuity": 1.0, "has_lineup_data": 0, "has_rating_data": 0}
    any_injuries = injuries.select(F.lit(1).alias("x")).limit(1).agg((F.count("*") > 0).cast("int").alias("has_injury_data"))
    return fixtures.select("team", "match_id").distinct().join(out, ["team", "match_id"], "left").fillna(defaults).crossJoin(F.broadcast(any_injuries))  # one row


def squad_rating_table(teams: DataFrame, matched: DataFrame, nation_players: DataFrame, most: int = 26) -> DataFrame:
    """Per team: average, top, attack, defense and goalkeeper rating of its matched(team, position, rating: null if unmatched) players; a team without any gets its nation's best of nation_players(team, position, rating); none at all the defaults."""
    own = matched.withColumn("_rank", F.lit(1))
    none = teams.select("team").join(matched.select("team").distinct(), "team", "left_anti")
    best = Window.partitionBy("team").orderBy(F.desc("rating"), "player_id")
    other = nation_players.join(none, "team").withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= most)
    pool = own.select("team", "position", "rating").unionByName(other.select("team", "position", "rating"))
    mean = lambda p, d: F.round(F.coalesce(F.avg(F.when(F.col("position") == p, F.col("rating"))), F.avg("rating"), F.lit(d)), 1)
    agg = pool.groupBy("team").agg(F.round(F.avg("rating"), 1).alias("squad_avg_rating"), F.round(F.max("rating").cast("double"), 1).alias("top_player_rating"), mean("FWD", 69.0).alias("attack_rating"), mean("DEF", 67.0).alias("defense_rating"), mean("GK", 68.0).alias("gk_rating"))
    return teams.select("team").join(agg, "team", "left").fillna({"squad_avg_rating": 68.0, "top_player_rating": 76.0, "attack_rating": 69.0, "defense_rating": 67.0, "gk_rating": 68.0})


def outcome_shares(rows: DataFrame, label: str = "target") -> DataFrame:
    """Each value's count and share."""
    total = rows.agg(F.count("*").alias("_n"))
    return rows.groupBy(label).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_n"), 6)).drop("_n")  # one row


STAGES = ["group", "r32", "r16", "qf", "sf", "third", "final", "champion"]


def stage_tally(outcomes: DataFrame, stages: list[str] = STAGES) -> DataFrame:
    """For each team of outcomes(sim_id, team, stage): the share of runs that ended at each stage, 0 where none did."""
    n = outcomes.agg(F.countDistinct("sim_id").alias("_n"))
    counts = outcomes.groupBy("team").pivot("stage", stages).agg(F.count(F.lit(1)))
    return counts.crossJoin(F.broadcast(n)).select("team", *(F.round(F.coalesce(s, F.lit(0)) / F.col("_n"), 4).alias(s) for s in stages))  # one row


def modal_winner(winners: DataFrame) -> DataFrame:
    """The most frequent winner of each slot of winners(sim_id, slot, winner) (the first by name on ties) and how often it won."""
    counts = winners.groupBy("slot", "winner").agg(F.count("*").alias("n"))
    return counts.groupBy("slot").agg(F.min(F.struct((-F.col("n")).alias("m"), "winner")).alias("b")).select("slot", "b.winner", (-F.col("b.m")).alias("n"))


def reach_probabilities(tally: DataFrame) -> DataFrame:
    """From shares by exit stage to the chances of reaching each stage."""
    order = ["champion", "final", "sf", "qf", "r16", "r32"]
    out, total = {}, F.lit(0.0)
    for s in order:
        total = total + F.col(s) + (F.col("third") if s == "sf" else F.lit(0.0))
        out[f"reach_{s}"] = F.round(total, 4)
    return tally.select("team", *(v.alias(k) for k, v in out.items()))
