"""League tables, standings, brackets and lists (K1-K9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import points
from .scoring import neutral_symmetrize


def league_table(group_team: DataFrame, finished: DataFrame) -> DataFrame:
    """grp, team, seed_pos, played, won, drawn, lost, gf, ga, gd and pts of every team of group_team(grp, team, seed_pos), from finished(grp, home_team, away_team, home_score, away_score)."""

    def side(me: str, other: str):
        return F.struct(F.col(f"{me}_team").alias("team"), F.col(f"{me}_score").alias("gf"), F.col(f"{other}_score").alias("ga"))

    long = finished.select("grp", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("grp", "s.*")
    sums = long.groupBy("grp", "team").agg(
        F.count("*").alias("played"), F.count_if(F.col("gf") > F.col("ga")).alias("won"), F.count_if(F.col("gf") == F.col("ga")).alias("drawn"), F.count_if(F.col("gf") < F.col("ga")).alias("lost"),
        F.sum("gf").alias("gf"), F.sum("ga").alias("ga"), F.sum(points(F.col("gf"), F.col("ga"))).alias("pts"),
    )
    out = group_team.join(sums, ["grp", "team"], "left").fillna(0, ["played", "won", "drawn", "lost", "gf", "ga", "pts"])
    return out.withColumn("gd", F.col("gf") - F.col("ga"))


def rank_standings(table: DataFrame) -> DataFrame:
    """table with position (by points, goal difference, goals, then listing order) and zone."""
    order = Window.partitionBy("grp").orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "seed_pos")
    position = F.row_number().over(order)
    return table.withColumn("position", position).withColumn("zone", F.when(F.col("position") <= 2, "ADV").when(F.col("position") == 3, "3RD?").otherwise("OUT"))


def expected_points(group_team: DataFrame, pairs: DataFrame) -> DataFrame:
    """grp, team, exp_points and place of group_team(grp, team, rank): the sum over the other teams of its group of 3 P(win) + P(draw), by pairs(home, away, p_h, p_d, p_a)."""
    a = group_team.select("grp", F.col("team").alias("home"), "rank")
    b = group_team.select("grp", F.col("team").alias("away"))
    sums = a.join(b, "grp").where("home <> away").join(pairs, ["home", "away"]).groupBy("grp", "home", "rank").agg(F.round(F.sum(3 * F.col("p_h") + F.col("p_d")), 6).alias("exp_points"))
    return sums.select("grp", F.col("home").alias("team"), "exp_points", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("exp_points"), "rank", "home")).alias("place"))


def best_third(standings: DataFrame, n: int = 8) -> DataFrame:
    """The n best teams in third place, with their place; a row for each group is ranked."""
    order = Window.orderBy(F.desc("pts"), F.desc("gd"), F.desc("gf"), "rank", "team")
    return standings.where("position = 3").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def assign_third_slots(thirds: DataFrame, lookup: DataFrame) -> DataFrame:
    """slot and team of each third(scenario_id, grp, team), by lookup(groups, slots: map slot -> group) of the sorted set of their groups; an error if the set isn't listed."""
    sets = thirds.groupBy("scenario_id").agg(F.array_join(F.array_sort(F.collect_set("grp")), "").alias("groups"))
    found = sets.join(lookup, "groups", "left").withColumn("slots", F.when(F.col("slots").isNull(), F.raise_error(F.concat(F.lit("no slots for groups "), "groups"))).otherwise(F.col("slots")))
    slots = found.select("scenario_id", F.explode("slots").alias("slot", "grp"))
    return slots.join(thirds, ["scenario_id", "grp"]).select("scenario_id", "slot", "grp", "team")


def knockout_probabilities(pairs: DataFrame) -> DataFrame:
    """team1, team2 and p1, the chance that team1 goes on, of pairs(home, away, p_h, p_d, p_a): averaged over both orientations, a draw counts half for either."""
    return neutral_symmetrize(pairs).select(F.col("home").alias("team1"), F.col("away").alias("team2"), F.round(F.col("p_h") + F.col("p_d") / 2, 12).alias("p1"))


def pair_array(teams: DataFrame, probabilities: DataFrame, most_teams: int) -> DataFrame:
    """One row: names, the sorted distinct teams(team), and cells, p1 of every pair by the places of both (one half where probabilities(team1, team2, p1) has none). An error beyond most_teams teams."""
    one = teams.distinct().limit(most_teams + 1).agg(F.sort_array(F.collect_list("team")).alias("names"))
    checked = F.when(F.size("names") > most_teams, F.raise_error(F.lit(f"a bracket's pairs are packed for {most_teams} teams at most"))).otherwise(F.col("names"))
    rows = one.select(F.posexplode(checked).alias("i", "team1"), F.col("names"))
    cells = rows.select("i", "team1", F.posexplode("names").alias("j", "team2")).join(probabilities, ["team1", "team2"], "left")
    packed = cells.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "j", F.coalesce("p1", F.lit(0.5)).alias("p")))), lambda c: c["p"]).alias("cells"))
    return one.crossJoin(packed)  # one row each


def propagate_bracket(first_round: DataFrame, feeds: DataFrame, probabilities: DataFrame, most_teams: int = 1000) -> DataFrame:
    """All matches of brackets: scenario_id, slot, round, team1, team2, p1 (of 4 decimals) and winner.

    first_round(scenario_id, slot, team1, team2) is played, team1 advancing if p1 >=
    0.5 by probabilities(team1, team2, p1); feeds(slot, from1, from2, round, losers)
    name the next rounds' slots. A match without both teams isn't played. A bracket
    is one row, folded over the feeds; the pairs of all teams, a square of at most
    most_teams, and the feeds are one row, broadcast. No round is a join.
    """
    teams = first_round.select(F.explode(F.array("team1", "team2")).alias("team")).where("team is not null")
    slots = feeds.agg(F.sort_array(F.collect_list(F.struct("round", "slot", "from1", "from2", "losers"))).alias("feeds"))
    fixed = F.broadcast(pair_array(teams, probabilities, most_teams).crossJoin(slots))  # one row each
    brackets = first_round.where("team1 is not null and team2 is not null").groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("slot", "team1", "team2"))).alias("first")).crossJoin(fixed)
    place = lambda team: (F.array_position("names", team) - 1).cast("int")

    def played(slot: Column, number: Column, m: Column) -> Column:
        p = F.element_at("cells", m["a"] * F.size("names") + m["b"] + 1)
        ahead = p >= 0.5
        return F.struct(slot.cast("int").alias("slot"), number.cast("int").alias("round"), m["a"].alias("a"), m["b"].alias("b"), p.alias("p"), F.when(ahead, m["a"]).otherwise(m["b"]).alias("won"), F.when(ahead, m["b"]).otherwise(m["a"]).alias("lost"))

    def then(ended: Column, f: Column) -> Column:
        source = lambda slot: F.get(F.filter(ended, lambda r: r["slot"] == slot), F.lit(0))
        team = lambda slot: F.transform(F.array(source(slot)), lambda r: F.when(f["losers"], r["lost"]).otherwise(r["won"]))[0]
        both = F.filter(F.array(F.struct(team(f["from1"]).alias("a"), team(f["from2"]).alias("b"))), lambda m: m["a"].isNotNull() & m["b"].isNotNull())
        return F.concat(ended, F.transform(both, lambda m: played(f["slot"], f["round"], m)))

    start = F.transform("first", lambda m: F.struct(m["slot"].alias("slot"), F.struct(place(m["team1"]).alias("a"), place(m["team2"]).alias("b")).alias("m")))
    matches = F.aggregate("feeds", F.transform(start, lambda x: played(x["slot"], F.lit(1), x["m"])), then)
    name = lambda i: F.element_at("names", F.col(i) + 1)
    return brackets.select("scenario_id", "names", F.explode(matches).alias("m")).select("scenario_id", "names", "m.*").select("scenario_id", "slot", "round", name("a").alias("team1"), name("b").alias("team2"), F.round("p", 4).alias("p1"), name("won").alias("winner"))


def top_contenders(shares: DataFrame, n: int = 12, exit_above: float = 0.20) -> DataFrame:
    """kind, place and team of shares(team, grp, champion, reach_final, group_exit): the n likeliest champions (champion), of those the likeliest early exit above exit_above (upset), the two likeliest finalists (final), and the first group by the sum of its two likeliest champions (group)."""
    top = shares.orderBy(F.desc("champion"), "team").limit(n)
    place = lambda df, kind, *by: df.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(*by, "team")).alias("place"), "team")  # noqa: E731  at most n rows
    upset = top.where(F.col("group_exit") > exit_above).orderBy(F.desc("group_exit"), "team").limit(1)
    final = shares.orderBy(F.desc("reach_final"), "team").limit(2)
    ranked = shares.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("champion"), "team"))).where("_r <= 2")
    best = ranked.groupBy("grp").agg(F.round(F.sum("champion"), 6).alias("_s")).orderBy(F.desc("_s"), "grp").limit(1)
    group = ranked.join(F.broadcast(best), "grp")
    return place(top, "champion", F.desc("champion")).unionByName(place(upset, "upset", F.desc("group_exit"))).unionByName(place(final, "final", F.desc("reach_final"))).unionByName(place(group, "group", F.desc("champion")))


def list_entities(teams: DataFrame, order: list[str], confederation: str | None = None, contains: str | None = None) -> DataFrame:
    """teams(team, confederation, rank) of a confederation and with a part of the name (in any case), by confederation in the given order, rank (nulls last) and name."""
    out = teams
    if confederation is not None:
        out = out.where(F.lower("confederation") == confederation.lower())
    if contains is not None:
        out = out.where(F.contains(F.lower("team"), F.lit(contains.lower())))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("confederation")), F.lit(0))
    return out.orderBy(F.when(place == 0, len(order) + 1).otherwise(place), F.col("rank").asc_nulls_last(), "team")


UNDETERMINED = ("", "tbd", "none", "null")


def knockout_by_stage(matches: DataFrame, stages: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """stage, stage_order and its matches (sorted, joined by |) whose teams are both known; for each event, named by by."""
    known = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(c)).isin(*UNDETERMINED)
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    rows = matches.where(known("home_team") & known("away_team")).withColumn("stage_order", order).where("stage_order > 0")
    return rows.groupBy(*by, "stage", "stage_order").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("-", "home_team", "away_team"))), "|").alias("matches"))
