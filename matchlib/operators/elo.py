"""Two-sided rating replay and what follows from it."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch, written
from .splits import with_position


@dataclass(frozen=True)
class EloConfig:
    """k: base step. advantage and discount: by confederation, with a default for others. start: rating of a team without one of its own. The defaults are fixed values."""

    k: float = 25.0
    advantage: dict[str, float] = field(default_factory=lambda: {"UEFA": 80.0, "CONMEBOL": 110.0, "CONCACAF": 70.0, "CAF": 90.0, "AFC": 80.0, "OFC": 60.0, "UNKNOWN": 100.0})
    advantage_default: float = 100.0
    discount: dict[str, float] = field(default_factory=lambda: {"UEFA": 1.0, "CONMEBOL": 1.0, "CAF": 0.9, "AFC": 0.85, "CONCACAF": 0.8, "OFC": 0.65, "UNKNOWN": 0.9})
    discount_default: float = 1.0
    start: float = 1500.0


RATINGS = ["home_elo_pre", "away_elo_pre", "home_elo_post", "away_elo_post"]
REPLAY = "league string, match_id long, " + ", ".join(f"{c} array<double>" for c in RATINGS)


def _lookup(values: dict[str, float], default: float, key: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default)) if values else F.lit(default)


def margin(goal_difference: Column) -> Column:
    gd = F.abs(goal_difference)
    return F.when(gd <= 1, 1.0).when(gd == 2, 1.5).otherwise((11.0 + gd) / 8.0)


def elo_steps(matches: DataFrame, config: EloConfig) -> DataFrame:
    """league, match_id, date, both teams, step (all factors of K), advantage and score: what the replay needs of each match; matches have k_multiplier."""
    discount = (_lookup(config.discount, config.discount_default, F.col("home_confederation")) + _lookup(config.discount, config.discount_default, F.col("away_confederation"))) / 2
    gd = F.col("home_score") - F.col("away_score")
    advantage = F.when(F.col("neutral"), 0.0).otherwise(_lookup(config.advantage, config.advantage_default, F.col("home_confederation")))
    score = F.when(gd > 0, 1.0).when(gd == 0, 0.5).otherwise(0.0)
    return matches.select("league", "match_id", "date", "home_team", "away_team", (config.k * F.col("k_multiplier") * discount * margin(gd)).alias("step"), advantage.alias("advantage"), score.alias("score"))


def with_start(steps: DataFrame, start: DataFrame | None, default: float) -> DataFrame:
    """steps with home_start and away_start, by start(team, rating) or start(league, team, rating)."""
    if start is None:
        return steps.withColumns({"home_start": F.lit(default), "away_start": F.lit(default)})
    for side in ("home", "away"):
        mine = start.select(*(F.col(c).alias(f"{side}_team" if c == "team" else c) for c in start.columns if c != "rating"), F.col("rating").alias(f"{side}_start"))
        steps = steps.join(mine, [c for c in mine.columns if c != f"{side}_start"], "left").fillna(default, [f"{side}_start"])
    return steps


def _replay(ratings: dict, rows, scales: list[float], out: list[list]) -> None:
    """Applies matches in order to the ratings by team; appends those before and after each match to the four columns out."""
    for h, a, step, advantage, score, h_start, a_start in rows:
        mine, theirs = ratings.get(h) or [h_start] * len(scales), ratings.get(a) or [a_start] * len(scales)
        change = [k * step * (score - 1.0 / (1.0 + 10.0 ** ((y - x - advantage) / 400.0))) for k, x, y in zip(scales, mine, theirs)]
        ratings[h], ratings[a] = [x + c for x, c in zip(mine, change)], [y - c for y, c in zip(theirs, change)]
        for column, value in zip(out, (mine, theirs, ratings[h], ratings[a])):
            column.append(value)


_STEP = ("home_team", "away_team", "step", "advantage", "score", "home_start", "away_start")


def replayed_in_order(steps: DataFrame, scales: list[float]) -> DataFrame:
    """league, match_id and arrays of ratings before and after each match, one for each scale of the step; all scales in one pass.

    A league is one sequence: sorted by Spark, which spills, and streamed through a
    task that holds a batch and the ratings of the league's teams, never the
    matches. Leagues run side by side.
    """

    def run(batches):
        league, ratings = None, {}
        for batch in batches:
            names = batch.column("league").to_pylist()
            columns = [batch.column(c).to_pylist() for c in _STEP]
            out: list[list[list[float]]] = [[], [], [], []]
            i = 0
            while i < len(names):
                if names[i] != league:
                    league, ratings = names[i], {}
                j = i + 1
                while j < len(names) and names[j] == league:
                    j += 1
                _replay(ratings, zip(*(c[i:j] for c in columns)), scales, out)
                i = j
            yield pa.RecordBatch.from_arrays([batch.column("league"), batch.column("match_id"), *(pa.array(c, pa.list_(pa.float64())) for c in out)], names=["league", "match_id", *RATINGS])

    ordered = steps.withColumn("match_id", F.col("match_id").cast("long")).repartition("league").sortWithinPartitions("league", "date", "match_id")
    return ordered.mapInArrow(run, REPLAY)


#: Matches of a slice for each team of the league. Up to one half a random graph of so many matches falls into small parts.
SLICE = 0.4


def sliced(steps: DataFrame, share: float = SLICE) -> DataFrame:
    """steps with slice, a number of days in order that hold about share matches for each of the league's teams, a day at least. Days are counted first, and only a league's table of days meets in one task."""
    teams = steps.select("league", F.explode(F.array("home_team", "away_team")).alias("t")).groupBy("league").agg(F.countDistinct("t").alias("_teams"))
    days = steps.groupBy("league", "date").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("league").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = days.withColumn("_ahead", ahead).join(teams, "league").select("league", "date", F.floor(F.col("_ahead") / F.greatest(F.lit(1.0), F.col("_teams") * share)).cast("int").alias("slice"))
    # without gaps: slices are steps of a loop
    cut = cut.withColumn("slice", F.dense_rank().over(Window.partitionBy("league").orderBy("slice")) - 1)
    return steps.join(cut, ["league", "date"])


def linked(edges: DataFrame) -> DataFrame:
    """node and part, one of the nodes that it is connected with, the same for all of them, of edges(a, b).

    Every node moves to the one of its neighbours and itself that comes first in an
    order by hash, new in each round; edges then link the places moved to. So in a
    round some share of the nodes left merges, whatever the graph, and what has
    merged whole is not read again. Rounds grow with the logarithm of the nodes.
    """
    both = written(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(F.col("e.a").alias("node"), F.col("e.b").alias("other")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not moves or both.limit(1).count():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(moves)), c).alias("h"), F.col(c).alias("n"))
        moves.append(written(both.groupBy("node").agg(F.least(place("node"), F.min(place("other")))["n"].alias("part")), "moves"))
        ends = [moves[-1].select(F.col("node").alias(c), F.col("part").alias(f"_{c}")) for c in ("node", "other")]
        left = both.join(ends[0], "node").join(ends[1], "other").where("_node <> _other")
        both = written(left.select(F.col("_node").alias("node"), F.col("_other").alias("other")).distinct(), "edges")
    out = moves.pop()
    while moves:
        after = out.select(F.col("node").alias("part"), F.col("part").alias("_after"))
        out = moves.pop().join(after, "part", "left").select("node", F.coalesce("_after", "part").alias("part"))
    return out


def connected(edges: DataFrame) -> DataFrame:
    """node and part, the smallest node that it is connected with, of edges(a, b)."""
    parts = written(linked(edges), "parts")
    return parts.join(parts.groupBy("part").agg(F.min("node").alias("_least")), "part").select("node", F.col("_least").alias("part"))


#: Files of a slice at most.
SLICE_FILES = 16


def replayed_in_waves(steps: DataFrame, scales: list[float], share: float = SLICE) -> DataFrame:
    """The same as replayed_in_order, for leagues of many teams: slice after slice, and in a slice its parts, teams connected by its matches, side by side.

    No team of one part meets one of another within the slice, so parts don't
    depend on each other, and within a part matches come in order. Parts of all
    slices are found at once, and so is the slice in which a team plays next: a
    slice leaves its teams' ratings there, in the shared folder, and reads those
    left for it, no others. So a slice is one job over its own matches and teams; a
    lost executor costs a slice at most. There are about as many slices as matches
    of a team over share. Teams of a slice are told apart by a hash of 64 bits: equal
    ones would only make one part of two.
    """
    spark = steps.sparkSession
    steps = written(sliced(steps.withColumn("match_id", F.col("match_id").cast("long")), share), "slices")
    node = lambda c: F.xxhash64("league", "slice", c)
    parts = written(linked(steps.select(node("home_team").alias("a"), node("away_team").alias("b"))), "parts")
    matches = steps.withColumns({"node": node("home_team"), "kind": F.lit(2)}).join(parts, "node").drop("node")
    sides = steps.select("league", "slice", F.explode(F.array("home_team", "away_team")).alias("home_team")).distinct()
    ahead = Window.partitionBy("league", "home_team").orderBy("slice")
    teams = sides.withColumns({"node": node("home_team"), "kind": F.lit(0)}).join(parts, "node").drop("node")
    teams = teams.withColumns({"next": F.lead("slice").over(ahead), "next_part": F.lead("part").over(ahead)})
    base, left = scratch(spark, "waves"), scratch(spark, "left")
    rows = matches.unionByName(teams, allowMissingColumns=True)
    rows.repartition("slice", F.pmod("part", F.lit(SLICE_FILES))).write.partitionBy("slice").parquet(base)
    rows = spark.read.schema(rows.drop("slice").schema).parquet
    columns = ["part", "kind", "date", "match_id", "league", *_STEP, "next", "next_part", "rating"]

    def run(batches):
        part, ratings, places = None, {}, {}

        def row(slices, parts_of, league, ids, columns, teams, values):
            arrays = [pa.array(slices, pa.int32()), pa.array(parts_of, pa.int64()), pa.array(league, pa.string()), pa.array(ids, pa.int64()), *(pa.array(c, pa.list_(pa.float64())) for c in columns), pa.array(teams, pa.string()), pa.array(values, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["next", "part", "league", "match_id", *RATINGS, "home_team", "rating"])

        for batch in batches:
            keys, kinds, leagues, ids, known, later, later_part = (batch.column(c).to_pylist() for c in ("part", "kind", "league", "match_id", "rating", "next", "next_part"))
            steps_of = zip(*(batch.column(c).to_pylist() for c in _STEP))
            out, mine, names, moved = [[], [], [], []], [], [], []
            for key, kind, league, match_id, rating, at, at_part, step in zip(keys, kinds, leagues, ids, known, later, later_part, steps_of):
                if key != part:
                    moved.extend((*where, *who, ratings[who]) for who, where in places.items())
                    part, ratings, places = key, {}, {}
                if kind == 0:
                    if at is not None:
                        places[league, step[0]] = (at, at_part)
                elif kind == 1:
                    ratings[league, step[0]] = rating
                else:
                    _replay(ratings, [((league, step[0]), (league, step[1]), *step[2:])], scales, out)
                    mine.append(match_id), names.append(league)
            n = [None] * len(mine)
            if mine:
                yield row([-1] * len(mine), n, names, mine, out, n, n)
            if moved:
                yield passed(row, moved)
        if places:
            yield passed(row, [(*where, *who, ratings[who]) for who, where in places.items()])

    def passed(row, moved):
        at, at_part, league, team, rating = zip(*moved)
        n = [None] * len(moved)
        return row(at, at_part, league, n, [n] * 4, team, rating)

    schema = f"next int, part long, {REPLAY}, home_team string, rating array<double>"
    awaited = {r["next"] for r in teams.select("next").distinct().collect()}  # slices at most
    for i in range((steps.agg(F.max("slice")).first()[0] or 0) + 1):
        now = rows(f"{base}/slice={i}").withColumn("rating", F.lit(None).cast("array<double>"))
        if i in awaited:
            before = spark.read.schema("part long, league string, home_team string, rating array<double>").parquet(f"{left}/next={i}").withColumn("kind", F.lit(1))
            now = now.unionByName(before, allowMissingColumns=True)
        ended = now.select(*columns).repartition("part").sortWithinPartitions("part", "kind", "date", "match_id").mapInArrow(run, schema)
        ended.write.mode("append").partitionBy("next").parquet(left)
    return spark.read.schema(REPLAY).parquet(f"{left}/next=-1")


#: Matches of a league that one task replays, some minutes; and slices, each a job or two, beyond which waves don't pay.
MOST_IN_TASK, MOST_SLICES = 50_000_000, 1000


def replayed(matches: DataFrame, steps: DataFrame, scales: list[float], most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """steps of matches replayed: leagues of at most most_in_task matches in order, larger ones in waves if their teams are so many that there are at most MOST_SLICES slices. Both ways give the same ratings."""
    sides = F.explode(F.array("home_team", "away_team")).alias("t")
    sizes = matches.groupBy("league").agg(F.count("*").alias("n")).where(F.col("n") > most_in_task)
    large = [r["league"] for r in sizes.collect()]  # fewer than all matches / most_in_task
    if large:
        teams = matches.where(F.col("league").isin(large)).select("league", sides).groupBy("league").agg(F.countDistinct("t").alias("teams"))
        large = [r["league"] for r in sizes.join(teams, "league").where(F.col("n") <= MOST_SLICES * SLICE * F.col("teams")).collect()]
    if not large:
        return replayed_in_order(steps, scales)
    is_large = F.coalesce(F.col("league").isin(large), F.lit(False))
    return replayed_in_waves(steps.where(is_large), scales).unionByName(replayed_in_order(steps.where(~is_large), scales))


def elo_replay(matches: DataFrame, config: EloConfig = EloConfig(), start: DataFrame | None = None, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """league, match_id and the ratings of both teams before and after each match of matches (with league and k_multiplier). A team starts from start(team, rating) or start(league, team, rating), else from config.start. Leagues of more than most_in_task matches and enough teams are replayed in waves."""
    out = replayed(matches, with_start(elo_steps(matches, config), start, config.start), [1.0], most_in_task)
    return out.select("league", "match_id", *(F.col(c)[0].alias(c) for c in RATINGS))


def elo_win_prob(home: Column, away: Column, neutral: Column, advantage: float = 100.0) -> Column:
    """The home side's expected score, with the global home advantage."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), (away - home - F.when(neutral, 0.0).otherwise(advantage)) / 400.0))


def final_ratings(matches: DataFrame, replayed: DataFrame, offsets: DataFrame, shootouts: DataFrame, k: float = 25.0) -> DataFrame:
    """league, team and rating: the last one, plus offsets(team, offset), plus K/2 for each of shootouts(team, won) won, less K/2 for each lost."""
    joined = matches.select("match_id", "date", "home_team", "away_team").join(replayed, "match_id")
    sides = F.array(*(F.struct(F.col(f"{s}_team").alias("team"), F.col(f"{s}_elo_post").alias("elo")) for s in ("home", "away")))
    last = joined.select("league", "date", "match_id", F.explode(sides).alias("s")).groupBy("league", "s.team").agg(F.max_by("s.elo", F.struct("date", "match_id")).alias("elo"))
    moved = shootouts.groupBy("team").agg(F.sum(F.when(F.col("won"), k / 2).otherwise(-k / 2)).alias("_shootout"))
    added = offsets.groupBy("team").agg(F.sum("offset").alias("_offset"))
    return last.join(added, "team", "left").join(moved, "team", "left").select("league", "team", (F.col("elo") + F.coalesce("_offset", F.lit(0.0)) + F.coalesce("_shootout", F.lit(0.0))).alias("rating"))


def elo_k_sweep(matches: DataFrame, grid: list[float], from_year: int = 1993, test_share: float = 0.2, most_in_task: int = MOST_IN_TASK) -> DataFrame:
    """k, n, log_loss, binary_accuracy, accuracy_3 and best for each K of the grid: replays from from_year, all teams at 1500, home advantage 100, no confederation discount; scored on the last test_share of rows by date. One replay carries the ratings of all K."""
    recent = matches.where(F.year("date") >= from_year)
    tested = with_position(recent, total="_n").where(F.col("position") >= F.floor(F.col("_n") * F.lit(1 - test_share))).select("match_id", "neutral", "home_score", "away_score")
    steps = with_start(elo_steps(recent, EloConfig(advantage={}, discount={}, k=1.0)), None, 1500.0)
    each = F.posexplode(F.arrays_zip("home_elo_pre", "away_elo_pre")).alias("_i", "_r")
    rated = replayed(recent, steps, [float(k) for k in grid], most_in_task).join(tested, "match_id").select("neutral", "home_score", "away_score", each)
    rated = rated.withColumn("k", F.array(*(F.lit(float(k)) for k in grid))[F.col("_i")])
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), elo_win_prob(F.col("_r.home_elo_pre"), F.col("_r.away_elo_pre"), F.col("neutral"))))
    rows = rated.withColumn("p", p).withColumn("win", (F.col("home_score") > F.col("away_score")).cast("int"))
    label = F.when(F.col("home_score") > F.col("away_score"), "H").when(F.col("home_score") < F.col("away_score"), "A").otherwise("D")
    guess = F.when(F.col("p") > 0.55, "H").when(F.col("p") < 0.45, "A").otherwise("D")
    out = rows.groupBy("k").agg(
        F.count("*").alias("n"), F.round(-F.avg(F.when(F.col("win") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))), 6).alias("log_loss"),
        F.round(F.avg(((F.col("p") > 0.5).cast("int") == F.col("win")).cast("int")), 6).alias("binary_accuracy"), F.round(F.avg((guess == label).cast("int")), 6).alias("accuracy_3"),
    )
    # a row for each K meets in one window
    best = F.first("k").over(Window.orderBy("log_loss", "k"))
    return out.withColumn("best", F.col("k") == best)
