"""Operators on hand-made rows."""

import re
import time
import tracemalloc
from datetime import date, timedelta
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from matchlib.functions import cleaning as B
from matchlib.operators import aggregates, elo, evaluation, joins, scoring, sets, splits
from matchlib.operators import standings as K
from matchlib.operators import windows as W
from matchlib.plans import testdata
from matchlib.plans.registry import QUERIES
from matchlib.sources import shared
from matchlib.sources import feeds
from matchlib.streaming import incremental
from matchlib.streaming.features import FeatureStore, LastRows, stream_features

MATCH = "match_id long, date date, home_team string, away_team string, home_score int, away_score int, neutral boolean"


def matches(spark, rows):
    return spark.createDataFrame([(i, date(2025, 1, 1) + timedelta(days=d), h, a, x, y, n) for i, (d, h, a, x, y, n) in enumerate(rows)], MATCH)


def test_missing_columns_are_listed(spark):
    with pytest.raises(ValueError, match="home_score, away_score"):
        B.validate_schema(spark.createDataFrame([], "date date, home_team string, away_team string"), "matches")


def test_six_wins(spark):
    m = matches(spark, [(30 * i, "Brazil", "Weaker", 2, 0, True) for i in range(7)])
    long = W.team_features(W.long_table(m))
    r = long.where("match_id = 6 and team = 'Brazil'").first()
    assert (r["attack_w5"], r["defense_w5"], r["form_last5"], r["win_streak"], r["clean_sheet_rate_w5"]) == (2.0, 0.0, 3.0, 6, 1.0)
    first = long.where("match_id = 0 and team = 'Brazil'").first()
    assert (first["attack_w5"], first["form_last5"], first["draw_rate_w5"], first["rest_days"]) == (1.0, 1.5, 0.25, 7)


def test_no_future_row_is_used(spark):
    m = matches(spark, [(3 * i, f"t{i % 4}", f"t{(i + 1) % 4}", i % 3, i % 2, i % 5 == 0) for i in range(30)])
    part = m.where("match_id < 20")
    whole = W.team_features(W.long_table(m)).where("match_id < 20")
    assert sorted(map(str, whole.collect())) == sorted(map(str, W.team_features(W.long_table(part)).collect()))


def test_dedup_keeps_reversed_fixtures_and_other_dates(spark):
    m = matches(spark, [(0, "A", "B", 1, 0, False), (0, "A", "B", 2, 0, False), (1, "A", "B", 1, 0, False), (0, "B", "A", 1, 0, False)])
    assert sorted(r["match_id"] for r in B.dedup_matches(m).collect()) == [0, 2, 3]


def rated(spark, m):
    return m.withColumns({"league": F.lit("x"), "k_multiplier": F.lit(1.0), "home_confederation": F.lit("UEFA"), "away_confederation": F.lit("UEFA")})


def test_elo_is_zero_sum_and_independent_of_partitions(spark):
    m = rated(spark, matches(spark, [(i, f"t{i % 5}", f"t{(i + 2) % 5}", i % 4, i % 3, False) for i in range(40)]))
    one = sorted(map(tuple, elo.elo_replay(m.repartition(1)).collect()))
    assert one == sorted(map(tuple, elo.elo_replay(m.repartition(13)).collect()))
    for r in one:
        assert r[2] + r[3] == pytest.approx(r[4] + r[5])
    assert one[0][2:4] == (1500.0, 1500.0)


def test_rank_is_strictly_before_and_falls_back_to_the_earliest(spark):
    ranks = spark.createDataFrame([("France", date(2022, 10, 1), 3), ("France", date(2023, 10, 1), 2)], "team string, date date, rank int")
    fixtures = spark.createDataFrame([(1, "France", date(2023, 1, 1)), (2, "France", date(2023, 10, 1)), (3, "France", date(2020, 1, 1)), (4, "Nowhere", date(2020, 1, 1)), (5, None, date(2020, 1, 1))], "id int, team string, date date")
    static = spark.createDataFrame([], "team string, static_rank int")
    assert {r["id"]: r["rank"] for r in joins.asof_rank(fixtures, ranks, static).collect()} == {1: 3, 2: 3, 3: 3, 4: 75, 5: 75}


def test_interval_ends(spark):
    d = date(2024, 5, 1)
    f = spark.createDataFrame([("A", "p", d)], "team string, player_id string, date date")
    rosters = spark.createDataFrame([("a", "q", None, d), ("a", "r", d, None)], "team string, player_id string, joined_date date, left_date date")
    assert [r["player_id"] for r in joins.active_roster(f.drop("player_id"), rosters).collect()] == ["r"]
    injuries = spark.createDataFrame([("p", d - timedelta(days=5), d)], "player_id string, from_date date, to_date date")
    assert joins.active_injuries(f, injuries).count() == 1


def test_perfect_and_wrong_predictions(spark):
    p = spark.createDataFrame([("good", 2, 0.0, 0.0, 1.0), ("bad", 2, 1.0, 0.0, 0.0)], "model string, y int, p_a double, p_d double, p_h double")
    got = {r["model"]: (r["accuracy"], r["brier"]) for r in evaluation.basic_metrics(p, ["model"]).collect()}
    assert got == {"good": (1.0, 0.0), "bad": (0.0, 2.0)}
    assert evaluation.calibration(p, ["model"]).where("ece is not null").count() == 0  # each class always or never occurs


def test_split_fractions(spark):
    m = matches(spark, [(i // 3, "A", "B", 1, 0, False) for i in range(20)])
    got = {r["split"]: r["count"] for r in splits.chronological_split(m).groupBy("split").count().collect()}
    assert got == {"train": 13, "val": 4, "test": 3}
    with pytest.raises(ValueError):
        splits.chronological_split(m, 0.6, 0.5)


def test_incremental_append(spark, tmp_path):
    path = str(tmp_path / "stored")
    matches(spark, [(0, "A", "B", 1, 0, False)]).write.parquet(path)
    aliases = spark.createDataFrame([("Ay", "A")], "alias string, canonical string")
    incoming = matches(spark, [(0, "Ay", "B", 1, 0, False), (1, "Ay", "C", 2, 2, False), (2, "D", "E", None, 1, False)])
    assert incremental.incremental_append(path, incoming, aliases, since="2025-01-01") == 1
    assert incremental.incremental_append(path, incoming, aliases) == 0
    assert incremental.high_water_mark(spark.createDataFrame([], MATCH)).first()["mark"] == date(2020, 1, 1)


def test_upsert_and_optional_table(spark, tmp_path):
    old = spark.createDataFrame([("A", 1), ("B", 2)], "team string, rank int")
    new = spark.createDataFrame([("B", 5), ("C", 3)], "team string, rank int")
    assert sorted(map(tuple, sets.upsert_rankings(old, new).collect())) == [("A", 1, False), ("B", 5, True), ("C", 3, True)]
    assert feeds.read_optional(spark, str(tmp_path / "none"), "a int").count() == 0


def test_outcome_of_equal_rates_is_symmetric(spark):
    r = scoring.outcome_from_rates(spark.createDataFrame([(1, 1.3, 1.3)], "match_id int, lambda_home double, lambda_away double")).first()
    assert r["p_h"] == pytest.approx(r["p_a"]) and r["p_h"] + r["p_d"] + r["p_a"] == pytest.approx(1)


def test_replay_starts_from_given_ratings(spark):
    m = rated(spark, matches(spark, [(0, "A", "B", 1, 0, True), (1, "A", "C", 1, 0, True), (2, "A", "B", 0, 0, True)]))
    start = spark.createDataFrame([("A", 1700.0), ("B", 1450.0)], "team string, rating double")
    got = {r["match_id"]: r for r in elo.elo_replay(m, start=start).collect()}
    assert (got[0]["home_elo_pre"], got[0]["away_elo_pre"], got[1]["away_elo_pre"]) == (1700.0, 1450.0, 1500.0)
    assert got[1]["home_elo_pre"] == got[0]["home_elo_post"] and got[2]["away_elo_pre"] == got[0]["away_elo_post"]
    other = start.withColumn("league", F.lit("y"))
    assert elo.elo_replay(m, start=other).where("match_id = 0").first()["home_elo_pre"] == 1500.0


def test_stage_names(spark):
    names = spark.createDataFrame([("league stage", "group_stage"), ("group g", "group_stage"), ("first round", "round_of_32"), ("second round", "round_of_16"), ("quarter-finals", "quarterfinal")], "raw string, stage string")
    raw = ["League Stage", "Group G", " first round", "second round", "QUARTER-FINALS", "FINAL", "Round of 16", "Third-Place", "Something Else", None]
    got = {r["tournament_stage"]: (r["stage"], r["stage_importance"], r["stage_weight"]) for r in B.stage_attrs(spark.createDataFrame([(x,) for x in raw], "tournament_stage string"), names).collect()}
    assert [got[x][0] for x in raw] == ["group_stage", "group_stage", "round_of_32", "round_of_16", "quarterfinal", "final", "round_of_16", "third_place", "something_else", "unknown"]
    assert got["League Stage"][1] < got["QUARTER-FINALS"][1] < got["FINAL"][1] and got["Something Else"][1:] == (1, 1.0) and got[None][1:] == (0, 0.5)


def test_player_names_lose_all_accents(spark):
    names = ["Luka Modrić", "Benjamin Šeško", "Nguyễn  Quang Hải", "José Ángel", "été", "Ødegaard", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(B.normalize_player_name(F.col("n"))).collect()]
    assert got == ["luka modric", "benjamin sesko", "nguyen quang hai", "jose angel", "ete", "ødegaard", None]


def test_cleaning_of_absent_values(spark):
    df = spark.createDataFrame([("2025-01-01", "A", "B", "1", "x", None, None)], "date string, home_team string, away_team string, home_score string, away_score string, neutral string, home_fifa_rank string")
    r = B.fill_defaults(B.coerce_types(df)).first()
    assert (r["away_score"], r["neutral"], r["home_fifa_rank"], r["away_fifa_rank"], r["competition"]) == (None, False, 75, 75, "Unknown")
    assert B.validate_schema(spark.createDataFrame([], "team string"), "teams").columns == ["team"]


def played(spark, n=40):
    m = matches(spark, [(4 * i, f"t{i % 4}", f"t{(i + 1 + i % 3) % 4}" if (1 + i % 3) % 4 else "t9", i % 4, i % 3, i % 3 == 0) for i in range(n)])
    m = rated(spark, m.where("home_team <> away_team"))
    return m.join(elo.elo_replay(m).drop("league"), "match_id").withColumns({"competition_weight": F.lit(3), "home_fifa_rank": F.lit(5), "away_fifa_rank": F.lit(9), "tournament_stage": F.lit("Final")})


def test_snapshot_equals_the_row_of_the_match(spark):
    m = played(spark)
    rows = W.team_features(W.long_table(m, {"opp_elo_pre": ("away_elo_pre", "home_elo_pre")}), adjusted=True)
    snapshot = W.snapshot_as_of(m, m.select(F.col("match_id").alias("fixture_id"), "date", "home_team", "away_team"))
    home = {r["fixture_id"]: r for r in snapshot.collect()}
    for r in rows.where("side = 'home'").collect():
        for c in W.FEATURES:
            assert home[r["match_id"]][f"home_{c}"] == pytest.approx(r[c]), (r["match_id"], c)
    h2h = {r["match_id"]: r for r in W.head_to_head(m).collect()}
    assert all(home[i]["home_h2h_win_rate"] == h2h[i]["home_h2h_win_rate"] and home[i]["h2h_n_matches"] == h2h[i]["h2h_n_matches"] for i in h2h)
    later = spark.createDataFrame([(1, date(2030, 1, 1), "t0", "nobody")], "fixture_id long, date date, home_team string, away_team string")
    r = W.snapshot_as_of(m, later).first()
    last = m.selectExpr("date", "match_id", "explode(array(struct(home_team as t, home_elo_post as e), struct(away_team as t, away_elo_post as e))) as s").where("s.t = 't0'").orderBy(F.desc("date"), F.desc("match_id")).first()
    assert r["home_elo_pre"] == last["s"]["e"] and r["away_form_last5"] == 1.5 and r["away_n_matches"] == 0 and r["home_rest_days"] > 1000


def test_feature_table_holds_in_both_orientations(spark):
    m = played(spark)
    rates = spark.createDataFrame([(3, 0.5, 0.2, 0.3)], "competition_weight int, h double, d double, a double")
    penalties = spark.createDataFrame([("t0", 3, 4)], "team string, won int, played int")
    rows = {(r["match_id"], r["swapped"]): r for r in W.feature_table(m, rates, penalties=penalties).collect()}
    both = [i for i, swapped in rows if swapped]
    assert len(both) == m.where("neutral").count() and len(rows) == m.count() + len(both)
    for i in both:
        a, b = rows[i, False], rows[i, True]
        for c in ("elo_diff_home_away", "rank_diff", "form_diff_w3", "goal_balance_diff", "penalty_win_rate_diff", "home_h2h_goal_diff"):
            assert a[c] == pytest.approx(-b[c])
        assert a["elo_win_prob"] == pytest.approx(1 - b["elo_win_prob"]) and a["home_h2h_win_rate"] == b["away_h2h_win_rate"]
        assert b["stage_weight"] == a["stage_weight"] / 2 and b["match_weight"] == a["match_weight"] and {a["target"], b["target"]} in ({"H", "A"}, {"D"})


def pool_adjacent(x, y):
    """Isotonic means of y by rising x."""
    blocks = []
    for v in sorted(set(x)):
        mine = [b for a, b in zip(x, y) if a == v]
        blocks.append([sum(mine), len(mine), [v]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] > blocks[-1][0] / blocks[-1][1]:
            s, n, vs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + vs]
    return {v: s / n for s, n, vs in blocks for v in vs}


def test_isotonic_calibration(spark):
    rows = [(i, i % 3, (i * 7 % 10 + 1) / 30, (i * 3 % 10 + 1) / 30) for i in range(60)]
    rows = [(i, y, a, d, 1 - a - d) for i, y, a, d in rows]
    df = spark.createDataFrame(rows, "match_id int, y int, p_a double, p_d double, p_h double")
    maps = [pool_adjacent([r[2 + c] for r in rows], [float(r[1] == c) for r in rows]) for c in range(3)]
    for r, got in zip(rows, scoring.calibrate_isotonic(df, df).orderBy("match_id").collect()):
        p = [min(1 - 1e-6, max(1e-6, maps[c][r[2 + c]])) for c in range(3)]
        assert [got["p_a"], got["p_d"], got["p_h"]] == pytest.approx([x / sum(p) for x in p], abs=1e-9)


def test_regression_is_at_its_optimum_and_predicts_by_its_weights(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) * [1.0, 3.0]
    y = (x @ [[1.0, 0.0, -1.0], [0.1, 0.0, -0.1]] + rng.gumbel(size=(300, 3))).argmax(axis=1)
    own = rng.uniform(0.5, 1.0, 300)
    df = scoring.balanced(spark.createDataFrame([(i, *map(float, a), float(b), float(w)) for i, (a, b, w) in enumerate(zip(x, y, own))], "match_id int, a double, b double, label double, own double"), "label", "own")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = scoring.train_logreg(df, "label", "sample_weight")
    weights = own * 300 / (3 * np.bincount(y)[y])
    z = x @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    # the penalty holds for standardised features
    mean = np.average(x, axis=0, weights=weights)
    variance = (weights[:, None] * (x - mean) ** 2).sum(axis=0) / (weights.sum() - (weights**2).sum() / weights.sum())
    gradient = (weights[:, None] * (p - np.eye(3)[y])).T @ x / weights.sum() + 0.001 * model.coefficientMatrix.toArray() * variance
    assert abs(gradient).max() < 2e-3
    got = scoring.predict_batch(model, df).orderBy("match_id").collect()
    assert np.abs(np.array([[r["p_a"], r["p_d"], r["p_h"]] for r in got]) - p).max() < 1e-9


def test_fuzzy_match_loses_nothing(spark):
    rng = np.random.default_rng(2)
    name = lambda: "".join(rng.choice(list("abcd"), int(rng.integers(1, 14))))
    left = [(i, "x", name()) for i in range(60)]
    right = [(i, "x", name(), name()) for i in range(80)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, p in enumerate(a, 1):
            row, before = [i], row
            for j, q in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (p != q)))
        return row[-1]

    similar = lambda a, b: 100 * (1 - distance(a, b) / max(len(a), len(b)))
    want = {}
    for i, _, n in left:
        best = min((-max(similar(n, a), similar(n, b)), j) for j, _, a, b in right)
        if -best[0] >= 75 - 1e-9:
            want[i] = best[1]
    players = spark.createDataFrame(left, "id int, nation string, name string")
    ratings = spark.createDataFrame(right, "other_id int, nation string, other_name string, other_short string")
    assert {r["id"]: r["other_id"] for r in joins.fuzzy_squad_match(players, ratings, "nation").collect()} == want and len(want) > 10


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    table, late, source, checkpoint = (f"file://{tmp_path}/{x}" for x in ("table", "late", "source", "checkpoint"))
    none = spark.createDataFrame([], "alias string, canonical string")
    matches(spark, [(0, "A", "B", 1, 0, False)]).write.parquet(f"{table}/batch=-1")

    def run():
        stream = spark.readStream.schema(MATCH).parquet(source)
        incremental.append_stream(stream, table, none, checkpoint, late, availableNow=True).awaitTermination()
        return sorted((r["home_team"], r["batch"]) for r in spark.read.parquet(table).collect()), sorted(r["home_team"] for r in spark.read.parquet(late).collect())

    for rows in ([(1, "C", "D", 1, 0, False), (0, "L", "D", 1, 0, False)], [(2, "E", "F", 1, 1, False), (1, "M", "F", 1, 1, False)]):
        matches(spark, rows).write.mode("append").parquet(source)
        found = run()
    assert found == ([("A", -1), ("C", 0), ("E", 1)], ["L", "M"])
    # as if the driver had been lost before the batch was noted as done
    for commit in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        commit.unlink()
    assert run() == found


def test_bracket_by_the_symmetrised_rule_over_five_rounds(spark):
    """A favourite with a win chance below one half goes on if half the draws make it one half; five rounds; a slot without its teams isn't played; no plan node per round."""
    pairs = spark.createDataFrame([("a", "b", 0.4, 0.3, 0.3), ("b", "a", 0.3, 0.3, 0.4), ("c", "d", 0.4, 0.1, 0.5), ("d", "c", 0.4, 0.1, 0.5)], "home string, away string, p_h double, p_d double, p_a double")
    p = {(r["team1"], r["team2"]): r["p1"] for r in K.knockout_probabilities(pairs).collect()}
    assert p == {("a", "b"): 0.55, ("b", "a"): 0.45, ("c", "d"): 0.5, ("d", "c"): 0.5}
    first = [(1, 0, "a", "b"), (1, 1, "c", "d"), (2, 0, "b", "a"), (3, 0, "x", None), (3, 1, "c", "d")]
    feeds = spark.createDataFrame([(2, 0, 1, 2, False), (3, 0, 1, 2, True)], "slot int, from1 int, from2 int, round int, losers boolean")
    table = spark.createDataFrame(first, "scenario_id long, slot int, team1 string, team2 string")
    got = {(r["scenario_id"], r["slot"]): (r["team1"], r["team2"], r["p1"], r["winner"]) for r in K.propagate_bracket(table, feeds, K.knockout_probabilities(pairs)).collect()}
    assert got == {(1, 0): ("a", "b", 0.55, "a"), (1, 1): ("c", "d", 0.5, "c"), (1, 2): ("a", "c", 0.5, "a"), (1, 3): ("b", "d", 0.5, "b"), (2, 0): ("b", "a", 0.45, "a"), (3, 1): ("c", "d", 0.5, "c")}
    with pytest.raises(Exception, match="at most"):
        K.propagate_bracket(table, feeds, K.knockout_probabilities(pairs), most_teams=2).collect()
    joins = []
    for rounds in (2, 5):
        more = spark.createDataFrame([(20 + r, 18 + r, 19 + r, r, False) for r in range(2, rounds + 1)], feeds.schema)
        plan = K.propagate_bracket(table, more, K.knockout_probabilities(pairs))._jdf.queryExecution().optimizedPlan().toString()
        joins.append(plan.count("Join"))
    assert joins[0] == joins[1]


def test_players_one_row_each(spark):
    """Two players with one alias: a nationality chooses, without one there is no answer; accents count; one row in, one out."""
    aliases = spark.createDataFrame([("J. Smith", "s1", "England"), ("j.  smith", "s2", "Wales"), ("José", "j", "Spain"), ("K", "k", None), ("L", "l", "Mali"), ("L", "l", "Chad")], "alias string, player_id string, player_nationality string")
    names = [("J. Smith", None), ("J. SMITH", "wales"), ("J. Smith", "Spain"), ("Jose", None), (" josé ", ""), ("K", None), ("K", "Mali"), ("L", None), (None, None), ("nobody", "x")]
    df = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "i int, name string, nationality string")
    got = [r["player_id"] for r in B.resolve_players(df, aliases).orderBy("i").collect()]
    assert got == [None, "s2", None, None, "j", "k", None, "l", None, None]


def test_rows_without_a_date_are_late(spark):
    batch = spark.createDataFrame([(1, "2024-01-02"), (2, None), (3, "2023-12-31"), (4, "2024-01-01")], "id int, d string").selectExpr("id", "to_date(d) AS date")
    mark = spark.sql("SELECT date'2024-01-01' AS mark")
    on_time, late = incremental.split_late(batch, mark)
    assert [r["id"] for r in on_time.collect()] == [1] and sorted(r["id"] for r in late.collect()) == [2, 3, 4]


def test_waves_equal_the_replay_in_order(spark):
    """Slices of a few days, parts of teams that meet in a slice, two scales, start ratings, several matches of a team on a day; a small league stays in one task."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        h, a = rng.choice(24, 2, replace=False)
        rows.append(("big", i, date(2025, 1, 1) + timedelta(days=int(rng.integers(0, 30))), f"t{h}", f"t{a}", float(rng.integers(10, 60)), float(rng.choice([0.0, 100.0])), float(rng.choice([0, 0.5, 1])), 1500.0 + float(h), 1500.0 + float(a)))
    steps = spark.createDataFrame(rows, "league string, match_id long, date date, home_team string, away_team string, step double, advantage double, score double, home_start double, away_start double")
    got, want = ({r["match_id"]: r for r in f(steps, [1.0, 0.5]).collect()} for f in (elo.replayed_in_waves, elo.replayed_in_order))
    assert got == want and len(got) == 90
    cut = elo.sliced(steps)
    parts = elo.connected(cut.select(F.struct("slice", F.col("home_team").alias("t")).alias("a"), F.struct("slice", F.col("away_team").alias("t")).alias("b")))
    per_slice = [r["n"] for r in parts.groupBy("node.slice").agg(F.countDistinct("part").alias("n")).collect()]
    assert len(per_slice) > 4 and max(per_slice) > 2  # parts that tasks take side by side
    small = steps.withColumn("league", F.when(F.col("match_id") < 10, "small").otherwise("big"))
    both = elo.replayed(small, small, [1.0], most_in_task=20)
    assert {tuple(map(str, r)) for r in both.collect()} == {tuple(map(str, r)) for r in elo.replayed_in_order(small, [1.0]).collect()}


def test_waves_read_what_is_left_for_them(spark, monkeypatch):
    """Two leagues with teams of the same names: edges shrink round by round, no table of all ratings is written, and ratings equal those in order."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        h, a = rng.choice(16, 2, replace=False)
        rows.append((f"l{i % 2}", i, date(2025, 1, 1) + timedelta(days=i // 4), f"t{h}", f"t{a}", float(rng.integers(10, 60)), 0.0, float(rng.choice([0, 0.5, 1])), 1500.0 + float(h), 1500.0 + float(a)))
    steps = spark.createDataFrame(rows, STEPS)
    tables, write = [], elo.written
    monkeypatch.setattr(elo, "written", lambda df, label: tables.append((label, write(df, label))) or tables[-1][1])
    got, want = ({r["match_id"]: r for r in f(steps, [1.0]).collect()} for f in (elo.replayed_in_waves, elo.replayed_in_order))
    assert got == want and len(got) == 60
    edges = [t.count() for label, t in tables if label == "edges"]
    assert len(edges) > 2 and edges == sorted(set(edges), reverse=True) and edges[-1] == 0
    assert not any(label == "ratings" for label, _ in tables)


def test_connected_parts(spark):
    """A long path, a ring, a loop on itself and two that stand alone."""
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (300, 301)]
    got = {r["node"]: r["part"] for r in elo.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 300, 301: 300}


def run_stream(spark, tmp_path, batches, make, mode):
    """Runs a stream over batches, a restart from the checkpoint before each; the emitted rows and the state operators' progress of each."""
    source, out = f"file://{tmp_path}/source", []
    for batch in batches:
        batch.write.mode("append").parquet(source)
        rows = []
        stream = spark.readStream.schema(batch.schema).parquet(source)
        q = make(stream).writeStream.outputMode(mode).foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        out.append((rows, [s["numRowsUpdated"] for p in q.recentProgress if p["numInputRows"] for s in p["stateOperators"]]))
    return out


STEPS = "league string, match_id long, date date, home_team string, away_team string, step double, advantage double, score double, home_start double, away_start double"


@pytest.mark.skipif(not incremental.HAS_KEYED_STATE, reason="needs protobuf")
def test_streamed_ratings_write_what_they_touch(spark, tmp_path):
    """After a batch of many teams one of a single match writes two ratings, and both ways of keeping state agree with the replay."""
    row = lambda i, day, h, a: ("L", i, date(2025, 1, 1) + timedelta(days=day), h, a, 30.0, 100.0, float(i % 2), 1500.0, 1400.0)
    rows = [[row(i, i, f"t{i % 20}", f"t{(i * 7 + 1) % 20}") for i in range(60) if i % 20 != (i * 7 + 1) % 20], [row(100, 100, "t3", "t9")], [row(101, 101, "t3", "new")]]
    batches = [spark.createDataFrame(r, STEPS) for r in rows]
    emitted = run_stream(spark, tmp_path, batches, incremental.stream_elo, "append")
    assert [sum(n) for _, n in emitted[1:]] == [2, 2] and sum(emitted[0][1]) == 20
    want = {r["match_id"]: (r["home_elo_pre"][0], r["away_elo_pre"][0]) for r in elo.replayed_in_order(spark.createDataFrame([r for b in rows for r in b], STEPS), [1.0]).collect()}
    assert {r["match_id"]: (r["home_elo_pre"], r["away_elo_pre"]) for b, _ in emitted for r in b} == want
    plain = run_stream(spark, tmp_path / "plain", batches, lambda s: incremental.stream_elo(s, keyed=False), "append")
    assert {r["match_id"]: (r["home_elo_pre"], r["away_elo_pre"]) for b, _ in plain for r in b} == want


def test_live_state_is_dropped(spark, tmp_path):
    """Old matches leave the state; late news within the watermark are overtaken by event time, later ones ignored."""
    row = lambda m, day, e, h: (m, f"2025-01-{day:02d} 12:00:00", e, "FINISHED", h, 0)
    make = lambda rows: spark.createDataFrame(rows, "match_id long, t string, event_id long, status string, home_score int, away_score int").withColumn("event_time", F.to_timestamp("t")).drop("t")
    batches = [make([row(i, 1, i, 1) for i in range(50)]), make([row(100, 3, 1, 2), row(100, 2, 9, 7)]), make([row(101, 25, 1, 3)]), make([row(102, 26, 1, 4), row(0, 1, 99, 9)])]
    progress = []

    def live(stream):
        return incremental.stream_live_table(stream, "4 days")

    source = f"file://{tmp_path}/source"
    rows = []
    for batch in batches:
        batch.write.mode("append").parquet(source)
        q = live(spark.readStream.schema(batch.schema).parquet(source)).writeStream.outputMode("update").foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        progress.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert progress[0] == 50 and progress[-1] < 5
    latest = {}
    for r in rows:
        latest[r["match_id"]] = max(latest.get(r["match_id"], (None, 0)), (r["event_time"], r["home_score"]), key=lambda x: str(x[0] or ""))
    assert latest[100][1] == 2 and latest[0][1] == 1 and {101, 102} <= set(latest)


def test_intervals_meet_only_what_overlaps(spark):
    """Random stints, open ends, empty and reversed ones, a hot team: pairs are those of the plain predicate, and no pair is joined and dropped."""
    rng = np.random.default_rng(4)
    day = lambda n: None if n is None else date(1990, 1, 1) + timedelta(days=int(n))
    maybe = lambda n: None if rng.random() < 0.1 else int(n)
    stints = [(f"T{int(rng.integers(0, 3)) if i % 3 else 0}", i, day(maybe(s)), day(maybe(s + rng.integers(-3, 2000)))) for i, s in enumerate(rng.integers(0, 12000, 150))]
    stints += [("t0", 1000, day(5), day(5)), ("t0", 1001, None, None), ("t0", 1002, date(1, 1, 1), date(9999, 12, 31))]
    fixtures = [(i, f"t{i % 3}", day(maybe(rng.integers(-100, 14000)))) for i in range(80)]
    want = {(f, p) for f, team, d in fixtures for t, p, a, b in stints if t.lower() == team and (a is None or (d is not None and a <= d)) and (b is None or (d is not None and b > d))}
    r = spark.createDataFrame(stints, "team string, player_id int, joined_date date, left_date date")
    joined = joins.active_roster(spark.createDataFrame(fixtures, "id int, team string, date date"), r)
    got = [(x["id"], x["player_id"]) for x in joined.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "left_date" not in plan.partition("Join")[2].partition("\n")[0]  # buckets alone decide
    cut = spark.sql("select 8388608L + 100 as a, 8388608L + 5000 as b").select(F.explode(joins.buckets_of(F.col("a"), F.col("b"))).alias("x")).count()
    assert cut < 40


def test_isotonic_fits_pool_parts(spark):
    """Pools of ranges, pooled again, equal the pools of the whole; names apart; a group that validation lacks."""
    rng = np.random.default_rng(5)
    rows = [(f"m{i % 2}", float(x), float(y)) for i, (x, y) in enumerate(zip(rng.integers(0, 60, 600) / 60, rng.random(600)))]
    points = spark.createDataFrame(rows, "name string, x double, y double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = scoring.isotonic_fits(points).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for name in ("m0", "m1"):
        fit = pool_adjacent([x for n, x, _ in rows if n == name], [y for n, _, y in rows if n == name])
        mine = [s for s in steps if s["name"] == name]
        assert len(mine) > 1 and [s["value"] for s in mine] == sorted(s["value"] for s in mine)
        for x, f in fit.items():
            assert [s["value"] for s in mine if s["lo"] <= x <= s["hi"]] == [pytest.approx(f, abs=1e-9)]
    some = spark.createDataFrame([("x", 0, 0.2, 0.3, 0.5), ("x", 2, 0.1, 0.3, 0.6)], "model string, y int, p_a double, p_d double, p_h double")
    other = some.withColumn("model", F.lit("y"))
    assert [round(r["p_a"], 6) for r in scoring.calibrate_isotonic(some, other, by="model").collect()] == [0.333333] * 2


def test_appending_reads_marks_and_not_the_table(spark, tmp_path):
    """Batches over restarts; a damaged file in the table harms nobody who doesn't read it; a batch run again changes nothing; undated and old rows are late."""
    none = spark.createDataFrame([], "alias string, canonical string")
    table, late, source = (f"file://{tmp_path}/{x}" for x in ("table", "late", "source"))
    m = matches(spark, [(d, f"a{d}", f"b{d}", 1, 0, False) for d in range(12)])
    m.where("match_id < 3").write.parquet(f"{table}/batch=-1")
    undated = m.where("match_id = 11").withColumns({"date": F.lit(None).cast("date"), "match_id": F.lit(99).cast("long")})
    parts = [m.where("match_id between 2 and 5"), m.where("match_id in (4, 6, 7)").unionByName(undated), m.where("match_id >= 8")]
    for i, part in enumerate(parts):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(m.schema).parquet(source)
        incremental.append_stream(stream, table, none, f"file://{tmp_path}/checkpoint", late, availableNow=True).awaitTermination()
        if i == 0:  # all rows of the table before: from now on only marks are read
            (tmp_path / "table" / "batch=-1" / "part-damaged.parquet").write_bytes(b"no parquet")
    marks = {r["batch"]: r["mark"] for r in spark.read.parquet(f"{table}/_marks").collect()}
    assert [marks[k] for k in sorted(marks)] == sorted(marks.values()) and max(marks.values()) == date(2025, 1, 12)
    (tmp_path / "table" / "batch=-1" / "part-damaged.parquet").unlink()
    kept = sorted(r["match_id"] for r in spark.read.parquet(table).collect())
    assert kept == list(range(12))
    assert sorted(r["match_id"] for r in spark.read.parquet(late).collect()) == [2, 4, 99]


def test_late_rows_read_their_months_only(spark, tmp_path):
    none = spark.createDataFrame([], "alias string, canonical string")
    table = f"file://{tmp_path}/months"
    m = matches(spark, [(d, f"a{d}", f"b{d}", 1, 0, False) for d in range(0, 300, 5)])
    incremental.by_month(m.where("match_id % 2 = 0"), table)
    (tmp_path / "months" / "month=2025-09" / "part-damaged.parquet").write_bytes(b"no parquet")
    late = m.where("date < '2025-03-01'").unionByName(m.where("match_id = 1").withColumn("date", F.lit(None).cast("date")))
    assert incremental.append_late(table, late, none) == late.where("match_id % 2 = 1 and date is not null").count()
    assert incremental.append_late(table, late, none) == 0


@pytest.mark.parametrize("classes, weighted", [(2, False), (3, True)])
def test_newton_reaches_the_optimum(spark, classes, weighted):
    """The gradient vanishes; predictions follow from the weights; null features and labels, a feature that doesn't vary, no rows."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2))
    y = (x @ rng.normal(size=(2, classes)) + rng.gumbel(size=(200, classes))).argmax(axis=1)
    own = rng.uniform(0.5, 2.0, 200) if weighted else np.ones(200)
    rows = [(float(a), float(b) if i else None, 0.0, int(k), float(w)) for i, ((a, b), k, w) in enumerate(zip(x, y, own))] + [(1.0, 1.0, 0.0, None, 9.0)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, k int, w double")
    features = ["a", "b", "flat"]
    weights = scoring.train_newton(df, features, "k", classes, "w" if weighted else None, ridge=0.01)
    beta = {(r["class_no"], r["feature"]): r["weight"] for r in weights.collect()}
    x[0, 1] = 0.0
    full = np.column_stack([np.ones(200), x, np.zeros(200)])
    b = np.array([[beta[c, f] for f in ["", *features]] for c in range(1, classes)])
    z = np.column_stack([np.zeros(200), full @ b.T])
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    gradient = (own[:, None] * (p[:, 1:] - (y[:, None] == np.arange(1, classes)))).T @ full / own.sum() + 0.01 * b * [0, 1, 1, 1]
    assert abs(gradient).max() < 1e-9
    names = "xyz"[:classes]
    got = scoring.predict_newton(weights, df.where("k is not null"), features, names).collect()
    assert np.allclose(sorted(r["p_y"] for r in got), sorted(p[:, 1]), atol=1e-9)
    assert {r["weight"] for r in scoring.train_newton(df.where("false"), features, "k", classes).collect()} == {0.0}
    with pytest.raises(ValueError, match="weights"):
        scoring.train_newton(df, features * 700, "k", classes)


def test_copies_of_names_meet_once(spark, monkeypatch):
    """A thousand copies of a few names on each side: pairs are made of distinct names, and each row gets the first of its best."""
    kinds = ["red ring", "blue ring", "red bolt", "old gear"]
    left = spark.range(1000).select("id", F.lit("b").alias("block"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("id") % 4 + 1).cast("int")).alias("name"))
    right = left.select((F.col("id") + 5000).alias("other_id"), "block", F.concat("name", F.lit("s")).alias("other_name"), F.col("name").alias("other_short"), (-F.col("id")).alias("ordinal"))
    made, rare = [], joins.sharing_rare
    monkeypatch.setattr(joins, "sharing_rare", lambda *a: made.append(rare(*a)) or made[-1])
    tokens = {r["id"]: r["other_id"] for r in joins.token_match(left, right, "block", 0.5).collect()}
    assert tokens == {i: 5996 + i % 4 for i in range(1000)}
    fuzzy = {r["id"]: r["other_id"] for r in joins.fuzzy_squad_match(left, right, "block", 75.0).collect()}
    assert fuzzy == {i: 5000 + i % 4 for i in range(1000)}
    low = {r["id"]: r["other_id"] for r in joins.fuzzy_squad_match(left, right, "block", 40.0).collect()}
    assert low == fuzzy
    passes = {r["id"]: (r["other_id"], r["pass_no"]) for r in joins.exact_then_fallback_match(left, right.withColumn("other_name", F.col("other_short")), "block", 0.5).collect()}
    assert passes == {i: (5000 + i % 4, 1) for i in range(1000)}
    assert len(made) == 4 and all(m.count() <= 16 for m in made)


def test_short_names_meet_by_deletions(spark):
    """Names of up to a few letters against all pairs of their block, by edit distance; repeated letters; empty and null names; thresholds high and low."""
    rng = np.random.default_rng(6)
    name = lambda n: "".join(rng.choice(list("abA "), n))
    left = [(i, name(int(rng.integers(0, 7))), f"b{i % 2}") for i in range(60)] + [(100, "aaaaaaaa", "b0"), (101, None, "b0"), (102, "xyz", "b1")]
    right = [(i, name(int(rng.integers(0, 9))), name(3) if i % 3 else None, f"b{i % 2}") for i in range(60)] + [(100, "aaaaaaa", "aaaa", "b0"), (101, None, None, "b0"), (102, "xz", "yz", "b1")]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    def alike(a, b):
        return 0.0 if a is None or b is None or not max(len(a), len(b)) else 100.0 * (1 - edits(a.lower(), b.lower()) / max(len(a), len(b)))

    a = spark.createDataFrame(left, "id int, name string, block string")
    b = spark.createDataFrame(right, "other_id int, other_name string, other_short string, block string")
    for threshold in (90.0, 75.0, 60.0, 40.0):
        want = {}
        for i, n, block in left:
            scored = [(-max(alike(n, x), alike(n, y)), j) for j, x, y, other in right if other == block]
            best = min((s for s in scored if s[0] <= -threshold), default=None)
            if best:
                want[i] = (best[1], round(-best[0], 6))
        got = {r["id"]: (r["other_id"], round(r["score"], 6)) for r in joins.fuzzy_squad_match(a, b, "block", threshold).collect()}
        assert got == want, threshold


def league(spark, n=60, teams=12):
    rows = [(i // 2, f"t{i % teams}", f"t{(i * 5 + 1 + i // teams) % teams}", i % 4, i % 3, i % 5 == 0) for i in range(n)]
    m = rated(spark, matches(spark, rows).where("home_team <> away_team"))
    return m.withColumns({"league": F.when(F.col("match_id") % 7 != 0, F.lit("x")), "competition_weight": F.lit(3), "home_fifa_rank": F.lit(5), "away_fifa_rank": F.lit(9), "tournament_stage": F.lit("Final"), "bucket": F.lit("clash"), "batch_note": F.lit("kept")})


def rebuilt(m, start):
    m = m.withColumn("league", F.coalesce("league", F.lit("")))
    whole = m.join(elo.elo_replay(m, start=start).drop("league"), "match_id")
    return W.feature_table(whole, aggregates.tier_base_rates(whole).where("competition_weight is not null"))


def as_rows(df, columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_feature_store_equals_a_rebuild(spark, tmp_path):
    """Three batches, one of them empty and one added twice: all columns as by a rebuild; a batch of two matches reads and writes the buckets of its teams only."""
    m = league(spark)
    start = spark.createDataFrame([("t1", 1700.0), ("t2", 1300.0)], "team string, rating double")
    store = FeatureStore(f"file://{tmp_path}/store", start=start, buckets=16)
    last = m.where(F.col("date") >= date(2025, 1, 30))
    parts = [m.where(F.col("date") < date(2025, 1, 20)), m.limit(0), m.where((F.col("date") >= date(2025, 1, 20)) & (F.col("date") < date(2025, 1, 30))), last]
    for number, part in enumerate(parts[:3]):
        store.append(part, number)
    store.append(parts[2], 2)  # as after a failure
    playing = {t for r in last.collect() for t in (r["home_team"], r["away_team"])}
    of = lambda names: {r["b"] for r in spark.createDataFrame([(t,) for t in names], "team string").select(store.teams.bucket().alias("b")).collect()}
    others = of({f"t{i}" for i in range(12)}) - of(playing)
    assert others  # versions of buckets that the batch has no business with
    for b in others:
        for folder in (tmp_path / "store" / "teams").glob(f"batch=*/bucket={b}"):
            for f in folder.glob("*.parquet"):
                f.write_bytes(b"no parquet")
    store.append(last, 3)
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "store" / "teams" / "batch=3").glob("bucket=*")} == of(playing)
    table, whole = store.table(spark), rebuilt(m, start)
    assert set(table.columns) == set(whole.columns)
    assert as_rows(table, whole.columns) == as_rows(whole, whole.columns) and table.count() > m.count()


def test_last_rows_are_bounded(spark, tmp_path):
    """A team of more matches than are kept leaves only the last ones."""
    table = LastRows(f"file://{tmp_path}/rows", ("team",), 3, 4)
    rows = lambda days: spark.createDataFrame([("a", date(2025, 1, d), d) for d in days], "team string, date date, match_id long")
    assert table.advanced(rows(range(1, 9)), 0).count() == 8
    seen = {r["match_id"]: r["_new"] for r in table.advanced(rows([10]), 1).collect()}
    assert seen == {6: False, 7: False, 8: False, 10: True}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        table.advanced(rows([11]), 5)  # a batch is missing


def test_streamed_features_restart_and_late_rows(spark, tmp_path):
    """A restart before each batch and a batch done twice: equal to a rebuild of what was on time; old and undated rows go aside, repeated and unplayed ones don't count."""
    m = league(spark, 40, 6)
    store = FeatureStore(f"file://{tmp_path}/store", buckets=4)
    source, checkpoint, late = (f"file://{tmp_path}/{x}" for x in ("source", "checkpoint", "late"))
    old = m.where("match_id = 2").withColumn("match_id", F.lit(900).cast("long"))
    undated = old.withColumns({"date": F.lit(None).cast("date"), "match_id": F.lit(901).cast("long")})
    unplayed = m.where("match_id = 37").withColumns({"home_score": F.lit(None).cast("int"), "match_id": F.lit(902).cast("long")})
    first, second = m.where(F.col("date") < date(2025, 1, 12)), m.where(F.col("date") >= date(2025, 1, 12))

    def run():
        stream = spark.readStream.schema(m.schema).parquet(source)
        stream_features(stream, store, checkpoint, late, availableNow=True).awaitTermination()

    for part in (first.unionByName(first.where("match_id < 5")), second.unionByName(old).unionByName(undated).unionByName(unplayed)):
        part.write.mode("append").parquet(source)
        run()
    whole = rebuilt(m, None)
    want = as_rows(whole, whole.columns)
    assert as_rows(store.table(spark), whole.columns) == want
    assert sorted(r["match_id"] for r in spark.read.parquet(late).collect()) == [900, 901]
    for commit in (tmp_path / "checkpoint" / "commits").glob("*1*"):
        commit.unlink()
    run()
    assert as_rows(store.table(spark), whole.columns) == want


@pytest.mark.parametrize("threshold", [40.0, 75.0])
def test_name_matches_broadcast_no_names(spark, threshold):
    """Distinct names may be as many as rows: none of the joins sends a side of them through the driver, however small its files are."""
    left = spark.range(50).select("id", F.lit("b").alias("block"), F.concat(F.lit("red ring "), "id").alias("name"))
    right = left.select((F.col("id") + 500).alias("other_id"), "block", F.col("name").alias("other_name"), F.concat("name", F.lit("s")).alias("other_short"), F.col("id").alias("ordinal"))
    fuzzy = joins.fuzzy_squad_match(left, right, "block", threshold)
    for found in (fuzzy, joins.token_match(left, right, "block", threshold / 100)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: (r["other_id"], r["score"]) for r in fuzzy.collect()} == {i: (500 + i, 100.0) for i in range(50)}


def test_blends_meet_in_parts_that_follow_the_rows(spark, monkeypatch):
    """Twice the rows, twice the parts: a task holds as many matches as before."""
    monkeypatch.setattr(shared, "PART_ROWS", 50)
    monkeypatch.setattr(shared, "FEW", 100)

    def blends(n):
        long = spark.range(n).select((F.col("id") / 2).cast("long").alias("match_id"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("model"), *(F.lit(p).alias(f"p_{c}") for c, p in zip("hda", (0.5, 0.25, 0.25))))
        weights = spark.createDataFrame([("x", 1.0, 1.0, 1.0), ("y", 1.0, 1.0, 1.0)], "model string, w_h double, w_d double, w_a double")
        draw = spark.createDataFrame([], "match_id long, p_draw double")
        return scoring.blend_models(long, weights, draw, 0.3), scoring.blend_interval(long.withColumn("weight", F.lit(0.5)))

    for n in (400, 800):
        for out in blends(n):
            assert f", {n // 50}), REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
            assert out.count() == n // 2 and {(r["p_h"], r["p_d"], r["p_a"]) for r in out.collect()} == {(0.5, 0.25, 0.25)}


def test_many_matches_are_dealt_by_their_number(spark, monkeypatch):
    """The same matches, and tasks of so many of them, whatever their teams' table is joined by."""
    views = testdata.Views(spark, "/root/testdata/sf0.001")
    want, n = views.matches().collect(), views.table("orders").count()
    monkeypatch.setattr(shared, "FEW", n - 1)
    monkeypatch.setattr(shared, "PART_ROWS", 100)
    got = views.matches()
    assert got._jdf.queryExecution().executedPlan().toString().count(f", {-(-n // 100)}), REPARTITION_BY_NUM") >= 2
    assert sorted(got.collect()) == sorted(want) and len(want) > 100


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_look_back_row_by_row(spark):
    """No frame is gathered or summed anew for each row, and the features are those of a plain count of the last 30 matches."""
    m = played(spark, 200).withColumn("neutral", F.col("match_id") % 3 == 0)
    long = W.long_table(m)
    made = W.team_features(long)
    plan = plan_of(made)
    assert "lag(" in plan and not any(f in plan for f in ("collect_list", "avg(", "lambda"))
    kept: dict[str, list] = {}
    seen = 0
    for r in made.orderBy("date", "match_id", "side").collect():
        past = kept.setdefault(r["team"], [])[-30:]
        if past:
            at = [1 if x["is_home"] else -1 if x["is_home"] is None else 0 for x in past]
            plain = incremental.team_features([str(x["date"]) for x in past], *([x[c] for x in past] for c in ("points", "gf", "ga")), at)
            for c, x in plain.items():
                if c != "last_date":
                    assert r["form_last5" if c == "form_w5" else c] == pytest.approx(x), c
                    seen += 1
        kept[r["team"]].append(r)
    assert seen > 1000 and max(map(len, kept.values())) > 40


def test_sides_are_not_widened_before_they_meet(spark):
    long = spark.createDataFrame([(1, "home", 3), (1, "away", 4), (2, "away", None), (2, "home", 5), (3, "home", 6), (4, "away", 7)], "match_id long, side string, x int")
    got = W.by_sides(long, "match_id", ["x"])
    assert "max(" not in plan_of(got)
    assert sorted(map(tuple, got.collect())) == [(1, 3, 4), (2, 5, None), (3, 6, None), (4, None, 7)]


def test_pairs_of_teams_copy_a_team_once_a_block(spark):
    """Both sides are dealt into blocks, in parts that follow the pairs; every ordered pair of rows of other names comes once."""
    teams = spark.createDataFrame([(f"t{i % 90}" if i % 30 else None, i) for i in range(100)], "team string, rank int")
    rows = teams.collect()
    want = sorted((x["team"], x["rank"], y["team"], y["rank"]) for x in rows for y in rows if x["team"] and y["team"] and x["team"] != y["team"])
    for blocks in (None, 1, 7):
        got = joins.pair_matrix(teams, blocks)
        assert plan_of(got).count("Generate explode") == 2 and plan_of(got).count("REPARTITION_BY_NUM") == 2
        assert sorted(map(tuple, got.collect())) == want


@pytest.mark.skipif(not incremental.HAS_KEYED_STATE, reason="needs protobuf")
def test_streamed_teams_cost_no_frame_each(spark, tmp_path):
    """Teams' rows reach their state as rows of one text each, not as a frame for each team; features are those of plain state, over restarts and more matches than are kept."""
    row = lambda i: (f"t{i % 3 if i % 40 else 99}", date(2025, 1, 1) + timedelta(days=i % 50), 1000 - i, (3, 1, 0)[i % 3], i % 5, i % 4, i % 3 - 1)
    batches = [spark.createDataFrame([row(i) for i in ids], "team string, date date, match_id long, points int, gf int, ga int, is_home int") for ids in (range(0, 150, 2), range(1, 150, 2), range(150, 160))]
    made = incremental.stream_team_state(spark.readStream.schema(batches[0].schema).parquet(str(tmp_path)))
    assert "pandas" not in made._jdf.queryExecution().logical().toString()
    keyed, plain = ([sorted(map(tuple, rows)) for rows, _ in run_stream(spark, tmp_path / str(k), batches, lambda s: incremental.stream_team_state(s, keyed=k), "update")] for k in (True, False))  # noqa: B023
    assert keyed == plain and [len(rows) for rows in keyed] == [4, 3, 3]
    assert max(r[1] for rows in keyed for r in rows) > 40


def test_a_leagues_batch_is_held_as_numbers():
    """Of a league's matches no frames, names or dates are held, and ratings leave in frames of bounded size."""
    class State:
        exists = False

        def update(self, value):
            self.value = value

    def frames(n, size=1000):
        for i in range(0, n, size):
            ids = range(i, i + size)
            yield pd.DataFrame({"match_id": ids, "date": [date(2025, 1, 1) + timedelta(days=j * 7 % 50) for j in ids], "home_team": [f"T{j % 20}" for j in ids], "away_team": [f"T{(j + 1 + j % 18) % 20}" for j in ids], "step": 30.0, "advantage": 100.0, "score": [float(j % 2) for j in ids], "home_start": 1500.0, "away_start": 1400.0})

    n = 60_000
    tracemalloc.start()
    rows = {len(out) for out in incremental.elo_state(("L",), frames(n), State())}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 * n and max(rows) <= incremental.CHUNK < n


def test_predictions_fit_one_model_over_matches_made_once(spark, monkeypatch):
    """A query fits no model that it doesn't use, and matches and encoded rows are made once for all passes."""
    fits, made, train, matches = [], [], scoring.train_logreg, testdata.Views.matches
    monkeypatch.setattr(scoring, "train_logreg", lambda rows, *a, **k: (fits.append(plan_of(rows)), train(rows, *a, **k))[1])
    monkeypatch.setattr(testdata.Views, "matches", lambda v: (made.append(v), matches(v))[1])
    rows = QUERIES["j13_predict_batch"](spark, "/root/testdata/sf0.001")
    assert len(fits) == 1 and len(made) == 1 and "_ix" not in fits[0]
    total = F.col("p_a") + F.col("p_d") + F.col("p_h")
    assert rows.where(F.abs(total - 1) < 0.001).count() == matches(testdata.Views(spark, "/root/testdata/sf0.001")).count() > 0


@pytest.fixture
def unbroadcast(spark):
    """Nothing is broadcast for being small, as tables of a large run aren't."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_files(spark):
    """The shuffle files on this machine's disks."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for d in dirs for f in Path(d).glob("*/shuffle_*.data")}


def left_over(spark, before):
    """Shuffle files made since before that stay; they are removed in the background."""
    for _ in range(50):
        if not shuffled_files(spark) - before:
            break
        time.sleep(0.1)
    return shuffled_files(spark) - before


def test_wide_rows_of_the_feature_table_are_not_shuffled(spark, unbroadcast):
    """Only by match, team, pair of teams and, for its key alone, place: never the rows with features by a team or a competition's weight, and never matches by competition or stage."""
    m = league(spark)
    team = F.explode(F.array("home_team", "away_team")).alias("team")
    teams = m.select(team).distinct()
    blocks = {"penalties": teams.select("team", F.lit(1).alias("won"), F.lit(4).alias("played")), "squads": teams.select("team", F.lit(71.0).alias("squad_avg_rating"), F.lit(80.0).alias("top_player_rating")), "stages": spark.createDataFrame([("final", "final")], "raw string, stage string")}
    rates = spark.createDataFrame([(3, 0.5, 0.25, 0.25)], "competition_weight int, h double, d double, a double")
    rated_matches = m.join(elo.elo_replay(m).drop("league"), "match_id")
    table = W.feature_table(rated_matches, rates, **blocks)
    by = set(re.findall(r"hashpartitioning\((\w+?)#", plan_of(table)))
    assert by <= {"match_id", "team", "_t", "a", "league", "_team"} and "SortMergeJoin" in plan_of(table)
    found = {(r["home_penalty_win_rate"], r["away_penalty_win_rate"], r["home_squad_avg_rating"], r["away_top_player_rating"], r["tier_home_rate"], r["stage"]) for r in table.collect()}
    assert found == {(0.25, 0.25, 71.0, 80.0, 0.5, "final")}
    assert table.where("home_goals_for_last5 <> home_attack_w5 or away_long_break <> cast(away_rest_days > 21 as int)").count() == 0


def test_matches_are_not_dealt_by_a_few_names(spark, unbroadcast):
    attrs = spark.createDataFrame([("Cup", 5, 2.0)], "name string, weight int, k double")
    stages = spark.createDataFrame([("last 16", "round_of_16")], "raw string, stage string")
    m = spark.createDataFrame([(1, "cup ", "Last 16"), (2, "x", None)], "match_id long, competition string, tournament_stage string")
    got = B.stage_attrs(B.competition_attrs(m, attrs), stages)
    assert "SortMergeJoin" not in plan_of(got)
    assert sorted((r["match_id"], r["competition_weight"], r["k_multiplier"], r["stage"]) for r in got.collect()) == [(1, 5, 2.0, "round_of_16"), (2, 2, 1.0, "unknown")]


def test_sides_that_are_not_used_are_not_shuffled(spark):
    long = spark.createDataFrame([(1, "home", 3, 4), (1, "away", 5, 6)], "match_id long, side string, used int, unused int")
    got = W.by_sides(long, "match_id", ["used", "unused"]).select("home_used", "away_used")
    assert "unused" not in got._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert got.collect() == [(3, 5)]


def test_what_a_written_table_shuffled_leaves_the_disks(spark):
    before = shuffled_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    out = shared.written(df, "t")
    assert not left_over(spark, before)
    assert out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_a_batch_of_the_feature_store_leaves_its_tables_only(spark, tmp_path, unbroadcast):
    """No shuffle files, no rows in memory; and reading the table shuffles no row of it."""
    m, store = league(spark).cache(), FeatureStore(f"file://{tmp_path}/store", buckets=4)
    m.count()
    before = shuffled_files(spark)
    held = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    store.append(m, 0)
    assert not left_over(spark, before)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == held
    table = store.table(spark)
    assert "SortMergeJoin" not in plan_of(table) and table.count() > m.count() - 1
    m.unpersist()
