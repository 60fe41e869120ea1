"""Incremental results, in batch and by Structured Streaming."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.cleaning import drop_incomplete, points, resolve_names
from ..operators.sets import new_rows_only
from ..operators.standings import league_table

KEY = ("date", "home_team", "away_team")


def high_water_mark(stored: DataFrame, fallback: str = "2020-01-01") -> DataFrame:
    """One row: mark, the last date stored."""
    return stored.agg(F.coalesce(F.max("date"), F.lit(fallback).cast("date")).alias("mark"))


def rows_to_append(stored: DataFrame, incoming: DataFrame, aliases: DataFrame, since: str | None = None) -> DataFrame:
    """Completed incoming rows after the mark (or from since on), with canonical names, that aren't stored yet. Rows that repeat within incoming all stay."""
    done = drop_incomplete(incoming)
    if since is None:
        done = done.crossJoin(F.broadcast(high_water_mark(stored))).where("date > mark").drop("mark")  # one row
    else:
        done = done.where(F.col("date") >= F.lit(since).cast("date"))
    return new_rows_only(resolve_names(done, aliases, ["home_team", "away_team"]), stored, KEY)


def incremental_append(path: str, incoming: DataFrame, aliases: DataFrame, since: str | None = None) -> int:
    """Appends to the Parquet table at path what is new in incoming; returns how many rows."""
    spark = incoming.sparkSession
    new = rows_to_append(spark.read.parquet(path), incoming, aliases, since).persist()
    n = new.count()
    if n:
        new.select(spark.read.parquet(path).columns).write.mode("append").parquet(path)
    new.unpersist()
    return n


def mark_before(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The mark after the batch before this one: one row of the small table of marks, or, where there is none yet, from a scan of the table at path."""
    try:
        return spark.read.schema("mark date").parquet(f"{path}/_marks/batch={number - 1}")
    except AnalysisException:
        return high_water_mark(spark.read.parquet(path).where(F.col("batch") < number))


def append_stream(stream: DataFrame, path: str, aliases: DataFrame, checkpoint: str, late_path: str | None = None, **trigger):
    """A started query that appends each batch's new rows to the table at path, which is partitioned by batch (-1: what was there before); rows no later than the mark, and those without a date, go to late_path.

    What is on time is later than all that is stored, so nothing of it can be stored
    already: a batch reads the mark that the batch before it has left, one row, and
    never the table. It writes its own partitions and mark, so a batch that is run
    again after a failure changes nothing. append_late stores what is new among late rows.
    """
    columns = stream.sparkSession.read.parquet(path).drop("batch").columns

    def each(batch: DataFrame, number: int) -> None:
        mark = mark_before(batch.sparkSession, path, number)
        on_time, late = split_late(batch, mark)
        if late_path:
            late.write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        new = resolve_names(drop_incomplete(on_time), aliases, ["home_team", "away_team"]).select(columns)
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")
        stored = batch.sparkSession.read.schema(new.schema).parquet(f"{path}/batch={number}").select(F.col("date").alias("mark"))
        mark.unionByName(stored).agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{path}/_marks/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def by_month(rows: DataFrame, path: str) -> None:
    """Writes rows to a table partitioned by month, in which append_late finds the days of a batch."""
    rows.withColumn("month", F.date_format("date", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def append_late(path: str, late: DataFrame, aliases: DataFrame) -> int:
    """Appends to the table at path, as by_month writes it, what of late isn't stored yet, and returns how many rows; rows without a date stay out. Only the months of late are read: at most a folder each, named by the driver."""
    spark = late.sparkSession
    done = resolve_names(drop_incomplete(late.where("date is not null")), aliases, ["home_team", "away_team"]).withColumn("month", F.date_format("date", "yyyy-MM")).persist()
    months = [r["month"] for r in done.select("month").distinct().collect()]
    stored = spark.read.schema(done.schema).parquet(path).where(F.col("month").isin(months))
    new = new_rows_only(done, stored, KEY).drop("month").persist()
    n = new.count()
    if n:
        by_month(new, path)
    for held in (new, done):
        held.unpersist()
    return n


def split_late(batch: DataFrame, mark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows after the mark, all others: those no later than it and those without a date)."""
    marked = batch.crossJoin(F.broadcast(mark))  # one row
    after = F.coalesce(F.col("date") > F.col("mark"), F.lit(False))
    return marked.where(after).drop("mark"), marked.where(~after).drop("mark")


def stream_dedup(stream: DataFrame, key: list[str], time: str, delay: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


STATE = "dates array<string>, points array<int>, gf array<int>, ga array<int>, home array<int>, played long"
TEAM_STATE = (
    "team string, n_matches long, form_w3 double, form_w5 double, form_w10 double, attack_w5 double, defense_w5 double, form_rw5 double, attack_rw5 double, defense_rw5 double, clean_sheet_rate_w5 double, gd_form_w5 double, draw_rate_w5 double, "
    "home_form_w5 double, away_form_w5 double, win_streak int, unbeaten_streak int, loss_streak int, last_date string"
)


def team_features(dates: list[str], points: list[int], gf: list[int], ga: list[int], home: list[int]) -> dict:
    """The per-team features after the last of some matches, by the definitions of the window features."""
    mean = lambda x, d=1.0: sum(x) / len(x) if len(x) else d
    days = [date.fromisoformat(d).toordinal() for d in dates[-5:]]
    weights = [0.5 ** ((days[-1] - d) / 180.0) for d in days]
    recent = lambda x: sum(w * v for w, v in zip(weights, x[-5:])) / sum(weights)
    run = lambda ok: next((i for i, p in enumerate(reversed(points[-10:])) if not ok(p)), len(points[-10:]))
    at = lambda side: mean([p for p, h in zip(points, home) if h == side][-5:], 1.5)
    return {
        **{f"form_w{n}": mean(points[-n:]) for n in (3, 5, 10)}, "attack_w5": mean(gf[-5:]), "defense_w5": mean(ga[-5:]), "form_rw5": recent(points), "attack_rw5": recent(gf), "defense_rw5": recent(ga),
        "clean_sheet_rate_w5": mean([a == 0 for a in ga[-5:]]), "gd_form_w5": mean([max(-4, min(4, f - a)) for f, a in zip(gf[-5:], ga[-5:])]), "draw_rate_w5": mean([f == a for f, a in zip(gf[-5:], ga[-5:])]),
        "home_form_w5": at(1), "away_form_w5": at(0), "win_streak": run(lambda p: p == 3), "unbeaten_streak": run(lambda p: p >= 1), "loss_streak": run(lambda p: p == 0), "last_date": dates[-1],
    }


def team_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, kept: int = 30) -> Iterator[pd.DataFrame]:
    """The last matches of a team, at most kept of them; emits its features after the batch. Rows of a batch are applied in order of date and match_id; is_home is 1, 0 or, on neutral ground, -1."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["date", "match_id"])
    dates, *numbers, played = state.get if state.exists else ([], [], [], [], [], 0)
    dates = [*dates, *rows["date"].astype(str)][-kept:]
    numbers = [[*map(int, old), *map(int, rows[c])][-kept:] for old, c in zip(numbers, ("points", "gf", "ga", "is_home"))]
    played += len(rows)
    state.update((dates, *numbers, played))
    yield pd.DataFrame([{"team": key[0], "n_matches": played, **team_features(dates, *numbers)}])


try:  # keyed state needs protobuf
    import google.protobuf  # noqa: F401
    from pyspark.sql.streaming import StatefulProcessor

    HAS_KEYED_STATE = True
except ImportError:
    StatefulProcessor, HAS_KEYED_STATE = object, False

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_keyed_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, mode: str, rows: bool = False, time: str = "None") -> DataFrame:
    """stream through a stateful processor for each key: of few keys in pandas frames, of many keys row by row, as a frame for each key costs more than its rows. State lies in a RocksDB store, which the session is set to."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    groups = stream.groupBy(key)
    return (groups.transformWithState if rows else groups.transformWithStateInPandas)(processor, schema, mode, time)


class TeamProcessor(StatefulProcessor):
    """A team's last matches, a text each as packed() has it, and how many it has played, read and written as one value. Of a batch's rows no more than are kept are held."""

    def __init__(self, kept: int = 30):
        self.kept = kept

    def init(self, handle) -> None:
        self.matches = handle.getValueState("matches", "matches array<string>, played long")

    def handleInputRows(self, key, rows, timers):  # noqa: N802
        old, played = self.matches.get() or ([], 0)
        last, count = [], 0
        for count, r in enumerate(rows, 1):
            match = r["match"]
            day, match_id, _ = match.split(" ", 2)
            (heapq.heappush if count <= self.kept else heapq.heappushpop)(last, (day, int(match_id), count, match))
        matches = [*old, *(m for *_, m in sorted(last))][-self.kept :]
        self.matches.update((matches, played + count))
        dates, _, *numbers = zip(*(m.split(" ") for m in matches))
        yield Row(team=key[0], n_matches=played + count, **team_features(dates, *(list(map(int, x)) for x in numbers)))

    def close(self) -> None:
        pass


def packed(long: DataFrame) -> DataFrame:
    """team and match, a text of all else that the state needs: a worker pays for each column of each row."""
    parts = [x for c in ("date", "match_id", "points", "gf", "ga", "is_home") for x in (F.lit(" "), F.col(c).cast("string"))]
    return long.select("team", F.concat(*parts[1:]).alias("match"))


def stream_team_state(long: DataFrame, keyed: bool = HAS_KEYED_STATE) -> DataFrame:
    """Per-team rolling state of a stream of the long table (team, date, match_id, points, gf, ga, is_home): a row for each team that a batch touches, and only their state is read and written."""
    if keyed:
        return with_keyed_state(packed(long), "team", TeamProcessor(), TEAM_STATE, "Update", rows=True)
    return long.groupBy("team").applyInPandasWithState(team_state, TEAM_STATE, STATE, "update", GroupStateTimeout.NoTimeout)


ELO_STATE = "teams array<string>, ratings array<double>"
ELO_OUT = "league string, match_id long, home_elo_pre double, away_elo_pre double"


#: Matches of a league that are taken from arrays and emitted at a time.
CHUNK = 10_000


def gathered(batches: Iterator[pd.DataFrame]) -> tuple[dict[str, int], dict[str, np.ndarray]]:
    """(number of each team, columns as arrays of numbers) of a league's matches in a batch: what is held of a match is 64 bytes, no names, dates or frames."""
    teams: dict[str, int] = {}
    held: dict[str, list[np.ndarray]] = {c: [] for c in ("date", "match_id", "home_team", "away_team", "step", "advantage", "score", "home_start", "away_start")}
    for rows in batches:
        for c, arrays in held.items():
            if c.endswith("team"):
                arrays.append(np.fromiter((teams.setdefault(t, len(teams)) for t in rows[c]), np.int32, len(rows)))
            else:
                arrays.append(rows[c].to_numpy().astype("datetime64[D]" if c == "date" else np.int64 if c == "match_id" else np.float64))
    return teams, {c: np.concatenate(held.pop(c)) for c in list(held)}


def rated_in_order(columns: dict[str, np.ndarray], rating: dict[int, float]) -> Iterator[pd.DataFrame]:
    """Applies matches in order of date and match_id to the ratings by number of team, all of them at once; then gives match_id and the ratings before each match in frames. Start ratings give way to these ratings, so nothing more is held."""
    order = np.lexsort((columns["match_id"], columns.pop("date")))
    chunks = [order[i : i + CHUNK] for i in range(0, len(order), CHUNK)]
    for at in chunks:
        pre = []
        for h, a, k, advantage, score, x, y in zip(*(columns[c][at].tolist() for c in ("home_team", "away_team", "step", "advantage", "score", "home_start", "away_start"))):
            x, y = rating.get(h, x), rating.get(a, y)
            change = k * (score - 1.0 / (1.0 + 10.0 ** ((y - x - advantage) / 400.0)))
            pre.append((x, y))
            rating[h], rating[a] = x + change, y - change
        columns["home_start"][at], columns["away_start"][at] = np.array(pre).T
    return (pd.DataFrame({"match_id": columns["match_id"][at], "home_elo_pre": columns["home_start"][at], "away_elo_pre": columns["away_start"][at]}) for at in chunks)


def elo_state(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The ratings of a league's teams; emits those before each match. Rows of a batch are applied in order of date and match_id."""
    teams, columns = gathered(batches)
    rating = {teams.setdefault(t, len(teams)): r for t, r in zip(*(state.get if state.exists else ([], [])))}
    rated = rated_in_order(columns, rating)
    state.update(([t for t, i in teams.items() if i in rating], [rating[i] for i in teams.values() if i in rating]))
    for rows in rated:
        yield rows.assign(league=key[0])[["league", *rows.columns]]


class EloProcessor(StatefulProcessor):
    """The ratings of a league's teams, a map whose entries are read and written one by one: only those of teams that play."""

    def init(self, handle) -> None:
        self.ratings = handle.getMapState("ratings", "team string", "rating double")

    def handleInputRows(self, key, batches, timers):  # noqa: N802
        teams, columns = gathered(batches)
        rating = {i: self.ratings.getValue((t,))[0] for t, i in teams.items() if self.ratings.containsKey((t,))}
        rated = rated_in_order(columns, rating)
        for team, i in teams.items():
            self.ratings.updateValue((team,), (rating[i],))
        for rows in rated:
            yield rows.assign(league=key[0])[["league", *rows.columns]]

    def close(self) -> None:
        pass


def stream_elo(steps: DataFrame, keyed: bool = HAS_KEYED_STATE) -> DataFrame:
    """Ratings before each match of a stream of elo_steps with start ratings (elo.with_start). Both teams of a match share their league's state, so a league is one group of each batch: bound batches by the source's maxFilesPerTrigger; a task holds 64 bytes for each match of a league's batch. Its teams' ratings are entries of their own, so a batch costs what it touches, not what the league holds."""
    if keyed:
        return with_keyed_state(steps, "league", EloProcessor(), ELO_OUT, "Append")
    return steps.groupBy("league").applyInPandasWithState(elo_state, ELO_OUT, ELO_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_live_table(updates: DataFrame, keep: str = "7 days") -> DataFrame:
    """The live table of a stream of updates, event_time a timestamp: a row for each match whose state a batch changes, in update mode; the row with the last event_time of a match counts. A match's state is dropped when the watermark, keep behind the latest event, has passed its stretch of time (of length keep), so what is kept are the matches of twice that time; later news than the watermark are ignored."""
    newest = F.max_by(F.struct("status", "home_score", "away_score"), F.struct("event_time", "event_id")).alias("l")
    last = F.max(F.struct("event_time", "event_id")).alias("at")
    return updates.withWatermark("event_time", keep).groupBy("match_id", F.window("event_time", keep)).agg(newest, last).select("match_id", "l.*", "at.event_time", "at.event_id")


def live_table(updates: DataFrame) -> DataFrame:
    """The latest state of each match of updates(match_id, event_time, event_id, status, home_score, away_score)."""
    return updates.groupBy("match_id").agg(F.max_by(F.struct("status", "home_score", "away_score"), F.struct("event_time", "event_id")).alias("l")).select("match_id", "l.*")


def live_standings(live: DataFrame, fixtures: DataFrame, group_team: DataFrame) -> DataFrame:
    """The league table of group_team(grp, team, seed_pos) after the finished matches of a live table, by fixtures(match_id, grp, home_team, away_team)."""
    finished = live.where("status = 'FINISHED'").select("match_id", "home_score", "away_score").join(fixtures, "match_id")
    return league_table(group_team, finished.select("grp", "home_team", "away_team", "home_score", "away_score"))


def long_points(matches: DataFrame) -> DataFrame:
    """The long table's columns that team_state needs."""
    home = lambda x: F.when(F.col("neutral"), -1).otherwise(x).alias("is_home")
    sides = F.array(*(F.struct(F.col(f"{m}_team").alias("team"), F.col(f"{m}_score").alias("gf"), F.col(f"{o}_score").alias("ga"), home(x)) for m, o, x in (("home", "away", 1), ("away", "home", 0))))
    return matches.select("match_id", "date", F.explode(sides).alias("s")).select("s.team", "date", "match_id", points(F.col("s.gf"), F.col("s.ga")).alias("points"), "s.gf", "s.ga", "s.is_home")
