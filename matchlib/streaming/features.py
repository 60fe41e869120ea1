"""The feature table kept up to date batch by batch (E18 with L2 and L4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.cleaning import dedup_matches, drop_incomplete
from ..operators import windows as W
from ..operators.aggregates import tier_base_rates
from ..operators.elo import EloConfig, elo_replay
from ..sources.shared import shuffles_dropped
from .incremental import split_late


def left_by(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame | None:
    """What the batch before number has left below path, None before the first. A store that a later batch finds empty is an error, as its rows would start anew."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch={number - 1}")
    except AnalysisException:
        if number > 0:
            raise
        return None


@dataclass(frozen=True)
class LastRows:
    """The last rows (by date and match_id, at most kept) of each key, as a table in buckets by a hash of the key.

    A batch reads the buckets of its keys only, and writes new versions of these. A
    small index, one row a bucket, tells which batch has written a bucket last. No
    batch overwrites what another has written, so one that is run again after a
    failure reads the same and writes the same. What a batch costs depends on the
    keys it touches, not on the rows that were stored before; older versions of a
    bucket are never read again and may be deleted. Choose buckets so that one, with
    kept rows for each of its keys, fits a task.
    """

    path: str
    key: tuple[str, ...]
    kept: int
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def written(self, spark: SparkSession, number: int) -> dict[int, int]:
        """bucket -> the batch before number that has written it last; at most a row for each bucket."""
        found = left_by(spark, f"{self.path}/_index", "bucket int, written int", number)
        return {} if found is None else {r["bucket"]: r["written"] for r in found.collect()}

    def stored(self, rows: DataFrame, schema: StructType | str, number: int) -> tuple[DataFrame, list[int]]:
        """What is stored before batch number in the buckets of the keys of rows, and these buckets."""
        spark = rows.sparkSession
        touched = sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())  # at most buckets
        written = self.written(spark, number)
        folders = [f"{self.path}/batch={written[b]}/bucket={b}" for b in touched if b in written]
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema), touched

    def advanced(self, new: DataFrame, number: int) -> DataFrame:
        """Adds the new rows, all later than those stored of their keys, as batch number, and returns them (_new) after what was stored of the same keys (not _new)."""
        spark = new.sparkSession
        old, touched = self.stored(new, new.schema, number)
        rows = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
        latest = Window.partitionBy(*self.key).orderBy(F.desc("date"), F.desc("match_id"))
        last = rows.drop("_new").withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= self.kept).drop("_n")
        last.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")
        index = sorted((self.written(spark, number) | dict.fromkeys(touched, number)).items())
        spark.createDataFrame(index, "bucket int, written int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_index/batch={number}")
        seen = F.max("_new").over(Window.partitionBy(*self.key))
        return rows.withColumn("_touched", seen).where("_touched").drop("_touched")


class FeatureStore:
    """The feature table of results that come in batches, each later than all before it.

    Features need a team's last 30 matches, a pair's last 10 and the ratings: these
    are kept as LastRows. A batch reads them for the teams and pairs that play, and
    writes its rated matches and its features, a row for each match, as a partition
    of its own. Its rows are written first (arrived), in the place of those of the
    batch before, and what a write has shuffled leaves the disks with it. What later
    matches change (shares of results by competition, the weight by age) and what
    follows from a row alone (swapped sides, differences) is added by table(). So
    table() equals windows.feature_table over all matches.

    path: below a folder that the driver and all executors share. start(team, rating):
    as in elo_replay. blocks: the optional tables of windows.feature_table; a batch
    takes what they hold when it is added. A match without a league counts for league ''.
    """

    KEPT, MEETINGS = 30, 10
    FIRST_DAY = "0001-01-01"
    RATING = "league string, team string, date date, match_id long, rating double"

    def __init__(self, path: str, config: EloConfig = EloConfig(), start: DataFrame | None = None, buckets: int = 64, **blocks):
        self.path, self.config, self.start, self.blocks = path.rstrip("/"), config, start, blocks
        self.teams = LastRows(f"{self.path}/teams", ("team",), self.KEPT, buckets)
        self.pairs = LastRows(f"{self.path}/pairs", ("a", "b"), self.MEETINGS, buckets)
        self.ratings = LastRows(f"{self.path}/ratings", ("league", "team"), 1, buckets)

    def mark(self, spark: SparkSession, number: int) -> DataFrame:
        """One row: mark, the last date added before batch number."""
        found = left_by(spark, f"{self.path}/marks", "mark date", number)
        return spark.range(1).select(F.lit(self.FIRST_DAY).cast("date").alias("mark")) if found is None else found

    def _rated(self, matches: DataFrame, number: int) -> DataFrame:
        """matches with ratings before and after, written as batch number of the rated matches."""
        spark = matches.sparkSession
        playing = matches.select("league", F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
        before, _ = self.ratings.stored(playing, self.RATING, number)
        start = playing.join(before.select("league", "team", "rating"), ["league", "team"], "left")
        if self.start is not None:
            given = self.start.select("team", F.col("rating").alias("_given"))
            start = start.join(given, "team", "left").withColumn("rating", F.coalesce("rating", "_given"))
        start = start.select("league", "team", "rating").fillna(self.config.start, ["rating"])
        out = matches.join(elo_replay(matches, self.config, start).drop("league"), "match_id")
        out.write.mode("overwrite").parquet(f"{self.path}/rated/batch={number}")
        return spark.read.schema(out.schema).parquet(f"{self.path}/rated/batch={number}")

    def append(self, matches: DataFrame, number: int) -> None:
        """Adds matches (with league, competition_weight and k_multiplier) as batch number, the one after the batch before; all are later than the mark, and match_id is unique. Adding a batch again replaces it."""
        with shuffles_dropped(matches.sparkSession):
            self._append(matches, number)

    def _append(self, matches: DataFrame, number: int) -> None:
        spark = matches.sparkSession
        matches = matches.withColumns({"league": F.coalesce("league", F.lit("")), "match_id": F.col("match_id").cast("long")})
        matches.write.mode("overwrite").parquet(f"{self.path}/arrived")
        rated = self._rated(spark.read.schema(matches.schema).parquet(f"{self.path}/arrived"), number)
        sides = F.explode(F.array(*(F.struct(F.col(f"{s}_team").alias("team"), F.col(f"{s}_elo_post").alias("rating")) for s in ("home", "away")))).alias("s")
        self.ratings.advanced(rated.select("league", "date", "match_id", sides).select("league", "s.team", "date", "match_id", "s.rating"), number)
        long = W.team_features(self.teams.advanced(W.long_table(rated, W.OPPONENT), number), adjusted=True).where("_new")
        record = W.record_before(self.pairs.advanced(W.pair_meetings(rated), number), self.MEETINGS, "_new").where("_new").drop("_new")
        W.match_features(rated, long, record, **self.blocks).write.mode("overwrite").parquet(f"{self.path}/features/batch={number}")
        last = rated.select(F.col("date").alias("mark"))
        self.mark(spark, number).unionByName(last).agg(F.max("mark").alias("mark")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")

    def features(self, spark: SparkSession) -> DataFrame:
        """A row for each match added, as windows.match_features has it."""
        return spark.read.parquet(f"{self.path}/features").drop("batch")

    def table(self, spark: SparkSession, base_rates: DataFrame | None = None, **options) -> DataFrame:
        """The feature table of all matches added; base_rates: their own, unless given. options: those of windows.both_orientations."""
        features = self.features(spark)
        rates = base_rates if base_rates is not None else tier_base_rates(features.select("competition_weight", "home_score", "away_score")).where("competition_weight is not null")
        return W.both_orientations(features, rates, features.select("date"), **options)


def stream_features(stream: DataFrame, store: FeatureStore, checkpoint: str, late_path: str | None = None, **trigger):
    """A started query that adds a stream of matches to the store, a micro-batch at a time. Of complete rows those later than the mark count, one for each match_id; rows no later than it and those without a date go to late_path."""

    def each(batch: DataFrame, number: int) -> None:
        on_time, late = split_late(batch, store.mark(batch.sparkSession, number))
        if late_path:
            late.write.mode("overwrite").parquet(f"{late_path}/batch={number}")
        store.append(dedup_matches(drop_incomplete(on_time), ("match_id",), ("date", "home_team", "away_team")), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()
