"""Reading and writing tables, and flattening nested feeds."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MATCHES = "match_id long, date date, home_team string, away_team string, home_score int, away_score int, competition string, neutral boolean, home_confederation string, away_confederation string, home_fifa_rank int, away_fifa_rank int, tournament_stage string, source string"


def read_matches(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """A typed match table; a column named tournament is the competition. What can't be read as its type is null."""
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    if "tournament" in raw.columns and "competition" not in raw.columns:
        raw = raw.withColumnRenamed("tournament", "competition")
    kinds = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(MATCHES)}
    return raw.select(*(typed(c, kinds.get(c, "string")).alias(c) if raw.schema[c].dataType.simpleString() == "string" else F.col(c) for c in raw.columns))


def typed(name: str, kind: str) -> Column:
    """A string column as another type, null where it can't be read."""
    c = F.trim(F.col(name))
    if kind == "boolean":
        return F.lower(c).isin("true", "1", "yes")
    return F.col(name) if kind == "string" else c.try_cast(kind)


def read_optional(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """The table at path, or an empty one if there is none. Missing columns are an error."""
    wanted = StructType.fromDDL(schema)
    try:
        found = spark.read.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], wanted)
    missing = [c for c in wanted.names if c not in found.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return found.select(*(F.col(f.name).cast(f.dataType) for f in wanted))


FEED = "struct<id:long,utcDate:string,status:string,minute:int,stage:string,`group`:string,homeTeam:struct<name:string>,awayTeam:struct<name:string>,score:struct<fullTime:struct<home:int,away:int>,halfTime:struct<home:int,away:int>>>"


def flatten_match_feed(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each match of JSON documents {"matches": [...]}: id, date, teams and full-time score; missing keys are null."""
    matches = F.from_json(payload, f"struct<matches:array<{FEED}>>")["matches"]
    m = feed.select(F.explode(matches).alias("m"))
    return m.select(
        F.col("m.id").alias("id"), F.to_date(F.substring("m.utcDate", 1, 10)).alias("date"), F.col("m.homeTeam.name").alias("home_team"), F.col("m.awayTeam.name").alias("away_team"),
        F.col("m.score.fullTime.home").alias("home_score"), F.col("m.score.fullTime.away").alias("away_score"),
    )


LIVE = ("IN_PLAY", "PAUSED")


def flatten_live_feed(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each JSON match: status, stage, group without its prefix, half- and full-time scores, an id made of date and teams, TBD for unknown teams, and whether any match is live."""
    m = feed.select(F.from_json(payload, FEED).alias("m"))
    home, away = (F.coalesce(F.col(f"m.{s}Team.name"), F.lit("TBD")) for s in ("home", "away"))
    day = F.substring("m.utcDate", 1, 10)
    rows = m.select(
        F.concat_ws("_", day, home, away).alias("live_id"), day.alias("day"), F.col("m.status").alias("status"), F.col("m.minute").alias("minute"), F.col("m.stage").alias("stage"),
        F.regexp_replace("m.group", "^GROUP_", "").alias("grp"), home.alias("home_team"), away.alias("away_team"),
        F.col("m.score.fullTime.home").alias("home_score"), F.col("m.score.fullTime.away").alias("away_score"), F.col("m.score.halfTime.home").alias("ht_home"), F.col("m.score.halfTime.away").alias("ht_away"),
    )
    live = rows.agg(F.coalesce(F.bool_or(F.col("status").isin(*LIVE)), F.lit(False)).alias("has_live"))
    return rows.crossJoin(F.broadcast(live))  # one row


ROSTER = "map<string,struct<released:boolean,goalkeepers:array<struct<name:string,club:string>>,defenders:array<struct<name:string,club:string>>,midfielders:array<struct<name:string,club:string>>,forwards:array<struct<name:string,club:string>>>>"


def flatten_rosters(rosters: DataFrame, payload: str = "payload") -> DataFrame:
    """A row for each player of JSON maps from team to position groups: team, pos_group, ordinal (from 0), name, club. Teams with released = false are left out."""
    teams = rosters.select(F.explode(F.from_json(payload, ROSTER)).alias("team", "r")).where(F.coalesce("r.released", F.lit(True)))
    groups = F.create_map(*(x for g in ("goalkeepers", "defenders", "midfielders", "forwards") for x in (F.lit(g), F.col(f"r.{g}"))))
    players = teams.select("team", F.explode(groups).alias("pos_group", "players")).select("team", "pos_group", F.posexplode("players").alias("ordinal", "p"))
    return players.select("team", "pos_group", "ordinal", "p.name", "p.club")


def parse_roster_lines(lines: DataFrame) -> DataFrame:
    """A row for each player of text lines(doc, line_no, line). "Position: Name (Club), Name (Club)" lists players; any other line that isn't empty names the team of those that follow."""
    header = ~F.col("line").rlike(r"^[A-Za-z]+:\s") & (F.trim("line") != "")
    order = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = lines.withColumn("team", F.last(F.when(header, F.trim("line")), ignorenulls=True).over(order)).where(~header & (F.trim("line") != ""))
    pattern = r"([^,(:]+?)\s*\(([^)]*)\)"
    players = F.arrays_zip(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("club"))
    rows = carried.select("doc", "team", F.regexp_extract("line", r"^([A-Za-z]+):", 1).alias("position"), F.posexplode(players).alias("ordinal", "p"))
    return rows.select("doc", "team", "position", "ordinal", F.trim("p.name").alias("name"), F.trim("p.club").alias("club"))


def write_table(df: DataFrame, path: str, by_year_of: str | None = None, fmt: str = "parquet") -> None:
    """Writes df, by year of a date column if one is named."""
    if by_year_of:
        df = df.withColumn("year", F.year(by_year_of))
        df.write.mode("overwrite").format(fmt).partitionBy("year").save(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
