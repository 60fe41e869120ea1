"""Match tables as views of the star schema, in Spark and in SQL.

All are integer arithmetic over whole tables, so both sides agree exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import scale_rank
from ..sources.shared import dealt

STAGE_NAMES = ["Unknown", "Group Stage", "Round of 16", "Quarterfinal", "semifinal", "Final", "third-place", "qualification"]
CONFEDERATIONS = {"AFRICA": (90.0, 0.9), "AMERICA": (110.0, 1.0), "ASIA": (80.0, 0.85), "EUROPE": (80.0, 1.0), "MIDDLE EAST": (60.0, 0.65)}
TIERS = {"EUROPE": 6, "AMERICA": 5, "ASIA": 3, "AFRICA": 3}
COMPETITIONS = [("1-URGENT", 5, 2.0), ("2-HIGH", 4, 1.5), ("3-MEDIUM", 3, 1.25), ("4-NOT SPECIFIED", 2, 1.0), ("5-LOW", 1, 0.5)]
POSITIONS = ["GK", "DEF", "MID", "FWD", "DEF"]

_STAGE_LIST = ", ".join(f"'{s}'" for s in STAGE_NAMES)

SQL = {
    "t": "t AS (SELECT count(*) AS n FROM supplier)",
    "team": "team AS (SELECT s_suppkey AS id, 'T' || s_suppkey AS team, r_name AS confederation, CAST(s_suppkey % 210 + 1 AS INT) AS rank, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "matches": f"""m0 AS (
  SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS price, o_custkey % n AS h, (o_custkey % n + 1 + o_orderkey % (n - 1)) % n AS a FROM orders, t
), matches AS (
  SELECT o_orderkey AS match_id, CAST(o_orderdate AS DATE) AS date, x.team AS home_team, y.team AS away_team, CAST(price % 5 AS INT) AS home_score, CAST((price // 7) % 4 AS INT) AS away_score,
    o_orderpriority AS competition, o_orderstatus = 'P' AS neutral, x.confederation AS home_confederation, y.confederation AS away_confederation, x.rank AS home_fifa_rank, y.rank AS away_fifa_rank,
    [{_STAGE_LIST}][CAST(o_orderkey % 8 + 1 AS INT)] AS tournament_stage, o_orderpriority AS league
  FROM m0 JOIN team x ON x.id = h JOIN team y ON y.id = a
)""",
    "attrs": "attrs(name, weight, k) AS (VALUES " + ", ".join(f"('{n}', {w}, CAST({k} AS DOUBLE))" for n, w, k in COMPETITIONS) + ")",
    "lng": """lng AS (
  SELECT match_id, date, home_team AS team, away_team AS opponent, 'home' AS side, home_score AS gf, away_score AS ga, CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS points, CASE WHEN NOT neutral THEN TRUE END AS is_home FROM matches
  UNION ALL
  SELECT match_id, date, away_team, home_team, 'away', away_score, home_score, CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END, CASE WHEN NOT neutral THEN FALSE END FROM matches
)""",
    "predictions": """w0 AS (
  SELECT match_id, date, tournament_stage, competition, CASE WHEN home_score > away_score THEN 2 WHEN home_score = away_score THEN 1 ELSE 0 END AS y, match_id % 5 AS win, unnest([1, 2, 3]) AS m FROM matches
), w1 AS (
  SELECT *, 1 + (match_id * 3 + m) % 5 AS a, 1 + (match_id + m) % 4 AS d, 1 + (match_id * 7 + m * y) % 6 AS h FROM w0
), predictions AS (
  SELECT match_id, date, tournament_stage, competition, y, win, 'model' || m AS model, a / (a + d + h) AS p_a, d / (a + d + h) AS p_d, h / (a + d + h) AS p_h FROM w1
)""",
    "outcomes": "outcomes AS (SELECT o_orderkey // 25 AS sim_id, 'T' || (o_custkey % n) AS team, ['group', 'r32', 'r16', 'qf', 'sf', 'third', 'final', 'champion'][CAST(o_orderkey % 8 + 1 AS INT)] AS stage, o_orderkey % 16 AS slot FROM orders, t)",
    "rank_history": "rank_history AS (SELECT team, date, min(rank) AS rank FROM (SELECT 'T' || (o_custkey % n) AS team, CAST(o_orderdate AS DATE) AS date, CAST(CAST(floor(o_totalprice) AS BIGINT) % 210 + 1 AS INT) AS rank FROM orders, t WHERE o_orderkey % 3 = 0) GROUP BY team, date)",
    "players": "players AS (SELECT c_custkey AS player_id, 'N' || c_nationkey AS nation, c_name AS name, ['GK', 'DEF', 'MID', 'FWD', 'DEF'][CAST(c_custkey % 5 + 1 AS INT)] AS position FROM customer)",
    "ratings": "ratings AS (SELECT o_custkey AS player_id, CAST(o_orderdate AS DATE) AS rating_date, max(CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 40 + 55.0 END) AS overall_rating FROM orders GROUP BY 1, 2)",
    "rosters": "rosters AS (SELECT DISTINCT 'T' || (o_custkey % n) AS team, o_custkey AS player_id, CAST(o_orderdate AS DATE) AS joined_date, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(30 * (o_orderkey % 12) AS INT) END AS left_date FROM orders, t WHERE o_orderkey % 4 = 0)",
    "start": "start AS (SELECT team, id, CASE WHEN id % 5 = 0 THEN 1450.0 ELSE greatest(1500.0, 1900.0 - (greatest(1, rank) - 1) * 400.0 / 210.0) END AS rating FROM team)",
    "penalties": "penalties AS (SELECT team, id % 3 AS won, id % 4 AS played FROM team WHERE id % 2 = 0)",
    "squads": "squads AS (SELECT team, 60.0 + id % 30 AS squad_avg_rating, 70.0 + id % 25 AS top_player_rating FROM team WHERE id % 4 <> 0)",
    "injuries": "injuries AS (SELECT DISTINCT o_custkey AS player_id, CAST(o_orderdate AS DATE) AS from_date, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(10 * (o_orderkey % 12) AS INT) END AS to_date FROM orders WHERE o_orderkey % 4 = 1)",
    "pairs": "pairs AS (SELECT x.n_name AS home, y.n_name AS away, (1 + (x.n_nationkey * 3 + y.n_nationkey) % 7) AS wh, (1 + (x.n_nationkey + y.n_nationkey * 5) % 4) AS wd, (1 + (x.n_nationkey * 2 + y.n_nationkey * 3) % 6) AS wa FROM nation x JOIN nation y ON x.n_nationkey <> y.n_nationkey)",
}
NEEDS = {"matches": ["t", "team"], "lng": ["matches"], "predictions": ["matches"], "outcomes": ["t"], "rank_history": ["t"], "rosters": ["t"], "start": ["team"], "penalties": ["team"], "squads": ["team"]}


def with_views(*names: str, recursive: bool = False) -> str:
    """WITH and the named views and all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in order)


class Views:
    """The same views in Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def with_n(self, df: DataFrame) -> DataFrame:
        """df with n, the number of teams; one row is broadcast."""
        return df.crossJoin(F.broadcast(self.table("supplier").agg(F.count("*").alias("n"))))

    def team(self) -> DataFrame:
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return s.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("T"), "s_suppkey").alias("team"), F.col("r_name").alias("confederation"), (F.col("s_suppkey") % 210 + 1).cast("int").alias("rank"), F.col("n_name").alias("nation"))

    def matches(self) -> DataFrame:
        price = F.floor("o_totalprice").cast("long")
        h = F.col("o_custkey") % F.col("n")
        base = self.with_n(self.table("orders")).select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", price.alias("price"), h.alias("h"), ((h + 1 + F.col("o_orderkey") % (F.col("n") - 1)) % F.col("n")).alias("a"))
        x, y = (self.team().select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "team", "confederation", "rank"))) for s in ("home", "away"))
        n = self.table("orders").count()
        joined = dealt(dealt(base, "h", n).join(x, F.col("h") == F.col("home_id")), "a", n).join(y, F.col("a") == F.col("away_id"))
        stage = F.element_at(F.array(*map(F.lit, STAGE_NAMES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
        return joined.select(
            F.col("o_orderkey").alias("match_id"), F.to_date("o_orderdate").alias("date"), "home_team", "away_team", (F.col("price") % 5).cast("int").alias("home_score"), (F.expr("price div 7") % 4).cast("int").alias("away_score"),
            F.col("o_orderpriority").alias("competition"), (F.col("o_orderstatus") == "P").alias("neutral"), "home_confederation", "away_confederation", F.col("home_rank").alias("home_fifa_rank"), F.col("away_rank").alias("away_fifa_rank"),
            stage.alias("tournament_stage"), F.col("o_orderpriority").alias("league"),
        )

    def attrs(self) -> DataFrame:
        return self.spark.createDataFrame(COMPETITIONS, "name string, weight int, k double")

    def predictions(self) -> DataFrame:
        y = F.when(F.col("home_score") > F.col("away_score"), 2).when(F.col("home_score") == F.col("away_score"), 1).otherwise(0)
        m = self.matches().select("match_id", "date", "tournament_stage", "competition", y.alias("y"), (F.col("match_id") % 5).alias("win"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("m"))
        w = {"a": 1 + (F.col("match_id") * 3 + F.col("m")) % 5, "d": 1 + (F.col("match_id") + F.col("m")) % 4, "h": 1 + (F.col("match_id") * 7 + F.col("m") * F.col("y")) % 6}
        total = w["a"] + w["d"] + w["h"]
        return m.select("match_id", "date", "tournament_stage", "competition", "y", "win", F.concat(F.lit("model"), "m").alias("model"), *((w[c] / total).alias(f"p_{c}") for c in "adh"))

    def outcomes(self) -> DataFrame:
        from ..operators.aggregates import STAGES

        stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 8 + 1).cast("int"))
        return self.with_n(self.table("orders")).select(F.expr("o_orderkey div 25").alias("sim_id"), F.concat(F.lit("T"), F.col("o_custkey") % F.col("n")).alias("team"), stage.alias("stage"), (F.col("o_orderkey") % 16).alias("slot"))

    def rank_history(self) -> DataFrame:
        rows = self.with_n(self.table("orders")).where("o_orderkey % 3 = 0").select(F.concat(F.lit("T"), F.col("o_custkey") % F.col("n")).alias("team"), F.to_date("o_orderdate").alias("date"), (F.floor("o_totalprice") % 210 + 1).cast("int").alias("rank"))
        return rows.groupBy("team", "date").agg(F.min("rank").alias("rank"))

    def players(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("player_id"), F.concat(F.lit("N"), "c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.element_at(F.array(*map(F.lit, POSITIONS)), (F.col("c_custkey") % 5 + 1).cast("int")).alias("position"))

    def ratings(self) -> DataFrame:
        value = F.when(F.col("o_orderkey") % 13 != 0, (F.floor("o_totalprice") % 40 + 55).cast("double"))
        return self.table("orders").groupBy(F.col("o_custkey").alias("player_id"), F.to_date("o_orderdate").alias("rating_date")).agg(F.max(value).alias("overall_rating"))

    def _interval(self, rest: int, days: int, team: bool) -> DataFrame:
        day = F.to_date("o_orderdate")
        end = F.when(F.col("o_orderkey") % 11 != 0, F.date_add(day, (days * (F.col("o_orderkey") % 12)).cast("int")))
        first = [F.concat(F.lit("T"), F.col("o_custkey") % F.col("n")).alias("team")] if team else []
        a, b = ("joined_date", "left_date") if team else ("from_date", "to_date")
        return self.with_n(self.table("orders")).where(F.col("o_orderkey") % 4 == rest).select(*first, F.col("o_custkey").alias("player_id"), day.alias(a), end.alias(b)).distinct()

    def rosters(self) -> DataFrame:
        return self._interval(0, 30, True)

    def start(self) -> DataFrame:
        """Start ratings by rank; every fifth team has none."""
        return self.team().select("team", scale_rank(F.when(F.col("id") % 5 != 0, F.col("rank"))).alias("rating"))

    def penalties(self) -> DataFrame:
        return self.team().where("id % 2 = 0").select("team", (F.col("id") % 3).alias("won"), (F.col("id") % 4).alias("played"))

    def squads(self) -> DataFrame:
        return self.team().where("id % 4 <> 0").select("team", (F.lit(60.0) + F.col("id") % 30).alias("squad_avg_rating"), (F.lit(70.0) + F.col("id") % 25).alias("top_player_rating"))

    def injuries(self) -> DataFrame:
        return self._interval(1, 10, False)

    def pairs(self) -> DataFrame:
        x, y = (self.table("nation").select(F.col("n_name").alias(n), F.col("n_nationkey").alias(k)) for n, k in (("home", "i"), ("away", "j")))
        i, j = F.col("i"), F.col("j")
        return x.join(y, i != j).select("home", "away", (1 + (i * 3 + j) % 7).alias("wh"), (1 + (i + j * 5) % 4).alias("wd"), (1 + (i * 2 + j * 3) % 6).alias("wa"))

    def pair_probabilities(self) -> DataFrame:
        total = F.col("wh") + F.col("wd") + F.col("wa")
        return self.pairs().select("home", "away", *((F.col(f"w{c}") / total).alias(f"p_{c}") for c in "hda"))
