"""Queries for sources and sinks, and for incremental and streaming results (A, L)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import elo as R
from ..sources import feeds as A
from ..sources import shared
from ..streaming import incremental as L
from ..streaming.features import FeatureStore, stream_features
from .join_queries import _COLUMNS, _ELO, CONFIG, elo_matches, features_sql, places, rounded, table_sql
from .queries import query, r6, registry, with_variants
from .testdata import TIERS, Views, with_views


def scratch(v: Views, label: str) -> str:
    return shared.scratch(v.spark, label)


_KEYS = "match_id, date, home_team, away_team, home_score, away_score, competition, neutral"


@query("a1_read_matches", with_views("matches") + f" SELECT {_KEYS} FROM matches", dates=("date",))
def a1(v: Views) -> DataFrame:
    path = scratch(v, "matches")
    v.matches().select(*_KEYS.split(", ")).withColumnRenamed("competition", "tournament").write.option("header", True).csv(path)
    return A.read_matches(v.spark, path).select(*_KEYS.split(", "))


@query("a2_read_optional", "SELECT r_regionkey, r_name FROM region")
def a2(v: Views) -> DataFrame:
    schema = "r_regionkey int, r_name string"
    return A.read_optional(v.spark, f"{v.sf_dir}/region.parquet", schema).unionByName(A.read_optional(v.spark, f"{v.sf_dir}/no_such_table.parquet", schema))


def match_json(v: Views):
    """One struct for each match, as a feed has it."""
    k = F.col("match_id")
    score = lambda h, a: F.struct(h.alias("home"), a.alias("away"))
    half = score(F.floor(F.col("home_score") / 2).cast("int"), F.floor(F.col("away_score") / 2).cast("int"))
    return F.struct(
        k.alias("id"), F.concat(F.col("date").cast("string"), F.lit("T18:00:00Z")).alias("utcDate"), F.when(k % 50 == 0, "IN_PLAY").otherwise("FINISHED").alias("status"), F.lit("GROUP_STAGE").alias("stage"), F.concat(F.lit("GROUP_"), k % 4).alias("group"),
        F.struct(F.col("home_team").alias("name")).alias("homeTeam"), F.when(k % 9 != 0, F.struct(F.col("away_team").alias("name"))).alias("awayTeam"), F.struct(score(F.col("home_score"), F.col("away_score")).alias("fullTime"), half.alias("halfTime")).alias("score"),
    )


@query("a3_flatten_match_feed", with_views("matches") + " SELECT match_id AS id, date, home_team, CASE WHEN match_id % 9 <> 0 THEN away_team END AS away_team, home_score, away_score FROM matches", dates=("date",))
def a3(v: Views) -> DataFrame:
    docs = v.matches().groupBy("date").agg(F.to_json(F.struct(F.collect_list(match_json(v)).alias("matches"))).alias("payload"))
    return A.flatten_match_feed(docs)


@query("a4_flatten_live_feed", with_views("matches") + " SELECT strftime(date, '%Y-%m-%d') || '_' || home_team || '_' || CASE WHEN match_id % 9 <> 0 THEN away_team ELSE 'TBD' END AS live_id, CASE WHEN match_id % 50 = 0 THEN 'IN_PLAY' ELSE 'FINISHED' END AS status, CAST(match_id % 4 AS VARCHAR) AS grp, home_score, away_score, home_score // 2 AS ht_home, away_score // 2 AS ht_away, true AS has_live FROM matches")
def a4(v: Views) -> DataFrame:
    return A.flatten_live_feed(v.matches().select(F.to_json(match_json(v)).alias("payload"))).select("live_id", "status", "grp", "home_score", "away_score", "ht_home", "ht_away", "has_live")


@query("a5_flatten_rosters", with_views("players") + """, p AS (SELECT nation AS team, CASE position WHEN 'GK' THEN 'goalkeepers' WHEN 'DEF' THEN 'defenders' WHEN 'MID' THEN 'midfielders' ELSE 'forwards' END AS pos_group, name, player_id FROM players WHERE nation NOT IN ('N3', 'N4'))
SELECT team, pos_group, CAST(row_number() OVER (PARTITION BY team, pos_group ORDER BY player_id) - 1 AS INT) AS ordinal, name, 'C' || (player_id % 7) AS club FROM p""")
def a5(v: Views) -> DataFrame:
    names = {"GK": "goalkeepers", "DEF": "defenders", "MID": "midfielders", "FWD": "forwards"}
    one = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("position") == p, F.struct("player_id", "name")))), lambda s: F.struct(s["name"].alias("name"), F.concat(F.lit("C"), s["player_id"] % 7).alias("club")))
    teams = v.players().groupBy("nation").agg(*(one(p).alias(n) for p, n in names.items())).withColumn("released", ~F.col("nation").isin("N3", "N4"))
    return A.flatten_rosters(teams.select(F.to_json(F.create_map(F.col("nation"), F.struct("released", *names.values()))).alias("payload")))


@query("a6_parse_roster_lines", """SELECT 'd' || (p_partkey // 100) AS doc, 'Team ' || ((p_partkey % 100) // 10) AS team, 'Defender' AS position, unnest([0, 1]) AS ordinal, unnest([p_name, p_brand]) AS name, unnest(['Club ' || p_size, p_type]) AS club FROM part WHERE p_partkey % 10 > 0""")
def a6(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    players = F.concat(F.lit("Defender: "), "p_name", F.lit(" (Club "), "p_size", F.lit("), "), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    lines = v.table("part").select(F.concat(F.lit("d"), F.expr("p_partkey div 100")).alias("doc"), k.alias("line_no"), F.when(k % 10 == 0, F.concat(F.lit("Team "), F.expr("(p_partkey % 100) div 10"))).otherwise(players).alias("line"))
    return A.parse_roster_lines(lines)


@query("a7_write_table", with_views("matches") + " SELECT match_id, home_team, home_score, CAST(year(date) AS INT) AS year FROM matches")
def a7(v: Views) -> DataFrame:
    path = scratch(v, "written")
    A.write_table(v.matches().select("match_id", "date", "home_team", "home_score"), path, by_year_of="date")
    return v.spark.read.parquet(path).select("match_id", "home_team", "home_score", "year")


# --- L: incremental and streaming ----------------------------------------------------------------


@query("l1_high_water_mark", with_views("matches") + " SELECT coalesce(max(date), DATE '2020-01-01') AS mark FROM matches", dates=("mark",))
def l1(v: Views) -> DataFrame:
    return L.high_water_mark(v.matches())


_INC = with_views("matches") + ", alias AS (SELECT team AS alias, nation AS canonical FROM team WHERE id % 10 <> 9), st AS (SELECT date, coalesce(x.canonical, home_team) AS home_team, coalesce(y.canonical, away_team) AS away_team FROM matches LEFT JOIN alias x ON x.alias = home_team LEFT JOIN alias y ON y.alias = away_team WHERE date < DATE '1999-01-01' OR match_id % 3 = 0), inc AS (SELECT match_id, date, coalesce(x.canonical, home_team) AS home_team, coalesce(y.canonical, away_team) AS away_team FROM matches LEFT JOIN alias x ON x.alias = home_team LEFT JOIN alias y ON y.alias = away_team WHERE match_id % 5 <> 0 AND date >= DATE '1998-06-01')"


def stored_and_incoming(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..functions.cleaning import aliases_of, resolve_names

    m, aliases = v.matches(), aliases_of(registry(v))
    stored = resolve_names(m.where("date < '1999-01-01' or match_id % 3 = 0"), aliases, ["home_team", "away_team"])
    return stored, m.withColumn("home_score", F.when(F.col("match_id") % 5 != 0, F.col("home_score"))), aliases


@query("l2_incremental_append", _INC + " SELECT match_id, date, home_team, away_team FROM inc WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.date = inc.date AND st.home_team = inc.home_team AND st.away_team = inc.away_team)", dates=("date",))
def l2(v: Views) -> DataFrame:
    stored, incoming, aliases = stored_and_incoming(v)
    return L.rows_to_append(stored, incoming, aliases, since="1998-06-01").select("match_id", "date", "home_team", "away_team")


FILES = 1000
SLICES = ("1997-06-01", "1999-09-01")


def streamed(v: Views, slices: list[DataFrame], make, mode: str, start=None) -> DataFrame:
    """What a stream has emitted when all its files are read; results are files in the shared folder.

    The slices come one after the other; for each the query is started again from
    its checkpoint and reads what is new in micro-batches of up to FILES files.
    """
    source, out, checkpoint = (scratch(v, x) for x in ("source", "out", "checkpoint"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> None:
        stream = v.spark.readStream.schema(slices[0].schema).option("maxFilesPerTrigger", FILES).parquet(source)
        q = start(stream, checkpoint) if start else make(stream).writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    for part in slices:
        with shared.shuffles_dropped(v.spark):
            part.write.mode("append").parquet(source)
        run()
    return None if start else v.spark.read.parquet(out)




def by_date(rows: DataFrame) -> list[DataFrame]:
    """rows in slices of time, in order."""
    first, second = SLICES
    return [rows.where(F.col("date") < first), rows.where((F.col("date") >= first) & (F.col("date") < second)), rows.where(F.col("date") >= second)]


_APPENDED = with_views("matches") + f""", s0 AS (SELECT * FROM matches WHERE date < DATE '1996-01-01'), inc AS (SELECT *, CASE WHEN match_id % 13 = 0 OR date >= DATE '{SLICES[1]}' THEN 3 WHEN date < DATE '{SLICES[0]}' THEN 1 ELSE 2 END AS part FROM matches),
k0 AS (SELECT max(date) AS mark FROM s0), k1 AS (SELECT greatest(k0.mark, (SELECT coalesce(max(date), k0.mark) FROM inc WHERE part = 1)) AS mark FROM k0), k2 AS (SELECT greatest(k1.mark, (SELECT coalesce(max(date), k1.mark) FROM inc WHERE part = 2)) AS mark FROM k1),
marked AS (SELECT inc.*, CASE part WHEN 1 THEN k0.mark WHEN 2 THEN k1.mark ELSE k2.mark END AS mark FROM inc, k0, k1, k2)"""


@query("l2_append_stream", _APPENDED + " SELECT match_id, 'before' AS side FROM s0 UNION ALL SELECT match_id, CASE WHEN date > mark THEN 'on_time' ELSE 'late' END FROM marked")
def l2s(v: Views) -> DataFrame:
    m = v.matches()
    table, late = scratch(v, "appended"), scratch(v, "late")
    m.where("date < '1996-01-01'").write.parquet(f"{table}/batch=-1")
    last = (F.col("match_id") % 13 == 0) | (F.col("date") >= SLICES[1])
    slices = [m.where(~last & (F.col("date") < SLICES[0])), m.where(~last & (F.col("date") >= SLICES[0])), m.where(last)]
    none = v.spark.createDataFrame([], "alias string, canonical string")
    streamed(v, slices, None, "append", lambda stream, checkpoint: L.append_stream(stream, table, none, checkpoint, late, availableNow=True))
    kept = v.spark.read.parquet(table).select("match_id", F.when(F.col("batch") < 0, "before").otherwise("on_time").alias("side"))
    return kept.unionByName(v.spark.read.parquet(late).select("match_id", F.lit("late").alias("side")))


@query("l3_stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def l3(v: Views) -> DataFrame:
    events = v.table("events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    slices = [events.where(F.pmod(F.xxhash64("ts"), F.lit(3)) == i) for i in range(3)]
    out = streamed(v, slices, lambda s: L.stream_dedup(s, ["user_id", "event_type"], "ts", "3650 days"), "append")
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_L4 = {c: x for c, x in features_sql("h").items() if c not in ("rest_days", "adj_form_w5", "adj_attack_w5", "adj_defense_w5", "goals_for_last5", "goals_against_last5")}
_L4 = {("form_w5" if c == "form_last5" else c): x for c, x in _L4.items()}


@query("l4_stream_team_state", with_views("lng") + ", o AS (SELECT team, list({'d': date, 'points': points, 'gf': gf, 'ga': ga, 'h': is_home} ORDER BY date DESC, match_id DESC) AS h, count(*) AS n_matches, strftime(max(date), '%Y-%m-%d') AS last_date FROM lng GROUP BY team) SELECT team, n_matches, last_date, " + ", ".join(f"CAST(round({x}, 6) + 0.0 AS DOUBLE) AS {c}" for c, x in _L4.items()) + " FROM o")
def l4(v: Views) -> DataFrame:
    out = streamed(v, by_date(L.long_points(v.matches())), L.stream_team_state, "update")
    columns = [c for c in out.columns if c not in ("team", "batch")]
    last = out.groupBy("team").agg(F.max_by(F.struct(*columns), "batch").alias("l")).select("team", "l.*")
    return rounded(last, ("team", "n_matches", "last_date"))


@query("l4_stream_features", table_sql([*_COLUMNS]), dates=("date",))
def l4f(v: Views) -> DataFrame:
    matches, names = with_variants(v, shared.written(elo_matches(v), "matches"))  # read by each slice, and each batch reads the cities
    venues, cities = places(v, matches)
    cities = shared.written(cities, "cities")
    store = FeatureStore(scratch(v, "features"), CONFIG, v.start(), stages=names, penalties=v.penalties(), squads=v.squads(), venues=venues, cities=cities, inactivity_halflife=365.0)
    streamed(v, by_date(matches), None, "append", lambda stream, checkpoint: stream_features(stream, store, checkpoint, availableNow=True))
    return rounded(store.table(v.spark, tiers=TIERS).select("swapped", "target", *_COLUMNS), ("match_id",))


@query("l5_stream_elo", _ELO + " SELECT match_id, round(h0, 6) AS home_elo_pre, round(a0, 6) AS away_elo_pre FROM r WHERE match_id IS NOT NULL")
def l5(v: Views) -> DataFrame:
    steps = R.with_start(R.elo_steps(elo_matches(v), CONFIG), v.start(), CONFIG.start)
    return streamed(v, by_date(steps), L.stream_elo, "append").select("match_id", *r6("home_elo_pre", "away_elo_pre"))


@query("l6_late_rows", with_views("matches") + ", k AS (SELECT max(date) AS mark FROM matches WHERE match_id % 3 = 0 AND date < DATE '1999-01-01') SELECT match_id, CASE WHEN date > mark THEN 'on_time' ELSE 'late' END AS side FROM matches, k")
def l6(v: Views) -> DataFrame:
    m = v.matches()
    on_time, late = L.split_late(m, L.high_water_mark(m.where("match_id % 3 = 0 and date < '1999-01-01'")))
    return on_time.select("match_id", F.lit("on_time").alias("side")).unionByName(late.select("match_id", F.lit("late").alias("side")))


@query("l7_live_table", "SELECT match_id, status, home_score, away_score FROM (SELECT user_id AS match_id, event_type AS status, event_id % 5 AS home_score, event_id % 3 AS away_score, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def l7(v: Views) -> DataFrame:
    e = F.col("event_id")
    updates = v.table("events").select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("event_time"), "event_id", F.col("event_type").alias("status"), (e % 5).alias("home_score"), (e % 3).alias("away_score"))
    return latest(streamed(v, [updates.where(e % 3 == i) for i in range(3)], lambda s: L.stream_live_table(s, "3650 days"), "update"))


def latest(emitted: DataFrame) -> DataFrame:
    """The last row that a stream in update mode has emitted for each match."""
    return emitted.groupBy("match_id").agg(F.max_by(F.struct("status", "home_score", "away_score"), F.struct("event_time", "event_id", "batch")).alias("l")).select("match_id", "l.*")


@query("l7_live_standings", with_views("matches") + """, f AS (SELECT home_confederation AS grp, home_team, away_team, home_score, away_score FROM matches WHERE home_confederation = away_confederation AND match_id % 9 <> 0),
lo AS (SELECT grp, home_team AS team, home_score AS gf, away_score AS ga FROM f UNION ALL SELECT grp, away_team, away_score, home_score FROM f)
SELECT confederation AS grp, t2.team, count(gf) AS played, coalesce(CAST(sum(gf) AS BIGINT), 0) AS gf, coalesce(CAST(sum(ga) AS BIGINT), 0) AS ga, coalesce(CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 WHEN gf < ga THEN 0 END) AS BIGINT), 0) AS pts FROM team t2 LEFT JOIN lo ON lo.team = t2.team GROUP BY 1, 2""")
def l7s(v: Views) -> DataFrame:
    m = v.matches().where("home_confederation = away_confederation")
    k = F.col("match_id")
    at = lambda hour, status, h, a: F.struct(F.concat(F.col("date").cast("string"), F.lit(f"T{hour}:00")).cast("timestamp").alias("event_time"), F.lit(int(hour)).alias("event_id"), status.alias("status"), h.cast("int").alias("home_score"), a.cast("int").alias("away_score"))
    ended = F.when(k % 9 != 0, "FINISHED").otherwise("IN_PLAY")
    updates = m.select(k, F.explode(F.array(at("18", F.lit("IN_PLAY"), F.lit(0), F.lit(0)), at("19", F.lit("IN_PLAY"), F.col("home_score"), F.lit(0)), at("20", ended, F.col("home_score"), F.col("away_score")))).alias("u")).select("match_id", "u.*")
    # late news first: the order of events decides, not that of arrival
    slices = [updates.where(F.pmod(k + F.col("event_id"), F.lit(3)) == i) for i in range(3)]
    live = latest(streamed(v, slices, lambda s: L.stream_live_table(s, "3650 days"), "update"))
    groups = v.team().select(F.col("confederation").alias("grp"), "team", F.col("id").alias("seed_pos"))
    return L.live_standings(live, m.select("match_id", F.col("home_confederation").alias("grp"), "home_team", "away_team"), groups).select("grp", "team", "played", "gf", "ga", "pts")
