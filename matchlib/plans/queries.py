"""A query for each operator, over whole tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as B
from ..operators import sets as C
from ..operators import windows as W
from .testdata import COMPETITIONS, Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    """Registers a function of Views as a query; dates become text on both sides."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: dates_as_text(f(Views(spark, sf_dir)))
        if sql:
            texts = ", ".join(f"strftime({d}, '%Y-%m-%d') AS {d}" for d in dates)
            SQL[name] = f"SELECT * REPLACE ({texts}) FROM ({sql})" if dates else sql
        return f

    return add


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- B: cleaning ---------------------------------------------------------------------------------

KEYS = "match_id, date, home_team, away_team, home_score, away_score"


@query("b1_validate_schema", with_views("matches") + f" SELECT {KEYS} FROM matches", dates=("date",))
def b1(v: Views) -> DataFrame:
    return B.validate_schema(v.matches(), "matches").select(*KEYS.split(", "))


@query("b2_fill_defaults", with_views("matches") + " SELECT match_id, CASE WHEN match_id % 3 = 0 THEN competition ELSE 'Unknown' END AS competition, neutral, CASE WHEN match_id % 4 = 0 THEN 75 ELSE home_fifa_rank END AS home_fifa_rank, 'unknown' AS source FROM matches")
def b2(v: Views) -> DataFrame:
    holes = v.matches().withColumns({"competition": F.when(F.col("match_id") % 3 == 0, F.col("competition")), "home_fifa_rank": F.when(F.col("match_id") % 4 != 0, F.col("home_fifa_rank"))})
    return B.fill_defaults(holes).select("match_id", "competition", "neutral", "home_fifa_rank", "source")


@query("b3_coerce_types", with_views("matches") + " SELECT match_id, CASE WHEN match_id % 5 <> 0 THEN date END AS date, CASE WHEN match_id % 7 <> 0 THEN home_score END AS home_score, away_score, CASE WHEN match_id % 11 <> 0 THEN home_fifa_rank END AS home_fifa_rank, match_id % 4 < 3 AND match_id % 9 <> 0 AS neutral FROM matches", dates=("date",))
def b3(v: Views) -> DataFrame:
    k = F.col("match_id")
    words = F.element_at(F.array(F.lit("TRUE"), F.lit("1"), F.lit(" yes"), F.lit("no")), (k % 4 + 1).cast("int"))
    text = v.matches().select("match_id", F.when(k % 5 == 0, "n/a").otherwise(F.col("date").cast("string")).alias("date"), F.when(k % 7 == 0, "x").otherwise(F.concat("home_score", F.lit(".0"))).alias("home_score"), F.col("away_score").cast("string").alias("away_score"), F.when(k % 11 == 0, "?").otherwise(F.col("home_fifa_rank").cast("string")).alias("home_fifa_rank"), F.when(k % 9 != 0, words).alias("neutral"))
    return B.coerce_types(text)


@query("b4_drop_incomplete", with_views("matches") + f" SELECT {KEYS} FROM matches WHERE match_id % 6 <> 0", dates=("date",))
def b4(v: Views) -> DataFrame:
    return B.drop_incomplete(v.matches().withColumn("home_score", F.when(F.col("match_id") % 6 != 0, F.col("home_score")))).select(*KEYS.split(", "))


def registry(v: Views) -> DataFrame:
    t = v.team()
    return t.where("id % 10 <> 9").select(F.col("nation").alias("name"), F.col("team")).groupBy("name").agg(F.array_sort(F.collect_list("team")).alias("aliases"))


_ALIAS = with_views("matches") + ", alias AS (SELECT team AS alias, nation AS canonical FROM team WHERE id % 10 <> 9 UNION SELECT nation, nation FROM team WHERE id % 10 <> 9)"


@query("b5_resolve_names", _ALIAS + " SELECT match_id, coalesce(x.canonical, home_team) AS home_team, coalesce(y.canonical, away_team) AS away_team FROM matches LEFT JOIN alias x ON x.alias = home_team LEFT JOIN alias y ON y.alias = away_team")
def b5(v: Views) -> DataFrame:
    padded = v.matches().withColumn("home_team", F.concat(F.lit("  "), "home_team"))
    return B.resolve_names(padded, B.aliases_of(registry(v)), ["home_team", "away_team"]).select("match_id", "home_team", "away_team")


@query("b6_resolve_or_null", _ALIAS + " SELECT match_id, x.canonical AS home_team, x.canonical IS NOT NULL AS home_team_known FROM matches LEFT JOIN alias x ON x.alias = home_team")
def b6(v: Views) -> DataFrame:
    return B.resolve_names(v.matches(), B.aliases_of(registry(v)), ["home_team"], unknown_to_null=True, flag=True).select("match_id", "home_team", "home_team_known")


@query("b6_list_aliases", _ALIAS + " SELECT canonical, string_agg(alias, '|' ORDER BY alias) AS aliases, count(*) AS n_aliases FROM alias GROUP BY canonical")
def b6l(v: Views) -> DataFrame:
    return B.list_aliases(B.aliases_of(registry(v)))


@query("b7_lookup_attribute", with_views("matches") + " SELECT match_id, CASE WHEN id % 4 = 0 OR id % 4 = 1 THEN confederation ELSE 'UNKNOWN' END AS confederation, CAST(CASE WHEN id % 4 = 0 THEN rank WHEN id % 4 = 1 THEN rank + 5 ELSE 75 END AS INT) AS rank FROM matches JOIN team ON team = home_team")
def b7(v: Views) -> DataFrame:
    t = v.team()
    both = t.where("id % 4 < 2").withColumn("rank", F.col("rank") + 5)
    return B.lookup_attribute(v.matches().select("match_id", "home_team"), "home_team", t.where("id % 4 = 0"), both).select("match_id", "confederation", "rank")


@query("b8_drop_defunct", with_views("matches") + " SELECT match_id, date, home_team, away_team FROM matches m WHERE NOT EXISTS (SELECT 1 FROM team WHERE id % 9 = 0 AND (team = home_team OR team = away_team) AND date < DATE '1997-01-01' + CAST(id AS INT))", dates=("date",))
def b8(v: Views) -> DataFrame:
    defunct = v.team().where("id % 9 = 0").select(F.col("team").alias("name"), F.expr("date_add(date'1997-01-01', cast(id as int))").alias("cutoff"))
    return B.drop_defunct(v.matches(), defunct).select("match_id", "date", "home_team", "away_team")


@query("b9_map_competition", with_views("matches") + " SELECT match_id, CASE competition WHEN '1-URGENT' THEN 'Cup' WHEN '5-LOW' THEN 'Friendly' ELSE competition END AS competition, CASE competition WHEN '1-URGENT' THEN 'Final' WHEN '5-LOW' THEN 'Group' WHEN '2-HIGH' THEN 'Playoff' ELSE 'Unknown' END AS tournament_stage FROM matches")
def b9(v: Views) -> DataFrame:
    names = v.spark.createDataFrame([("1-URGENT", "Cup"), ("5-LOW", "Friendly")], "raw string, canonical string")
    stages = v.spark.createDataFrame([("1-URGENT", "Final"), ("Cup", "Other"), ("Friendly", "Group"), ("2-HIGH", "Playoff")], "key string, stage string")
    raw = v.matches().select("match_id", F.concat(F.lit(" "), "competition").alias("tournament"))
    return B.map_competition(raw, names, stages).select("match_id", "competition", "tournament_stage")


@query("b10_competition_attrs", with_views("matches", "attrs") + " SELECT match_id, CASE WHEN competition = '3-MEDIUM' THEN 2 ELSE weight END AS competition_weight, CASE WHEN competition = '3-MEDIUM' THEN 1.0 ELSE k END AS k_multiplier FROM matches JOIN attrs ON name = competition")
def b10(v: Views) -> DataFrame:
    m = v.matches().select("match_id", F.concat(F.lower("competition"), F.lit(" ")).alias("competition"))
    return B.competition_attrs(m, v.attrs().where("name <> '3-MEDIUM'")).select("match_id", "competition_weight", "k_multiplier")


#: Raw names as feeds have them, by the view's stage: (raw, stage, importance, weight).
VARIANTS = {
    "Unknown": ("Unknown", "unknown", 0, 0.5), "Group Stage": ("Matchday 2", "group_stage", 1, 1.0), "Round of 16": (" Last 16", "round_of_16", 4, 1.5), "Quarterfinal": ("Quarter-finals", "quarterfinal", 5, 1.75),
    "semifinal": ("SEMI-FINAL", "semifinal", 6, 2.0), "Final": ("Final", "final", 8, 2.5), "third-place": ("third-place", "third_place", 7, 1.5), "qualification": ("Play-off", "playoff", 4, 1.5),
}
STAGE_TABLE = [("matchday 2", "group_stage"), ("last 16", "round_of_16"), ("quarter-finals", "quarterfinal"), ("semi-final", "semifinal"), ("play-off", "playoff")]
VARIANT_SQL = "variants(tournament_stage, stage, stage_importance, stage_weight) AS (VALUES " + ", ".join(f"('{k}', '{s}', {i}, CAST({w} AS DOUBLE))" for k, (_, s, i, w) in VARIANTS.items()) + ")"


def with_variants(v: Views, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """matches with stages as feeds name them, and the table of such names."""
    raw = F.create_map(*(F.lit(x) for k, (r, *_) in VARIANTS.items() for x in (k, r)))
    return matches.withColumn("tournament_stage", raw[F.col("tournament_stage")]), v.spark.createDataFrame(STAGE_TABLE, "raw string, stage string")


@query("b11_normalize_stage", with_views("matches") + f", {VARIANT_SQL} SELECT match_id, CASE WHEN match_id % 10 = 7 THEN 'odd_name' WHEN match_id % 10 = 8 THEN 'unknown' ELSE stage END AS stage, CASE WHEN match_id % 10 = 7 THEN 1 WHEN match_id % 10 = 8 THEN 0 ELSE stage_importance END AS stage_importance, CASE WHEN match_id % 10 = 7 THEN 1.0 WHEN match_id % 10 = 8 THEN 0.5 ELSE stage_weight END AS stage_weight FROM matches JOIN variants USING (tournament_stage)")
def b11(v: Views) -> DataFrame:
    m, names = with_variants(v, v.matches())
    k = F.col("match_id") % 10
    odd = F.when(k == 7, "Odd Name").when(k == 8, F.lit(None)).otherwise(F.col("tournament_stage"))
    return B.stage_attrs(m.withColumn("tournament_stage", odd), names).select("match_id", "stage", "stage_importance", "stage_weight")


@query("b12_dedup_matches", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def b12(v: Views) -> DataFrame:
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return B.dedup_matches(lines, ("l_orderkey", "l_linenumber"), ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("l_extendedprice"))


@query("b13_backfill_stage", with_views("matches") + ", lk AS (SELECT date, home_team, away_team, max('S' || (match_id % 3)) AS s FROM matches WHERE match_id % 2 = 0 GROUP BY 1, 2, 3) SELECT match_id, CASE WHEN tournament_stage = 'Unknown' THEN coalesce(s, tournament_stage) ELSE tournament_stage END AS tournament_stage FROM matches LEFT JOIN lk USING (date, home_team, away_team)")
def b13(v: Views) -> DataFrame:
    m = v.matches()
    lookup = m.where("match_id % 2 = 0").groupBy("date", "home_team", "away_team").agg(F.max(F.concat(F.lit("S"), F.col("match_id") % 3)).alias("tournament_stage"))
    return B.backfill_stage(m, lookup).select("match_id", "tournament_stage")


@query("b14_prepare_results", _ALIAS.replace("WITH ", "WITH ", 1) + """, attrs(name, weight, k) AS (VALUES """ + ", ".join(f"('{n}', {w}, CAST({k} AS DOUBLE))" for n, w, k in COMPETITIONS) + """), p AS (
  SELECT match_id, date, coalesce(x.canonical, home_team) AS home_team, coalesce(y.canonical, away_team) AS away_team, CASE WHEN match_id % 7 = 0 THEN 0 ELSE home_score END AS home_score, weight AS competition_weight
  FROM matches LEFT JOIN alias x ON x.alias = home_team LEFT JOIN alias y ON y.alias = away_team JOIN attrs ON name = competition WHERE year(date) >= 1995)
SELECT match_id, date, home_team, away_team, home_score, competition_weight, 'feed' AS source FROM (SELECT *, row_number() OVER (PARTITION BY date, home_team, away_team ORDER BY match_id) AS rn FROM p) WHERE rn = 1""", dates=("date",))
def b14(v: Views) -> DataFrame:
    raw = v.matches().withColumn("home_score", F.when(F.col("match_id") % 7 == 0, "x").otherwise(F.col("home_score").cast("string")))
    return B.prepare_results(raw, B.aliases_of(registry(v)), v.attrs(), 1995, "feed").select("match_id", "date", "home_team", "away_team", "home_score", "competition_weight", "source")


@query("b15_normalize_player_name", "SELECT doc_id, md5(lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g')))) AS name_md5 FROM documents")
def b15(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.md5(B.normalize_player_name(F.col("text")).cast("binary")).alias("name_md5"))


@query("b16_scale_rank", with_views("team") + " SELECT team, CASE WHEN id % 5 = 0 THEN 1450.0 ELSE round(greatest(1500.0, 1900.0 - (greatest(1, rank) - 1) * 400.0 / 210.0), 6) END AS start_elo FROM team")
def b16(v: Views) -> DataFrame:
    t = v.team().withColumn("rank", F.when(F.col("id") % 5 != 0, F.col("rank")))
    return t.select("team", F.round(B.scale_rank(F.col("rank")), 6).alias("start_elo"))


@query("b17_rank_to_rating", with_views("team") + ", q AS (SELECT team, CASE WHEN id % 5 = 0 THEN 68.0 ELSE round(CAST(greatest(5600, 8500 - 28 * (rank - 1)) AS DOUBLE) / 100, 1) END AS r FROM team) SELECT team, r AS squad_avg_rating, least(99.0, r + 8) AS top_player_rating, r + 1 AS attack_rating, r - 1 AS defense_rating, r AS gk_rating FROM q")
def b17(v: Views) -> DataFrame:
    t = v.team().withColumn("rank", F.when(F.col("id") % 5 != 0, F.col("rank")))
    return B.rank_to_ratings(t, "rank").select("team", *(F.round(c, 4).alias(c) for c in ("squad_avg_rating", "top_player_rating", "attack_rating", "defense_rating", "gk_rating")))


@query("b18_result_label", with_views("matches") + " SELECT match_id, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS label, CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS points FROM matches")
def b18(v: Views) -> DataFrame:
    h, a = F.col("home_score"), F.col("away_score")
    return v.matches().select("match_id", B.result_label(h, a).alias("label"), B.points(h, a).alias("points"))


_FANS = "f AS (SELECT 'fan ' || c_custkey % 97 AS alias, c_nationkey, CASE WHEN min(c_custkey) = max(c_custkey) THEN min(c_custkey) END AS one FROM customer GROUP BY ALL), u AS (SELECT 'fan ' || c_custkey % 97 AS alias, CASE WHEN min(c_custkey) = max(c_custkey) THEN min(c_custkey) END AS one FROM customer GROUP BY ALL)"


@query("b19_resolve_players", f"WITH {_FANS} SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 AND (c_custkey % 5 = 0 OR c_custkey % 2 = 0) THEN c_custkey END AS player_id, CASE WHEN c_custkey % 5 = 0 THEN u.one ELSE f.one END AS shared_alias_id FROM customer c JOIN f ON f.alias = 'fan ' || c_custkey % 97 AND f.c_nationkey = c.c_nationkey JOIN u ON u.alias = f.alias")
def b19(v: Views) -> DataFrame:
    c = v.table("customer")
    home = F.concat(F.lit("N"), "c_nationkey")
    aliases = c.where("c_custkey % 3 <> 0").select(F.col("c_name").alias("alias"), F.col("c_custkey").alias("player_id"), F.lower(home).alias("player_nationality"))
    nation = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).when(F.col("c_custkey") % 2 == 0, home).otherwise("other")
    own = B.resolve_players(c.select("c_custkey", F.upper("c_name").alias("name"), nation.alias("nationality")), aliases).select("c_custkey", "player_id")
    # aliases that many share
    fan = F.concat(F.lit("Fan  "), F.col("c_custkey") % 97)
    many = B.resolve_players(c.select("c_custkey", fan.alias("name"), F.when(F.col("c_custkey") % 5 != 0, home).alias("nationality")), c.select(fan.alias("alias"), F.col("c_custkey").alias("player_id"), home.alias("player_nationality")))
    return own.join(many.select("c_custkey", F.col("player_id").alias("shared_alias_id")), "c_custkey")


@query("b19_list_players", "SELECT CAST(c_custkey AS BIGINT) AS player_id FROM customer WHERE c_nationkey = 7")
def b19l(v: Views) -> DataFrame:
    players = v.table("customer").select(F.col("c_custkey").cast("long").alias("player_id"), F.concat(F.lit("N"), "c_nationkey").alias("nationality"))
    return B.list_players(players, "n7")


@query("b20_profile_matches", with_views("matches") + ", s AS (SELECT count(DISTINCT x) AS n_teams FROM (SELECT home_team AS x FROM matches UNION ALL SELECT away_team FROM matches)) SELECT count(*) AS n, min(date) AS first_date, max(date) AS last_date, round(avg(CAST(home_score > away_score AS INT)), 6) AS share_h, round(avg(CAST(home_score = away_score AS INT)), 6) AS share_d, round(avg(CAST(home_score < away_score AS INT)), 6) AS share_a, count(*) FILTER (home_confederation = 'UNKNOWN') AS n_unknown, count(*) FILTER (tournament_stage IS NULL) AS n_no_stage, (SELECT n_teams FROM s) AS n_teams FROM matches", dates=("first_date", "last_date"))
def b20(v: Views) -> DataFrame:
    return B.profile_matches(v.matches())


_HOLES = with_views("matches") + ", h AS (SELECT * REPLACE (CASE WHEN match_id % 7 = 0 THEN 'UNKNOWN' ELSE home_confederation END AS home_confederation, CASE WHEN match_id % 500 = 3 THEN NULL ELSE away_confederation END AS away_confederation) FROM matches)"


def holes(v: Views) -> DataFrame:
    k = F.col("match_id")
    return v.matches().withColumns({"home_confederation": F.when(k % 7 == 0, "UNKNOWN").otherwise(F.col("home_confederation")), "away_confederation": F.when(k % 500 != 3, F.col("away_confederation"))})


@query("b20_confederation_counts", _HOLES + " SELECT home_confederation AS confederation, count(*) AS n FROM h GROUP BY 1")
def b20c(v: Views) -> DataFrame:
    return B.confederation_counts(holes(v))


@query("b20_unknown_teams", _HOLES + " SELECT home_team AS team FROM h WHERE home_confederation = 'UNKNOWN' UNION SELECT away_team FROM h WHERE away_confederation IS NULL")
def b20u(v: Views) -> DataFrame:
    return B.unknown_teams(holes(v))


# --- C: sets -------------------------------------------------------------------------------------


@query("c1_team_table", with_views("matches") + """, x AS (SELECT 0 AS side, date, match_id, home_team AS team, home_confederation AS confederation, home_fifa_rank AS rank FROM matches UNION ALL SELECT 1, date, match_id, away_team, away_confederation, away_fifa_rank FROM matches)
SELECT team, confederation, rank FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY side DESC, date DESC, match_id DESC) AS rn FROM x) WHERE rn = 1""")
def c1(v: Views) -> DataFrame:
    return C.team_table(v.matches())


@query("c2_coverage_sets", with_views("matches") + " SELECT team, CASE WHEN EXISTS (SELECT 1 FROM matches WHERE home_team = team AND competition = '1-URGENT' AND tournament_stage = 'Final' AND home_score = 4) THEN 'present' ELSE 'missing' END AS status FROM team")
def c2(v: Views) -> DataFrame:
    return C.coverage_sets(v.team(), v.matches().where("competition = '1-URGENT' and tournament_stage = 'Final' and home_score = 4").select(F.col("home_team").alias("team")))


@query("c3_new_rows_only", with_views("matches") + " SELECT match_id, date, home_team, away_team FROM matches a WHERE NOT EXISTS (SELECT 1 FROM matches b WHERE b.match_id % 3 = 0 AND a.date = b.date AND a.home_team = b.home_team AND a.away_team = b.away_team)", dates=("date",))
def c3(v: Views) -> DataFrame:
    m = v.matches()
    return C.new_rows_only(m, m.where("match_id % 3 = 0")).select("match_id", "date", "home_team", "away_team")


@query("c4_upsert_rankings", with_views("team") + " SELECT team, CAST(CASE WHEN id % 3 = 0 THEN rank + id % 2 ELSE rank END AS BIGINT) AS rank, id % 7 = 0 AND id % 3 = 0 OR id % 3 = 0 AND id % 2 = 1 AS changed FROM team WHERE id % 7 <> 0 OR id % 3 = 0")
def c4(v: Views) -> DataFrame:
    t = v.team()
    return C.upsert_rankings(t.where("id % 7 <> 0").select("team", F.col("rank").cast("long").alias("rank")), t.where("id % 3 = 0").select("team", (F.col("rank") + F.col("id") % 2).alias("rank")))


@query("c5_find_duplicate_ids", "SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_names, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def c5(v: Views) -> DataFrame:
    return C.find_duplicate_ids(v.table("lineitem"), "l_orderkey", "l_suppkey")


@query("c5_dedup_in_position", "SELECT l_returnflag AS team, l_linestatus AS position, l_suppkey AS name, l_partkey AS player_id, min(l_orderkey * 10 + l_linenumber) AS ordinal FROM lineitem GROUP BY 1, 2, 3, 4")
def c5d(v: Views) -> DataFrame:
    players = v.table("lineitem").select(F.col("l_returnflag").alias("team"), F.col("l_linestatus").alias("position"), F.col("l_suppkey").alias("name"), F.col("l_partkey").alias("player_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return C.dedup_in_position(players)


# --- E: windows ----------------------------------------------------------------------------------

_W = {n: f"w{n} AS (PARTITION BY team ORDER BY date, match_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (3, 5, 10, 30)}


def per_team(name: str, columns: Callable[[], dict], expressions: dict[str, str], exact: tuple[str, ...] = ()) -> None:
    """A query of window columns over the long table, rounded unless exact."""
    sql = with_views("lng") + " SELECT match_id, team, " + ", ".join(f"{e} AS {c}" if c in exact else f"round({e}, 6) AS {c}" for c, e in expressions.items()) + " FROM lng WINDOW " + ", ".join(_W.values()) + ", ws AS (PARTITION BY team ORDER BY date, match_id)"

    @query(name, sql)
    def _(v: Views) -> DataFrame:
        made = columns()
        return W.with_past(W.long_table(v.matches())).select("match_id", "team", *(made[c].alias(c) if c in exact else F.round(made[c], 6).alias(c) for c in expressions))


_avg = lambda x, n, d: f"coalesce(avg({x}) OVER w{n}, {d})"
per_team("e1_form", W.form, {f"form_w{n}": _avg("points", n, 1.5) for n in (3, 5, 10)})
per_team("e2_goals_last5", W.goals, {"goals_for_last5": _avg("gf", 5, 1.0), "goals_against_last5": _avg("ga", 5, 1.0)})
per_team("e3_attack_defense", W.attack_defense, {"attack_w5": _avg("gf", 5, 1.0), "defense_w5": _avg("ga", 5, 1.0)})
_past = "list({'d': date, 'points': points, 'gf': gf, 'ga': ga, 'h': is_home}) OVER w5"

SQL_E4 = with_views("lng") + f", q AS (SELECT match_id, team, {_past} AS h FROM lng WINDOW {_W[5]}), k AS (SELECT *, list_transform(h, lambda s: pow(0.5, date_diff('day', s.d, h[-1].d) / 180.0)) AS w FROM q) SELECT match_id, team, " + ", ".join(
    f"round(CASE WHEN h IS NULL OR len(h) = 0 THEN {d} ELSE list_dot_product(w, list_transform(h, lambda s: CAST(s.{f} AS DOUBLE))) / list_sum(w) END, 6) AS {c}" for c, f, d in (("form_rw5", "points", 1.5), ("attack_rw5", "gf", 1.0), ("defense_rw5", "ga", 1.0))
) + " FROM k"


@query("e4_recency", SQL_E4)
def e4(v: Views) -> DataFrame:
    made = W.recency()
    return W.with_past(W.long_table(v.matches())).select("match_id", "team", *(F.round(x, 6).alias(c) for c, x in made.items()))


per_team("e5_clean_sheets", W.clean_sheets, {"clean_sheet_rate_w5": _avg("CAST(ga = 0 AS INT)", 5, 0.0)})
per_team("e6_goal_difference", W.goal_difference, {"gd_form_w5": _avg("greatest(-4, least(4, gf - ga))", 5, 0.0)})
SQL_E7 = with_views("lng") + f", q AS (SELECT match_id, team, list({{'h': is_home, 'points': points}}) OVER w30 AS h FROM lng WINDOW {_W[30]}), k AS (SELECT match_id, team, list_filter(coalesce(h, []), lambda s: s.h = true)[-5:] AS x, list_filter(coalesce(h, []), lambda s: s.h = false)[-5:] AS y FROM q) SELECT match_id, team, round(coalesce(list_avg(list_transform(x, lambda s: s.points)), 1.5), 6) AS home_form_w5, round(coalesce(list_avg(list_transform(y, lambda s: s.points)), 1.5), 6) AS away_form_w5 FROM k"


@query("e7_form_by_venue", SQL_E7)
def e7(v: Views) -> DataFrame:
    return W.with_past(W.long_table(v.matches())).select("match_id", "team", *(F.round(x, 6).alias(c) for c, x in W.form_by_venue().items()))


per_team("e9_draw_rate", W.draw_rate, {"draw_rate_w5": _avg("CAST(gf = ga AS INT)", 5, 0.25)})
_streak = lambda broken: f"least(10, rn - 1 - coalesce(max(CASE WHEN {broken} THEN rn END) OVER (PARTITION BY team ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))"


@query("e10_streaks", with_views("lng") + ", o AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY date, match_id) AS rn FROM lng) SELECT match_id, team, " + f"{_streak('points <> 3')} AS win_streak, {_streak('points = 0')} AS unbeaten_streak, {_streak('points <> 0')} AS loss_streak FROM o")
def e10(v: Views) -> DataFrame:
    return W.with_past(W.long_table(v.matches())).select("match_id", "team", *(x.cast("long").alias(c) for c, x in W.streaks().items()))


_rest = "greatest(0, coalesce(date_diff('day', lag(date) OVER ws, date), 7))"
per_team("e11_rest_days", W.rest_days, {"rest_days": _rest, "rest_days_log": f"ln(1 + {_rest})", "long_break": f"CAST({_rest} > 21 AS INT)"}, exact=("rest_days", "long_break"))


@query("e12_head_to_head", with_views("matches") + """, p AS (SELECT match_id, date, least(home_team, away_team) AS a, greatest(home_team, away_team) AS b, home_team < away_team AS f, CASE WHEN home_team < away_team THEN home_score - away_score ELSE away_score - home_score END AS gd FROM matches)
SELECT match_id, round(coalesce(CASE WHEN f THEN avg(CAST(gd > 0 AS INT)) OVER w ELSE avg(CAST(gd < 0 AS INT)) OVER w END, 0.45), 6) AS home_h2h_win_rate, round(coalesce(CASE WHEN f THEN avg(CAST(gd < 0 AS INT)) OVER w ELSE avg(CAST(gd > 0 AS INT)) OVER w END, 0.45), 6) AS away_h2h_win_rate, round(coalesce(avg(CAST(gd = 0 AS INT)) OVER w, 0.25), 6) AS h2h_draw_rate,
  round(coalesce(CASE WHEN f THEN avg(gd) OVER w ELSE -avg(gd) OVER w END, 0.0), 6) AS home_h2h_goal_diff, round(coalesce(CASE WHEN f THEN -avg(gd) OVER w ELSE avg(gd) OVER w END, 0.0), 6) AS away_h2h_goal_diff, count(*) OVER w AS h2h_n_matches FROM p WINDOW w AS (PARTITION BY a, b ORDER BY date, match_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def e12(v: Views) -> DataFrame:
    return W.head_to_head(v.matches()).select("match_id", *r6("home_h2h_win_rate", "away_h2h_win_rate", "h2h_draw_rate", "home_h2h_goal_diff", "away_h2h_goal_diff"), "h2h_n_matches")


@query("e15_time_decay_weight", with_views("matches") + " SELECT match_id, round(pow(2.0, -date_diff('day', date, (SELECT max(date) FROM matches)) / 730.0), 6) AS match_weight FROM matches")
def e15(v: Views) -> DataFrame:
    return W.time_decay_weight(v.matches(), 730.0).select("match_id", "match_weight")


@query("e16_augment_neutral", with_views("matches") + """ SELECT match_id, home_team, away_team, home_score, away_score, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS target, 1.0 AS stage_weight, false AS swapped FROM matches
UNION ALL SELECT match_id, away_team, home_team, away_score, home_score, CASE WHEN home_score > away_score THEN 'A' WHEN home_score < away_score THEN 'H' ELSE 'D' END, 0.5, true FROM matches WHERE neutral""")
def e16(v: Views) -> DataFrame:
    m = v.matches().withColumns({"target": B.result_label(F.col("home_score"), F.col("away_score")), "stage_weight": F.lit(1.0)})
    return W.augment_neutral(m).select("match_id", "home_team", "away_team", "home_score", "away_score", "target", "stage_weight", "swapped")


@query("e19_feature_blocks", with_views("lng") + """, h AS (SELECT match_id, coalesce(avg(points) OVER w5, 1.5) AS f, side FROM lng WINDOW """ + _W[5] + """)
SELECT m.match_id, round(x.f, 6) AS home_form_w5, round(y.f, 6) AS away_form_w5, round(x.f - y.f, 6) AS form_diff FROM matches m JOIN h x ON x.match_id = m.match_id AND x.side = 'home' JOIN h y ON y.match_id = m.match_id AND y.side = 'away'""")
def e19(v: Views) -> DataFrame:
    def form(m: DataFrame) -> DataFrame:
        long = W.with_past(W.long_table(m)).withColumns(W.form((5,)))
        return W.fold_back(m.select("match_id"), long, ["form_w5"])

    blocks = [("form", form), ("broken", lambda m: m.select("no_such_column")), ("diff", lambda m: form(m).select("match_id", (F.col("home_form_w5") - F.col("away_form_w5")).alias("form_diff")))]
    return W.feature_blocks(v.matches(), blocks).select("match_id", *r6("home_form_w5", "away_form_w5", "form_diff"))
