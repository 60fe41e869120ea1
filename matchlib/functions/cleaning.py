"""Projections, filters and scalar functions that clean a match table."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns that each kind of table must have, and what absent values become.
REQUIRED = {
    "matches": ["date", "home_team", "away_team", "home_score", "away_score"],
    "teams": ["team"],
    "players": ["player_id", "name", "nationality", "position"],
    "rosters": ["team", "player_id", "joined_date", "left_date"],
    "injuries": ["player_id", "from_date", "to_date"],
    "player_ratings": ["player_id", "rating_date", "overall_rating"],
    "lineups": ["match_id", "team", "player_id", "is_starter"],
}
DEFAULTS = {"competition": "Unknown", "neutral": False, "home_confederation": "UNKNOWN", "away_confederation": "UNKNOWN", "home_fifa_rank": 75, "away_fifa_rank": 75, "tournament_stage": "Unknown", "source": "unknown"}
TEAM_DEFAULTS = {"confederation": "UNKNOWN", "fifa_rank": 75}


def validate_schema(df: DataFrame, kind: str) -> DataFrame:
    """df, if it has the columns that its kind of table requires; else an error that lists all it lacks."""
    missing = [c for c in REQUIRED[kind] if c not in df.columns]
    if missing:
        raise ValueError(f"{kind}: missing columns {', '.join(missing)}")
    return df


def fill_defaults(df: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    """Absent columns added, and nulls filled, with a default for each column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def coerce_types(df: DataFrame) -> DataFrame:
    """Dates, scores and ranks from text, null if they can't be read; neutral is true for true, 1 and yes, false for all else."""
    neutral = F.coalesce(F.lower(F.trim(F.col("neutral").cast("string"))).isin("true", "1", "yes"), F.lit(False))
    out = {"date": F.col("date").cast("string").try_cast("date"), "neutral": neutral}
    out |= {c: F.col(c).cast("string").try_cast("double").cast("int") for c in ("home_score", "away_score", "home_fifa_rank", "away_fifa_rank")}
    return df.withColumns({c: v for c, v in out.items() if c in df.columns})


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Rows with a date, both teams and both scores."""
    return df.dropna(subset=REQUIRED["matches"])


def aliases_of(registry: DataFrame) -> DataFrame:
    """(alias, canonical) of registry(name, aliases); a name is its own alias, and of several names for an alias the first is kept."""
    long = registry.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), F.col("name").alias("canonical"))
    return long.groupBy(F.trim("alias").alias("alias")).agg(F.min("canonical").alias("canonical"))


def resolve_names(df: DataFrame, aliases: DataFrame, columns: list[str], unknown_to_null: bool = False, flag: bool = False) -> DataFrame:
    """Columns with aliases replaced by canonical names. An unknown name passes through trimmed, or is null; flag adds <column>_known."""
    for c in columns:
        a = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
        df = df.join(a, F.trim(c) == F.col("_alias"), "left")
        if flag:
            df = df.withColumn(f"{c}_known", F.col("_canonical").isNotNull())
        df = df.withColumn(c, F.col("_canonical") if unknown_to_null else F.coalesce("_canonical", F.trim(c))).drop("_alias", "_canonical")
    return df


def list_aliases(aliases: DataFrame) -> DataFrame:
    """canonical and its aliases, sorted and joined by |."""
    return aliases.groupBy("canonical").agg(F.array_join(F.array_sort(F.collect_list("alias")), "|").alias("aliases"), F.count("*").alias("n_aliases"))


def lookup_attribute(df: DataFrame, team: str, first: DataFrame, second: DataFrame) -> DataFrame:
    """confederation and rank of a team: from first(team, confederation, rank), then second, then UNKNOWN and 75."""
    a = first.select(F.col("team").alias("_a"), F.col("confederation").alias("_ac"), F.col("rank").alias("_ar"))
    b = second.select(F.col("team").alias("_b"), F.col("confederation").alias("_bc"), F.col("rank").alias("_br"))
    joined = df.join(a, F.col(team) == F.col("_a"), "left").join(b, F.col(team) == F.col("_b"), "left")
    return joined.withColumns({"confederation": F.coalesce("_ac", "_bc", F.lit("UNKNOWN")), "rank": F.coalesce("_ar", "_br", F.lit(75))}).drop("_a", "_ac", "_ar", "_b", "_bc", "_br")


def drop_defunct(df: DataFrame, defunct: DataFrame) -> DataFrame:
    """Rows without a raw name of defunct(name, cutoff) before its cutoff. Comes before resolve_names."""
    for side in ("home_team", "away_team"):
        df = df.join(defunct, (F.col(side) == F.col("name")) & (F.col("date") < F.col("cutoff")), "left_anti")
    return df


def map_competition(df: DataFrame, names: DataFrame, stages: DataFrame) -> DataFrame:
    """competition by names(raw, canonical), else the raw one; tournament_stage by stages(key, stage) of the raw name, then of the canonical, else Unknown."""
    n = names.select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical"))
    df = df.withColumn("_tournament", F.trim("tournament")).join(n, F.col("_tournament") == F.col("_raw"), "left").withColumn("competition", F.coalesce("_canonical", "_tournament"))
    for i, key in enumerate(("_tournament", "competition")):
        df = df.join(stages.select(F.col("key").alias(f"_k{i}"), F.col("stage").alias(f"_s{i}")), F.col(key) == F.col(f"_k{i}"), "left")
    return df.withColumn("tournament_stage", F.coalesce("_s0", "_s1", F.lit("Unknown"))).drop("_tournament", "_raw", "_canonical", "_k0", "_s0", "_k1", "_s1")


def competition_attrs(df: DataFrame, attrs: DataFrame) -> DataFrame:
    """competition_weight (2 if unknown) and k_multiplier (1.0) by attrs(name, weight, k), whatever the case. attrs has a row for each competition, so it goes to the matches, not they by a few names to a few tasks."""
    a = attrs.select(F.lower(F.trim("name")).alias("_name"), F.col("weight").alias("_w"), F.col("k").alias("_k"))
    joined = df.join(F.broadcast(a), F.lower(F.trim("competition")) == F.col("_name"), "left")
    return joined.withColumns({"competition_weight": F.coalesce("_w", F.lit(2)), "k_multiplier": F.coalesce("_k", F.lit(1.0))}).drop("_name", "_w", "_k")


# Stage -> importance, sample weight.
STAGES = {"unknown": (0, 0.5), "qualification": (0, 0.5), "group_stage": (1, 1.0), "round_of_64": (2, 1.25), "round_of_32": (3, 1.25), "round_of_16": (4, 1.5), "playoff": (4, 1.5), "quarterfinal": (5, 1.75), "semifinal": (6, 2.0), "third_place": (7, 1.5), "final": (8, 2.5), "other": (1, 1.0)}


def normalize_stage(stage: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(stage)), "[ -]", "_")


def stage_attrs(df: DataFrame, names: DataFrame | None = None, column: str = "tournament_stage") -> DataFrame:
    """stage, stage_importance (1 if unmapped) and stage_weight (1.0). A stage is named by names(raw, stage) of the lower-case trimmed text, else by the text itself with _ for spaces and hyphens; null is unknown."""
    raw = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit("unknown"))))
    if names is not None:
        mapped = names.select(F.lower(F.trim("raw")).alias("_raw"), F.col("stage").alias("_stage"))
        df = df.join(F.broadcast(mapped), raw == F.col("_raw"), "left")  # a row for each name of a stage
    stage = F.coalesce("_stage", normalize_stage(raw)) if names is not None else normalize_stage(raw)
    df = df.withColumn("stage", stage).drop("_raw", "_stage")
    importance, weight = (F.create_map(*(F.lit(x) for s, v in STAGES.items() for x in (s, v[i])))[F.col("stage")] for i in (0, 1))
    return df.withColumns({"stage_importance": F.coalesce(importance, F.lit(1)), "stage_weight": F.coalesce(weight, F.lit(1.0))})


def dedup_matches(df: DataFrame, key: tuple = ("date", "home_team", "away_team"), order: tuple = ("match_id",)) -> DataFrame:
    """The first row of each key; a minimum over structs, so that tasks reduce their rows before the shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    first = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r")
    return df.groupBy(*key).agg(first).select(*(F.col(c) if c in key else F.col(f"_r.{c}") for c in df.columns))


def backfill_stage(df: DataFrame, lookup: DataFrame) -> DataFrame:
    """tournament_stage from lookup(date, home_team, away_team, tournament_stage) where it is null, empty or unknown."""
    found = lookup.withColumnRenamed("tournament_stage", "_stage")
    unknown = F.col("tournament_stage").isNull() | F.lower("tournament_stage").isin("unknown", "")
    return df.join(found, ["date", "home_team", "away_team"], "left").withColumn("tournament_stage", F.when(unknown, F.coalesce("_stage", "tournament_stage")).otherwise(F.col("tournament_stage"))).drop("_stage")


def prepare_results(raw: DataFrame, aliases: DataFrame, attrs: DataFrame, from_year: int, source: str) -> DataFrame:
    """From raw results to a match table: scores (0 if not a number), years from from_year, canonical names, competition attributes, first of each key."""
    scored = raw.withColumns({c: F.coalesce(F.col(c).cast("string").try_cast("double").cast("int"), F.lit(0)) for c in ("home_score", "away_score")})
    named = resolve_names(scored.where(F.year("date") >= from_year), aliases, ["home_team", "away_team"])
    return dedup_matches(competition_attrs(named, attrs).withColumn("source", F.lit(source)))


def _plain_letters() -> tuple[str, str]:
    """Letters with marks, and what is left of each without them, by their canonical decompositions."""
    base = lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    marked = [c for c in map(chr, range(0xA0, 0x2100)) if c.isalpha() and len(base(c)) == 1 and base(c) != c]
    marked += [c for c in map(chr, range(0x2100, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and c.isalpha() and len(base(c)) == 1 and base(c) != c and not 0xAC00 <= ord(c) < 0xD7B0]
    return "".join(marked), "".join(map(base, marked))


def normalize_player_name(name: Column) -> Column:
    """In lower case, single-spaced, without accents: letters with marks of every script lose them, combining marks are dropped. Ligatures of several letters stay."""
    marked, plain = _plain_letters()
    letters = F.translate(F.regexp_replace(name, r"\p{M}+", ""), marked, plain)
    return F.lower(F.trim(F.regexp_replace(letters, r"\s+", " ")))


def scale_rank(rank: Column) -> Column:
    """Starting rating of a rank; 1450 without one."""
    return F.when(rank.isNull(), F.lit(1450.0)).otherwise(F.greatest(F.lit(1500.0), 1900.0 - (F.greatest(F.lit(1), rank) - 1) * 400.0 / 210.0))


def rank_to_ratings(df: DataFrame, rank: str) -> DataFrame:
    """Squad ratings derived from a rank (68 without one)."""
    avg = F.when(F.col(rank).isNull(), F.lit(68.0)).otherwise(F.round(F.greatest(F.lit(56.0), 85.0 - 0.28 * (F.col(rank) - 1)), 1))
    return df.withColumn("squad_avg_rating", avg).withColumns({"top_player_rating": F.least(F.lit(99.0), F.col("squad_avg_rating") + 8), "attack_rating": F.col("squad_avg_rating") + 1, "defense_rating": F.col("squad_avg_rating") - 1, "gk_rating": F.col("squad_avg_rating")})


def result_label(home: Column, away: Column) -> Column:
    """H, D or A."""
    return F.when(home > away, "H").when(home < away, "A").otherwise("D")


def points(goals_for: Column, goals_against: Column) -> Column:
    return F.when(goals_for > goals_against, 3).when(goals_for == goals_against, 1).otherwise(0)


def player_key(name: Column) -> Column:
    """What two spellings of a player's name share: case and spacing don't count, accents do."""
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def resolve_players(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """player_id of df(name, nationality) by aliases(alias, player_id, player_nationality), one row for each of df. A nationality (in any case) chooses among the players of an alias; without one (null or empty) the alias must have one player. Null if no player or several are left."""
    known = aliases.select(player_key(F.col("alias")).alias("_key"), F.lower("player_nationality").alias("_nation"), F.col("player_id").alias("_id")).where("_key is not null and _id is not null")
    only = lambda name: F.when(F.min("_id") == F.max("_id"), F.min("_id")).alias(name)
    asked = df.withColumns({"_key": player_key(F.col("name")), "_nation": F.lower("nationality")})
    found = asked.join(known.groupBy("_key").agg(only("_any")), "_key", "left").join(known.where("_nation is not null").groupBy("_key", "_nation").agg(only("_one")), ["_key", "_nation"], "left")
    return found.withColumn("player_id", F.when(F.coalesce("_nation", F.lit("")) == "", F.col("_any")).otherwise(F.col("_one"))).drop("_key", "_nation", "_any", "_one")


def list_players(players: DataFrame, nationality: str) -> DataFrame:
    """The player_id of each of players(player_id, nationality) with the nationality, in any case."""
    return players.where(F.lower("nationality") == nationality.lower()).select("player_id")


def profile_matches(df: DataFrame) -> DataFrame:
    """One row: counts, dates, distinct teams, outcome shares, unknown confederations and missing stages."""
    label = result_label(F.col("home_score"), F.col("away_score"))
    teams = df.select(F.explode(F.array("home_team", "away_team")).alias("t")).agg(F.countDistinct("t").alias("n_teams"))
    share = lambda x: F.round(F.avg((label == x).cast("int")), 6)
    one = df.agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), share("H").alias("share_h"), share("D").alias("share_d"), share("A").alias("share_a"),
        F.count_if(F.col("home_confederation") == "UNKNOWN").alias("n_unknown"), F.count_if(F.col("tournament_stage").isNull()).alias("n_no_stage"),
    )
    return one.crossJoin(F.broadcast(teams))  # one row each


def confederation_counts(df: DataFrame) -> DataFrame:
    """confederation and n: how many home sides each has."""
    return df.groupBy(F.col("home_confederation").alias("confederation")).agg(F.count("*").alias("n"))


def unknown_teams(df: DataFrame) -> DataFrame:
    """The teams that appear with an unknown confederation."""
    sides = F.explode(F.array(*(F.struct(F.col(f"{s}_team").alias("team"), F.col(f"{s}_confederation").alias("c")) for s in ("home", "away")))).alias("s")
    return df.select(sides).where(F.coalesce("s.c", F.lit("UNKNOWN")) == "UNKNOWN").select("s.team").distinct()
