"""As-of, interval, attribute and fuzzy joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def asof(queries: DataFrame, facts: DataFrame, key: str, day: str, fact_day: str, value: str, out: str) -> DataFrame:
    """queries with the last non-null value of facts for the key strictly before the day, as out.

    Queries and facts are sorted together once per key; a query comes before the
    facts of its own day, so it doesn't see them.
    """
    q = queries.select(F.struct("*").alias("_q"), F.col(key).alias("_key"), F.col(day).alias("_day"), F.lit(0).alias("_fact"), F.lit(None).cast(facts.schema[value].dataType).alias("_v"))
    f = facts.select(F.lit(None).cast(q.schema["_q"].dataType).alias("_q"), F.col(key).alias("_key"), F.col(fact_day).alias("_day"), F.lit(1).alias("_fact"), F.col(value).alias("_v"))
    seen = Window.partitionBy("_key").orderBy("_day", "_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return q.union(f).withColumn(out, F.last("_v", ignorenulls=True).over(seen)).where("_fact = 0").select("_q.*", out)


def asof_rank(fixtures: DataFrame, ranks: DataFrame, static: DataFrame) -> DataFrame:
    """fixtures(team, date, ...) with rank: the last of ranks(team, date, rank) strictly before the date, else the team's earliest, else static(team, static_rank), else 75."""
    ranks = ranks.withColumnRenamed("date", "_fact_day").withColumnRenamed("rank", "_rank")
    found = asof(fixtures, ranks, "team", "date", "_fact_day", "_rank", "_asof")
    earliest = ranks.groupBy("team").agg(F.min_by("_rank", "_fact_day").alias("_first"))
    joined = found.join(earliest, "team", "left").join(static, "team", "left")
    return joined.withColumn("rank", F.coalesce("_asof", "_first", "static_rank", F.lit(75))).drop("_asof", "_first", "static_rank")


def asof_player_rating(fixtures: DataFrame, ratings: DataFrame) -> DataFrame:
    """fixtures(player_id, date, ...) with overall_rating, the last non-null one strictly before the date."""
    return asof(fixtures, ratings, "player_id", "date", "rating_date", "overall_rating", "overall_rating")


#: Days are counted from long before any date, and buckets of a level hold RADIX of the level below.
_FIRST_DAY, RADIX, LEVELS = 1 << 23, 8, 9


def day_number(day: Column) -> Column:
    return F.unix_date(day) + F.lit(_FIRST_DAY)


def buckets_of(start: Column, stop: Column) -> Column:
    """The buckets that make up the days from start to before stop, as an array of (level, bucket): at each level those within the interval that no bucket of the level above within it holds, at most twice RADIX. Every day of the interval lies in exactly one."""

    def at(level: int) -> Column:
        size = RADIX**level
        first, last = F.ceil(start / size), F.floor(stop / size)
        above = [F.ceil(start / (size * RADIX)) * RADIX, F.floor(stop / (size * RADIX)) * RADIX]
        whole = (above[0] >= above[1]) if level + 1 < LEVELS else F.lit(True)
        row = lambda x, y: F.when(x < y, F.sequence(x, y - 1)).otherwise(F.array().cast("array<bigint>"))
        numbers = F.when(whole, row(first, last)).otherwise(F.concat(row(first, above[0]), row(above[1], last)))
        return F.transform(numbers, lambda n: F.struct(F.lit(level).alias("level"), n.alias("bucket")))

    return F.concat(*map(at, range(LEVELS)))


def buckets_at(day: Column) -> Column:
    """The bucket of each level that holds the day."""
    return F.array(*(F.struct(F.lit(level).alias("level"), F.floor(day / RADIX**level).alias("bucket")) for level in range(LEVELS)))


def within(points: DataFrame, intervals: DataFrame, key: str, day: str, start: Column, stop: Column) -> DataFrame:
    """points joined with the intervals(key, ...) of their key whose days, from start (null: always) to before stop (null: for ever), hold the point's day.

    An interval is cut into nested buckets of days, of which a point looks up one
    at each level: pairs meet on equal buckets, and only those that overlap, once
    each. So a key with a long history costs what it returns, and is dealt out by its
    buckets. A point without a day lies only in what is open at both ends.
    """
    begin, end = F.coalesce(day_number(start), F.lit(0)).cast("long"), F.coalesce(day_number(stop), F.lit(RADIX ** (LEVELS - 1))).cast("long")
    cut = intervals.withColumn("_bucket", F.explode(buckets_of(begin, end)))
    alone = F.array(F.struct(F.lit(LEVELS - 1).alias("level"), F.lit(0).cast("long").alias("bucket")))
    asked = points.withColumn("_bucket", F.explode(F.when(F.col(day).isNull(), alone).otherwise(buckets_at(day_number(F.col(day)).cast("long")))))
    return asked.join(cut, [key, "_bucket"]).drop("_bucket")


def active_roster(fixtures: DataFrame, rosters: DataFrame) -> DataFrame:
    """fixtures(team, date, ...) with each player of rosters(team, player_id, joined_date, left_date) who has joined by the date and leaves after it; team in any case."""
    r = rosters.select(F.lower("team").alias("_team"), "player_id", "joined_date", "left_date")
    return within(fixtures.withColumn("_team", F.lower("team")), r, "_team", "date", F.col("joined_date"), F.col("left_date")).drop("_team", "joined_date", "left_date")


def active_injuries(fixtures: DataFrame, injuries: DataFrame, key: str = "player_id") -> DataFrame:
    """fixtures(player_id, date, ...) that fall within one of injuries(player_id, from_date, to_date), both days included; an open end lasts."""
    i = injuries.select(F.col(key).alias("_key"), "from_date", "to_date")
    active = (F.col("from_date") <= F.col("date")) & (F.col("to_date").isNull() | (F.col("to_date") >= F.col("date")))
    return fixtures.join(i, (F.col(key) == F.col("_key")) & active, "left_semi")


def rated_and_healthy(fixtures: DataFrame, ratings: DataFrame, injuries: DataFrame) -> DataFrame:
    """fixtures(player_id, date, ...) with overall_rating as in asof_player_rating and healthy (whether no injury is active). All three are sorted together once per player: an injury is active if the latest end of those begun by the day isn't before it."""
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    q = fixtures.select(F.struct("*").alias("_q"), F.col("player_id").alias("_key"), F.col("date").alias("_day"), F.lit(1).alias("_kind"), none(ratings, "overall_rating").alias("_v"), F.lit(None).cast("date").alias("_until"))
    empty = F.lit(None).cast(q.schema["_q"].dataType)
    r = ratings.where("rating_date is not null").select(empty, "player_id", "rating_date", F.lit(2), "overall_rating", F.lit(None).cast("date"))
    i = injuries.where("from_date is not null").select(empty, "player_id", "from_date", F.lit(0), none(ratings, "overall_rating"), F.coalesce("to_date", F.expr("date'9999-12-31'")))
    seen = Window.partitionBy("_key").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = q.union(r).union(i).withColumns({"overall_rating": F.last("_v", ignorenulls=True).over(seen), "healthy": F.coalesce(F.max("_until").over(seen) < F.col("_day"), F.lit(True))})
    return found.where("_kind = 1").select("_q.*", "overall_rating", "healthy")


def attach_xg(matches: DataFrame, xg: DataFrame) -> DataFrame:
    """home_xg and away_xg by date and teams, else the proxies home_attack and away_attack, and xg_source."""
    x = xg.select("date", "home_team", "away_team", F.col("home_xg").alias("_h"), F.col("away_xg").alias("_a"))
    joined = matches.join(x, ["date", "home_team", "away_team"], "left")
    return joined.withColumns({"home_xg": F.coalesce("_h", "home_attack"), "away_xg": F.coalesce("_a", "away_attack"), "xg_source": F.when(F.col("_h").isNotNull(), "xg").otherwise("proxy")}).drop("_h", "_a")


def attach_venue(matches: DataFrame, fixtures: DataFrame, venues: DataFrame) -> DataFrame:
    """Altitude, dome and capacity of the city that fixtures(date, home_team, away_team, city) name; 0 if unknown."""
    joined = matches.join(fixtures, ["date", "home_team", "away_team"], "left").join(venues, "city", "left")
    return joined.withColumns({"venue_altitude_m": F.coalesce("altitude_m", F.lit(0)), "venue_is_dome": F.coalesce(F.col("is_dome").cast("int"), F.lit(0)), "venue_capacity": F.coalesce("capacity", F.lit(0))}).drop("city", "altitude_m", "is_dome", "capacity")


def squad_ratings(rows: DataFrame, squads: DataFrame, side: str = "") -> DataFrame:
    """rows with {side}squad_avg_rating (70) and {side}top_player_rating (75) of their {side}team."""
    s = squads.select(F.col("team").alias("_t"), F.col("squad_avg_rating").alias("_avg"), F.col("top_player_rating").alias("_top"))
    new = {f"{side}squad_avg_rating": F.coalesce("_avg", F.lit(70.0)), f"{side}top_player_rating": F.coalesce("_top", F.lit(75.0))}
    return rows.join(s, F.col(f"{side}team") == F.col("_t"), "left").withColumns(new).drop("_t", "_avg", "_top")


def attach_squad_ratings(matches: DataFrame, squads: DataFrame) -> DataFrame:
    """Average (70) and top (75) rating of both squads and the difference of the averages."""
    matches = squad_ratings(squad_ratings(matches, squads, "home_"), squads, "away_")
    return matches.withColumn("squad_rating_diff", F.col("home_squad_avg_rating") - F.col("away_squad_avg_rating"))


def lineup_players(fixtures: DataFrame, lineups: DataFrame, by_match: bool = True) -> DataFrame:
    """The starters of fixtures(team, match_id, date), by match or by day; team in any case."""
    key = "match_id" if by_match else "date"
    starters = lineups.where("is_starter").select(F.lower("team").alias("_team"), key, "player_id")
    return fixtures.withColumn("_team", F.lower("team")).join(starters, ["_team", key]).drop("_team")


#: Rows on each side of a block of the pair matrix, and pairs that make a task of it worthwhile.
BLOCK_ROWS, TASK_PAIRS = 1_000, 20_000_000


def pair_matrix(teams: DataFrame, blocks: int | None = None) -> DataFrame:
    """Every ordered pair of distinct teams with the attributes of both. The result itself has the square of teams' rows: for fixtures alone, join those. Both sides are dealt into blocks (without a number of them, of some BLOCK_ROWS each) and every block meets every other by an equi-join, so a team is copied once a block, not once for every few pairs."""
    n = teams.count() if blocks is None else None
    blocks = max(1, -(-n // BLOCK_ROWS)) if blocks is None else blocks
    a, b = (teams.select(*(F.col(c).alias(f"{s}_{c}") for c in teams.columns)) for s in ("home", "away"))
    mine = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    a, b = a.withColumn("_o", every).withColumn("_b", mine("home_team") * blocks + F.col("_o")), b.withColumn("_o", every).withColumn("_b", F.col("_o") * blocks + mine("away_team"))
    least = int(teams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, min(blocks * blocks, (n or 0) ** 2 // TASK_PAIRS))
    a, b = (x.drop("_o").repartition(parts, "_b") for x in (a, b))  # a little shuffled makes many pairs, so parts follow the pairs
    return a.join(b, "_b").where(F.col("home_team") != F.col("away_team")).drop("_b")


def match_either_orientation(fixtures: DataFrame, feed: DataFrame) -> DataFrame:
    """fixtures(fixture_id, date, home_team, away_team) with the scores of feed(date, home_team, away_team, home_score, away_score) in the fixture's orientation; the same orientation is preferred."""
    key = lambda df: df.withColumns({"_lo": F.least("home_team", "away_team"), "_hi": F.greatest("home_team", "away_team")})
    f = key(feed).select("date", "_lo", "_hi", F.col("home_team").alias("_home"), "home_score", "away_score")
    joined = key(fixtures).join(f, ["date", "_lo", "_hi"])
    same = F.col("home_team") == F.col("_home")
    best = F.min(F.struct((~same).cast("int").alias("o"), F.when(same, F.col("home_score")).otherwise(F.col("away_score")).alias("h"), F.when(same, F.col("away_score")).otherwise(F.col("home_score")).alias("a"))).alias("b")
    return joined.groupBy("fixture_id").agg(best).select("fixture_id", F.col("b.h").alias("home_score"), F.col("b.a").alias("away_score"), (F.col("b.o") == 1).alias("swapped"))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words over the larger number of distinct words; 0 if either has none."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    larger = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / larger)


def words_of(*columns: str) -> Column:
    """The distinct words of some texts, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"\s+"), lambda w: w != ""))


def sharing_rare(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """The distinct pairs (id, other_id) of a block in which one of the keep rarest of left(id, block, tokens, keep) is among right(other_id, block, tokens).

    Rare means rare on the right, in the block; so frequent tokens join nothing
    unless a left row has none but such.
    """
    index = right.select("other_id", block, F.explode("tokens").alias("token"))
    often = index.groupBy(block, "token").agg(F.count("*").alias("_n"))
    asked = left.select("id", block, "keep", F.explode("tokens").alias("token")).join(often.hint("merge"), [block, "token"], "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("_n", F.lit(0)), "token"))
    seeds = asked.withColumn("_place", place).where((F.col("_place") <= F.col("keep")) & F.col("_n").isNotNull())
    return seeds.select("id", block, "token").join(index.hint("merge"), [block, "token"]).select("id", "other_id").distinct()


def once_each(rows: DataFrame, key: list[str], number: str, *smallest: str) -> DataFrame:
    """Each distinct key of rows once, written, with a number of its own and the smallest struct of the columns smallest of its rows."""
    least = [F.min(F.struct(*smallest)).alias("_least")] if smallest else []
    return written((rows.groupBy(*key).agg(*least) if least else rows.select(*key).distinct()).withColumn(number, F.monotonically_increasing_id()), number)


def of_copies(left: DataFrame, asked: DataFrame, best: DataFrame, block: str) -> DataFrame:
    """id, other_id and score: best(_left, other_id, score), found for the distinct names asked(_left, name, block), for each row of left. Sides are merged: neither need fit a driver."""
    found = asked.join(best.hint("merge"), "_left").select("name", block, "other_id", "score")
    return left.select("id", "name", block).hint("merge").join(found, ["name", block]).select("id", "other_id", "score")


def token_match(left: DataFrame, right: DataFrame, block: str, threshold: float) -> DataFrame:
    """left(id, name, block) with the right(other_id, other_name, other_short, ordinal, block) of the same block with the largest token overlap of name or short name; the first ordinal of equal ones; only from threshold on (above 0).

    A pair with the threshold shares at least threshold * n of the n words of its
    left name, hence one of any n - that + 1 of them: only rows that share one of
    so many of the rarest meet. Rows of the same block and names are one: names
    that occur again and again meet once, whatever the number of their rows.
    """
    mine = once_each(left.where(F.col("name").isNotNull()), ["name", block], "_left")
    theirs = once_each(right, ["other_name", "other_short", block], "_right", "ordinal", "other_id")
    words = words_of("name")
    keep = F.size(words) - F.ceil(F.size(words) * threshold - 1e-9) + 1
    asked = mine.select(F.col("_left").alias("id"), block, words.alias("tokens"), keep.alias("keep"))
    known = theirs.select(F.col("_right").alias("other_id"), block, words_of("other_name", "other_short").alias("tokens"))
    pairs = sharing_rare(asked, known, block).select(F.col("id").alias("_left"), F.col("other_id").alias("_right"))
    scored = pairs.join(mine.select("_left", "name").hint("merge"), "_left").join(theirs.hint("merge"), "_right").withColumn("score", F.greatest(token_overlap(F.col("name"), F.col("other_name")), token_overlap(F.col("name"), F.col("other_short"))))
    best = scored.where(F.col("score") >= threshold).groupBy("_left").agg(F.min(F.struct((-F.col("score")).alias("s"), "_least")).alias("b"))
    return of_copies(left, mine, best.select("_left", F.col("b._least.other_id").alias("other_id"), (-F.col("b.s")).alias("score")), block)


def similarity(a: Column, b: Column) -> Column:
    """100 less the edit distance as a share of the longer string; 0 for two empty ones."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(0.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longer))


def letter_pairs(c: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    n = F.length(c)
    return F.array_distinct(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def deletions(c: Column, most: int) -> Column:
    """The distinct strings that up to most deletions of characters leave."""

    def fewer(s: Column) -> Column:
        less = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
        return F.concat(F.array(s), less)

    out = F.array(c)
    for _ in range(most):
        out = F.array_distinct(F.flatten(F.transform(out, fewer)))
    return out


#: Edits up to which names meet by what deletions leave.
MOST_EDITS = 2


def sharing_deletions(left: DataFrame, right: DataFrame, block: str, longest: int) -> DataFrame:
    """The distinct pairs (id, other_id) of a block of which some deletions, at most edits of left(id, block, _name, edits) from either name, leave the same: all pairs at most edits apart are among them. right(other_id, block, _long, _short); longer names than longest can't be meant."""
    own = F.when(F.col("edits") == 0, F.array("_name")).when(F.col("edits") == 1, deletions(F.col("_name"), 1)).otherwise(deletions(F.col("_name"), MOST_EDITS))
    names = F.filter(F.array_distinct(F.array("_long", "_short")), lambda n: n.isNotNull() & (F.length(n) <= longest))
    index = right.select("other_id", block, F.explode(names).alias("_n")).select("other_id", block, F.explode(deletions(F.col("_n"), MOST_EDITS)).alias("left_over"))
    return left.select("id", block, F.explode(own).alias("left_over")).join(index.hint("merge"), [block, "left_over"]).select("id", "other_id").distinct()


#: Parts into which the names of a block are dealt that meet all of it.
DEALT = 16


def meeting_all(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """left and right joined on the block alone. The names of a block are dealt into parts, each of which meets all of the other side: even tasks that hold a block of the right, and nothing that passes through the driver."""
    every = F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))
    dealt = F.pmod(F.xxhash64("id"), F.lit(DEALT)).cast("int")
    return left.withColumn("_part", dealt).join(right.withColumn("_part", every).hint("merge"), [block, "_part"]).drop("_part")


def fuzzy_squad_match(players: DataFrame, ratings: DataFrame, block: str, threshold: float = 75.0) -> DataFrame:
    """players(id, name, block) with the ratings(other_id, other_name, other_short, block) of the same block that is most similar in name or short name, from threshold on; ties go to the smaller other_id. Similarity is by edit distance, in the place of the third-party score used elsewhere.

    A pair with the threshold t is no more than d = n (1 - t) / t edits apart, n
    being the length of the player's name, and each edit undoes two letter pairs at
    most. So of any 2 d + 1 letter pairs of the name one is in the other: only rows
    that share one of so many of the rarest meet. A name with fewer letter pairs
    than that meets those with which it shares what up to d deletions leave; only if
    d is above MOST_EDITS too (a low threshold, or one letter again and again) it meets
    all of its block whose length allows the threshold. Rows of the same block and
    names (in lower case) are one: names that occur again and again meet once.
    """
    share = threshold / 100
    players = players.select("id", F.lower("name").alias("name"), block)
    asked = once_each(players.where(F.col("name").isNotNull()), ["name", block], "_left")
    given = once_each(ratings.select("other_id", F.lower("other_name").alias("_long"), F.lower("other_short").alias("_short"), block), ["_long", "_short", block], "_right", "other_id")
    mine = asked.select(F.col("_left").alias("id"), block, F.col("name").alias("_name")).withColumn("tokens", letter_pairs(F.col("_name")))
    keep = (2 * F.floor(F.length("_name") * (1 - share) / share + 1e-9) + 1).cast("int")
    mine = mine.withColumn("keep", keep)
    theirs = given.select(F.col("_right").alias("other_id"), block, "_long", "_short")
    known = theirs.withColumn("tokens", F.array_union(letter_pairs(F.coalesce("_long", F.lit(""))), letter_pairs(F.coalesce("_short", F.lit("")))))
    enough = F.size("tokens") >= F.col("keep")
    by_pairs = sharing_rare(mine.where(enough), known, block)
    fits = lambda c: (F.least(F.length("_name"), F.length(c)) >= share * F.greatest(F.length("_name"), F.length(c)) - 1e-9)
    short = mine.where(~enough).withColumn("edits", ((F.col("keep") - 1) / 2).cast("int"))
    by_deletions = sharing_deletions(short.where(F.col("edits") <= MOST_EDITS), theirs, block, math.ceil((MOST_EDITS + 1) / max(1 - share, 1e-9)))
    wanted = ("id", "_name", "_long", "_short", "_least")
    # many pairs: scored where they meet, so that only each task's best are sent on
    by_length = meeting_all(short.where(F.col("edits") > MOST_EDITS).select("id", block, "_name"), given, block).where(fits("_long") | fits("_short")).select(*wanted)
    pairs = by_pairs.unionByName(by_deletions)
    names = pairs.join(mine.select("id", "_name").hint("merge"), "id").join(given.withColumnRenamed("_right", "other_id").hint("merge"), "other_id").select(*wanted)
    scored = names.unionByName(by_length).withColumn("score", F.greatest(similarity(F.col("_name"), F.col("_long")), similarity(F.col("_name"), F.col("_short"))))
    best = scored.where(F.col("score") >= threshold).groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "_least")).alias("b"))
    return of_copies(players, asked, best.select(F.col("id").alias("_left"), F.col("b._least.other_id").alias("other_id"), (-F.col("b.s")).alias("score")), block)


def exact_then_fallback_match(left: DataFrame, right: DataFrame, block: str, threshold: float) -> DataFrame:
    """id, other_id and pass_no: rows of equal names (pass 1; the smallest other_id), then token matches of the rest (pass 2)."""
    first = right.groupBy(F.lower("other_name").alias("_name"), block).agg(F.min("other_id").alias("other_id"))
    exact = left.withColumn("_name", F.lower("name")).hint("merge").join(first, ["_name", block]).select("id", "other_id", F.lit(1).alias("pass_no"))
    rest = left.join(exact, "id", "left_anti")
    return exact.unionByName(token_match(rest, right, block, threshold).select("id", "other_id", F.lit(2).alias("pass_no")))


def prefer_model_by_tier(matches: DataFrame, base: DataFrame, special: DataFrame, tier: int) -> DataFrame:
    """p and model: the special prediction where competition_weight >= tier and there is one, else the base one."""
    joined = matches.join(base.withColumnRenamed("p", "_base"), "match_id", "left").join(special.withColumnRenamed("p", "_special"), "match_id", "left")
    use = (F.col("competition_weight") >= tier) & F.col("_special").isNotNull()
    return joined.withColumns({"p": F.when(use, F.col("_special")).otherwise(F.col("_base")), "model": F.when(use, "special").otherwise("base")}).drop("_base", "_special")
