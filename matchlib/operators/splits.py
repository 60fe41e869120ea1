"""Chronological splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, total: str | None = None) -> DataFrame:
    """df with position: the number of rows before each by date and match_id; and the number of all rows as total. Days are counted first, and only the table of days is accumulated in one task."""
    days = df.groupBy("date").agg(F.count("*").alias("_rows"))
    whole = Window.orderBy("date")
    ahead = days.withColumn("_ahead", F.coalesce(F.sum("_rows").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if total:
        ahead = ahead.withColumn(total, F.sum("_rows").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return df.join(ahead.drop("_rows"), "date").withColumn("position", F.row_number().over(Window.partitionBy("date").orderBy("match_id")) - 1 + F.col("_ahead")).drop("_ahead")


def chronological_split(df: DataFrame, test: float = 0.15, val: float = 0.20) -> DataFrame:
    """df with split: train, val or test by position. The cuts are rounded down from double products, as int() does."""
    if not (0 < test < 1 and 0 < val < 1 and test + val < 1):
        raise ValueError("test and val must be fractions that leave some rows to train on")
    first, second = (F.floor(F.col("_n") * F.lit(share)) for share in (1 - val - test, 1 - test))
    split = F.when(F.col("position") < first, "train").when(F.col("position") < second, "val").otherwise("test")
    return with_position(df, total="_n").withColumn("split", split).drop("_n")


def rolling_windows(df: DataFrame, windows: int = 5, min_train: float = 0.60) -> DataFrame:
    """A row for each row and window that it takes part in: window from 0, part train (all before) or test."""
    n = F.col("_n")
    start = F.floor(n * F.lit(min_train))
    many = F.greatest(F.lit(1), F.least(F.lit(windows), n - start)).cast("int")
    size = F.greatest(F.lit(1), F.floor((n - start) / many))
    low = lambda i: start + i * size
    high = lambda i: F.when(i == many - 1, n).otherwise(start + (i + 1) * size)
    part = lambda i: F.when(F.col("position") < low(i), "train").when(F.col("position") < high(i), "test")
    parts = F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("window"), part(i).alias("part")))
    mine = F.explode(F.filter(parts, lambda x: x["part"].isNotNull()))
    return with_position(df, total="_n").withColumn("_w", mine).select("*", "_w.window", "_w.part").drop("_w", "_n")


def year_folds(df: DataFrame, years: list[int], span: int = 2, least_train: int = 100, least_test: int = 10) -> DataFrame:
    """fold, n_train and n_test: tests are the years from fold on, training all before; folds with too few rows are left out."""
    folds = df.sparkSession.createDataFrame([(y,) for y in years], "fold int")
    y = F.year("date")
    counts = df.withColumn("_y", y).groupBy("_y").count()
    joined = folds.join(F.broadcast(counts), F.col("_y") < F.col("fold") + span)  # a row for each year
    agg = joined.groupBy("fold").agg(F.coalesce(F.sum(F.when(F.col("_y") < F.col("fold"), F.col("count"))), F.lit(0)).alias("n_train"), F.coalesce(F.sum(F.when(F.col("_y") >= F.col("fold"), F.col("count"))), F.lit(0)).alias("n_test"))
    return agg.where((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))


def event_cutoff_split(df: DataFrame, competition: str, year: int, cutoff: str) -> DataFrame:
    """df with split: test for the competition's matches of the year, train for those before the cutoff, the rest left out."""
    test = (F.col("competition") == competition) & (F.year("date") == year)
    return df.withColumn("split", F.when(test, "test").when(F.col("date") < F.lit(cutoff).cast("date"), "train")).where("split is not null")


def min_year(df: DataFrame, year: int, tier: int | None = None) -> DataFrame:
    out = df.where(F.year("date") >= year)
    return out if tier is None else out.where(F.col("competition_weight") >= tier)


def split_leak_check(split: DataFrame) -> DataFrame:
    """One row: last training day, first validation day, and whether the order holds."""
    return split.agg(F.max(F.when(F.col("split") == "train", F.col("date"))).alias("last_train"), F.min(F.when(F.col("split") == "val", F.col("date"))).alias("first_val")).withColumn("ok", F.coalesce(F.col("last_train") <= F.col("first_val"), F.lit(True)))
