"""Metrics over predictions(model, y, p_a, p_d, p_h) with y 0 for A, 1 for D, 2 for H."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLASSES = ("a", "d", "h")
P = [f"p_{c}" for c in CLASSES]


def predicted() -> Column:
    """The most probable class, the lowest of equal ones."""
    return F.when((F.col("p_a") >= F.col("p_d")) & (F.col("p_a") >= F.col("p_h")), 0).when(F.col("p_d") >= F.col("p_h"), 1).otherwise(2)


def _of_y(*values: Column) -> Column:
    return F.when(F.col("y") == 0, values[0]).when(F.col("y") == 1, values[1]).otherwise(values[2])


def row_log_loss(clip: float = 1e-10, renormalise: bool = True) -> Column:
    p = [F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(c))) for c in P]
    chosen = _of_y(*p)
    return -F.log(chosen / (p[0] + p[1] + p[2]) if renormalise else chosen)


def row_brier() -> Column:
    return sum((F.pow(F.col(c) - (F.col("y") == i).cast("int"), 2) for i, c in enumerate(P)), F.lit(0.0))


def row_hit() -> Column:
    return (predicted() == F.col("y")).cast("int")


def _basic_sums() -> list[Column]:
    return [F.count("*").alias("n"), F.round(F.avg(row_hit()), 6).alias("accuracy"), F.round(F.avg(row_log_loss()), 6).alias("log_loss"), F.round(F.avg(row_brier()), 6).alias("brier")]


def basic_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """n, accuracy, log_loss and brier of each group, in one pass."""
    return predictions.groupBy(*by).agg(*_basic_sums())


def confusion_matrix(predictions: DataFrame, by: list[str]) -> DataFrame:
    """group, y, predicted and n, zeros kept; the counts are made in one pass and turned by a fixed list."""
    cells = [(t, p) for t in range(3) for p in range(3)]
    counts = predictions.groupBy(*by).agg(*(F.count_if((F.col("y") == t) & (predicted() == p)).alias(f"_{t}{p}") for t, p in cells))
    return counts.select(*by, F.explode(F.array(*(F.struct(F.lit(t).alias("y"), F.lit(p).alias("predicted"), F.col(f"_{t}{p}").alias("n")) for t, p in cells))).alias("c")).select(*by, "c.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def _class_sums() -> list[Column]:
    """For each class: hits, predictions and support."""
    return [x for i in range(3) for x in (F.count_if((F.col("y") == i) & (predicted() == i)).alias(f"_t{i}"), F.count_if(predicted() == i).alias(f"_p{i}"), F.count_if(F.col("y") == i).alias(f"_s{i}"))]


def _class_rows() -> list[tuple]:
    """(class, precision, recall, F1, support) of each class and of both means, from _class_sums."""
    one = []
    for i, c in enumerate(CLASSES):
        precision, recall = _ratio(F.col(f"_t{i}"), F.col(f"_p{i}")), _ratio(F.col(f"_t{i}"), F.col(f"_s{i}"))
        one.append((c.upper(), precision, recall, _ratio(2 * precision * recall, precision + recall), F.col(f"_s{i}")))
    total = one[0][4] + one[1][4] + one[2][4]
    macro = [sum((x[k] for x in one), F.lit(0.0)) / 3 for k in (1, 2, 3)]
    weighted = [_ratio(sum((x[k] * x[4] for x in one), F.lit(0.0)), total) for k in (1, 2, 3)]
    return [*one, ("macro", *macro, total), ("weighted", *weighted, total)]


def per_class_prf(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each class and group, 0 where undefined; class macro is their mean, weighted their mean by support."""
    structs = [F.struct(F.lit(n).alias("cls"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), s.cast("long").alias("support")) for n, p, r, f, s in _class_rows()]
    return predictions.groupBy(*by).agg(*_class_sums()).select(*by, F.explode(F.array(*structs)).alias("c")).select(*by, "c.*")


def calibration_bins(predictions: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """group, cls, bin (right-closed, equal widths), n, mean_pred and frac_pos of the bins that aren't empty."""
    stacked = predictions.select(*by, F.explode(F.array(*(F.struct(F.lit(c.upper()).alias("cls"), F.col(f"p_{c}").alias("p"), (F.col("y") == i).cast("int").alias("hit")) for i, c in enumerate(CLASSES)))).alias("c")).select(*by, "c.*")
    binned = stacked.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(bins - 1), (F.ceil(F.round(F.col("p") * bins, 9)) - 1).cast("int"))))
    return binned.groupBy(*by, "cls", "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg("hit").alias("frac_pos"))


def calibration(predictions: DataFrame, by: list[str], bins: int = 5) -> DataFrame:
    """group, cls, ece (mean over bins, not weighted) and overconfident; null for a class that always or never occurs."""
    per_bin = calibration_bins(predictions, by, bins)
    out = per_bin.groupBy(*by, "cls").agg(F.avg(F.abs(F.col("frac_pos") - F.col("mean_pred"))).alias("ece"), F.avg(F.col("mean_pred") - F.col("frac_pos")).alias("gap"), F.sum(F.col("frac_pos") * F.col("n")).alias("hits"), F.sum("n").alias("total"))
    known = (F.round("hits") > 0) & (F.round("hits") < F.col("total"))
    return out.select(*by, "cls", F.when(known, F.round("ece", 6)).alias("ece"), F.when(known, F.col("gap") > 0).alias("overconfident"))


def metrics_by_group(predictions: DataFrame, group: str, few: int = 30, drop: float = 0.10) -> DataFrame:
    """Accuracy and macro precision, recall and F1 of each group; low_sample below few rows, flagged if the accuracy is below that of all by more than drop."""
    prf = per_class_prf(predictions, [group]).where("cls = 'macro'").select(group, F.col("precision").alias("macro_precision"), F.col("recall").alias("macro_recall"), F.col("f1").alias("macro_f1"))
    acc = predictions.groupBy(group).agg(F.count("*").alias("n"), F.avg(row_hit()).alias("accuracy"))
    whole = predictions.agg(F.avg(row_hit()).alias("_all"))
    joined = acc.join(prf, group).crossJoin(F.broadcast(whole))  # one row
    return joined.select(group, "n", F.round("accuracy", 6).alias("accuracy"), "macro_precision", "macro_recall", "macro_f1", (F.col("n") < few).alias("low_sample"), (F.col("_all") - F.col("accuracy") > drop).alias("flagged"))


def compare_models(predictions: DataFrame, by: list[str]) -> DataFrame:
    """All basic metrics, mean ECE and macro F1 of each model (by[0]) and window, with the model's place by accuracy, then log-loss, then name."""
    ece = calibration(predictions, by).groupBy(*by).agg(F.round(F.avg("ece"), 6).alias("mean_ece"))
    macro_f1 = next(F.round(x[3], 6) for x in _class_rows() if x[0] == "macro")
    one = predictions.groupBy(*by).agg(*_basic_sums(), *_class_sums()).select(*by, "n", "accuracy", "log_loss", "brier", macro_f1.alias("macro_f1"))
    joined = one.join(ece, by)
    place = Window.partitionBy(*by[1:]).orderBy(F.desc("accuracy"), "log_loss", by[0])  # rows: models
    return joined.withColumn("place", F.row_number().over(place))


def backtest_summary(per_window: DataFrame) -> DataFrame:
    """Mean and population deviation over windows of each model's accuracy and log_loss."""
    return per_window.groupBy("model").agg(F.count("*").alias("n_windows"), *(f for m in ("accuracy", "log_loss") for f in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))))


def worst_predictions(predictions: DataFrame, n: int = 10) -> DataFrame:
    """The n rows with the largest loss, not renormalised; ties by match_id and model."""
    return predictions.withColumn("loss", F.round(row_log_loss(renormalise=False), 6)).orderBy(F.desc("loss"), "match_id", "model").limit(n)


def metrics_by_stage(predictions: DataFrame, stage: str = "tournament_stage", least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """n, accuracy and log_loss of each stage (of each by) with at least so many rows."""
    return predictions.groupBy(*by, stage).agg(F.count("*").alias("n"), F.round(F.avg(row_hit()), 6).alias("accuracy"), F.round(F.avg(row_log_loss()), 6).alias("log_loss")).where(F.col("n") >= least)


def draw_report(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of draws for each group, by falling recall."""
    return per_class_prf(predictions, by).where("cls = 'D'").drop("cls").orderBy(F.desc("recall"), *by)
