"""Scoring math on tables."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.shared import dealt


def goal_rates(df: DataFrame, params: DataFrame) -> DataFrame:
    """lambda_home and lambda_away from both sides' attack and defense and one row of params."""
    at = lambda c: F.greatest(F.lit(0.1), F.col(c))
    joined = df.crossJoin(F.broadcast(params))  # one row
    rate = lambda base, me, other: at(base) * (at(f"{me}_attack") / at("mean_attack")) * (at(f"{other}_defense") / at("mean_defense"))
    clip = lambda x: F.greatest(F.lit(0.5), F.least(F.lit(4.0), x))
    home = rate("base_home", "home", "away") * F.when(F.col("neutral"), 1.0).otherwise(F.col("home_factor"))
    return joined.withColumns({"lambda_home": clip(home), "lambda_away": clip(rate("base_away", "away", "home"))}).drop(*params.columns)


def poisson(rate: Column, k: Column | int) -> Column:
    """The chance of k events."""
    if isinstance(k, int):
        return F.exp(-rate) * F.pow(rate, F.lit(float(k))) / math.factorial(k)
    return F.exp(-rate) * F.pow(rate, k) / F.factorial(k.cast("int"))


def scoreline_grid(df: DataFrame, top: int = 3, most: int = 5) -> DataFrame:
    """The top scorelines of each match, as rows match_id, place, h, a and p; ties go to the lower h, then a. The grid is an array within the row."""
    goals = F.sequence(F.lit(0), F.lit(most))
    cells = F.flatten(F.transform(goals, lambda h: F.transform(goals, lambda a: F.struct((-(poisson(F.col("lambda_home"), h) * poisson(F.col("lambda_away"), a))).alias("q"), h.alias("h"), a.alias("a")))))
    best = df.select("match_id", F.posexplode(F.slice(F.array_sort(cells), 1, top)).alias("i", "c"))
    return best.select("match_id", (F.col("i") + 1).alias("place"), "c.h", "c.a", F.round(-F.col("c.q"), 6).alias("p"))


def outcome_from_rates(df: DataFrame, most: int = 10) -> DataFrame:
    """p_h, p_d and p_a from the goal rates, over scores up to most each, renormalised; no row is multiplied."""
    home, away = ([poisson(F.col(f"lambda_{s}"), k) for k in range(most + 1)] for s in ("home", "away"))
    cells = F.array(*home), F.array(*away)
    draw = F.aggregate(F.zip_with(*cells, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # win: sum over h of P(h) * P(away < h)
    running = F.aggregate(F.zip_with(*cells, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("win")), lambda s, c: F.struct((s["below"] + c["y"]).alias("below"), (s["win"] + c["x"] * s["below"]).alias("win")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    whole = total(cells[0]) * total(cells[1])
    out = df.withColumns({"_w": running["win"], "_d": draw, "_n": whole})
    return out.withColumns({"p_h": F.col("_w") / F.col("_n"), "p_d": F.col("_d") / F.col("_n"), "p_a": 1 - (F.col("_w") + F.col("_d")) / F.col("_n")}).drop("_w", "_d", "_n")


def rates_for_outcome(targets: DataFrame, step: float = 0.05, low: float = 0.5, high: float = 2.5) -> DataFrame:
    """match_id with the lattice point (lambda_home, lambda_away) whose outcome is closest to p_h, p_d and p_a; the lower point on ties. The lattice is computed once and is of fixed size; it stands in for a numeric optimiser."""
    n = round((high - low) / step) + 1
    points = targets.sparkSession.range(n * n).select((F.lit(low) + F.floor(F.col("id") / n) * step).alias("lambda_home"), (F.lit(low) + (F.col("id") % n) * step).alias("lambda_away"))
    lattice = outcome_from_rates(points).agg(F.array_sort(F.collect_list(F.struct("lambda_home", "lambda_away", F.col("p_h").alias("h"), F.col("p_d").alias("d"), F.col("p_a").alias("a")))).alias("lattice"))
    square = lambda x, p: (x - F.col(p)) * (x - F.col(p))
    loss = F.transform("lattice", lambda c: F.struct(F.round(square(c["h"], "p_h") + square(c["d"], "p_d") + square(c["a"], "p_a"), 12).alias("loss"), c["lambda_home"].alias("lambda_home"), c["lambda_away"].alias("lambda_away")))
    return targets.crossJoin(F.broadcast(lattice)).withColumn("_b", F.array_min(loss)).select("match_id", "_b.lambda_home", "_b.lambda_away")


def select_scoreline(df: DataFrame, scorelines: str = "scorelines") -> DataFrame:
    """h and a of the first of scorelines (array of h, a) that agrees with the most probable outcome and has at most 6 goals; else rounded goal rates."""
    outcome = F.when((F.col("p_h") >= F.col("p_d")) & (F.col("p_h") >= F.col("p_a")), 1).when(F.col("p_a") >= F.col("p_d"), -1).otherwise(0)
    fits = F.filter(scorelines, lambda s: (F.signum(s["h"] - s["a"]) == outcome) & (s["h"] + s["a"] <= 6))
    first = F.when(F.size(fits) > 0, F.element_at(fits, 1))
    return df.withColumns({"h": F.coalesce(first["h"], F.round("lambda_home").cast("int")), "a": F.coalesce(first["a"], F.round("lambda_away").cast("int"))})


def neutral_symmetrize(pairs: DataFrame) -> DataFrame:
    """pairs(home, away, p_h, p_d, p_a) averaged with the swapped pair, where there is one."""
    other = pairs.select(F.col("home").alias("away"), F.col("away").alias("home"), F.col("p_h").alias("_h"), F.col("p_d").alias("_d"), F.col("p_a").alias("_a"))
    joined = pairs.join(other, ["home", "away"], "left")
    half = lambda a, b: (F.col(a) + F.coalesce(b, a)) / 2
    return joined.select("home", "away", half("p_h", "_a").alias("p_h"), half("p_d", "_d").alias("p_d"), half("p_a", "_h").alias("p_a"))


def compress_to_uniform(df: DataFrame, factor: float = 0.20, only: Column | None = None) -> DataFrame:
    """Probabilities drawn to one third by factor, for the rows that only names."""
    cond = F.lit(True) if only is None else only
    return df.withColumns({p: F.when(cond, (1 - factor) * F.col(p) + factor / 3).otherwise(F.col(p)) for p in ("p_h", "p_d", "p_a")})


def blend_models(long: DataFrame, weights: DataFrame, draw: DataFrame, draw_weight: float) -> DataFrame:
    """match_id, p_h, p_d and p_a: long(match_id, model, p_h, p_d, p_a) averaged with weights(model, w_h, w_d, w_a), a draw model (match_id, p_draw) mixed in, the rest split as it stands."""
    joined = long.join(weights, "model")
    mixed = dealt(joined, "match_id").groupBy("match_id").agg(*((F.sum(F.col(f"p_{c}") * F.col(f"w_{c}")) / F.sum(f"w_{c}")).alias(f"_{c}") for c in "hda")).join(draw, "match_id", "left")
    d = F.when(F.col("p_draw").isNull(), F.col("_d")).otherwise((1 - draw_weight) * F.col("_d") + draw_weight * F.col("p_draw"))
    rest = F.col("_h") + F.col("_a")
    share = F.when(rest > 0, F.col("_h") / rest).otherwise(0.5)
    left = mixed.withColumns({"_s": share, "_x": d}).withColumns({"_hh": (1 - F.col("_x")) * F.col("_s"), "_aa": (1 - F.col("_x")) * (1 - F.col("_s"))})
    total = F.col("_hh") + F.col("_x") + F.col("_aa")
    return left.select("match_id", (F.col("_hh") / total).alias("p_h"), (F.col("_x") / total).alias("p_d"), (F.col("_aa") / total).alias("p_a"))


def blend_interval(long: DataFrame, least: float = 0.15) -> DataFrame:
    """Per match and class of long(match_id, model, weight, p_h, p_d, p_a): weighted mean and mean -/+ weighted deviation over models of at least least weight (all if none has it), within 0 and 1."""
    some = F.max("weight").over(Window.partitionBy("match_id"))
    kept = dealt(long, "match_id").withColumn("_w", F.when((F.col("weight") >= least) | (some < least), F.col("weight")).otherwise(0.0))
    agg = []
    for c in "hda":
        agg += [F.sum(F.col("_w") * F.col(f"p_{c}")).alias(f"_m{c}"), F.sum(F.col("_w") * F.col(f"p_{c}") * F.col(f"p_{c}")).alias(f"_q{c}")]
    one = kept.groupBy("match_id").agg(F.sum("_w").alias("_n"), *agg)
    out = []
    for c in "hda":
        mean = F.col(f"_m{c}") / F.col("_n")
        deviation = F.sqrt(F.greatest(F.lit(0.0), F.round(F.col(f"_q{c}") / F.col("_n") - mean * mean, 12)))
        out += [F.round(mean, 6).alias(f"p_{c}"), F.round(F.greatest(F.lit(0.0), mean - deviation), 5).alias(f"low_{c}"), F.round(F.least(F.lit(1.0), mean + deviation), 5).alias(f"high_{c}")]
    return one.select("match_id", *out)


_BLOCK = "name string, lo double, hi double, total double, n double"


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (name, lo, hi, total, n), in order of name and lo, pooled until their means rise. Pooling pools of parts gives the pools of the whole."""
    name, stack = None, []

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.float64()) for c in zip(*rows))], names=["name", "lo", "hi", "total", "n"])

    for batch in batches:
        for new, *block in zip(*(batch.column(c).to_pylist() for c in ("name", "lo", "hi", "total", "n"))):
            if new != name:
                if stack:
                    yield out(stack)
                name, stack = new, []
            stack.append(block)
            # means compared without division
            while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
                _, hi, total, n = stack.pop()
                lo, _, before, m = stack.pop()
                stack.append([lo, hi, before + total, m + n])
    if stack:
        yield out(stack)


def isotonic_fits(points: DataFrame) -> DataFrame:
    """name, lo, hi and value: the steps of an isotonic regression of y on x for each name of points(name, x, y).

    Equal x are summed first. Points are dealt out by ranges of x, pooled there,
    and what is left, few blocks unless they rise already, is pooled for each name.
    """
    sums = points.where("x is not null and y is not null").groupBy("name", "x").agg(F.sum(F.col("y").cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
    blocks = sums.select("name", F.col("x").alias("lo"), F.col("x").alias("hi"), "total", "n")
    parts = blocks.repartitionByRange("name", "lo").sortWithinPartitions("name", "lo").mapInArrow(_pooled, _BLOCK)
    whole = parts.repartition("name").sortWithinPartitions("name", "lo").mapInArrow(_pooled, _BLOCK)
    return whole.select("name", "lo", "hi", (F.col("total") / F.col("n")).alias("value"))


def calibrate_isotonic(validation: DataFrame, rows: DataFrame, clip: float = 1e-6, by: str | None = None, most_steps: int = 1_000_000) -> DataFrame:
    """rows with p_a, p_d and p_h mapped by isotonic regressions, one for each class, fitted on validation(y, p_a, p_d, p_h); clipped and renormalised. With by, for each value of it apart; rows of a value that validation lacks become even shares.

    All regressions are fitted in one pass. Between steps values are interpolated, beyond
    the outer ones they are theirs. The steps, at most most_steps (else an error), go
    to the tasks that map rows.
    """
    name = lambda c: F.concat(F.lit(c), F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit(""))
    each = F.explode(F.array(*(F.struct(name(c).alias("name"), F.col(f"p_{c}").alias("x"), (F.col("y") == i).cast("int").alias("y")) for i, c in enumerate("adh")))).alias("e")
    steps = isotonic_fits(validation.select(each).select("e.*")).orderBy("name", "lo").limit(most_steps + 1).toArrow()
    if steps.num_rows > most_steps:
        raise ValueError(f"more than {most_steps} steps")
    fits: dict[str, tuple[list[float], list[float]]] = {}
    for n, lo, hi, value in zip(*(steps.column(c).to_pylist() for c in ("name", "lo", "hi", "value"))):
        xs, ys = fits.setdefault(n, ([], []))
        xs += [lo] if lo == hi else [lo, hi]
        ys += [value] if lo == hi else [value, value]
    shared = rows.sparkSession.sparkContext.broadcast(fits)

    @pandas_udf("p_a double, p_d double, p_h double")
    def mapped(value: pd.Series, a: pd.Series, d: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = {c: pd.Series(np.nan, index=value.index) for c in "adh"}
        for v, at in value.groupby(value).groups.items():
            for c, x in zip("adh", (a, d, h)):
                xs, ys = shared.value.get(f"{c}{v}", ([0.0], [1 / 3]))
                out[c][at] = np.interp(x[at], xs, ys)
        safe = {c: x.clip(clip, 1 - clip) for c, x in out.items()}
        total = sum(safe.values())
        return pd.DataFrame({f"p_{c}": x / total for c, x in safe.items()})

    p = mapped(F.coalesce(F.col(by).cast("string"), F.lit("")) if by else F.lit(""), *(F.col(f"p_{c}").cast("double") for c in "adh"))
    return rows.withColumn("_p", p).withColumns({f"p_{c}": F.col(f"_p.p_{c}") for c in "adh"}).drop("_p")


def encode_features(train: DataFrame, categorical: list[str], numeric: list[str]) -> PipelineModel:
    """A fitted encoder to features: one-hot categories (unknown ones are zero everywhere) and standardised numbers. Population deviations are taken by scaled()."""
    index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    hot = OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep", dropLast=True)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[*(f"{c}_hot" for c in categorical), *numeric], outputCol="features")]).fit(train)


def scaled(train: DataFrame, rows: DataFrame, numeric: list[str]) -> DataFrame:
    """rows with numeric columns standardised by train's mean and population deviation (0 if it doesn't vary); nulls become the mean."""
    stats = train.agg(*(x for c in numeric for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.when(F.col(f"_s_{c}") > 0, (F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in numeric}
    return joined.withColumns(z).drop(*stats.columns)


def balanced(rows: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """rows with sample_weight: n / (k n_c) for each of k classes, times a weight if given."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_c"))
    share = counts.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))  # one row
    per_class = counts.crossJoin(F.broadcast(share)).select(label, (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("_w"))
    return rows.join(F.broadcast(per_class), label).withColumn("sample_weight", F.col("_w") * (F.col(weight) if weight else F.lit(1.0))).drop("_w")  # a row for each class


def train_logreg(encoded: DataFrame, label: str, weight: str | None = None, features: str = "features", binary: bool = False):
    """A multinomial (or binary) logistic regression, by a sample weight if given."""
    model = LogisticRegression(featuresCol=features, labelCol=label, family="binomial" if binary else "multinomial", maxIter=50, regParam=0.001)
    return (model.setWeightCol(weight) if weight else model).fit(encoded)


def _newton_sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of rows (x array, k, w): the rows of the weighted Hessian and, in its last column, the gradient of the log loss at beta, summed over the task."""
    free, q = beta.shape
    total = np.zeros((free, q, free * q + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.column_stack([np.ones(batch.num_rows), np.stack(batch.column("x").to_numpy(zero_copy_only=False))]) if q > 1 else np.ones((batch.num_rows, 1))
        k, w = batch.column("k").to_numpy(), batch.column("w").to_numpy()
        z = np.column_stack([np.zeros(len(x)), x @ beta.T])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p = (p / p.sum(axis=1, keepdims=True))[:, 1:]
        total[:, :, -1] += (w[:, None] * (p - (k[:, None] == np.arange(1, free + 1)))).T @ x
        for i in range(free):
            for j in range(free):
                total[i, :, j * q : (j + 1) * q] += (x * (w * p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x
    rows = total.reshape(free * q, -1)
    yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(rows)), pa.int32()), "row": pa.array(rows.tolist(), pa.list_(pa.float64()))})


#: Weights that one small system on the driver solves for.
MOST_WEIGHTS = 2000


def train_newton(rows: DataFrame, features: list[str], label: str, classes: int = 3, weight: str | None = None, ridge: float = 0.001, steps: int = 8) -> DataFrame:
    """Weights of a logistic regression on numeric features: class_no (from 1; class 0 has none), feature ("" is the intercept) and weight, after some Newton steps from zero.

    The loss is the weighted mean log loss plus ridge / 2 times the squared weights but
    for intercepts. A step is one pass: each task sums its gradient and Hessian, the
    Gram matrix of rows weighted by their probabilities; the sums, a square of
    the number of weights, are added up, and the driver solves that small system.
    Null features count as 0; rows with a null label are left out.
    """
    q, free = len(features) + 1, classes - 1
    if q * free > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    x = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features)) if features else F.array().cast("array<double>")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    data = rows.where(F.col(label).isNotNull()).select(x.alias("x"), F.col(label).cast("int").alias("k"), w.alias("w"))
    total = data.agg(F.sum("w")).first()[0]
    beta, penalty = np.zeros((free, q)), np.tile(np.append(0.0, np.full(q - 1, ridge)), free)
    for _ in range(steps if total else 0):
        parts = data.mapInArrow(functools.partial(_newton_sums, beta=beta), "i int, row array<double>")
        sums = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
        system = np.zeros((free * q, free * q + 1))
        system[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
        gradient = system[:, -1] / total + penalty * beta.ravel()
        beta = beta - np.linalg.lstsq(system[:, :-1] / total + np.diag(penalty), gradient, rcond=None)[0].reshape(free, q)
    names = ["", *features]
    return rows.sparkSession.createDataFrame([(c + 1, names[j], float(beta[c, j])) for c in range(free) for j in range(q)], "class_no int, feature string, weight double")


def predict_newton(weights: DataFrame, rows: DataFrame, features: list[str], classes: str = "adh") -> DataFrame:
    """rows with p_<class> for each class, in the order of their codes, by the weights of train_newton: one row of them, broadcast, and built-in functions."""
    key = F.concat_ws(":", F.col("class_no").cast("string"), "feature")
    one = weights.agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "weight"))).alias("_w"))
    joined = rows.crossJoin(F.broadcast(one))  # one row
    z = {c: F.lit(0.0) for c in classes[:1]}
    for i, c in enumerate(classes[1:], 1):
        z[c] = sum((F.col("_w")[f"{i}:{f}"] * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features), F.col("_w")[f"{i}:"])
    joined = joined.withColumns({f"_z{c}": x for c, x in z.items()})
    top = F.greatest(*(f"_z{c}" for c in classes))
    joined = joined.withColumns({f"_e{c}": F.exp(F.col(f"_z{c}") - top) for c in classes})
    total = sum((F.col(f"_e{c}") for c in classes[1:]), F.col(f"_e{classes[0]}"))
    return joined.withColumns({f"p_{c}": F.col(f"_e{c}") / total for c in classes}).drop("_w", *(f"_{k}{c}" for k in "ze" for c in classes))


def predict_batch(model, rows: DataFrame, classes: str = "adh") -> DataFrame:
    """rows scored in one pass: p_<class> for each class, in the order of their codes."""
    p = vector_to_array("probability")
    return model.transform(rows).select("*", *(p[i].alias(f"p_{c}") for i, c in enumerate(classes))).drop("rawPrediction", "probability", "prediction")


def explain_row(df: DataFrame) -> DataFrame:
    """The columns that explain a prediction, rounded."""
    kinds = {"elo_diff_home_away": 1, "rank_diff": 0, "form_diff": 2, "h2h_goal_diff": 2, "p_h": 4, "p_d": 4, "p_a": 4}
    return df.select("match_id", *(F.round(c, n).alias(c) for c, n in kinds.items() if c in df.columns))
