"""Queries for evaluation, splits, scoring and standings (H-K)."""

from __future__ import annotations

import functools

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning as B
from ..operators import evaluation as H
from ..operators import scoring as J
from ..operators import splits as I
from ..operators import standings as K
from ..operators.aggregates import score_model_params, stage_tally
from ..operators import elo as R
from ..sources.shared import written
from .join_queries import _TALLY, ATTACKED, CONFIG, PARAMS, attacked, labelled
from .queries import query, r6
from .testdata import STAGE_NAMES, Views, with_views

# --- H: evaluation -------------------------------------------------------------------------------

_PRED = with_views("predictions") + """, ev AS (SELECT *, CASE WHEN p_a >= p_d AND p_a >= p_h THEN 0 WHEN p_d >= p_h THEN 1 ELSE 2 END AS guess, CASE y WHEN 0 THEN p_a WHEN 1 THEN p_d ELSE p_h END AS py FROM predictions),
sc AS (SELECT *, CAST(guess = y AS INT) AS hit, -ln(greatest(1e-10, least(1 - 1e-10, py)) / (greatest(1e-10, least(1 - 1e-10, p_a)) + greatest(1e-10, least(1 - 1e-10, p_d)) + greatest(1e-10, least(1 - 1e-10, p_h)))) AS loss,
  pow(p_a - CAST(y = 0 AS INT), 2) + pow(p_d - CAST(y = 1 AS INT), 2) + pow(p_h - CAST(y = 2 AS INT), 2) AS brier FROM ev)"""


def one_metric(name: str, column: str, expression: str) -> None:
    @query(name, _PRED + f" SELECT model, count(*) AS n, round(avg({expression}), 6) AS {column} FROM sc GROUP BY model")
    def _(v: Views) -> DataFrame:
        return H.basic_metrics(v.predictions(), ["model"]).select("model", "n", column)


one_metric("h1_accuracy", "accuracy", "hit")
one_metric("h2_log_loss", "log_loss", "loss")
one_metric("h3_brier", "brier", "brier")


@query("h4_confusion_matrix", _PRED + ", cells AS (SELECT * FROM (SELECT DISTINCT model FROM sc), (SELECT unnest([0, 1, 2]) AS y), (SELECT unnest([0, 1, 2]) AS predicted)) SELECT model, y, predicted, (SELECT count(*) FROM sc WHERE sc.model = cells.model AND sc.y = cells.y AND sc.guess = cells.predicted) AS n FROM cells")
def h4(v: Views) -> DataFrame:
    return H.confusion_matrix(v.predictions(), ["model"])


def prf_sql(by: str) -> str:
    return _PRED + f""", cl AS (SELECT {by}, c, count(*) FILTER (y = c AND guess = c) AS tp, count(*) FILTER (guess = c) AS pp, count(*) FILTER (y = c) AS s FROM sc, (SELECT unnest([0, 1, 2]) AS c) GROUP BY {by}, c),
pr AS (SELECT *, CASE WHEN pp = 0 THEN 0.0 ELSE tp / pp END AS p, CASE WHEN s = 0 THEN 0.0 ELSE tp / s END AS r FROM cl),
f AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr),
prf AS (SELECT {by}, ['A', 'D', 'H'][c + 1] AS cls, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, s AS support FROM f
UNION ALL SELECT {by}, 'macro', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6), CAST(sum(s) AS BIGINT) FROM f GROUP BY {by}
UNION ALL SELECT {by}, 'weighted', round(sum(p * s) / sum(s), 6), round(sum(r * s) / sum(s), 6), round(sum(f1 * s) / sum(s), 6), CAST(sum(s) AS BIGINT) FROM f GROUP BY {by})"""


@query("h5_per_class_prf", prf_sql("model") + " SELECT * FROM prf")
def h5(v: Views) -> DataFrame:
    return H.per_class_prf(v.predictions(), ["model"])


def bins_sql(by: str) -> str:
    return f"""st AS (SELECT {by}, 'A' AS cls, p_a AS p, CAST(y = 0 AS INT) AS hit FROM sc UNION ALL SELECT {by}, 'D', p_d, CAST(y = 1 AS INT) FROM sc UNION ALL SELECT {by}, 'H', p_h, CAST(y = 2 AS INT) FROM sc),
bn AS (SELECT {by}, cls, CAST(greatest(0, least(4, ceil(round(p * 5, 9)) - 1)) AS INT) AS bin, count(*) AS n, avg(p) AS mean_pred, avg(hit) AS frac_pos FROM st GROUP BY {by}, cls, bin)"""


@query("h6_calibration_bins", _PRED + ", " + bins_sql("model") + " SELECT model, cls, bin, n, round(mean_pred, 6) AS mean_pred, round(frac_pos, 6) AS frac_pos FROM bn")
def h6b(v: Views) -> DataFrame:
    return H.calibration_bins(v.predictions(), ["model"]).select("model", "cls", "bin", "n", *r6("mean_pred", "frac_pos"))


@query("h6_calibration", _PRED + ", " + bins_sql("model") + " SELECT model, cls, round(avg(abs(frac_pos - mean_pred)), 6) AS ece, avg(mean_pred - frac_pos) > 0 AS overconfident FROM bn GROUP BY 1, 2")
def h6(v: Views) -> DataFrame:
    return H.calibration(v.predictions(), ["model"])


@query("h7_metrics_by_group", prf_sql("tournament_stage") + " SELECT tournament_stage, n, round(acc, 6) AS accuracy, precision AS macro_precision, recall AS macro_recall, f1 AS macro_f1, n < 30 AS low_sample, (SELECT avg(hit) FROM sc) - acc > 0.10 AS flagged FROM (SELECT tournament_stage, count(*) AS n, avg(hit) AS acc FROM sc GROUP BY 1) JOIN prf USING (tournament_stage) WHERE cls = 'macro'")
def h7(v: Views) -> DataFrame:
    return H.metrics_by_group(v.predictions(), "tournament_stage")


@query("h8_compare_models", prf_sql("model, win").replace("SELECT model, win, ['A'", "SELECT model, win, ['A'") + ", " + bins_sql("model, win") + """, ec AS (SELECT model, win, round(avg(e), 6) AS mean_ece FROM (SELECT model, win, cls, round(avg(abs(frac_pos - mean_pred)), 6) AS e FROM bn GROUP BY 1, 2, 3) GROUP BY 1, 2),
ba AS (SELECT model, win, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(loss), 6) AS log_loss, round(avg(brier), 6) AS brier FROM sc GROUP BY 1, 2)
SELECT model, win, n, accuracy, log_loss, brier, mean_ece, f1 AS macro_f1, CAST(row_number() OVER (PARTITION BY win ORDER BY accuracy DESC, log_loss, model) AS INT) AS place FROM ba JOIN ec USING (model, win) JOIN prf USING (model, win) WHERE cls = 'macro'""")
def h8(v: Views) -> DataFrame:
    return H.compare_models(v.predictions(), ["model", "win"])


@query("h9_backtest_summary", _PRED + ", ba AS (SELECT model, win, round(avg(hit), 6) AS accuracy, round(avg(loss), 6) AS log_loss FROM sc GROUP BY 1, 2) SELECT model, count(*) AS n_windows, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_std, round(avg(log_loss), 6) AS log_loss_mean, round(stddev_pop(log_loss), 6) AS log_loss_std FROM ba GROUP BY model")
def h9(v: Views) -> DataFrame:
    return H.backtest_summary(H.basic_metrics(v.predictions(), ["model", "win"]))


@query("h10_worst_predictions", _PRED + " SELECT match_id, model, round(-ln(greatest(1e-10, least(1 - 1e-10, py))), 6) AS loss FROM sc ORDER BY loss DESC, match_id, model LIMIT 10")
def h10(v: Views) -> DataFrame:
    return H.worst_predictions(v.predictions()).select("match_id", "model", "loss")


@query("h11_metrics_by_stage", _PRED + " SELECT model, competition, CAST(year(date) AS INT) AS year, tournament_stage, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(loss), 6) AS log_loss FROM sc GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2")
def h11(v: Views) -> DataFrame:
    return H.metrics_by_stage(v.predictions().withColumn("year", F.year("date")), by=("model", "competition", "year"))


@query("h12_draw_report", prf_sql("model") + " SELECT model, precision, recall, f1, support FROM prf WHERE cls = 'D'")
def h12(v: Views) -> DataFrame:
    return H.draw_report(v.predictions(), ["model"])


# --- I: splits -----------------------------------------------------------------------------------

_POS = with_views("matches") + ", pos AS (SELECT *, row_number() OVER (ORDER BY date, match_id) - 1 AS position FROM matches), c AS (SELECT count(*) AS n FROM matches)"


@query("i1_chronological_split", _POS + " SELECT match_id, position, CASE WHEN position < CAST(floor(n * (1 - 0.20 - 0.15)) AS BIGINT) THEN 'train' WHEN position < CAST(floor(n * (1 - 0.15)) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM pos, c")
def i1(v: Views) -> DataFrame:
    return I.chronological_split(v.matches()).select("match_id", "position", "split")


@query("i2_rolling_windows", _POS + """, e AS (SELECT CAST(floor(n * 0.6) AS BIGINT) AS s, (n - CAST(floor(n * 0.6) AS BIGINT)) // 5 AS z, n FROM c), w AS (SELECT unnest(range(0, 5)) AS win)
SELECT match_id, CAST(win AS INT) AS win, CASE WHEN position < s + win * z THEN 'train' ELSE 'test' END AS part FROM pos, e, w WHERE position < CASE WHEN win = 4 THEN n ELSE s + (win + 1) * z END""")
def i2(v: Views) -> DataFrame:
    return I.rolling_windows(v.matches()).select("match_id", F.col("window").alias("win"), "part")


@query("i3_year_folds", with_views("matches") + " SELECT fold, CAST(count(*) FILTER (year(date) < fold) AS BIGINT) AS n_train, CAST(count(*) FILTER (year(date) >= fold) AS BIGINT) AS n_test FROM matches, (SELECT CAST(unnest(range(1994, 2003)) AS INT) AS fold) WHERE year(date) < fold + 2 GROUP BY fold HAVING n_train >= 100 AND n_test >= 10")
def i3(v: Views) -> DataFrame:
    return I.year_folds(v.matches(), [*range(1994, 2003)])


@query("i4_event_cutoff_split", with_views("matches") + " SELECT * FROM (SELECT match_id, CASE WHEN competition = '1-URGENT' AND year(date) = 1998 THEN 'test' WHEN date < DATE '1998-01-01' THEN 'train' END AS split FROM matches) WHERE split IS NOT NULL")
def i4(v: Views) -> DataFrame:
    return I.event_cutoff_split(v.matches(), "1-URGENT", 1998, "1998-01-01").select("match_id", "split")


@query("i5_min_year", with_views("matches", "attrs") + " SELECT match_id FROM matches JOIN attrs ON name = competition WHERE year(date) >= 1997 AND weight >= 3")
def i5(v: Views) -> DataFrame:
    return I.min_year(B.competition_attrs(v.matches(), v.attrs()), 1997, 3).select("match_id")


@query("i6_split_leak_check", _POS + ", s AS (SELECT date, CASE WHEN position < floor(n * (1 - 0.20 - 0.15)) THEN 'train' WHEN position < floor(n * (1 - 0.15)) THEN 'val' END AS split FROM pos, c) SELECT max(date) FILTER (split = 'train') AS last_train, min(date) FILTER (split = 'val') AS first_val, max(date) FILTER (split = 'train') <= min(date) FILTER (split = 'val') AS ok FROM s", dates=("last_train", "first_val"))
def i6(v: Views) -> DataFrame:
    return I.split_leak_check(I.chronological_split(v.matches()))


# --- J: scoring ----------------------------------------------------------------------------------

_RATES = with_views("matches") + f""", {ATTACKED}, {PARAMS}, la AS (SELECT match_id, neutral, competition, date, home_score, away_score,
  greatest(0.5, least(4.0, greatest(0.1, base_home) * (greatest(0.1, home_attack) / greatest(0.1, mean_attack)) * (greatest(0.1, away_defense) / greatest(0.1, mean_defense)) * CASE WHEN neutral THEN 1.0 ELSE home_factor END)) AS lh,
  greatest(0.5, least(4.0, greatest(0.1, base_away) * (greatest(0.1, away_attack) / greatest(0.1, mean_attack)) * (greatest(0.1, home_defense) / greatest(0.1, mean_defense)))) AS ra FROM att, params)"""
_GRID = ", gr AS (SELECT match_id, h, a, exp(-lh) * pow(lh, h) / factorial(h) * (exp(-ra) * pow(ra, a) / factorial(a)) AS p FROM la, (SELECT CAST(unnest(range(0, {0})) AS INT) AS h), (SELECT CAST(unnest(range(0, {0})) AS INT) AS a))"
_OUT = _RATES + _GRID.format(11) + ", oc AS (SELECT match_id, sum(p) FILTER (h > a) / sum(p) AS p_h, sum(p) FILTER (h = a) / sum(p) AS p_d, sum(p) FILTER (h < a) / sum(p) AS p_a FROM gr GROUP BY match_id)"


def with_rates(v: Views) -> DataFrame:
    rows = attacked(v)
    return J.goal_rates(rows, score_model_params(rows))


@query("j1_goal_rates", _RATES + " SELECT match_id, round(lh, 6) AS lambda_home, round(ra, 6) AS lambda_away FROM la")
def j1(v: Views) -> DataFrame:
    return with_rates(v).select("match_id", *r6("lambda_home", "lambda_away"))


@query("j2_scoreline_grid", _RATES + _GRID.format(6) + " SELECT match_id, CAST(place AS INT) AS place, h, a, round(p, 6) AS p FROM (SELECT match_id, h, a, p, row_number() OVER (PARTITION BY match_id ORDER BY p DESC, h, a) AS place FROM gr) WHERE place <= 3")
def j2(v: Views) -> DataFrame:
    return J.scoreline_grid(with_rates(v)).select("match_id", "place", "h", "a", "p")


@query("j3_outcome_from_rates", _OUT + " SELECT match_id, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d, round(p_a, 6) AS p_a FROM oc")
def j3(v: Views) -> DataFrame:
    return J.outcome_from_rates(with_rates(v)).select("match_id", *r6("p_h", "p_d", "p_a"))


_PAIRS = with_views("pairs") + ", pp AS (SELECT home, away, wh / (wh + wd + wa) AS p_h, wd / (wh + wd + wa) AS p_d, wa / (wh + wd + wa) AS p_a FROM pairs)"
_LATTICE = """, ax AS (SELECT 0.5 + CAST(0.05 AS DOUBLE) * unnest(range(0, 41)) AS x), lt AS (SELECT a.x AS lh, b.x AS ra FROM ax a, ax b),
lg AS (SELECT lh, ra, h, a, exp(-lh) * pow(lh, h) / factorial(h) * (exp(-ra) * pow(ra, a) / factorial(a)) AS p FROM lt, (SELECT CAST(unnest(range(0, 11)) AS INT) AS h), (SELECT CAST(unnest(range(0, 11)) AS INT) AS a)),
lo AS (SELECT lh, ra, sum(p) FILTER (h > a) / sum(p) AS h, sum(p) FILTER (h = a) / sum(p) AS d, sum(p) FILTER (h < a) / sum(p) AS a FROM lg GROUP BY lh, ra)"""


@query("j4_rates_for_outcome", _PAIRS + _LATTICE + ", ls AS (SELECT home || '-' || away AS match_id, lh, ra, round(pow(h - p_h, 2) + pow(d - p_d, 2) + pow(a - p_a, 2), 12) AS loss FROM pp, lo) SELECT match_id, round(lh, 2) AS lambda_home, round(ra, 2) AS lambda_away, round(loss, 9) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY loss, lh, ra) AS rn FROM ls) WHERE rn = 1")
def j4(v: Views) -> DataFrame:
    targets = v.pair_probabilities().withColumn("match_id", F.concat_ws("-", "home", "away"))
    best = J.rates_for_outcome(targets)
    back = J.outcome_from_rates(best).select("match_id", "lambda_home", "lambda_away", F.col("p_h").alias("h"), F.col("p_d").alias("d"), F.col("p_a").alias("a")).join(targets, "match_id")
    loss = F.round(sum((F.pow(F.col(c) - F.col(f"p_{c}"), 2) for c in "hda"), F.lit(0.0)), 9).alias("loss")
    return back.select("match_id", F.round("lambda_home", 2).alias("lambda_home"), F.round("lambda_away", 2).alias("lambda_away"), loss)


@query("j5_select_scoreline", with_views("matches") + """, s AS (SELECT match_id, 1 + match_id % 5 AS wh, 1 + match_id % 3 AS wd, 1 + match_id % 4 AS wa, [{'h': CAST(match_id % 8 AS INT), 'a': CAST(match_id % 3 AS INT)}, {'h': home_score, 'a': away_score}, {'h': CAST(1 AS INT), 'a': CAST(1 AS INT)}] AS l FROM matches),
o AS (SELECT *, CASE WHEN wh >= wd AND wh >= wa THEN 1 WHEN wa >= wd THEN -1 ELSE 0 END AS o FROM s), f AS (SELECT *, list_filter(l, lambda x: sign(x.h - x.a) = o AND x.h + x.a <= 6)[1] AS x FROM o)
SELECT match_id, coalesce(x.h, 2) AS h, coalesce(x.a, 1) AS a FROM f""")
def j5(v: Views) -> DataFrame:
    k = F.col("match_id")
    line = lambda h, a: F.struct(h.cast("int").alias("h"), a.cast("int").alias("a"))
    total = 3 + k % 5 + k % 3 + k % 4
    m = v.matches().select("match_id", ((1 + k % 5) / total).alias("p_h"), ((1 + k % 3) / total).alias("p_d"), ((1 + k % 4) / total).alias("p_a"), F.array(line(k % 8, k % 3), line(F.col("home_score"), F.col("away_score")), line(F.lit(1), F.lit(1))).alias("scorelines"), F.lit(1.8).alias("lambda_home"), F.lit(1.2).alias("lambda_away"))
    return J.select_scoreline(m).select("match_id", "h", "a")


_SYM = _PAIRS + ", sy AS (SELECT x.home, x.away, (x.p_h + y.p_a) / 2 AS p_h, (x.p_d + y.p_d) / 2 AS p_d, (x.p_a + y.p_h) / 2 AS p_a FROM pp x JOIN pp y ON x.home = y.away AND x.away = y.home)"


@query("j6_neutral_symmetrize", _SYM + " SELECT home, away, round(p_h, 6) AS p_h, round(p_d, 6) AS p_d, round(p_a, 6) AS p_a FROM sy")
def j6(v: Views) -> DataFrame:
    return J.neutral_symmetrize(v.pair_probabilities()).select("home", "away", *r6("p_h", "p_d", "p_a"))


@query("j7_compress_to_uniform", _PAIRS + ", q AS (SELECT *, home < away AS c FROM pp) SELECT home, away, " + ", ".join(f"round(CASE WHEN c THEN 0.8 * p_{x} + 0.2 / 3 ELSE p_{x} END, 6) AS p_{x}" for x in "hda") + " FROM q")
def j7(v: Views) -> DataFrame:
    return J.compress_to_uniform(v.pair_probabilities(), 0.20, F.col("home") < F.col("away")).select("home", "away", *r6("p_h", "p_d", "p_a"))


@query("j8_blend_models", with_views("predictions") + """, w(model, wh, wd, wa) AS (VALUES ('model1', 0.5, 0.2, 0.4), ('model2', 0.3, 0.3, 0.3), ('model3', 0.2, 0.5, 0.3)),
b AS (SELECT match_id, CAST(sum(p_h * wh) / sum(wh) AS DOUBLE) AS h, CAST(sum(p_d * wd) / sum(wd) AS DOUBLE) AS d, CAST(sum(p_a * wa) / sum(wa) AS DOUBLE) AS a FROM predictions JOIN w USING (model) GROUP BY match_id),
x AS (SELECT *, CASE WHEN match_id % 2 = 0 THEN 0.7 * d + 0.3 * 0.25 ELSE d END AS e FROM b) SELECT match_id, round((1 - e) * h / (h + a), 6) AS p_h, round(e, 6) AS p_d, round((1 - e) * a / (h + a), 6) AS p_a FROM x""")
def j8(v: Views) -> DataFrame:
    weights = v.spark.createDataFrame([("model1", 0.5, 0.2, 0.4), ("model2", 0.3, 0.3, 0.3), ("model3", 0.2, 0.5, 0.3)], "model string, w_h double, w_d double, w_a double")
    draw = v.matches().where("match_id % 2 = 0").select("match_id", F.lit(0.25).alias("p_draw"))
    return J.blend_models(v.predictions().select("match_id", "model", "p_h", "p_d", "p_a"), weights, draw, 0.3).select("match_id", *r6("p_h", "p_d", "p_a"))


@query("j9_blend_interval", with_views("predictions") + ", w(model, weight) AS (VALUES ('model1', CAST(0.6 AS DOUBLE)), ('model2', 0.3), ('model3', 0.1)), s AS (SELECT match_id, " + ", ".join(f"sum(weight * p_{c}) / sum(weight) AS m{c}, sum(weight * p_{c} * p_{c}) / sum(weight) AS q{c}" for c in "hda") + " FROM predictions JOIN w USING (model) WHERE weight >= 0.15 GROUP BY match_id) SELECT match_id, " + ", ".join(f"round(m{c}, 6) AS p_{c}, round(greatest(0.0, m{c} - sqrt(greatest(0.0, round(q{c} - m{c} * m{c}, 12)))), 5) AS low_{c}, round(least(1.0, m{c} + sqrt(greatest(0.0, round(q{c} - m{c} * m{c}, 12)))), 5) AS high_{c}" for c in "hda") + " FROM s")
def j9(v: Views) -> DataFrame:
    weights = v.spark.createDataFrame([("model1", 0.6), ("model2", 0.3), ("model3", 0.1)], "model string, weight double")
    return J.blend_interval(v.predictions().join(weights, "model"))


# the isotonic value at a point: the greatest, over what starts no later, of the least mean of any stretch from there that ends no earlier
_ISO = with_views("predictions") + """, pt AS (SELECT model, c, x, CAST(sum(y) AS DOUBLE) AS s, count(*) AS n FROM (SELECT model, 'a' AS c, p_a AS x, CAST(y = 0 AS INT) AS y FROM predictions WHERE win = 0 UNION ALL SELECT model, 'd', p_d, CAST(y = 1 AS INT) FROM predictions WHERE win = 0 UNION ALL SELECT model, 'h', p_h, CAST(y = 2 AS INT) FROM predictions WHERE win = 0) GROUP BY ALL),
cu AS (SELECT model, c, x, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn, s, n FROM pt WINDOW w AS (PARTITION BY model, c ORDER BY x)),
st AS (SELECT a.model, a.c, a.i, b.i AS j, (b.cs - a.cs + a.s) / (b.cn - a.cn + a.n) AS m FROM cu a JOIN cu b ON a.model = b.model AND a.c = b.c AND a.i <= b.i),
lw AS (SELECT model, c, i, j, min(m) OVER (PARTITION BY model, c, i ORDER BY j DESC) AS low FROM st),
ft AS (SELECT l.model, l.c, x, max(low) AS f FROM lw l JOIN cu ON cu.model = l.model AND cu.c = l.c AND cu.i = l.j GROUP BY ALL),
q AS (SELECT DISTINCT model, c, x FROM (SELECT model, 'a' AS c, p_a AS x FROM predictions UNION ALL SELECT model, 'd', p_d FROM predictions UNION ALL SELECT model, 'h', p_h FROM predictions)),
e AS (SELECT q.model, q.c, q.x, arg_max(ft.x, ft.x) FILTER (ft.x <= q.x) AS x0, arg_max(f, ft.x) FILTER (ft.x <= q.x) AS f0, arg_min(ft.x, ft.x) FILTER (ft.x >= q.x) AS x1, arg_min(f, ft.x) FILTER (ft.x >= q.x) AS f1 FROM q JOIN ft ON ft.model = q.model AND ft.c = q.c GROUP BY ALL),
v AS (SELECT model, c, x, greatest(1e-6, least(1 - 1e-6, CASE WHEN f0 IS NULL THEN f1 WHEN f1 IS NULL OR x0 = x1 THEN f0 ELSE f0 + (f1 - f0) * (x - x0) / (x1 - x0) END)) AS p FROM e)
SELECT match_id, model, round(a.p / (a.p + d.p + h.p), 6) AS p_a, round(d.p / (a.p + d.p + h.p), 6) AS p_d, round(h.p / (a.p + d.p + h.p), 6) AS p_h FROM predictions r
JOIN v a USING (model) JOIN v d USING (model) JOIN v h USING (model) WHERE a.c = 'a' AND a.x = p_a AND d.c = 'd' AND d.x = p_d AND h.c = 'h' AND h.x = p_h"""


@query("j10_calibrate_isotonic", _ISO)
def j10(v: Views) -> DataFrame:
    p = v.predictions()
    return J.calibrate_isotonic(p.where("win = 0"), p, by="model").select("match_id", "model", *r6("p_a", "p_d", "p_h"))


NUMERIC = ["home_fifa_rank", "away_fifa_rank", "rank_diff"]


def ranked(v: Views, matches: DataFrame | None = None) -> DataFrame:
    return I.chronological_split(labelled(v, matches).withColumn("rank_diff", F.col("home_fifa_rank") - F.col("away_fifa_rank"))).withColumn("label", F.when(F.col("target") == "A", 0.0).when(F.col("target") == "D", 1.0).otherwise(2.0))


_SPLIT = _POS + ", sp AS (SELECT *, home_fifa_rank - away_fifa_rank AS rank_diff, CASE WHEN position < floor(n * (1 - 0.20 - 0.15)) THEN 'train' WHEN position < floor(n * (1 - 0.15)) THEN 'val' ELSE 'test' END AS split FROM pos, c)"


@query("j11_encode_features", _SPLIT + ", st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC) + " FROM sp WHERE split = 'train') SELECT match_id, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUMERIC) + ", competition = '1-URGENT' AS is_urgent FROM sp, st")
def j11(v: Views) -> DataFrame:
    rows = ranked(v)
    train = rows.where("split = 'train'")
    encoded = J.encode_features(train, ["competition"], NUMERIC).transform(J.scaled(train, rows, NUMERIC))
    x = vector_to_array("features")
    return encoded.select("match_id", *r6(*NUMERIC), (x[0] == 1.0).alias("is_urgent"))


RATINGS_ONLY = ["home_elo_pre", "away_elo_pre", "elo_diff", "elo_win_prob"]


def variants(v: Views, *names: str) -> tuple[DataFrame, dict]:
    """(rows with a split, encoded for each variant; name: model) for the named variants only: all features, ratings only, and draws against the rest, by stage weight and class balance. Matches and encoded rows are written once: a fit passes over its rows several times."""
    matches = written(v.matches(), "matches")
    rows = ranked(v, matches).join(R.elo_replay(B.competition_attrs(matches, v.attrs()), CONFIG, v.start()).select("match_id", "home_elo_pre", "away_elo_pre"), "match_id")
    rows = rows.withColumns({"elo_diff": F.col("home_elo_pre") - F.col("away_elo_pre"), "elo_win_prob": R.elo_win_prob(F.col("home_elo_pre"), F.col("away_elo_pre"), F.col("neutral")), "stage_weight": F.when(F.col("neutral"), 0.5).otherwise(1.0), "draw": (F.col("target") == "D").cast("double")})
    rows = written(rows.select("match_id", "split", "label", "draw", "stage_weight", "competition", *NUMERIC, *RATINGS_ONLY), "ranked")
    train = rows.where("split = 'train'")
    scaled = J.scaled(train, rows, [*NUMERIC, *RATINGS_ONLY])
    encoded = J.encode_features(train, ["competition"], NUMERIC).transform(scaled)
    encoded = VectorAssembler(inputCols=RATINGS_ONLY, outputCol="ratings").transform(encoded)
    encoded = written(encoded.select("match_id", "split", "label", "draw", "stage_weight", "features", "ratings"), "encoded")
    kinds = {"all": ("label", "features", False), "ratings": ("label", "ratings", False), "draw": ("draw", "features", True)}
    models = {}
    for name in names:
        label, features, binary = kinds[name]
        fitted = J.balanced(encoded.where("split = 'train'"), label, "stage_weight").select(label, features, "sample_weight")
        models[name] = J.train_logreg(fitted, label, "sample_weight", features=features, binary=binary)
    return encoded, models


@query("j12_train_logreg")
def j12(v: Views) -> DataFrame:
    rows, models = variants(v, "all", "ratings", "draw")
    test = rows.where("split = 'test'")
    out = [H.basic_metrics(J.predict_batch(models[name], test).withColumns({"y": F.col("label").cast("int"), "variant": F.lit(name)}), ["variant"]) for name in ("all", "ratings")]
    draw = J.predict_batch(models["draw"], test, classes=["rest", "draw"]).select(F.col("draw").cast("int").alias("y"), "p_draw", F.lit("draw").alias("variant"))
    p = F.greatest(F.lit(1e-10), F.least(F.lit(1 - 1e-10), F.col("p_draw")))
    one = draw.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p_draw") > 0.5).cast("int") == F.col("y")).cast("int")), 6).alias("accuracy"), F.round(-F.avg(F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col("p_draw") - F.col("y"), 2) * 2), 6).alias("brier"))
    return out[0].unionByName(out[1]).unionByName(one)


@query("j13_predict_batch")
def j13(v: Views) -> DataFrame:
    rows, models = variants(v, "all")
    return J.predict_batch(models["all"], rows).select("match_id", *(F.round(f"p_{c}", 4).alias(f"p_{c}") for c in "adh"))


NEWTON_STEPS = 4


def newton_sql(name: str, classes: int, label: str, weight: str) -> str:
    """Views {name}_b{i}: the weights after i Newton steps on one feature, rank_diff standardised; the system of each step is solved by elimination, a view for each pivot."""
    free, n = classes - 1, 2 * (classes - 1)
    at = [(c, j) for c in range(1, classes) for j in (0, 1)]
    x = ("1.0", "x")
    out = [f"{name}_d AS (SELECT (rank_diff - m) / s AS x, {label} AS k, {weight} AS w FROM sp JOIN wt USING (target), st WHERE split = 'train')", f"{name}_b0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(n)) + ")"]
    for t in range(NEWTON_STEPS):
        e = [f"exp(b{2 * c} + b{2 * c + 1} * x)" for c in range(free)]
        out.append(f"{name}_p{t} AS (SELECT x, k, w, " + ", ".join(f"{e[c]} / (1 + {' + '.join(e)}) AS p{c + 1}" for c in range(free)) + f" FROM {name}_d, {name}_b{t})")
        cells = [f"sum(w * p{c} * ({int(c == d)} - p{d}) * {x[i]} * {x[j]}) / sum(w) + {0.001 if (c, i) == (d, j) and i else 0.0} AS a{r}_{s}" for r, (c, i) in enumerate(at) for s, (d, j) in enumerate(at)]
        right = [f"sum(w * (p{c} - CAST(k = {c} AS INT)) * {x[i]}) / sum(w) AS g{r}" for r, (c, i) in enumerate(at)]
        out.append(f"{name}_s{t} AS (SELECT {', '.join(cells + right)} FROM {name}_p{t})")
        out.append(f"{name}_e{t}_0 AS (SELECT " + ", ".join([f"a{r}_{s}" for r in range(n) for s in range(n)] + [f"g{r} + {0.001 if at[r][1] else 0.0} * b{r} AS a{r}_{n}" for r in range(n)] + [f"b{r}" for r in range(n)]) + f" FROM {name}_s{t}, {name}_b{t})")
        for v in range(n):
            cell = lambda r, s: f"a{v}_{s} / a{v}_{v}" if r == v else f"a{r}_{s} - a{r}_{v} * a{v}_{s} / a{v}_{v}"  # noqa: B023, E731
            out.append(f"{name}_e{t}_{v + 1} AS (SELECT " + ", ".join([f"{cell(r, s)} AS a{r}_{s}" for r in range(n) for s in range(n + 1)] + [f"b{r}" for r in range(n)]) + f" FROM {name}_e{t}_{v})")
        out.append(f"{name}_b{t + 1} AS (SELECT " + ", ".join(f"b{r} - a{r}_{n} AS b{r}" for r in range(n)) + f" FROM {name}_e{t}_{n})")
    return ",\n".join(out)


_VARIANTS = {
    "all": (3, "CASE target WHEN 'A' THEN 0 WHEN 'D' THEN 1 ELSE 2 END", "1.0"),
    "balanced": (3, "CASE target WHEN 'A' THEN 0 WHEN 'D' THEN 1 ELSE 2 END", "wt.w"),
    "draw": (2, "CASE target WHEN 'D' THEN 1 ELSE 0 END", "1.0"),
}
_NEWTON = _SPLIT.replace(", sp AS (SELECT *,", ", sp AS (SELECT *, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS target,") + """, st AS (SELECT avg(rank_diff) AS m, stddev_pop(rank_diff) AS s FROM sp WHERE split = 'train'),
wt AS (SELECT target, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS w FROM sp WHERE split = 'train' GROUP BY target),
""" + ",\n".join(newton_sql(name, *v) for name, v in _VARIANTS.items())


def newton(v: Views) -> tuple[DataFrame, dict[str, DataFrame]]:
    """All rows with rank_diff standardised, and the weights of each variant."""
    rows = ranked(v)
    rows = J.scaled(rows.where("split = 'train'"), rows, ["rank_diff"]).withColumn("draw", (F.col("target") == "D").cast("int"))
    train = written(J.balanced(rows.where("split = 'train'"), "target").select("rank_diff", "label", "draw", "sample_weight"), "train")
    each = {"all": ("label", 3, None), "balanced": ("label", 3, "sample_weight"), "draw": ("draw", 2, None)}
    return rows, {name: J.train_newton(train, ["rank_diff"], label, k, weight, steps=NEWTON_STEPS) for name, (label, k, weight) in each.items()}


@query("j12_newton_weights", _NEWTON + " " + " UNION ALL ".join(f"SELECT '{name}' AS variant, CAST({c} AS INT) AS class_no, '{f}' AS feature, round(b{2 * (c - 1) + j}, 6) AS weight FROM {name}_b{NEWTON_STEPS}" for name, (k, _, _) in _VARIANTS.items() for c in range(1, k) for j, f in enumerate(("", "rank_diff"))))
def j12n(v: Views) -> DataFrame:
    _, weights = newton(v)
    return functools.reduce(DataFrame.unionByName, (w.select(F.lit(name).alias("variant"), "class_no", "feature", F.round("weight", 6).alias("weight")) for name, w in weights.items()))


@query("j13_newton_predict", _NEWTON + f""" SELECT match_id, round(1 / (1 + e1 + e2), 5) AS p_a, round(e1 / (1 + e1 + e2), 5) AS p_d, round(e2 / (1 + e1 + e2), 5) AS p_h FROM (SELECT match_id, exp(b0 + b1 * (rank_diff - m) / s) AS e1, exp(b2 + b3 * (rank_diff - m) / s) AS e2 FROM sp, st, balanced_b{NEWTON_STEPS})""")
def j13n(v: Views) -> DataFrame:
    rows, weights = newton(v)
    return J.predict_newton(weights["balanced"], rows, ["rank_diff"]).select("match_id", *(F.round(f"p_{c}", 5).alias(f"p_{c}") for c in "adh"))


@query("j14_explain_row", _OUT + " SELECT match_id, round(home_fifa_rank - away_fifa_rank, 0) AS rank_diff, round(p_h, 4) AS p_h, round(p_d, 4) AS p_d, round(p_a, 4) AS p_a FROM oc JOIN matches USING (match_id)")
def j14(v: Views) -> DataFrame:
    m = J.outcome_from_rates(with_rates(v)).withColumn("rank_diff", F.col("home_fifa_rank") - F.col("away_fifa_rank"))
    return J.explain_row(m)


# --- K: standings --------------------------------------------------------------------------------

_GRP = with_views("matches") + """, gt AS (SELECT confederation || '-' || y AS grp, team, CAST(id AS INT) AS seed_pos, rank FROM team, (SELECT DISTINCT year(date) AS y FROM matches)),
fin AS (SELECT home_confederation || '-' || year(date) AS grp, home_team, away_team, home_score, away_score FROM matches WHERE home_confederation = away_confederation),
lo AS (SELECT grp, home_team AS team, home_score AS gf, away_score AS ga FROM fin UNION ALL SELECT grp, away_team, away_score, home_score FROM fin),
su AS (SELECT grp, team, count(*) AS played, count(*) FILTER (gf > ga) AS won, count(*) FILTER (gf = ga) AS drawn, count(*) FILTER (gf < ga) AS lost, CAST(sum(gf) AS BIGINT) AS gf, CAST(sum(ga) AS BIGINT) AS ga, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS pts FROM lo GROUP BY 1, 2),
lt AS (SELECT gt.grp, gt.team, seed_pos, rank, coalesce(played, 0) AS played, coalesce(won, 0) AS won, coalesce(drawn, 0) AS drawn, coalesce(lost, 0) AS lost, coalesce(gf, 0) AS gf, coalesce(ga, 0) AS ga, coalesce(pts, 0) AS pts, coalesce(gf, 0) - coalesce(ga, 0) AS gd FROM gt LEFT JOIN su ON su.grp = gt.grp AND su.team = gt.team),
rs AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pts DESC, gd DESC, gf DESC, seed_pos) AS position FROM lt)"""


def table_of(v: Views) -> DataFrame:
    """A table for each confederation and year."""
    m = v.matches().withColumn("y", F.year("date"))
    years = F.broadcast(m.select("y").distinct())  # a row for each year
    groups = v.team().crossJoin(years).select(F.concat_ws("-", "confederation", "y").alias("grp"), "team", F.col("id").cast("int").alias("seed_pos"), "rank")
    finished = m.where("home_confederation = away_confederation").select(F.concat_ws("-", "home_confederation", "y").alias("grp"), "home_team", "away_team", "home_score", "away_score")
    return K.league_table(groups, finished)


@query("k1_league_table", _GRP + " SELECT grp, team, played, won, drawn, lost, gf, ga, gd, pts FROM lt")
def k1(v: Views) -> DataFrame:
    return table_of(v).select("grp", "team", "played", "won", "drawn", "lost", "gf", "ga", "gd", "pts")


@query("k2_rank_standings", _GRP + " SELECT grp, team, CAST(position AS INT) AS position, CASE WHEN position <= 2 THEN 'ADV' WHEN position = 3 THEN '3RD?' ELSE 'OUT' END AS zone FROM rs")
def k2(v: Views) -> DataFrame:
    return K.rank_standings(table_of(v)).select("grp", "team", "position", "zone")


@query("k3_expected_points", _SYM + ", na AS (SELECT n_name, r_name, CAST(n_nationkey AS INT) AS rank FROM nation JOIN region ON n_regionkey = r_regionkey), ex AS (SELECT x.r_name AS grp, x.n_name AS team, x.rank, round(sum(3 * p_h + p_d), 6) AS exp_points FROM na x JOIN na y ON x.r_name = y.r_name AND x.n_name <> y.n_name JOIN sy ON home = x.n_name AND away = y.n_name GROUP BY 1, 2, 3) SELECT grp, team, exp_points, CAST(row_number() OVER (PARTITION BY grp ORDER BY exp_points DESC, rank, team) AS INT) AS place FROM ex")
def k3(v: Views) -> DataFrame:
    nations = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("grp"), F.col("n_name").alias("team"), F.col("n_nationkey").cast("int").alias("rank"))
    return K.expected_points(nations, J.neutral_symmetrize(v.pair_probabilities()))


@query("k4_best_third", _GRP + " SELECT grp, team, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (ORDER BY pts DESC, gd DESC, gf DESC, rank, team) AS place FROM rs WHERE position = 3) WHERE place <= 8")
def k4(v: Views) -> DataFrame:
    return K.best_third(K.rank_standings(table_of(v)), 8).select("grp", "team", "place")


@query("k5_assign_third_slots", with_views("outcomes") + ", th AS (SELECT o_orderkey // 4 AS scenario_id, ['A', 'B', 'C', 'D'][CAST(o_orderkey % 4 + 1 AS INT)] AS grp, 'T' || (o_custkey % n) AS team FROM orders, t), ok AS (SELECT scenario_id FROM th GROUP BY 1 HAVING count(*) = 4) SELECT scenario_id, CAST(74 + instr('CADB', grp) AS INT) AS slot, grp, team FROM th JOIN ok USING (scenario_id)")
def k5(v: Views) -> DataFrame:
    o = F.col("o_orderkey")
    thirds = v.with_n(v.table("orders")).select(F.expr("o_orderkey div 4").alias("scenario_id"), F.element_at(F.array(*map(F.lit, "ABCD")), (o % 4 + 1).cast("int")).alias("grp"), F.concat(F.lit("T"), F.col("o_custkey") % F.col("n")).alias("team"))
    whole = thirds.groupBy("scenario_id").count().where("count = 4").drop("count")
    lookup = v.spark.createDataFrame([("ABCD", {75: "C", 76: "A", 77: "D", 78: "B"})], "groups string, slots map<int,string>")
    return K.assign_third_slots(thirds.join(whole, "scenario_id"), lookup)


# Fifty teams, two of each nation; every customer is a scenario of 32 of them, over five rounds and a match for third place.
_BR = """WITH team AS (SELECT CAST(2 * n_nationkey + x AS INT) AS i, n_name || '-' || x AS team FROM nation, (VALUES (0), (1)) v(x)),
w AS (SELECT a.team AS home, b.team AS away, 1 + (a.i * 3 + b.i) % 7 AS wh, 1 + (a.i + b.i * 5) % 4 AS wd, 1 + (a.i * 2 + b.i * 3) % 6 AS wa FROM team a JOIN team b ON a.i <> b.i),
pr AS (SELECT home, away, wh / (wh + wd + wa) AS h, wd / (wh + wd + wa) AS d, wa / (wh + wd + wa) AS a FROM w),
pp AS (SELECT x.home AS team1, x.away AS team2, round((x.h + y.a) / 2 + (x.d + y.d) / 2 / 2, 12) AS p FROM pr x JOIN pr y ON x.home = y.away AND x.away = y.home),
f1 AS (SELECT c_custkey AS scenario_id, CAST(s AS INT) AS slot, a.team AS team1, b.team AS team2 FROM customer, range(0, 16) r(s) JOIN team a ON a.i = (c_custkey * 7 + 2 * s) % 50 JOIN team b ON b.i = (c_custkey * 7 + 2 * s + 1) % 50),
w1 AS (SELECT *, CASE WHEN p >= 0.5 THEN team1 ELSE team2 END AS winner, CASE WHEN p >= 0.5 THEN team2 ELSE team1 END AS loser FROM f1 JOIN pp USING (team1, team2))""" + "".join(f""",
f{r} AS (SELECT a.scenario_id, CAST({base} + (a.slot - {before}) // 2 AS INT) AS slot, a.winner AS team1, b.winner AS team2 FROM w{r - 1} a JOIN w{r - 1} b ON a.scenario_id = b.scenario_id AND (a.slot - {before}) % 2 = 0 AND b.slot = a.slot + 1{" UNION ALL SELECT a.scenario_id, 31, a.loser, b.loser FROM w4 a JOIN w4 b ON a.scenario_id = b.scenario_id AND a.slot = 28 AND b.slot = 29" if r == 5 else ""}),
w{r} AS (SELECT *, CASE WHEN p >= 0.5 THEN team1 ELSE team2 END AS winner, CASE WHEN p >= 0.5 THEN team2 ELSE team1 END AS loser FROM f{r} JOIN pp USING (team1, team2))""" for r, before, base in ((2, 0, 16), (3, 16, 24), (4, 24, 28), (5, 28, 30)))


@query("k6_propagate_bracket", _BR + " " + " UNION ALL ".join(f"SELECT scenario_id, slot, CAST({r} AS INT) AS round, team1, team2, round(p, 4) AS p1, winner FROM w{r}" for r in range(1, 6)))
def k6(v: Views) -> DataFrame:
    team = v.table("nation").select("n_name", F.explode(F.array(F.lit(0), F.lit(1))).alias("x"), "n_nationkey").select((2 * F.col("n_nationkey") + F.col("x")).cast("int").alias("i"), F.concat_ws("-", "n_name", "x").alias("team"))
    x, y = team.select(F.col("i").alias("_i"), F.col("team").alias("home")), team.select(F.col("i").alias("_j"), F.col("team").alias("away"))
    i, j = F.col("_i"), F.col("_j")
    pairs = x.join(y, i != j).withColumns({"wh": 1 + (i * 3 + j) % 7, "wd": 1 + (i + j * 5) % 4, "wa": 1 + (i * 2 + j * 3) % 6})
    pairs = pairs.select("home", "away", *((F.col(f"w{c}") / (F.col("wh") + F.col("wd") + F.col("wa"))).alias(f"p_{c}") for c in "hda"))
    slots = v.table("customer").select(F.col("c_custkey").alias("scenario_id"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot"))
    at = lambda k: (F.col("scenario_id") * 7 + 2 * F.col("slot") + k) % 50
    first = slots.join(F.broadcast(x.withColumnRenamed("home", "team1")), i == at(0)).join(F.broadcast(y.withColumnRenamed("away", "team2")), j == at(1)).drop("_i", "_j")  # two teams of each nation
    rounds = [(16 + k, 2 * k, 2 * k + 1, 2, False) for k in range(8)] + [(24 + k, 16 + 2 * k, 17 + 2 * k, 3, False) for k in range(4)] + [(28 + k, 24 + 2 * k, 25 + 2 * k, 4, False) for k in range(2)] + [(30, 28, 29, 5, False), (31, 28, 29, 5, True)]
    feeds = v.spark.createDataFrame(rounds, "slot int, from1 int, from2 int, round int, losers boolean")
    return K.propagate_bracket(first, feeds, K.knockout_probabilities(pairs))


@query("k7_top_contenders", _TALLY + """, sh AS (SELECT team, confederation AS grp, champion, champion + final AS reach_final, "group" AS group_exit FROM tally JOIN (SELECT s_suppkey, 'T' || s_suppkey AS team, r_name AS confederation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) USING (team)),
top AS (SELECT * FROM sh ORDER BY champion DESC, team LIMIT 12), rk AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY champion DESC, team) AS r FROM sh),
bg AS (SELECT grp FROM (SELECT grp, round(sum(champion), 6) AS s FROM rk WHERE r <= 2 GROUP BY grp) ORDER BY s DESC, grp LIMIT 1)
SELECT 'champion' AS kind, CAST(row_number() OVER (ORDER BY champion DESC, team) AS INT) AS place, team FROM top
UNION ALL SELECT 'upset', 1, team FROM (SELECT * FROM top WHERE group_exit > 0.001 ORDER BY group_exit DESC, team LIMIT 1)
UNION ALL SELECT 'final', CAST(row_number() OVER (ORDER BY reach_final DESC, team) AS INT), team FROM (SELECT * FROM sh ORDER BY reach_final DESC, team LIMIT 2)
UNION ALL SELECT 'group', CAST(r AS INT), team FROM rk JOIN bg USING (grp) WHERE r <= 2""")
def k7(v: Views) -> DataFrame:
    shares = stage_tally(v.outcomes()).join(v.team().select("team", F.col("confederation").alias("grp")), "team")
    return K.top_contenders(shares.select("team", "grp", "champion", (F.col("champion") + F.col("final")).alias("reach_final"), F.col("group").alias("group_exit")), exit_above=0.001)


@query("k8_list_entities", with_views("team") + " SELECT team, confederation, CASE WHEN id % 6 <> 0 THEN rank END AS rank FROM team WHERE lower(confederation) = 'asia' AND contains(lower(team), 't')")
def k8(v: Views) -> DataFrame:
    t = v.team().withColumn("rank", F.when(F.col("id") % 6 != 0, F.col("rank")))
    return K.list_entities(t, ["EUROPE", "ASIA"], confederation="Asia", contains="T").select("team", "confederation", "rank")


@query("k9_knockout_by_stage", with_views("matches") + ", k AS (SELECT CAST(year(date) AS INT) AS year, tournament_stage AS stage, CASE WHEN match_id % 5 = 0 THEN 'TBD' ELSE home_team END AS h, CASE WHEN match_id % 7 = 0 THEN '' ELSE away_team END AS a FROM matches), s AS (SELECT * FROM (VALUES ('Round of 16', 1), ('Quarterfinal', 2), ('semifinal', 3), ('Final', 4)) x(stage, stage_order)) SELECT year, stage, stage_order, string_agg(h || '-' || a, '|' ORDER BY h || '-' || a) AS matches FROM k JOIN s USING (stage) WHERE h <> 'TBD' AND a <> '' GROUP BY 1, 2, 3")
def k9(v: Views) -> DataFrame:
    k = F.col("match_id")
    m = v.matches().select(F.year("date").alias("year"), F.col("tournament_stage").alias("stage"), F.when(k % 5 == 0, "TBD").otherwise(F.col("home_team")).alias("home_team"), F.when(k % 7 == 0, "").otherwise(F.col("away_team")).alias("away_team"))
    return K.knockout_by_stage(m, [STAGE_NAMES[2], STAGE_NAMES[3], STAGE_NAMES[4], STAGE_NAMES[5]], by=("year",))
