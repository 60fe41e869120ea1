"""Quality classification by co-training a text view and a metadata view.

A document is good if it is labelled of quality 1 and not toxic. Two logistic
regressions look at different views of it: the text view at the words of the
labelled sample whose effect there is at least ``TELLING`` standard errors, and at
the text's style; the metadata view at language, source and length. Each language
and source of the sample has a place of its own; all others share one place for
languages and one for sources. Over ``ROUNDS`` rounds each view scores every
document outside the labelled sample and labels those that it is confident of, for
the other to learn from; they weigh as much together as ``PSEUDO`` times the
labelled ones at most, so that these still count in a large corpus. Both are then
calibrated on labelled documents that neither has learned from, and their
calibrated log-odds are added, less those of the base rate, to score every document
from its whole text.

The labelled sample is bounded (in expectation) by ``LABELLED`` rows, chosen by a
hash of doc_id; everything else covers all rows. Labelled documents outside the
sample count as unlabelled. If no document is left outside it, or none is scored
confidently, nothing is exchanged: the views are two regressions on the sample.

Defined results: a null text is empty, a null language or source is an empty one; a document with several labels counts with each; labels without
a document, or with nulls, are left out; if the sample lacks good or bad
documents every score is the base rate (0.5 without labels); repeated rows are
each scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import in_slices, new_dir, with_fields, written

LABELLED = 8_000
ROUNDS = 2
CONFIDENT = 0.97
PSEUDO = 0.5
TELLING = 2.0


def _sampled(df: DataFrame, most: int, salt: int) -> DataFrame:
    n = df.count()
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, most / max(n, 1))))


STYLE = ["log_words", "share_upper", "share_marks", "share_digits", "share_repeated", "share_bars", "words_per_line", "mean_length"]


EDGES = ".,;:!?*%$&#|"
#: Tokens whose word a task remembers, and texts that are Python strings at a time.
TOKENS, SLICE = 400_000, 256
View = tuple[np.ndarray, np.ndarray]


class Places(dict):
    """For a token: the place of its word in a text view, -1 if it has none. Keeps what it has seen, up to a bound."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS:
            self.clear()
        i = self.words.get(token.strip(EDGES).lower())
        self[token] = place = -1 if i is None else len(STYLE) + i
        return place


def style_of(text: str, tokens: list[str]) -> tuple[float, ...]:
    """The values of STYLE."""
    n = len(tokens) or 1
    distinct = set(tokens)
    letters = len(text) or 1
    upper = sum(t.isupper() and len(t) > 1 for t in tokens)
    marks = sum(text.count(c) for c in "!#$%&*")
    digits = sum(text.count(c) for c in "0123456789")
    return (math.log1p(len(tokens)), upper / n, min(1.0, marks / n), digits / letters, 1 - len(distinct) / n, min(1.0, text.count("|") / n), math.log1p(n / (text.count("\n") + 1)), min(2.0, letters / n / 10))


def text_view(text: str | None, places: Places) -> View:
    """Places and values of what isn't zero: the style of a text, then 1 for each known word that it holds."""
    text = text or ""
    tokens = text.split()
    held = {places[t] for t in set(tokens)}
    held.discard(-1)
    at = np.array([*range(len(STYLE)), *sorted(held)], np.int32)
    return at, np.concatenate([style_of(text, tokens), np.ones(len(held))])


#: Places of a metadata view before those of the sample's languages and sources.
META = ["other_lang", "other_source", "length", "length_squared"]


def meta_view(lang: str | None, source: str | None, n_chars: int | None, values: dict[tuple[str, str], int]) -> View:
    """Places and values of what isn't zero: 1 for the language and for the source, and the length."""
    length = math.log1p(max(0, n_chars or 0)) / 10
    found = {2: length, 3: length * length}
    for other, kind, value in ((0, "lang", lang), (1, "source", source)):
        i = values.get((kind, value or ""))
        found[other if i is None else len(META) + i] = 1.0
    at = sorted(found)
    return np.array(at, np.int32), np.array([found[i] for i in at])


def _sparse(rows: list[View], size: int) -> pa.StructArray:
    """rows as Spark keeps sparse vectors."""
    ends = np.concatenate([[0], np.cumsum([len(at) for at, _ in rows])]).astype(np.int32)
    indices = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int32), *(at for at, _ in rows)]))
    values = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0), *(x for _, x in rows)]))
    return pa.StructArray.from_arrays([pa.array([0] * len(rows), pa.int8()), pa.array([size] * len(rows), pa.int32()), indices, values], names=["type", "size", "indices", "values"])


def with_views(docs: DataFrame, known: tuple[dict, dict]) -> DataFrame:
    """The written table of docs(text, lang, source, n_chars, ...) with the vectors text_view and meta_view in the place of these."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    read = ["text", "lang", "source", "n_chars"]

    def of(batches):
        words, values = shared.value
        places = Places(words)
        for batch in in_slices(batches, SLICE):
            text = [text_view(t, places) for t in batch.column("text").to_pylist()]
            meta = [meta_view(*x, values) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]
            yield batch.drop_columns(read).append_column("text_view", _sparse(text, len(STYLE) + len(words))).append_column("meta_view", _sparse(meta, len(META) + len(values)))

    vector = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"
    path = new_dir(docs.sparkSession, "views")
    docs.mapInArrow(of, with_fields(docs.drop(*read), f"text_view {vector}, meta_view {vector}")).write.parquet(path)
    # read as vectors, so that no row is widened
    schema = StructType([*docs.drop(*read).schema.fields, StructField("text_view", VectorUDT()), StructField("meta_view", VectorUDT())])
    return docs.sparkSession.read.schema(schema).parquet(path)


def telling_words(sample: DataFrame) -> dict[str, int]:
    """The words of sample(text, good) whose presence tells something about good, numbered; no more than the sample holds."""
    edges = "[" + re.escape(EDGES) + "]+"
    sums = sample.agg(F.sum("good").alias("g"), F.count("*").alias("n")).first()
    n, good = sums["n"], sums["g"] or 0
    word = F.explode(F.array_distinct(F.transform(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda t: F.lower(F.regexp_replace(t, f"^{edges}|{edges}$", ""))))).alias("word")
    counts = sample.select("good", word).where("word <> ''").groupBy("word").agg(F.sum("good").alias("g"), F.count("*").alias("n"))
    g, b = F.col("g") + 0.5, F.col("n") - F.col("g") + 0.5
    # a distance from no effect, in standard errors
    effect = F.abs(F.log(g / (good + 1)) - F.log(b / (n - good + 1))) / F.sqrt(1 / g + 1 / b)
    return {r["word"]: i for i, r in enumerate(counts.where(effect >= TELLING).select("word").orderBy("word").collect())}


def known_values(sample: DataFrame) -> dict[tuple[str, str], int]:
    """All languages and sources of sample(lang, source), numbered."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.coalesce(c, F.lit("")).alias("value")) for c in ("lang", "source")))).alias("p")
    return {(r["kind"], r["value"]): i for i, r in enumerate(sample.select(pairs).select("p.*").distinct().orderBy("kind", "value").collect())}


def fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    """A logistic regression of good on a view, from rows(good, weight, view), with classes weighted alike."""
    share = rows.agg(F.sum(F.col("weight") * F.col("good")) / F.sum("weight")).first()[0]
    weight = F.col("weight") * F.when(F.col("good") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    return LogisticRegression(featuresCol=view, labelCol="good", weightCol="weight", regParam=0.005, maxIter=25).fit(rows.select(view, F.col("good").cast("double").alias("good"), weight.alias("weight")))


def log_odds(rows: DataFrame, view: str, model: LogisticRegressionModel) -> DataFrame:
    """rows and z, the log-odds by the model of a view."""
    out = model.setFeaturesCol(view).setRawPredictionCol("raw").setProbabilityCol("").setPredictionCol("").transform(rows)
    return out.withColumn("z", vector_to_array("raw")[1]).drop("raw")


def cotrain(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> dict:
    """Words, languages and sources and calibrated models of both views, from docs and labels(doc_id, quality, toxic)."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    sample = written(docs.select(columns).join(_sampled(known, LABELLED, 1), "doc_id"), "labelled")
    sums = sample.agg(F.sum("good").alias("g"), F.count("*").alias("n")).first()
    good, n = sums["g"] or 0, sums["n"]
    base = (good + 0.5) / (n + 1)
    if not 0 < good < n:
        return {"base": base}
    known = telling_words(sample), known_values(sample)
    labelled = with_views(sample.select(*columns, "good", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)).alias("fold")), known).coalesce(4)
    learned, calibration = labelled.where("fold > 0"), labelled.where("fold = 0")
    sums = learned.agg(F.avg("good").alias("share"), F.count("*").alias("n")).first()
    if not 0 < (sums["share"] or 0) < 1 or not 0 < (calibration.agg(F.avg("good")).first()[0] or 0) < 1:
        return {"base": base}
    # all rows whose label is not in the sample, the labelled ones among them
    unlabelled = with_views(docs.select(columns).join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_anti").drop("doc_id"), known)
    pseudo = {"text_view": None, "meta_view": None}
    other = {"text_view": "meta_view", "meta_view": "text_view"}
    for turn in range(rounds + 1):
        models = {}
        for view, more in pseudo.items():
            rows = learned.select("good", F.lit(1.0).alias("weight"), view)
            models[view] = fit(rows if more is None else rows.unionByName(more), view)
        if turn == rounds:
            break
        for view, model in models.items():
            sure = log_odds(unlabelled, view, model).where(F.abs("z") >= math.log(CONFIDENT / (1 - CONFIDENT)))
            n_sure = sure.count()
            good = (F.col("z") >= 0).cast("int").alias("good")
            pseudo[other[view]] = sure.select(good, F.lit(min(1.0, PSEUDO * sums["n"] / n_sure)).alias("weight"), other[view]) if n_sure else None
    for view, model in models.items():
        raw = log_odds(calibration, view, model).select(F.array("z").alias("z"), "good")
        line = LogisticRegression(featuresCol="x", labelCol="good", regParam=1e-4, maxIter=25).fit(raw.select(array_to_vector("z").alias("x"), F.col("good").cast("double").alias("good")))
        slope, shift = float(line.coefficients[0]), float(line.intercept)
        models[view] = (model.coefficients.toArray() * slope, float(model.intercept) * slope + shift)
    return {"base": base, "known": known, **models}


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, quality_score (chance of being good) and kept (at least one half) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        m = shared.value
        base = math.log(m["base"] / (1 - m["base"])) if m["base"] not in (0, 1) else 0.0
        words, values = m.get("known", ({}, {}))
        places = Places(words)
        for batch in in_slices(batches, SLICE):
            scores = []
            for text, lang, source, n_chars in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))):
                z = base
                if "known" in m:
                    parts = (text_view(text, places), m["text_view"]), (meta_view(lang, source, n_chars, values), m["meta_view"])
                    z = sum(float(x @ w[at]) + b for (at, x), (w, b) in parts) - base
                scores.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([s >= 0.5 for s in scores], pa.bool_())], names=["doc_id", "quality_score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text", "lang", "source", F.col("n_chars").cast("long")).mapInArrow(of, "doc_id long, quality_score double, kept boolean")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, cotrain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
