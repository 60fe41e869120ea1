"""Language identification: known words first, then ever shorter character n-grams.

The model is counted by Spark on labelled documents: the frequency of each word
in each language, and of the character n-grams of those words. A word of a text
that the model knows scores by its log frequency in each language. An unseen
word scores by its longest n-grams that the model knows: n-grams of 5
characters, else of 4, down to 1. A text's scores are the sums over its words;
the language with the largest is predicted, and the score is its posterior
probability, all languages being alike before and words independent.

The sample of labelled documents is bounded by ``SAMPLE_DOCS`` (in expectation:
rows are chosen by a hash of doc_id), dealt out to the languages alike: one with
few documents gives all of them, every other at least about ``LEAST_DOCS``, so each
language is learned at every size. The model holds every word and n-gram of the
sample: 12 bytes for each, and 6 for each language that it occurs in. Every
document is predicted, from its whole text alone.

Defined results: ``und`` and 0.0 for a text that is null or has no letter, or if
nothing was learned; languages that tie go to the first in alphabetical order;
rows with a null doc_id are predicted, not learned from and not held out;
repeated rows are each predicted; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, only_cache, with_fields, written

SAMPLE_DOCS = 20_000
LEAST_DOCS = 100
HASHES = 1_000_000_000
LONGEST = 5
#: Spark's seed for xxhash64.
SEED = 42


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _share(counts: list[int], most: int) -> int:
    """The bound for each of the groups of these sizes that leaves most rows in all; what small groups leave goes to the large ones."""
    for i, n in enumerate(sorted(counts)):
        bound = most // (len(counts) - i)
        if n > bound:
            return bound
        most -= n
    return max(counts, default=0)


@dataclass
class Model:
    """Log frequencies by language of words (kind 0) and n-grams (kinds 1 to LONGEST), half a count added to each.

    keys are sorted hashes; the entries of key i, of languages and by how much
    they are above that of a key never seen there (``unseen``, by kind and
    language), stand from starts[i] to starts[i + 1].
    """

    langs: list[str]
    keys: np.ndarray
    starts: np.ndarray
    entry_langs: np.ndarray
    entries: np.ndarray
    unseen: np.ndarray

    def rows(self, at: np.ndarray, kind: int) -> np.ndarray:
        """The log frequencies of the keys at these places, which are of one kind."""
        out = np.tile(self.unseen[kind], (len(at), 1))
        n = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(at)), n), self.entry_langs[entry]] += self.entries[entry]
        return out

    def find(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each of names its place, and whether the model knows it."""
        h = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "replace"), SEED) for x in names), np.uint64, len(names))
        if not len(self.keys):
            return h, np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h

    def word_scores(self, words: list[str]) -> np.ndarray:
        """For each of words its log frequencies, or the means of those of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        at, known = self.find(["=" + w for w in words])
        out[known] = self.rows(at[known], 0)
        left = np.flatnonzero(~known)
        for k in range(LONGEST, 0, -1):
            marked = [f"_{words[i]}_" for i in left]
            owner = np.repeat(left, [max(0, len(m) - k + 1) for m in marked])
            at, known = self.find([m[i : i + k] for m in marked for i in range(len(m) - k + 1)])
            np.add.at(out, owner[known], self.rows(at[known], k))
            n = np.bincount(owner[known], minlength=len(words))[left]
            out[left[n > 0]] /= n[n > 0, None]
            left = left[n == 0]
        return out


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model from docs(doc_id, text, lang)."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # a row for each language that is labelled
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    each = max(LEAST_DOCS, _share(list(counts.values()), sample_docs))
    limits = docs.sparkSession.createDataFrame([(x, math.ceil(HASHES * min(1.0, each / n))) for x, n in counts.items()], "lang string, below long")
    chosen = labelled.select("doc_id", "text", "lang").join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < F.col("below"))
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("marked"))))
    starts = F.explode(F.sequence(F.lit(1), F.length("marked") - F.col("kind") + 1))
    gram = F.col("marked").substr(F.col("i"), F.col("kind"))
    grams = counted.select("lang", "n", marked.alias("marked")).withColumn("kind", lengths).withColumn("i", starts).select("lang", "kind", gram.alias("name"), "n")
    of_words = counted.select("lang", F.lit(0).alias("kind"), F.concat(F.lit("="), "word").alias("name"), "n")
    of_grams = grams.groupBy("lang", "kind", "name").agg(F.sum("n").alias("n"))
    # no more than the sample holds; hashes in the place of names
    found = of_words.unionByName(of_grams).select("lang", "kind", F.xxhash64("name").alias("key"), "n").toArrow()
    return _model(found)


def _model(found: pa.Table) -> Model:
    names, place = np.unique(np.array(found.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
    kind, n = found.column("kind").to_numpy(), found.column("n").to_numpy().astype(float)
    order = np.lexsort((place, found.column("key").to_numpy().view(np.uint64)))
    keys, starts = np.unique(found.column("key").to_numpy().view(np.uint64)[order], return_index=True)
    totals = np.zeros((LONGEST + 1, len(names)))
    np.add.at(totals, (kind, place), n)
    unseen = np.log(0.5 / (totals + 1))
    above = np.log((n + 0.5) / (totals[kind, place] + 1)) - unseen[kind, place]
    return Model(names.tolist(), keys, np.append(starts, len(order)).astype(np.int64), place[order].astype(np.int16), above[order].astype(np.float32), unseen)


def letters_of(token: str) -> list[str]:
    """The runs of letters of a token in lower case."""
    return [token] if token.isalpha() else "".join(c if c.isalpha() else " " for c in token).split()


class Scorer(dict):
    """For a token: the row of its summed word scores and its number of words in a table that grows with the tokens seen, up to a bound."""

    def __init__(self, model: Model, most: int = 350_000):
        super().__init__()
        width = len(model.langs) + 1
        self.model, self.most = model, max(1000, min(most, (1 << 24) // width))
        self.table = np.zeros((self.most, width), dtype=np.float32)

    def add(self, tokens: list[str]) -> None:
        words = [letters_of(t) for t in tokens]
        n = np.array([len(w) for w in words], dtype=np.int64)
        scores = self.model.word_scores([x for w in words for x in w])
        rows = slice(len(self), len(self) + len(tokens))
        self.table[rows] = 0.0
        np.add.at(self.table[rows, :-1], np.repeat(np.arange(len(n)), n), scores)
        self.table[rows, -1] = n
        self.update(zip(tokens, range(rows.start, rows.stop)))

    def sums(self, tokens: list[str], ends: np.ndarray) -> np.ndarray:
        """For each run of tokens up to one of ends: the sums of their rows."""
        distinct = set(tokens)
        new = [t for t in distinct if t not in self]
        if len(self) + len(new) > self.most:
            self.clear()
            new = list(distinct)
        self.add(new)
        rows = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        upto = np.concatenate([np.zeros((1, self.table.shape[1])), np.cumsum(self.table[rows], axis=0, dtype=np.float64)])
        return np.diff(upto[ends], axis=0, prepend=0.0)

    def predict(self, texts: list[str | None], at_once: int = 50_000) -> list[tuple[str, float]]:
        """(language, score) of each text; at_once tokens are looked up at a time, of a longer text too."""
        at_once = min(at_once, self.most)
        totals = np.zeros((len(texts), self.table.shape[1]))
        held: list[str] = []
        owners: list[int] = []
        ends: list[int] = []

        def flush() -> None:
            if held:
                np.add.at(totals, owners, self.sums(held, np.array(ends)))
            for x in (held, owners, ends):
                x.clear()

        for i, text in enumerate(texts):
            tokens = (text or "").lower().split()
            for j in range(0, len(tokens), at_once):
                part = tokens[j : j + at_once]
                if len(held) + len(part) > at_once:
                    flush()
                held.extend(part)
                owners.append(i)
                ends.append(len(held))
        flush()
        return [self._best(total) for total in totals]

    def _best(self, total: np.ndarray) -> tuple[str, float]:
        n, x = total[-1], total[:-1]
        if not n or not len(x):
            return "und", 0.0
        best = int(np.argmax(x))
        return self.model.langs[best], float(1 / np.exp(x - x[best]).sum())


#: The scorer of the last model that a Python worker has met.
_SCORERS: dict[str, Scorer] = {}


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    shared, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def predict(batches):
        only_cache("languages", _SCORERS.clear)
        if name not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[name] = Scorer(shared.value)
        scorer = _SCORERS[name]
        for part in in_slices(batches, 1024):
            found = scorer.predict(part.column("text").to_pylist())
            yield part.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column("score", pa.array([x for _, x in found], pa.float64()))

    return docs.mapInArrow(predict, with_fields(docs, "lang_pred string, score double"))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The rows of docs(doc_id, text, lang, ...) whose language is identified with at least least_score."""
    mine = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = predicted(mine, learn(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score)).select("row.*")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.select("doc_id", "text", "lang"))
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
