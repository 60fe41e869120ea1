"""Benchmark decontamination: rare word and pair seeds, then Smith-Waterman alignment.

The benchmark is a stated query set, taken in blocks of about ``WORDS_AT_ONCE``
words (an item is never cut) against all documents. In a first pass each task
counts how often the items' words and word pairs occur in the documents. The
rarest words and pairs of an item become seeds, so many that every leak, by its
score, holds some of them (see ``Items``). In a second pass seeds found in a
document open a window around them; if enough of the item's words and pairs stand
in it, window and item are aligned word by word. So the leaks are those of an
alignment of every item with every document.

A leak is an alignment that scores at least ``LEAST_SHARE`` of the item's best
score, or that of ``LONG`` words.

Defined results: null and empty texts and items match nothing, nor do items of
fewer than ``FEWEST`` words; items of equal texts are each reported; repeated
documents are each reported; of several places in a document the best is (the
first, should they tie); rows with a null doc_id or item_id are kept; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, only_cache
from .words import WORDS, ngrams

FEWEST = 3
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SHARE = 0.5
LONG = 40
WORDS_AT_ONCE = 500_000
HITS_SHARE = (1, 5)
#: So many words of documents are looked up at a time.
LOOKED_UP = 50_000
HITS = "doc_id long, item_id long, score double, first_word long, last_word long"


def align(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """(score, first, last word of the window) of the best local alignment, by Smith-Waterman with linear gaps; the first of equal ones."""
    n = len(window)
    places = np.arange(n + 1)
    h = np.zeros(n + 1, dtype=np.int64)
    origin = places.copy()
    best = (0, 0, 0)
    for word in item:
        diagonal = h[:-1] + np.where(window == word, MATCH, MISMATCH)
        up = h[1:] + GAP
        new, start = np.zeros(n + 1, dtype=np.int64), places.copy()
        take = diagonal > 0
        new[1:][take], start[1:][take] = diagonal[take], origin[:-1][take]
        take = up > new[1:]
        new[1:][take], start[1:][take] = up[take], origin[1:][take]
        # gaps along the window: the best of all places before, less the way from there
        lifted = new - GAP * places
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, places, 0))
        along = top + GAP * places
        start = np.where(along > new, start[source], start)
        h, origin = np.maximum(new, along), start
        end = int(np.argmax(h))
        if h[end] > best[0]:
            best = (int(h[end]), int(origin[end]), end - 1)
    return best


def least_score(n: int) -> int:
    """The least score of a leak of an item of n words."""
    return math.ceil(min(LEAST_SHARE * MATCH * n, MATCH * LONG))


def tokens_of(words: np.ndarray) -> np.ndarray:
    """The hashes of the words and then of the word pairs of a text."""
    return np.concatenate([ngrams(words, 1), ngrams(words, 2)]) if len(words) > 1 else ngrams(words, 1)


def in_chunks(texts: list[str | None]):
    """(first row, words of each row) for as many texts as hold about LOOKED_UP words, one at least."""
    first, held, n = 0, [], 0
    for text in texts:
        held.append(WORDS.of(text))
        n += len(held[-1])
        if n >= LOOKED_UP:
            yield first, held
            first, held, n = first + len(held), [], 0
    if held:
        yield first, held


def tokens_of_all(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row of docs, place in it) of the words and word pairs of all docs."""
    words = np.concatenate(docs)
    n = np.array([len(d) for d in docs])
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(docs)), n)
    place = np.arange(len(words)) - (ends - n)[owner]
    if len(words) < 2:
        return ngrams(words, 1), owner, place
    inside = owner[1:] == owner[:-1]
    pairs = ngrams(words, 2)[inside]
    return np.concatenate([ngrams(words, 1), pairs]), np.concatenate([owner, owner[:-1][inside]]), np.concatenate([place, place[:-1][inside]])


class Items:
    """A block of benchmark items, and where their words and word pairs stand.

    An alignment of m matched words in r runs scores at most MATCH * m - (r - 1),
    so m words and m - r pairs of its item, m + (m - r) >= score - 1 of them,
    stand in the document. Of an item's 2n - 1 words and pairs a leak thus misses
    2n - least at most: any 2n - least + need of them are enough as seeds, of which
    need are hit.
    """

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids, self.words = [], []
        for item_id, text in rows:
            words = WORDS.of(text)
            if len(words) >= FEWEST:
                self.ids.append(item_id)
                self.words.append(words)
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.least = np.array([least_score(len(w)) for w in self.words], dtype=np.int64)
        # gaps that a leak has room for
        self.slack = MATCH * self.size - self.least
        self.need = np.ones(len(self.words), dtype=np.int64)
        self.own = [tokens_of(w) for w in self.words]
        if self.words:
            self.set_grams(np.concatenate(self.own), np.repeat(np.arange(len(self.own)), 2 * self.size - 1), np.concatenate([np.concatenate([np.arange(n), np.arange(n - 1)]) for n in self.size]))
        else:
            self.set_grams(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))

    def set_grams(self, grams: np.ndarray, items: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.grams, self.items, self.places = grams[order], items[order].astype(np.int64), places[order].astype(np.int64)
        self.first = np.flatnonzero(np.concatenate([[True], self.grams[1:] != self.grams[:-1]])[: len(self.grams)])
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[(self.grams & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def found(self, grams: np.ndarray) -> np.ndarray:
        """The places in grams that hold one of these words or pairs."""
        at = np.flatnonzero(self.filter[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0]
        i = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        return at[self.grams[i] == grams[at]]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each of the items' distinct words and pairs occurs in texts."""
        out = np.zeros(len(self.grams) + 1, dtype=np.int64)
        for _, docs in in_chunks(texts):
            tokens = tokens_of_all(docs)[0]
            out += np.bincount(np.searchsorted(self.grams, tokens[self.found(tokens)]), minlength=len(out))
        return out[self.first]

    def keep_seeds(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Keeps of each item the words and pairs that occur least, as many as a leak can't do without: ``need`` of them stand in each. grams are sorted; others occur nowhere. The counts decide how fast leaks are found, not which."""
        often = np.zeros(len(self.grams), dtype=np.int64)
        if len(grams):
            at = np.minimum(np.searchsorted(grams, self.grams), len(grams) - 1)
            often = np.where(grams[at] == self.grams, counts[at], 0)
        parts, must = 2 * self.size - 1, self.least - 1
        self.need = np.maximum(1, must * HITS_SHARE[0] // HITS_SHARE[1])
        order = np.lexsort((self.places, often, self.items))
        begin = np.concatenate([[0], np.cumsum(parts)[:-1]])
        rank = np.arange(len(order)) - np.repeat(begin, parts)
        kept = order[rank < np.repeat(parts - must + self.need, parts)]
        self.set_grams(self.grams[kept], self.items[kept], self.places[kept])

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(row, item, share of its best score, first, last word) for each item that leaks into one of texts."""
        return [(first + d, *hit) for first, docs in in_chunks(texts) for d, *hit in self._leaks(docs)]

    def _leaks(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, int, int]]:
        tokens, owner, place = tokens_of_all(docs)
        at = self.found(tokens)
        if not len(at):
            return []
        low, high = np.searchsorted(self.grams, tokens[at], "left"), np.searchsorted(self.grams, tokens[at], "right")
        many = high - low
        row = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        item, at = self.items[row], np.repeat(at, many)
        # most items have too few hits in a whole document
        _, pair, n = np.unique(owner[at] * len(self.size) + item, return_inverse=True, return_counts=True)
        able = n[pair] >= self.need[item]
        if not able.any():
            return []
        item, row, at = item[able], row[able], at[able]
        doc, begin = owner[at], place[at] - self.places[row]
        order = np.lexsort((begin, item, doc))
        doc, item, begin, row = doc[order], item[order], begin[order], row[order]
        # a window for each run of starts that lie close to each other
        new = np.ones(len(item), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > np.maximum(self.size, self.slack)[item[1:]])
        edges = np.append(np.flatnonzero(new), len(item))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        of: dict[int, np.ndarray] = {}
        full = np.flatnonzero(np.diff(edges) >= self.need[item[edges[:-1]]])
        for a, b in zip(edges[full].tolist(), edges[full + 1].tolist()):
            d, k = int(doc[a]), int(item[a])
            if len(set(row[a:b].tolist())) < self.need[k]:
                continue
            if d not in of:
                of[d] = tokens_of(docs[d])
            words, mine = docs[d], of[d]
            own, n, least, slack = self.words[k], int(self.size[k]), int(self.least[k]), int(self.slack[k])
            lo, hi = max(0, int(begin[a]) - slack), min(len(words), int(begin[b - 1]) + n + slack)
            # of a run of many copies a window grows long: it is aligned in overlapping parts
            for p in range(lo, hi, 4 * n):
                end = min(hi, p + 5 * n + slack)
                window = words[p:end]
                if np.isin(self.own[k], np.concatenate([mine[p:end], mine[len(words) + p : len(words) + end - 1]])).sum() < least - 1:
                    continue
                score, first, last = align(window, own)
                if score >= least and score > best.get((d, k), (0,))[0]:
                    best[d, k] = (score, p + first, p + last)
        return [(d, k, score / (MATCH * int(self.size[k])), first, last) for (d, k), (score, first, last) in sorted(best.items())]


def _blocks(benchmark: DataFrame, words_at_once: int):
    """Blocks of at most words_at_once words each, unless one item (or its repeated rows) has more; each is collected for itself."""
    number = F.xxhash64("item_id", "text")
    rows = benchmark.select(F.col("item_id").cast("long"), "text").withColumn("number", number).withColumn("n", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))

    def split(i: int, parts: int):
        mine = rows.where(F.pmod("number", F.lit(parts)) == i)
        sums = mine.agg(F.sum("n").alias("n"), (F.min("number") < F.max("number")).alias("several")).first()
        if sums["n"] is None:
            return
        if sums["n"] > words_at_once and sums["several"]:
            yield from split(i, 2 * parts)
            yield from split(i + parts, 2 * parts)
        else:
            yield mine.select("item_id", "text").collect()

    yield from split(0, 1)


def _seeded(docs: DataFrame, benchmark: DataFrame, words_at_once: int):
    """A broadcast block of items at a time, with their seeds chosen."""
    spark = docs.sparkSession
    for rows in _blocks(benchmark, words_at_once):
        items = Items([tuple(r) for r in rows])
        if not len(items.grams):
            continue
        shared = spark.sparkContext.broadcast(items)

        def count(batches, shared=shared):
            only_cache("words", WORDS.clear)
            mine = shared.value
            total = 0
            for batch in in_slices(batches, 1024):
                total = total + mine.counts(batch.column("text").to_pylist())
            if isinstance(total, np.ndarray):
                held = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(mine.grams[mine.first[held]].view(np.int64)), pa.array(total[held])], names=["gram", "n"])

        # at most a row for each word or pair of the block
        found = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
        grams, n = found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
        order = np.argsort(grams)
        items.keep_seeds(grams[order], n[order])
        yield spark.sparkContext.broadcast(items)


def find_leaks(docs: DataFrame, benchmark: DataFrame, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """doc_id, item_id, score (share of the item's best), first_word and last_word of each leak of benchmark(item_id, text) into docs(doc_id, text)."""

    def scan(shared):
        def of(batches):
            only_cache("words", WORDS.clear)
            for batch in in_slices(batches, 1024):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[d], shared.value.ids[k], score, first, last) for d, k, score, first, last in shared.value.leaks(batch.column("text").to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "first_word", "last_word"])

        return of

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], HITS)
    for shared in _seeded(docs, benchmark, words_at_once):
        out = out.unionByName(docs.mapInArrow(scan(shared), HITS))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, words_at_once: int = WORDS_AT_ONCE) -> DataFrame:
    """The rows of docs into which no item of benchmark leaks."""

    def keep(shared):
        def of(batches):
            only_cache("words", WORDS.clear)
            for batch in in_slices(batches, 1024):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[[d for d, *_ in shared.value.leaks(batch.column("text").to_pylist())]] = False
                yield batch.filter(pa.array(clean))

        return of

    for shared in _seeded(docs, benchmark, words_at_once):
        docs = docs.mapInArrow(keep(shared), docs.schema)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
