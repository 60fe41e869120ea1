"""Runs of repeated words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are
equal) of at least ``LEAST`` words and ``TIMES`` periods that no neighbouring word
extends. Documents are small beside a batch, so a batch of them is worked on at
once in numpy, each with symbols of its own.

1. Re-Pair. In each round the pairs of neighbouring symbols are counted per
   document, and a pair that occurs at least twice becomes a new symbol wherever
   neither pair that overlaps it is more frequent there (ties by a hash of the
   pair). So a document's most frequent pair is replaced at all its places, as in
   Re-Pair, and in the same round others that don't touch it. It ends when no pair
   occurs twice. Each replacement is a place where the symbol derives the text.
2. What is left of a document, its start rule, is halved into a balanced tree.
   Every stretch of words lies in a lowest node of the parse tree (a symbol, or a
   node of the start rule's tree) that contains it, and crosses the boundary of that
   node's halves. So the runs that cross a symbol's boundary within its expansion
   are computed once for each symbol, at its first place.
3. Which periods q can cross a boundary m? In a run of at least max(24, 3 q) words
   words q apart are equal over a stretch of at least max(16, 2 q); so either the
   four words from m on are those at m + q, or the four before m are those before
   m - q. Such places are looked up; hashes tell how far words q apart stay equal to
   either side, and survivors are compared word by word.
4. Of the periods at a boundary the smallest are kept: what lies within the run of
   a smaller period has that one too.
5. The runs of a symbol are moved to all its places, and intervals of one period
   that share at least q words are merged. Each run is found whole at its lowest
   node, so the maximal intervals are the runs.

Defined results: words are what stands between white space (space, tab, line
ends, vertical tab, form feed), whatever else they hold; a null or empty text has no
words and no runs; a document with a null doc_id isn't rewritten; repeated rows are
all kept; other columns are not read. No row is shuffled; a task holds one batch of
documents, of ``AT_ONCE`` words or one document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import mixed

LEAST = 24
TIMES = 3
#: Words whose equality shows a period at a boundary; with LEAST and TIMES as they are, no more than four.
GRAM = 4
AT_ONCE = 400_000
_ROW = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def repaired(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair on documents that stand one after the other. ids: word numbers that differ between documents.

    Returns the places of replacements as rows (symbol, from, middle, to), words
    counted over all documents, and the start rules: the place of each symbol left
    and its document.
    """
    n = len(ids)
    symbol, at, where = ids.astype(np.int64), np.arange(n, dtype=np.int64), doc.astype(np.int64)
    end = at + 1
    fresh = int(symbol.max()) + 1 if n else 0
    places: list[np.ndarray] = []
    left: list[tuple[np.ndarray, np.ndarray]] = []
    # whether the pair from here can occur twice: one that occurs once never will again
    open_ = np.ones(n, dtype=bool)
    while len(symbol):
        key = (symbol[:-1] << 32) | symbol[1:]
        live = np.flatnonzero((where[:-1] == where[1:]) & open_[:-1])
        # of pairs that overlap themselves (x x x) every second place counts
        first = np.append(True, key[1:] != key[:-1])[: len(key)]
        begun = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        apart = live[(live - begun[live]) % 2 == 0]
        apart = apart[np.argsort(key[apart])]
        head = np.flatnonzero(np.append(True, key[apart[1:]] != key[apart[:-1]])[: len(apart)])
        times = np.diff(np.append(head, len(apart)))
        often = np.zeros(len(key), dtype=np.int64)
        often[apart] = np.repeat(times, times)
        rank = np.full(len(key), -1, dtype=np.int64)
        good = apart[often[apart] >= 2]
        rank[good] = (often[good] << 31) | (mixed(key[good].view(np.uint64)) >> np.uint64(33)).astype(np.int64)
        i = np.sort(good)
        i = i[(rank[i] >= np.append(rank, -1)[i + 1]) & (rank[i] > np.append(-1, rank)[i])]
        if not len(i):
            left.append((at, where))
            break
        made, number = np.unique(key[i], return_inverse=True)
        places.append(np.stack([fresh + number, at[i], at[i + 1], end[i + 1]], axis=1))
        # pairs that still occur twice stay open, and those of the new symbols are
        open_ = np.zeros(len(symbol), dtype=bool)
        open_[live] = often[begun[live]] >= 2
        open_[i] = True
        open_[np.maximum(i - 1, 0)] = True
        symbol[i], end[i] = fresh + number, end[i + 1]
        fresh += len(made)
        keep = np.ones(len(symbol), dtype=bool)
        keep[i + 1] = False
        symbol, at, end, where, open_ = symbol[keep], at[keep], end[keep], where[keep], open_[keep]
        # documents without an open pair are done
        going = np.zeros(int(doc[-1]) + 1, dtype=bool)
        going[where[:-1][open_[:-1] & (where[1:] == where[:-1])]] = True
        going = going[where]
        left.append((at[~going], where[~going]))
        symbol, at, end, where, open_ = symbol[going], at[going], end[going], where[going], open_[going]
    rows = np.concatenate(places) if places else np.empty((0, 4), np.int64)
    start, owner = (np.concatenate(c) for c in zip(*left)) if left else (np.empty(0, np.int64),) * 2
    order = np.argsort(start)
    return rows, start[order], owner[order]


def start_nodes(start: np.ndarray, owner: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The balanced trees over start rules as rows (from, middle, to); ends: where each document ends."""
    if not len(start):
        return np.empty((0, 3), np.int64)
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    size = np.diff(np.append(head, len(start)))
    place = np.arange(len(start)) - np.repeat(head, size)
    of, many = np.repeat(head, size), np.repeat(size, size)
    stop = ends[owner]
    out, step = [], 1
    while step < size.max():
        i = np.flatnonzero((place % (2 * step) == step) & (place < many))
        last = place[i] + step
        to = np.where(last < many[i], start[np.minimum(of[i] + last, len(start) - 1)], stop[i])
        out.append(np.stack([start[i - step], start[i], to], axis=1))
        step *= 2
    return np.concatenate(out) if out else np.empty((0, 3), np.int64)


class _Text:
    """Word numbers with what compares stretches of them."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.by_hash = ids.astype(np.int64), True
        n = len(ids)
        self.value = mixed(self.ids.view(np.uint64) + np.uint64(1))
        power = np.empty(n + 1, np.uint64)
        power[0] = 1
        if n:
            power[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        # prefix sums of value * base ** place; a stretch is brought to one place by multiplying
        self.power, self.sums = power, np.append(np.uint64(0), np.cumsum(self.value * power[:n], dtype=np.uint64))

    def equal(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i are those from j, i <= j; by hash, that is never false if they are equal."""
        if not self.by_hash:
            return np.array([bool((self.ids[a : a + k] == self.ids[b : b + k]).all()) for a, b, k in zip(i.tolist(), j.tolist(), n.tolist())], dtype=bool)
        return (self.sums[i + n] - self.sums[i]) * self.power[j - i] == self.sums[j + n] - self.sums[j]

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on, at most most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(i, j, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j, at most most."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            half = (low + high + 1) // 2
            same = self.equal(i - half, j - half, half)
            low, high = np.where(same, half, low), np.where(same, high, half - 1)
        return low

    def grams(self) -> np.ndarray:
        """A hash of the GRAM words from each place on; at the end of all, of those that are left."""
        out = np.zeros(len(self.ids), np.uint64)
        for k in range(GRAM):
            out[: len(out) - k] = mixed(out[: len(out) - k] * _BASE + self.value[k:])
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number from low to before high, and which pair it is of."""
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which], which


def crossing(text: _Text, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs that cross the boundaries of nodes (from, middle, to) within them: node, period, from, to; smallest periods only."""
    low, mid, high = nodes.T
    n = len(text.ids)
    gram = text.grams()
    # places that have the four words of a boundary, in order of gram and place
    asked = np.unique(np.concatenate([gram[mid], gram[np.maximum(mid - GRAM, 0)]]))
    marks = np.zeros(1 << 20, dtype=bool)
    marks[asked >> np.uint64(44)] = True
    places = np.flatnonzero(marks[gram >> np.uint64(44)])
    number = np.searchsorted(asked, gram[places])
    hit = asked[np.minimum(number, len(asked) - 1)] == gram[places]
    places, number = places[hit], number[hit]
    key = np.sort(number * (n + 1) + places)
    most = (high - low) // TIMES
    one = np.searchsorted(asked, gram[mid]) * (n + 1)
    right = _ranges(np.searchsorted(key, one + mid + 1), np.searchsorted(key, one + np.minimum(mid + most, high - GRAM) + 1))
    two = np.searchsorted(asked, gram[np.maximum(mid - GRAM, 0)]) * (n + 1)
    left = _ranges(np.searchsorted(key, two + np.maximum(mid - GRAM - most, low)), np.searchsorted(key, two + np.maximum(mid - GRAM, 0)))
    node = np.concatenate([right[1], left[1]])
    period = np.concatenate([key[right[0]] % (n + 1) - mid[right[1]], mid[left[1]] - GRAM - key[left[0]] % (n + 1)])
    node, period = np.divmod(np.unique(node * (n + 1) + period), n + 1)
    # how far do words q apart stay equal, around the boundary and around q before it
    lo, m, hi, q = low[node], mid[node], high[node], period
    found = []
    for shift in (m, m - q):
        ok = (shift >= lo) & (shift + q <= hi)
        i, s, p = np.flatnonzero(ok), shift[ok], q[ok]
        begin = s - text.backward(s, s + p, s - lo[ok])
        stop = s + p + text.forward(s, s + p, hi[ok] - s - p)
        good = (stop - begin >= np.maximum(LEAST, TIMES * p)) & (begin < m[ok]) & (stop > m[ok])
        found.append(np.stack([node[i[good]], p[good], begin[good], stop[good]], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    # what lies within the run of a smaller period at this boundary isn't a smallest period
    kept = []
    while len(runs):
        first = np.append(True, runs[1:, 0] != runs[:-1, 0])
        kept.append(runs[first])
        mine = runs[np.maximum.accumulate(np.where(first, np.arange(len(runs)), 0))]
        runs = runs[~first & ~((runs[:, 2] >= mine[:, 2]) & (runs[:, 3] <= mine[:, 3]))]
    out = np.concatenate(kept) if kept else np.empty((0, 4), np.int64)
    # hashes may take different words for equal: then all is compared word by word
    if text.by_hash and not all((text.ids[b : e - p] == text.ids[b + p : e]).all() for _, p, b, e in out.tolist()):
        text.by_hash = False
        return crossing(text, nodes)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def runs_of(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All runs of documents that stand one after the other, as rows (from, period, to) in order of from and period; ids: word numbers that differ between documents; ends: where each document ends."""
    none = np.empty((0, 3), np.int64)
    if len(ids) < LEAST:
        return none
    rules, start, owner = repaired(ids, doc)
    rules = rules[rules[:, 3] - rules[:, 1] >= LEAST]
    rules = rules[np.lexsort((rules[:, 1], rules[:, 0]))]
    head = np.append(True, rules[1:, 0] != rules[:-1, 0]) if len(rules) else np.empty(0, bool)
    tree = start_nodes(start, owner, ends)
    tree = tree[tree[:, 2] - tree[:, 0] >= LEAST]
    nodes = np.concatenate([rules[head][:, 1:], tree])
    if not len(nodes):
        return none
    node, period, begin, stop = crossing(_Text(ids), nodes)
    if not len(node):
        return none
    # a symbol's runs at all its places
    places = np.flatnonzero(head)
    many = np.append(np.diff(np.append(places, len(rules))), np.ones(len(tree), np.int64))
    first = np.append(places, np.zeros(len(tree), np.int64))
    place, which = _ranges(first[node], first[node] + many[node])
    of_rule = node[which] < len(places)
    shift = np.where(of_rule, (rules[place, 1] if len(rules) else 0) - nodes[node[which], 0], 0)
    period, begin, stop = period[which], begin[which] + shift, stop[which] + shift
    # maximal intervals of a document and period
    owner = doc[begin]
    order = np.lexsort((begin, period, owner))
    owner, period, begin, stop = owner[order], period[order], begin[order], stop[order]
    group = np.cumsum(np.append(True, (owner[1:] != owner[:-1]) | (period[1:] != period[:-1]))) - 1
    span = len(ids) + 1
    reach = np.maximum.accumulate(stop + group * span) - group * span
    new = np.append(True, (group[1:] != group[:-1]) | (begin[1:] > reach[:-1] - period[1:]))
    at = np.flatnonzero(new)
    out = np.stack([begin[at], period[at], reach[np.append(at[1:] - 1, len(reach) - 1)]], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, or for one document in ten those with a periodic end."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(docs: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
    """The contract's row of each document (id, words)."""
    ids: list[int] = []
    offset = 0
    ends = np.cumsum([len(w) for _, w in docs])
    for _, words in docs:
        own: dict[bytes, int] = {}
        ids += [offset + own.setdefault(w, len(own)) for w in words]
        offset += len(own)
    doc = np.repeat(np.arange(len(docs)), [len(w) for _, w in docs])
    runs = runs_of(np.array(ids, np.int64), doc, ends)
    cut = np.searchsorted(runs[:, 0], ends)
    done = 0
    for (doc_id, words), end, stop in zip(docs, ends.tolist(), cut.tolist()):
        base = end - len(words)
        mine = [(b - base, e - b, q) for b, q, e in runs[done:stop].tolist()]
        done = stop
        best = min(mine, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if mine else None
        if mine:
            gone = np.zeros(len(words) + 1, np.int64)
            for b, n, q in mine:
                gone[b + q] += 1
                gone[b + n] -= 1
            words = [w for w, dropped in zip(words, np.cumsum(gone[:-1]).tolist()) if not dropped]
        listed = "".join(f"{b},{n},{q}\n" for b, n, q in mine).encode()
        yield doc_id, len(mine), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()


def run_digests(docs: DataFrame, rewrite: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, the number of runs, the most repeated one, and digests of all runs and of the text without repetitions; rewrite: one document in ten gets a periodic end first."""

    def run(batches):
        schema = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in (f.split()[0] for f in _ROW.split(", "))])

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*digests(held)), schema)], schema=schema)

        held, n = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id = doc_id.as_py()
                words = (text.as_py() or b"").split()
                held.append((doc_id, rewritten(words, doc_id) if rewrite else words))
                n += len(words)
                if n >= at_once or len(held) >= 4096:
                    yield out(held)
                    held, n = [], 0
        if held:
            yield out(held)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, _ROW)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over documents."""
    return run_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), rewrite=True)
