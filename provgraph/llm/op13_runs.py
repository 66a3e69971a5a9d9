"""Runs of words that repeat with a period, by the linear method of Gusfield
and Stoye.

A run is a stretch of words with smallest period q, at least ``EXPONENT`` times
q and ``LEAST`` words long, that no neighbouring word extends. Every run
consists of squares (a stretch twice in a row) whose half is q long and does
not repeat itself. Those squares are found in three phases:

1. Lempel-Ziv blocks: each block is the longest stretch that also starts
   earlier. The leftmost square of each kind lies about one or two block
   borders, where extensions to both sides find it.
2. Suffix-link walks: a square without its first word, and with that word put
   last, is a square if the suffix tree goes on with that word. Walks from the
   leftmost squares, each until it fails or comes to a place that was reached
   before, complete the vocabulary: one entry for each different square.
3. The leaves below an entry's place in the tree are all its occurrences;
   those that follow each other by one word, with one period, are a run.

The suffix tree is held as a suffix array: a place in the tree is an interval
of it and a depth. Suffixes are ordered by prefix doubling of ranks, and the
ranks of each doubling answer how far two places agree. All documents of a part
of a batch are one sequence in which no word of one equals a word of another;
phases work in numpy on all of them at once.

Scale: a document is worked on where it is read, with no shuffle; a part of a
batch holds some megabytes of text, or one longer document, and its arrays are
a multiple of that.

Defined results: null and empty texts have no words, no run, four nulls and
the hashes of nothing; a document without a doc_id is not altered before the
search; repeated rows are each treated alike; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.llm.common import table
from provgraph.llm.hashing import slices, utf8, word_bounds

EXPONENT, LEAST = 4, 6


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place within the row of ``counts`` items a row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]


class Suffixes:
    """Suffix array of a sequence of numbers, with the ranks of each doubling."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n, self.x = n, x
        order = np.argsort(x, kind="stable")
        self.order, self.ranks = order, []
        rank, more = self._ranked(order, np.arange(n), x[order]), 1
        while True:
            self.ranks.append(rank)
            # groups of several suffixes that agree so far
            held = rank[self.order]
            alone = np.ones(n + 1, bool)
            alone[1:n] = held[1:] != held[:-1]
            open_ = np.flatnonzero(~(alone[:-1] & alone[1:]))
            if not len(open_):
                break
            suffix = self.order[open_]
            after = np.where(suffix + more < n, rank[np.minimum(suffix + more, n - 1)], -1)
            by = np.argsort((held[open_] << np.int64(32)) + (after + 1), kind="stable")
            suffix, group, after = suffix[by], held[open_][by], after[by]
            self.order = self.order.copy()
            self.order[open_] = suffix
            first = np.ones(len(open_), bool)
            first[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
            rank = rank.copy()
            rank[suffix] = open_[np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))]
            more *= 2
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.common = np.zeros(n, np.int64)  # with the suffix before in order
        same = np.flatnonzero(x[self.order[1:]] == x[self.order[:-1]]) + 1
        self.common[same] = self.ahead(self.order[same], self.order[same - 1])
        # least value of common over 2^k places, to find intervals
        self.least = [self.common]
        while 2 << (len(self.least) - 1) <= n and self.least[-1].any():
            step, low = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(low[: len(low) - step], low[step:]))

    @staticmethod
    def _ranked(order: np.ndarray, at: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
        first = np.ones(len(order), bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.maximum.accumulate(np.where(first, at, 0))
        return rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and j on."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i + total, j + total
            inside = (a < self.n) & (b < self.n)
            same = inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)]) & (i != j)
            total += same.astype(np.int64) << k
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree that end at i and j."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - total - (1 << k) + 1, j - total - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            same = inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)])
            total += same.astype(np.int64) << k
        return total

    def interval(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, in order, of the suffixes that agree with
        suffix i in ``depth`` words."""
        low, high = self.place[i].copy(), self.place[i].copy()
        for k in range(len(self.least) - 1, -1, -1):
            held, step = self.least[k], 1 << k
            at = low - step + 1
            fits = (at > 0) & (low > 0)
            fits &= held[np.where(fits, at, 0)] >= depth
            low -= fits * step
            at = high + 1
            fits = at + step <= self.n
            fits &= held[np.where(fits, at, 0)] >= depth
            high += fits * step
        return low, high

    def earlier(self) -> np.ndarray:
        """For each place the longest stretch from it that also starts earlier."""
        longest = np.zeros(self.n, np.int64)
        # places next to each other that begin with one word
        tied = np.concatenate((self.common > 0, [False]))
        for turned in (False, True):
            near = self.order[::-1] if turned else self.order
            after = tied[1:][::-1] if turned else tied[:-1]
            # the nearest suffix before, in order, that starts further left
            back = np.concatenate((np.where(after, np.arange(-1, self.n - 1), -1), [-1]))
            wrong = np.flatnonzero(after)
            while len(wrong := wrong[(back[wrong] >= 0) & (near[back[wrong]] > near[wrong])]):
                back[wrong] = back[back[wrong]]
            at = np.flatnonzero(back[:-1] >= 0)
            i, j = near[at], near[back[at]]
            longest[i] = np.maximum(longest[i], self.ahead(i, j))
        return longest


def primitive(tree: Suffixes, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the halves of squares do not repeat themselves."""
    good, left = np.ones(len(start), bool), half.copy()
    prime = 2
    while (left > 1).any():
        if prime * prime > left.max():  # what is left are primes
            factor = np.where(left > 1, left, 0)
            left = np.ones_like(left)
        else:
            factor = np.where(left % prime == 0, prime, 0)
            while (deeper := left % prime == 0).any():
                left = np.where(deeper, left // prime, left)
            prime += 1
        at = np.flatnonzero((factor > 0) & good)
        if len(at):
            part = half[at] // factor[at]
            good[at] = tree.ahead(start[at], start[at] + part) < 2 * half[at] - part
    return good


def leftmost(tree: Suffixes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of primitive squares, the leftmost of each kind among them."""
    longest = tree.earlier()
    opens, free = np.ones(tree.n, bool), 0
    for i in np.flatnonzero(longest > 1).tolist():
        if i >= free:
            free = i + int(longest[i])
            opens[i + 1 : free] = False
    h = np.flatnonzero(opens)
    document = np.searchsorted(bounds, h, "right")
    end = bounds[document]
    h1 = np.minimum(np.concatenate((h[1:], [tree.n])), end)
    size = h1 - h
    later = np.concatenate((np.where(document[1:] == document[:-1], size[1:], 0), [0]))
    out = []
    # centre and start within the block: about the border after it
    row, k = spread(size)
    k += 1
    q = h1[row] - k
    ok = (h1[row] < end[row]) & (tree.x[np.minimum(h1[row], tree.n - 1)] == tree.x[q])
    row, k, q = row[ok], k[ok], q[ok]
    fore, back = tree.ahead(h1[row], q), tree.behind(h1[row] - 1, q - 1)
    ok = fore + back >= k
    out.append((np.maximum(q - back, q - k + 1)[ok], k[ok]))
    # centre in the block, start before it: about the border before it
    row, k = spread(size + later)
    k += 1
    q = h[row] + k
    ok = (q < end[row]) & (tree.x[h[row]] == tree.x[np.minimum(q, tree.n - 1)])
    row, k, q = row[ok], k[ok], q[ok]
    fore, back = tree.ahead(h[row], q), tree.behind(h[row] - 1, q - 1)
    ok = fore + back >= k
    out.append((np.maximum(h[row] - back, h[row] - k + 1)[ok], k[ok]))
    start, half = (np.concatenate(x) for x in zip(*out))
    good = primitive(tree, start, half)
    return start[good], half[good]


def vocabulary(tree: Suffixes, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, half) of each different square, from the
    leftmost ones by suffix-link walks."""
    marked, found = set(), []
    while len(start):
        # as far as the text itself goes on, or all turns are made, each next
        # place is known to be in the tree
        further = np.minimum(tree.ahead(start, start + half) - half, half - 1)
        row, turn = spread(further + 1)
        here, width = start[row] + turn, half[row]
        low, high = tree.interval(here, 2 * width)
        fresh = np.zeros(len(here), bool)
        for i, key in enumerate(zip(low.tolist(), width.tolist())):
            if key not in marked:
                marked.add(key)
                fresh[i] = True
        found.append((low[fresh], high[fresh], width[fresh]))
        goes = (turn == further[row]) & fresh & (turn < width - 1)
        start, half = here[goes], width[goes]
        # the suffix link, and the branch that goes on with the first word
        word, depth = tree.x[start], 2 * half - 1
        low, high = tree.interval(np.minimum(start + 1, tree.n - 1), depth)
        top = high + 1
        value = lambda at: np.where(tree.order[at] + depth < tree.n, tree.x[np.minimum(tree.order[at] + depth, tree.n - 1)], -1)  # noqa: E731, B023
        while (going := low < top).any():  # the first with that word or a greater one
            middle = np.where(going, (low + top) // 2, np.minimum(low, tree.n - 1))
            less = value(middle) < word
            low = np.where(going & less, middle + 1, low)
            top = np.where(going & ~less, middle, top)
        here = np.minimum(low, tree.n - 1)
        goes = (low <= high) & (value(here) == word)
        start, half = tree.order[here][goes], half[goes]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def runs_of(x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions of two periods or
    more, in a sequence whose documents share no value, by period and start."""
    if not len(x):
        return (np.zeros(0, np.int64),) * 3
    tree = Suffixes(x)
    low, high, half = vocabulary(tree, *leftmost(tree, bounds))
    row, inside = spread(high - low + 1)
    at, half = tree.order[low[row] + inside], half[row]
    by = np.lexsort((at, half))
    at, half = at[by], half[by]
    first = np.ones(len(at), bool)
    first[1:] = (half[1:] != half[:-1]) | (at[1:] != at[:-1] + 1)
    opens = np.flatnonzero(first)
    closes = np.concatenate((opens[1:], [len(at)])) - 1 if len(opens) else opens
    return at[opens], at[closes] - at[opens] + 2 * half[opens], half[opens]


def altered(words: np.ndarray, checks: list[int | None]) -> np.ndarray:
    """For each word of each document the number of the word that takes its
    place: itself, or one of a repeated stretch."""
    row, place = spread(words)
    for d, h in enumerate(checks):
        n = int(words[d])
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a, at = g % n, int(words[:d].sum())
            p = 1 + (n - a) // (3 + g % 8)
            place[at + a : at + n] = a + np.arange(n - a) % p
    return place


def find_runs(texts: pa.Array, checks: list[int | None]) -> list[tuple]:
    """Per document: the runs (start, length, period) by start and period, and
    the hash of the words that collapsing them keeps."""
    data, offsets = utf8(texts)
    starts, ends = word_bounds(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    counts, sizes = np.diff(bounds), ends - starts
    take = altered(counts, checks) + np.repeat(bounds[:-1], counts)
    # words as numbers: the same one for equal bytes
    row, inside = spread(sizes)
    letters = data[starts[row] + inside]
    cuts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)])
    codes = np.asarray(plain.dictionary_encode().indices, np.int64)[take]
    key = (np.repeat(np.arange(len(counts)), counts) << np.int64(32)) + codes
    _, x = np.unique(key, return_inverse=True)
    start, length, period = runs_of(x, bounds)
    kept = length >= np.maximum(LEAST, EXPONENT * period)
    start, length, period = start[kept], length[kept], period[kept]
    drop = np.zeros(len(x) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    stays = np.cumsum(drop[:-1]) == 0
    document = np.searchsorted(bounds, start, "right") - 1
    by = np.lexsort((period, start))
    start, length, period, document = start[by], length[by], period[by], document[by]
    # the words that stay, each followed by a space
    held = take[stays]
    row, inside = spread(sizes[held] + 1)
    text, solid = np.full(len(row), 32, np.uint8), inside < sizes[held][row]
    text[solid] = data[(starts[held][row] + inside)[solid]]
    text = text.tobytes()
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(stays)))[bounds]
    places = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes[held] + 1)))[before].tolist()
    edges, out = np.searchsorted(document, np.arange(len(counts) + 1)).tolist(), []
    for d, first in enumerate(bounds[:-1].tolist()):
        these = slice(edges[d], edges[d + 1])
        runs = list(zip((start[these] - first).tolist(), length[these].tolist(), period[these].tolist()))
        out.append((runs, sha256(text[places[d] : max(places[d], places[d + 1] - 1)]).hexdigest()))
    return out


RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every row, its longest one, and hashes of all runs and of
    the text without their repetitions."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for name, (runs, text) in zip(part.column(0).to_pylist(), find_runs(part.column(1), part.column(2).to_pylist())):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rows.append((name, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha256(listed.encode()).hexdigest(), text))
                names = [field.split()[0] for field in RESULT.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return rows.withColumn("check", F.crc32(F.col("doc_id").cast("string"))).mapInArrow(work, RESULT)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """The periodic runs of every document."""
    return periodic_runs(table(spark, sf_dir, "documents"))
