"""Periodic runs of words, caught online over completed power-of-two blocks.

Words are appended to a stream.  On each level the completed blocks of 2^k
words carry a catcher; of an appended word's suffix of 2^k words only two
catchers of a level are far enough behind (2^(k+1)-1 to 2^(k+2)-2 words) to
tell a square whose period is in that range, since such a period holds a whole
block.  A suffix that equals the block of a catcher is a hit; hits of one
period on neighbouring blocks are squares of one run, so they merge.  When the
next block no longer fits, the run is compared word by word to find its ends.
Hashes only choose what is compared, so every run is exact.

Each document is its own task's work: texts are taken as whole words, many
documents are appended to one stream with a mark of its own between any two,
and a long text is a stream of its own.

A null or empty text has no words, no runs and the hash of nothing.  A null id
leaves its text as it is.  Repeated rows and null ids give rows of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hourcast.llm.common import ship
from hourcast.llm.words import mix

#: A run has so many periods and so many words at least.
EXPONENT, LEAST = 4, 6
#: Words of a stream that holds several documents, and words appended at once.
STREAM, CHUNK = 100_000, 1 << 16
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

Runs = list[tuple[int, int, int]]


class Numbers(dict):
    """A number for each word, given when it is first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Catchers:
    """The runs of a stream of numbers (words), found while they are appended."""

    def __init__(self, exponent: int = EXPONENT, least: int = LEAST):
        self.exponent, self.least = exponent, least
        self.x = np.zeros(0, np.int64)
        #: Of each level: the hash of the block that starts at each place, and the
        #: unfinished chains of hits as columns (period, first block, last block).
        self.hashes: list[np.ndarray] = []
        self.open: list[np.ndarray] = []
        #: Of each period the runs (start, end) in order.
        self.known: dict[int, Runs] = {}

    def append(self, words: np.ndarray, longest: int | None = None) -> None:
        """Advances the suffix comparisons of all levels; no run is longer than ``longest``."""
        self.x = np.concatenate([self.x, words])
        end = len(self.x)
        level, size = 0, 1
        while self.exponent * (2 * size - 1) <= min(end, longest or end):
            if level == len(self.hashes):
                self.hashes.append(np.zeros(0, np.uint64))
                self.open.append(np.zeros((3, 0), np.int64))
            first = len(self.hashes[level])
            self._hash(level, size, first, end - size + 1)
            self._compare(level, size, first, end)
            level, size = level + 1, 2 * size

    def _hash(self, level: int, size: int, first: int, last: int) -> None:
        """Hashes of the blocks of a level that are complete now."""
        if level == 0:
            new = mix(self.x[first:last].astype(np.uint64) + np.uint64(1))
        else:
            below, half = self.hashes[level - 1], size // 2
            new = below[first:last] * _LEFT + (below[first + half : last + half] ^ _RIGHT) * _RIGHT
            new ^= new >> np.uint64(31)
        self.hashes[level] = np.concatenate([self.hashes[level], new])

    def _compare(self, level: int, size: int, first: int, end: int) -> None:
        """Compares the new suffixes with the two catchers in reach and merges the hits."""
        h, chains = self.hashes[level], [self.open[level]]
        for nearest in (2 * size - 1, 3 * size - 1):
            at = np.arange(max(first, nearest), len(h))
            catcher = (at - nearest) // size * size
            hit = np.flatnonzero(h[at] == h[catcher])
            if len(hit):
                chains.append(np.array([at[hit] - catcher[hit], catcher[hit], catcher[hit]]))
        chain = np.concatenate(chains, axis=1) if len(chains) > 1 else chains[0]
        if not chain.shape[1]:
            return
        period, start, last = chain[:, np.lexsort((chain[1], chain[0]))]
        begins = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (start[1:] != last[:-1] + size)))
        period, start, last = period[begins], start[begins], last[np.append(begins[1:], len(last)) - 1]
        unfinished = last + 2 * size + period > end
        self.open[level] = np.array([period[unfinished], start[unfinished], last[unfinished]])
        self._catch(size, period[~unfinished], start[~unfinished], last[~unfinished])

    def _matches(self, period):
        """The equal words, one period apart, that the shortest run of a period has."""
        return np.maximum(self.least - period, (self.exponent - 1) * period)

    def _catch(self, size: int, period: np.ndarray, start: np.ndarray, last: np.ndarray) -> None:
        """Finds the ends of the runs of finished chains that have the blocks of a whole run."""
        long = (last - start) // size + 1 >= np.maximum(1, (self._matches(period) - size + 1) // size)
        for p, a, z in zip(period[long].tolist(), start[long].tolist(), (last[long] + size).tolist(), strict=True):
            if self._covered(p, a, z + p):
                continue
            # neighbouring blocks don't fit, so the ends are at most two blocks away
            low, high = max(0, a - 2 * size), min(len(self.x) - p, z + 2 * size)
            same = self.x[low:high] == self.x[low + p : high + p]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]))) + low
            for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                held, run = self.known.setdefault(p, []), (b, e + p)
                if b < z and e > a and e - b >= self._matches(p) and run not in held[-2:]:
                    insort(held, run)

    def _covered(self, period: int, start: int, end: int) -> bool:
        """Whether a known run of a period that divides this one holds the stretch."""
        for q, held in self.known.items():
            if period % q == 0 and held and (k := bisect_right(held, (start, len(self.x)))) and held[k - 1][1] >= end:
                return True
        return False

    def runs(self) -> Runs:
        """(start, length, period) of all runs of the words so far, by start and period."""
        for level, (period, start, last) in enumerate(self.open):
            self._catch(1 << level, period, start, last)
        smallest: dict[tuple[int, int], int] = {}
        for p in sorted(self.known, reverse=True):
            smallest |= dict.fromkeys(self.known[p], p)  # a stretch has its smallest period
        return sorted((a, e - a, p) for (a, e), p in smallest.items())


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The places that the words of a document are taken from, or None if it stays as it is."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def stream_runs(documents: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST, chunk: int = CHUNK) -> list[Runs]:
    """The runs of each document (an array of word numbers), all appended to one stream."""
    longest = max(map(len, documents), default=0)
    if longest < least:
        return [[] for _ in documents]
    marked = [part for k, d in enumerate(documents) for part in (d, np.array([-2 - k]))]  # a mark equals no word and no other mark
    whole = np.concatenate(marked)
    catchers = Catchers(exponent, least)
    for a in range(0, len(whole), chunk):
        catchers.append(whole[a : a + chunk], longest)
    begins = np.cumsum([0] + [len(d) + 1 for d in documents])
    out: list[Runs] = [[] for _ in documents]
    for start, length, period in catchers.runs():
        k = bisect_right(begins, start) - 1
        out[k].append((start - int(begins[k]), length, period))
    return out


def collapsed(words: list[bytes], runs: Runs) -> bytes:
    """The words but those that a run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def streams(doc_ids: list[int | None], texts: Iterator[bytes | None]) -> Iterator[tuple[list[int | None], list[list[bytes]], list[np.ndarray]]]:
    """Documents in streams of about STREAM words: ids, words and their numbers."""
    ids, held, numbered, number, total = [], [], [], Numbers(), 0
    for doc_id, text in zip(doc_ids, texts, strict=True):
        words = (text or b"").split()  # bytes split at U+0009 to U+000D and blanks alone
        own = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        if (taken := planted(doc_id, len(words))) is not None:
            words, own = [words[i] for i in taken.tolist()], own[taken]
        ids.append(doc_id)
        held.append(words)
        numbered.append(own)
        total += len(words)
        if total >= STREAM:
            yield ids, held, numbered
            ids, held, numbered, number, total = [], [], [], Numbers(), 0
    if ids:
        yield ids, held, numbered


OUT = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
)


def _row(doc_id: int | None, words: list[bytes], runs: Runs) -> tuple:
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{a},{n},{p}\n" for a, n, p in runs).encode()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha256(listed).hexdigest(), sha256(collapsed(words, runs)).hexdigest())


def op13_periodic_runs(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Figures and digests of the runs of every document, and of its text without their repeats."""
    ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text").cast(pa.large_binary()))
            for ids, held, numbered in streams(batch.column("doc_id").to_pylist(), texts):
                rows = list(map(_row, ids, held, stream_runs(numbered)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)

    kinds = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(each, kinds)
