"""Quality rules: gradient-boosted trees over statistics of a document.

Each text is measured as a whole (``FEATURES``).  Trees are boosted in numpy on
the log loss of ``quality`` labels, level by level over histograms of quantile
bins.  Where more of a statistic can only be worse (``FALLING``), a split must
give its upper side the lower value, and the values below it stay on their side
of the middle, so the score never rises with it.  All trees lie in flat arrays
of nodes; scoring follows them for all rows and trees of a batch at once.

A document goes if the base rules fail it (too few words, too many repeated) or
if its score is below THRESHOLD.  The trees are fitted on a sample of at most
ROWS labelled rows of either label (as the documented bound) that are not held
out; rows weigh by the inverse of the share taken.

A null or empty text has no words and fails the base rules.  Without labels of
both kinds there are no trees: the score is null and the base rules decide.
Each row is judged by itself, so repeated rows and null ids give rows of their
own; ids with contradicting labels teach nothing.  An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import sampling
from hourcast.llm.common import narrow, remainder, ship
from hourcast.llm.periodic import Numbers

FOLDS, HELD_OUT = 4, 2
#: Rows of either label that the trees are fitted on.
ROWS = 4000
#: The base rules: words at least, words of a window, percent of repeated words at most.
WORDS, WINDOW, REPEATED = 20, 8, 30
THRESHOLD = 0.5
TREES, DEPTH, BINS, RATE, SHRINK, LIGHT = 60, 4, 64, 0.2, 1.0, 5.0

FEATURES = (
    "log_words",
    "word_length",
    "symbols_per_word",
    "repeated_lines",
    "repeated_words",
    "words_as_before",
    "most_frequent_word",
    "distinct_words",
    "digits",
    "capitals",
    "marks_per_word",
    "closing_marks_per_word",
    "beyond_ascii",
    "log_words_per_line",
)
#: Statistics that the score never rises with.
FALLING = ("symbols_per_word", "repeated_lines", "repeated_words", "words_as_before")

# kinds of bytes, summed up by one count
BLANK, INNER, SYMBOL, DIGIT, CAPITAL, SMALL, CLOSING, MARK, BEYOND = range(9)
KIND = np.full(256, MARK, np.int64)
KIND[128:192], KIND[192:] = INNER, BEYOND  # the bytes of a character behind its first, and its first
for kind, characters in ((BLANK, b" \t\n\x0b\x0c\r"), (SYMBOL, b"#*$%&|<>"), (DIGIT, b"0123456789"), (CLOSING, b".!?")):
    KIND[list(characters)] = kind
KIND[65:91], KIND[97:123] = CAPITAL, SMALL


def repeated(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words (a power of two) found twice or more."""
    if len(numbers) < window:
        return 0
    ranks, size = numbers, 1
    while size < window:
        pairs = ranks[: len(ranks) - size] * (len(numbers) + 1) + ranks[size:]
        _, ranks, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(ranks):
            return 0  # no run of this size is found twice, so no longer one is
        size *= 2
    edges = np.zeros(len(numbers) + 1, np.int64)
    twice = np.flatnonzero(counts[ranks] > 1)
    edges[twice] += 1
    np.subtract.at(edges, twice + window, 1)
    return int((np.cumsum(edges) > 0).sum())


def measured(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """(words, code points in them, symbols, repeated lines, repeated words) and FEATURES of a text in UTF-8."""
    kinds = np.bincount(KIND[np.frombuffer(text, np.uint8)], minlength=9)
    words = text.split()  # bytes split at U+0009 to U+000D and blanks alone
    n = len(words)
    letters = int(kinds.sum() - kinds[BLANK] - kinds[INNER])
    lines = [line for line in text.split(b"\n") if line.strip()]
    again = len(lines) - len(set(lines))
    number = Numbers()
    numbers = np.fromiter(map(number.__getitem__, words), np.int64, n)
    base = (n, letters, int(kinds[SYMBOL]), again, repeated(numbers))
    a_word, a_letter = 1 / max(1, n), 1 / max(1, letters)
    features = [
        np.log1p(n),
        letters * a_word,
        base[2] * a_word,
        again / max(1, len(lines)),
        base[4] * a_word,
        sum(map(eq, words, words[1:])) * a_word,
        (int(np.bincount(numbers).max()) if n else 0) * a_word,
        len(number) * a_word,
        kinds[DIGIT] * a_letter,
        kinds[CAPITAL] * a_letter,
        kinds[MARK] * a_word,
        kinds[CLOSING] * a_word,
        kinds[BEYOND] * a_letter,
        np.log1p(n / max(1, len(lines))),
    ]
    return base, features


def all_measured(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of counts and one of features for each text; null is empty."""
    got = [measured(t.as_py() or b"") for t in column.cast(pa.large_binary())]
    return np.array([b for b, _ in got], np.int64).reshape(-1, 5), np.array([f for _, f in got], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """All nodes of all trees: a row goes to ``left`` or, above ``threshold``, to the node behind it; a leaf is its own left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = self.left[at] + (x[row, self.feature[at]] > self.threshold[at])
        return self.start + self.value[at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x), -500, 500)))


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    """The borders of each feature's bins, between values that occur."""
    out = []
    for column in x.T:
        values = np.unique(column)
        middles = (values[1:] + values[:-1]) / 2
        out.append(middles if len(middles) < BINS else np.unique(middles[np.linspace(0, len(middles) - 1, BINS - 1).astype(int)]))
    return out


def _tree(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, falling: np.ndarray) -> tuple[list[list], np.ndarray]:
    """Nodes [feature, threshold, left, value] of one tree, and each row's value."""
    features = binned.shape[1]
    nodes: list[list] = [[0, np.inf, 0, 0.0]]
    bounds = {0: (-np.inf, np.inf)}
    at = np.zeros(len(binned), np.int64)
    best = lambda g, h: -g / (h + SHRINK)
    gain = lambda g, h, v: -(g * v + 0.5 * (h + SHRINK) * v * v)
    level = [0]
    for depth in range(DEPTH + 1):
        # sums of each (node of the level, feature, bin)
        place = np.full(len(nodes), -1)
        place[level] = np.arange(len(level))
        own = np.flatnonzero(place[at] >= 0)
        cell = ((place[at[own]][:, None] * features + np.arange(features)) * BINS + binned[own]).ravel()
        g, h = (np.bincount(cell, np.repeat(s[own], features), len(level) * features * BINS).reshape(-1, features, BINS) for s in (gradient, weight))
        below = []
        for k, node in enumerate(level):
            low, high = bounds[node]
            sums = g[k, 0].sum(), h[k, 0].sum()
            nodes[node][3] = value = float(np.clip(best(*sums), low, high))
            gl, hl = g[k].cumsum(axis=1), h[k].cumsum(axis=1)
            gr, hr = sums[0] - gl, sums[1] - hl
            vl, vr = np.clip(best(gl, hl), low, high), np.clip(best(gr, hr), low, high)
            won = gain(gl, hl, vl) + gain(gr, hr, vr) - gain(*sums, value)
            won[(hl < LIGHT) | (hr < LIGHT) | (falling[:, None] & (vl < vr))] = -np.inf
            f, b = np.unravel_index(won.argmax(), won.shape)
            if depth == DEPTH or won[f, b] <= 1e-6 or b >= len(cuts[f]):
                nodes[node][2] = node
                continue
            left = len(nodes)
            nodes[node][:3] = [int(f), float(cuts[f][b]), left]
            nodes += [[0, np.inf, left, 0.0], [0, np.inf, left + 1, 0.0]]
            middle = (vl[f, b] + vr[f, b]) / 2
            bounds[left], bounds[left + 1] = ((middle, high), (low, middle)) if falling[f] else ((low, high), (low, high))
            rows = np.flatnonzero(at == node)
            at[rows] = left + (binned[rows, f] > b)
            below += [left, left + 1]
        level = below
        if not level:
            break
    return nodes, np.array([n[3] for n in nodes])[at]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Boosted trees for the log-odds of label 1."""
    cuts = _cuts(x)
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    falling = np.isin(FEATURES, FALLING)
    weight = weight / weight.mean()
    p = float((weight * y).sum() / weight.sum())
    start = float(np.log(p / (1 - p)))
    odds, roots, nodes = np.full(len(x), start), [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        tree, value = _tree(binned, cuts, weight * (p - y), weight * p * (1 - p), falling)
        odds += RATE * value
        roots.append(len(nodes))
        nodes += [[f, t, left + roots[-1], RATE * v] for f, t, left, v in tree]
    feature, threshold, left, value = zip(*nodes, strict=True)
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(value), np.array(roots), start)


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Trees | None:
    """The trees of the rows that are not held out, or None without labels of both kinds."""
    ship(spark)
    sample, share = sampling.texts(narrow(docs), labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT), "quality", rows)
    if len(share) < 2:
        return None

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = all_measured(batch.column("text"))[1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("quality"), pa.array([v.tobytes() for v in x], pa.binary())], names=["row", "quality", "x"])

    got = sample.select("row", "quality", "text").mapInArrow(features, "row long, quality int, x binary").toPandas().sort_values("row")
    y = got["quality"].to_numpy(np.float64)
    x = np.frombuffer(b"".join(got["x"]), np.float64).reshape(len(got), -1)
    return fit(x, y, np.array([1 / share[int(q)] for q in y]))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])


def judged(spark: SparkSession, docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Counts, verdicts and scores of all rows of ``docs`` (doc_id, text)."""
    ship(spark)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, x = all_measured(batch.column("text"))
            failed = (base[:, 0] < WORDS) | (100 * base[:, 4] > REPEATED * base[:, 0])
            score = pa.array(trees.scores(x)) if trees else pa.nulls(len(base), pa.float64())
            kept = ~failed & (trees.scores(x) >= THRESHOLD) if trees else ~failed
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, base.T), pa.array(failed), pa.array(kept), score], schema=OUT)

    kinds = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "base_failed boolean, kept boolean, score double"])
    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(each, kinds)


def op11_monotone_trees(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(spark, docs, learned(spark, docs, labels))
