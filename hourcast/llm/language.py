"""Language identification by a byte convolutional network.

The network sees windows of BYTES bytes (A-Z and the Latin-1 capitals in
lower case, 0 behind the end).  Filters of 2, 3 and 4 bytes give, at each
place, the sum of one number for each byte under the filter, which is what a
convolution of one-hot bytes is; each filter keeps its maximum over the window;
a softmax over the kept values names the language.  It is trained in numpy on
windows of a sample of labelled rows: ROWS rows over all languages (one at
least of every language that occurs) and WINDOWS windows of each are the bounds
of what the driver gets.

A document is cut into windows that overlap by one less than the widest
filter, the last one ending with the text; all of a text is read.  The
probabilities are the means over its windows.

A null text and one without a letter are ``und`` with score 0, and so is all
text when no row is labelled.  Each row is judged by itself, so repeated rows
and null ids give rows of their own (a null id counts as the text '' in the
split).  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import sampling, words
from hourcast.llm.common import narrow, remainder, ship

FOLDS = 5
#: Bounds of the sample: rows over all languages, windows of a row.
ROWS, WINDOWS = 3000, 4
BYTES, WIDTHS, FILTERS = 128, (2, 3, 4), 16
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Windows judged at once.
BLOCK = 512
#: A letter: of what a word may hold neither a digit nor another number (a half, a square, a Roman twelve).
NUMBERS = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Nl", "No"))
LETTER = re.compile(rf"[^\W\d_{re.escape(NUMBERS)}]")


def prepared(data: np.ndarray) -> np.ndarray:
    """Bytes in lower case: A-Z, and the capitals that UTF-8 writes with C3."""
    out = words.LOWER[data]
    capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    out[capital + 1] += 32
    return out


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end of its text, text) of each window."""
    size, step = np.diff(bounds), BYTES - max(WIDTHS) + 1
    n = np.maximum(1, -(-(size - BYTES) // step) + 1)
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    start = bounds[:-1][text] + np.minimum(k * step, np.maximum(0, size[text] - BYTES))
    return start, bounds[1:][text], text


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(BYTES)
    inside = at < end[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0) if len(data) else np.zeros(at.shape, np.uint8)


@dataclass
class Network:
    """Filters (a table of 256 rows for each place under each filter), weights and bias."""

    languages: list[str]
    tables: list[list[np.ndarray]]
    weights: np.ndarray
    bias: np.ndarray

    def conv(self, tables: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        n = BYTES - len(tables) + 1
        out = tables[0].take(x[:, :n], axis=0)
        for k, t in enumerate(tables[1:], 1):
            out += t.take(x[:, k : k + n], axis=0)
        return out

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The maximum of each filter and where it is."""
        maps = [self.conv(t, x) for t in self.tables]
        where = [m.argmax(axis=1) for m in maps]
        return np.concatenate([np.take_along_axis(m, w[:, None, :], axis=1)[:, 0] for m, w in zip(maps, where, strict=True)], axis=1), where

    def kept(self, x: np.ndarray) -> np.ndarray:
        """As ``pooled`` without the places; windows run along the columns, so each step is one long row operation."""
        x = np.ascontiguousarray(x.T)
        out = []
        for tables in self.tables:
            best = None
            for at in range(BYTES - len(tables) + 1):
                m = tables[0].take(x[at], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    m += t.take(x[at + k], axis=0)
                best = m if best is None else np.maximum(best, m, out=best)
            out.append(best)
        return np.concatenate(out, axis=1)

    def probabilities(self, kept: np.ndarray) -> np.ndarray:
        z = np.maximum(kept, 0) @ self.weights + self.bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Network:
    """Adam on the cross entropy; a filter's gradient goes to the bytes at its maximum alone."""
    rng = np.random.default_rng(1)
    normal = lambda shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(languages, [[normal((256, FILTERS), 0.3) for _ in range(w)] for w in WIDTHS], normal((FILTERS * len(WIDTHS), len(languages)), 0.3), np.zeros(len(languages), np.float32))
    params = [*(t for ts in net.tables for t in ts), net.weights, net.bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            own = order[a : a + BATCH]
            xs, n = x[own], len(own)
            kept, where = net.pooled(xs)
            p = net.probabilities(kept)
            p[np.arange(n), y[own]] -= 1
            p /= n
            active = np.maximum(kept, 0)
            back = (p @ net.weights.T) * (kept > 0)
            grads = []
            for i, tables in enumerate(net.tables):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(len(tables)):
                    byte = xs[np.arange(n)[:, None], where[i] + k].astype(np.int64)
                    flat = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), weights=g.ravel(), minlength=256 * FILTERS)
                    grads.append(flat.reshape(256, FILTERS).astype(np.float32))
            grads += [active.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def train(spark: SparkSession, labelled: DataFrame, rows: int = ROWS) -> Network | None:
    """A network learned from (row, text, lang), or None without labels."""
    ship(spark)
    labelled = labelled.where("text is not null and lang is not null").select("row", "text", "lang")
    n = labelled.select("lang").distinct().count()
    if not n:
        return None
    sample, share = sampling.by_label(labelled.select("row", "lang"), "lang", max(1, rows // n))
    sample = labelled.drop("lang").join(F.broadcast(sample), "row")
    languages = sorted(share)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, bounds in words.runs(batch.column("text")):
                start, end, text = windows(data, bounds)
                count = np.bincount(text, minlength=len(bounds) - 1)
                begin = np.cumsum(count) - count
                chosen = np.unique(begin[:, None] + (np.arange(WINDOWS)[None, :] * count[:, None]) // WINDOWS)
                x = cut(prepared(data), start[chosen], end[chosen])
                keys = batch.column("lang").take(pa.array(first + text[chosen]))
                order = batch.column("row").take(pa.array(first + text[chosen]))
                yield pa.RecordBatch.from_arrays([order, keys, pa.array([r.tobytes() for r in x], pa.binary())], names=["row", "lang", "x"])

    got = sample.select("row", "lang", "text").mapInArrow(some, "row long, lang string, x binary").toPandas().sort_values(["row", "lang", "x"])
    x = np.frombuffer(b"".join(got["x"]), np.uint8).reshape(-1, BYTES)
    return fit(x, np.searchsorted(languages, got["lang"].to_numpy(str)), languages)


OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of (doc_id, held_out, text)."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for first, last, data, bounds in words.runs(texts):
                n = last - first
                lettered = np.array([t is not None and LETTER.search(t) is not None for t in texts.slice(first, n).to_pylist()], bool)
                name, score = np.full(n, "und", object), np.zeros(n)
                if net and lettered.any():
                    low = prepared(data)
                    start, end, text = windows(data, bounds)
                    sums = np.zeros((n, len(net.languages)))
                    for a in range(0, len(start), BLOCK):
                        p = net.probabilities(net.kept(cut(low, start[a : a + BLOCK], end[a : a + BLOCK])))
                        np.add.at(sums, text[a : a + BLOCK], p)
                    mean = sums / np.bincount(text, minlength=n)[:, None]
                    best = mean.argmax(axis=1)
                    name = np.where(lettered, np.array(net.languages, object)[best], name)
                    score = np.where(lettered, np.clip(mean[np.arange(n), best], 0, 1), score)
                keep = lambda c: batch.column(c).slice(first, n)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([keep("doc_id").cast(pa.int64()), keep("held_out"), pa.array(name, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(each, OUT)


def op2_byte_cnn(spark: SparkSession, docs: DataFrame) -> DataFrame:
    d = narrow(docs, "lang").withColumn("held_out", remainder(F.col("doc_id"), FOLDS) == 0)
    return predict(d, train(spark, d.where("not held_out")))
