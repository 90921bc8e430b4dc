"""Quality classifier: random-indexing word vectors and a two-layer network.

Words are runs of letters, of digits and of other marks.  Each also has a
form: letters by case and length, digits by length, marks by their first
characters; and a word that equals the one before counts as a form of
its own.  Every word has an index vector, a few signed ones at places that
its hash gives.  The vector of a word is its index vector plus the normed sum of
the index vectors around it in all documents (random indexing); a word that
stands alone wherever it occurs has its index vector.

A document is the mean of the vectors of its words, the mean over its distinct
words, and the same for forms; a network of two layers, trained in numpy, turns
them into a log-odds, and a temperature fitted on rows kept apart makes them
probabilities.  All words of a text count.

The sums around words are whole numbers, so their order does not matter.  Each
task adds up its own rows', deals them to buckets of 64-bit word hashes, and a
bucket's task writes sorted hashes and their vectors to files in the shared
folder, which workers map.  Labels play no part in this.  The network and the
temperature take about ROWS labelled rows of either label, as their documented
bound; rows weigh by the inverse of the share taken, so scores keep the labels'
own frequencies.

A null or empty text is a document without words and gets a score too.
Without labels the score is 0.5, with one label only its smoothed share; such
a constant judges nothing, so the stage keeps all documents then.
Each row is judged by itself, so repeated rows and null ids give rows of their
own.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import lm, sampling
from hourcast.llm.common import Scratch, fresh, narrow, remainder, ship, table
from hourcast.llm.words import BASE, END, mix

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
#: Rows of either label that the network is fitted on.
ROWS = 2500
SIZE, ONES, AROUND = 64, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 0.003, 1e-4
#: Code points of the texts that are read at once (one text may be longer), and their terms that are added up at once.
CHARS, RUN = 300_000, 50_000
#: Words whose sums a task gathers before it hands them on.
GATHERED = 250_000
#: Bytes of text for each bucket of words; sums that a byte holds.
BUCKET_BYTES, SMALL = 16 << 20, 127

SPACE, LETTER, DIGIT, MARK = range(4)
#: Runs of these are terms.
KINDS = ((LETTER, r"[^\W\d_]+"), (DIGIT, r"\d+"), (SPACE, r"\s+"))
#: Forms: letters by case and length, then digits by length, the form of a term like the one before, then marks by their first characters.
LENGTHS, DIGITS, AGAIN, MARKS = 7, 28, 63, 64
FORM_SEED = np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: its kind, itself in lower case, and 1 for capitals, 2 for small letters."""
    every = "".join("\0" if 0xD800 <= c < 0xE000 else chr(c) for c in range(0x110000))
    kind, lower, case = np.full(len(every), MARK, np.uint8), np.arange(len(every), dtype=np.uint32), np.zeros(len(every), np.uint8)
    for k, pattern in KINDS:
        for m in re.finditer(pattern, every):
            kind[m.start() : m.end()] = k
    for c in np.flatnonzero(kind == LETTER).tolist():
        x = every[c]
        if len(x.lower()) == 1:
            lower[c] = ord(x.lower())
        case[c] = 1 if x.isupper() else 2 if x.islower() else 0
    return kind, lower, case


@lru_cache(maxsize=2)
def powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


@dataclass
class Terms:
    """The terms of some texts, one behind the other: their text, and hashes of them as written, in lower case and of their form."""

    text: np.ndarray
    exact: np.ndarray
    word: np.ndarray
    form: np.ndarray


def terms_of(texts: list[str | None]) -> Terms:
    kinds, lower, cases = tables()
    texts = [t or "" for t in texts]
    code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[code]
    inside = np.flatnonzero(kind != SPACE)
    if not len(inside):
        none = np.zeros(0, np.uint64)
        return Terms(np.zeros(0, np.int64), none, none, none)
    kind, code = kind[inside], code[inside]
    first = np.flatnonzero(np.append(True, (kind[1:] != kind[:-1]) | (np.diff(inside) > 1)))
    size = np.diff(np.append(first, len(inside)))
    place = np.arange(len(inside)) - np.repeat(first, size)
    power = powers(1 << int(size.max()).bit_length())[place]
    end = size.astype(np.uint64) * END

    def hashed(codes: np.ndarray) -> np.ndarray:
        return mix(np.add.reduceat(mix(codes.astype(np.uint64) + np.uint64(1)) * power, first) + end)

    case = cases[code]
    large, small = (np.add.reduceat((case == k).astype(np.int64), first) for k in (1, 2))
    alone = size == 1
    shape = np.select([(large > 0) & (small == 0) & ~alone, (small > 0) & (large == 0), alone | ((large == 1) & (case[first] == 1) & (large + small == size))], [0, 1, 2], 3)
    lead = [np.where(size > k, code[np.minimum(first + k, len(code) - 1)].astype(np.uint64) + np.uint64(1) << np.uint64(21 * k), np.uint64(0)) for k in range(3)]
    own = kind[first]
    form = np.where(own == LETTER, shape * LENGTHS + np.minimum(size // 3, LENGTHS - 1), DIGITS + np.minimum(size, 8)).astype(np.uint64)
    form = np.where(own == MARK, np.uint64(MARKS) + (lead[0] | lead[1] | lead[2]), form)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Terms(np.searchsorted(starts, inside[first], side="right") - 1, hashed(code), hashed(lower[code]), form)


def runs_of(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts, in lists of about CHARS code points."""
    run, n = [], 0
    for text in column:
        run.append(text.as_py())
        n += len(run[-1] or "")
        if n >= CHARS:
            yield run
            run, n = [], 0
    if run:
        yield run


def places(hashes: np.ndarray) -> np.ndarray:
    """Twice the places of each hash's ONES signed ones, plus 1 for those below nought."""
    x = mix(hashes[:, None] + np.arange(1, ONES + 1, dtype=np.uint64) * BASE)
    return ((x >> np.uint64(1)) % np.uint64(SIZE) * np.uint64(2) + (x & np.uint64(1))).astype(np.int64)


def differences(cells: np.ndarray, rows: int) -> np.ndarray:
    """Signed ones at row * 2 * SIZE + place, added up by row."""
    counts = np.bincount(cells.ravel(), minlength=rows * 2 * SIZE).reshape(rows, SIZE, 2)
    return counts[:, :, 0] - counts[:, :, 1]


def index_counts(hashes: np.ndarray) -> np.ndarray:
    """The index vectors, as sums of signed ones."""
    return differences(np.arange(len(hashes))[:, None] * (2 * SIZE) + places(hashes), len(hashes))


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    return (index_counts(hashes) / ONES**0.5).astype(np.float32)


def form_vectors(forms: np.ndarray) -> np.ndarray:
    return index_vectors(mix(forms ^ FORM_SEED))


@lru_cache(maxsize=4096)
def held(root: str, bucket: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """A bucket's sorted keys and vectors: sums that bytes hold, and normed sums; nothing where no word fell into it."""
    try:
        data = lm.get(root, f"words-{bucket}")
    except FileNotFoundError:
        return ()
    small, large = data[:16].view(np.int64).tolist()
    cuts = np.cumsum([16, 8 * small, 8 * large, 4 * SIZE * large, SIZE * small])
    keys, other, normed, sums = (data[a:z] for a, z in zip(cuts, cuts[1:], strict=False))
    return (keys.view("<u8"), sums.view(np.int8).reshape(-1, SIZE)), (other.view("<u8"), normed.view("<f4").reshape(-1, SIZE))


def put_bucket(root: str, bucket: int, keys: np.ndarray, sums: np.ndarray) -> None:
    """Writes what ``held`` reads, in one file; words without neighbours are left out."""
    most = np.maximum(sums.max(axis=1), -sums.min(axis=1))
    small, large = (most > 0) & (most <= SMALL), most > SMALL
    normed = (sums[large] / np.linalg.norm(sums[large], axis=1, keepdims=True)).astype("<f4")
    parts = (np.array([small.sum(), large.sum()]), keys[small], keys[large], normed, sums.astype(np.int8)[small])
    lm.put(root, f"words-{bucket}", np.frombuffer(b"".join(p.tobytes() for p in parts), np.uint8))


@dataclass
class Trained:
    """The files of the sums around words, a bucket each."""

    root: str
    bits: int

    def around(self, words: np.ndarray) -> np.ndarray:
        """The normed sums around each word (sorted hashes), zeros without."""
        out = np.zeros((len(words), SIZE), np.float32)
        to = lm.bucket_of(words, self.bits)
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist() if len(to) else []
        for a, z in zip(cuts, [*cuts[1:], len(to)], strict=True):
            for known, vectors in held(self.root, int(to[a])):
                if len(known):
                    at = np.minimum(np.searchsorted(known, words[a:z]), len(known) - 1)
                    hit = np.flatnonzero(known[at] == words[a:z])
                    found = vectors[at[hit]].astype(np.float32)
                    out[a + hit] = found / np.linalg.norm(found, axis=1, keepdims=True)
        return out

    def vectors(self, words: np.ndarray) -> np.ndarray:
        """The vectors of words (sorted hashes)."""
        return index_vectors(words) + self.around(words)


def pooled(texts: list[str | None], trained: Trained) -> np.ndarray:
    """The features of each text: means over its words and its distinct ones, the same of forms, and three figures."""
    t = terms_of(texts)
    out = np.zeros((len(texts), 4 * SIZE + 3), np.float32)
    if not len(t.text):
        return out
    n = np.bincount(t.text, minlength=len(texts))
    again = np.bincount(t.text[1:][(t.exact[1:] == t.exact[:-1]) & (t.text[1:] == t.text[:-1])], minlength=len(texts))
    # the distinct terms of each text, in the order of the text, so sums are the same in any company
    kinds, exact = np.unique(t.exact, return_inverse=True)
    _, first, count = np.unique(t.text * len(kinds) + exact, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, count = first[order], count[order]
    own = t.text[first]
    distinct = np.bincount(own, minlength=len(texts)) + (again > 0)
    share, one = 1 / np.maximum(n, 1), 1 / np.maximum(distinct, 1)
    full = np.flatnonzero(n)
    begins = np.searchsorted(own, full)
    words, word = np.unique(t.word[first], return_inverse=True)
    vectors = trained.vectors(words)[word]
    out[full, :SIZE] = np.add.reduceat(vectors * (count * share[own]).astype(np.float32)[:, None], begins)
    out[full, SIZE : 2 * SIZE] = np.add.reduceat(vectors, begins) * one[full, None]
    # forms are few: a count of each for each text; the first is that of terms like the one before
    shapes, shape = np.unique(np.append(np.uint64(AGAIN), t.form[first]), return_inverse=True)
    cell, repeat = own * len(shapes) + shape[1:], shape[0]
    often, seen = (np.bincount(cell, v, len(texts) * len(shapes)).reshape(-1, len(shapes)) for v in (count, np.ones(len(count))))
    often[:, repeat] += again
    seen[:, repeat] += again > 0
    for k, counts, part in ((2, often, share), (3, seen, one)):
        row, column = np.nonzero(counts[full])
        at = np.searchsorted(row, np.arange(len(full)))
        out[full, k * SIZE : (k + 1) * SIZE] = np.add.reduceat(form_vectors(shapes)[column] * (counts[full][row, column] * part[full][row])[:, None], at)
    out[full, 4 * SIZE :] = np.stack([np.ones(len(full)), np.log(n[full]), distinct[full] * share[full]], axis=1)
    return out


def near_sums(text: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word (a place in ``at``) the sum of the signed ones (``at``) of the words up to AROUND places before and after it in its text."""
    sums = np.zeros((len(at), SIZE), np.int32)
    for a in range(0, len(word), RUN):
        # pairs whose first word is of this run
        own, local = np.unique(word[a : a + RUN + AROUND], return_inverse=True)
        near = text[a : a + RUN + AROUND]
        centre, other = [], []
        for d in range(1, min(AROUND, len(near) - 1) + 1):
            left, right = local[:-d][:RUN], local[d:][:RUN]
            same = (near[:-d] == near[d:])[:RUN]
            centre += [left[same], right[same]]
            other += [right[same], left[same]]
        if centre:
            cells = np.concatenate(centre)[:, None] * (2 * SIZE) + at[own][np.concatenate(other)]
            sums[own] += differences(cells, len(own)).astype(np.int32)
    return sums


PACKED = "bucket long, keys binary, sums binary"


def contexts(bits: int):
    """A mapInArrow function: the sums of the index rows around each word of a task's rows, packed by bucket."""

    def deal(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        to = lm.bucket_of(keys, bits)
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
        rows = []
        for a, z in zip(cuts, [*cuts[1:], len(to)], strict=True):
            own = sums[a:z]
            small = ((own << 1) ^ (own >> 31)).astype("<u4")  # small numbers of either sign have high bytes of nought
            rows.append((int(to[a]), lm.pack(lm.planes(keys[a:z])), squeezed(small.view(np.uint8).reshape(-1, 4).T.copy())))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "keys", "sums"])

    def together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.unique(np.concatenate([k for k, _ in parts]))
        sums = np.zeros((len(keys), SIZE), np.int32)
        for own, more in parts:  # the keys of a part are distinct
            sums[np.searchsorted(keys, own)] += more
        return keys, sums

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for run in runs_of(batch.column("text")):
                t = terms_of(run)
                if not len(t.word):
                    continue
                words, word = np.unique(t.word, return_inverse=True)
                parts.append((words, near_sums(t.text, word, places(words))))
                if sum(len(k) for k, _ in parts) > GATHERED:
                    parts = [together(parts)]
                    if len(parts[0][0]) > GATHERED // 2:
                        yield deal(*parts.pop())
        if parts:
            yield deal(*together(parts))

    return each


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True) + values.nbytes.to_bytes(8, "little")


def spread(packed: bytes) -> np.ndarray:
    size = int.from_bytes(packed[-8:], "little")
    small = np.frombuffer(pa.decompress(packed[:-8], size, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return (small >> 1).astype(np.int32).reshape(-1, SIZE) ^ -(small & 1).astype(np.int32).reshape(-1, SIZE)


def added(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's distinct keys, sorted, and the sums around them; one part at a time, so the parts never lie side by side."""
    parts = [lm.from_planes(x) for x in pdf["keys"]]
    keys = np.unique(np.concatenate(parts))
    sums, most = np.zeros((len(keys), SIZE), np.int32), 0
    for own, packed in zip(parts, pdf["sums"], strict=True):  # the keys of a part are distinct
        more = spread(packed)
        most += max(int(more.max(initial=0)), -int(more.min(initial=0)))
        if most > np.iinfo(np.int32).max and sums.dtype == np.int32:
            sums = sums.astype(np.int64)
        sums[np.searchsorted(keys, own)] += more
    return keys, sums


def trained(docs: DataFrame, s: Scratch) -> Trained:
    """Vectors of all words of ``docs`` (text), in files of the scratch folder."""
    root = s.root
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (-(-size // BUCKET_BYTES) - 1).bit_length())

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        keys, sums = added(pdf)
        put_bucket(root, b, keys, sums)
        return pd.DataFrame({"bucket": [b], "n": [len(keys)]})

    dealt = docs.select("text").mapInArrow(contexts(bits), PACKED)
    s.keep(dealt.groupBy("bucket").applyInPandas(write, "bucket long, n long"), "buckets")
    return Trained(root, bits)


@dataclass
class Network:
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.first + self.bias, 0) @ self.second[:-1] + self.second[-1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.odds(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Trained on four fifths of the rows; the rest gives the temperature."""
    rng = np.random.default_rng(1)
    order = rng.permutation(len(x))
    aside, own = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    net = Network(rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN + 1), mean, scale)
    params = [net.first, net.bias, net.second]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        for a in range(0, len(own), BATCH):
            rows = rng.permutation(own)[:BATCH] if a == 0 else own[a : a + BATCH]
            z = (x[rows] - mean) / scale
            h = z @ net.first + net.bias
            active = np.maximum(h, 0)
            p = 1 / (1 + np.exp(-np.clip(active @ net.second[:-1] + net.second[-1], -500, 500)))
            d = (p - y[rows]) * weight[rows] / weight[rows].sum()
            back = np.outer(d, net.second[:-1]) * (h > 0)
            grads = [z.T @ back + DECAY * net.first, back.sum(axis=0), np.append(active.T @ d, d.sum()) + DECAY * net.second]
            step += 1
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        own = rng.permutation(own)
    if len(aside):
        odds = net.odds(x[aside])
        loss = lambda t: float((weight[aside] * np.logaddexp(0, np.where(y[aside] == 1, -odds, odds) / t)).sum())
        net.temperature = min(np.geomspace(0.25, 16, 61).tolist(), key=loss)
    return net


@dataclass
class Model:
    words: Trained | None
    net: Network | None
    constant: float


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Words from all of ``docs`` (row, doc_id, text), the network from the rows whose id ``labels`` (doc_id, quality) names."""
    rows, share = sampling.texts(docs, labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "quality", ROWS)
    s = Scratch(spark, "quality")
    rows = s.keep(rows, "sample")  # 2 x ROWS at most
    if len(share) < 2:
        n = {0: 0, 1: 0} | {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
        return Model(None, None, (n[1] + 1) / (n[0] + n[1] + 2))
    known = trained(docs, s)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [v.tobytes() for run in runs_of(batch.column("text")) for v in pooled(run, known)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("quality"), pa.array(x, pa.binary())], names=["row", "quality", "x"])

    got = rows.select("row", "quality", "text").mapInArrow(features, "row long, quality int, x binary").toPandas().sort_values("row")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(np.float64)
    y = got["quality"].to_numpy(np.float64)
    return Model(known, fit(x, y, np.array([1 / share[int(q)] for q in y])), 0.5)


OUT = "doc_id long, held_out boolean, score double, predicted int"


def score(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, score) of the rows of ``docs`` (key, text)."""
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = batch.column("text")
            s = np.full(len(texts), m.constant)
            if m.net:
                s = np.concatenate([np.zeros(0), *(m.net.scores(pooled(run, m.words)) for run in runs_of(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(key).cast(pa.int64()), pa.array(s)], names=[key, "score"])

    return docs.select(key, "text").mapInArrow(each, f"{key} long, score double")


def learned(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the rows that are not held out."""
    return train(spark, narrow(docs), labels.where(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))


def op5_random_indexing(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(spark, docs, learned(spark, docs, labels))
    return out.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept; all documents where labels don't give one."""
    row = fresh(docs, "_row")
    model = learned(spark, docs, table(spark, sf_dir, "labels"))
    if model.net is None:
        return docs
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    kept = score(spark, numbered.select(F.col(row).alias("row"), "text"), model, "row").where(F.col("score") >= THRESHOLD).select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)
