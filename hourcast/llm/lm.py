"""Language-model scores: interpolated modified Kneser-Ney n-grams, counted in Spark.

Tokens are lower-cased words and one end for each text; ends also stand before
a text's first word.  The order n is a parameter (ORDER in the query).  With
a(g) the count of an n-gram, and of a shorter one the number of words seen
before it, h the words before w and h' those but the first,

    p(w | h) = (a(hw) - D(a(hw)) + (D(1) N1(h) + D(2) N2(h) + D(3+) N3+(h)) * p(w | h')) / A(h)

where A(h) adds up a(hw) over w, Nk(h) counts the w with a(hw) = k, and each
order has D(1), D(2), D(3+) from the numbers of its grams with a = 1 to 4.
Below single words lies 1 / (V + 1).  Where h was never seen, p(w | h) is
p(w | h'); a word that the training texts lack has its share of 1 / (V + 1)
alone, and says nothing about what follows it.

Counting.  Each task counts its words by 64-bit hash, deals the counts to
buckets of hashes as packed arrays, and a bucket's task adds them up: a sorted
array of hashes and their counts.  Words are numbered by frequency, bucket by
bucket in turn, so frequent ones have small numbers, which pack small.  Grams
are rows of these numbers, kept by a 64-bit hash of the row in buckets of
hashes.  The longest grams that begin alike meet in one bucket, which adds up
what it hands on for their beginning, unless all words of the beginning are so
frequent that it could weigh on a bucket: then they are dealt one by one.  (The
bits of the bucket are the beginning's, so of N grams in B buckets, F of which
begin alike, one shares its hash with chance (N + B F) / 2^64 at most.)  A
bucket's task adds up its grams and hands on, for each of their beginnings and
ends, what the next lower order needs; so order follows order, down to words, in
one job.  All arrays are files in the shared folder, written under a name of
their own and then renamed, so a lost task can be repeated.  Of sorted hashes
the files have the last bits and where each cell of the first ones begins; of
counts a few bits each, and the rare ones that these cannot hold apart.

Scoring.  Workers map the arrays into memory (files that are not on a mounted
file system are fetched first) and look up a run of texts at a time, sorted.
All counts grow with the corpus; nothing of it passes the driver but a few
numbers a bucket of words and an order.

Null and empty texts consist of their end.  Null ids count as the text '' in
the split.  Repeated rows count and are scored each.  An empty table gives an
empty result; without training rows every word has the probability 1.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import words
from hourcast.llm.common import Scratch, remainder

FOLDS, HELD_OUT = 7, 2
#: The longest grams.
ORDER = 3
#: Bytes of text for each bucket of counts.
BUCKET_BYTES = 32 << 20
#: Mapped arrays that a worker keeps, some ten a bucket of grams: each run of texts looks into all buckets in turn, so
#: fewer than these would all be mapped anew for each run.  A process has 65,530 mappings by default.
MAPPED = 32768
#: With so many buckets of grams, or fewer, a run of texts has words.RUN_BYTES; with more, as many times more, up to LONGEST.
FEW_BUCKETS, LONGEST = 256, 4
#: Distinct keys that a task gathers before it hands them on.
GATHERED = 3_000_000

# --- files ------------------------------------------------------------------


def _at(root: str, name: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
    return files, f"{path}/{name}.npy"


def put(root: str, name: str, values: np.ndarray) -> None:
    files, path = _at(root, name)
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as f:
        np.lib.format.write_array(_Writer(f), values)
    files.move(own, path)


class _Writer:
    def __init__(self, stream):
        self.write = stream.write


@lru_cache(maxsize=MAPPED)
def get(root: str, name: str) -> np.ndarray:
    """The array, mapped into memory."""
    files, path = _at(root, name)
    if not isinstance(files, fs.LocalFileSystem):
        folder = _fetched()
        local = os.path.join(folder.name, f"{abs(hash((root, name)))}.npy")
        fs.copy_files(path, local, source_filesystem=files, destination_filesystem=fs.LocalFileSystem())
        path = local
    return np.asarray(np.load(path, mmap_mode="r"))


@lru_cache(maxsize=1)
def _fetched() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="lm-")


def narrowest(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


#: Hashes that a cell holds on average, at most.
CELL = 8


def put_keys(root: str, name: str, keys: np.ndarray, lead: int) -> None:
    """Stores sorted distinct hashes that share their first ``lead`` bits: the last 32 bits of each, those before by fours, and where cells of equal further bits begin."""
    n = len(keys)
    least = max(0, (-(-n // CELL) - 1).bit_length())
    # as many cells as make all together smallest
    bits = min(range(least, max(least, 64 - lead) + 1), key=lambda c: (8 + _fours(64 - lead - c)) * n // 2 + (2 << c))
    shift = 64 - lead - bits
    cell = (keys & np.uint64((1 << (64 - lead)) - 1)) >> np.uint64(shift)
    begins = np.searchsorted(cell, np.arange((1 << bits) + 1, dtype=np.uint64))
    ahead = begins - (np.arange((1 << bits) + 1) * n >> bits)  # of where evenly spread ones would begin
    put(root, f"{name}-cells", ahead.astype(np.min_scalar_type(-1 - int(np.abs(ahead).max()))))
    last = keys & np.uint64((1 << shift) - 1)
    put(root, f"{name}-last", last.astype(np.uint32))
    fours = [(last >> np.uint64(32 + 4 * j)).astype(np.uint8) & np.uint8(15) for j in range(_fours(shift))]
    put(root, f"{name}-before", squeezed(np.concatenate([*fours, np.zeros(0, np.uint8)]), 4))


def _fours(bits: int) -> int:
    return max(0, -(-(bits - 32) // 4))


def squeezed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of so many bits (2, 4 or 8), side by side in bytes."""
    each = 8 // bits
    out = np.zeros((-(-len(values) // each), each), np.uint8)
    out.ravel()[: len(values)] = values
    return np.bitwise_or.reduce(out << np.arange(0, 8, bits, dtype=np.uint8), axis=1)


def squeezed_at(held: np.ndarray, bits: int, places: np.ndarray) -> np.ndarray:
    if bits == 8:
        return held[places]
    out = held[places >> (2 if bits == 2 else 1)]
    out >>= ((places & (8 // bits - 1)) * bits).astype(np.uint8)
    out &= np.uint8((1 << bits) - 1)
    return out


def find(root: str, name: str, keys: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(which of ``keys`` are stored, their places, how many are stored)."""
    held, ahead = get(root, f"{name}-last"), get(root, f"{name}-cells")
    n, bits = len(held), (len(ahead) - 1).bit_length() - 1
    shift = 64 - lead - bits
    cell = ((keys & np.uint64((1 << (64 - lead)) - 1)) >> np.uint64(shift)).astype(np.int64)
    begin, end = ((c * n >> bits) + ahead[c] for c in (cell, cell + 1))
    each = end - begin
    upto = np.cumsum(each)
    at = np.arange(int(upto[-1])) + np.repeat(begin - (upto - each), each)
    last = (keys & np.uint64((1 << shift) - 1)).astype(np.uint32)
    hit = np.flatnonzero(held[at] == np.repeat(last, each))
    which, at = np.searchsorted(upto, hit, "right"), at[hit]
    if _fours(shift):
        before = get(root, f"{name}-before")
        fours = ((keys[which] & np.uint64((1 << shift) - 1)) >> np.uint64(32)).astype(np.int64)
        same = np.ones(len(at), bool)
        for j in range(_fours(shift)):
            same &= squeezed_at(before, 4, at + j * n) == (fours >> 4 * j & 15)
        which, at = which[same], at[same]
    return which, at, n


def put_counts(root: str, name: str, columns: list[np.ndarray]) -> None:
    """Stores columns of counts one behind the other: 2, 4 or 8 bits each, and places and values of those that are too large."""
    values = np.concatenate(columns).astype(np.int64)
    bits = min((2, 4, 8), key=lambda b: len(values) * b / 8 + 8 * int((values >= (1 << b) - 1).sum()))
    most = (1 << bits) - 1
    rare = np.flatnonzero(values >= most)
    put(root, f"{name}-rare", narrowest(np.stack([rare, values[rare]])))
    put(root, f"{name}-few", np.append(np.uint8(bits), squeezed(np.minimum(values, most).astype(np.uint8), bits)))


def counts_at(root: str, name: str, places: np.ndarray) -> np.ndarray:
    """The counts at places in all columns, one behind the other."""
    few = get(root, f"{name}-few")
    bits = int(few[0])
    out = squeezed_at(few[1:], bits, places)
    large = np.flatnonzero(out == (1 << bits) - 1)
    if not len(large):
        return out
    rare = get(root, f"{name}-rare")
    out = out.astype(np.int64)
    out[large] = rare[1][np.searchsorted(rare[0], places[large].astype(rare.dtype))]
    return out


# --- gathering counts by key, in buckets ---------------------------------------


def bucket_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


PACKED = "bucket long, keys binary, counts binary"


def pack(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="lz4", asbytes=True) + len(values.tobytes()).to_bytes(8, "little")


def unpack(packed: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(packed[-8:], "little")
    return np.frombuffer(pa.decompress(packed[:-8], size, codec="lz4", asbytes=True), kind)


def planes(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as differences, byte by byte: the high bytes are mostly nought."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def from_planes(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def small(counts: np.ndarray) -> np.ndarray:
    return counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()


def gathered(each_run: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int, bucket: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """A mapInArrow function: counts of the keys that ``each_run`` makes of a run of texts, dealt to buckets."""

    def deal(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        to = bucket(keys)
        order = np.argsort(to, kind="stable")  # keys stay sorted within a bucket
        to, keys, counts = to[order], keys[order], counts[order]
        cuts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
        parts = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True)]
        columns = [pa.array([int(to[a]) for a, _ in parts], pa.int64())]
        columns += [pa.array([pack(planes(keys[a:b])) for a, b in parts], pa.binary()), pa.array([pack(small(counts[a:b])) for a, b in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "counts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for _, _, data, bounds in words.runs(batch.column("text")):
                keys, counts = np.unique(each_run(*words.word_hashes(data, bounds)), return_counts=True)
                held.append((keys, counts))
                n += len(keys)
                if n > GATHERED:
                    held = [add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    n = len(held[0][0])
                    if n > GATHERED // 2:
                        yield deal(*held[0])
                        held, n = [], 0
        if n:
            yield deal(*add_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])))

    return each


def merged(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([from_planes(x) for x in pdf["keys"]])
    counts = np.concatenate([unpack(x, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel() for x in pdf["counts"]])
    return add_up(keys, counts)


def with_ends(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of the texts, and the place of each text's first."""
    return np.insert(hashes, firsts[1:], words.END), firsts + np.arange(len(firsts))


# --- the model ------------------------------------------------------------------


Discounts = tuple[float, float, float]


def gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    keys = columns[0].astype(np.uint64)
    for c in columns[1:]:
        keys = words.mix(keys * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return keys


#: What is known of a gram: a(g), A(g), N1(g), N2(g), N3+(g); of the longest, the first alone.
FIELDS = ("seen", "all", "once", "twice", "often")


@dataclass
class Model:
    """What is not in the files: where they are and the numbers that all lookups need."""

    root: str
    bits: int
    order: int
    sizes: list[int]  # the number of words of each bucket
    tokens: int
    discounts: dict[int, Discounts] = field(default_factory=dict)  # of each order
    bigrams: int = 0
    rest: float = 1.0  # what the discounts of single words leave

    @property
    def types(self) -> int:
        return sum(self.sizes)

    @property
    def lead(self) -> int:
        """The bits of a key that name a gram's bucket: long grams outnumber words, so they have a bucket for a quarter of the bytes of text."""
        return self.bits + 2 * (self.order > 2)

    @property
    def run_bytes(self) -> int:
        """Bytes of text to look up at once: a look into a bucket costs the same for few grams as for some hundred."""
        return words.RUN_BYTES * min(LONGEST, max(1, (1 << self.lead) // FEW_BUCKETS))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each of the sorted hashes, -1 if unknown: its rank in its bucket, then the bucket."""
        out = np.full(len(hashes), -1, np.int64)
        cuts = np.searchsorted(bucket_of(hashes, self.bits), np.arange((1 << self.bits) + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[b], cuts[b + 1])
            if self.sizes[b]:
                held, rank = get(self.root, f"hash-{b}"), get(self.root, f"rank-{b}")
                at = np.minimum(np.searchsorted(held, hashes[own]), len(held) - 1)
                out[own] = np.where(held[at] == hashes[own], rank[at].astype(np.int64) << self.bits | b, -1)
        return out

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        """A 64-bit key of each gram (a column of numbers for each of its words) that begins with its bucket."""
        if len(columns) == 1:
            number = columns[0].astype(np.uint64)
            return number >> np.uint64(self.bits) | number << np.uint64(64 - self.bits)
        keys = gram_keys(columns)
        if len(columns) < self.order or self.order == 2:
            return keys
        # a word of that rank or beyond has no more than a bucket's share of all tokens
        frequent = np.logical_and.reduce([c < 1 << (self.lead + self.bits) for c in columns[:-1]])
        rest = np.uint64(64 - self.lead)
        bucket = np.where(frequent, keys << rest >> rest, gram_keys(columns[:-1]) >> rest)
        return bucket << rest | keys >> np.uint64(self.lead)

    def bucket(self, k: int, keys: np.ndarray) -> np.ndarray:
        """The bucket of each key of a gram of ``k`` words; in order where the keys are."""
        return bucket_of(keys, self.bits if k == 1 else self.lead)

    def parts(self, k: int, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(bucket, from, to) for the sorted keys of grams of ``k`` words."""
        to = self.bucket(k, keys)
        cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(to)], strict=True):
            yield int(to[a]), a, z

    def look_up(self, columns: list[np.ndarray], *names: str) -> list[np.ndarray]:
        """What is known of grams (a column of numbers for each of their words) by the names of ``FIELDS``, "count" of a word; 0 where there is none."""
        k = len(columns)
        known = np.logical_and.reduce([c >= 0 for c in columns])
        keys, place = np.unique(self.keys([c[known] for c in columns]), return_inverse=True)
        found = np.zeros((len(names), len(keys)))
        for b, a, z in self.parts(k, keys):
            if k == 1:
                which, at, n = np.arange(a, z), (keys[a:z] & np.uint64((1 << (64 - self.bits)) - 1)).astype(np.int64), self.sizes[b]
            elif files_of(self.root, f"{k}-{b}-last"):
                which, at, n = find(self.root, f"{k}-{b}", keys[a:z], self.lead)
                which += a
            else:
                continue
            if names == ("count",):
                found[0, which] = get(self.root, f"count-{b}")[at]
            else:
                places = np.add.outer([FIELDS.index(name) * n for name in names], at)
                found[:, which] = counts_at(self.root, f"{k}-{b}", places.ravel()).reshape(places.shape)
        outs = [np.zeros(len(known)) for _ in names]
        for out, values in zip(outs, found, strict=True):
            out[known] = values[place]
        return outs


@lru_cache(maxsize=65536)
def files_of(root: str, name: str) -> bool:
    """Whether there is such an array: a bucket without grams has none."""
    files, path = _at(root, name)
    return files.get_file_info(path).type == fs.FileType.File


def discounts(ones: int, twos: int, threes: int, fours: int) -> Discounts:
    """D(1), D(2), D(3+); where a count is nought, half a count is taken off."""
    y = ones / (ones + 2 * twos) if ones else 0.0
    of = lambda k, n, m: min(max(k - (k + 1) * y * m / n, 0.0), float(k)) if n and ones else 0.5
    return of(1, ones, twos) or 0.5, of(2, twos, threes) or 0.5, of(3, threes, fours) or 0.5


def off(d: Discounts, counts: np.ndarray) -> np.ndarray:
    return np.where(counts >= 3, d[2], np.where(counts >= 2, d[1], np.where(counts >= 1, d[0], 0.0)))


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def grams(model: Model, hashes: np.ndarray, firsts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(columns, firsts): the numbers of the words up to each token, a column for each place, its own last; -1 if unknown."""
    tokens, firsts = with_ends(hashes, firsts)
    distinct, place = np.unique(tokens, return_inverse=True)
    own = model.numbers(distinct)[place]
    end = model.numbers(np.array([words.END]))[0]
    since = np.arange(len(own)) - np.repeat(firsts[:-1], np.diff(firsts))
    columns = [own]
    for k in range(1, model.order):
        before = np.full_like(own, end)
        before[k:] = own[:-k]
        before[since < k] = end
        columns.insert(0, before)
    return columns, firsts


def packed(rows: list[np.ndarray], rising: bool) -> bytes:
    """Numbers byte by byte, without high bytes that are all nought; of a ``rising`` first row the differences."""
    if rising:
        rows = [np.diff(rows[0], prepend=0), *rows[1:]]
    widths = [max(1, -(-int(x.max(initial=0)).bit_length() // 8)) for x in rows]
    raw = b"".join(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:w].tobytes() for x, w in zip(rows, widths, strict=True))
    return pa.compress(raw, codec="zstd", asbytes=True) + bytes(widths) + len(raw).to_bytes(8, "little")


def unpacked(parts: pd.Series, n: int, rising: bool) -> list[np.ndarray]:
    rows: list[list[np.ndarray]] = [[] for _ in range(n)]
    for x in parts:
        widths = list(x[-8 - n : -8])
        raw = np.frombuffer(pa.decompress(x[: -8 - n], int.from_bytes(x[-8:], "little"), codec="zstd", asbytes=True), np.uint8)
        of_byte = raw.reshape(sum(widths), -1)
        for i, w in enumerate(widths):
            values = np.zeros((of_byte.shape[1], 8), np.uint8)
            values[:, :w] = of_byte[sum(widths[:i]) :][:w].T
            rows[i].append(np.cumsum(values.view(np.int64).ravel()) if rising and i == 0 else values.view(np.int64).ravel())
    return [np.concatenate(x) for x in rows]


def summed(model: Model, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The distinct grams in the order of their keys: keys, columns, and the sums of each of ``counts``."""
    keys = model.keys(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    at = order[first]
    return keys[first], [c[at] for c in columns], [np.add.reduceat(c[order], first) if len(first) else c for c in counts]


GRAMS = "bucket long, words binary, counts binary, tally array<long>"


def rows_of(model: Model, keys: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
    """A row for each bucket that the sorted grams fall into."""
    rows = []
    for b, a, z in model.parts(len(columns), keys):
        # by the first words, which then pack small
        by = [c[a:z].astype(np.uint64) for c in columns[:2]]
        order = a + np.argsort(by[0] if len(by) == 1 else (by[0] << np.uint64(32)) + by[1])
        rows.append((b, packed([c[order] for c in columns], True), packed([c[order] for c in counts], False), None))
    return rows


def counted(model: Model) -> Callable:
    """A mapInArrow function: the counts of the longest grams of the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def together() -> tuple:
            return summed(model, [np.concatenate(c) for c in zip(*[x[0] for x in held], strict=True)], [np.concatenate([x[1] for x in held])])

        def batch_of(found: tuple) -> pa.RecordBatch:
            columns = zip(*rows_of(model, *found), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["bucket", "words", "counts", "tally"])

        for batch in batches:
            for _, _, data, bounds in words.runs(batch.column("text")):
                columns, _ = grams(model, *words.word_hashes(data, bounds))
                held.append((columns, np.ones(len(columns[0]), np.int64)))
                n += len(columns[0])
                if n > GATHERED // model.order:  # a gram has as many columns
                    found = together()
                    held, n = [(found[1], found[2][0])], len(found[0])
                    if n > GATHERED // model.order // 2:
                        yield batch_of(found)
                        held, n = [], 0
        if n:
            yield batch_of(together())

    return each


def added_up(model: Model, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Adds up a bucket of grams of ``k`` words, stores them, and hands on what the grams of k - 1 words need.

    Counts are those of ``FIELDS``, for the longest grams the first alone.
    """

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        if b < 0:  # the tallies of a higher order
            return pd.DataFrame([(b, None, None, np.sum(pdf["tally"].tolist(), axis=0).tolist())], columns=list(pdf.columns))
        keys, columns, counts = summed(model, unpacked(pdf["words"], k, True), unpacked(pdf["counts"], 1 if k == model.order else len(FIELDS), False))
        seen = counts[0]
        put_counts(model.root, f"{k}-{b}", counts)
        if k > 1:
            put_keys(model.root, f"{k}-{b}", keys, model.lead)
        rows = [(-k, None, None, [*_tally(seen), int((seen > 0).sum())])]
        if k > 1:
            there = seen > 0  # what only stands before others is no gram itself
            columns, seen = [c[there] for c in columns], seen[there]
            none = np.zeros_like(seen)
            kinds = [(seen == 1).astype(np.int64), (seen == 2).astype(np.int64), (seen > 2).astype(np.int64)]
            ends, begins = [none + 1, none, none, none, none], [none, seen, *kinds]
            lower = [np.concatenate([x, y]) for x, y in zip(columns[1:], columns[:-1], strict=True)]
            rows += rows_of(model, *summed(model, lower, [np.concatenate([x, y]) for x, y in zip(ends, begins, strict=True)]))
        return pd.DataFrame(rows, columns=list(pdf.columns))

    return each


def train(spark: SparkSession, docs: DataFrame, s: Scratch, order: int = ORDER) -> Model:
    """Counts the rows of ``docs`` (text); the files lie in the scratch folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    root = s.root
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(2, (-(-size // BUCKET_BYTES) - 1).bit_length())

    # words
    def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
        b = int(pdf["bucket"].iloc[0])
        keys, counts = merged(pdf)
        put(root, f"hash-{b}", keys)
        often = np.argsort(-counts, kind="stable")
        put(root, f"rank-{b}", narrowest(np.argsort(often)))
        put(root, f"count-{b}", narrowest(counts[often]))
        return pd.DataFrame({"bucket": [b], "types": [len(keys)], "tokens": [int(counts.sum())]})

    dealt = docs.select("text").mapInArrow(gathered(lambda h, f: with_ends(h, f)[0], bits, lambda k: bucket_of(k, bits)), PACKED)
    sizes = s.keep(dealt.groupBy("bucket").applyInPandas(count_words, "bucket long, types long, tokens long"), "words")
    found = {r["bucket"]: r for r in sizes.collect()}  # a row a bucket
    model = Model(root, bits, order, [found[b]["types"] if b in found else 0 for b in range(1 << bits)], sum(r["tokens"] for r in found.values()))
    if not model.types:
        return model

    # grams, from the longest to single words
    rows = docs.select("text").mapInArrow(counted(model), GRAMS)
    for k in range(order, 0, -1):
        rows = rows.groupBy("bucket").applyInPandas(added_up(model, k), GRAMS)
    tallies = s.keep(rows.select(F.col("bucket").alias("k"), "tally"), "tallies")
    sums = tallies.groupBy("k").agg(*[F.sum(F.col("tally")[i]) for i in range(5)]).collect()  # a row an order
    tally = {-r[0]: r[1:] for r in sums}
    model.discounts = {k: discounts(*t[:4]) for k, t in tally.items()}
    model.bigrams = tally[2][4]
    d, (ones, twos, _, _, every) = model.discounts[1], tally[1]
    model.rest = (d[0] * ones + d[1] * twos + d[2] * (every - ones - twos)) / model.bigrams
    return model


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def probabilities(model: Model, columns: list[np.ndarray]) -> np.ndarray:
    """The probability of each token after the words before it."""
    n, tokens = model.order, len(columns[0])
    if not model.types:
        return np.ones(tokens)
    # grams and, of the same length, what stands before the words: looked up together
    found = {k: model.look_up([np.concatenate(c) for c in zip(columns[n - k :], columns[n - k - 1 : -1], strict=True)], *FIELDS) for k in range(1, n)}
    seen = found[1][0][:tokens]
    p = (seen - off(model.discounts[1], seen)) / model.bigrams + model.rest / (model.types + 1)
    for k in range(2, n + 1):
        every, once, twice, often = (v[tokens:] for v in found[k - 1][1:])
        d = model.discounts[k]
        seen = found[k][0][:tokens] if k < n else model.look_up(columns, "seen")[0]
        p = np.where(every > 0, (seen - off(d, seen) + (d[0] * once + d[1] * twice + d[2] * often) * p) / np.maximum(every, 1), p)
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of each row of ``docs`` (doc_id, held_out, text), in log10."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, bounds in words.runs(batch.column("text"), model.run_bytes):
                columns, firsts = grams(model, *words.word_hashes(data, bounds))
                own = model.look_up(columns[-1:], "count")[0] if model.types else np.zeros(len(columns[-1]))
                base = np.log10((own + 1) / (model.tokens + model.types + 1))
                sums = lambda x: np.add.reduceat(x, firsts[:-1])  # noqa: B023, E731
                keep = lambda c: batch.column(c).slice(first, end - first)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [keep("doc_id").cast(pa.int64()), keep("held_out"), pa.array(np.diff(firsts)), pa.array(sums((own > 0).astype(np.int64))), pa.array(np.full(end - first, model.tokens)), pa.array(sums(base)), pa.array(sums(np.log10(probabilities(model, columns))))],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(each, SCORES)


def op6_kneser_ney(spark: SparkSession, docs: DataFrame, order: int = ORDER) -> DataFrame:
    d = docs.select("doc_id", "text", (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    model = train(spark, d.where("not held_out"), Scratch(spark, "lm"), order)
    out = score(d, model).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    # six places, so that sums in another order compare equal
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score", "perplexity")})


def _sql_discounts(of: str, to: str) -> str:
    """The three discounts from the counts of counts n1 to n4 of ``of``."""
    d = [f"greatest(least({k} - {k + 1} * y * n{k + 1} / n{k}, {k}.0), 0.0)" for k in (1, 2, 3)]
    d = [f"coalesce(nullif(CASE WHEN n1 > 0 AND n{k} > 0 THEN {x} END, 0.0), 0.5) AS d{k}" for k, x in zip((1, 2, 3), d, strict=True)]
    counts = ", ".join(f"CAST(count(*) FILTER (c = {k}) AS DOUBLE) AS n{k}" for k in (1, 2, 3, 4))
    return f"{to} AS (SELECT {', '.join(d)} FROM (SELECT *, n1 / nullif(n1 + 2 * n2, 0) AS y FROM (SELECT {counts} FROM {of})))"


def _off(c: str, d: str) -> str:
    return f"CASE WHEN {c} >= 3 THEN {d}.d3 WHEN {c} = 2 THEN {d}.d2 WHEN {c} = 1 THEN {d}.d1 ELSE 0 END"


#: crc32 of the id as text, from its table of 256 remainders; ids are non-negative here.
_CRC = """
crc_bits(b, r, k) AS (
  SELECT b, b, 0 FROM (SELECT unnest(range(256)) AS b)
  UNION ALL
  SELECT b, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM crc_bits WHERE k < 8),
crc_table AS (SELECT b, r FROM crc_bits WHERE k = 8),
crc_steps(doc_id, id, r, k) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), 4294967295, 0 FROM documents
  UNION ALL
  SELECT doc_id, id, xor(t.r, s.r >> 8), k + 1
  FROM crc_steps s JOIN crc_table t ON t.b = xor(s.r, ascii(substr(id, k + 1, 1))) & 255 WHERE k < length(id)),
held AS (SELECT doc_id, xor(r, 4294967295) % 7 = 2 AS held_out FROM crc_steps WHERE k = length(id))"""


def oracle(order: int = ORDER) -> str:
    """DuckDB SQL for the scores; u1 is the word before v, u2 the one before that, and so on."""
    before = [f"u{j}" for j in range(order - 1, 0, -1)]  # farthest first
    words_of = {k: [*before[order - k :], "v"] for k in range(1, order + 1)}  # the words of a gram of k
    listed = {k: ", ".join(w) for k, w in words_of.items()}
    shifted = ", ".join(f"unnest(pad[{order - j}:len(a) + {order - 1 - j}]) AS u{j}" for j in range(1, order))
    ctes = [f"g{order} AS (SELECT {listed[order]}, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL)"]
    ctes += [f"g{k} AS (SELECT {listed[k]}, count(*) AS c FROM g{k + 1} GROUP BY ALL)" for k in range(order - 1, 0, -1)]
    ctes += [_sql_discounts(f"g{k}", f"d{k}_") for k in range(1, order + 1)]
    ctes += [f"h{k} AS (SELECT {', '.join(words_of[k][:-1])}, sum(c) AS a, sum({_off('c', f'd{k}_')}) AS g FROM g{k}, d{k}_ GROUP BY ALL)" for k in range(2, order + 1)]
    p = f"((coalesce(g1.c, 0) - {_off('coalesce(g1.c, 0)', 'd1_')}) / tot.pairs + rest.rest / (tot.types + 1))"
    joins = "LEFT JOIN uni ON uni.v = t.v LEFT JOIN g1 ON g1.v = t.v"
    for k in range(2, order + 1):
        same = lambda of, names: " AND ".join(f"{of}.{x} = t.{x}" for x in names)
        joins += f" LEFT JOIN h{k} ON {same(f'h{k}', words_of[k][:-1])} LEFT JOIN g{k} ON {same(f'g{k}', words_of[k])}"
        p = f"(CASE WHEN h{k}.a IS NULL THEN {p} ELSE (coalesce(g{k}.c, 0) - {_off(f'coalesce(g{k}.c, 0)', f'd{k}_')} + h{k}.g * {p}) / h{k}.a END)"
    discounts_ = ", ".join(f"d{k}_" for k in range(1, order + 1))
    sep = ",\n"
    return rf"""
WITH RECURSIVE {_CRC.strip()},
w AS (
  SELECT doc_id, list_append(['w' || x FOR x IN regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')],
           'end') AS a
  FROM documents),
padded AS (SELECT doc_id, a, list_concat([{', '.join(["'end'"] * (order - 1))}], a) AS pad FROM w),
t AS (SELECT doc_id, held_out, unnest(a) AS v, {shifted} FROM padded JOIN held USING (doc_id)),
uni AS (SELECT v, count(*) AS c FROM t WHERE NOT held_out GROUP BY v),
{sep.join(ctes)},
tot AS (SELECT (SELECT sum(c) FROM uni) AS n, (SELECT count(*) FROM uni) AS types, (SELECT count(*) FROM g2) AS pairs),
rest AS (SELECT sum({_off('c', 'd1_')}) / any_value(pairs) AS rest FROM g1, d1_, tot),
p AS (SELECT t.doc_id, t.held_out, uni.c AS c, tot.n, tot.types, {p} AS p FROM t {joins}, tot, rest, {discounts_}),
q AS (
  SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
         sum(log10((coalesce(c, 0) + 1) / (n + types + 1))) AS base_score, sum(log10(p)) AS score
  FROM p GROUP BY doc_id)
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score,
       round(pow(10.0, -score / n_tokens), 6) AS perplexity
FROM q
"""


ORACLE = oracle()
