"""Spelling variants: words one letter apart, by a bit-sliced position index.

The vocabulary is the corpus' own: runs of Latin letters with their counts over
all documents.  A block of it is held as bit sets: for each position and letter
the words that have the letter there.  A query word walks over its letters
once; at each step a few word-parallel operations on the whole block advance
four sets of words: those that agree so far without an error, with one letter
replaced (same position), with one more letter than the query (position + 1)
and with one less (position - 1).

Blocks: two near words, of P and P or P + 1 letters, agree in the first half
(P div 2 letters) or else in the last half.  So the words of P and P + 1
letters are dealt to blocks by a hash of either half, and each pair is found in
one block alone: by its first half where that agrees, by its last half where it
doesn't.  A block has LETTERS letters or so; one whose half is shared by more
words than that is searched in parts, every query against every part, so no
task holds more and no pair is lost.

A null text has no words; a null id counts as the text ''.  Repeated rows count
each time.  Ties go to the smallest word in code-point order.  An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm.common import Scratch, ship

#: Words have so many letters and occurrences at least; a form has so many times a word's occurrences.
SHORTEST, OFTEN, TIMES = 6, 5, 5
#: A run of a document whose crc32 this divides loses a letter.
DROPS = 199
#: Words that a task counts before it hands them on.
KEPT = 300_000
#: Letters of a block, and bytes of each set of bits of the queries searched at once.
LETTERS, AT_ONCE = 1 << 19, 1 << 19
RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % SHORTEST)
NEAR = "word string, n_near long, best_n long, best string"


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of (doc_id, text), in partial counts."""
    ship(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def dealt() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            texts = pc.ascii_lower(batch.column("text"))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), (t.as_py() for t in texts), strict=True):
                start = crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in Counter(RUN.findall(text or "")).items():
                    h = crc32(run.encode(), start)
                    if h % DROPS == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) < SHORTEST:
                            continue
                    counts[run] += n
                if len(counts) > KEPT:
                    yield dealt()
                    counts.clear()
        if counts:
            yield dealt()

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(counted, "word string, n long")


def vocabulary(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words with ``often`` occurrences over all documents."""
    return occurrences(docs).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def letters_of(words: list[str], width: int) -> np.ndarray:
    """A row of letters for each word, zeros behind its end; no letter is beyond U+00FF."""
    return np.frombuffer(b"".join([w.encode("latin-1").ljust(width, b"\0") for w in words]), np.uint8).reshape(len(words), width)


def bits(which: np.ndarray) -> np.ndarray:
    """A bit for each word of the block."""
    packed = np.packbits(which, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view("<u8")


class Index:
    """The words of a block (``letters``, one row a word), as sets of bits for each position and letter."""

    def __init__(self, letters: np.ndarray, shorter: int):
        self.shorter = shorter
        sizes = (letters != 0).sum(axis=1)
        self.short, self.long = bits(sizes == shorter), bits(sizes == shorter + 1)
        self.all = self.short | self.long
        self.place = np.zeros((shorter + 1, 256), np.int64)
        sets = [np.zeros_like(self.all)]  # of letters that no word has at a place
        for position in range(shorter + 1):
            for letter in np.unique(letters[:, position]).tolist():
                self.place[position, letter] = len(sets)
                sets.append(bits(letters[:, position] == letter))
        self.sets = np.array(sets)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """For each query the words with its letter at the position."""
        return self.sets[self.place[position, letters]]

    def near(self, queries: np.ndarray, size: int, first_half: bool) -> np.ndarray:
        """For each query of ``size`` letters the words one error away that agree in the first half, or that do not."""
        exact = np.repeat(self.all[None, :], len(queries), axis=0)
        replaced, less = np.zeros_like(exact), np.zeros_like(exact)
        more, half = exact, None
        for j in range(size):
            here = self.at(j, queries[:, j])
            less = (less & self.at(j - 1, queries[:, j])) | exact if j else exact
            replaced = (replaced & here) | (exact & ~here)
            exact = exact & here
            more = (more & self.at(j + 1, queries[:, j])) | exact if j < self.shorter else exact
            if j + 1 == self.shorter // 2:
                half = exact
        found = (replaced & self.short) | (more & self.long) if size == self.shorter else less & self.short
        return found & (half if first_half else ~half)


def searched(pdf: pd.DataFrame) -> pd.DataFrame:
    """The near words of a block's queries: how many, and the first by count and word."""
    shorter, first_half = int(pdf["shorter"].iloc[0]), bool(pdf["first_half"].iloc[0])
    held = pdf[pdf["held"]]
    words, n = held["word"].tolist(), held["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))  # so the first bit is the best word
    words, n = [words[i] for i in order], n[order]
    asked = pdf.loc[pdf["asked"], "word"].tolist()
    out: list[tuple[str, int, int, str]] = []
    if words:
        index = Index(letters_of(words, shorter + 1), shorter)
        step = max(1, AT_ONCE // index.all.nbytes)
        for size in (shorter, shorter + 1):
            own = [w for w in asked if len(w) == size]
            for a in range(0, len(own), step):
                found = index.near(letters_of(own[a : a + step], size), size, first_half)
                count = np.bitwise_count(found).sum(axis=1)
                hit = np.flatnonzero(count)
                block = (found[hit] != 0).argmax(axis=1)
                low = found[hit, block]
                best = block * 64 + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1))
                out += [(own[a + q], c, int(n[b]), words[b]) for q, c, b in zip(hit.tolist(), count[hit].tolist(), best.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def dealt(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """The words (word, n) as rows of the blocks (shorter, first_half, block, part, asked_part) that hold or ask them."""
    size = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("shorter")).where(F.col("shorter") >= SHORTEST)
    sides = sides.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("first_half"))
    half = F.expr("if(first_half, left(word, shorter div 2), right(word, shorter - shorter div 2))")
    # one row for each length of a word: a small table whatever the vocabulary
    blocks = sides.where("first_half").groupBy("shorter").agg(F.ceil(F.count(F.lit(1)) * F.col("shorter") / F.lit(letters)).alias("blocks"))
    cells = ["shorter", "first_half", "block"]
    sides = sides.join(F.broadcast(blocks), "shorter").withColumn("block", F.pmod(F.xxhash64(half), F.col("blocks"))).drop("blocks")
    # a half that many words share makes a large block: it is searched in parts
    parts = sides.groupBy(*cells).agg(F.ceil(F.count(F.lit(1)) * F.col("shorter") / F.lit(2 * letters)).alias("parts"))
    sides = sides.join(parts, cells).withColumn("own", F.pmod(F.xxhash64("word", F.lit(7)), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    flags = lambda part, asked: F.struct(part.alias("part"), asked.alias("asked_part"), (part == F.col("own")).alias("held"), (asked == F.col("own")).alias("asked"))
    holds = F.transform(every, lambda q: flags(F.col("own"), q))
    asks = F.transform(F.filter(every, lambda p: p != F.col("own")), lambda p: flags(p, F.col("own")))
    return sides.select(*cells, "word", "n", F.explode(F.concat(holds, asks)).alias("to")).select(*cells, "word", "n", "to.*")


def near_words(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n_near, best_n, best) of the words of (word, n) that have near words among them."""
    found = dealt(words, letters).groupBy("shorter", "first_half", "block", "part", "asked_part").applyInPandas(searched, NEAR)
    first = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame, s: Scratch) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, twice as far each time.

    A form is TIMES as frequent as its word, so a chain has 27 steps at most
    and five rounds end it.
    """
    chain, step = s.keep(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = s.keep(chain.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step + 1}")
        moved = not longer.where("moved").isEmpty()
        s.drop(f"roots-{step}")
        chain, step = longer.drop("moved"), step + 1
        if not moved:
            return chain


def variants(spark: SparkSession, docs: DataFrame, often: int = OFTEN, letters: int = LETTERS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``docs`` (doc_id, text)."""
    s = Scratch(spark, "spelling")
    words = s.keep(vocabulary(docs, often), "words")
    near = words.join(near_words(words, letters), "word", "left")
    enough = F.col("best_n") >= TIMES * F.col("n")
    formed = s.keep(
        near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n")), "forms"
    )
    last = roots(formed.where("form is not null").select("word", "form"), s)
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op12_bit_sliced_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return variants(spark, docs).select("word", "form", "root", "n", "n_near", "form_n")
