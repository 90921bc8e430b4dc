"""Spelling variants against brute force over whole tables and made-up vocabularies."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from hourcast.llm import spelling
from hourcast.llm.common import Scratch


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return counts


def one_apart(a, b):
    """Whether some one letter replaced, inserted or deleted makes ``b`` of ``a``."""
    if len(a) > len(b):
        a, b = b, a
    lead = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    if len(a) == len(b):
        return lead < len(a) and a[lead + 1 :] == b[lead + 1 :]
    return len(b) == len(a) + 1 and a[lead:] == b[lead + 1 :]


def brute(counts):
    """(word, form, root, n, n_near, form_n) from all pairs of words."""
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [u for k in (-1, 0, 1) for u in by_size.get(len(w) + k, []) if one_apart(w, u)] for w in counts}
    best = {w: min(us, key=lambda u: (-counts[u], u)) for w, us in near.items() if us}
    form = {w: b for w, b in best.items() if counts[b] >= 5 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def result(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = counted([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = brute({w: n for w, n in counts.items() if n >= 5})
    got = result(spelling.op12_bit_sliced_variants(spark, docs))
    assert len(got) == len(want) and set(got) == want


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["prefix" + "".join(rng.choice("ab") for _ in range(7)) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(4):
            k = rng.randrange(len(w))
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcÿ") + w[k:], w[:k] + rng.choice("abcÿ") + w[k + 1 :]]))
    return {w: rng.choice([5, 6, 30, 30, 200, 1100, 6000]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("letters", [spelling.LETTERS, 400, 60])
def test_hot_halves_are_searched_in_parts(spark, vocabulary, letters):
    """Blocks of any size, also those that one half shared by many words overfills, give each pair once."""
    words = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(words, letters).collect()}
    want = {}
    for w in vocabulary:
        near = [u for u in vocabulary if one_apart(u, w)]
        if near:
            b = min(near, key=lambda u: (-vocabulary[u], u))
            want[w] = (len(near), vocabulary[b], b)
    assert got == want
    if letters == 60:
        assert spelling.dealt(words, letters).agg({"part": "max"}).first()[0] > 0


def test_one_walk_tracks_all_errors():
    words = ["abcdef", "abcdeg", "xbcdef", "bcdefg", "abcdefg", "aabcdef", "abcxdef", "abdcef"]
    index = spelling.Index(spelling.letters_of(words, 7), 6)
    found = index.near(spelling.letters_of(["abcdef"], 6), 6, True)[0]
    assert [w for k, w in enumerate(words) if found[0] >> np.uint64(k) & np.uint64(1)] == ["abcdeg", "abcdefg", "abcxdef"]
    found = index.near(spelling.letters_of(["abcdef"], 6), 6, False)[0]
    assert [w for k, w in enumerate(words) if found[0] >> np.uint64(k) & np.uint64(1)] == ["xbcdef", "aabcdef"]


def test_long_words(spark):
    long = "abcdefghij" * 300
    words = {long: 5, long[:1500] + "x" + long[1500:]: 50, long[:-1]: 7, long[1:]: 7, "x" + long[1:]: 7}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(frame).collect()}
    assert got[long] == (4, long[:1500] + "x" + long[1500:]) and got[long[1:]] == (2, "x" + long[1:])


def test_roots_follow_long_chains(spark):
    chain = [f"word{chr(97 + i)}" for i in range(27)]
    forms = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [("other", "worda")], "word string, form string")
    got = dict(map(tuple, spelling.roots(forms, Scratch(spark, "chain")).collect()))
    assert set(got.values()) == {chain[-1]} and len(got) == 27


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute({w: n for w, n in counted(rows).items() if n >= 2})
    assert set(result(spelling.variants(spark, odd, often=2))) == want and want
    assert result(spelling.op12_bit_sliced_variants(spark, odd)) == []
    assert result(spelling.op12_bit_sliced_variants(spark, none)) == []


def test_empty_block():
    pdf = pd.DataFrame({"shorter": [6], "first_half": [True], "word": ["abcdef"], "n": [5], "held": [False], "asked": [True]})
    assert len(spelling.searched(pdf)) == 0
