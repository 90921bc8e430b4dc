"""Periodic runs against brute force: random streams, whole tables, any way of appending."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hourcast.llm import periodic


def brute(x):
    """(start, length, period) of all runs, from every period's stretches of equal words."""
    found = {}
    for p in range(1, len(x) // 4 + 1):
        i = 0
        while i + p < len(x):
            start = i
            while i + p < len(x) and x[i] == x[i + p]:
                i += 1
            if i > start and i + p - start >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
            i += i == start
    return sorted((a, z - a, p) for (a, z), p in found.items())


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for a, size, p in runs for i in range(a + p, a + size)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, sha("".join(f"{a},{size},{p}\n" for a, size, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = sorted(expected(r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(map(tuple, periodic.op13_periodic_runs(spark, docs).collect())) == want
    assert sum(w[1] > 0 for w in want) > 10


def repetitive(rng, size):
    out, k = [], rng.randrange(1, 4)
    while len(out) < size:
        word = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
        out += (word * 9)[: rng.randrange(1, len(word) * 8)]
    return np.array(out, np.int64)


def test_streams_of_documents_in_any_pieces():
    rng = random.Random(4)
    for _ in range(150):
        documents = [repetitive(rng, rng.randrange(0, 150)) if rng.random() < 0.9 else np.zeros(0, np.int64) for _ in range(rng.randrange(1, 4))]
        want = [brute(d.tolist()) for d in documents]
        for chunk in (1, rng.randrange(2, 40), 1 << 16):
            assert periodic.stream_runs(documents, chunk=chunk) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(2, 5))
def test_squares_and_higher_powers(x, exponent):
    """Runs of any least exponent, squares included."""
    got = periodic.stream_runs([np.array(x, np.int64)], exponent, exponent)[0]
    want = {}
    for p in range(1, len(x) // exponent + 1):
        same = [x[i] == x[i + p] for i in range(len(x) - p)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            if j - i >= (exponent - 1) * p:
                want.setdefault((i, j + p), p)
            i = max(j, i + 1)
    assert got == sorted((a, z - a, p) for (a, z), p in want.items())


def test_online_runs_are_known_as_words_arrive():
    catchers = periodic.Catchers()
    for k, w in enumerate([5, 1, 2, 1, 2, 1, 2, 1, 2, 7, 7, 7, 7, 7, 7]):
        catchers.append(np.array([w]))
        if k == 9:
            assert catchers.runs() == [(1, 8, 2)]
    assert catchers.runs() == [(1, 8, 2), (9, 6, 1)]


def test_equal_hashes_give_no_run(monkeypatch):
    """What the hashes choose is compared word by word."""
    monkeypatch.setattr(periodic, "mix", lambda x: np.zeros_like(x))
    rng = random.Random(6)
    for _ in range(40):
        x = repetitive(rng, 60)
        assert periodic.stream_runs([x]) == [brute(x.tolist())]
    assert periodic.stream_runs([np.arange(100)]) == [[]]


def test_long_streams():
    assert periodic.stream_runs([np.zeros(50_000, np.int64)]) == [[(0, 50_000, 1)]]
    word = np.random.default_rng(1).integers(0, 1 << 40, 9_000)
    assert periodic.stream_runs([np.tile(word, 5)[:40_000]], chunk=1000) == [[(0, 40_000, 9_000)]]


def test_odd_rows(spark, odd, none):
    got = sorted(map(tuple, periodic.op13_periodic_runs(spark, odd.where("doc_id <> 8 OR doc_id IS NULL")).collect()), key=repr)
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 8), key=repr)
    assert periodic.op13_periodic_runs(spark, odd.where("doc_id = 8")).count() == 1
    assert periodic.op13_periodic_runs(spark, none).collect() == []
