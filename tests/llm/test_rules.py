"""Boosted-tree rules: counts by brute force, monotonic scores, held-out accuracy."""

import random
import re
import zlib

import numpy as np
import pytest

from hourcast.llm import rules, sampling


def brute(text):
    """The contract's counts, word by word and window by window."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    where = {}
    for i in range(len(words) - 7):
        where.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for found in where.values() if len(found) > 1 for i in found for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(inside)


def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "a b c d e f g h", "a b c d e f g h " * 2, "\n\n\n", "x\nx\n x\nx", "ä#ö% ü| z", "😀 <b> & * $"]
    for _ in range(400):
        n = rng.choice([1, 2, 3, 50])
        out.append(rng.choice(["", " ", "\n"]).join(f"{rng.choice('abÄ#')}{rng.randrange(n)}{rng.choice([' ', chr(10), chr(11), '  '])}" for _ in range(rng.randrange(0, 80))))
    return out


def test_counts_of_any_text():
    for t in texts():
        assert rules.measured((t or "").encode())[0] == brute(t), t


def test_texts_of_few_repeated_words():
    """Also those with fewer words than a window, whose shorter stretches are found twice."""
    for n in range(20):
        for period in (1, 2, 3, 4):
            t = " ".join("abcd"[k % period] for k in range(n))
            assert rules.measured(t.encode())[0] == brute(t), t


def test_query_counts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = rules.op11_monotone_trees(spark, docs, labels).collect()
    assert len(rows) == len(text)
    for r in rows:
        want = brute(text[r["doc_id"]])
        assert tuple(r[c] for c in rules.COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= rules.THRESHOLD)


@pytest.fixture(scope="module")
def trees():
    """Labels that want rising scores on falling statistics too, so the constraint has something to forbid."""
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(rules.FEATURES)))
    y = ((np.sin(x[:, 2] * 9) + x[:, 3] - x[:, 4] + x[:, 0] * x[:, 8] + rng.normal(0, 0.3, 3000)) > 0.6).astype(float)
    return rules.fit(x, y, np.ones(3000)), x, y


def test_scores_never_rise_with_a_falling_statistic(trees):
    net, x, _ = trees
    for name in rules.FALLING:
        column = rules.FEATURES.index(name)
        grid = np.repeat(x[:200, None, :], 40, axis=1)
        grid[:, :, column] = np.linspace(-0.1, 1.1, 40)
        scores = net.scores(grid.reshape(-1, x.shape[1])).reshape(200, 40)
        assert (np.diff(scores, axis=1) <= 1e-12).all()
    free = rules.FEATURES.index("log_words")
    grid = np.repeat(x[:200, None, :], 40, axis=1)
    grid[:, :, free] = np.linspace(0, 1, 40)
    assert np.ptp(net.scores(grid.reshape(-1, x.shape[1])).reshape(200, 40), axis=1).max() > 0.05


def test_flat_arrays_are_the_trees(trees):
    net, x, _ = trees

    def walk(row, node):
        if net.left[node] == node:
            return net.value[node]
        return walk(row, net.left[node] + (row[net.feature[node]] > net.threshold[node]))

    for row in x[:50]:
        assert np.isclose(net.odds(row[None, :])[0], net.start + sum(walk(row, r) for r in net.roots))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in rules.op11_monotone_trees(spark, docs, labels).collect() if r["doc_id"] in label and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    good = [r["kept"] for r in rows if label[r["doc_id"]] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if label[r["doc_id"]] == 0]
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.2


def test_sample_is_drawn_by_row(spark):
    """One id, or none, on all rows; repeated and contradicting labels."""
    rows = spark.range(3000).selectExpr("id AS row", "if(id % 3 = 0, null, 7L) AS doc_id", "concat('text ', id) AS text", "if(id % 10 = 0, 'a', 'b') AS lang")
    drawn, share = sampling.by_label(rows.select("row", "lang"), "lang", 200)
    assert {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()} == {"a": 200, "b": 200}
    assert share == {"a": 200 / 300, "b": 200 / 2700}
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, sampling.by_label(rows.select("row", "lang"), "lang", 200)[0].collect()))
    labels = spark.createDataFrame([(7, 1), (7, 1), (7, 0), (8, 1), (8, 0), (None, 1), (9, None), (9, 2)], "doc_id long, quality int")
    assert [tuple(r) for r in sampling.one_label(labels, "quality").collect()] == [(7, 1)]
    got, share = sampling.texts(rows.select("row", "doc_id", "text"), labels, "quality", 500)
    assert got.count() == 500 and share == {1: 500 / 2000}
    assert len({r["row"] for r in got.collect()}) == 500
