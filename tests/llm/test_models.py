"""Classifiers by held-out accuracy, the language model against brute force."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from hourcast.llm import language, lm, quality, words
from hourcast.llm.common import Scratch


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.op2_byte_cnn(spark, docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_training_is_repeatable(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first, second = (sorted(map(tuple, language.op2_byte_cnn(spark, docs).collect())) for _ in range(2))
    assert first == second


def test_windows_cover_the_whole_text():
    sizes = [0, 1, 127, 128, 129, 1000]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    start, end, text = language.windows(np.zeros(bounds[-1], np.uint8), bounds)
    for k, n in enumerate(sizes):
        own = start[text == k] - bounds[k]
        reach = sorted((a, min(a + language.BYTES, n)) for a in own.tolist())
        assert reach[0][0] == 0 and reach[-1][1] == n
        # neighbours overlap, so no filter's place is lost
        assert all(b[0] <= a[1] - max(language.WIDTHS) + 1 for a, b in zip(reach, reach[1:], strict=False))


def test_both_ways_of_pooling_agree():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, language.BYTES), dtype=np.uint8)
    net = language.fit(x, rng.integers(0, 3, 40), ["a", "b", "c"])
    assert np.allclose(net.kept(x), net.pooled(x)[0], atol=1e-5)


def test_quality_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    label = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.op5_random_indexing(spark, docs, labels).collect() if r["held_out"] and r["doc_id"] in label]
    right = lambda y: [r["predicted"] == y for r in rows if label[r["doc_id"]] == y]
    assert sum(right(1)) / len(right(1)) >= 0.98 and sum(right(0)) / len(right(0)) >= 0.85


TERM = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")


def form(term):
    """The form of a term, as the module's text has it."""
    if term[0].isdecimal():
        return "0", min(len(term), 8)
    if re.match(r"[^\W\d_]", term):
        case = "A" if term.isupper() and len(term) > 1 else "a" if term.islower() else "Aa" if len(term) == 1 or (term[0].isupper() and term[1:].islower() and all(c.islower() for c in term[1:])) else "aA"
        return case, min(len(term) // 3, 6)
    return "mark", term[:3]


def hash_of(word):
    return quality.terms_of([word]).word


def test_terms_words_and_forms():
    rng = np.random.default_rng(7)
    texts = ["".join(map(chr, rng.integers(0, 256, 80))) for _ in range(200)] + ["Ωμέγα ABC Abc aBc a A ½x 12 ١٢ !!!! __ 日本語", None, "", "İstanbul ǅ ß"]
    got = quality.terms_of(texts)
    terms = [(i, x) for i, t in enumerate(texts) for x in TERM.findall(t or "")]
    assert got.text.tolist() == [i for i, _ in terms]
    lower = ["".join(c.lower() if len(c.lower()) == 1 else c for c in x) for _, x in terms]
    for hashes, names in ((got.exact, [x for _, x in terms]), (got.word, lower), (got.form, [form(x) for _, x in terms])):
        pairs = set(zip(hashes.tolist(), names, strict=True))
        assert len(pairs) == len({h for h, _ in pairs}) == len({x for _, x in pairs})


def test_pooling_by_hand(spark):
    """Means over words and distinct words, of words and forms, one text at a time and in any company."""
    texts = ["one two two Two", None, "", "a", "!! !! x 12 12 12", "one two three one", "Ωμέγα ωμέγα"]
    known = quality.trained(spark.createDataFrame([(t,) for t in texts], "text string"), quality.Scratch(spark, "pool"))
    for text, got in zip(texts, quality.pooled(texts, known), strict=True):
        terms = TERM.findall(text or "")
        again = sum(a == b for a, b in zip(terms, terms[1:], strict=False))
        if not terms:
            assert not got.any()
            continue
        counts = {t: terms.count(t) for t in terms} | ({"<again>": again} if again else {})
        word = {t: known.vectors(hash_of(t))[0] if t != "<again>" else np.zeros(quality.SIZE) for t in counts}
        shape = {t: quality.form_vectors(quality.terms_of([t]).form if t != "<again>" else np.array([quality.AGAIN], np.uint64))[0] for t in counts}
        means = [sum(f(t) * side[t] for t in counts) / total for side in (word, shape) for f, total in ((counts.get, len(terms)), (lambda t: 1, len(counts)))]
        want = np.concatenate([*means, [1, np.log(len(terms)), len(counts) / len(terms)]])
        assert np.allclose(got, want, atol=1e-5) and np.allclose(quality.pooled([text], known)[0], got, atol=1e-6)


def test_word_vectors_of_all_documents(spark):
    """Of documents without a label too, of words seen once, past the first terms, however the rows are dealt."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'Wort' if k % 2 else 'wort'}{'abcdefghij'[x]}" for k, x in enumerate(rng.integers(0, 10, n))) for n in (0, 1, 2, 3, 50, 30_000)]
    texts += ["einmal hier", "allein", None]
    want: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(quality.SIZE))
    index = {}
    for t in texts:
        terms = [x.lower() for x in TERM.findall(t or "")]
        index |= {w: quality.index_counts(hash_of(w))[0] for w in set(terms) - index.keys()}
        for i, w in enumerate(terms):
            for j in range(max(0, i - quality.AROUND), min(len(terms), i + quality.AROUND + 1)):
                want[w] += index[terms[j]] if i != j else 0
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    known = quality.train(spark, docs, labels).words
    for w, v in want.items():
        norm = np.linalg.norm(v)
        assert np.allclose(known.vectors(hash_of(w))[0], quality.index_vectors(hash_of(w))[0] + (v / norm if norm else 0), atol=1e-6)


def brute_lm(texts, order):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    ends = [None] * (order - 1)
    grams = lambda w: [tuple([*ends, *w][j : j + order]) for j in range(len(w))]
    c, a = Counter(), {order: Counter()}
    for i, w in tokens.items():
        if not held[i]:
            c.update(w)
            a[order].update(grams(w))
    for k in range(order - 1, 0, -1):
        a[k] = Counter(g[1:] for g in a[k + 1])
    d, every, left = {}, defaultdict(int), defaultdict(float)
    for k, counts in a.items():
        d[k] = (0.0, *lm.discounts(*[sum(x == n for x in counts.values()) for n in (1, 2, 3, 4)]))
        for g, n in counts.items():
            every[g[:-1]] += n
            left[g[:-1]] += d[k][min(n, 3)]

    def p(g):
        below = p(g[1:]) if len(g) > 1 else 1 / (len(c) + 1)
        h, n = g[:-1], a[len(g)][g]
        return (n - d[len(g)][min(n, 3)] + left[h] * below) / every[h] if h in every else below

    total = sum(c.values())
    out = {}
    for i, w in tokens.items():
        base = sum(math.log10((c[v] + 1) / (total + len(c) + 1)) for v in w)
        out[i] = (held[i], len(w), sum(v in c for v in w), total, base, sum(math.log10(p(g)) for g in grams(w)))
    return out, p, c, a[order]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_against_brute_force(spark, small, order):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want, p, c, grams = brute_lm({r["doc_id"]: r["text"] for r in docs.collect()}, order)
    got = {r["doc_id"]: r for r in lm.op6_kneser_ney(spark, docs, order).collect()}
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        # the query shows six places
        for got_, want_ in ((r["base_score"], base), (r["score"], score), (r["perplexity"], 10 ** (-score / n))):
            assert got_ == pytest.approx(want_, abs=6e-7, rel=1e-12)
    # probabilities of all words and of one unknown word make one
    for h in [g[:-1] for g in list(grams)[:3]] + [("never", *["seen"] * order)[: order - 1]]:
        assert sum(p((*h, v)) for v in c) + p((*h, "never seen")) == pytest.approx(1)


def test_unseen_ends_and_one_text(spark):
    assert [r["n_tokens"] for r in lm.op6_kneser_ney(spark, spark.createDataFrame([(3, None), (3, "")], "doc_id long, text string"), 4).collect()] == [1, 1]


def test_no_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm.op6_kneser_ney(spark, spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)


def test_packing_round_trip():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (lm.from_planes(lm.pack(lm.planes(keys))) == keys).all()
    (_, _, data, bounds), = words.runs(pa.array(["a b", "", "c"]))
    tokens, firsts = lm.with_ends(*words.word_hashes(data, bounds))
    assert firsts.tolist() == [0, 3, 4, 6] and (tokens[[2, 3, 5]] == words.END).all()


def test_sums_of_many_parts_are_added_one_at_a_time():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64))
    want, rows = {}, []
    for _ in range(40):
        keys = np.append(pool[:1], np.sort(rng.choice(pool[1:], 2000, replace=False)))
        sums = rng.integers(-3, 4, (len(keys), quality.SIZE)).astype(np.int32)
        sums[0] = 2**29  # more than 32 bits in all
        for k, v in zip(keys.tolist(), sums.astype(np.int64), strict=True):
            want[k] = want.get(k, 0) + v
        own = ((sums << 1) ^ (sums >> 31)).astype("<u4")
        rows.append((1, lm.pack(lm.planes(keys)), quality.squeezed(own.view(np.uint8).reshape(-1, 4).T.copy())))
    pdf = pd.DataFrame(rows, columns=["bucket", "keys", "sums"])
    tracemalloc.start()
    keys, sums = quality.added(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert keys.tolist() == sorted(want)
    assert (sums == np.array([want[k] for k in keys.tolist()])).all()
    assert peak < 16 * len(keys) * quality.SIZE * 4  # 40 parts of half the words each took more side by side


def test_stored_keys_and_counts_are_found(tmp_path):
    rng = np.random.default_rng(3)
    root = str(tmp_path)
    for n, lead in ((1, 4), (5, 4), (3000, 4), (40000, 9), (200, 60)):
        first = rng.integers(0, 2**lead, dtype=np.uint64) << np.uint64(64 - lead)
        drawn = rng.integers(0, 2 ** (64 - lead), 2 * n, dtype=np.uint64) | first
        keys = np.unique(drawn[: max(1, n)])
        asked = np.unique(drawn)
        lm.put_keys(root, f"{n}", keys, lead)
        which, at, stored = lm.find(root, f"{n}", asked, lead)
        assert stored == len(keys) and (keys[at] == asked[which]).all() and len(which) == len(keys)
    # near misses: equal in their last 32 bits
    keys = np.unique(rng.integers(0, 2**60, 1000, dtype=np.uint64))
    lm.put_keys(root, "near", keys, 4)
    assert not len(lm.find(root, "near", np.setdiff1d(keys ^ np.uint64(1 << 33), keys), 4)[0])
    for most in (2, 3, 9, 300, 2**40):
        columns = [np.minimum(rng.geometric(0.5, 777), most), np.zeros(777, np.int64), rng.integers(0, most, 777)]
        lm.put_counts(root, f"c{most}", columns)
        assert (lm.counts_at(root, f"c{most}", np.arange(3 * 777)) == np.concatenate(columns)).all()


def test_model_takes_little_disk(spark):
    """Of N trigrams and M bigrams the files once held 9 N + 13 M bytes and more."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{w}" for w in np.minimum(rng.zipf(1.2, 400), 50_000)) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    s = Scratch(spark, "lm")
    model = lm.train(spark, docs, s)
    grams = {k: {g for t in texts for w in [["", "", *t.split(), ""]] for g in zip(*[w[2 - k + 1 + j :] for j in range(k)], strict=False)} for k in (2, 3)}
    files = [f for f in Path(s.root).iterdir() if f.name[:2] in ("2-", "3-")]
    assert sum(f.stat().st_size - 128 for f in files) < 8 * len(grams[3]) + 10.5 * len(grams[2])
    # frequent words have small numbers
    (_, _, data, bounds), = words.runs(pa.array(["w1 w2 w3"]))
    assert (model.numbers(np.sort(words.word_hashes(data, bounds)[0])) < 16 << model.bits).all()


def test_beginnings_share_a_bucket_unless_frequent():
    model = lm.Model("", 2, 3, [100_000] * 4, 0)
    column = lambda *x: np.array(x, np.int64)
    last = np.arange(5000)
    rare = model.keys([np.full(5000, 7), np.full(5000, 300_000), last])
    assert len(np.unique(model.bucket(3, rare))) == 1 and model.bucket(3, rare)[0] == model.bucket(2, model.keys([column(7), column(300_000)]))[0]
    frequent = model.keys([np.full(5000, 7), np.full(5000, 8), last])
    assert np.bincount(model.bucket(3, frequent), minlength=16).max() < 2 * 5000 / 16
    assert len(np.unique(rare)) == len(np.unique(frequent)) == 5000


def test_many_buckets_stay_mapped_and_are_looked_up_for_long_runs(tmp_path):
    """As many as 6 GB of text have: all arrays of a worker fit its cache, and a look into all buckets serves more text."""
    many, few = (lm.Model(str(tmp_path), bits, 3, [0] * (1 << bits), 0) for bits in (8, 2))
    assert lm.get.cache_info().maxsize > 10 * (1 << many.lead) + 3 * (1 << many.bits)
    texts = pa.array(["a b c " * 100] * 20000)
    assert many.run_bytes == 4 * words.RUN_BYTES and few.run_bytes == words.RUN_BYTES
    runs = list(words.runs(texts, many.run_bytes))
    assert len(runs) == 4 < len(list(words.runs(texts, few.run_bytes)))
    assert [a for a, *_ in runs] == [0, *(z for _, z, *_ in runs[:-1])] and runs[-1][1] == len(texts)
