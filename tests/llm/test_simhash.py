import hashlib

from pyspark.sql import functions as F

from hourcast.llm import simhash


def test_edits_follow_the_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (j, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 2
        edited = text[: len(text) - k] + after[:k]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert got[i]["near_next"] == bits(got[i]["fingerprint"], got[j]["fingerprint"])
        assert got[i]["near_edited"] == bits(got[i]["fingerprint"], got[i]["edited_fingerprint"])


def test_ids_that_many_rows_have(spark):
    # no id for a third of the rows, one id for another: cut into ranges, in the order of hash and text
    rows = [(None, f"null {i}") for i in range(400)] + [(50, f"fifty {i % 300}") for i in range(400)] + [(i, f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bounds, slices = simhash.ranges(spark, docs)
    assert slices[0] > 4 and max(slices[1:]) > 4 and len(slices) == len(bounds) + 2
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))
    want = sorted(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for a, b in zip([r["text"] for r in order], [r["text"] for r in order[1:] + order[:1]], strict=True))
    edits = simhash.edits(spark, docs).where("not extra")
    assert sorted(hashlib.sha256(r["edited"].encode()).hexdigest() for r in edits.collect()) == want
    per = [r["count"] for r in edits.groupBy("part").count().collect()]
    assert max(per) < 150


def test_one_document_follows_itself(spark):
    r = simhash.op8_simhash(spark, spark.createDataFrame([(3, "ab cd")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and r["near_next"] == 1.0


def test_votes_against_brute_force(spark):
    texts = [(1, "a bb ccc a"), (2, "ccc"), (3, ""), (4, "a " * 70_000)]
    df = spark.createDataFrame(texts, "k long, text string")
    got = {r["k"]: r["fp"] for r in simhash.fingerprints(df, ["k"]).collect()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([("a",), ("bb",), ("ccc",)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    for k, text in texts:
        votes = [sum(len(w) * (1 if hashes[w] >> b & 1 else -1) for w in text.split()) for b in range(64)]
        assert got[k] & (1 << 64) - 1 == sum(1 << b for b, v in enumerate(votes) if v > 0)


def test_links_are_all_within_the_radius(spark):
    import random

    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            x = f
            for b in rng.sample(range(64), n):
                x ^= 1 << b
            fps.append(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps] + [None, 0, 0]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    distinct = sorted({x for x in signed if x is not None})
    for radius in (0, 1, 3):
        want = {(a, b) for i, b in enumerate(distinct) for a in distinct[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert {(r["a"], r["b"]) for r in simhash.links(df, radius).collect()} == want


def test_one_shuffle_of_the_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = simhash.op8_simhash(spark, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_finds_all_near_documents(spark, small):
    rows = simhash.op8_simhash(spark, spark.read.parquet(f"{small}/documents.parquet")).collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    assert any(r["near_docs"] for r in rows)
    for r, f in zip(rows, fps, strict=True):
        near = [g for g in fps if (f ^ g).bit_count() <= simhash.RADIUS]
        assert (r["near_fingerprints"], r["near_docs"]) == (len(set(near)) - 1, len(near) - 1)


def test_near_copies_that_are_not_neighbours(spark):
    text = " ".join(f"word{i}" for i in range(400))
    far = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(1, 40)]
    docs = spark.createDataFrame([(0, text), *far, (40, text + " end"), (41, "other words here"), (42, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.op8_simhash(spark, docs).collect()}
    assert [got[i]["near_docs"] for i in (0, 40, 42, 41)] == [2, 2, 2, 0]


def test_split_cells(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") * 7 % 1024).alias("fp"))
    whole = sorted(map(tuple, simhash.links(df).collect()))
    monkeypatch.setattr(simhash, "CELL", 16)
    assert sorted(map(tuple, simhash.links(df).collect())) == whole and len(whole) > 1000
