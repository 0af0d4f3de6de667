import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm.ngram_join import _narrow, _shared, _signatures, candidate_groups, fold, ngram_join, survivors

SCHEMA = "doc_id long, text string, n int, digest string, key string"


def brute(rows, k=5, threshold=90):
    sets = {}
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[^\x20\x09-\x0d]+", low)
        grams = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())
        sets[i] = grams
    near = {i: set() for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            near[a].add(b)
            near[b].add(a)
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(sets[i]), len(near[i]), min(seen))
    return out


def corpus(seed, n_base=12):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["Été", "ß", "Á"]
    rows = []
    for _ in range(n_base):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 12, 30, 120, 600]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(t))
                t[at : at + rng.choice([0, 1])] = [rng.choice(words)]
            rows.append(rng.choice([" ", "\n", "\t "]).join(t))
    rows += ["", None, " \t", "one two", "ONE  TWO", "a b c d e", "A b c d e", "  x y", "same same same same same same"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_against_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA).repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join(df).collect()}
        assert got == brute(rows)


def test_cut_groups_lose_nothing(spark):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(300)]
    rows = []
    for i in range(70):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join(df, task_sets=16, task_shingles=4000).collect()}
    assert got == brute(rows)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(1, text, 1, "x", "k"), (1, text, 1, "x", "k"), (2, text, 2, None, None), (3, None, 3, "", "")], SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join(rows).collect())
    assert got == [(1, 46, 2, 1), (1, 46, 2, 1), (2, 46, 2, 1), (3, 0, 0, 3)]
    kept = survivors(rows)
    assert kept.columns == rows.columns
    assert sorted({r["doc_id"] for r in kept.collect()}) == [1, 3]


def test_long_text_spans_chunks(spark):
    long = " ".join(f"w{i % 9973}x{i}" for i in range(200_000))
    rows = spark.createDataFrame([(1, long, 1, "", ""), (2, long + " tail", 1, "", ""), (3, "tiny", 1, "", "")], SCHEMA)
    got = {r["doc_id"]: (r["n_similar"], r["component_id"]) for r in ngram_join(rows).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}


def links(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in df.collect()), key=str)


def test_repeated_rows_with_a_near_copy(spark):
    a = " ".join(f"w{i}" for i in range(104))
    b = a + " tail"
    rows = spark.createDataFrame([(1, a, 1, "", ""), (1, a, 1, "", ""), (2, b, 1, "", "")], SCHEMA)
    assert links(ngram_join(rows)) == [(1, 100, 2, 1), (1, 100, 2, 1), (2, 101, 2, 1)]
    many = spark.createDataFrame([(1, a, 1, "", "")] * 5 + [(2, b, 1, "", "")] * 3, SCHEMA).repartition(4)
    assert links(ngram_join(many)) == [(1, 100, 7, 1)] * 5 + [(2, 101, 7, 1)] * 3


def test_rows_without_id_link(spark):
    a = " ".join(f"w{i}" for i in range(104))
    rows = spark.createDataFrame([(None, a, 1, "", ""), (None, a + " x", 1, "", ""), (7, a + " x y", 1, "", ""), (None, "alone", 1, "", "")], SCHEMA)
    assert links(ngram_join(rows)) == [(7, 102, 2, 7), (None, 1, 0, None), (None, 100, 2, 7), (None, 101, 2, 7)]
    nameless = spark.createDataFrame([(None, a, 1, "", ""), (None, a + " x", 1, "", "")], SCHEMA)
    assert links(ngram_join(nameless)) == [(None, 100, 1, None), (None, 101, 1, None)]
    assert survivors(rows).count() == 4


def test_cut_buckets_lose_nothing(spark):
    rng = random.Random(4)
    rows = []
    for g in range(3):
        base = [f"t{g}_{i}" for i in range(150)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    df = spark.createDataFrame([(i, t, 1, "x", None) for i, t in rows], SCHEMA).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["n_similar"], r["component_id"]) for r in ngram_join(df, bucket_sets=5).collect()}
    assert got == brute(rows)


def test_buckets_are_told_once_across_batches():
    rng = np.random.default_rng(3)
    rows = sorted((int(k), int(c)) for k, c in zip(rng.integers(0, 40, 500), rng.integers(0, 30, 500)))
    by = {}
    for k, c in rows:
        by.setdefault(k, set()).add(c)
    want = sorted((k, c, i // 4) for k, cs in by.items() if len(cs) > 1 for i, c in enumerate(sorted(cs)))
    for width in (1, 2, 3, 7, 500):
        cut = [rows[i : i + width] for i in range(0, len(rows), width)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([c for _, c in p], pa.int64())], ["key", "cid"]) for p in cut]
        got = sorted(tuple(r.values()) for b in _shared(4)(iter(batches)) for r in b.to_pylist())
        assert got == want


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (3, 40, 300, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.unique(np.concatenate((a[n // 20 :], rng.integers(0, 1 << 63, n // 15 + 1, dtype=np.uint64))))
        a = np.unique(a)
        x, y = _narrow([fold(a), fold(b)])
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_unrelated_sets_do_not_grow_together(spark):
    """40,000 sets of 80 to 120 random shingles: some share a bucket, none passes for a candidate."""
    rng = random.Random(8)
    rows = [(i, " ".join(map(str, rng.choices(range(10**7), k=rng.randint(84, 124)))), 1, "", "") for i in range(40_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("doc_id", "text")
    classes = df.mapInArrow(_signatures(5), "doc_id long, n long, digest binary, sketch binary").withColumn("cid", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    found = candidate_groups(df, classes, 5, 90, 4096)
    assert found.groupBy("component").count().where("count > 3").count() == 0
    assert found.count() < 40
