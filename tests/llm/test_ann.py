import math

import numpy as np

from quillspark.llm import ann
from quillspark.llm.ann import fit, op3_ann_search, search

SCHEMA = "vec_id long, embedding array<float>, score string, rank int"


def exact(rows, k=20):
    use = {i: np.array(v, dtype=np.float64) for i, v in rows}
    ids = np.array(sorted(use))
    x = np.stack([use[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = x @ use[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), s[j]) for j in order]
    return out


def recall(got, want):
    hit = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hit / sum(map(len, want.values()))


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_the_table(spark):
    for sf in ("sf0.01", "sf0.1"):
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
        got, want = collect(op3_ann_search(spark, f"/root/testdata/{sf}")), exact(rows)
        assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
        assert recall(got, want) >= 0.95
        lookup = {i: np.array(v, np.float64) for i, v in rows}
        for q, found in got.items():
            assert q not in [v for v, _ in found]
            assert found == sorted(found, key=lambda t: (-t[1], t[0]))
            assert all(math.isclose(s, float(lookup[q] @ lookup[v]), rel_tol=1e-12, abs_tol=1e-15) for v, s in found)


def test_clusters_and_a_hot_cell(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    rows = [(i, (centres[i % 30] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(3000 + i, [1.0] * 16) for i in range(1500)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    got = collect(search(df, df.where("vec_id % 20 = 0"), block_rows=300, group_rows=700))
    want = exact(rows)
    kth = {q: w[-1][1] for q, w in want.items()}
    good = sum(s >= kth[q] - 1e-9 for q, found in got.items() for _, s in found)
    assert good >= 0.95 * sum(map(len, want.values()))


def test_rows_that_take_no_part(spark):
    ok = [(i, [float(i % 7) + 1, float(i % 3), 0.5, -1.0]) for i in range(12)]
    bad = [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, None, 2.0, 3.0]), (104, [1.0, float("nan"), 0.0, 0.0]), (105, [float("inf"), 0.0, 0.0, 0.0]), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0]), (120, None)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in ok + bad + ok[:3]], SCHEMA)
    got = collect(search(df, df.where("vec_id % 20 = 0")))
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in exact(ok).items()}
    assert search(df.limit(0), df.limit(0)).count() == 0
    assert search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0
    assert search(df.where("vec_id = 100"), df).columns == ["query_id", "rank", "vec_id", "score"]


def test_copies_go_by_the_smaller_id_and_take_one_place(spark):
    rng = np.random.default_rng(9)
    hot = np.array([4.0, 1.0, 1.0, 1.0] * 4)
    rows = [(int(i), hot.tolist()) for i in rng.permutation(3000) + 1000]
    rows += [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(200)]
    rows += [(7000 + i, (hot * 1.001 + rng.normal(size=16) * 1e-4).astype(np.float32).tolist()) for i in range(15)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    asked = [1000, 2000, 3980, 7000]
    got = collect(search(df, df.where(df.vec_id.isin(asked))))
    want = exact(rows)
    for i in asked:
        assert [v for v, _ in got[i]] == [v for v, _ in want[i]]


def test_one_id_with_many_vectors_takes_one_place(spark):
    rng = np.random.default_rng(3)
    rows = [(50_001, [9.0 + j / 1000, 1.0, 1.0, 1.0]) for j in range(300)] + [(i, (rng.normal(size=4) + 1).tolist()) for i in range(400)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    got = collect(search(df, df.where("vec_id = 20"), max_cells=1))[20]
    want = {}
    q = np.array(dict(rows)[20], np.float32).astype(float)
    for i, v in rows:
        if i != 20:
            want[i] = max(want.get(i, -np.inf), float(np.array(v, np.float32).astype(float) @ q))
    best = sorted(want, key=lambda i: (-want[i], i))[:20]
    assert [v for v, _ in got] == best


def test_cells_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "TOP", 8)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16)) * 3
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(5500)]
    rows += [(5500 + i, [1.0] * 16) for i in range(2500)] + [(9000, None)]
    df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)
    index = fit(df.selectExpr("vec_id AS id", "embedding AS vec"), 20, 20_000, 1 << 16, 0.97)
    assert index.cells > 60 == len(centres) and len(index.top) == 8 and index.first[-1] == index.cells == len(index.rows)
    assert abs(index.rows.sum() - 8000) < 1 and index.probes < index.cells / 2
    x = np.array([v for _, v in rows[:500]], np.float32)
    near = index.nearest(x)
    above = ((x[:, None, :] - index.top[None]) ** 2).sum(2).argmin(1)
    for i in range(500):
        mine = np.arange(index.first[above[i]], index.first[above[i] + 1])
        away = ((index.coarse[mine] - x[i]) ** 2).sum(1)
        assert near[i] in mine and away[near[i] - mine[0]] <= away.min() + 1e-3
    got = collect(search(df, df.where("vec_id % 20 = 0")))
    want = exact([r for r in rows if r[1]])
    kth = {q: w[-1][1] for q, w in want.items()}
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    good = sum(s >= kth[q] - 1e-9 for q, found in got.items() for _, s in found)
    assert good >= 0.95 * sum(map(len, want.values()))


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


def test_recall_where_clusters_are_much_tighter_than_the_rest(spark):
    rng = np.random.default_rng(12)
    scales, which = 10 ** rng.uniform(-3, 0, 60), rng.integers(0, 60, 5000)
    vecs = unit(rng.normal(size=(60, 32))[which] + scales[which][:, None] * rng.normal(size=(5000, 32)) * 3)
    df = spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vecs)], SCHEMA)
    assert recall(collect(search(df, df.where("vec_id % 20 = 0"))), exact(list(enumerate(vecs)))) >= 0.95


def test_recall_where_queries_lie_elsewhere_than_the_rows(spark):
    rng = np.random.default_rng(13)
    x, asked = rng.normal(size=(6000, 32)), np.arange(6000) % 20 == 0
    x[:5000][asked[:5000]] = np.array([1.0, -1.0] * 16) + rng.normal(size=(250, 32)) * 0.05
    vecs = unit(x)
    df = spark.createDataFrame([(i, v, "", 0) for i, v in enumerate(vecs)], SCHEMA)
    assert recall(collect(search(df, df.where("vec_id % 20 = 0"))), exact(list(enumerate(vecs)))) >= 0.95


def test_no_neighbour_is_lost_in_probed_cells(spark):
    rng = np.random.default_rng(14)
    for offset, spread in ((0.0, 1.0), (1000.0, 1e-2)):
        vecs = (offset + rng.normal(size=(3000, 24)) * spread * np.exp(rng.normal(size=(3000, 1)))).tolist()
        rows = [(i, v) for i, v in enumerate(vecs)] + [(40, vecs[41]), (40, vecs[60]), (7000, vecs[80])]
        df = spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA.replace("float", "double"))
        index = fit(df.selectExpr("vec_id AS id", "embedding AS vec"), 20, 20_000, 1 << 16, 0.97)
        got = collect(search(df, df.where("vec_id in (100, 200, 300)"), target=1.0, block_rows=500, group_rows=900))
        assert index.cells > 10 and set(got) == {100, 200, 300}
        x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
        for q, found in got.items():
            s = x @ np.array(vecs[q])
            by = {}
            for i, v in zip(ids.tolist(), s.tolist()):
                by[i] = max(by.get(i, -np.inf), v)
            want = sorted((v for i, v in by.items() if i != q), reverse=True)[:20]
            np.testing.assert_allclose([v for _, v in found], want, rtol=1e-12)
