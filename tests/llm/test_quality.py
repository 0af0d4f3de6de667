import numpy as np

from quillspark.llm.language_id import held_out
from quillspark.llm.quality import Model, features, fit, fit_ordinal, grades, op8_quality, penalised_loss, score, thresholds_of


def test_features_of_a_chunk_are_those_of_its_rows():
    texts = ["Good words, GOOD words!!", "", "a a a b", "été ÉTÉ x1", "wörd. " * 5]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    row, col, val = features(raw, offs)
    assert len(set(zip(row.tolist(), col.tolist()))) == len(row)
    for i, t in enumerate(texts):
        one = np.frombuffer(t.encode(), np.uint8)
        _, c, v = features(one, np.array([0, len(one)]))
        assert sorted(zip(c.tolist(), v.tolist())) == sorted(zip(col[row == i].tolist(), val[row == i].tolist()))


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.integers(0, 2, (n, 6))
    f = x @ np.array([3.0, -3.0, 1.5, 0, 0, 0]) + rng.logistic(size=n)
    grade = np.digitize(f, [-1.0, 1.0])
    row, col = np.nonzero(x)
    m = fit_ordinal(row, col + 2000, np.ones(len(row)), grade, 3, 4096, rounds=400)
    assert m.thresholds[0] < m.thresholds[1]
    w = m.weights[2000:2006]
    assert w[0] > w[2] > 0 > w[1] and abs(w[0] + w[1]) < 1.0
    tails = m.tails(np.array([-5.0, 0.0, 5.0]))
    assert (tails[:, 0] >= tails[:, 1]).all() and (np.diff(tails[:, 1]) > 0).all()


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = op8_quality(spark, sf).join(grades(spark.read.parquet(f"{sf}/labels.parquet")), "doc_id").where(held_out()).toPandas()
    assert got[got.grade == 2].kept.mean() >= 0.97
    assert got[got.grade == 0].kept.mean() <= 0.10
    assert got[got.grade == 1].kept.mean() <= 0.35
    assert got[got.grade == 0].expected_grade.mean() < got[got.grade == 1].expected_grade.mean() < got[got.grade == 2].expected_grade.mean()


def test_edges(spark):
    docs = spark.createDataFrame([(i, ("fine day " if i % 2 else "bad!! day ") * 5, "k") for i in range(60)] + [(90, None, ""), (91, "", None), (None, "fine", "")], "doc_id long, text string, kept string")
    rated = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(60)] + [(1, None), (None, 1), (999, 2), (90, 2)], "doc_id long, grade int")
    got = {r["doc_id"]: r for r in score(docs, fit(docs, rated, 3)).collect()}
    assert got[1]["kept"] and not got[0]["kept"] and got[1]["expected_grade"] > got[0]["expected_grade"]
    assert got[90]["p_tail"] == got[91]["p_tail"]
    none = score(docs, fit(docs, rated.limit(0), 3))
    assert none.where("kept and p_tail is null").count() == docs.count()
    assert score(docs.limit(0), fit(docs, rated, 3)).count() == 0


def plain_loss(w, t, x, grade, decay):
    """The same by its definition, a row at a time."""
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    edge = [-np.inf, *t, np.inf]
    total = 0.0
    for features_of, j in zip(x, grade):
        f = float(features_of @ w)
        total -= np.log(sigmoid(edge[j + 1] - f) - sigmoid(edge[j] - f))
    return total / len(x) + decay / 2 * float(w @ w)


def test_loss_and_gradient_against_plain_ones():
    rng = np.random.default_rng(2)
    for grades_ in (2, 3, 5):
        x = rng.normal(size=(40, 6)) * (rng.random((40, 6)) < 0.7)
        grade = rng.integers(0, grades_, 40)
        w, steps = rng.normal(size=6), rng.normal(size=grades_ - 1)
        row, col = np.nonzero(x)
        loss = lambda w, s: plain_loss(w, thresholds_of(s), x, grade, 0.01)
        got, gradient = penalised_loss(w, steps, row, col, x[row, col], grade, 0.01)
        assert abs(got - loss(w, steps)) < 1e-9
        both = np.concatenate((w, steps))
        for i in range(len(both)):
            up, down = both.copy(), both.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            slope = (loss(up[:6], up[6:]) - loss(down[:6], down[6:])) / 2e-5
            assert abs(slope - gradient[i]) < 1e-6


def test_fit_is_near_the_minimum():
    rng = np.random.default_rng(3)
    n = 1500
    x = rng.integers(0, 2, (n, 5)).astype(float)
    grade = np.digitize(x @ np.array([2.0, -2.0, 1.0, 0.5, -1.0]) + rng.logistic(size=n), [-1.0, 1.0])
    row, col = np.nonzero(x)
    m = fit_ordinal(row, col + 2000, np.ones(len(row)), grade, 3, 4096, rounds=400, chi=0.0)
    w, t = m.weights[2000:2005].astype(float), m.thresholds
    here = plain_loss(w, t, x, grade, 3e-4)
    for _ in range(200):
        away = plain_loss(w + rng.normal(scale=0.05, size=5), np.sort(t + rng.normal(scale=0.05, size=2)), x, grade, 3e-4)
        assert away > here - 1e-4


def test_expected_grade_is_the_sum_of_tails():
    m = Model(np.zeros(4, np.float32), np.array([-1.0, 0.5, 2.0]))
    f = np.array([-30.0, 0.0, 0.3, 30.0])
    tails = m.tails(f)
    each = -np.diff(np.concatenate((np.ones((4, 1)), tails, np.zeros((4, 1))), axis=1), axis=1)  # P(grade = j)
    assert np.allclose(each.sum(axis=1), 1) and np.allclose(each @ np.arange(4), tails.sum(axis=1))


def test_long_texts_ties_and_repeated_rows(spark):
    docs = spark.createDataFrame([(i, ("fine day " if i % 2 else "bad!! day ") * 5) for i in range(60)] + [(70, "fine day " * 300_000), (71, "bad!! " * 5), (71, "bad!! " * 5), (72, "x" * 2_000_000)], "doc_id long, text string")
    rated = spark.createDataFrame([(i, 2 if i % 2 else 0) for i in range(60)], "doc_id long, grade int")
    got = score(docs, fit(docs, rated, 3)).toPandas()
    assert len(got) == 64
    assert len(set(got[got.doc_id == 71].p_tail)) == 1 and len(set(got[got.doc_id.between(0, 59) & (got.doc_id % 2 == 0)].p_tail)) == 1
    assert got[got.doc_id == 70].kept.item() and not got[got.doc_id == 71].kept.any()
