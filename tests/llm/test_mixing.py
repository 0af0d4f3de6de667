import collections
import inspect
import re

import numpy as np
import pandas as pd
import pytest

from quillspark.llm import mixing
from quillspark.llm.mixing import factor, flatten, mix, op2_mixing, rake, survivors


def slow_rake(cells, goals, rounds=3000):
    """cells: {(a, b, c): tokens}; goals: per position {value: share}."""
    w = dict.fromkeys(cells, 1.0)
    total = sum(cells.values())
    for _ in range(rounds):
        for i, goal in enumerate(goals):
            now = collections.Counter()
            for k in cells:
                now[k[i]] += w[k] * cells[k]
            for k in cells:
                if now[k[i]]:
                    w[k] *= goal[k[i]] * total / now[k[i]]
    return w


def test_query_against_plain_raking(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    got = op2_mixing(spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for r in docs.itertuples():
        assert got.tokens[r.doc_id] == len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or ""))
    cells = got.reset_index().groupby(["source", "lang", "topic"]).tokens.sum().to_dict()
    goals = []
    for i, power in enumerate((0.5, 0.8, 0.9)):
        share = collections.Counter()
        for k, v in cells.items():
            share[k[i]] += v
        p = {k: (v / sum(share.values())) ** power for k, v in share.items()}
        goals.append({k: v / sum(p.values()) for k, v in p.items()})
    want = slow_rake(cells, goals, 300)
    top = max(want.values())
    for r in got.itertuples():
        assert abs(r.weight - want[r.source, r.lang, r.topic]) < 1e-6
        assert abs(r.probability - want[r.source, r.lang, r.topic] / top) < 1e-6
    assert got.probability.max() <= 1 and got.selected.any() and not got.selected.all()
    expected = (got.probability * got.tokens).groupby(got.source).sum()
    assert np.allclose(expected / expected.sum(), pd.Series(goals[0])[expected.index], atol=1e-8)
    chosen = got[got.selected]
    assert abs(chosen.tokens.sum() / (got.probability * got.tokens).sum() - 1) < 0.1


def test_budget_is_met_with_cuts():
    w, m = np.array([4.0, 2.0, 1.0, 0.5]), np.array([10.0, 20.0, 30.0, 40.0])
    for budget in (1, 20, 55, 80, 99):
        s = factor(w, m, budget)
        assert abs(np.minimum(1, w * s) @ m - budget) < 1e-9
    assert (np.minimum(1, w * factor(w, m, 1000)) == 1).all()


def test_a_tiny_source_beside_a_hot_one_keeps_the_stated_share(spark):
    big = [(i, "word " * 50, "hot" if i % 10 else "other", "en") for i in range(1500)]
    df = spark.createDataFrame([*big, (5000, "rare " * 5, "tiny", "en")], "doc_id long, text string, source string, lang string")
    for max_cells in (50_000, 0):
        got = mix(df, max_cells=max_cells).toPandas()
        kept = (got.probability * got.tokens).sum() / got.tokens.sum()
        assert abs(kept - mixing.LEAST_SHARE) < 1e-6
        assert got.probability.max() <= 1 and got[got.source == "tiny"].selected.all()
    assert abs(survivors(df).count() / 1501 - 0.3) < 0.05
    w, m = np.array([2.0, 1.0]), np.array([10.0, 20.0])
    assert factor(w, m, None, 20.0) == 0.5 and factor(w, m, None, 20.5) > 0.5


def test_partial_targets():
    cells = pd.DataFrame({"a": ["x", "x", "y", "z"], "b": ["p", "q", "p", "q"], "tokens": [10, 20, 30, 40]})
    w = rake(cells, {"a": {"x": 0.5, "missing": 0.3}, "b": None})
    mass = w * cells.tokens
    assert abs(mass[:2].sum() / mass.sum() - 0.5) < 1e-8
    assert abs(mass[cells.b == "p"].sum() / mass.sum() - 0.4) < 1e-8


SCHEMA = "doc_id long, text string, source string, lang string, tokens string, weight int, _cell_source string"


def rows(spark):
    out = [(i, "word " * (i % 9 + 1), "hot" if i % 3 else f"s{i % 4}", None if i % 11 == 0 else "en", "", 1, "") for i in range(300)]
    return spark.createDataFrame(out + [(400, None, None, None, None, None, None), (401, "", "s1", "en", "", 0, ""), (None, "x", "s2", "fr", "", 0, ""), (5, "word " * 6, "hot", "en", "", 1, "")], SCHEMA)


def test_edges(spark):
    df = rows(spark)
    got = mix(df).toPandas()
    assert len(got) == 304 and got.probability.notna().all()
    assert got[got.doc_id == 400].tokens.iloc[0] == 0
    assert got[got.doc_id == 5].selected.nunique() == 1
    kept = survivors(df)
    assert kept.columns == df.columns
    assert sorted(kept.toPandas().doc_id.dropna()) == sorted(got[got.selected].doc_id.dropna())
    assert mix(df.limit(0)).count() == 0


def test_wide_way_agrees(spark):
    df = rows(spark).where("text is not null and text <> ''")
    targets = {"source": flatten(0.5), "lang": flatten(0.8), "topic": None}
    for budget in (0.7,):
        a = mix(df, targets, budget_share=budget).toPandas().sort_values(["doc_id", "tokens"], ignore_index=True)
        b = mix(df, targets, budget_share=budget, max_cells=0).toPandas().sort_values(["doc_id", "tokens"], ignore_index=True)
        assert np.allclose(a.weight, b.weight, rtol=1e-9) and np.allclose(a.probability, b.probability, rtol=1e-9)
        assert (a.selected == b.selected).all()
    assert mixing.DIMS == ("source", "lang", "topic")


def test_wide_way_agrees_on_sparse_cells(spark):
    """A chain of sources that share few languages settles slowly; its targets can't all be met."""
    cells = pd.DataFrame([(f"s{i // 2}", f"l{(i + 1) // 2}", 1 + i * i % 7) for i in range(14)], columns=["source", "lang", "tokens"])
    targets = {"source": flatten(0.5), "lang": lambda shares: {v: 1 / len(shares) for v in shares.index}}
    df = spark.createDataFrame(cells)
    rounds = 5
    with pytest.warns(UserWarning, match="off its target"):
        want = rake(cells, targets, rounds)
    with pytest.warns(UserWarning, match="off its target"):
        factors, scale, state = mixing._rake_wide(df, ["source", "lang"], targets, None, rounds)
    both = cells.assign(want=want).merge(state.toPandas(), on=["source", "lang"])
    assert len(both) == 14 and np.allclose(both.w, both.want, rtol=1e-9)
    by = {d: {r["_v"]: r["_f"] for r in f.collect()} for d, f in factors.items()}
    assert np.allclose([by["source"][a] * by["lang"][b] for a, b in zip(both.source, both.lang)], both.want, rtol=1e-9)
    assert abs(scale * max(want) - 1) < 1e-9
    defaults = [inspect.signature(f).parameters for f in (rake, mixing._rake_wide)]
    assert all(defaults[0][x].default == defaults[1][x].default for x in ("rounds", "tolerance"))


def test_texts_are_not_moved(spark):
    for max_cells in (50_000, 3):
        plan = survivors(rows(spark), max_cells=max_cells)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_very_long_texts(spark):
    df = spark.createDataFrame([(1, "word " * 1_000_000, "a", "en"), (2, "x" * 3_000_000, "b", "en"), (3, " \n" * 1_000_000, "a", "en")], "doc_id long, text string, source string, lang string")
    got = mix(df).toPandas().set_index("doc_id")
    assert got.tokens.to_dict() == {1: 1_000_000, 2: 1, 3: 0} and got.probability.notna().all()
