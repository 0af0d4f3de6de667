import random

import pytest

from quillspark.llm.common import free_prefix
from quillspark.llm.components import connected_components
from quillspark.llm.sieve import Sieve, split, without


def test_sieve_never_loses_an_id(spark):
    rng = random.Random(8)
    ids = rng.sample(range(-(10**12), 10**12), 3000)
    df = spark.createDataFrame([(i, "x") for i in ids] + [(None, "n")], "id long, _sieve_id string")
    some = spark.createDataFrame([(i,) for i in ids[:1000]] + [(None,)], "gone long")
    maybe, not_there = split(df, "id", some)
    assert {r["id"] for r in maybe.collect()} >= set(ids[:1000])
    assert maybe.count() < 1300 and maybe.count() + not_there.count() == 3001
    kept = without(df, "id", some)
    assert kept.columns == df.columns
    assert sorted(r["id"] for r in kept.collect() if r["id"] is not None) == sorted(ids[1000:]) and kept.where("id is null").count() == 1
    assert without(df, "id", some.limit(0)).count() == 3001
    assert Sieve(some, "gone", least=6, most=6).bits == 64


@pytest.mark.parametrize("kind", ["random", "chain", "none"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"random": [(rng.randrange(400), rng.randrange(400)) for _ in range(260)], "chain": [(i, i + 1) for i in range(130)] + [(500, 500)], "none": []}[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in list(parent)}


def test_free_prefix():
    assert free_prefix(["a"]) == "_q_"
    assert not any(c.lower().startswith(free_prefix(["_q_x", "__Q_y"])) for c in ["_q_x", "__Q_y"])
