import hashlib

import pytest

from quillspark.llm.exact_dedup import exact_dedup, survivors

SCHEMA = "doc_id long, text string, keep_id string, _h string, kept int"


@pytest.mark.parametrize("keep", ["min", "max"])
def test_against_plain_grouping(spark, keep):
    texts = ["a", "a ", "A", "", None, "b" * 100_000, "b" * 100_000, "é", "é"]
    rows = [(i, texts[i * 7 % 9 if i < 60 else 0]) for i in range(100)]
    df = spark.createDataFrame([(i, t, "x", None, 1) for i, t in rows], SCHEMA).repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    got = {r["doc_id"]: r for r in exact_dedup(df, keep=keep).collect()}
    assert len(got) == 100
    pick = min if keep == "min" else max
    for i, t in rows:
        mine = groups[t or ""]
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (pick(mine), len(mine), i == pick(mine))
        assert r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    stay = survivors(df, keep=keep)
    assert stay.columns == df.columns
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(pick(g) for g in groups.values())


def test_edges(spark):
    df = spark.createDataFrame([(1, "t", "", "", 0), (1, "t", "", "", 0), (1, "other", "", "", 0), (None, "t", "", "", 0), (None, "only", "", "", 0)], SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == [("1", "1", 1, True), ("1", "1", 3, True), ("1", "1", 3, True), ("None", "1", 3, False), ("None", "None", 1, True)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in survivors(df).collect()) == [("1", "other"), ("1", "t"), ("None", "only")]
    assert exact_dedup(df.limit(0)).count() == 0 and survivors(df.limit(0)).count() == 0
