"""The whole pipeline against a plain version of every stage."""

import collections
import importlib.util
import math
import os
import re

import pandas as pd
import pytest

from quillspark.llm import mixing, packing
from quillspark.llm.language_id import Profiles, _grams, held_out, learn

from .test_ngram_join import brute

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not there")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two hundred documents with rows of every odd kind added."""
    d = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kinds = {r["doc_id"]: r for r in docs.collect()}
    some = kinds[min(kinds)]["text"]
    words = some.split(" ")
    near = " ".join([*words[:-1], "changed"])
    odd = [(9001, None, "en", "src1", None), (9002, "", "en", "src1", 0), (9003, "12 34 !!", None, None, 8), (9004, some, "en", "src2", 1), (9005, near, None, "src3", 1), (9006, some + " ", "fr", "src0", 1), (None, "no id here but words enough to tell", "en", "src1", 3)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).repartition(4).write.parquet(f"{d}/documents.parquet")
    return str(d)


def plain(spark, folder):
    """Ids that each stage keeps, by Python alone but for the learnt profiles."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    profiles = Profiles(learn(docs.where(~held_out())), 400)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "") and profiles.best(_grams([r[1]])[0])[0] != "und"]
    yield {r[0] for r in rows}
    first = {}
    for r in rows:
        first.setdefault(r[1], []).append(r)
    rows = [min(g, key=lambda r: math.inf if r[0] is None else r[0]) for g in first.values()]
    yield {r[0] for r in rows}
    found = brute([(r[0], r[1]) for r in rows if r[0] is not None])
    rows = [r for r in rows if r[0] is None or found[r[0]][2] == r[0]]
    yield {r[0] for r in rows}
    cells = collections.Counter()
    for r in rows:
        cells[r[3], r[2], topic(r[1])] += len(re.findall(r"[^ \t\n\x0b\f\r]+", r[1]))
    frame = pd.DataFrame([(*(("none",) if v is None else v for v in k), n) for k, n in cells.items()], columns=["source", "lang", "topic", "tokens"])
    weight = dict(zip(cells, mixing.rake(frame, mixing.DEFAULT_TARGETS)))
    top = max(w for k, w in weight.items() if cells[k])
    ids = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select("doc_id", mixing.draw("doc_id", 42).alias("u")).collect()
    u = {r["doc_id"]: r["u"] for r in ids}
    rows = [r for r in rows if u[r[0]] < min(1, weight[r[3], r[2], topic(r[1])] / top)]
    yield {r[0] for r in rows}
    encode = packing.encoder(packing.default_tokenizer())
    yield {r[0]: len(encode(r[1])) + 1 for r in rows}


def topic(t):
    if " License" in t or "licensed under" in t:
        return "licence"
    if " | " in t:
        return "table"
    if "@" in t:
        return "contact"
    if any(x in t for x in ("%%%", "***", "!!")):
        return "symbols"
    return "note" if len(t) < 1000 else "prose"


def test_every_stage(spark, folder, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = None, docs.columns
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain(spark, folder)):
        out = stage(spark, docs, folder)
        out.write.parquet(os.path.join(tmp_path, name))
        docs = spark.read.parquet(os.path.join(tmp_path, name))
        if name == "packing":
            got = {r["doc_id"]: (r["n"], r["m"]) for r in docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", *["n", "m"]).collect()}
            assert {k: set(v) for k, v in got.items()} == {k: {n} for k, n in want.items()}
            continue
        assert docs.columns == columns
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(got) == want and len(got) == len(want), name
        assert before is None or set(got) <= before
        before = set(got)


def test_run_is_the_stages(spark, folder):
    import corpus_pipeline

    *_, want = plain(spark, folder)
    got = corpus_pipeline.run(spark, folder).groupBy("doc_id").agg({"length": "sum"}).toDF("doc_id", "n").collect()
    assert {r["doc_id"]: r["n"] for r in got} == want


def test_empty_corpus(spark, folder, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
