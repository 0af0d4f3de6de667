import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm.packing import TIERS, Packer, default_tokenizer, encoder, pack

REAL = Tokenizer.from_file(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_ids_are_those_of_tokenizers(text):
    assert encoder(default_tokenizer())(text) == REAL.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b", "  \n\n\t x  ", "don't 've'll ÀÉ中文    \U0001f600" * 3, "x" * 3000, " " * 2000, "1234 ½ Ⅷ"])
def test_ids_of_odd_texts(text):
    assert encoder(default_tokenizer())(text) == REAL.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("c", [" ", "\n", "\u2003", "\r\n", "a", "!", "é", "1"])
def test_ids_of_two_million_alike(c):
    text = "x" + c * (2_000_000 // len(c)) + "y"
    assert encoder(default_tokenizer())(text) == REAL.encode(text, add_special_tokens=False).ids


def test_ids_of_all_code_points():
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    encode = encoder(default_tokenizer())
    for a in range(0, len(points), 4096):
        text = "".join(f"a{c}b{c}{c}1{c} {c}' " for c in map(chr, points[a : a + 4096]))
        assert encode(text) == REAL.encode(text, add_special_tokens=False).ids


def check(rows, docs):
    """Every id in one piece, sequences gapless and short of nothing."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(docs)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r[1]):
            assert r[1] == at and r[2] > 0 and r[4] == len(ids)
            assert r[3] == zlib.crc32(np.array(ids[at : at + r[2]], dtype="<u4").tobytes())
            at += r[2]
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= pieces[0][7] and len({r[7] for r in pieces}) == 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_packer_keeps_every_token():
    rng = random.Random(4)
    for case in range(20):
        packer, docs = Packer(TIERS, 32, case), {}
        for d in range(rng.choice([0, 1, 3, 200])):
            docs[d] = [rng.randrange(50000) for _ in range(rng.choice([1, 2, 127, 128, 129, 700, 1023, 1024, 1025, 5000, rng.randrange(1, 3000)]))]
            packer.add(d, np.array(docs[d], dtype="<u4"))
        packer.pack(0)
        assert check(packer.rows, docs) <= 1024
        made = {}
        for tier, number in {(r[7], r[9]) for r in packer.rows}:
            made.setdefault(tier, []).append(number)
        for numbers in made.values():
            assert sorted(numbers) == list(range(len(numbers)))


def test_step_groups_are_full_over_all_tasks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 40, 150, 700])))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = pack(df, default_tokenizer(), step_tokens=4096).collect()
    groups, tier_of = {}, {}
    for r in got:
        groups.setdefault(r["step_group"], set()).add(r["sequence_id"])
        assert tier_of.setdefault(r["step_group"], r["tier"]) == r["tier"]
    short = [tier_of[g] for g, seqs in groups.items() if len(seqs) != 4096 // tier_of[g]]
    assert len(groups) > 20 and len(short) == len(set(short))  # the last group of a tier at most
    assert all(len(seqs) <= 4096 // tier_of[g] for g, seqs in groups.items())


def test_query_shape(spark):
    rows = [(i, ("word%d " % i) * (i * 7 % 400), "x") for i in range(60)] + [(100, None, "x"), (101, "", None), (102, "z" * 50_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tier string").repartition(3)
    got = [tuple(r) for r in pack(df, default_tokenizer()).collect()]
    docs = {i: REAL.encode(t or "", add_special_tokens=False).ids + [0] for i, t, _ in rows}
    assert check(got, docs) <= 3 * 1024
    assert pack(df.limit(0), default_tokenizer()).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "same text here", 5, "k")] * 4 + [(None, "no id", None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, task int, step_group string").repartition(2)
    got = pack(df, default_tokenizer()).collect()
    ids = REAL.encode("same text here", add_special_tokens=False).ids + [0]
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 4 * len(ids)
    assert sum(r["length"] for r in got if r["doc_id"] is None) == 2 * (len(REAL.encode("no id", add_special_tokens=False).ids) + 1)
