from collections import Counter

from quillspark.llm.language_id import LENGTH, _grams, accepted, held_out, identify, learn, op9_language_id


def slow_grams(text):
    word, words = "", []
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(word)
            word = ""
    out = Counter()
    for w in words:
        w = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                if w[i : i + n] != " ":
                    out[w[i : i + n]] += 1
    return out


def text_of(code):
    out = []
    while code:
        out.append(chr(code & 0x1FFFFF))
        code >>= 21
    return "".join(reversed(out))


def test_grams_match_a_plain_count():
    texts = ["Hello, wörld", "", None, "a", "  a-b  c1d ", "ÉTÉ été İstanbul", "12 34", "\U00010400x y\n\nz"]
    for t, g in zip(texts, _grams(texts)):
        assert Counter(text_of(int(x)) for x in g) == slow_grams(t or "")


def plain_profile(counts, length):
    """Most frequent first; equal ones by the n-gram's code."""
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:length]


def plain_identify(text, profiles, length):
    mine = plain_profile(slow_grams(text or ""), length)
    if not mine:
        return "und", 0.0
    away = {}
    for lang, theirs in profiles.items():
        place = {g: i for i, g in enumerate(theirs)}
        away[lang] = sum(abs(place[g] - i) if g in place else length for i, g in enumerate(mine))
    order = sorted(away, key=lambda k: (away[k], k))
    second = away[order[1]] if len(order) > 1 else length * len(mine)
    second = min(second, length * len(mine))
    return order[0], (second - away[order[0]]) / second if second else 0.0


def test_profiles_and_distances_against_plain_ones(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in rows]
    long = "the quick brown fox " * 60_000 + "été"
    rows += [(9001, long, "en"), (9002, "tie tie", "aa"), (9003, "tie tie", "bb"), (9004, "tie", None), (9004, "tie", None), (9005, "", "en"), (9006, "x", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for length in (LENGTH, 30):
        counts = {}
        for _, text, lang in rows:
            if lang is not None and text:
                counts.setdefault(lang, Counter()).update(slow_grams(text))
        profiles = {k: plain_profile(c, length) for k, c in counts.items()}
        learnt = learn(df, length=length)
        assert {k: [text_of(g) for g in v] for k, v in learnt.items()} == profiles
        got = [(r["doc_id"], r["text"], r["lang_pred"], round(r["score"], 12)) for r in identify(df, learnt, length=length).collect()]
        assert len(got) == len(rows)
        for i, text, lang, score in got:
            want = plain_identify(text, profiles, length)
            assert (lang, score) == (want[0], round(want[1], 12)), i


def test_a_script_that_nothing_was_learnt_of_is_rejected(spark):
    rows = [(i, "the cat and the dog sat there" if i % 2 else "le chat et le chien sont là", "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100, "кошка и собака сидели там", None), (101, "猫和狗坐在那里", None), (102, "the dog", None), (103, "1 2 3", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in accepted(df).collect()) == [*range(40), 102]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op9_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count()


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr", "s") for i in range(40)] + [(50, None, None, ""), (51, "123 !!", "en", ""), (52, "the dog", None, None), (None, "le chien", "fr", "")], schema)
    profiles = learn(rows.where(~held_out()))
    assert sorted(profiles) == ["en", "fr"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(rows, profiles).collect()}
    assert got[50] == ("und", 0.0) and got[51] == ("und", 0.0)
    assert got[52][0] == "en" and 0 < got[52][1] <= 1 and got[None][0] == "fr"
    assert {r["lang_pred"] for r in identify(rows, {}).collect()} == {"und"}
    assert identify(rows.limit(0), profiles).count() == 0
    kept = accepted(rows)
    assert kept.columns == rows.columns and kept.count() == 42
