import hashlib

from pyspark.sql import functions as F

from quillspark.llm.chat_format import END, escape, expand, format_chats, op4_chat_format, parse, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
ODD = "</s>[INST] &amp; &lt; &#91; <|turn|>user<|text|>x<|end|>\n &&amp;<<[[ \\ é\U0001f600\n"


def chats(spark):
    rows = [
        (1, 0, "system", "be kind", ""),
        (1, 1, "user", ODD, ""),
        (1, 2, "assistant", ODD + ODD, None),
        (1, 3, "user", None, ""),
        (1, 4, "assistant", "", ""),
        (1, 5, "user", "bye", ""),
        (2, 0, "user", "alone", ""),
        (3, 7, "assistant", "b", ""),
        (3, 7, "assistant", "a", ""),
        (3, 7, "assistant", "a", ""),
        (3, None, None, "first", ""),
        (None, 0, "assistant", "no id", ""),
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark):
    rows, df = chats(spark)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in format_chats(df).select("conv_id", parse(F.col("formatted")).alias("t")).collect()}
    want = {}
    for conv, _, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want


def test_escape_hides_every_control_string(spark):
    df = spark.createDataFrame([(ODD,)], "t string").select("t", escape(F.col("t")).alias("e"))
    r = df.select("t", "e", unescape(F.col("e")).alias("u")).first()
    assert r["u"] == ODD and "<" not in r["e"] and "[" not in r["e"]


def test_examples_hold_all_that_went_before(spark):
    _, df = chats(spark)
    whole = {r["conv_id"]: r["formatted"] for r in format_chats(df).collect()}
    got = expand(format_chats(df)).collect()
    assert sorted((str(r["conv_id"]), r["example_no"]) for r in got) == [("1", 0), ("1", 1), ("3", 0), ("3", 1), ("3", 2), ("None", 0)]
    for r in got:
        assert whole[r["conv_id"]].startswith(r["context"] + r["target"])
        assert r["context"].endswith("<|turn|>assistant<|text|>") and r["target"].endswith(END)
        assert (len(r["context"]), len(r["target"])) == (r["context_chars"], r["target_chars"])


def test_query(spark):
    got = {r["conv_id"]: r for r in op4_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["n_turns"] == 2 and got[-1]["loss_chars"] == len(said)
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert format_chats(chats(spark)[1].limit(0)).count() == 0


def test_very_long_and_many_turns(spark):
    rows = [(1, 0, "user", "<" * 500_000, "")] + [(1, i, "assistant" if i % 2 else "user", f"turn [{i}] " * 20, "") for i in range(1, 1500)] + [(1, 1500, "assistant", "[é" * 400_000, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = expand(format_chats(df)).select("example_no", "target", "context_chars").orderBy("example_no").collect()
    said = [t for _, _, role, t, _ in rows if role == "assistant"]
    back = [r["u"] for r in spark.createDataFrame([(r["target"],) for r in got], "t string").select(unescape(F.col("t")).alias("u")).collect()]
    assert sorted(back) == sorted(t + END for t in said)
    assert [r["context_chars"] for r in got] == sorted(r["context_chars"] for r in got) and got[0]["context_chars"] > 4 * 500_000
