"""Chat formatting by prefix-target expansion, in DataFrame functions only.

``format_chats`` writes each conversation as one string, a turn being::

    <|turn|>ROLE<|text|>TEXT<|end|>\\n

with ``&``, ``<`` and ``[`` of roles and texts written as character references.
No control string of this template, nor of those that use ``<``/``[`` marks
(``</s>``, ``[INST]``, ``<|im_start|>``), can then occur inside a text, and
``unescape`` gives back the text exactly.

``expand`` explodes every assistant turn into an example of its own: the context
is everything before the reply's text, the target is that reply and its end
mark.  The context is a prefix of the one string, so an example carries two
offsets and, when asked, the text; a query that needs targets only never builds
contexts, whose total length is quadratic in the turns of a conversation.

Defined cases: a null text or role is empty.  Turns go by ``turn`` (nulls
first), ties by role and text, so repeated rows stay next to each other.
A null ``conv_id`` is a conversation of its own.  A conversation without
assistant turns has a string and no example.  Empty tables give empty results;
other columns are ignored.  A conversation is one string and so one row; Spark
limits it to 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


def escape(c: Column) -> Column:
    """Reversible: afterwards the text holds no ``<`` and no ``[``."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted: one row per conversation."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    one = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
    return grouped.select("conv_id", F.array_join(F.transform("turns", one), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> as read back from a formatted string."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def one(p: Column) -> Column:
        body = F.substring(p, F.lit(len(TURN) + 1), F.length(p))
        cut = F.instr(body, TEXT)
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + len(TEXT), F.length(body))).alias("text"),
        )

    return F.transform(parts, one)


def _spans(formatted: Column) -> Column:
    """array<struct<role, start, length, text>>: where each turn's written text lies (from 0), and the text."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<role:string,start:bigint,length:bigint,text:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        head = F.instr(p, TEXT) - 1 + len(TEXT)
        role = F.substring(p, F.lit(len(TURN) + 1), head - len(TEXT) - len(TURN))
        span = F.struct(unescape(role).alias("role"), (acc["at"] + head).cast("long").alias("start"), (F.length(p) - head).cast("long").alias("length"), F.substring(p, head + 1, F.length(p)).alias("text"))
        return F.struct((acc["at"] + F.length(p) + len(END)).cast("long").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != ""), zero, step)["out"]


def expand(chats: DataFrame, keep: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """One row per assistant turn: conv_id, example_no, context_chars, target_chars, context, target.

    Only the target is trained on.  ``context`` and ``target`` are as written,
    escapes included; the target ends with the end mark.  ``keep`` names further
    columns of ``chats`` to carry; with ``outer`` a conversation without assistant
    turns has one row of nulls.  The rows stay where their conversation is.
    """
    spans = F.filter(_spans(F.col("formatted")), lambda s: s["role"] == "assistant")
    explode = F.posexplode_outer if outer else F.posexplode
    rows = chats.select("conv_id", "formatted", *keep, explode(spans).alias("example_no", "s"))
    return rows.select(
        "conv_id",
        *keep,
        F.col("example_no").cast("long").alias("example_no"),
        F.col("s.start").alias("context_chars"),
        (F.col("s.length") + len(END)).alias("target_chars"),
        F.substring("formatted", F.lit(1), F.col("s.start").cast("int")).alias("context"),
        F.concat("s.text", F.lit(END)).alias("target"),
    )


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse(F.col("formatted"))
    chats = format_chats(turns).select(
        "conv_id",
        "formatted",
        F.size(back).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(back, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = ("n_turns", "turns_sha256", "formatted_chars")
    examples = expand(chats, whole, outer=True)
    reply = F.expr(f"substring(target, 1, length(target) - {len(END)})")
    told = examples.groupBy("conv_id").agg(
        *[F.first(c).alias(c) for c in whole], F.sort_array(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example_no", reply.alias("reply"))))).alias("said")
    )
    mask = F.array_join(F.transform("said", lambda s: unescape(s["reply"])), "")
    return told.select(
        "conv_id", "n_turns", "turns_sha256", F.length(mask).cast("long").alias("loss_chars"), F.sha2(mask, 256).alias("loss_sha256"), "formatted_chars"
    )


#: The escapes cost 4 characters for "&" and "[" and 3 for "<" beyond the character itself.
ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS er,
         replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(er) + 8 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
