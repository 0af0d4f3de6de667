"""Hierarchical multi-length packing.

Tokens of a document go into full windows of the longest tier while they last;
the rest is routed to the shortest tier that holds it.  Each tier packs its rests
into windows of its own length, longest first.  A gap in a window is filled with
the largest whole rest of the same or a shorter tier that fits; when none fits,
one is cut to close the gap, and what is left of it is routed again.  All
windows but a task's last few are therefore full, and all but its very last
token run have a length that is a tier.

Each task packs its own rows in one pass and holds at most ``buffer`` rests, so
there is no shuffle, no hot key, and a long document costs nothing but its own
tokens.  Sequence ids carry the partition number.  The pieces (no texts, no ids)
are written once to the shared folder, so a lost executor never changes a
sequence that was told already.

Windows of a tier are then numbered through over all tasks (each task tells how
many it made, so only tasks x tiers rows are summed up) and taken off in that order
into step groups of ``step_tokens`` tokens.  All groups of a tier have the same
number of windows, but for its last one, which may be short.

Token ids are those of the ``tokenizers`` file.  For a plain byte-level BPE file
the ids come from the same merges run by ``tiktoken``, some four times as fast;
the tests compare both on every code point.  Texts with a run of ``LONG_SPACE``
white-space characters, on which that engine's stack ends, and all texts with any
other file are run by ``tokenizers`` itself.

Defined cases: a null or empty text is its end token alone.  Repeated rows are
packed as often as they occur.  Empty tables give empty results, other columns
are ignored, a null id is packed under the null id.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released, table

TIERS = (1024, 512, 256, 128)
LONG_SPACE = 1000
_SPACES = re.compile(r"\s{%d}" % LONG_SPACE)
#: ``window_no`` counts the windows of a tier in a task
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, task int, window_no long"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """text -> list of ids, as ``tokenizers`` gives them without added special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
    plain = (
        model["type"] == "BPE"
        and spec.get("normalizer") is None
        and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": pre.get("trim_offsets"), "use_regex": True}
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and all(a["special"] and not a["normalized"] and not any(a[k] for k in ("single_word", "lstrip", "rstrip")) for a in added)
    )
    special = {a["content"]: a["id"] for a in added}
    if plain:
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merged]
        plain = all(x < y for x, y in zip(ids, ids[1:])) and sum(len(w) == 1 for w in ranks) == 256  # ids are the merges' order
    whole = functools.cache(lambda: Tokenizer.from_file(path))
    if not plain:
        return lambda text: whole().encode(text, add_special_tokens=False).ids
    fast = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names = set(special)

    def encode(text: str) -> list[int]:
        if _SPACES.search(text):
            return whole().encode(text, add_special_tokens=False).ids
        if any(name in text for name in names):
            return fast.encode(text, allowed_special=names)
        return fast.encode_ordinary(text)

    return encode


class Packer:
    """Packs one task's documents; ``rows`` holds finished pieces."""

    def __init__(self, tiers: tuple[int, ...], buffer: int, task: int):
        self.tiers = sorted(tiers, reverse=True)
        self.buffer, self.task = buffer, task
        self.next_id = task << 36
        self.rest: list[tuple[int, int]] = []  # (length, number), sorted
        self.held: dict[int, tuple] = {}  # number -> (doc_id, ids, start, doc_tokens)
        self.serial = 0
        self.made = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def _tier(self, n: int) -> int:
        return min(t for t in self.tiers if t >= n)

    def _write(self, window: list[tuple], tier: int) -> None:
        """window: (doc_id, ids, start, length, doc_tokens)."""
        at = 0
        for doc, ids, start, n, total in window:
            self.rows.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), total, self.next_id, at, tier, self.task, self.made[tier]))
            at += n
        self.made[tier] += 1
        self.next_id += 1

    def _hold(self, doc, ids, start, total) -> None:
        bisect.insort(self.rest, (total - start, self.serial))
        self.held[self.serial] = (doc, ids, start, total)
        self.serial += 1

    def add(self, doc, ids: np.ndarray) -> None:
        longest, total = self.tiers[0], len(ids)
        full = total // longest
        for i in range(full):
            self._write([(doc, ids, i * longest, longest, total)], longest)
        if total % longest:
            self._hold(doc, ids[:total], full * longest, total)
        if len(self.rest) >= self.buffer:
            self.pack(self.buffer // 2)

    def _take(self, at: int):
        n, number = self.rest.pop(at)
        doc, ids, start, total = self.held.pop(number)
        return n, doc, ids, start, total

    def pack(self, leave: int) -> None:
        """Pack until at most ``leave`` rests are held."""
        while len(self.rest) > leave:
            n, doc, ids, start, total = self._take(len(self.rest) - 1)
            tier = self._tier(n)
            window, gap = [(doc, ids, start, n, total)], tier - n
            while gap and self.rest:
                at = bisect.bisect_right(self.rest, (gap, self.serial)) - 1
                n, doc, ids, start, total = self._take(max(at, 0))
                part = min(n, gap)
                window.append((doc, ids, start, part, total))
                gap -= part
                if part < n:
                    self._hold(doc, ids, start + part, total)
            if gap and len(self.tiers) > 1:
                self._last(window)
            else:
                self._write(window, tier)

    def _last(self, window: list[tuple]) -> None:
        """The run that ends a task is split into tiers; only what is shorter than all of them needs padding."""
        now, room = [], None
        left = sum(w[3] for w in window)
        for doc, ids, start, n, total in window:
            while n:
                if room is None:
                    tier = room = next((t for t in self.tiers if t <= left), self.tiers[-1])
                part = min(n, room)
                now.append((doc, ids, start, part, total))
                start, n, room, left = start + part, n - part, room - part, left - part
                if not room or not left:
                    self._write(now, tier)
                    now, room = [], None

    def drain(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        columns, self.rows = list(zip(*self.rows)), []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in PIECES.split(", ")])


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 0,
    step_tokens: int = 1 << 16,
    buffer: int = 2048,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    ``tier`` is the sequence's length before padding to it, ``step_group`` the
    training step it belongs to.
    """

    def run(batches):
        encode = encoder(tokenizer)
        packer = Packer(tiers, buffer, TaskContext.get().partitionId())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, dtype="<u4"))
                if len(packer.rows) > 20000:
                    yield packer.drain()
        packer.pack(0)
        if (last := packer.drain()) is not None:
            yield last

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return step_groups(materialize(rows.mapInArrow(released(run), PIECES), "pieces"), tiers, step_tokens)


def step_groups(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """``pieces`` with ``step_group``: the windows of a tier, numbered through over the tasks, by ``step_tokens`` tokens."""
    made = pieces.groupBy("tier", "task").agg((F.max("window_no") + 1).alias("made"))
    before = Window.partitionBy("tier").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(made.select("tier", "task", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("base")), "bases")
    each = F.greatest(F.lit(1), F.expr(f"{step_tokens} div tier"))
    tier_no = F.array_position(F.array(*map(F.lit, sorted(tiers, reverse=True))), F.col("tier")) - 1
    group = F.floor((F.col("base") + F.col("window_no")) / each) * len(tiers) + tier_no
    return pieces.join(bases, ["tier", "task"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.cast("long").alias("step_group")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
