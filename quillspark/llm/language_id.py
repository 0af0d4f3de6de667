"""Language identification by rank-order n-gram profiles.

A profile is the most frequent character 1- to 3-grams of a text in order of
frequency; n-grams lie inside words, which carry a blank at each end.  The
distance of a document to a language is the sum, over the document's profile, of
how far each n-gram is out of place in the language's profile; an n-gram that is
missing there counts as the profile's length.

Profiles are learnt from every training row: each task counts into one table of
(language, n-gram), which is summed by key, so nothing but distinct n-grams is
shuffled.  The profiles (languages x length rows) go to the tasks in the closure;
more than ``MAX_LANGS`` labels are an error, since no label may be left out.
Prediction is one pass without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text where nothing could be learnt.  Equal frequencies go by
n-gram, equal distances by language name.  Rows without language or id teach
nothing.  Rows repeated are learnt from and identified each.  Texts of any length
are read whole.  Empty tables give empty results; other columns are left alone, and
one with the name of an output column is replaced.  ``accepted`` turns away texts
without a letter, and those of whose profile less than ``LEAST_SHARED`` is in the
nearest language's (another script, say), however far the other languages are.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, released, table

LENGTH = 400
MAX_LANGS = 10_000
LEAST_SHARED = 0.1
UNKNOWN = "und"
_CHARS = 1 << 18  # characters that are split at once; a longer text is a piece of its own


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _slices(batches, rows: int = 500):
    """Batches of few rows, so that few texts are Python strings at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > _CHARS:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def _grams(texts: list[str | None]) -> list[np.ndarray]:
    """The 1- to 3-grams of each text as integers, one per occurrence."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le"), dtype=np.uint32)
    points = np.where(_letters()[points], points, 32).astype(np.int64)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    at = np.cumsum(keep) - 1
    ends = np.cumsum([len(t) + 1 for t in low])
    cuts = at[np.concatenate(([0], ends))]
    c = points[keep]
    two = (c[:-1] << 21) | c[1:]
    three = (two[:-1] << 21) | c[2:]
    inner = c[1:-1] != 32
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            out.append(np.zeros(0, np.int64))
            continue
        one = c[a + 1 : b]
        out.append(np.concatenate((one[one != 32], two[a:b], three[a : b - 1][inner[a : b - 1]])))
    return out


def _count(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        grams = np.concatenate([g for g, _ in parts])
        order = np.argsort(grams)
        grams, counts = grams[order], np.concatenate([n for _, n in parts])[order]
        first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
        return grams[first], np.add.reduceat(counts, first)

    for batch in _slices(batches):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in _pieces(texts):
            by: dict[str, list[np.ndarray]] = {}
            for lang, g in zip(langs[a:b], _grams(texts[a:b])):
                by.setdefault(lang, []).append(g)
            for lang, parts in by.items():
                grams = np.concatenate(parts)
                if len(grams):
                    mine = held.setdefault(lang, [])
                    mine.append(np.unique(grams, return_counts=True))
                    if len(mine) > 16:
                        held[lang] = [merge(mine)]
    for lang, parts in held.items():
        grams, counts = merge(parts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = LENGTH) -> dict[str, list[int]]:
    """Language -> its ``length`` most frequent n-grams, most frequent first."""
    rows = rows.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    best = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= length).select("lang", "gram", "r")
    out: dict[str, list[tuple[int, int]]] = {}
    found = best.limit(MAX_LANGS * length + 1).collect()
    if len(found) > MAX_LANGS * length:
        raise ValueError(f"more than {MAX_LANGS} languages")
    for r in found:
        out.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {lang: [g for _, g in sorted(ranked)] for lang, ranked in sorted(out.items())}


def ranks(grams: np.ndarray, length: int) -> np.ndarray:
    """A document's profile."""
    values, counts = np.unique(grams, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:length]]


class Profiles:
    """Ranks of all languages in one table, for lookup by binary search."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.langs, self.length = sorted(profiles), length
        self.grams = np.unique(np.concatenate([np.array(profiles[k], dtype=np.int64) for k in self.langs]))
        self.rank = np.full((len(self.langs), len(self.grams)), -1, dtype=np.int64)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, profiles[k])] = np.arange(len(profiles[k]))

    def best(self, grams: np.ndarray) -> tuple[str, float, float]:
        """The nearest language, by what part it is nearer than the next, and the share of the text's profile that is in its profile."""
        if not len(grams):
            return UNKNOWN, 0.0, 0.0
        mine = ranks(grams, self.length)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        there = self.rank[:, at]
        known = (there >= 0) & (self.grams[at] == mine)
        away = np.where(known, np.abs(there - np.arange(len(mine))), self.length).sum(axis=1)
        order = np.argsort(away, kind="stable")
        next_best = min([self.length * len(mine), *(int(away[i]) for i in order[1:2])])
        return self.langs[order[0]], (next_best - int(away[order[0]])) / next_best if next_best else 0.0, float(known[order[0]].mean())


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", length: int = LENGTH, lang_out: str = "lang_pred", score_out: str = "score", shared_out: str = "shared") -> DataFrame:
    """``docs`` with the predicted language, a score (by how much the best language is nearer than the next, 0 to 1) and the share of the text's profile that its profile has."""
    docs = docs.drop(lang_out, score_out, shared_out)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType()), T.StructField(shared_out, T.DoubleType())])
    at = docs.columns.index(text_col)

    def run(batches):
        table = Profiles(profiles, length) if profiles else None
        for batch in _slices(batches):
            found = []
            texts = batch.column(at).to_pylist()
            for a, b in _pieces(texts):
                found += [table.best(g) if table else (UNKNOWN, 0.0, 0.0) for g in _grams(texts[a:b])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64()))]], [*batch.schema.names, lang_out, score_out, shared_out]
            )

    return docs.mapInArrow(released(run), schema)


def held_out(id_col: str = "doc_id"):
    """A quarter of the ids; rows without id belong to it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = learn(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), profiles).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least_shared: float = LEAST_SHARED) -> DataFrame:
    """The rows whose text has a language, all columns unchanged; profiles learnt from the rows themselves."""
    profiles = learn(docs.where(~held_out()))
    p = free_prefix(docs.columns)
    found = identify(docs, profiles, lang_out=p + "lang", score_out=p + "score", shared_out=p + "shared")
    return found.where((F.col(p + "lang") != UNKNOWN) & (F.col(p + "shared") >= least_shared)).select(*docs.columns)
