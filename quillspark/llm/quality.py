"""Quality classifier: ordinal cumulative-link regression on graded ratings.

``P(grade >= j) = sigmoid(f(text) - t_j)`` with one weight vector over hashed text
features and ordered thresholds ``t_1 < t_2 < ...``.  Features are the words of
the whole text without trailing punctuation and their first 4, 5 and 6 bytes
(present or not), and, as shares of the words, the hashed trailing punctuation,
letter shape and repetition of the word before.

The model is fitted on at most ``sample_rows`` rated rows, chosen by a hash of
the id; the weights (``2**bits`` floats) go to the tasks as a broadcast of that
fixed size.  Scoring is one pass without a shuffle, vectorised over chunks.

Defined cases: null and empty texts are scored with no feature (the thresholds
alone).  Texts of any length are read whole; a repeated row is scored each time.
Ratings without grade or text are left out; a document rated twice
counts twice.  Without ratings, or with one grade only, scores are null and
every row is kept.  Empty tables give empty results; other columns are returned
unchanged, one with the name of an output column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .language_id import held_out
from .words import chunks, hash_spans, text_bytes, word_spans

BITS = 18
SHARES = 1024  # features that are shares of the words; the rest are words
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of a chunk; each pair of row and feature once.

    ``live`` says which features are of interest; others may be left out.
    """
    low, starts, ends, rows = word_spans(raw, offsets)
    n = len(offsets) - 1
    size = 1 << bits
    owner = np.repeat(np.arange(n), np.diff(rows))
    core = ends.copy()
    for _ in range(4):
        core -= _PUNCT[low[np.maximum(core - 1, 0)]] & (core - starts > 1)
    words = hash_spans(low, starts, core)
    tail = hash_spans(low, core, ends)
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    wide = np.concatenate(([0], np.cumsum(raw > 127)))
    length = core - starts
    caps = upper[core] - upper[starts]
    shape = (caps > 1).astype(np.int64) + 2 * (caps == 1) + 4 * (digit[core] > digit[starts]) + 8 * (wide[core] > wide[starts]) + 16 * (length > 12) + 32 * (length == 1)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    named = []
    for k in (0, 4, 5, 6):
        part = words if not k else hash_spans(low, starts, np.minimum(starts + k, core)) + np.uint64(k)
        who = owner
        if k:
            long = length >= k
            part, who = part[long], owner[long]
        at = SHARES + (part % np.uint64(size - SHARES)).astype(np.int64)
        if live is not None:
            use = live[at]
            at, who = at[use], who[use]
        named.append(who * size + at)
    word = np.unique(np.concatenate(named))
    total = np.maximum(np.diff(rows), 1)
    parts = np.concatenate((owner * size + 64 + (tail % np.uint64(SHARES - 64)).astype(np.int64), owner * size + shape % 63, (owner * size + 63)[again]))
    share, counts = np.unique(parts, return_counts=True)
    at = np.concatenate((word, share))
    values = np.concatenate((np.ones(len(word)), counts / total[share // size]))
    return at // size, at % size, values


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, f: np.ndarray) -> np.ndarray:
        """P(grade >= j), j = 1.., of each row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - f[:, None], -500, 500)))


def thresholds_of(steps: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then logarithms of the gaps."""
    return steps[0] + np.concatenate(([0.0], np.cumsum(np.exp(steps[1:]))))


def penalised_loss(w: np.ndarray, steps: np.ndarray, row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with half ``decay`` times the squared weights, and its gradient by (w, steps)."""
    n, cuts = len(grade), len(steps)
    edge = np.concatenate(([-np.inf], thresholds_of(steps), [np.inf]))
    f = np.bincount(row, weights=w[col] * val, minlength=n)
    hi, lo = 1 / (1 + np.exp(np.clip(f - edge[grade + 1], -50, 50))), 1 / (1 + np.exp(np.clip(f - edge[grade], -50, 50)))
    p = np.maximum(hi - lo, 1e-9)
    d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_w = np.bincount(col, weights=val * (d_hi - d_lo)[row], minlength=len(w)) / n + decay * w
    g_edge = np.array([(-d_hi[grade == j].sum() + d_lo[grade == j + 1].sum()) / n for j in range(cuts)])
    g_steps = np.concatenate((g_edge.sum(keepdims=True), np.cumsum(g_edge[::-1])[::-1][1:] * np.exp(steps[1:])))
    return float(-np.log(p).mean() + decay / 2 * (w @ w)), np.concatenate((g_w, g_steps))


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, grades: int, dim: int, rounds: int = 200, decay: float = 3e-4, least: int = 4, chi: float = 30.0) -> Model:
    """Penalised maximum likelihood by Adam over all rows.

    A feature has a weight if ``least`` rows have it and its presence depends on
    the grade: the chi-square of one of the splits of the grades is ``chi`` at least.
    Shares are always used.
    """
    n = len(grade)
    seen = np.bincount(col, minlength=dim)
    best = np.zeros(dim)
    for j in range(1, grades):
        low = np.bincount(col[grade[row] < j], minlength=dim)
        q = (grade < j).mean()
        expected = np.maximum(seen * q, 1e-9)
        spread = expected * (1 - q) * np.maximum(1 - seen / n, 1e-3)
        best = np.maximum(best, (low - expected) ** 2 / np.maximum(spread, 1e-9))
    live = (seen >= least) & (best >= chi)
    live[:SHARES] = seen[:SHARES] >= least
    ok = live[col]
    row, col, val = row[ok], col[ok], val[ok]
    use, col = np.unique(col, return_inverse=True)
    w = np.zeros(len(use))
    freq = np.array([(grade < j).mean() for j in range(1, grades)]).clip(0.01, 0.99)
    t = np.log(freq / (1 - freq))
    steps = np.concatenate((t[:1], np.log(np.maximum(np.diff(t), 1e-2))))
    m, v = np.zeros(len(w) + grades - 1), np.zeros(len(w) + grades - 1)
    for k in range(1, rounds + 1):
        _, g = penalised_loss(w, steps, row, col, val, grade, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - (k - 1) / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w -= step[: len(w)]
        steps -= step[len(w) :]
    weights = np.zeros(dim, dtype=np.float32)
    weights[use] = w
    return Model(weights, thresholds_of(steps))


def fit(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, bits: int = BITS) -> Model | None:
    """``ratings`` is (id, grade) with grades 0 .. grades-1."""
    rated = ratings.select(F.col(id_col).alias("_id"), F.col("grade").cast("int").alias("_grade")).where(f"_id is not null and _grade between 0 and {grades - 1}")
    total = rated.count()
    part = 1.0 if total <= sample_rows else sample_rows / total
    picked = rated.where(F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * sample_rows)
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_text is not null").join(F.broadcast(picked), "_id")

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets):
                row, col, val = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits)
                cuts = np.searchsorted(np.sort(row), np.arange(b - a + 1))
                order = np.argsort(row, kind="stable")
                for i in range(b - a):
                    at = order[cuts[i] : cuts[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(a + i, 1), batch.column(2).slice(a + i, 1), pa.array([col[at].astype(np.int32).tobytes()], pa.binary()), pa.array([val[at].astype(np.float32).tobytes()], pa.binary())],
                        ["id", "grade", "cols", "vals"],
                    )

    got = joined.select("_text", "_id", "_grade").mapInArrow(run, T.StructType([T.StructField("id", joined.schema["_id"].dataType), T.StructField("grade", T.IntegerType()), T.StructField("cols", T.BinaryType()), T.StructField("vals", T.BinaryType())])).toArrow()
    got = got.sort_by([("id", "ascending"), ("grade", "ascending"), ("cols", "ascending")])
    grade = got.column("grade").to_numpy().astype(np.int64)
    if len(set(grade.tolist())) < 2:
        return None
    cols = [np.frombuffer(b, np.int32) for b in got.column("cols").to_pylist()]
    vals = np.concatenate([np.frombuffer(b, np.float32) for b in got.column("vals").to_pylist()]).astype(np.float64)
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    return fit_ordinal(row, np.concatenate(cols).astype(np.int64), vals, grade, grades, 1 << bits)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", tail: int = 2, keep: float = 0.5, bits: int = BITS) -> DataFrame:
    """``docs`` with expected_grade, p_tail = P(grade >= tail) and kept = p_tail >= keep."""
    names = ["expected_grade", "p_tail", "kept"]
    docs = docs.drop(*names)
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias(names[0]), F.lit(None).cast("double").alias(names[1]), F.lit(True).alias(names[2]))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        live = model.weights != 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(at))
            f = np.zeros(batch.num_rows)
            for a, b in chunks(offsets):
                row, col, val = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], bits, live)
                f[a:b] = np.bincount(row, weights=model.weights[col] * val, minlength=b - a)
            p = model.tails(f)
            best = p[:, tail - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), pa.array(best), pa.array(best >= keep)], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """0: toxic, 1: poor, 2: good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, grades(table(spark, sf_dir, "labels")).where(~held_out()), 3)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "expected_grade", "p_tail", "kept")
