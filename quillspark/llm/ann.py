"""Approximate nearest neighbours by inner product: inverted file, exact scores
in the probed cells.

Fitting.  The number of cells grows as the square root of the rows, up to
``max_cells``.  The first ``TOP`` centroids and the number of cells to probe come from a
sample of ``sample_rows`` vectors at most, chosen by a hash of the id.  Where more cells are wanted, each of these first cells is divided further, all at
once in tasks, each from a sample of ``PER_CELL`` vectors a cell that it is to have
(``MOST_PARTS`` cells at most, so a task's sample is bounded, however hot its cell).  The
probes are the fewest that find ``target`` of the exact neighbours, within the
sample, of ``TRIES`` of the queries themselves (they may lie elsewhere than most rows),
so tight clusters are searched narrowly and shapeless data widely.

Searching.  Every vector is indexed.  A cell is cut into sub-cells of about
``block_rows`` vectors (a hot cell into many), sub-cells are hashed to groups, and
a query is sent once to each group that holds a cell it probes.  A group's task
holds copies of a vector as one, with their ``k`` + 1 smallest ids.  It scores all
vectors of a probed sub-cell by their distance from the centroid in single precision, and
again in double precision those that may be among the best by the bound on its error:
in the probed cells no neighbour is lost, however close together they lie.  (Product
quantised codes were too coarse for that where clusters are much tighter than the rest.)
Queries stream through a group in blocks; what a task holds is a group's vectors
and one block.  Should a query end with fewer neighbours than asked though more
vectors exist, it is searched again in all cells.

Defined cases: vectors that are null, empty, zero, of another length than most
of the sample, or with a null or non-finite component take no part; neither do
rows without id.  Repeated ids: rows of one id are never each other's neighbours,
and count once, with the best score.  Equal scores go by the smaller id.  With no
more than ``k`` candidates all are returned.  Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

RESULT = "query_id long, vec_id long, score double"


def vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of usable rows, their vectors as float64)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dim))
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=-1).astype(np.int64)
    at = np.flatnonzero(lengths == dim)
    if not dim or not len(at):
        return at[:0], np.zeros((0, dim))
    flat = column.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(at), dim)
    ok = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    return at[ok], rows[ok]


def _closest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distance less the row's own square."""
    near, far, own = np.empty(len(x), np.int64), np.empty(len(x), np.float32), (c * c).sum(1)[None, :]
    for a in range(0, len(x), block):
        d = own - 2 * (x[a : a + block] @ c.T)
        near[a : a + block] = d.argmin(1)
        far[a : a + block] = d.min(1)
    return near, far


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids; an empty cluster takes over the point farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near, far = _closest(x, c)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = (total / np.maximum(n, 1)[:, None]).astype(np.float32)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            c[empty] = x[np.argsort(-far)[: len(empty)]]
    return c


#: First cells at most, sampled vectors for each cell wanted, cells at most that a first cell is divided into, and queries that fit the probes
TOP, PER_CELL, MOST_PARTS, TRIES = 256, 40, 1024, 512


class Top:
    """The first cells, from the driver's sample."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, total: int, max_cells: int):
        self.ids, self.x = ids, sample.astype(np.float32)
        wanted = max(1, min(max_cells, math.isqrt(total)))
        self.centroids = kmeans(self.x, max(1, min(TOP, wanted, len(self.x) // PER_CELL)))
        near, _ = _closest(self.x, self.centroids)
        self.rows = np.bincount(near, minlength=len(self.centroids)) * (total / len(self.x))
        self.parts = np.ones(len(self.centroids), np.int64)
        if wanted > len(self.centroids) and total >= PER_CELL * wanted:
            self.parts = np.clip(np.round(self.rows / total * wanted), 1, MOST_PARTS).astype(np.int64)


class Index:
    """Centroids and probes; small, of bounded size.

    ``leaves`` are the cells, those of a first cell next to each other; ``rows`` is
    about how many vectors each will hold.
    """

    def __init__(self, top: Top, total: int, k: int, target: float, tries: tuple[np.ndarray, np.ndarray], leaves: list[np.ndarray] | None = None, rows: np.ndarray | None = None):
        x, self.dim, self.total = top.x, top.x.shape[1], total
        self.top = top.centroids
        groups = leaves if leaves is not None else [c[None, :] for c in top.centroids]
        self.first = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
        self.coarse = np.ascontiguousarray(np.concatenate(groups), dtype=np.float32)
        self.cells = len(self.coarse)
        self.rows = top.rows if rows is None else rows
        self.probes = self._fit_probes(x, top.ids, *tries, k, target)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row: the nearest in its first cell."""
        above, _ = _closest(x, self.top)
        if self.cells == len(self.top):
            return above
        out = np.empty(len(x), np.int64)
        order = np.argsort(above, kind="stable")
        cuts = np.searchsorted(above[order], np.arange(len(self.top) + 1))
        for c in np.unique(above).tolist():
            rows = order[cuts[c] : cuts[c + 1]]
            out[rows] = self.first[c] + _closest(x[rows], self.coarse[self.first[c] : self.first[c + 1]])[0]
        return out

    def _fit_probes(self, x: np.ndarray, ids: np.ndarray, tries: np.ndarray, q: np.ndarray, k: int, target: float) -> int:
        """The fewest that find ``target`` of the neighbours among ``x`` of the queries ``q``, whose ids are ``tries``."""
        if len(x) <= 4 * k or self.cells == 1 or not len(q):
            return self.cells
        q = q.astype(np.float32)
        exact = q @ x.T
        exact[tries[:, None] == ids[None, :]] = -np.inf
        best = np.argpartition(-exact, k, axis=1)[:, :k]
        order = self.order(q)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(self.cells)[None, :].repeat(len(q), 0), 1)
        found = place[np.arange(len(q))[:, None], self.nearest(x)[best]]
        return min(self.cells, int(np.quantile(found, target, method="higher")) + 1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, most promising first."""
        return np.argsort(-(q.astype(np.float32) @ self.coarse.T), axis=1, kind="stable")


def fit(rows: DataFrame, k: int, sample_rows: int, max_cells: int, target: float, queries: DataFrame | None = None) -> Index | None:
    """Fit on bounded samples of rows (id, vec) and of queries, which are the rows if not given."""
    there = rows.where(F.col("vec").isNotNull() & F.col("id").isNotNull())
    total = there.count()
    part = 1.0 if total <= sample_rows else 1.1 * sample_rows / total
    picked = there.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(part * (1 << 30))).limit(2 * sample_rows).select("id", "vec").toArrow()
    picked = picked.sort_by("id")
    ids, picked = picked.column("id").to_numpy(), picked.column("vec").combine_chunks()
    if not len(picked):
        return None
    lengths = np.nan_to_num(picked.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64), nan=0).astype(np.int64)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return None
    at, sample = vectors(picked, int(np.bincount(lengths).argmax()))
    if not len(sample):
        return None
    top = Top(ids[at][:sample_rows], sample[:sample_rows], total, max_cells)
    asked = there if queries is None else queries.where(F.col("vec").isNotNull() & F.col("id").isNotNull())
    asked = asked.select("id", "vec").orderBy(F.xxhash64("id", F.lit(29)), "id").limit(TRIES).toArrow()
    at, tries = vectors(asked.column("vec"), sample.shape[1])
    tries = asked.column("id").to_numpy()[at], tries
    if (top.parts == 1).all():
        return Index(top, total, k, target, tries)
    return Index(top, total, k, target, tries, *_divide(there, top))


def _divide(rows: DataFrame, top: Top) -> tuple[list[np.ndarray], np.ndarray]:
    """(cells of each first cell, rows that each will hold): a task for each first cell, on a bounded sample."""
    dim, shared = top.x.shape[1], rows.sparkSession.sparkContext.broadcast((top.centroids, top.parts, top.rows))
    most = float(np.max(np.minimum(1.0, PER_CELL * top.parts / np.maximum(top.rows, 1))))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(23)), 11).cast("double") * F.lit(2.0**-53)

    def place(batches):
        centroids, parts, held = shared.value
        keep = np.minimum(1.0, PER_CELL * parts / np.maximum(held, 1))
        for batch in batches:
            at, x = vectors(batch.column(0), dim)
            if not len(at):
                continue
            near, _ = _closest(x.astype(np.float32), centroids)
            use = batch.column(1).to_numpy()[at] < keep[near]
            yield pa.RecordBatch.from_arrays([pa.array(near[use].astype(np.int32)), pa.array([v.tobytes() for v in x[use].astype(np.float32)], pa.binary())], ["cell", "vec"])

    def divide(key, part):
        _, parts, held = shared.value
        c = int(key[0])
        x = np.frombuffer(b"".join(sorted(part["vec"])), np.float32).reshape(-1, dim)
        found = kmeans(x, int(max(1, min(parts[c], len(x) // 2))))
        n = np.bincount(_closest(x, found)[0], minlength=len(found)) * (held[c] / len(x))
        return pd.DataFrame({"cell": c, "no": range(len(found)), "vec": [v.tobytes() for v in found], "n": n.astype(float)})

    drawn = rows.select("vec", draw.alias("draw")).where(F.col("draw") < most).mapInArrow(place, "cell int, vec binary")
    got = drawn.groupBy("cell").applyInPandas(divide, "cell int, no int, vec binary, n double").toPandas().sort_values(["cell", "no"])
    of = {c: g for c, g in got.groupby("cell")}
    leaves = [np.frombuffer(b"".join(of[c]["vec"]), np.float32).reshape(-1, dim) if c in of else top.centroids[c : c + 1] for c in range(len(top.centroids))]
    return leaves, np.concatenate([of[c]["n"].to_numpy() if c in of else top.rows[c : c + 1] for c in range(len(top.centroids))])


def _layout(index: Index, block_rows: int, group_rows: int, tasks: int) -> tuple[np.ndarray, int]:
    """(sub-cells of each cell, groups): enough groups for the tasks, none above ``group_rows``."""
    subs = np.maximum(1, np.ceil(index.rows / block_rows)).astype(np.int64)
    return subs, max(1, math.ceil(index.total / group_rows), min(tasks, math.ceil(index.total / 512)))


def _group_of(cell, sub, groups: int):
    return (np.asarray(cell, dtype=np.uint64) * np.uint64(0x9E3779B1) + np.asarray(sub, dtype=np.uint64) * np.uint64(0x85EBCA77)) % np.uint64(groups)


def _search(index_rows: DataFrame, query_rows: DataFrame, shared, k: int, probes: int, block_rows: int, group_rows: int) -> DataFrame:
    """query_id, vec_id, score: the best of each group for each query."""
    tasks = 2 * index_rows.sparkSession.sparkContext.defaultParallelism
    kind = np.float32 if dict(index_rows.dtypes)["vec"] == "array<float>" else np.float64
    schema = "grp int, kind int, id long, vec binary, cell int, sub int, extra binary"

    def place(batches):
        index = shared.value
        subs, groups = _layout(index, block_rows, group_rows, tasks)
        for batch in batches:
            at, x = vectors(batch.column(1), index.dim)
            if not len(at):
                continue
            ids = batch.column(0).take(pa.array(at)).to_numpy()
            near = index.nearest(x.astype(np.float32))
            sub = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % subs[near]
            n = len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_group_of(near, sub, groups).astype(np.int32)),
                    pa.array(np.zeros(n, np.int32)),
                    pa.array(ids),
                    pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                    pa.array(near.astype(np.int32)),
                    pa.array(sub.astype(np.int32)),
                    pa.nulls(n, pa.binary()),
                ],
                ["grp", "kind", "id", "vec", "cell", "sub", "extra"],
            )

    def send(batches):
        index = shared.value
        subs, groups = _layout(index, block_rows, group_rows, tasks)
        # the groups that hold each cell, next to each other
        cell, sub = np.repeat(np.arange(len(subs)), subs), np.arange(subs.sum()) - np.repeat(np.cumsum(subs) - subs, subs)
        pairs = np.unique(np.stack([cell, _group_of(cell, sub, groups).astype(np.int64)], axis=1), axis=0)
        starts = np.searchsorted(pairs[:, 0], np.arange(len(subs) + 1))
        for batch in batches:
            at, q = vectors(batch.column(1), index.dim)
            if not len(at):
                continue
            ids = batch.column(0).take(pa.array(at)).to_pylist()
            out = []
            probed = (cells for a in range(0, len(q), 256) for cells in index.order(q[a : a + 256])[:, :probes])
            for i, vec, cells in zip(ids, q, probed):
                n = starts[cells + 1] - starts[cells]
                mine = pairs[np.arange(n.sum()) + np.repeat(starts[cells] - (np.cumsum(n) - n), n)]
                mine = mine[np.argsort(mine[:, 1], kind="stable")]
                cuts = np.flatnonzero(np.concatenate(([True], mine[1:, 1] != mine[:-1, 1], [True])))
                raw = vec.astype(kind).tobytes()
                out += [(int(mine[a, 1]), 1, i, raw, 0, 0, mine[a:b, 0].astype(np.int32).tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS)], ["grp", "kind", "id", "vec", "cell", "sub", "extra"])

    def score(batches):
        index = shared.value
        grp, held, ready, ask = None, [], None, []
        for batch in batches:
            groups = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((groups[1:] != groups[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(groups)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if a == b:
                    continue
                if groups[a] != grp:
                    if ask:
                        yield from _answers(index, ready, ask, k, kind)
                    grp, held, ready, ask = groups[a], [], None, []
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    ready, held = _cells(index, held, kind, k), []
                for i, v, e in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(6).to_pylist()):
                    ask.append((i, v, e))
                    if len(ask) >= 256:
                        yield from _answers(index, ready, ask, k, kind)
                        ask = []
        if ask:
            yield from _answers(index, ready, ask, k, kind)

    rows = index_rows.mapInArrow(place, schema).union(query_rows.mapInArrow(send, schema))
    _, groups = _layout(shared.value, block_rows, group_rows, tasks)
    return rows.repartition(2 * groups, "grp").sortWithinPartitions("grp", "kind").mapInArrow(score, RESULT)


_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]


class Cell:
    """What a group holds of a cell: distinct vectors, ``starts`` of the ids of each, the vectors' ``rest`` from the centroid and its longest, ``radius``."""

    def __init__(self, centroid: np.ndarray, ids: np.ndarray, starts: np.ndarray, x: np.ndarray):
        self.centroid, self.ids, self.starts, self.x = centroid.astype(np.float64), ids, starts, x
        rest = x - self.centroid
        self.rest, self.radius = rest.astype(np.float32), float(np.sqrt((rest * rest).sum(1).max()))


def _cells(index: Index, held: list[pa.RecordBatch], kind, k: int) -> tuple[dict[int, Cell], bool]:
    """(the cells of a group, whether no id comes twice in it); copies of a vector keep their ``k`` + 1 smallest ids."""
    if not held:
        return {}, True
    whole = pa.Table.from_batches(held)
    ids, cell = whole.column("id").to_numpy(), whole.column("cell").to_numpy()
    raw = whole.column("vec").to_pylist()
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, index.dim)
    order = np.lexsort((ids, cell))
    cuts = np.flatnonzero(np.concatenate(([True], cell[order][1:] != cell[order][:-1]))).tolist() + [len(order)]
    out = {}
    for a, b in zip(cuts[:-1], cuts[1:]):
        seen: dict[bytes, int] = {}
        rows = order[a:b]
        copy = np.array([seen.setdefault(raw[r], len(seen)) for r in rows.tolist()])
        by = np.argsort(copy, kind="stable")
        rows, copy = rows[by], copy[by]
        new = np.concatenate(([True], (copy[1:] != copy[:-1]) | (ids[rows][1:] != ids[rows][:-1])))
        rows, copy = rows[new], copy[new]
        keep = np.arange(len(copy)) - np.searchsorted(copy, copy) <= k
        rows, copy = rows[keep], copy[keep]
        starts = np.searchsorted(copy, np.arange(len(seen) + 1))
        first = rows[starts[:-1]]
        c = int(cell[rows[0]])
        out[c] = Cell(index.coarse[c], ids[rows], starts, x[first])
    return out, len(np.unique(ids)) == len(ids)


def _top(who: np.ndarray, vec: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best ids of each query, an id once with its best score, equal scores by the smaller id."""
    order = np.lexsort((-s, vec, who))
    who, vec, s = who[order], vec[order], s[order]
    once = np.concatenate(([True], (who[1:] != who[:-1]) | (vec[1:] != vec[:-1]))) if len(who) else np.zeros(0, bool)
    who, vec, s = who[once], vec[once], s[once]
    order = np.lexsort((vec, -s, who))
    who, vec, s = who[order], vec[order], s[order]
    best = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[best], vec[best], s[best]


def _answers(index: Index, ready: tuple[dict[int, Cell], bool], ask: list, k: int, kind):
    """The ``k`` best in this group for a block of queries."""
    cells, once = ready
    if not cells:
        return
    names = np.array([i for i, _, _ in ask], dtype=np.int64)
    q = np.frombuffer(b"".join(v for _, v, _ in ask), kind).reshape(-1, index.dim).astype(np.float64)
    length = np.sqrt((q * q).sum(1))
    unit = (q / length[:, None]).astype(np.float32)
    wanted: dict[int, list[int]] = {}
    for j, (_, _, e) in enumerate(ask):
        for c in np.frombuffer(e, np.int32).tolist():
            wanted.setdefault(c, []).append(j)
    # scores by a query's length.  The k + 1 best so far of each (one may be the query itself), less the error that they may have
    best = np.full((len(ask), k + 1), -np.inf)
    got, held = [], 0
    for c, asking in wanted.items():
        if c not in cells:
            continue
        cell, asking = cells[c], np.array(asking)
        base = (q[asking] @ cell.centroid) / length[asking]
        # of single precision sums; of doubles, and of what is added to them
        error = (index.dim + 8) * (2.0**-23 * cell.radius + 2.0**-50 * float(np.sqrt((cell.centroid**2).sum())))
        may = ~(base + cell.radius + error < best[asking].min(1))
        who, base = asking[may], base[may]
        for lo in range(0, len(cell.x) if len(who) else 0, 4096):
            near = unit[who] @ cell.rest[lo : lo + 4096].T
            n = near.shape[1]
            mine = cell.ids[cell.starts[lo] : cell.starts[lo + n]]
            # one more for the query itself, one for each time an id comes again
            take = k + 1 + len(mine) - len(np.unique(mine))
            last = np.full(len(who), -np.inf)
            if take < n:
                tops = np.partition(near, n - take, axis=1)[:, n - take :].astype(np.float64)
                last = tops[:, 0] - 2 * error
            else:
                tops = near.astype(np.float64)
            if once:
                both = np.concatenate([best[who], tops + (base - error)[:, None]], axis=1)
                best[who] = np.partition(both, both.shape[1] - k - 1, axis=1)[:, both.shape[1] - k - 1 :]
                last = np.maximum(last, best[who].min(1) - base - error)
            row, pick = np.nonzero(~(near < last[:, None]))
            for at in range(0, len(row), 65_536):
                r, p = who[row[at : at + 65_536]], pick[at : at + 65_536] + lo
                exact = np.einsum("rd,rd->r", cell.x[p].astype(np.float64), q[r])
                n = cell.starts[p + 1] - cell.starts[p]
                each = np.repeat(np.arange(len(p)), n)
                vec = cell.ids[np.arange(len(each)) + np.repeat(cell.starts[p] - (np.cumsum(n) - n), n)]
                real = np.isfinite(exact[each]) & (vec != names[r[each]])
                got.append((r[each][real], vec[real], exact[each][real]))
                held += len(each)
                if held > 1 << 21:
                    got = [_top(*map(np.concatenate, zip(*got)), k)]
                    held = 0
    if not got:
        return
    who, vec, s = _top(*map(np.concatenate, zip(*got)), k)
    yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(vec), pa.array(s)], ["query_id", "vec_id", "score"])


def search(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    sample_rows: int = 20_000,
    max_cells: int = 1 << 16,
    target: float = 0.97,
    block_rows: int = 4096,
    group_rows: int = 131_072,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product for each query."""
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    queries = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    index = fit(rows, k, sample_rows, max_cells, target, queries)
    if index is None:
        return empty
    shared = spark.sparkContext.broadcast(index)

    def best(found: DataFrame) -> DataFrame:
        once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    how = (k, index.probes, block_rows, group_rows)
    out = materialize(best(_search(rows, queries, shared, *how)), "neighbours")
    if index.probes == index.cells:
        return out
    full = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
    short = queries.join(full, queries["id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return out
    again = best(_search(rows, short, shared, k, index.cells, block_rows, group_rows))
    return out.join(full, "query_id", "left_semi").unionByName(again)


def op3_ann_search(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
