"""N-gram Jaccard join by parity sketches.

A document's set is its distinct 5-word shingles.  Two documents link when
``100 * |A & B| >= T * |A | B|``, which is ``(100 + T) * |A ^ B| <= (100 - T) *
(|A| + |B|)``: with sizes in a band, linked sets differ in at most D shingles.
Each shingle flips one bit of a sketch; the Hamming distance of two sketches is
then at most ``|A ^ B|``.  Cut into D + 1 blocks, the sketches of two linked sets
agree in at least one block, whatever the hashes are, so an equi-join on
(band, block number, block value) misses no link.  Candidates are verified on
whole shingle sets.

Plan at scale.  Texts are read three times and never shuffled: what moves is block
keys, about a quarter of a key for each shingle, a narrower sketch per distinct set,
and the sets of candidates, which a Bloom filter of bounded size picks out of the
third reading.  Equal sets are one class, named by a 128-bit digest of the set, so
that copies cost a counter; a task emits the block keys of a set once however many
copies it sees.

Sets that share a bucket are candidates only if the Hamming distance of their
sketches (folded to about half a bit a shingle, which only lowers it) and the
difference of their sizes leave the link possible.  Unrelated sets meet in buckets,
as more and more sets share a block without any odd bit, but hardly ever pass
this test, so groups of candidates don't grow together.  A bucket gives a spanning
forest of its possible links, never pairs, and a bucket above ``bucket_sets`` is cut
into chunks whose pairs are tasks.  Candidate groups, the forests' components, are
verified in tasks of bounded size in the same way, so a hot group spreads over the
cluster and nothing is dropped.  A task emits sums and a spanning forest.

Defined cases: null and empty texts, and texts of white space, have an empty
set, link with nothing and are their own component.  A text with fewer words
than a shingle has its whole word sequence as its only shingle.  Repeated rows
are documents of their own and count as links.  A row without id links as any
other, but never names a component (a component without ids has none).  Empty
tables give empty results.  Other columns are ignored by ``ngram_join`` and
returned unchanged by ``survivors``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, released, table
from .components import connected_components
from .sieve import Sieve, without
from .words import chunks, mix, text_bytes, word_hashes

BLOCK_BITS = 512
_MULT = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def bands(limit: int, threshold: int) -> np.ndarray:
    """Lower bounds of size bands; linked sizes lie in one band or in neighbours."""
    out = [1]
    while out[-1] <= limit:
        out.append(100 * out[-1] // threshold + 1)
    return np.array(out + [100 * out[-1] // threshold + 1], dtype=np.int64)


def allowed(band: int, lows: np.ndarray, threshold: int) -> int:
    """Most differing shingles of a linked pair whose smaller set is in ``band``."""
    small = int(lows[band + 1]) - 1
    return (100 - threshold) * (small + 100 * small // threshold) // (100 + threshold)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    words, rows = word_hashes(raw, offsets)
    if len(words) >= k:
        grams = words[: len(words) - k + 1] * _MULT[0]
        for i in range(1, k):
            grams += words[i : len(words) - k + 1 + i] * _MULT[i]
        grams = mix(grams)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        n = b - a
        if n >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif n:
            short = (words[a:b] * _MULT[:n]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short ^ np.uint64(0xA5A5A5A5_00000000 + n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def block_keys(hashes: np.ndarray, band: int, blocks: int) -> np.ndarray:
    """One 64-bit key per sketch block; equal blocks have equal keys.

    ``hashes`` is sorted, so bit positions (their scaled upper halves) are too.
    """
    width = max(1, min(BLOCK_BITS, (1 << 32) // blocks))
    bits = ((hashes >> np.uint64(32)) * np.uint64(blocks * width)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate(([True], bits[1:] != bits[:-1], [True])))
    odd = bits[edge[:-1]][(np.diff(edge) & 1).astype(bool)]
    sums = np.zeros(len(odd) + 1, dtype=np.uint64)
    np.cumsum(mix(odd + np.uint64(1)), out=sums[1:])
    cuts = np.searchsorted(odd, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(width))
    value = sums[cuts[1:]] - sums[cuts[:-1]]
    return mix(value + mix(np.arange(blocks, dtype=np.uint64) + np.uint64(band << 40)))


def fold(hashes: np.ndarray) -> bytes:
    """A parity sketch of 64 bits at least and about half a bit a shingle; halves of it XORed are the next narrower one."""
    bits = max(64, 1 << (len(hashes) // 2).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _rows(batches: Iterator[pa.RecordBatch], k: int):
    """(ids, sets) of successive chunks."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            yield batch.column(0).slice(a, b - a), shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def _class_number(name: bytes) -> int:
    """The first 64 bits of a digest.  Classes that share them are candidates together, no more."""
    return int.from_bytes(name[:8], "big", signed=True)


def _signatures(k: int):
    def run(batches):
        for ids, sets in _rows(batches, k):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([fold(s) for s in sets], pa.binary())],
                ["doc_id", "n", "digest", "sketch"],
            )

    return run


def _keys(k: int, threshold: int):
    def run(batches):
        lows, seen = bands(1, threshold), set()
        for _, sets in _rows(batches, k):
            keys, owners = [], []
            for s in sets:
                if not len(s):
                    continue
                name = digest(s)
                if name in seen:
                    continue
                seen.add(name)
                if len(s) >= lows[-2]:
                    lows = bands(2 * len(s), threshold)
                own = int(np.searchsorted(lows, len(s), side="right")) - 1
                for band in (own, own - 1):
                    most = allowed(band, lows, threshold) if band >= 0 else 0
                    if most:  # with no difference allowed, linked sets are equal: one class
                        keys.append(block_keys(s, band, most + 1))
                        owners.append((_class_number(name), most + 1))
            if keys:
                who = np.repeat(np.array([c for c, _ in owners], dtype=np.int64), [n for _, n in owners])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(who)], ["key", "cid"])

    return run


def _shared(bucket_sets: int):
    """Of rows sorted by (key, cid): the members of buckets with two classes or more, each once, with the number of its chunk."""

    def run(batches):
        key = cid = None
        waiting, place = False, 0  # whether the bucket's first member is not told yet; place of the last member
        for batch in batches:
            keys, cids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            fresh = np.concatenate(([key is None or keys[0] != key], keys[1:] != keys[:-1]))
            new = fresh | np.concatenate(([cids[0] != cid], cids[1:] != cids[:-1]))
            keys_, cids_, fresh_ = keys[new], cids[new], fresh[new]
            if len(keys_):
                n = len(keys_)
                head = np.maximum.accumulate(np.where(fresh_, np.arange(n), -1))
                where = np.where(head >= 0, np.arange(n) - np.maximum(head, 0), place + 1 + np.arange(n))
                lone = fresh_ & np.concatenate((fresh_[1:], [True]))  # a first member that no second follows here
                out = ~lone
                k, c, w = keys_[out], cids_[out], where[out]
                if waiting and not fresh_[0]:
                    k, c, w = np.concatenate(([key], k)), np.concatenate(([cid], c)), np.concatenate(([0], w))
                    waiting = False
                if fresh_.any():
                    waiting = bool(lone[-1])
                key, cid, place = keys_[-1], cids_[-1], int(where[-1])
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(c), pa.array((w // bucket_sets).astype(np.int32))], ["key", "cid", "chunk"])

    return run


def _narrow(sketches: list[bytes]) -> np.ndarray:
    """Sketches of one width, the narrowest of them, as rows of 64-bit words."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), dtype=np.uint64)
    for i, b in enumerate(sketches):
        v = np.frombuffer(b, "<u8")
        while len(v) > width:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[i] = v
    return out


def _possible(m: int, n: int, x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    most = (100 - threshold) * (m + n) // (100 + threshold)
    return abs(m - n) <= most and int(np.bitwise_count(x ^ y).sum()) <= most


def possible_forest(sizes: np.ndarray, sketches: np.ndarray, threshold: int, split: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph in which two sets are adjacent if sizes and sketches leave a link possible; with ``split``, only edges across it.

    A search by breadth: what is reached is compared with what is not, so a group
    of near copies costs about its size, and only sets that are apart cost pairs.
    """
    n = len(sizes)
    # what is not reached yet, in order, on each side; without a split there is one side
    pools = [[np.arange(a, b), sizes[a:b], sketches[a:b]] for a, b in ([(0, n)] if split is None else [(0, split), (split, n)])]
    side = lambda u: 0 if split is None else int(u >= split)
    edges: list[tuple[int, int]] = []
    for root in range(n):
        own = pools[side(root)]
        if not len(own[0]) or own[0][0] != root:
            continue  # reached from an earlier one
        own[:] = [x[1:] for x in own]
        queue = [root]
        while queue:
            now, queue = queue, []
            for u in now:
                pool = pools[0 if split is None else 1 - side(u)]
                if not len(pool[0]):
                    continue
                most = (100 - threshold) * (sizes[u] + pool[1]) // (100 + threshold)
                near = np.bitwise_count(pool[2] ^ sketches[u]).sum(axis=1, dtype=np.int64) <= most
                near &= np.abs(pool[1] - sizes[u]) <= most
                if near.any():
                    hits = pool[0][near].tolist()
                    pool[:] = [x[~near] for x in pool]
                    edges += [(u, v) for v in hits]
                    queue += hits
    return edges


def _forests(threshold: int):
    """Of rows sorted by (key, ci, cj): edges (a, b) of the possible links in each bucket."""

    def solve(rows):
        rows = list({(r["chunk"], r["cid"], r["sketch"]): r for r in rows}.values())
        rows.sort(key=lambda r: (r["chunk"], r["cid"], r["sketch"]))
        if len(rows) == 2:  # most buckets
            x, y = rows
            return [(x["cid"], y["cid"])] if _possible(x["n"], y["n"], *_narrow([x["sketch"], y["sketch"]]), threshold) else []
        split = sum(r["chunk"] == rows[0]["ci"] for r in rows) if rows[0]["ci"] != rows[0]["cj"] else None
        edges = possible_forest(np.array([r["n"] for r in rows], dtype=np.int64), _narrow([r["sketch"] for r in rows]), threshold, split)
        return [(rows[u]["cid"], rows[v]["cid"]) for u, v in edges]

    def tell(done):
        a, b = zip(*sorted(set(done)))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        done: list[tuple[int, int]] = []
        for rows in _by_task(batches, ("key", "ci", "cj")):
            done += solve(rows)
            if len(done) > 50_000:
                yield tell(done)
                done = []
        if done:
            yield tell(done)

    return run


def _by_task(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]):
    """Rows of successive groups in sorted batches."""
    held, name = [], None
    for batch in batches:
        for r in batch.to_pylist():
            key = tuple(r[n] for n in names)
            if key != name and held:
                yield held
                held = []
            name = key
            held.append(r)
    if held:
        yield held


def _sets(k: int, sieve: Sieve, nameless: Sieve):
    """Shingle sets of the documents whose id passes the sieve, and of those without id whose class passes the other; a task gives a set once."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            for hit, named in ((batch.filter(sieve.passes(batch.column(0))), True), (batch.filter(batch.column(0).is_null()), False)):
                if not hit.num_rows or (not named and nameless.empty):
                    continue
                for _, sets in _rows([hit], k):
                    names = [digest(s) for s in sets]
                    ok = np.ones(len(sets), dtype=bool) if named else np.asarray(nameless.passes(pa.array([_class_number(x) for x in names], pa.int64())))
                    keep = []
                    for i, x in enumerate(names):
                        if ok[i] and x not in seen:
                            seen.add(x)
                            keep.append(i)
                    if keep:
                        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in keep], pa.binary()), pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["digest", "hashes"])

    return run


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def linked_pairs(sets: list[np.ndarray], threshold: int, split: int | None = None, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j that link; with ``split``, only pairs across it."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(edge, len(flat)))
    shared = np.repeat(lengths > 1, lengths)
    column = np.repeat(np.cumsum(lengths > 1) - 1, lengths)[shared]
    owner = owner[shared]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    total = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, total, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((len(sets), min(width, total - a)), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    both = sizes[:, None] + sizes[None, :] - common
    ok = np.triu((100 * common >= threshold * both) & (common > 0), 1)
    if split is not None:
        ok[:split, :split] = False
        ok[split:, split:] = False
    return np.nonzero(ok)


def _verify(threshold: int):
    """Of rows sorted by (group, ci, cj): per class the documents it links with, and a spanning forest."""

    def solve(rows):
        rows = list({r["digest"]: r for r in rows}.values())  # several tasks may have read a set
        part = rows[0]["ci"] != rows[0]["cj"]
        rows.sort(key=lambda r: (r["chunk"], r["digest"]))
        split = sum(r["chunk"] == rows[0]["ci"] for r in rows) if part else None
        left, right = linked_pairs([np.frombuffer(r["hashes"], np.uint64) for r in rows], threshold, split)
        if not len(left):
            return []
        size = np.array([r["size"] for r in rows], dtype=np.int64)
        more = np.zeros(len(rows), dtype=np.int64)
        np.add.at(more, left, size[right])
        np.add.at(more, right, size[left])
        root = _roots(len(rows), left, right)
        return [(r["digest"], int(m), rows[t]["digest"]) for r, m, t in zip(rows, more, root.tolist()) if m]

    def run(batches):
        done = []
        for rows in _by_task(batches, ("grp", "ci", "cj")):
            done += solve(rows)
            if len(done) > 20000:
                yield _links(done)
                done = []
        if done:
            yield _links(done)

    return run


def _links(done):
    d, m, r = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(m, pa.int64()), pa.array(r, pa.binary())], ["digest", "more", "root"])


def _chunk_pairs(rows: DataFrame, group: str) -> DataFrame:
    """A row for each pair of chunks (ci <= cj) that its chunk is in; ``cut`` is the number of chunks of its group."""
    spread = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    spread = spread.withColumns({"ci": F.least("chunk", "other"), "cj": F.greatest("chunk", "other")}).drop("other", "cut")
    return spread.repartition(group, "ci", "cj").sortWithinPartitions(group, "ci", "cj")


def candidate_groups(rows: DataFrame, classes: DataFrame, k: int, threshold: int, bucket_sets: int) -> DataFrame:
    """node, component over class numbers (see ``_class_number``) of sets that may link."""
    keys = rows.mapInArrow(released(_keys(k, threshold)), "key long, cid long")
    shared = materialize(keys.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(_shared(bucket_sets), "key long, cid long, chunk int"), "buckets")
    hot = shared.groupBy("key").agg((F.max("chunk") + 1).alias("cut")).where("cut > 1")
    member = shared.join(hot, "key", "left").join(classes.select("cid", "n", "sketch"), "cid").withColumn("cut", F.coalesce("cut", F.lit(1)))
    return connected_components(_chunk_pairs(member, "key").mapInArrow(_forests(threshold), "a long, b long"))


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: int = 90, task_shingles: int = 1_000_000, task_sets: int = 400, bucket_sets: int = 4096
) -> DataFrame:
    """One row per document: id, n_shingles, n_similar, component_id.

    ``threshold`` is in percent.  ``task_shingles`` and ``task_sets`` bound what
    one side of a verification task holds, ``bucket_sets`` what one side of a
    bucket's task does; larger groups and buckets are cut, not capped.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(released(_signatures(k)), "doc_id long, n long, digest binary, sketch binary"), "signatures")
    cid = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")
    of = signed.where("n > 0").groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialize(of.withColumn("cid", cid), "classes")

    groups = candidate_groups(rows, classes, k, threshold, bucket_sets)
    member = groups.join(classes.drop("sketch"), groups["node"] == classes["cid"]).select(F.col("component").alias("grp"), "digest", "size", classes["node"], "n", "cid")
    weight = member.groupBy("grp").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    cut = F.greatest(F.ceil(F.col("shingles") / task_shingles), F.ceil(F.col("sets") / task_sets)).cast("int")
    member = member.join(weight.where("sets > 1").select("grp", cut.alias("cut")), "grp")
    member = materialize(member.withColumn("chunk", F.pmod(F.xxhash64("digest"), F.col("cut")).cast("int")), "members")

    sieve, nameless = Sieve(member, "node"), Sieve(member.where("node is null"), "cid")
    found = rows.mapInArrow(released(_sets(k, sieve, nameless)), "digest binary, hashes binary")
    found = found.join(member.select("digest", "size", "grp", "chunk", "cut").hint("merge"), "digest")
    links = materialize(_chunk_pairs(found, "grp").mapInArrow(released(_verify(threshold)), "digest binary, more long, root binary"), "links")

    named = connected_components(links.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    named = materialize(named.join(classes.select("digest", "node"), "digest"), "named")
    lowest = named.groupBy("component").agg(F.min("node").alias("lowest"))
    more = links.groupBy("digest").agg(F.sum("more").alias("more")).join(named.join(lowest, "component").select("digest", "lowest"), "digest")
    of_class = classes.where("size > 1").select("digest", "size", "node").join(more, "digest", "full").select(
        "digest", F.coalesce("size", F.lit(1)).alias("size"), F.col("node"), F.coalesce("more", F.lit(0)).alias("more"), "lowest"
    )
    out = signed.drop("sketch").join(of_class, "digest", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.coalesce(F.col("size") - 1 + F.col("more"), F.lit(0))).otherwise(0).cast("long").alias("n_similar"),
        F.when(F.col("n") > 0, F.coalesce("lowest", "node", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, all columns unchanged.

    Rows that share an id stay or go together; they stay if one of them may.  Rows
    without id always stay.
    """
    found = materialize(ngram_join(docs, id_col, text_col, **how).select(F.col(id_col).alias("id"), F.col(id_col).eqNullSafe(F.col("component_id")).alias("stays")), "verdicts")
    gone = found.groupBy("id").agg(F.max("stays").alias("stays")).where("not stays").select("id")
    return without(docs, id_col, gone)


def op5_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE []::VARCHAR[] END AS sh FROM w
), e AS (
  SELECT doc_id, hash(g) AS g, n FROM (SELECT doc_id, unnest(sh) AS g, len(sh) AS n FROM s)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, coalesce(k.n, 0) AS n_similar, c.component_id
FROM s LEFT JOIN (SELECT a, count(*) AS n FROM p GROUP BY a) k ON k.a = s.doc_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = s.doc_id
"""
