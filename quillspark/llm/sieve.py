"""Finding a few rows of a table by id without moving the table.

A sieve is a Bloom filter of two hashes over 64-bit ids: 8 to 16 bits an id, ``2**16``
bits at least and ``2**30`` (128 MB) at most, whatever the number of ids, so it can be
broadcast.  A row that misses it is surely not among the ids; the few that hit it
(one in twenty at 8 bits) are joined exactly.  Beyond some 134 million ids more rows
hit it, and the joins move them, too; results stay exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released
from .words import mix


def _bits_of(ids: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each id."""
    if isinstance(ids, pa.ChunkedArray):
        ids = ids.combine_chunks()
    h = mix(ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64).copy())
    return h & np.uint64(bits - 1), (h >> np.uint64(34)) & np.uint64(bits - 1)


class Sieve:
    """Null ids never pass."""

    def __init__(self, ids: DataFrame, column: str, least: int = 16, most: int = 30):
        rows = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("id"))
        n = rows.count()
        self.empty = not n
        bits = 1 << min(most, max(least, (8 * n).bit_length()))

        def mark(batches):
            for batch in batches:
                at = np.concatenate(_bits_of(batch.column(0), bits))
                words, where = np.unique(at >> np.uint64(6), return_inverse=True)
                value = np.zeros(len(words), dtype=np.uint64)
                np.bitwise_or.at(value, where, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(value.view(np.int64))], ["word", "bits"])

        got = rows.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(bits >> 6, dtype=np.uint64)
        words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
        self.bits, self._shared = bits, ids.sparkSession.sparkContext.broadcast(words)

    def passes(self, ids: pa.Array) -> pa.Array:
        words, hit = self._shared.value, np.uint64(1)
        for at in _bits_of(ids, self.bits):
            hit = hit & (words[at >> np.uint64(6)] >> (at & np.uint64(63)))
        return pa.array(hit.astype(bool) & np.asarray(ids.is_valid()))


def split(docs: DataFrame, id_col: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among ``ids``, rows that are not); ``ids`` has one column."""
    sieve, at = Sieve(ids, ids.columns[0]), docs.columns.index(id_col)

    def part(wanted: bool):
        def run(batches):
            for batch in batches:
                hit = sieve.passes(batch.column(at))
                yield batch.filter(hit if wanted else pc.invert(hit))

        return run

    return docs.mapInArrow(released(part(True)), docs.schema), docs.mapInArrow(released(part(False)), docs.schema)


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is among ``ids``; rows with a null id stay."""
    maybe, surely_not = split(docs, id_col, ids)
    ids = ids.select(F.col(ids.columns[0]).alias("_sieve_id")).distinct().hint("merge")
    return surely_not.unionByName(maybe.join(ids, maybe[id_col] == ids["_sieve_id"], "left_anti"))
