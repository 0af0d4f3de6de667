"""A chainable query over a store's blocks; every step only adds to the plan."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import navigation as nav


class Query:
    def __init__(self, blocks: DataFrame, zones: DataFrame):
        self._blocks, self._zones = blocks, zones
        self._zone: Column | None = None
        self._heading: tuple[str, int | None] | None = None
        self._filters: list[Column] = []
        self._limit: int | None = None

    def _with(self, **changes) -> Query:
        out = copy.copy(self)
        out._filters = list(self._filters)
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def documents(self, predicate: Column | str) -> Query:
        """Only documents whose zone map fits; the last call wins."""
        return self._with(_zone=F.expr(predicate) if isinstance(predicate, str) else predicate)

    def under_heading(self, text: str, depth: int | None = None) -> Query:
        """Only blocks under the first such heading of each document; documents without it give none."""
        return self._with(_heading=(text, depth))

    def filter(self, condition: Column | str) -> Query:
        return self._with(_filters=[*self._filters, F.expr(condition) if isinstance(condition, str) else condition])

    def under_interval(self, pre: int, post: int) -> Query:
        return self.filter((F.col("pre") > pre) & (F.col("post") < post))

    def block_type(self, kind: str) -> Query:
        return self.filter(F.col("block_type") == kind)

    def heading_depth(self, depth: int) -> Query:
        return self.filter((F.col("block_type") == "heading") & (F.col("depth") == depth))

    def code_lang(self, lang: str) -> Query:
        return self.filter((F.col("block_type") == "code") & (F.col("lang") == lang))

    def content_contains(self, text: str) -> Query:
        return self.filter(F.col("content").contains(text))

    def content_contains_ci(self, text: str) -> Query:
        return self.filter(F.lower("content").contains(text.lower()))

    def limit(self, n: int) -> Query:
        return self._with(_limit=n)

    def blocks(self) -> DataFrame:
        out = self._blocks
        if self._zone is not None:
            out = out.join(self._zones.where(self._zone).select("document_id"), "document_id", "left_semi")
        for f in self._filters:
            out = out.where(f)
        if self._heading is not None:
            anchors = nav.first_heading(self._blocks, *self._heading)
            out = out.join(anchors, "document_id").where("anchor_pre < pre AND post < anchor_post").drop("anchor_pre", "anchor_post")
        out = out.select(*self._blocks.columns)
        if self._limit is not None:
            out = out.orderBy("document_id", "ord").limit(self._limit)
        return out

    def collect(self) -> list:
        return self.blocks().orderBy("document_id", "ord").collect()

    def count(self) -> int:
        return self.blocks().count()
