"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source x language x topic) are raked: each round
multiplies the cells of a marginal so that its shares meet their targets, in turn
for all marginals, until every share is met.  A document's probability is its
cell's weight times one factor, the largest for which no probability exceeds 1, so
expected token shares are the targets.  Where that factor keeps less than
``least_share`` of the tokens (one tiny cell far below its target is enough), or a
``budget_share`` is given, the factor is the one that keeps this share, with
probabilities cut at 1: cells that lack the tokens for their target are kept whole
and their shares stay below it.  Documents are then drawn by a hash of their id: the
draw is the same in every run, on any partitioning.

Rows are aggregated to cells on the map side.  Up to ``max_cells`` cells (counted
first) are raked on the driver; more are raked by DataFrame rounds, of which only
sums reach the driver (and the shares of a marginal whose target is a function other
than ``flatten``).  Both ways rake alike, until no share is off by ``TOLERANCE`` or for
``ROUNDS`` rounds; the numbers differ by rounding.  Targets not met by then (sparse cells
may allow no weights that meet them) are reported by a warning.

A cell's weight is a product of one factor per marginal, and only these go back to
the rows: one small table per marginal, broadcast as long as it has ``max_cells``
values at most, so texts stay where they are however many cells there are.  A
marginal with more values than that is joined by a shuffle.

Defined cases: null and empty texts have no tokens and take their cell's
probability, as has a null id (all null ids share one draw).  A null source,
language or topic is a value of its own.  A value without target keeps its
observed share of what the listed targets leave (all of it if none is listed).
Targets are scaled to 1; a target for a value that no row has is dropped before.
Rows repeated with one id are drawn together.  Empty tables give empty results;
``survivors`` returns columns unchanged, whatever their names.
"""

from __future__ import annotations

import functools
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_prefix, materialize, table

DIMS = ("source", "lang", "topic")
#: Share of the tokens that mixing keeps at least, however rare the rarest cell is.
LEAST_SHARE = 0.3
#: Raking ends when no share of a round is off its target by this part of it, or after so many rounds.
TOLERANCE, ROUNDS = 1e-10, 200


def tokens(text: str = "text") -> Column:
    """Number of white-space separated words."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long")


def topic(text: str = "text") -> Column:
    """What a text is about, as far as its form tells; the first that fits."""
    t = F.col(text)
    return (
        F.when(t.isNull() | (t == ""), "empty")
        .when(t.contains(" License") | t.contains("licensed under"), "licence")
        .when(t.contains(" | "), "table")
        .when(t.contains("@"), "contact")
        .when(t.contains("%%%") | t.contains("***") | t.contains("!!"), "symbols")
        .when(F.length(t) < 1000, "note")
        .otherwise("prose")
    )


class flatten:
    """Targets from observed shares: their powers, scaled; a power below 1 lifts the rare."""

    def __init__(self, power: float):
        self.power = power

    def __call__(self, shares: pd.Series) -> dict:
        p = shares.clip(lower=0) ** self.power
        return (p / p.sum()).to_dict() if p.sum() else {}


def _targets(shares: pd.Series, target) -> pd.Series:
    """One target share per observed value with tokens; they sum to 1."""
    shares = shares[shares > 0]
    listed = target(shares) if callable(target) else {k: v for k, v in (target or {}).items() if k in shares.index}
    out = pd.Series({k: listed.get(k, np.nan) for k in shares.index}, dtype=float)
    free = out.isna()
    if free.any():
        left = max(0.0, 1 - out.sum()) if not free.all() else 1.0
        out[free] = shares[free] / shares[free].sum() * left
    return out / out.sum() if out.sum() else out


def rake(cells: pd.DataFrame, targets: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights of the cells (dims and ``tokens``)."""
    return rake_factors(cells, targets, rounds, tolerance)[0]


def rake_factors(cells: pd.DataFrame, targets: dict, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, dict[str, dict]]:
    """Weights of the cells, and for each marginal the factors of its values, whose products the weights are."""
    w = np.ones(len(cells))
    mass = cells["tokens"].to_numpy(dtype=float)
    if not mass.sum():
        return w, {d: dict.fromkeys(cells[d], 1.0) for d in targets}
    codes = {}
    for d, target in targets.items():
        code, values = pd.factorize(cells[d])
        share = pd.Series(np.bincount(code, weights=mass, minlength=len(values)) / mass.sum(), index=values)
        goal = _targets(share, target)
        codes[d] = (code, np.array([goal.get(v, 0.0) for v in values]) * mass.sum(), values, np.ones(len(values)))
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for code, goal, _, f in codes.values():
            now = np.bincount(code, weights=w * mass, minlength=len(goal))
            ratio = np.divide(goal, now, out=np.ones_like(goal), where=now > 0)
            worst = max(worst, float(np.abs(ratio - 1)[now > 0].max(initial=0)))
            f *= ratio
            w = functools.reduce(np.multiply, [g[c] for c, _, _, g in codes.values()])
        if worst < tolerance:
            break
    _report(worst, tolerance, rounds)
    return w, {d: dict(zip(values, f.tolist())) for d, (_, _, values, f) in codes.items()}


def _report(worst: float, tolerance: float, rounds: int) -> None:
    if worst >= tolerance:
        warnings.warn(f"raking ended after {rounds} rounds; in the last one a share was off its target by {worst:.2g} of it", stacklevel=3)


def factor(weights: np.ndarray, mass: np.ndarray, budget: float | None, least: float = 0.0) -> float:
    """What makes probabilities of weights: the largest that needs no cut, if it keeps ``least``; else the one whose cut probabilities meet the budget, or ``least``."""
    use = (mass > 0) & (weights > 0)
    if not use.any():
        return 1.0
    w, m = weights[use], mass[use]
    if budget is None:
        if (w @ m) / w.max() >= least:
            return 1 / w.max()
        budget = least
    order = np.argsort(-w)
    w, m = w[order], m[order]
    rest = np.cumsum((w * m)[::-1])[::-1]
    full = np.concatenate(([0.0], np.cumsum(m)))
    for i in range(len(w)):  # the i heaviest cells are cut at 1
        s = (budget - full[i]) / rest[i]
        if s * w[i] <= 1:
            return max(s, 0.0)
    return 1 / w[-1]


def _goal_table(state: DataFrame, d: str, target, total: float) -> DataFrame:
    """value, goal of one marginal; nothing but sums reaches the driver."""
    share = state.groupBy(d).agg((F.sum("tokens") / F.lit(max(total, 1.0))).alias("share")).where("share > 0")
    if isinstance(target, flatten):
        raw = share.select(F.col(d).alias("_v"), F.pow("share", F.lit(target.power)).alias("goal"))
    elif callable(target):  # takes the shares of all values of this marginal, so they go to the driver
        seen = share.toPandas()
        goal = _targets(pd.Series(seen["share"].to_numpy(), index=[("",) if v is None else v for v in seen[d]], dtype=float), target)
        raw = share.sparkSession.createDataFrame([(None if v == ("",) else v, float(g)) for v, g in goal.items()], "_v string, goal double")
    else:
        listed = share.sparkSession.createDataFrame([(k, float(v)) for k, v in (target or {}).items()], "_k string, listed double")
        both = share.join(listed, share[d].eqNullSafe(listed["_k"]), "left")
        given, free = both.agg(F.coalesce(F.sum("listed"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("listed").isNull(), F.col("share"))), F.lit(0.0))).first()
        left = 1.0 if not given else max(0.0, 1 - given)
        raw = both.select(F.col(d).alias("_v"), F.coalesce("listed", F.col("share") / F.lit(free or 1.0) * F.lit(left)).alias("goal"))
    whole = raw.agg(F.sum("goal")).first()[0] or 1.0
    return materialize(raw.withColumn("goal", F.col("goal") * F.lit(total / whole)), "goals")


def _rake_wide(cells: DataFrame, dims: list[str], targets: dict, budget: float | None, rounds: int = ROUNDS, least: float = 0.0, tolerance: float = TOLERANCE) -> tuple[dict[str, DataFrame], float, DataFrame]:
    """``rake_factors`` and ``factor`` for more cells than a driver holds, and the weighted cells; a round writes one factor per value of a marginal."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {d: _goal_table(cells, d, target, total) for d, target in targets.items()}
    factors = {d: cells.select(F.col(d).alias("_v")).distinct().withColumn("_f", F.lit(1.0)) for d in targets}

    def weighted() -> DataFrame:
        out = cells.withColumn("w", F.lit(1.0))
        for d, f in factors.items():
            out = out.join(f, out[d].eqNullSafe(f["_v"])).withColumn("w", F.col("w") * F.col("_f")).drop("_v", "_f")
        return out

    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for d in targets:
            now = weighted().groupBy(d).agg(F.sum(F.col("w") * F.col("tokens")).alias("now")).alias("n").join(goals[d].alias("g"), F.col(f"n.{d}").eqNullSafe(F.col("g._v")), "left")
            ratio = now.select(F.col(f"n.{d}").alias("_r"), F.when(F.col("now") > 0, F.coalesce("goal", F.lit(0.0)) / F.col("now")).otherwise(1.0).alias("ratio"))
            both = factors[d].join(ratio, factors[d]["_v"].eqNullSafe(ratio["_r"]))
            step = materialize(both.select("_v", (F.col("_f") * F.col("ratio")).alias("_f"), "ratio"), "rake")
            worst = max(worst, float(step.agg(F.max(F.abs(F.col("ratio") - 1))).first()[0] or 0))
            factors[d] = step.select("_v", "_f")
        if worst < tolerance:
            break
    _report(worst, tolerance, rounds)
    state = materialize(weighted(), "rake")
    top = float(state.where("tokens > 0").agg(F.max("w")).first()[0] or 1.0)
    s = 1 / top if top else 1.0
    if budget is None and float(state.agg(F.sum(F.col("w") * F.col("tokens"))).first()[0] or 0) * s < least:
        budget = least
    if budget is not None:
        low, high = 0.0, 1e12
        for _ in range(60):
            s = (low * high) ** 0.5 if low else high / 2**20
            got = float(state.agg(F.sum(F.least(F.lit(1.0), F.col("w") * s) * F.col("tokens"))).first()[0] or 0)
            low, high = (s, high) if got < budget else (low, s)
    return factors, s, state


def calibrate(rows: DataFrame, targets: dict, budget_share: float | None = None, max_cells: int = 50_000, least_share: float = LEAST_SHARE) -> tuple[dict[str, DataFrame], float]:
    """For each marginal (_v, _f), the factors of its values, and what makes probabilities of their products; ``rows`` has the dims and ``tokens``."""
    dims, spark = list(targets), rows.sparkSession
    cells = materialize(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents")), "cells")
    if cells.count() > max_cells:
        total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
        factors, scale, _ = _rake_wide(cells, dims, targets, None if budget_share is None else budget_share * total, least=least_share * total)
    else:
        got = cells.toPandas().sort_values(dims, na_position="first", ignore_index=True)
        weight, found = rake_factors(got.assign(**{d: got[d].where(got[d].notna(), None).map(lambda v: ("",) if v is None else v) for d in dims}), targets)
        mass = got["tokens"].to_numpy(dtype=float)
        scale = factor(weight, mass, None if budget_share is None else budget_share * mass.sum(), least_share * mass.sum())
        factors = {d: spark.createDataFrame([(None if v == ("",) else v, float(f)) for v, f in of.items()], "_v string, _f double") for d, of in found.items()}
    return {d: F.broadcast(f) if f.count() <= max_cells else f for d, f in factors.items()}, float(scale)


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the id only."""
    return F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)


def _drawn(docs: DataFrame, targets: dict, dims: dict[str, Column], id_col: str, text_col: str, budget_share, seed: int, max_cells: int, least_share: float) -> tuple[DataFrame, str]:
    """``docs`` with the dims, tokens, weight, probability and selected under a prefix of their own."""
    p = free_prefix(docs.columns)
    rows = docs.select(*docs.columns, *[c.cast("string").alias(p + d) for d, c in dims.items()], tokens(text_col).alias(p + "tokens"))
    flat = rows.select(*[F.col(p + d).alias(d) for d in dims], F.col(p + "tokens").alias("tokens"))
    factors, scale = calibrate(flat, {d: targets.get(d) for d in dims}, budget_share, max_cells, least_share)
    drawn, weight = rows, F.lit(1.0)
    for d, f in factors.items():
        drawn = drawn.join(f.select(F.col("_v").alias(f"{p}v_{d}"), F.col("_f").alias(f"{p}f_{d}")), F.col(p + d).eqNullSafe(F.col(f"{p}v_{d}")), "left")
        weight = weight * F.coalesce(F.col(f"{p}f_{d}"), F.lit(1.0))
    drawn = drawn.withColumn(p + "weight", weight).withColumn(p + "probability", F.least(F.lit(1.0), F.col(p + "weight") * F.lit(scale)))
    drawn = drawn.drop(*[f"{p}{x}_{d}" for d in dims for x in "vf"])
    return drawn.withColumn(p + "selected", draw(id_col, seed) < F.col(p + "probability")), p


#: Sources and topics are flattened, languages a little.
DEFAULT_TARGETS = {"source": flatten(0.5), "lang": flatten(0.8), "topic": flatten(0.9)}


def _dims(text_col: str) -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(text_col)}


def mix(docs: DataFrame, targets: dict = DEFAULT_TARGETS, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", budget_share: float | None = None, seed: int = 42, max_cells: int = 50_000, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: id, the dims, tokens, weight, probability, selected.

    ``dims`` are the marginals as columns of ``docs`` (source, lang and the topic
    of the text, if not given); ``targets`` has, for each, a map from value to
    share or a function of the observed shares.  Expected to be kept are
    ``budget_share`` of the tokens or, if not given, ``least_share`` at least.
    """
    dims = dims or _dims(text_col)
    drawn, p = _drawn(docs, targets, dims, id_col, text_col, budget_share, seed, max_cells, least_share)
    return drawn.select(F.col(id_col), *[F.col(p + c).alias(c) for c in [*dims, "tokens", "weight", "probability", "selected"]])


def survivors(docs: DataFrame, targets: dict = DEFAULT_TARGETS, dims: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", budget_share: float | None = None, seed: int = 42, max_cells: int = 50_000, least_share: float = LEAST_SHARE) -> DataFrame:
    """The drawn rows, all columns unchanged."""
    drawn, p = _drawn(docs, targets, dims or _dims(text_col), id_col, text_col, budget_share, seed, max_cells, least_share)
    return drawn.where(p + "selected").select(*docs.columns)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
