"""Label-aware bins: best-first decision trees on single columns, many columns and groups at once.

The running sums of a histogram score every boundary of a leaf in one aggregation, on Spark, whatever its size. Only
the chosen boundaries come to the driver, at most a few for each column of each group.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.operators.ordered import histogram, running, stretch_cuts


@dataclass(frozen=True)
class Leaf:
    """Values above low and up to high of one group's column; before: rows and positives below it, then its own."""

    key: tuple
    low: float
    high: float
    before_n: int
    before_pos: int
    n: int
    pos: int

    @property
    def mixed(self) -> bool:
        return 0 < self.pos < self.n

    def split(self, x: float, cn: int, cp: int) -> list[Leaf]:
        left = Leaf(self.key, self.low, x, self.before_n, self.before_pos, cn - self.before_n, cp - self.before_pos)
        return [left, Leaf(self.key, x, self.high, cn, cp, self.n - left.n, self.pos - left.pos)]


def impurity(n: Column, pos: Column) -> Column:
    """n times the Gini index."""
    return n - (pos * pos + (n - pos) * (n - pos)) / n


def _key_type(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def boundary_gains(counts: DataFrame, leaves: Sequence[Leaf], by: Sequence[str] = ()) -> DataFrame:
    """leaf, x, cn, cp and gain (the fall of impurity) of every boundary after a value x within a leaf."""
    keys = [*by, "col"]
    rows = [(k, *leaf.key, leaf.low, leaf.high, leaf.before_n, leaf.before_pos, leaf.n, leaf.pos) for k, leaf in enumerate(leaves)]
    table = counts.sparkSession.createDataFrame(rows, f"leaf int, {_key_type(counts, keys)}, above double, upto double, bn long, bp long, ln long, lp long")
    inside = counts.join(F.broadcast(table), keys).where("x > above and x <= upto and cn - bn < ln")
    n, pos = F.col("ln").cast("double"), F.col("lp").cast("double")
    left_n, left_pos = (F.col("cn") - F.col("bn")).cast("double"), (F.col("cp") - F.col("bp")).cast("double")
    gain = impurity(n, pos) - impurity(left_n, left_pos) - impurity(n - left_n, pos - left_pos)
    return inside.select("leaf", "x", "cn", "cp", gain.alias("gain"))


def roots(counts: DataFrame, by: Sequence[str] = ()) -> list[Leaf]:
    """A leaf with all values of each column of each group."""
    keys = [*by, "col"]
    rows = counts.groupBy(*keys).agg(F.max("tn").alias("n"), F.max("tp").alias("pos")).collect()
    return [Leaf(tuple(r[k] for k in keys), -np.inf, np.inf, 0, 0, r.n, r.pos) for r in rows]


def tree_thresholds(counts: DataFrame, bins: dict[str, int], by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """Thresholds of a tree for each column of each group, with at most bins[column] leaves, by key (by..., col).

    The leaf with the largest fall of impurity is split next, at the first of its best boundaries; thresholds lie midway
    between neighbouring values. Columns of one value, or with labels that are all alike, have none. counts: of running().
    """
    keys = [*by, "col"]
    every, heaps = roots(counts, by), {}
    chosen: dict[tuple, list[float]] = {leaf.key: [] for leaf in every}
    unscored, popped = [leaf for leaf in every if leaf.mixed], True
    while popped:
        if unscored:
            best = F.max_by(F.struct("x", "cn", "cp", "gain"), F.struct(F.col("gain"), -F.col("x")))
            for r in boundary_gains(counts, unscored, by).groupBy("leaf").agg(best.alias("b")).collect():  # a row a leaf
                leaf = unscored[r.leaf]
                heapq.heappush(heaps.setdefault(leaf.key, []), (-r.b.gain, leaf.low, r.leaf, leaf, r.b))
        unscored, popped = [], False
        for key, heap in heaps.items():
            room = bins[key[-1]] - 1 - len(chosen[key])
            if heap and room > 0:
                *_, leaf, at = heapq.heappop(heap)
                chosen[key].append(at.x)
                unscored += [half for half in leaf.split(at.x, at.cn, at.cp) if half.mixed and room > 1]
                popped = True
    points = [(*key, x) for key, xs in chosen.items() for x in xs]
    out = {key: [] for key in chosen}
    if points:
        table = counts.sparkSession.createDataFrame(points, f"{_key_type(counts, keys)}, at double")
        after = counts.join(F.broadcast(table), keys).where("x > at").groupBy(*keys, "at").agg(F.min("x").alias("next"))
        for r in after.collect():
            out[tuple(r[k] for k in keys)].append((r["at"] + r["next"]) / 2)
    return {key: sorted(v) for key, v in out.items()}


def tree_edges(df: DataFrame, bins: dict[str, int], label: str) -> dict[str, list[float]]:
    """Thresholds for at most bins[column] bins of each column; none for a constant column or a constant label."""
    if not bins:
        return {}
    counts = running(histogram(df, list(bins), label=label), stretch_cuts(df, list(bins))).persist()
    found = tree_thresholds(counts, bins)
    counts.unpersist()
    return {c: found.get((c,), []) for c in bins}
