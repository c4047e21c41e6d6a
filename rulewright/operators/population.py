"""First rules of a population: random ones, best single literals, and mixtures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.functions.rules import OPERATORS, Lit, Rule, is_operator_type
from rulewright.operators.scoring import LABEL, WEIGHT, Matrix, f1_column, feature_columns, score_rule


class Strategy(Protocol):
    """Makes n rules over `data` with the random generator."""

    def generate(self, n: int, data: Matrix, rng: np.random.Generator, score="f1") -> list[Rule]: ...


class RandomStrategy:
    """A random operator over two different literals, each node negated by the toss of a coin."""

    def __init__(self, operator_types: Sequence[type] = OPERATORS):
        if not operator_types or not all(map(is_operator_type, operator_types)):
            raise ValueError("operator_types must be operators")
        self.operator_types = tuple(operator_types)

    def generate(self, n, data, rng, score="f1"):
        features = data.data.shape[1]
        if features < 2:
            raise ValueError("random rules need two features")
        kinds, tossed = rng.integers(len(self.operator_types), size=n), rng.random((n, 3)) < 0.5
        left = rng.integers(features, size=n)
        right = (left + 1 + rng.integers(features - 1, size=n)) % features
        return [self.operator_types[k]((Lit(int(a), bool(t[0])), Lit(int(b), bool(t[1]))), bool(t[2])) for k, a, b, t in zip(kinds, left, right, tossed, strict=True)]


def resolve_size(size: int | float | None, total: int, what: str) -> int:
    """None: all; an int: so many; a float: that share, rounded up."""
    if size is None:
        return total
    if isinstance(size, bool) or not isinstance(size, (int, float)):
        raise TypeError(f"{what} must be None, an int or a float")
    if isinstance(size, float):
        if not 0 < size <= 1:
            raise ValueError(f"{what} as a share must be in (0, 1]")
        return math.ceil(size * total)
    if not 1 <= size <= total:
        raise ValueError(f"{what} must be between 1 and {total}")
    return size


class BestLiteralStrategy:
    """The best literal on random rows and features; the first feature, not negated, of equals."""

    def __init__(self, sample_size: int | float | None = None, feature_size: int | float | None = None):
        self.sample_size, self.feature_size = sample_size, feature_size

    def generate(self, n, data, rng, score="f1"):
        rows, features = len(data), data.data.shape[1]
        k, m = resolve_size(self.sample_size, rows, "sample_size"), resolve_size(self.feature_size, features, "feature_size")
        out = []
        for _ in range(n):
            # Weights are a column of the data, so they are taken along with the rows.
            part = data if k == rows else data.take(np.sort(rng.choice(rows, k, replace=False)))
            chosen = np.arange(features) if m == features else np.sort(rng.choice(features, m, replace=False))
            out.append(max((Lit(int(f), neg) for f in chosen for neg in (False, True)), key=lambda r: score_rule(r, part, score)))
        return out


def literal_scores(df: DataFrame) -> DataFrame:
    """feature, negated, tp, fp, fn, tn, f1 of every literal, by one aggregation over a table of any size."""
    names = feature_columns(df)
    w = F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1).cast("long")
    total = lambda test: F.coalesce(F.sum(F.when(test, w)), F.lit(0)).cast("long")
    aggs = [F.struct(total(F.col(n) & F.col(LABEL)).alias("tp"), total(F.col(n)).alias("pp")).alias(n) for n in names]
    row = df.agg(total(F.col(LABEL)).alias("ap"), total(F.lit(True)).alias("all"), F.array(*aggs).alias("each"))
    each = row.select("ap", "all", F.posexplode("each").alias("feature", "e")).select("ap", "all", "feature", "e.*")
    both = each.select("feature", F.explode(F.array(F.struct(F.lit(False).alias("negated"), F.col("tp").alias("tp"), (F.col("pp") - F.col("tp")).alias("fp")), F.struct(F.lit(True).alias("negated"), (F.col("ap") - F.col("tp")).alias("tp"), (F.col("all") - F.col("ap") - F.col("pp") + F.col("tp")).alias("fp")))).alias("e"), "ap", "all").select("feature", "e.*", "ap", "all")
    counts = both.select("feature", "negated", "tp", "fp", (F.col("ap") - F.col("tp")).alias("fn"), (F.col("all") - F.col("ap") - F.col("fp")).alias("tn"))
    return counts.withColumn("f1", f1_column(F.col("tp"), F.col("fp"), F.col("fn")))


def best_literal(df: DataFrame) -> DataFrame:
    """The one best row of literal_scores()."""
    # Two rows a feature: small enough for one window.
    ranked = literal_scores(df).withColumn("rank", F.row_number().over(W.orderBy(F.desc("f1"), "feature", "negated")))
    return ranked.where("rank = 1").drop("rank")


class PopulationGenerator:
    """Rules from several strategies; how many from each is drawn once, by the weights."""

    def __init__(self, strategies: Sequence[Strategy], population_size: int = 100, weights: Sequence[float] | None = None, rng: np.random.Generator | None = None):
        if not strategies:
            raise ValueError("at least one strategy")
        if isinstance(population_size, bool) or not isinstance(population_size, int) or population_size < 1:
            raise ValueError("population_size must be a positive int")
        share = np.full(len(strategies), 1.0) if weights is None else np.asarray(weights, float)
        if len(share) != len(strategies) or (share < 0).any() or not share.sum():
            raise ValueError("a weight of at least 0 for each strategy, not all 0")
        self.strategies, self.size = list(strategies), population_size
        self.rng = rng or np.random.default_rng()
        self.counts = self.rng.multinomial(population_size, share / share.sum())

    def generate(self, data: Matrix, score="f1") -> list[Rule]:
        return [r for s, n in zip(self.strategies, self.counts, strict=True) if n for r in s.generate(int(n), data, self.rng, score)]
