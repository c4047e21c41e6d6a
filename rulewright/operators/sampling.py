"""Slices of the data for child populations: of features, of rows, or of both."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.operators.scoring import Matrix


@dataclass(frozen=True)
class Sample:
    """A child's data, where it comes from, and the parent's number of each of its features."""

    matrix: Matrix
    features: np.ndarray
    rows: np.ndarray
    mapping: dict[int, int]


def allocate(size: int, total: int, children: int, replace: bool, rng: np.random.Generator) -> list[np.ndarray]:
    """`size` of `total` numbers for each child: all of them if there are no more; disjoint if asked for and possible; else drawn apart."""
    if size >= total:
        return [np.arange(total) for _ in range(children)]
    if not replace and size * children <= total:
        order = rng.permutation(total)
        return [np.sort(order[k * size : (k + 1) * size]) for k in range(children)]
    return [np.sort(rng.choice(total, size, replace=False)) for _ in range(children)]


class Sampling:
    """Shares of features and of rows that each child gets, at least two of either; None for all."""

    def __init__(self, feature_fraction: float | None = None, sample_fraction: float | None = None, replace: bool = False):
        for what, value in (("feature_fraction", feature_fraction), ("sample_fraction", sample_fraction)):
            if value is not None and not isinstance(value, float):
                raise TypeError(f"{what} must be a float")
            if value is not None and not 0 < value <= 1:
                raise ValueError(f"{what} must be in (0, 1]")
        if feature_fraction is None and sample_fraction is None:
            raise ValueError("a fraction of features, of rows, or both")
        self.feature_fraction, self.sample_fraction, self.replace = feature_fraction, sample_fraction, replace

    def sample(self, matrix: Matrix, children: int, rng: np.random.Generator) -> list[Sample]:
        rows, features = matrix.data.shape
        size = lambda share, total: total if share is None else max(2, math.ceil(total * share))
        f = allocate(size(self.feature_fraction, features), features, children, self.replace, rng)
        r = allocate(size(self.sample_fraction, rows), rows, children, self.replace, rng)
        return [Sample(matrix.take(b, a), a, b, {k: int(x) for k, x in enumerate(a)}) for a, b in zip(f, r, strict=True)]


def FeatureSampling(feature_fraction: float, replace: bool = False) -> Sampling:  # noqa: N802
    return Sampling(feature_fraction, None, replace)


def InstanceSampling(sample_fraction: float, replace: bool = False) -> Sampling:  # noqa: N802
    return Sampling(None, sample_fraction, replace)


def CombinedSampling(feature_fraction: float, sample_fraction: float, replace: bool = False) -> Sampling:  # noqa: N802
    return Sampling(feature_fraction, sample_fraction, replace)


def hash_order(key: str, seed: int | Column) -> Column:
    """An order of rows that looks random and is the same in any engine. seed: a number, or a column of strings."""
    head = F.concat(seed, F.lit("|")) if isinstance(seed, Column) else F.lit(f"{seed}|")
    return F.md5(F.concat(head, F.col(f"`{key}`").cast("string")).cast("binary"))


def stratified_rank(df: DataFrame, key: str, label: str, seed: int | str, by: Sequence[str] = ()) -> DataFrame:
    """df with rank (from 1, in hash order within its label, and group if by is given) and total (rows of that label).

    No task sorts a whole label: rows are ranked within 4096 stretches of the hash, and each stretch knows how many rows
    come before it. seed: a number, or a column that has one.
    """
    marked = df.withColumn("__h", hash_order(key, seed)).withColumn("__s", F.substring("__h", 1, 3))
    parts = [*by, label]
    counts = marked.groupBy(*parts, "__s").agg(F.count("*").alias("__n"))
    place = W.partitionBy(*parts)
    so_far = F.sum("__n").over(place.orderBy("__s").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")
    before = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(parts)], F.col("__s").alias("__t"), so_far.alias("__b"), F.sum("__n").over(place).alias("total"))
    same = marked["__s"] == before["__t"]
    for i, c in enumerate(parts):
        same = same & marked[c].eqNullSafe(before[f"__k{i}"])
    # At most 4096 rows for each of two labels of a group; Spark broadcasts them if that is small.
    joined = marked.join(before, same)
    rank = F.row_number().over(W.partitionBy(*parts, "__s").orderBy("__h", key)) + F.col("__b")
    return joined.withColumn("rank", rank).select(*df.columns, "rank", "total")


def instance_partition(df: DataFrame, key: str, size: int, children: int, seed: int = 0) -> DataFrame:
    """df with child (0, 1, ...): disjoint parts of exactly `size` rows in hash order; other rows are left out. key must be unique."""
    ranked = stratified_rank(df.withColumn("__all", F.lit(True)), key, "__all", seed)
    return ranked.where(F.col("rank") <= size * children).select(*df.columns, F.floor((F.col("rank") - 1) / size).cast("int").alias("child"))


def feature_subset(features: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The first `size` rows of a feature dictionary in hash order, and their new numbers."""
    ranked = features.withColumn("__h", hash_order("feature_id", seed)).orderBy("__h", "feature_id").limit(size)
    return ranked.withColumn("child_feature", (F.row_number().over(W.orderBy("feature_id")) - 1).cast("int")).drop("__h")
