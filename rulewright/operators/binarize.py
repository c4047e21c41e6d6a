"""Mixed columns to named boolean features.

Booleans pass, categories become one feature for each value, numbers one for each bin. Fitting counts values, in two
passes over the table and one for categories; applying a fitted model is one projection, so only the columns in use are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.operators.ordered import histogram, quantiles, running, stretch_cuts
from rulewright.operators.tree_bins import tree_edges

#: Edges are rounded to so many decimals, so that engines that interpolate differently agree.
EDGE_DECIMALS = 6
#: Values that the categories of a table may have together: each becomes a feature, and all of them go to the driver.
CATEGORIES = 100_000


@dataclass(frozen=True)
class Feature:
    """One boolean feature: where it comes from and what it is called."""

    index: int
    name: str
    source: str
    kind: str  # bool, category or bin
    low: float | None = None
    high: float | None = None
    category: str | None = None

    def column(self) -> Column:
        """True or false, never null: null values and unseen categories are false."""
        c = F.col(f"`{self.source}`")
        if self.kind == "bool":
            return F.coalesce(c, F.lit(False))
        if self.kind == "category":
            return F.coalesce(c == self.category, F.lit(False))
        x, tests = c.cast("double"), []
        if self.low != -np.inf:
            tests.append(x > self.low)
        if self.high != np.inf:
            tests.append(x <= self.high)
        test = tests[0] if tests else F.lit(True)
        for t in tests[1:]:
            test = test & t
        # NaN sorts above all numbers in Spark, but is in no bin.
        return F.coalesce(test & x.isNotNull() & ~F.isnan(x), F.lit(False))


@dataclass(frozen=True)
class BinarizerModel:
    """Fitted features over the columns that the model was fitted on."""

    columns: tuple[str, ...]
    features: tuple[Feature, ...]
    edges: dict = field(default_factory=dict)

    def names(self) -> dict[int, str]:
        return {f.index: f.name for f in self.features}

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """df's rows as f0, f1, ... after the columns to keep. The other columns must be those of the fit, in order."""
        if tuple(c for c in df.columns if c not in keep) != self.columns:
            raise RuntimeError("the columns differ from those that the binarizer was fitted on")
        return df.select(*[F.col(f"`{c}`") for c in keep], *[f.column().alias(f"f{f.index}") for f in self.features])

    def dictionary(self, spark) -> DataFrame:
        rows = [(f.index, f.name, f.source, f.kind, f.low, f.high, f.category) for f in self.features]
        return spark.createDataFrame(rows, "feature_id int, name string, source_col string, kind string, lo double, hi double, category string")


def bin_name(column: str, low: float, high: float, precision: int) -> str:
    """The label of a bin. Bins are open below and closed above, though labels read the other way."""
    if low == -np.inf:
        return f"{column} < {high:.{precision}f}"
    if high == np.inf:
        return f"{low:.{precision}f} <= {column}"
    return f"{low:.{precision}f} <= {column} < {high:.{precision}f}"


def unique_name(name: str, taken: set[str]) -> str:
    """name, or name with the first free number."""
    if name in taken:
        k = 0
        while f"{name}_{k}" in taken:
            k += 1
        name = f"{name}_{k}"
    taken.add(name)
    return name


def finish_edges(inner: list[float]) -> list[float]:
    """Edges from -inf to inf over the distinct inner ones."""
    return [-np.inf, *sorted({round(float(x), EDGE_DECIMALS) for x in inner}), np.inf]


def bin_shares(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def quantile_edges(df: DataFrame, bins: dict[str, int]) -> dict[str, list[float]]:
    """Edges at equal shares of each column's values, nulls and NaN left out; all columns at once.

    A column of at most one value has one bin. Ties give fewer bins.
    """
    if not bins:
        return {}
    counts = running(histogram(df, list(bins)), stretch_cuts(df, list(bins)))
    inner: dict[str, list[float]] = {c: [] for c in bins}
    for r in quantiles(counts, {c: bin_shares(n) for c, n in bins.items()}).collect():  # a row for each edge
        inner[r.col].append(r.edge)
    return {c: finish_edges(v) for c, v in inner.items()}


def category_values(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), most: int = CATEGORIES) -> dict[tuple, list]:
    """The distinct values of each column, sorted, by (by..., column); nulls have no feature. More than `most` in all are an error."""
    found: dict[tuple, list] = {}
    for c in columns:  # columns may have different types
        rows = df.select(*by, F.col(f"`{c}`").alias("value")).where("value is not null").distinct().limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"column {c!r} has more than {most} categories: group rare ones first")
        for r in rows:
            found.setdefault((*(r[k] for k in by), c), []).append(r["value"])
    return {k: sorted(v) for k, v in found.items()}


def feature_list(columns: list[str], edges: dict[str, list[float]], values: dict[str, list], precision: dict[str, int]) -> tuple[Feature, ...]:
    """The features of columns in order: of categories (values), of numbers (edges), else of booleans."""
    out: list[Feature] = []
    taken: set[str] = set()

    def add(name, source, kind, **more):
        out.append(Feature(len(out), unique_name(name, taken), source, kind, **more))

    for c in columns:
        if c in values:
            for v in values[c]:
                add(f"{c}={v}", c, "category", category=v)
        elif c in edges:
            for low, high in zip(edges[c][:-1], edges[c][1:], strict=True):
                add(bin_name(c, low, high, precision[c]), c, "bin", low=low, high=high)
        else:
            add(c, c, "bool")
    return tuple(out)


class Binarizer:
    """num_bins for numbers, column_strategy for those of a column, precision of bin labels, column_precision of a column's."""

    def __init__(self, num_bins: int = 5, column_strategy: dict[str, int] | None = None, precision: int = 3, column_precision: dict[str, int] | None = None):
        self.num_bins, self.precision = num_bins, precision
        self.column_strategy, self.column_precision = dict(column_strategy or {}), dict(column_precision or {})
        for what, value, least in [("num_bins", num_bins, 2), *[(f"column_strategy[{k!r}]", v, 2) for k, v in self.column_strategy.items()], ("precision", precision, 0), *[(f"column_precision[{k!r}]", v, 0) for k, v in self.column_precision.items()]]:
            if isinstance(value, bool) or not isinstance(value, int):
                raise TypeError(f"{what} must be an int")
            if value < least:
                raise ValueError(f"{what} must be at least {least}")

    def fit(self, df: DataFrame, label: str | None = None, categorical: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> BinarizerModel:
        """A model of df's columns but label and keep. With a label, bins of numbers follow it (tree splits); else quantiles.

        Strings must be declared categorical; other types are refused.
        """
        columns, numbers, declared = self.kinds(df, label, categorical, keep)
        edges = quantile_edges(df, numbers) if label is None else {c: finish_edges(e) for c, e in tree_edges(df, numbers, label).items()}
        seen = category_values(df, declared)
        values = {c: seen.get((c,), []) for c in declared}
        return BinarizerModel(tuple(columns), feature_list(columns, edges, values, self.precisions(numbers)), edges)

    def precisions(self, numbers) -> dict[str, int]:
        return {c: self.column_precision.get(c, self.precision) for c in numbers}

    def kinds(self, df: DataFrame, label: str | None, categorical: tuple[str, ...], keep: tuple[str, ...]) -> tuple[list[str], dict[str, int], tuple[str, ...]]:
        """df's feature columns, the bins of those that are numbers, and those that are categories. Other types than these and booleans are refused."""
        columns = [c for c in df.columns if c != label and c not in keep]
        types = {c: df.schema[c].dataType for c in columns}
        for c, kind in types.items():
            if c not in categorical and not isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
                raise ValueError(f"column {c!r} of type {kind.simpleString()} is not supported: declare it categorical or cast it")
        numbers = {c: self.column_strategy.get(c, self.num_bins) for c, k in types.items() if c not in categorical and not isinstance(k, T.BooleanType)}
        return columns, numbers, tuple(c for c in columns if c in categorical)

    def fit_transform(self, df: DataFrame, label: str | None = None, categorical: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> tuple[DataFrame, BinarizerModel]:
        model = self.fit(df, label, categorical, keep)
        kept = tuple(c for c in df.columns if c in keep or c == label)
        return model.transform(df, kept), model
