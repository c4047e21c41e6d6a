"""The tables behind reports: comparisons, bands, moving averages, marks and picks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rulewright.operators.ordered import histogram, number, running, stretch_cuts


def join_results(tables: dict[str, DataFrame], key: str = "dataset", value: str = "mean_test_score") -> DataFrame:
    """The value of each table, by the keys that all have."""
    return reduce(lambda a, b: a.join(b, key), [t.select(key, F.col(value).alias(name)) for name, t in tables.items()])


def key_difference(a: DataFrame, b: DataFrame, key: str = "dataset") -> DataFrame:
    """key and side: keys that just one of the tables has."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def best_or_tied(df: DataFrame, columns: Sequence[str], rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """name and wins of each column: in how many rows it is the largest, or within tolerance of it."""
    best = F.greatest(*columns)
    row = df.agg(*[F.count_if(F.abs(F.col(c) - best) <= atol + rtol * F.abs(best)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("wins")) for c in columns])).alias("e")).select("e.*")


def band(df: DataFrame, by: Sequence[str], value: str, top: int | None = None, decimals: int = 6) -> DataFrame:
    """mean and std of value in each group, of its `top` largest if given; ties by row order are alike in value."""
    if top is not None:
        df = df.withColumn("__k", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(value)))).where(F.col("__k") <= top)
    return df.groupBy(*by).agg(F.round(F.avg(value), decimals).alias("mean"), F.round(F.stddev_pop(value), decimals).alias("std"))


def _series(df: DataFrame, by: Sequence[str], order: str, value: str, result: str, work) -> DataFrame:
    """Rows that work(frame sorted by order) gives for each series: one run's epochs, in one task."""
    rows = df.select(*by, order, F.col(value).cast("double").alias("value"))
    names = [x.split(" ")[0] for x in result.split(", ")]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def each(frame):
        out = work(frame.sort_values(order, kind="stable"))
        for c in by:
            out[c] = frame[c].iloc[0]
        return out[[*by, *names]]

    return rows.groupBy(*by).applyInPandas(each, f"{kinds}, {result}")


def moving_average(df: DataFrame, by: Sequence[str], order: str, value: str, span: int = 15, decimals: int = 6) -> DataFrame:
    """The exponential moving average with share 2/(span+1), beginning with the first value."""

    def smooth(frame):
        return frame[[order]].assign(ema=frame["value"].ewm(span=span, adjust=False).mean())

    found = _series(df, by, order, value, f"{order} {df.schema[order].dataType.simpleString()}, ema double", smooth)
    return found.withColumn("ema", F.round("ema", decimals))


def regeneration_marks(df: DataFrame, by: Sequence[str], order: str, value: str, patience: int) -> DataFrame:
    """Where a series went `patience` steps without a new best; the best is forgotten there."""

    def marks(frame):
        best, stale, out = float("-inf"), 0, []
        for at, x in zip(frame[order], frame["value"], strict=True):
            best, stale = (x, 0) if x > best else (best, stale + 1)
            if stale == patience:
                out.append(at)
                best, stale = float("-inf"), 0
        return frame[frame[order].isin(out)][[order]].rename(columns={order: "mark"})

    return _series(df, by, order, value, "mark long", marks)


def rank_picks(df: DataFrame, key: str, value: str) -> DataFrame:
    """best, q3, median, q1 and worst row by value, of equals by key: places n-1, 3n//4, n//2, n//4 and 0 from below.

    Running sums find the values; only rows that share one of these are ranked by key.
    """
    counts = running(histogram(df, [value]), stretch_cuts(df, [value]))
    places = {"worst": F.lit(0), "q1": F.floor(F.col("tn") / 4), "median": F.floor(F.col("tn") / 2), "q3": F.floor(3 * F.col("tn") / 4), "best": F.col("tn") - 1}
    asked = F.array(*[F.struct(F.lit(p).alias("pick"), at.cast("long").alias("at")) for p, at in places.items()])
    met = counts.withColumn("p", F.explode(asked)).where((F.col("p.at") < F.col("cn")) & (F.col("p.at") >= F.col("cn") - F.col("n")))
    met = met.select("x", "p.pick", (F.col("p.at") - F.col("cn") + F.col("n") + 1).alias("place"))
    alike = df.select(key, value).join(F.broadcast(met.select("x").distinct()), number(value) == F.col("x"), "left_semi")
    ranked = alike.withColumn("k", F.row_number().over(W.partitionBy(value).orderBy(key)))
    return ranked.join(F.broadcast(met), (number(value) == F.col("x")) & (F.col("k") == F.col("place"))).select("pick", key, value)


def peak_epoch(df: DataFrame, by: Sequence[str], order: str = "epoch", value: str = "val_score") -> DataFrame:
    """The first epoch with the largest value of each group."""
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.max_by(order, F.struct(F.col(value), -F.col(order))).alias("peak"), F.max(value).alias("value"))


def top_children(df: DataFrame, n: int, child: str = "path", value: str = "train_score") -> DataFrame:
    """The n children with the largest best score."""
    return df.groupBy(child).agg(F.max(value).alias("peak")).orderBy(F.desc("peak"), child).limit(n)
