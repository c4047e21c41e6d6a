"""Ordered counts: histograms of columns with running sums, and what follows from them.

No task sees a whole column and nothing depends on its size: values are counted, cut into stretches of the value range,
and summed within each; what comes before a stretch is added from one row for each stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Stretches that a column's values are dealt out to.
STRETCHES = 64


def number(column: str) -> Column:
    """A column as a double, NaN as null."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def stretch_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, list[float]]:
    """Values that cut each column into stretches of about the same number of rows. Which ones they are changes no result."""
    shares = F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)])
    row = df.agg(*[F.percentile_approx(number(c), shares, 1000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: sorted(set(row[f"c{i}"] or [])) for i, c in enumerate(columns)}


def histogram_cuts(hist: DataFrame) -> dict[str, list[float]]:
    """The same from a histogram that is held, by its distinct values."""
    shares = F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)])
    return {r.col: sorted(set(r.cuts)) for r in hist.groupBy("col").agg(F.percentile_approx("x", shares, 1000).alias("cuts")).collect()}


def histogram(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """by, col, x, n and pos: rows of each value of each column, and those with a true label. Nulls and NaN are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), number(c).alias("x")) for c in columns])
    y = F.col(f"`{label}`").cast("boolean") if label else F.lit(False)
    each = df.select(*by, F.explode(pairs).alias("e"), y.alias("y")).select(*by, "e.col", "e.x", "y").where("x is not null")
    return each.groupBy(*by, "col", "x").agg(F.count("*").alias("n"), F.count_if("y").alias("pos"))


def _place(cuts: list[float], first: int = 0) -> Column:
    """How many of the sorted cuts are below x, by halving."""
    if not cuts:
        return F.lit(first)
    mid = len(cuts) // 2
    return F.when(F.col("x") <= cuts[mid], _place(cuts[:mid], first)).otherwise(_place(cuts[mid + 1 :], first + mid + 1))


def running(hist: DataFrame, cuts: dict[str, list[float]], by: Sequence[str] = ()) -> DataFrame:
    """hist with cn and cp (n and pos of all values up to x), tn and tp (of all), low and high (the extreme values)."""
    keys, stretch = [*by, "col"], F.lit(0)
    for c, at in cuts.items():
        stretch = F.when(F.col("col") == c, _place(at)).otherwise(stretch)
    marked = hist.withColumn("stretch", stretch)
    sums = marked.groupBy(*keys, "stretch").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp"), F.min("x").alias("low"), F.max("x").alias("high"))
    everything = W.partitionBy(*keys)  # a row for each stretch
    earlier = everything.orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sofar = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("sn", "bn"), ("sp", "bp"))]
    total = [F.sum("sn").over(everything).alias("tn"), F.sum("sp").over(everything).alias("tp"), F.min("low").over(everything).alias("low"), F.max("high").over(everything).alias("high")]
    joined = marked.join(sums.select(*keys, "stretch", *sofar, *total), [*keys, "stretch"])
    upto = W.partitionBy(*keys, "stretch").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    return joined.select(*keys, "x", "n", "pos", (F.col("bn") + F.sum("n").over(upto)).alias("cn"), (F.col("bp") + F.sum("pos").over(upto)).alias("cp"), "tn", "tp", "low", "high")


def quantiles(counts: DataFrame, shares: dict[str, Sequence[float]], by: Sequence[str] = ()) -> DataFrame:
    """by, col, i and edge: the i-th share's quantile of each column, midway as its rank lies between two values' ranks.

    A column of one value has none. counts: of running().
    """
    rows = [(c, i, float(q)) for c, qs in shares.items() for i, q in enumerate(qs)]
    wanted = counts.sparkSession.createDataFrame(rows, "col string, i int, share double")
    rank = (F.col("tn") - 1) * F.col("share")
    first = F.floor(rank)
    met = counts.where("low < high").join(F.broadcast(wanted), "col").where((F.col("cn") - F.col("n") <= first + 1) & (F.col("cn") > first))
    ends = met.groupBy(*by, "col", "i").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max(rank - first).alias("part"))
    return ends.select(*by, "col", "i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("edge"))
