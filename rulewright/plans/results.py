"""Summaries of experiments, as aggregations of a table with a row for each run and fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def generation_table(folds: DataFrame) -> DataFrame:
    """A row for each generation of each population."""
    return folds.select("run", "fold", F.explode("generations").alias("g")).select("run", "fold", "g.*")


def fold_metrics(generations: DataFrame) -> DataFrame:
    """best_val (null without any) and best_train of each fold, from rows run, fold, epoch, train_score, val_score."""
    return generations.groupBy("run", "fold").agg(F.max("val_score").alias("best_val"), F.max("train_score").alias("best_train"))


def best_folds(folds: DataFrame) -> DataFrame:
    """The fold of each run with the largest best_val, the first of equals; mean_val is 0 without any validation."""
    order = W.partitionBy("run").orderBy(F.desc_nulls_last("best_val"), "fold")
    mean = F.coalesce(F.avg("best_val").over(W.partitionBy("run")), F.lit(0.0))
    train = F.avg("best_train").over(W.partitionBy("run"))
    return folds.withColumn("mean_val", mean).withColumn("mean_train", train).withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the largest mean_val if any is above 0, else mean_train; the first of equals."""
    value = F.when(F.max("mean_val").over(W.partitionBy()) > 0, F.col("mean_val")).otherwise(F.col("mean_train"))
    return runs.withColumn("value", value).orderBy(F.desc("value"), "run").limit(1).drop("value")


def attributes(folds: DataFrame) -> DataFrame:
    """One row about an experiment, from its folds (run, fold, best_rule, best_val, best_train, test_score, val, test): scores of the
    runs' best folds in order of runs with mean and deviation (of the population), where the best one is, its rule, and confusion counts."""
    best = best_folds(folds)
    top = best_run(best).select(F.col("run").alias("best_run"), F.col("fold").alias("best_fold"), F.col("test_score").alias("best_test"), F.col("best_rule").alias("rule"))
    by_run = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("run", F.col(c).alias("v")))), lambda x: x["v"])
    aggs = []
    for name, c in (("train", "mean_train"), ("val", "mean_val"), ("test", "test_score")):
        aggs += [by_run(c).alias(f"{name}_scores"), F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std")]
    found = best.agg(*aggs, by_run("val").alias("val_counts"), by_run("test").alias("test_counts"), F.count("best_val").alias("validated"))
    return found.withColumn("val_mean", F.when(F.col("validated") > 0, F.col("val_mean"))).join(F.broadcast(top), F.lit(True))


def confusion_text(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """[TP: a, FP: b, FN: c, TN: d], or [] without counts."""
    return F.when(tp.isNull(), "[]").otherwise(F.format_string("[TP: %d, FP: %d, FN: %d, TN: %d]", tp, fp, fn, tn))


def statistics(df: DataFrame, value: str, by: Sequence[str] = (), decimals: int = 6) -> DataFrame:
    """mean, std (of the population), min, max, median, q1, q3, iqr of a column."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    grouped = df.groupBy(*by) if by else df
    raw = grouped.agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("q"))
    r = lambda c: F.round(c, decimals)
    return raw.select(*by, r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), "min", "max", r(F.col("q")[1]).alias("median"), r(F.col("q")[0]).alias("q1"), r(F.col("q")[2]).alias("q3"), r(F.col("q")[2] - F.col("q")[0]).alias("iqr"))
