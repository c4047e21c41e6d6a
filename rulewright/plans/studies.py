"""Studies: objectives and attributes of trials, many data sets at once, baselines on the same folds, timings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions.rules import parse
from rulewright.operators.scoring import LABEL, confusion_columns, f1_column
from rulewright.plans.configs import ExperimentConfig, validate_experiment
from rulewright.plans.experiment import mark_runs, run_experiment
from rulewright.plans.results import attributes
from rulewright.plans.search import to_config


def objective(df: DataFrame, key: str, label: str, categorical: tuple[str, ...] = (), artifacts: str | None = None, **limits) -> Callable[[dict], tuple[float, dict]]:
    """For search(): the mean validation score over an experiment's runs, and the trial's attributes.

    limits: of to_config() (epochs, num_runs, n_folds, base_seed). artifacts: a folder for each trial's table of folds.
    A trial without any validation score is an error, so that search() prunes it.
    """
    made = 0

    def run(params: dict) -> tuple[float, dict]:
        nonlocal made
        folds = run_experiment(df, key, label, to_config(params, **limits), categorical).persist()
        told = attributes(folds).first().asDict(recursive=True)
        if artifacts is not None:
            folds.write.mode("overwrite").parquet(f"{artifacts}/trial={made}")
        made += 1
        folds.unpersist()
        if told["val_mean"] is None:
            raise ValueError("no fold was validated")
        told["complexity"] = len(parse(told["rule"]))
        return told["val_mean"], told

    return run


def fan_out(tables: dict[str, DataFrame], work: Callable[[str, DataFrame], float], at_once: int = 4) -> DataFrame:
    """dataset, mean_test_score and error of each table. The driver starts several at a time; their jobs share the cluster.

    A table whose work fails has its error and no score; the others go on.
    """
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession

    def one(name: str) -> tuple:
        try:
            return name, float(work(name, tables[name])), None
        except Exception as e:  # whatever it is, it is one data set's
            return name, None, f"{type(e).__name__}: {e}"[:500]

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, tables))
    return spark.createDataFrame(rows, "dataset string, mean_test_score double, error string")


def decision_tree_scores(df: DataFrame, key: str, label: str, config: ExperimentConfig, categorical: tuple[str, ...] = (), max_depth: int = 5) -> DataFrame:
    """run, fold, tp, fp, fn, tn and f1 on the test rows of Spark's decision tree, trained on the folds that run_experiment() has.

    Null numbers are 0 and null or new categories a category of their own, since the tree takes no nulls.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    validate_experiment(config)
    labelled = df.withColumn(LABEL, F.col(f"`{label}`").cast("boolean"))
    labelled = labelled.drop(label) if label != LABEL else labelled
    columns = [c for c in labelled.columns if c not in (key, LABEL)]
    plain = [F.col(f"`{c}`").cast("string") if c in categorical else F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in columns]
    marked = mark_runs(labelled, key, config)
    rows = marked.select("run", "test", "fold", F.col(LABEL), F.col(LABEL).cast("double").alias("y"), *[x.alias(f"x{i}") for i, x in enumerate(plain)]).persist()
    named = [i for i, c in enumerate(columns) if c in categorical]
    inputs = [f"i{i}" if i in named else f"x{i}" for i in range(len(columns))]
    stages = [StringIndexer(inputCol=f"x{i}", outputCol=f"i{i}", handleInvalid="keep") for i in named]
    tree = DecisionTreeClassifier(labelCol="y", featuresCol="x", maxDepth=max_depth, maxBins=256, seed=config.base_seed)
    pipeline = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="x"), tree])
    out = None
    for run in range(config.num_runs):
        for fold in range(config.n_folds):
            mine = rows.where(F.col("run") == run)
            model = pipeline.fit(mine.where(~F.col("test") & (F.col("fold") != fold)))
            counts = model.transform(mine.where("test")).agg(*[c.alias(n) for n, c in confusion_columns(F.col("prediction") == 1.0, F.col(LABEL)).items()])
            one = counts.select(F.lit(run).alias("run"), F.lit(fold).alias("fold"), "*", f1_column(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))
            out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Timings:
    """How often steps ran, and how long: in all, and without the steps within them."""

    clock: Callable[[], float] = time.perf_counter
    rows: dict[str, list] = field(default_factory=dict)
    inner: list[float] = field(default_factory=list)

    @contextmanager
    def step(self, name: str) -> Iterator[None]:
        began = self.clock()
        self.inner.append(0.0)
        try:
            yield
        finally:
            took, within = self.clock() - began, self.inner.pop()
            if self.inner:
                self.inner[-1] += took
            row = self.rows.setdefault(name, [0, 0.0, 0.0])
            row[0], row[1], row[2] = row[0] + 1, row[1] + took - within, row[2] + took

    def watch(self, thing, *names: str):
        """thing, whose methods of these names are timed from now on."""
        for name in names:
            method, said = getattr(thing, name), f"{type(thing).__name__}.{name}"

            def timed(*args, _method=method, _said=said, **kwargs):
                with self.step(_said):
                    return _method(*args, **kwargs)

            setattr(thing, name, timed)
        return thing

    def table(self, spark: SparkSession) -> DataFrame:
        """step, calls, own, elapsed and per_call (own) in seconds; the largest own time first."""
        kind = T.StructType([T.StructField("step", T.StringType()), T.StructField("calls", T.LongType()), T.StructField("own", T.DoubleType()), T.StructField("elapsed", T.DoubleType())])
        rows = spark.createDataFrame([(n, *r) for n, r in self.rows.items()], kind)
        return rows.withColumn("per_call", F.col("own") / F.col("calls")).orderBy(F.desc("own"), "step")


def profile_training(matrix, config, rng) -> Timings:
    """Timings of the phases of an evolution over config.epochs."""
    from rulewright.plans.evolve import Evolution

    timings = Timings()
    with timings.step("construct"):
        evolution = Evolution(matrix, config.evolution, rng)
    timings.watch(evolution, "step", "vary", "score", "settle")
    for _ in range(config.epochs):
        evolution.step()
    return timings
