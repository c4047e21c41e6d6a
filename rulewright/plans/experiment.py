"""Runs of stratified splits and folds: fit bins on the training part, train there, test the best fold's rule.

All runs and folds are prepared at once: rows are marked with run and fold, one histogram has every fold's values, and one
aggregation compresses every fold's parts. Each run and fold then trains in a task of its own, or on Spark if it is too
large for one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions.rules import Rule, parse
from rulewright.operators import scoring
from rulewright.operators.binarize import Binarizer, bin_shares, category_values, feature_list, finish_edges
from rulewright.operators.ordered import histogram, histogram_cuts, number, quantiles, running
from rulewright.operators.sampling import stratified_rank
from rulewright.operators.scoring import COUNT_SCORES, LABEL, WEIGHT, Matrix, Scorer, compress, confusion_matrix, prepare, score_rule
from rulewright.operators.tree_bins import tree_thresholds
from rulewright.plans.configs import ExperimentConfig, TrainerConfig, validate_experiment, validate_trainer
from rulewright.plans.evolve import Evolution

TRAIN, VAL, TEST = 0, 1, 2


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.2, seed: int = 0) -> DataFrame:
    """df with test (boolean): of each label the first rows in hash order, their share rounded up."""
    ranked = stratified_rank(df, key, label, seed)
    return ranked.select(*df.columns, (F.col("rank") <= F.ceil(F.round(F.col("total") * test_size, 6))).alias("test"))


def stratified_folds(df: DataFrame, key: str, label: str, n_folds: int = 5, seed: int = 0) -> DataFrame:
    """df with fold (0, 1, ...): of each label every n-th row in hash order."""
    return stratified_rank(df, key, label, seed).select(*df.columns, ((F.col("rank") - 1) % n_folds).cast("int").alias("fold"))


@dataclass
class History:
    """What training gave: the best rule, confusion counts on the training and validation data, all generations."""

    best_rule: Rule
    train: tuple
    val: tuple | None
    generations: list

    def __len__(self) -> int:
        return len(self.generations)

    def best_val(self) -> float | None:
        return max((g.val_score for g in self.generations if g.val_score is not None), default=None)

    def best_train(self) -> float:
        return max(max(g.train_scores) for g in self.generations)


def train(data: Matrix, config: TrainerConfig, rng: np.random.Generator, val: Matrix | DataFrame | None = None, scorer: Scorer | None = None, tell: Callable[[int, object], None] | None = None) -> History:
    """Evolves for config.epochs; the best rule so far is validated every val_every epochs and after the last.

    val: rows in memory, or a table that is scored on Spark. tell: called after each epoch with its number and record.
    """
    validate_trainer(config)
    evolution = Evolution(data, config.evolution, rng, scorer)
    score = config.val_score or config.evolution.score
    held = prepare(val, score) if isinstance(val, Matrix) else None
    judge = (lambda: evolution.evaluate_best(held, score)) if held is not None else (lambda: float(Scorer(val, score)([evolution.best])[0]))
    generations = []
    for epoch in range(config.epochs):
        generations.append(evolution.step())
        if val is not None and ((epoch + 1) % config.val_every == 0 or epoch + 1 == config.epochs):
            generations[-1].val_score = judge()
        if tell is not None:
            tell(epoch, generations[-1])
    count = lambda m: m and confusion_matrix(evolution.best.evaluate(m.data), m.label, m.weight)
    return History(evolution.best, count(evolution.matrix), count(held), generations)


GENERATION = "path string, epoch int, best_idx int, best_rule string, train_scores array<double>, complexities array<int>, val_score double"
FOLD = f"run int, fold int, best_rule string, rule_names string, best_val double, best_train double, train array<long>, val array<long>, test_score double, test array<long>, generations array<struct<{', '.join(f.replace(' ', ':', 1) for f in GENERATION.split(', '))}>>"


@dataclass
class Progress:
    """How many tasks and epochs are done, as seen on the driver. Workers report when they finish a run and fold."""

    spark: object
    total: int = 0
    epochs: object = field(init=False)
    done: object = field(init=False)

    def __post_init__(self):
        self.epochs, self.done = self.spark.sparkContext.accumulator(0), self.spark.sparkContext.accumulator(0)

    def __str__(self) -> str:
        return f"{self.done.value} of {self.total} folds, {self.epochs.value} epochs"


def mark_runs(df: DataFrame, key: str, config: ExperimentConfig) -> DataFrame:
    """df's rows for each run: run, test and fold (null for test rows). key must be unique."""
    seeds = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(str(config.base_seed + r)).alias("seed")) for r in range(config.num_runs)])
    each = df.withColumn("__r", F.explode(seeds)).withColumn("run", F.col("__r.run")).withColumn("__seed", F.col("__r.seed")).drop("__r")
    ranked = stratified_rank(each, key, LABEL, F.col("__seed"), ("run",))
    test = F.ceil(F.round(F.col("total") * config.test_size, 6))
    place = F.col("rank") - test  # of the rows that are left, in the same order
    fold = F.when(place > 0, ((place - 1) % config.n_folds).cast("int"))
    return ranked.select(*df.columns, "run", (place <= 0).alias("test"), fold.alias("fold"))


def _other_folds(n_folds: int):
    """The fits that train on a row: every fold's but its own."""
    return F.explode(F.expr(f"filter(sequence(0, {n_folds - 1}), f -> f != fold)")).alias("fit")


def fit_folds(rows: DataFrame, columns: list[str], numbers: dict[str, int], declared: tuple[str, ...], supervised: bool, n_folds: int) -> tuple[dict, dict]:
    """Inner edges and categories of every fold's training rows, by (run, fit, column). rows: of mark_runs()."""
    keys, training = ("run", "fit"), rows.where("not test")
    seen: dict[tuple, list] = {}
    for (run, fold, c), values in category_values(training, declared, ("run", "fold")).items():
        for fit in range(n_folds):
            if fit != fold:
                seen.setdefault((run, fit, c), set()).update(values)
    edges: dict[tuple, list[float]] = {}
    if numbers:
        counted = histogram(training, list(numbers), ("run", "fold"), LABEL).persist()
        each = counted.select("run", _other_folds(n_folds), "col", "x", "n", "pos")
        merged = each.groupBy(*keys, "col", "x").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        counts = running(merged, histogram_cuts(counted), keys).persist()
        if supervised:
            edges = tree_thresholds(counts, numbers, keys)
        else:
            for r in quantiles(counts, {c: bin_shares(n) for c, n in numbers.items()}, keys).collect():
                edges.setdefault((r.run, r.fit, r.col), []).append(r.edge)
        counts.unpersist()
        counted.unpersist()
    return edges, {k: sorted(v) for k, v in seen.items()}


@dataclass(frozen=True)
class Fold:
    """What a task has to know: its run and fold, the features' names, and for each column how many of them it became (0: a boolean)."""

    run: int
    fold: int
    names: dict[int, str]
    widths: tuple[int, ...]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Boolean features of rows of codes: the place of a value's bin or category, -1 for none."""
        parts = [codes[:, [i]] == (np.arange(w) if w else 1) for i, w in enumerate(self.widths)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(codes), 0), bool)

    def table(self, rows: DataFrame) -> DataFrame:
        """The same on Spark: f0, f1, ..., label and w."""
        tests = [F.col("codes")[i] == k for i, w in enumerate(self.widths) for k in (range(w) if w else [1])]
        return rows.select(*[t.alias(f"f{k}") for k, t in enumerate(tests)], LABEL, WEIGHT)


def prepare_folds(rows: DataFrame, config: ExperimentConfig, columns: list[str], categorical: tuple[str, ...]) -> tuple[list[Fold], DataFrame]:
    """Every run's folds, and their compressed rows: task, part, label, codes, w. rows: of mark_runs(), without the key."""
    if config.binarizer is not None:
        return _prepared_by(config.binarizer, rows, config, columns, categorical)
    spark, binarizer = rows.sparkSession, Binarizer(config.num_bins)
    _, numbers, declared = binarizer.kinds(rows.select(*columns, LABEL), LABEL, categorical, ())
    edges, seen = fit_folds(rows, columns, numbers, declared, config.supervised, config.n_folds)
    folds, fitted = [], []
    for run in range(config.num_runs):
        for fit in range(config.n_folds):
            inner = {c: finish_edges(edges.get((run, fit, c), [])) for c in numbers}
            values = {c: seen.get((run, fit, c), []) for c in declared}
            names = {f.index: f.name for f in feature_list(columns, inner, values, binarizer.precisions(numbers))}
            folds.append(Fold(run, fit, names, tuple(len(inner[c]) - 1 if c in inner else len(values[c]) if c in values else 0 for c in columns)))
            fitted.append((len(fitted), run, fit, [inner[c][1:-1] for c in numbers], *[values[c] for c in declared]))
    kinds = "".join(f", v{i} array<{rows.schema[c].dataType.simpleString()}>" for i, c in enumerate(declared))
    table = spark.createDataFrame(fitted, f"task int, of int, fit int, edges array<array<double>>{kinds}")

    def code(c: str):
        if c in numbers:
            below = F.size(F.filter(F.col("edges")[list(numbers).index(c)], lambda e: e < F.col(f"__x{list(numbers).index(c)}")))
            return F.when(F.col(f"__x{list(numbers).index(c)}").isNull(), -1).otherwise(below)
        if c in declared:
            return F.coalesce(F.array_position(f"v{declared.index(c)}", F.col(f"`{c}`")).cast("int") - 1, F.lit(-1))
        return F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("int")

    # One row for each run and fold.
    joined = rows.withColumns({f"__x{i}": number(c) for i, c in enumerate(numbers)}).join(F.broadcast(table), F.col("run") == F.col("of"))
    part = F.when(F.col("test"), TEST).when(F.col("fold") == F.col("fit"), VAL).otherwise(TRAIN)
    coded = joined.select("task", part.alias("part"), LABEL, F.array(*map(code, columns)).cast("array<int>").alias("codes"))
    return folds, coded.groupBy("task", "part", LABEL, "codes").agg(F.count("*").alias(WEIGHT))


def _prepared_by(binarizer, rows: DataFrame, config: ExperimentConfig, columns: list[str], categorical: tuple[str, ...]) -> tuple[list[Fold], DataFrame]:
    """prepare_folds() with a binarizer of the caller's own, which has to be fitted to each fold by itself."""
    folds, out = [], None
    for run in range(config.num_runs):
        mine = rows.where(F.col("run") == run)
        for fit in range(config.n_folds):
            training = mine.where(~F.col("test") & (F.col("fold") != fit)).select(*columns, LABEL)
            model = binarizer.fit(training, LABEL if config.supervised else None, categorical, (LABEL,))
            names = dict(model.names())
            folds.append(Fold(run, fit, names, (0,) * len(names)))
            for part, test in ((TRAIN, ~F.col("test") & (F.col("fold") != fit)), (VAL, ~F.col("test") & (F.col("fold") == fit)), (TEST, F.col("test"))):
                bits = compress(model.transform(mine.where(test).select(*columns, LABEL), (LABEL,)))
                codes = F.array(*[F.col(f"f{k}").cast("int") for k in range(len(names))])
                one = bits.select(F.lit(len(folds) - 1).alias("task"), F.lit(part).alias("part"), LABEL, codes.alias("codes"), WEIGHT)
                out = one if out is None else out.unionByName(one)
    return folds, out


def _told(fold: Fold, history: History, test: tuple, score: float) -> tuple:
    rule = history.best_rule
    told = [(g.path, g.epoch, g.best_index, g.best_rule, g.train_scores, g.complexities, g.val_score) for top in history.generations for g in top.flat()]
    return fold.run, fold.fold, str(rule), rule.to_str(fold.names), history.best_val(), history.best_train(), list(history.train), list(history.val), score, list(test), told


def train_fold(fold: Fold, parts: Sequence[Matrix], config: ExperimentConfig) -> tuple:
    """The FOLD row of one run and fold, from its training, validation and test rows in memory."""
    history = train(parts[TRAIN], config.trainer, np.random.default_rng([config.base_seed, fold.run, fold.fold]), parts[VAL])
    rule, test = history.best_rule, parts[TEST]
    score = score_rule(rule, test, config.trainer.val_score or config.trainer.evolution.score)
    return _told(fold, history, confusion_matrix(rule.evaluate(test.data), test.label, test.weight), score)


def train_fold_on_spark(fold: Fold, rows: DataFrame, config: ExperimentConfig) -> tuple:
    """The same for compressed rows too many for a task: rules are scored on Spark.

    Strategies that look at rows, and child populations, get a part of the rows that one task can hold, as rules start
    from samples anyway; scores that steer the evolution, and all those reported, are of every row.
    """
    score = config.trainer.val_score or config.trainer.evolution.score
    if not isinstance(score, str) or not isinstance(config.trainer.evolution.score, str):
        raise ValueError("data too large for a task need scores of confusion counts")
    tables = [fold.table(rows.where(F.col("part") == part)).persist() for part in (TRAIN, VAL, TEST)]
    width = max(1, len(fold.names))
    some = tables[TRAIN].orderBy(F.xxhash64(*tables[TRAIN].columns), *tables[TRAIN].columns).limit(max(2, scoring.LOCAL_CELLS // width)).toPandas()
    names = scoring.feature_columns(tables[TRAIN])
    held = Matrix(some[names].to_numpy(bool), some[LABEL].to_numpy(bool), some[WEIGHT].to_numpy(np.int64))
    history = train(held, config.trainer, np.random.default_rng([config.base_seed, fold.run, fold.fold]), tables[VAL], Scorer(tables[TRAIN], config.trainer.evolution.score))
    counts = [_counts(table, history.best_rule) for table in tables]
    history.train, history.val = counts[TRAIN], counts[VAL]
    for table in tables:
        table.unpersist()
    return _told(fold, history, counts[TEST], float(COUNT_SCORES[score](*counts[TEST])))


def _counts(table: DataFrame, rule: Rule) -> tuple:
    row = scoring.population_counts(table, [rule]).first()
    return row.tp, row.fp, row.fn, row.tn


def _types(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema))


def run_experiment(df: DataFrame, key: str, label: str, config: ExperimentConfig, categorical: tuple[str, ...] = (), progress: Progress | None = None) -> DataFrame:
    """One row (FOLD) for each run and fold. key must be unique; the other columns but label are features.

    A run and fold trains in a partition of its own if its compressed rows have at most LOCAL_CELLS cells; larger ones
    train one after another with their rules scored on Spark. Results depend on the seeds alone. A column whose values
    are all null has no bins; a null label is an error of the caller's.
    """
    validate_experiment(config)
    spark = df.sparkSession
    labelled = df.withColumn(LABEL, F.col(f"`{label}`").cast("boolean"))
    labelled = labelled.drop(label) if label != LABEL else labelled
    columns = [c for c in labelled.columns if c not in (key, LABEL)]
    rows = mark_runs(labelled, key, config).drop(key).persist()
    folds, compressed = prepare_folds(rows, config, columns, categorical)
    compressed = compressed.persist()
    sizes = {r.task: r.n for r in compressed.groupBy("task").agg(F.count("*").alias("n")).collect()}  # a row for each run and fold
    rows.unpersist()
    large = [k for k, fold in enumerate(folds) if sizes.get(k, 0) * max(1, len(fold.names)) > scoring.LOCAL_CELLS]
    small = [k for k in range(len(folds)) if k not in large]
    share = spark.sparkContext.broadcast(cloudpickle.dumps((folds, replace(config, binarizer=None))))  # tasks fit no bins
    if progress is not None:
        progress.total += len(folds)
    epochs, done, each = (progress.epochs, progress.done, config.trainer.epochs) if progress is not None else (None, None, 0)
    schema = _types(FOLD)

    def work(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        known, settings = cloudpickle.loads(share.value)
        table = pa.concat_tables(tables)
        for task in sorted(set(table["task"].to_pylist())):
            mine = table.filter(pc.equal(table["task"], task))
            fold = known[task]
            codes = np.array(mine["codes"].combine_chunks().flatten().to_numpy(), np.int64).reshape(mine.num_rows, len(fold.widths))
            part, y, w = (mine[c].to_numpy() for c in ("part", LABEL, WEIGHT))
            order = np.lexsort([y, *codes.T[::-1]])
            parts = [Matrix(fold.bits(codes[k]), y[k].astype(bool), w[k].astype(np.int64)) for k in (order[part[order] == p] for p in (TRAIN, VAL, TEST))]
            row = train_fold(fold, parts, settings)
            if epochs is not None:
                epochs.add(each)
                done.add(1)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_plain(row), schema, strict=True)], schema=schema)

    # Partition by partition, so that no hashing or coalescing puts two tasks into one while others are idle.
    width = len(small) if config.n_jobs == -1 else min(len(small), config.n_jobs)
    out = None
    if small:
        place = {k: i % width for i, k in enumerate(small)}
        dealt = compressed.where(F.col("task").isin(small)) if large else compressed
        where = F.element_at(F.create_map(*[F.lit(x) for k in small for x in (k, place[k])]), F.col("task"))
        out = dealt.repartitionById(width, where).mapInArrow(work, FOLD)
    if large:
        told = []
        for k in large:
            told.append(train_fold_on_spark(folds[k], compressed.where(F.col("task") == k), config))
            if progress is not None:
                progress.epochs.add(each)
                progress.done.add(1)
        more = spark.createDataFrame(told, FOLD)
        out = more if out is None else out.unionByName(more)
    return out


def _plain(row: tuple) -> list:
    """A FOLD row with its generations as dictionaries, as Arrow takes them."""
    names = [x.split(" ")[0] for x in GENERATION.split(", ")]
    return [*row[:-1], [dict(zip(names, g, strict=True)) for g in row[-1]]]


def best_rule(folds: DataFrame) -> Rule:
    """The rule of the best fold of the best run."""
    from rulewright.plans.results import best_folds

    row = best_folds(folds).orderBy(F.desc("mean_val"), "run").first()
    return parse(row.best_rule)
