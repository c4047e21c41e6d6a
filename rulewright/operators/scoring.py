"""Compression of duplicate rows to weights, confusion counts, and scores of whole populations."""

from __future__ import annotations

import inspect
import pickle
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.functions.rules import Rule

LABEL, WEIGHT = "label", "w"
#: Cells (rows times features) of compressed data that one task or the driver holds.
LOCAL_CELLS = 2_000_000


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (LABEL, WEIGHT)]


def compress(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Each distinct row of features and label once, with its number of rows (or sum of weights) as w."""
    weight = F.sum(WEIGHT) if WEIGHT in df.columns else F.count("*")
    return df.groupBy(*[c for c in df.columns if c != WEIGHT]).agg(weight.cast("long").alias(WEIGHT))


def confusion_columns(pred: Column, label: Column, weight: Column | None = None) -> dict[str, Column]:
    """tp, fp, fn and tn as aggregates, predictions first."""
    w = F.lit(1).cast("long") if weight is None else weight
    count = lambda test: F.coalesce(F.sum(F.when(test, w)), F.lit(0)).cast("long")
    return {"tp": count(pred & label), "fp": count(pred & ~label), "fn": count(~pred & label), "tn": count(~pred & ~label)}


def f1_column(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of counts: 1 if nothing is predicted and nothing is there, 0 if just one of them."""
    found, there = tp + fp, tp + fn
    return F.when((found == 0) & (there == 0), 1.0).when((found == 0) | (there == 0), 0.0).otherwise(2.0 * tp / (found + there))


def accuracy_column(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    return (tp + tn) / (tp + fp + fn + tn)


def confusion(df: DataFrame, rule: Rule, label: str = LABEL) -> DataFrame:
    """One row: tp, fp, fn, tn, f1, accuracy of a rule, weighted if df has weights."""
    weight = F.col(WEIGHT) if WEIGHT in df.columns else None
    counts = df.agg(*[c.alias(n) for n, c in confusion_columns(rule.to_column(), F.col(label), weight).items()])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", f1_column(tp, fp, fn).alias("f1"), accuracy_column(tp, fp, fn, tn).alias("accuracy"))


# Scores of NumPy arrays, predictions first, for the loop inside a task.


def confusion_matrix(pred, label, sample_weight=None) -> tuple[int, int, int, int]:
    pred, label = np.asarray(pred, bool), np.asarray(label, bool)
    w = np.ones(len(label), np.int64) if sample_weight is None else np.asarray(sample_weight)
    tp, found, there, every = (w[pred & label].sum(), w[pred].sum(), w[label].sum(), w.sum())
    return int(tp), int(found - tp), int(there - tp), int(every - found - there + tp)


def f1_score(pred, label, sample_weight=None) -> float:
    tp, fp, fn, _ = confusion_matrix(pred, label, sample_weight)
    return f1_of(tp, fp, fn, 0)


def accuracy_score(pred, label, sample_weight=None) -> float:
    return accuracy_of(*confusion_matrix(pred, label, sample_weight))


def f1_of(tp, fp, fn, tn) -> float:
    if tp + fp == 0 or tp + fn == 0:
        return float(tp + fp == tp + fn)
    return 2.0 * tp / (2 * tp + fp + fn)


def accuracy_of(tp, fp, fn, tn) -> float:
    total = tp + fp + fn + tn
    return (tp + tn) / total if total else 0.0


#: Scores by name: of confusion counts, so they need no rows.
COUNT_SCORES: dict[str, Callable[..., float]] = {"f1": f1_of, "accuracy": accuracy_of}


def accepts_weight(score: Callable) -> bool:
    """Whether a score of arrays takes sample_weight."""
    try:
        parameters = inspect.signature(score).parameters
    except (TypeError, ValueError):
        return False
    return "sample_weight" in parameters or any(p.kind is p.VAR_KEYWORD for p in parameters.values())


@dataclass(frozen=True)
class Matrix:
    """Rows in memory: boolean features, labels, and weights if compressed."""

    data: np.ndarray
    label: np.ndarray
    weight: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.label)

    def take(self, rows=None, features=None) -> Matrix:
        """Some rows and features; weights go with their rows."""
        rows = slice(None) if rows is None else rows
        data = self.data[rows]
        return Matrix(data if features is None else data[:, features], self.label[rows], None if self.weight is None else self.weight[rows])

    def compressed(self) -> Matrix:
        both = np.column_stack([self.data, self.label]).astype(bool)
        if not len(both):
            return Matrix(self.data, self.label, np.zeros(0, np.int64))
        unique, inverse = np.unique(both, axis=0, return_inverse=True)
        weight = np.bincount(inverse.ravel(), weights=self.weight, minlength=len(unique)).astype(np.int64)
        return Matrix(unique[:, :-1], unique[:, -1], weight)


def score_rule(rule: Rule, matrix: Matrix, score) -> float:
    """score: a name of COUNT_SCORES, or a function of predictions and labels, with sample_weight if it takes that."""
    pred = rule.evaluate(matrix.data)
    if isinstance(score, str):
        return float(COUNT_SCORES[score](*confusion_matrix(pred, matrix.label, matrix.weight)))
    if matrix.weight is not None:
        return float(score(pred, matrix.label, sample_weight=matrix.weight))
    return float(score(pred, matrix.label))


def prepare(matrix: Matrix, *scores) -> Matrix:
    """matrix compressed if every score takes weights; else as it is, with a warning for each that doesn't."""
    refused = [s for s in scores if not isinstance(s, str) and not accepts_weight(s)]
    for s in dict.fromkeys(refused):
        warnings.warn(f"score {getattr(s, '__name__', s)} takes no sample_weight: duplicate rows are not compressed", stacklevel=2)
    return matrix if refused else matrix.compressed()


def collect(df: DataFrame, most_cells: int = LOCAL_CELLS) -> Matrix | None:
    """df (features, label, w) as a Matrix, or None if it has more cells than that. Rows are sorted, so the same table gives the same matrix."""
    names = feature_columns(df)
    limit = most_cells // max(1, len(names))
    table = df.select(*names, LABEL, *([WEIGHT] if WEIGHT in df.columns else [])).limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    data = np.column_stack([table[c].to_numpy().astype(bool) for c in names]) if table.num_rows else np.zeros((0, len(names)), bool)
    label = table[LABEL].to_numpy().astype(bool)
    order = np.lexsort([label, *data.T[::-1]]) if table.num_rows else np.zeros(0, int)
    weight = table[WEIGHT].to_numpy().astype(np.int64)[order] if WEIGHT in df.columns else None
    return Matrix(data[order], label[order], weight)


def population_counts(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule_id, tp, fp, fn, tn of each rule over a table of any size.

    Each task counts all rules over its own Arrow batches and sends one row a rule; those are then added up.
    """
    names, packed = feature_columns(df), pickle.dumps(list(rules))
    weighted = WEIGHT in df.columns

    def count(batches):
        population = pickle.loads(packed)
        total = np.zeros((len(population), 4), np.int64)
        for batch in batches:
            data = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in range(len(names))])
            label = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            weight = batch.column(len(names) + 1).to_numpy() if weighted else None
            for k, rule in enumerate(population):
                total[k] += confusion_matrix(rule.evaluate(data), label, weight)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(population)), pa.int32()), *(pa.array(c) for c in total.T)], names=["rule_id", "tp", "fp", "fn", "tn"])

    rows = df.select(*names, LABEL, *([WEIGHT] * weighted))
    parts = rows.mapInArrow(count, "rule_id int, tp long, fp long, fn long, tn long")
    return parts.groupBy("rule_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def population_table(df: DataFrame, rules: Sequence[Rule], wide: bool = False) -> DataFrame:
    """rule_id, rule, complexity, tp, fp, fn, tn, f1, accuracy. wide: one aggregation with all rules as columns, for a handful."""
    spark = df.sparkSession
    if wide:
        weight = F.col(WEIGHT) if WEIGHT in df.columns else None
        row = df.agg(*[F.struct(*[c.alias(n) for n, c in confusion_columns(r.to_column(), F.col(LABEL), weight).items()]).alias(f"r{k}") for k, r in enumerate(rules)])
        counts = row.select(F.posexplode(F.array(*[F.col(f"r{k}") for k in range(len(rules))])).alias("rule_id", "e")).select("rule_id", "e.*")
    else:
        counts = population_counts(df, rules)
    said = spark.createDataFrame([(k, str(r), len(r)) for k, r in enumerate(rules)], "rule_id int, rule string, complexity int")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return said.join(counts, "rule_id").select("rule_id", "rule", "complexity", "tp", "fp", "fn", "tn", f1_column(tp, fp, fn).alias("f1"), accuracy_column(tp, fp, fn, tn).alias("accuracy"))


class Scorer:
    """Scores of rules on one table, known ones from memory: on a Matrix in this process, or on Spark if the table is too large."""

    def __init__(self, data: Matrix | DataFrame, score="f1", known: int = 100_000):
        self.data, self.score, self.most, self.known = data, score, known, {}
        if isinstance(data, DataFrame) and not isinstance(score, str):
            raise ValueError("a table too large to collect needs a score of confusion counts")

    def __call__(self, rules: Sequence[Rule]) -> np.ndarray:
        fresh = list(dict.fromkeys(r for r in rules if r not in self.known))
        if len(self.known) + len(fresh) > self.most:
            self.known = {}
            fresh = list(dict.fromkeys(rules))
        if isinstance(self.data, Matrix):
            self.known.update((r, score_rule(r, self.data, self.score)) for r in fresh)
        elif fresh:
            rows = population_counts(self.data, fresh).collect()  # a row a rule
            self.known.update((fresh[r.rule_id], float(COUNT_SCORES[self.score](r.tp, r.fp, r.fn, r.tn))) for r in rows)
        return np.array([self.known[r] for r in rules], float)
