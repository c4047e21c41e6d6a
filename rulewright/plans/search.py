"""Random search over settings, with conditional parameters and trials kept in a table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from rulewright.operators.population import BestLiteralStrategy, RandomStrategy
from rulewright.operators.sampling import Sampling
from rulewright.operators.selection import RouletteSelection, TournamentSelection
from rulewright.plans.configs import EvolutionConfig, ExperimentConfig, TrainerConfig

TRIAL = "trial long, state string, value double, params string, attributes string"

DEFAULT_SPACE = {
    "population_size": {"type": "int", "low": 50, "high": 200, "step": 10},
    "mutation_p": {"type": "float", "low": 0.01, "high": 0.5},
    "crossover_p": {"type": "float", "low": 0.3, "high": 1.0},
    "selection": {"type": "categorical", "choices": ["tournament", "roulette"]},
    "tournament_size": {"type": "int", "low": 2, "high": 20, "when": {"selection": ["tournament"]}},
    "selection_p": {"type": "float", "low": 0.1, "high": 0.9, "when": {"selection": ["tournament"]}},
    "complexity_penalty": {"type": "float", "low": 1e-4, "high": 0.05, "log": True},
    "max_depth": {"type": "int", "low": 0, "high": 2},
    "num_children": {"type": "int", "low": 2, "high": 4, "above": {"max_depth": 0}},
    "feature_fraction": {"type": "float", "low": 0.1, "high": 1.0, "above": {"max_depth": 0}},
    "top_k": {"type": "int", "low": 5, "high": 30, "above": {"max_depth": 0}},
    "feedback": {"type": "categorical", "choices": ["additive", "multiplicative"], "above": {"max_depth": 0}},
    "num_bins": {"type": "int", "low": 2, "high": 8},
}


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text[:1] in "'\"" and text[:1] == text[-1:] and len(text) > 1:
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def read_yaml(text: str):
    """The plain part of YAML that settings are written in: mappings and lists by indentation, lists in brackets, scalars, comments."""
    lines = []
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if bare and bare != "---":
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, depth: int):
        out = [] if lines[at][1].startswith("-") else {}
        while at < len(lines) and lines[at][0] == depth:
            said = lines[at][1]
            if isinstance(out, list):
                out.append(_scalar(said[1:]))
                at += 1
                continue
            name, colon, rest = said.partition(":")
            if not colon:
                raise ValueError(f"not a setting: {said!r}")
            deeper = at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("- "))
            if not rest.strip() and deeper:
                out[_scalar(name)], at = block(at + 1, lines[at + 1][0])
            else:
                out[_scalar(name)], at = _scalar(rest), at + 1
        if at < len(lines) and lines[at][0] > depth:
            raise ValueError(f"unexpected indentation: {lines[at][1]!r}")
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load_space(path: str) -> dict:
    """A search space from JSON or YAML."""
    text = Path(path).read_text()
    space = read_yaml(text) if path.endswith((".yaml", ".yml")) else json.loads(text)
    for name, spec in space.items():
        if not isinstance(spec, dict) or spec.get("type") not in ("int", "float", "categorical"):
            raise ValueError(f"{name}: type must be int, float or categorical")
    return space


def sample(space: dict, rng: np.random.Generator) -> dict:
    """A setting of each parameter whose conditions hold for those before it."""
    out: dict = {}
    for name, spec in space.items():
        if any(out.get(k) not in v for k, v in spec.get("when", {}).items()) or any(not out.get(k, 0) > v for k, v in spec.get("above", {}).items()):
            continue
        if spec["type"] == "categorical":
            out[name] = spec["choices"][rng.integers(len(spec["choices"]))]
            continue
        low, high = spec["low"], spec["high"]
        if name == "feature_fraction" and out.get("num_children"):  # disjoint slices at each level
            high = max(low, min(high, 1.0 / out["num_children"] ** out["max_depth"]))
        if spec["type"] == "int":
            step = spec.get("step", 1)
            out[name] = int(low + step * rng.integers((high - low) // step + 1))
        else:
            out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))) if spec.get("log") else rng.uniform(low, high))
    return out


def to_config(params: dict, epochs: int = 100, num_runs: int = 10, n_folds: int = 5, base_seed: int = 0) -> ExperimentConfig:
    selection = RouletteSelection() if params.get("selection") == "roulette" else TournamentSelection(params.get("tournament_size", 10), params.get("selection_p", 0.4))
    depth = params.get("max_depth", 0)
    plain = {k: params[k] for k in ("population_size", "mutation_p", "crossover_p", "complexity_penalty", "top_k", "feedback", "num_children") if k in params}
    if "top_k" in plain:
        plain["top_k"] = min(plain["top_k"], plain.get("population_size", 100))
    sampling = Sampling(params.get("feature_fraction", 0.33)) if depth else None
    evolution = EvolutionConfig(selection=selection, max_depth=depth, sampling=sampling, strategies=(RandomStrategy(), BestLiteralStrategy(0.5, 0.5)), **plain)
    return ExperimentConfig(TrainerConfig(evolution, epochs), num_runs, n_folds=n_folds, base_seed=base_seed, num_bins=params.get("num_bins", 5))


def trials(spark: SparkSession, path: str) -> DataFrame:
    """All trials that a study's table has; none if there is no table yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], TRIAL)
    return spark.read.schema(TRIAL).parquet(path)


def search(spark: SparkSession, path: str, objective: Callable[[dict], float | tuple[float, dict]], n_trials: int, space: dict | None = None, most: int | None = None, seed: int = 0) -> DataFrame:
    """Makes up to n_trials more complete trials, `most` in all; one that fails is kept as pruned, with why.

    objective: gives a value, or a value and a dictionary of attributes. Trials are appended to a table, so a study goes on
    where it stopped.
    """
    before = trials(spark, path)
    done, started = before.where("state = 'complete'").count(), before.count()
    left = n_trials if most is None else min(n_trials, most - done)
    for k in range(started, started + max(0, left)):
        params = sample(space or DEFAULT_SPACE, np.random.default_rng([seed, k]))
        try:
            found = objective(params)
            value, told = found if isinstance(found, tuple) else (found, {})
            row = (k, "complete", float(value), json.dumps(params), json.dumps(told))
        except (ValueError, RuntimeError) as e:
            row = (k, "pruned", None, json.dumps(params), json.dumps({"error": str(e)[:500]}))
        spark.createDataFrame([row], TRIAL).coalesce(1).write.mode("append").parquet(path)
    return trials(spark, path)


def best_trial(table: DataFrame) -> dict:
    row = table.where("state = 'complete'").orderBy(table.value.desc(), "trial").first()
    return json.loads(row.params)
