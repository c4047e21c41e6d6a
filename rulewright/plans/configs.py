"""Settings of evolution, training and experiments; checked each time that they are used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from rulewright.functions.rules import OPERATORS, Lit, Rule, complexity_check, is_operator_type
from rulewright.operators.population import RandomStrategy
from rulewright.operators.sampling import Sampling
from rulewright.operators.scoring import COUNT_SCORES
from rulewright.operators.selection import TournamentSelection
from rulewright.operators.variation import Mutation, Mutator


@dataclass(frozen=True)
class EvolutionConfig:
    """Settings of one evolution; children: see Evolution.

    score: a name of COUNT_SCORES or a function (predictions, labels[, sample_weight]). strategies: Strategy objects, or a
    function (data, score) that makes them for each population's data. literal_mutations, operator_mutations: functions
    from the number of features to the mutations for nodes of that kind; the default sets if not given, over operator_types.
    """

    score: str | Callable = "f1"
    population_size: int = 100
    strategies: tuple | Callable = field(default_factory=lambda: (RandomStrategy(),))
    strategy_weights: tuple[float, ...] | None = None
    mutation_p: float = 0.1
    mutation_tries: int = 1
    mutation_operator_p: float = 0.5
    literal_mutations: Callable[[int], tuple[Mutation, ...]] | None = None
    operator_mutations: Callable[[int], tuple[Mutation, ...]] | None = None
    operator_types: tuple[type, ...] = OPERATORS
    crossover_p: float = 0.7
    crossover_strategy: str = "random"
    crossover_tries: int = 1
    crossover_operator_p: float = 0.9
    selection: Any = field(default_factory=TournamentSelection)
    max_complexity: int | None = None
    check_valid: Callable[[Rule], bool] | None = None
    complexity_penalty: float = 0.0
    regeneration: bool = False
    regeneration_patience: int = 100
    compress: bool = True
    max_depth: int = 0
    num_children: int = 0
    sampling: Sampling | None = None
    top_k: int = 10
    feedback: str = "multiplicative"
    feedback_strength: float = 0.1
    child_weights: str = "distinct"

    def valid(self) -> Callable[[Rule], bool] | None:
        """check_valid and the limit on complexity, together."""
        limit = complexity_check(self.max_complexity) if self.max_complexity is not None else None
        checks = [c for c in (limit, self.check_valid) if c]
        return (lambda rule: all(c(rule) for c in checks)) if checks else None

    def mutator(self, num_literals: int) -> Mutator:
        """For a population with so many features."""
        made = [make and make(num_literals) for make in (self.literal_mutations, self.operator_mutations)]
        return Mutator(num_literals, self.mutation_p, self.mutation_tries, self.mutation_operator_p, self.operator_types, self.valid(), *made)


def _int(what: str, value, least: int) -> None:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{what} must be an int")
    if value < least:
        raise ValueError(f"{what} must be at least {least}")


def _number(what: str, value, low: float, high: float | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise TypeError(f"{what} must be a number")
    if value < low or high is not None and value > high:
        raise ValueError(f"{what} must be at least {low}" + f" and at most {high}" * (high is not None))


def check_score(score) -> None:
    if isinstance(score, str):
        if score not in COUNT_SCORES:
            raise ValueError(f"unknown score {score!r}")
    elif not callable(score):
        raise TypeError("a score is a name or a function")


def validate_evolution(config: EvolutionConfig) -> EvolutionConfig:
    check_score(config.score)
    _int("population_size", config.population_size, 1)
    for what in ("mutation_p", "mutation_operator_p", "crossover_p", "crossover_operator_p"):
        _number(what, getattr(config, what), 0, 1)
    for what in ("mutation_tries", "crossover_tries", "regeneration_patience"):
        _int(what, getattr(config, what), 1)
    _number("complexity_penalty", config.complexity_penalty, 0)
    _number("feedback_strength", config.feedback_strength, 0)
    _int("max_depth", config.max_depth, 0)
    _int("num_children", config.num_children, 0)
    if config.crossover_strategy != "random":
        raise ValueError("the only crossover strategy is 'random'")
    if config.feedback not in ("additive", "multiplicative"):
        raise ValueError("feedback is additive or multiplicative")
    if config.child_weights not in ("distinct", "full"):
        raise ValueError("child_weights is distinct or full")
    if config.max_complexity is not None:
        _int("max_complexity", config.max_complexity, 1)
    if config.max_depth:
        _int("num_children", config.num_children, 1)
        if config.sampling is None:
            raise ValueError("children need a sampling")
        _int("top_k", config.top_k, 1)
        if config.top_k > config.population_size:
            raise ValueError("top_k must be at most population_size")
    if not config.operator_types or not all(map(is_operator_type, config.operator_types)):
        raise ValueError("operator_types must be operators")
    for what in ("literal_mutations", "operator_mutations"):
        if getattr(config, what) is not None and not callable(getattr(config, what)):
            raise TypeError(f"{what} must be a function of the number of features")
    if config.check_valid is not None:
        if not callable(config.check_valid):
            raise TypeError("check_valid must be a function")
        if not isinstance(config.check_valid(Lit(0)), bool):
            raise TypeError("check_valid must return a bool")
    return config


@dataclass(frozen=True)
class TrainerConfig:
    evolution: EvolutionConfig = field(default_factory=EvolutionConfig)
    epochs: int = 1000
    val_every: int = 100
    val_score: str | Callable | None = None


def validate_trainer(config: TrainerConfig) -> TrainerConfig:
    validate_evolution(config.evolution)
    _int("epochs", config.epochs, 1)
    _int("val_every", config.val_every, 1)
    if config.val_score is not None:
        check_score(config.val_score)
    return config


@dataclass(frozen=True)
class ExperimentConfig:
    """binarizer: an object with fit(df, label, categorical, keep) that gives a model with names() and transform(df, keep),
    fitted on each fold's training rows in place of the own bins (num_bins, supervised)."""

    trainer: TrainerConfig = field(default_factory=TrainerConfig)
    num_runs: int = 30
    test_size: float = 0.2
    n_folds: int = 5
    n_jobs: int = -1
    base_seed: int = 0
    num_bins: int = 5
    supervised: bool = True
    binarizer: Any = None


def validate_experiment(config: ExperimentConfig) -> ExperimentConfig:
    validate_trainer(config.trainer)
    _int("num_runs", config.num_runs, 1)
    _int("n_folds", config.n_folds, 2)
    _int("base_seed", config.base_seed, 0)
    _int("num_bins", config.num_bins, 2)
    if isinstance(config.n_jobs, bool) or not isinstance(config.n_jobs, int) or config.n_jobs != -1 and config.n_jobs < 1:
        raise ValueError("n_jobs is -1 or a positive int")
    _number("test_size", config.test_size, 0, 1)
    if not 0 < config.test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    return config
