"""Hooks, large tables, studies, baselines and timings."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions.rules import And, Lit, Or, parse
from rulewright.operators import binarize, scoring
from rulewright.operators.binarize import Binarizer, quantile_edges
from rulewright.operators.ordered import histogram, running, stretch_cuts
from rulewright.operators.population import BestLiteralStrategy, RandomStrategy
from rulewright.operators.scoring import Matrix
from rulewright.operators.tree_bins import tree_edges
from rulewright.operators.variation import Delete, Negate
from rulewright.plans import experiment, search, studies
from rulewright.plans.configs import EvolutionConfig, ExperimentConfig, TrainerConfig, validate_evolution
from rulewright.plans.evolve import Evolution

SMALL = EvolutionConfig(population_size=20, strategies=(BestLiteralStrategy(), RandomStrategy()))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(x), k, bool(b), bool(x > 0.3 and k != "c")) for i, (x, k, b) in enumerate(zip(rng.normal(size=300).round(2), rng.choice(list("abc"), 300), rng.random(300) < 0.5, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, kind string, flag boolean, target boolean").repartition(3).cache()


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=3000).round(2)
    df = spark.createDataFrame([(float(v), bool(v > 1), int(k)) for v, k in zip(values, rng.integers(0, 2, 3000), strict=True)] + [(None, True, 0), (float("nan"), True, 1)], "x double, y boolean, g int").repartition(4)
    got = running(histogram(df, ["x"], ("g",), "y"), stretch_cuts(df, ["x"]), ("g",)).collect()
    frame = df.toPandas().dropna()
    for g, part in frame.groupby("g"):
        n = part.groupby("x").agg(n=("y", "size"), pos=("y", "sum")).cumsum()
        mine = {r.x: (r.cn, r.cp) for r in got if r.g == g}
        assert mine == {x: (int(a), int(b)) for x, a, b in n.itertuples()}
        assert {r.tn for r in got if r.g == g} == {len(part)}


def test_quantiles_are_the_plain_ones(spark):
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=1001), rng.integers(0, 5, 1001).astype(float)
    df = spark.createDataFrame(list(zip(map(float, x), map(float, z), strict=True)), "x double, z double").repartition(4)
    got = quantile_edges(df, {"x": 7, "z": 4})
    assert np.allclose(got["x"][1:-1], np.percentile(x, [100 * i / 7 for i in range(1, 7)]), atol=1e-6)
    assert got["z"][1:-1] == sorted({float(v) for v in np.percentile(z, [25, 50, 75])})
    assert quantile_edges(df.select(F.lit(None).cast("double").alias("n"), F.lit(3.0).alias("c")), {"n": 3, "c": 3}) == {"n": [-np.inf, np.inf], "c": [-np.inf, np.inf]}


def test_tree_of_many_values(spark):
    """More distinct values than stretches, against a tree grown over the whole sorted column."""
    rng = np.random.default_rng(3)
    x = rng.permutation(20_000) / 7
    y = ((x > 400) & (x < 1900) | (x > 2500)) ^ (rng.random(20_000) < 0.02)
    df = spark.createDataFrame(list(zip(map(float, x), map(bool, y), strict=True)), "x double, y boolean").repartition(4)
    order = np.argsort(x)
    xs, ys = x[order], y[order].astype(float)
    gini = lambda n, p: n - (p * p + (n - p) * (n - p)) / n
    leaves, cuts = [(0, len(xs))], []
    for _ in range(4):
        best = None
        for a, b in leaves:
            k, p = np.arange(1, b - a), np.cumsum(ys[a:b])
            gain = gini(b - a, p[-1]) - gini(k, p[:-1]) - gini(b - a - k, p[-1] - p[:-1])
            at = int(np.argmax(gain))
            if best is None or gain[at] > best[0]:
                best = (gain[at], a, b, a + at + 1)
        _, a, b, mid = best
        leaves = [leaf for leaf in leaves if leaf != (a, b)] + [(a, mid), (mid, b)]
        cuts.append((xs[mid - 1] + xs[mid]) / 2)
    assert np.allclose(tree_edges(df, {"x": 5}, "y")["x"], sorted(cuts))


def test_too_many_categories(spark):
    df = spark.createDataFrame([(str(k),) for k in range(9)], "c string")
    assert len(binarize.category_values(df, ("c",), most=9)[("c",)]) == 9
    with pytest.raises(ValueError, match="more than 8 categories"):
        binarize.category_values(df, ("c",), most=8)


def by_hand(table, config, run, fold):
    """Training, validation and test rows of a fold, binarized for themselves."""
    rows = experiment.mark_runs(table.withColumn("label", F.col("target")).drop("target"), "id", config).where(F.col("run") == run)
    parts = [rows.where(~F.col("test") & (F.col("fold") != fold)), rows.where(~F.col("test") & (F.col("fold") == fold)), rows.where("test")]
    keep = ("label", "run", "test", "fold", "id")
    model = Binarizer(config.num_bins).fit(parts[0].select("x", "kind", "flag", "label"), "label" if config.supervised else None, ("kind",), ("label",))
    return model, [model.transform(p.select("x", "kind", "flag", "label"), ("label",)) for p in parts], keep


@pytest.mark.parametrize("supervised", [True, False])
def test_folds_are_those_of_one_by_one(spark, table, supervised):
    config = ExperimentConfig(TrainerConfig(SMALL, 3, 1), num_runs=2, n_folds=3, num_bins=4, supervised=supervised)
    out = {(r.run, r.fold): r for r in experiment.run_experiment(table, "id", "target", config, ("kind",)).collect()}
    assert set(out) == {(r, f) for r in range(2) for f in range(3)}
    for (run, fold), r in out.items():
        model, parts, _ = by_hand(table, config, run, fold)
        rule = parse(r.best_rule)
        assert r.rule_names == rule.to_str(model.names())
        for got, part in zip((r.train, r.val, r.test), parts, strict=True):
            want = scoring.confusion(part, rule).first()
            assert got == [want.tp, want.fp, want.fn, want.tn]


def test_folds_too_large_for_a_task(spark, table, monkeypatch):
    config = ExperimentConfig(TrainerConfig(SMALL, 3, 1), num_runs=1, n_folds=2, num_bins=4)
    usual = experiment.run_experiment(table, "id", "target", config, ("kind",)).collect()
    monkeypatch.setattr(scoring, "LOCAL_CELLS", 60)
    progress = experiment.Progress(spark)
    large = experiment.run_experiment(table, "id", "target", config, ("kind",), progress).collect()
    assert len(large) == len(usual) == 2 and str(progress) == "2 of 2 folds, 6 epochs"
    for r in large:
        model, parts, _ = by_hand(table, config, r.run, r.fold)
        rule = parse(r.best_rule)
        for got, part in zip((r.train, r.val, r.test), parts, strict=True):
            want = scoring.confusion(part, rule).first()
            assert got == [want.tp, want.fp, want.fn, want.tn]
        assert r.test_score == pytest.approx(scoring.f1_of(*r.test)) and max(r.generations[-1].train_scores) <= 1


def test_own_mutations_strategies_and_operators():
    bits = np.random.default_rng(1).random((50, 5)) < 0.5
    matrix, seen = Matrix(bits, bits[:, 1]), []

    def strategies(data, score):
        seen.append((data.data.shape, score))
        return (RandomStrategy((And,)),)

    config = EvolutionConfig(population_size=12, strategies=strategies, crossover_p=0.0, mutation_p=1.0, operator_types=(And,), literal_mutations=lambda n: (Negate(),), operator_mutations=lambda n: (Negate(), Delete()))
    evolution = Evolution(matrix, config, np.random.default_rng(2))
    for _ in range(3):
        evolution.step()
    assert seen and seen[0][0][1] == 5 and all(type(r) is And and len(r) == 3 for r in evolution.population)
    for bad in (EvolutionConfig(operator_types=()), EvolutionConfig(operator_types=(Lit,)), EvolutionConfig(literal_mutations=3)):
        with pytest.raises((ValueError, TypeError)):
            validate_evolution(bad)
    assert Or not in {type(n) for r in evolution.population for n in r.flatten()}


class Halves:
    """A binarizer of a caller's own: one feature, above the median of x."""

    def fit(self, df, label, categorical, keep):
        cut = df.agg(F.percentile("x", 0.5)).first()[0]

        class Model:
            def names(self):
                return {0: f"x > {cut:.2f}", 1: "flag"}

            def transform(self, rows, keep):
                return rows.select(*keep, (F.col("x") > cut).alias("f0"), F.col("flag").alias("f1"))

        return Model()


def test_own_binarizer(spark, table):
    config = ExperimentConfig(TrainerConfig(SMALL, 2, 1), num_runs=1, n_folds=2, binarizer=Halves())
    rows = experiment.run_experiment(table.select("id", "x", "flag", "target"), "id", "target", config).collect()
    assert len(rows) == 2 and all("x > " in r.rule_names or "flag" in r.rule_names for r in rows) and all(sum(r.test) in (60, 61) for r in rows)


def test_progress_of_tasks(spark, table):
    progress, told = experiment.Progress(spark), []
    config = ExperimentConfig(TrainerConfig(SMALL, 4, 1), num_runs=1, n_folds=3, n_jobs=2)
    assert experiment.run_experiment(table, "id", "target", config, ("kind",), progress).count() == 3
    assert str(progress) == "3 of 3 folds, 12 epochs"
    bits = np.random.default_rng(1).random((30, 4)) < 0.5
    experiment.train(Matrix(bits, bits[:, 0]), TrainerConfig(SMALL, 3), np.random.default_rng(1), tell=lambda epoch, record: told.append((epoch, record.epoch)))
    assert told == [(0, 0), (1, 1), (2, 2)]


def test_study(spark, table, tmp_path):
    space = {"population_size": {"type": "int", "low": 10, "high": 20}, "num_bins": {"type": "int", "low": 2, "high": 4}, "selection": {"type": "categorical", "choices": ["roulette"]}}
    aim = studies.objective(table, "id", "target", ("kind",), f"{tmp_path}/artifacts", epochs=2, num_runs=2, n_folds=2)
    out = search.search(spark, f"{tmp_path}/study", aim, 2, space).where("state = 'complete'").collect()
    assert len(out) == 2
    for r in out:
        folds = spark.read.parquet(f"{tmp_path}/artifacts/trial={r.trial}")
        told = json.loads(r.attributes)
        runs = folds.groupBy("run").agg(F.avg("best_val").alias("v")).orderBy("run").collect()
        assert told["val_scores"] == pytest.approx([x.v for x in runs]) and r.value == pytest.approx(np.mean([x.v for x in runs]))
        best = folds.where((F.col("run") == told["best_run"]) & (F.col("fold") == told["best_fold"])).first()
        assert told["rule"] == best.best_rule and told["complexity"] == len(parse(best.best_rule)) and told["best_test"] == best.test_score

    def fails(params):
        raise ValueError("no")

    pruned = search.search(spark, f"{tmp_path}/study", fails, 1, space).where("state = 'pruned'").first()
    assert json.loads(pruned.attributes) == {"error": "no"} and pruned.value is None


def test_yaml(tmp_path):
    text = """
# a space
population_size:
  type: int
  low: 10   # least
  high: 20
selection: {unused}
selection:
  type: categorical
  choices: [tournament, 'roulette', 3, 0.5, true]
rate:
  type: float
  low: 1e-4
  log: true
  when:
    selection:
      - tournament
""".replace("selection: {unused}\n", "")
    (tmp_path / "s.yaml").write_text(text)
    space = search.load_space(f"{tmp_path}/s.yaml")
    assert space["population_size"] == {"type": "int", "low": 10, "high": 20} and space["selection"]["choices"] == ["tournament", "roulette", 3, 0.5, True]
    assert space["rate"] == {"type": "float", "low": 1e-4, "log": True, "when": {"selection": ["tournament"]}} and search.read_yaml("") == {}
    for bad in ("a:\n  type: other\n", "just words\n", "a: 1\n   b: 2\n"):
        (tmp_path / "s.yaml").write_text(bad)
        with pytest.raises(ValueError):
            search.load_space(f"{tmp_path}/s.yaml")


def test_fan_out(spark, table):
    def work(name, df):
        if name == "bad":
            raise RuntimeError("broken")
        return df.count()

    out = {r.dataset: (r.mean_test_score, r.error) for r in studies.fan_out({"a": table, "b": table.limit(7), "bad": table}, work).collect()}
    assert out == {"a": (300.0, None), "b": (7.0, None), "bad": (None, "RuntimeError: broken")}


def test_decision_tree_on_the_same_folds(spark, table):
    config = ExperimentConfig(TrainerConfig(SMALL, 2, 1), num_runs=1, n_folds=2)
    mine = {(r.run, r.fold): r for r in experiment.run_experiment(table, "id", "target", config, ("kind",)).collect()}
    tree = {(r.run, r.fold): r for r in studies.decision_tree_scores(table, "id", "target", config, ("kind",)).collect()}
    assert set(mine) == set(tree)
    for k, r in tree.items():
        assert r.tp + r.fn == mine[k].test[0] + mine[k].test[2] and r.tp + r.fp + r.fn + r.tn == sum(mine[k].test) and r.f1 > 0.8


def test_timings(spark):
    now = iter(range(100))
    timings = studies.Timings(clock=lambda: float(next(now)))
    with timings.step("outer"):
        for _ in range(2):
            with timings.step("inner"):
                pass
    rows = {r.step: (r.calls, r.own, r.elapsed) for r in timings.table(spark).collect()}
    assert rows == {"outer": (1, 3.0, 5.0), "inner": (2, 2.0, 2.0)}
    bits = np.random.default_rng(1).random((30, 4)) < 0.5
    table = studies.profile_training(Matrix(bits, bits[:, 0]), TrainerConfig(SMALL, 3), np.random.default_rng(1)).table(spark).collect()
    assert {r.step: r.calls for r in table} == {"construct": 1, "Evolution.step": 3, "Evolution.vary": 3, "Evolution.score": 3, "Evolution.settle": 3}
    assert [r.own for r in table] == sorted((r.own for r in table), reverse=True)
