"""Rules, bins, scores and evolution against plain computations and known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulewright.functions.rules import And, Lit, Or, complexity_check, from_postfix, is_operator, parse, pick_node, swap
from rulewright.operators import scoring, tree_bins
from rulewright.operators.binarize import Binarizer, bin_name, finish_edges, quantile_edges, unique_name
from rulewright.operators.population import BestLiteralStrategy, PopulationGenerator, RandomStrategy, best_literal
from rulewright.operators.sampling import Sampling, allocate
from rulewright.operators.scoring import Matrix, collect, compress, population_table
from rulewright.operators.selection import RouletteSelection, TournamentSelection
from rulewright.operators.variation import AddLiteral, Crossover, Delete, MutationError, Mutator, Negate, PromoteLiteral, RemoveOperator, ReplaceLiteral, ReplaceOperator
from rulewright.plans import experiment, search
from rulewright.plans.configs import EvolutionConfig, ExperimentConfig, TrainerConfig, validate_evolution
from rulewright.plans.evolve import Evolution, apply_feedback, feedback_signals

NESTED = And((Lit(0), Or((Lit(1, True), Lit(2))), Lit(3)))


def random_rule(rng, n, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return Lit(int(rng.integers(n)), bool(rng.integers(2)))
    return (And, Or)[rng.integers(2)](tuple(random_rule(rng, n, depth - 1) for _ in range(rng.integers(2, 4))), bool(rng.integers(2)))


def test_rendering():
    assert str(NESTED) == "And(0, Or(~1, 2), 3)" and len(NESTED) == 6 and len(And((Lit(1), Or((Lit(2), Lit(3)))))) == 5
    assert And((Lit(1), Lit(2)), True).to_str({1: "good", 2: "nice"}) == "~And(good, nice)"
    assert And((Lit(1), Or((Lit(2), Lit(3))))).to_str(indent=0) == "And(\n\t1,\n\tOr(\n\t\t2,\n\t\t3\n\t)\n)"
    assert str(And((Lit(0), Lit(1))).remap({0: 5, 1: 10})) == "And(5, 10)" and NESTED.remap(None) is NESTED
    with pytest.raises(KeyError):
        NESTED.remap({0: 1})
    assert [str(n) for n in And((Lit(0), Lit(1))).flatten()] == ["And(0, 1)", "1", "0"]


def test_round_trips_and_evaluation(spark):
    rng = np.random.default_rng(1)
    data = rng.random((40, 5)) < 0.5
    table = spark.createDataFrame([(i, *map(bool, r)) for i, r in enumerate(data)], "i int, " + ", ".join(f"f{k} boolean" for k in range(5)))
    rules = [random_rule(rng, 5) for _ in range(20)]
    for r in rules:
        assert parse(str(r)) == r and from_postfix(r.to_postfix()) == r
        assert all(r.at(p) == n for p, n in r.walk())
    got = table.select("i", *[r.to_column().alias(f"c{k}") for k, r in enumerate(rules)], *[F.expr(r.to_sql()).alias(f"s{k}") for k, r in enumerate(rules)]).orderBy("i").toPandas()
    for k, r in enumerate(rules):
        assert (got[f"c{k}"] == r.evaluate(data)).all() and (got[f"s{k}"] == r.evaluate(data)).all()
    assert not And((Lit(1), Lit(1, True))).evaluate(data).any() and Or((Lit(1), Lit(1, True))).evaluate(data).all()


def test_node_choice():
    rng = np.random.default_rng(2)
    hits = sum(is_operator(NESTED.at(pick_node(NESTED, rng))) for _ in range(500))
    assert hits > 400 and pick_node(Lit(0), rng) == ()
    assert swap(NESTED, (1,), Lit(9), ()) == (And((Lit(0), Lit(9), Lit(3))), NESTED.at((1,)))
    assert complexity_check(5)(Lit(0)) and not complexity_check(5)(NESTED)


def test_binarizer(spark):
    df = spark.createDataFrame([(True, "a", 10.0), (False, "b", 20.0), (True, "a", 30.0), (False, "b", 40.0), (None, None, None), (True, "c", float("nan"))], "flag boolean, color string, val double")
    model = Binarizer(2).fit(df.where("val < 50"), None, ("color",))
    assert list(model.names().values()) == ["flag", "color=a", "color=b", "val < 25.000", "25.000 <= val"]
    rows = [tuple(r) for r in model.transform(df).collect()]
    assert rows[0] == (True, True, False, True, False) and rows[4] == (False,) * 5 and rows[5] == (True, False, False, False, False)
    with pytest.raises(RuntimeError):
        model.transform(df.select("color", "flag", "val"))
    with pytest.raises(ValueError):
        Binarizer().fit(df)
    flag = spark.createDataFrame([(True, 1), (False, 2), (True, 3)], "flag boolean, val int")
    table, model = Binarizer(2).fit_transform(flag)
    assert [r.f1 for r in table.collect()] == [True, True, False]
    assert quantile_edges(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double"), {"x": 2}) == {"x": [-np.inf, 2.5, np.inf]}
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    table, model = Binarizer().fit_transform(same)
    assert model.names() == {0: "x < inf"} and [r.f0 for r in table.collect()] == [True, True, False]
    assert bin_name("x", 1.0, 3.0, 2) == "1.00 <= x < 3.00" and unique_name("col", {"col", "col_0"}) == "col_1"
    for bad in ({"num_bins": 1}, {"precision": -1}, {"column_strategy": {"a": 1}}):
        with pytest.raises(ValueError):
            Binarizer(**bad)


def brute_tree(x, y, leaves):
    """Best-first growth by trying every boundary of every leaf."""
    parts, cuts = [sorted(zip(x, y, strict=True))], []
    gini = lambda p: len(p) - (sum(b for _, b in p) ** 2 + (len(p) - sum(b for _, b in p)) ** 2) / len(p)
    while len(parts) < leaves:
        best = None
        for k, p in enumerate(parts):
            for i in range(1, len(p)):
                if p[i - 1][0] < p[i][0] and len({b for _, b in p}) == 2:
                    gain = gini(p) - gini(p[:i]) - gini(p[i:])
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, k, i)
        if best is None:
            break
        _, k, i = best
        p = parts.pop(k)
        cuts.append((p[i - 1][0] + p[i][0]) / 2)
        parts[k:k] = [p[:i], p[i:]]
    return sorted(cuts)


def test_tree_bins(spark):
    rng = np.random.default_rng(3)
    for _ in range(4):
        x, y = rng.integers(0, 30, 60).astype(float), rng.integers(0, 2, 60).astype(bool)
        df = spark.createDataFrame(list(zip(map(float, x), map(bool, y), strict=True)), "x double, y boolean")
        assert tree_bins.tree_edges(df, {"x": 4}, "y")["x"] == brute_tree(x, y, 4)
    two = spark.createDataFrame([(-3.0, True), (-1.0, False)], "x double, y boolean")
    assert finish_edges(tree_bins.tree_edges(two, {"x": 5}, "y")["x"]) == [-np.inf, -2.0, np.inf]


def test_scores(spark):
    t, f = True, False
    assert scoring.confusion_matrix([t, t, f, f], [t, f, t, f]) == (1, 1, 1, 1) and scoring.confusion_matrix([t, t, f], [t, f, f], [2, 3, 1]) == (2, 3, 0, 1)
    assert scoring.f1_score([t, t, f, f], [t, f, f, t]) == 0.5 and scoring.f1_score([f, f], [f, f]) == 1.0 and scoring.f1_score([t], [f]) == 0.0 == scoring.f1_score([f], [t])
    rng = np.random.default_rng(4)
    bits = rng.random((300, 6)) < 0.4
    df = spark.createDataFrame([tuple(map(bool, r)) for r in bits], ", ".join(f"f{k} boolean" for k in range(5)) + ", label boolean")
    rules, matrix = [random_rule(rng, 5) for _ in range(12)], collect(df)
    small = compress(df)
    assert small.agg(F.sum("w")).first()[0] == 300 and (collect(small).data == matrix.compressed().data).all()
    for table, wide in ((df, False), (small, False), (small, True)):
        for row in population_table(table, rules, wide).collect():
            counts = scoring.confusion_matrix(rules[row.rule_id].evaluate(matrix.data), matrix.label)
            assert (row.tp, row.fp, row.fn, row.tn) == counts and row.f1 == pytest.approx(scoring.f1_of(*counts)) and row.accuracy == pytest.approx(scoring.accuracy_of(*counts))
    spark_scores, here = scoring.Scorer(small)(rules), scoring.Scorer(matrix.compressed())(rules)
    assert np.allclose(spark_scores, here) and np.allclose(here, scoring.Scorer(matrix)(rules))
    best = best_literal(small).first()
    assert best.f1 == pytest.approx(max(scoring.Scorer(matrix)([Lit(k, n) for k in range(5) for n in (False, True)])))
    with pytest.warns(UserWarning):
        assert scoring.prepare(matrix, lambda p, y: 0.5) is matrix


def test_mutations():
    rule, rng = Or((Lit(0), And((Lit(1), Lit(2))), Lit(3))), np.random.default_rng(5)
    assert str(Delete().apply(rule, (1, 1))) == "Or(0, 3, 1)" and str(RemoveOperator().apply(Or((Lit(1), And((Lit(2), Lit(3))), Lit(4))), (1,))) == "Or(1, 4, 2, 3)"
    for mutation, tree, path in ((Delete(), rule, ()), (Delete(), And((Lit(0), Lit(1))), (0,)), (RemoveOperator(), rule, ()), (AddLiteral(2), And((Lit(0), Lit(1))), ())):
        with pytest.raises(MutationError):
            mutation.apply(tree, path, rng)
    assert str(Negate().apply(rule, (1,))) == "Or(0, ~And(1, 2), 3)" and str(ReplaceOperator().apply(rule, (), rng)) == "And(0, And(1, 2), 3)"
    assert ReplaceLiteral(2).apply(Lit(0, True), (), rng) == Lit(1, True) and len(PromoteLiteral(4).apply(rule, (0,), rng)) == len(rule) + 2
    assert {c.value for c in AddLiteral(3).apply(And((Lit(0), Lit(1))), (), rng).children} == {0, 1, 2}
    valid = complexity_check(7)
    mutator = Mutator(6, 0.9, 3, valid=valid)
    rules = [rule] * 200
    assert all(valid(r) for r in mutator.apply(rules, rng)) and mutator.apply([], rng) == []
    children, parents = Crossover(1.0, num_tries=3, valid=valid).apply(rules, rng)
    assert all(map(valid, children)) and parents.shape == (len(children), 2)
    with pytest.raises(ValueError):
        Crossover(strategy="best")


def test_selection_and_populations():
    rng, rules = np.random.default_rng(6), [Lit(k) for k in range(12)]
    scores = np.arange(12) / 12
    chosen, values = TournamentSelection(5, 0.8).select(rules, scores, 1000, rng)
    assert values.mean() > 0.7 and all(scores[r.value] == v for r, v in zip(chosen, values, strict=True)) and TournamentSelection().seats.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        TournamentSelection(13).select(rules, scores, 1, rng)
    assert RouletteSelection.chances([-1, 0, 1]).tolist() == pytest.approx([0, 1 / 3, 2 / 3]) and RouletteSelection.chances([0, 0]).tolist() == [0.5, 0.5]
    bits = rng.random((50, 6)) < 0.5
    data = Matrix(bits, bits[:, 3])
    assert BestLiteralStrategy().generate(2, data, rng) == [Lit(3)] * 2
    population = PopulationGenerator([RandomStrategy(), BestLiteralStrategy(0.5, 0.5)], 30, rng=rng).generate(data)
    assert len(population) == 30 and all(len(set(r.features())) == 2 for r in population if is_operator(r))
    parts = allocate(10, 40, 3, False, rng)
    assert len(set(np.concatenate(parts).tolist())) == 30 and all(len(set(p.tolist())) == 30 for p in allocate(30, 40, 3, False, rng))
    for s in Sampling(0.25, 0.5).sample(data, 4, rng):
        assert s.matrix.data.shape == (25, 2) and (s.matrix.data == bits[np.ix_(s.rows, s.features)]).all()


def test_feedback():
    assert apply_feedback([1.0, 2.0], np.array([0.4]), "additive", 0.5).tolist() == [1.2, 2.0] and apply_feedback([2.0], np.array([0.4]), "multiplicative", 0.5).tolist() == [2.4]
    assert not feedback_signals(np.ones(6), 4, np.array([[0, 1], [1, 0]]), 2).any()


def test_planted_rule(spark, data):
    from rulewright.plans.queries import _planted

    matrix = collect(_planted(spark, data))
    for more in ({}, {"max_depth": 1, "num_children": 2, "sampling": Sampling(0.5), "top_k": 5}):
        history = experiment.train(matrix, TrainerConfig(EvolutionConfig(population_size=80, strategies=(RandomStrategy(), BestLiteralStrategy(0.5, 0.5)), max_complexity=100, regeneration=True, regeneration_patience=30, **more), 60, 20), np.random.default_rng(1), matrix)
        assert history.best_train() > 0.85 > history.generations[0].train_scores[0] and history.best_val() is not None and len(history) == 60


def test_same_seed_same_rules():
    rng = np.random.default_rng(7)
    bits = rng.random((60, 6)) < 0.5
    matrix = Matrix(bits, bits[:, 0] | bits[:, 1])
    runs = [[Evolution(matrix, EvolutionConfig(population_size=20), np.random.default_rng(s)).step().best_rule for s in (1, 2)] for _ in range(2)]
    assert runs[0] == runs[1]
    with pytest.raises(ValueError):
        validate_evolution(EvolutionConfig(crossover_strategy="best"))


def test_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).alias("label"))
    split = experiment.stratified_split(df, "id", "label", 0.2, 1)
    assert {(r.label, r.test): r["count"] for r in split.groupBy("label", "test").count().collect()} == {(True, True): 50, (True, False): 200, (False, True): 150, (False, False): 600}
    folds = experiment.stratified_folds(df, "id", "label", 5, 1).groupBy("label", "fold").count().collect()
    assert {r["count"] for r in folds} == {50, 150} and len(folds) == 10


def test_experiment(spark):
    words = ["TFTF", "FTFT", "TTFF", "FFTT", "TFFT", "FTTF", "TTTF", "FFFT"] * 4
    df = spark.createDataFrame([(i, *(c == "T" for c in w), w[0] == "T") for i, w in enumerate(words)], "id int, a boolean, b boolean, c boolean, d boolean, target boolean")
    config = ExperimentConfig(TrainerConfig(EvolutionConfig(population_size=20, strategies=(BestLiteralStrategy(), RandomStrategy())), 5, 1), num_runs=2, n_folds=2)
    out = experiment.run_experiment(df, "id", "target", config).cache()
    rows = out.collect()
    assert len(rows) == 4 and all(len(r.generations) == 5 and r.test_score == 1.0 for r in rows) and str(experiment.best_rule(out))


def test_search(spark, tmp_path):
    path = f"{tmp_path}/study"
    out = search.search(spark, path, lambda p: p["mutation_p"], 3)
    assert out.count() == 3 and search.search(spark, path, lambda p: p["mutation_p"], 5, most=4).count() == 4
    assert 0 < search.best_trial(search.trials(spark, path))["mutation_p"] <= 0.5
    rng = np.random.default_rng(8)
    for _ in range(30):
        params = search.sample(search.DEFAULT_SPACE, rng)
        assert ("tournament_size" in params) == (params["selection"] == "tournament") and ("top_k" in params) == (params["max_depth"] > 0)
        validate_evolution(search.to_config(params).trainer.evolution)


def test_sources_and_streams(spark, tmp_path):
    from rulewright.sources import tables
    from rulewright.streaming.score import predict

    spark.createDataFrame([(1.0, True, 1), (2.0, False, 0), (3.0, True, 1), (4.0, False, 0)], "feat_a double, feat_b boolean, target int").write.option("header", True).csv(f"{tmp_path}/t.csv")
    df = tables.load_table(spark, f"{tmp_path}/t.csv")
    assert df.columns == ["feat_a", "feat_b", "label"] and df.where("label").count() == 2
    for path, error in (("none.csv", FileNotFoundError), ("t.csv/../t.txt", FileNotFoundError)):
        with pytest.raises(error):
            tables.load_table(spark, f"{tmp_path}/{path}")
    df.write.parquet(f"{tmp_path}/in")
    model = Binarizer(2).fit(df, keep=("label",))
    rule = Or((Lit(0), Lit(2, True)))
    stream = predict(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), model, rule)
    query = stream.writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("scored").collect())) == sorted(map(tuple, predict(df, model, rule).collect()))
