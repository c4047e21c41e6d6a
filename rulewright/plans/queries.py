"""The rule engine's queries: each operator over whole tables. plans/oracle.py has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rulewright.functions.rules import POSTFIX, And, Lit, Or, Rule, parse, swap
from rulewright.operators import ordered, population, sampling, scoring, tree_bins
from rulewright.operators.binarize import Binarizer, quantile_edges
from rulewright.operators.population import BestLiteralStrategy, RandomStrategy
from rulewright.operators.sampling import Sampling
from rulewright.operators.scoring import LABEL, WEIGHT, collect, compress
from rulewright.operators.selection import RouletteSelection, TournamentSelection
from rulewright.operators.variation import AddLiteral, Crossover, Delete, MutationError, Negate, PromoteLiteral, RemoveOperator, ReplaceLiteral, ReplaceOperator
from rulewright.plans import evolve, experiment, reports, results
from rulewright.plans.configs import EvolutionConfig, ExperimentConfig, TrainerConfig
from rulewright.sources.tables import payments, with_label

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLAG = "l_returnflag"

#: Rules over f0 to f19 (five bins of each number) and f20 to f22 (return flags A, N, R).
RULES: list[Rule] = [
    Lit(0),
    Lit(20, True),
    And((Lit(4), Lit(10, True))),
    Or((And((Lit(4), Lit(10, True))), Lit(22))),
    And((Lit(0), Or((Lit(21, True), Lit(7)))), True),
    Or((Lit(20, True), And((Lit(3), Lit(12, True), Lit(16)), True), Lit(19))),
    And((Lit(1), Lit(1, True))),
    Or((Lit(1), Lit(1, True))),
]
#: Epochs of a fixed series for reports: one row an epoch of each run.
SERIES_ROWS = 12


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _lineitem(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(*NUMBERS, FLAG, (F.col("l_linestatus") == "F").alias(LABEL))


def _binarized(spark, sf_dir) -> DataFrame:
    return Binarizer(5).fit_transform(_lineitem(spark, sf_dir), None, (FLAG,), (LABEL,))[0]


def _compressed(spark, sf_dir) -> DataFrame:
    return compress(_binarized(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binarize, compress, score rules, best first."""
    return scoring.population_table(_compressed(spark, sf_dir), RULES, wide=True).orderBy(F.desc("f1"), "rule_id")


def load_target(spark, sf_dir):
    df = _read(spark, sf_dir, "labels").withColumnRenamed("toxic", "target")
    return with_label(df)


def typed_ingest(spark, sf_dir):
    """Line items as a payments log."""
    zero = lambda c, when: F.when(when, 0.0).otherwise(F.col(c)).cast("float")
    log = _read(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("step"), F.col("l_returnflag").alias("type"), F.col("l_extendedprice").cast("float").alias("amount"),
        zero("l_quantity", F.col("l_discount") < 0.03).alias("oldbalanceOrg"), zero("l_tax", F.col("l_discount") < 0.05).alias("newbalanceOrig"),
        zero("l_discount", F.col("l_quantity") < 10).alias("oldbalanceDest"), zero("l_quantity", F.col("l_quantity") < 20).alias("newbalanceDest"),
        (F.col("l_linestatus") == "F").cast("int").alias("isFraud"),
    )
    return payments(log)


def bool_passthrough(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderkey", (F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice") > 150000)).alias("big"))
    model = Binarizer().fit(df, keep=("o_orderkey",))
    return model.transform(df, ("o_orderkey",))


def onehot_category(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"))
    model = Binarizer().fit(df.where("priority != '5-LOW'"), None, ("priority",), ("o_orderkey",))  # 5-LOW is unseen, null is missing
    return model.transform(df, ("o_orderkey",))


def _edge_rows(spark, edges):
    return spark.createDataFrame([(c, i, float(e)) for c, es in edges.items() for i, e in enumerate(es[1:-1], 1)], "source_col string, i int, edge double")


def quantile_edges_q(spark, sf_dir):
    return _edge_rows(spark, quantile_edges(_lineitem(spark, sf_dir), dict.fromkeys(NUMBERS, 5)))


def quantile_onehot(spark, sf_dir):
    df = _read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return Binarizer(4).fit(df, keep=("c_custkey",)).transform(df, ("c_custkey",))


def bin_counts(spark, sf_dir):
    bits = _binarized(spark, sf_dir)
    row = bits.agg(*[F.count_if(f"f{i}").alias(f"f{i}") for i in range(23)])
    return row.select(F.posexplode(F.array(*[f"f{i}" for i in range(23)])).alias("feature", "n"))


def column_strategy_bins(spark, sf_dir):
    df = _read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return Binarizer(5, {"p_size": 3, "p_retailprice": 2}).fit(df, keep=("p_partkey",)).transform(df, ("p_partkey",))


def constant_column_bin(spark, sf_dir):
    df = _read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 != 0, 7.0).alias("x"))
    return Binarizer(5).fit(df, keep=("s_suppkey",)).transform(df, ("s_suppkey",))


def feature_dictionary(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderstatus", (F.col("o_totalprice") > 1000).alias("big"))
    return Binarizer(4, precision=2).fit(df, None, ("o_orderpriority", "o_orderstatus")).dictionary(spark).select("feature_id", "name", "source_col", "kind", "category")


def tree_root_split(spark, sf_dir):
    df = _lineitem(spark, sf_dir).withColumn("y", F.col(FLAG) == "R")
    counts = ordered.running(ordered.histogram(df, ["l_quantity"], label="y"), ordered.stretch_cuts(df, ["l_quantity"]))
    scores = tree_bins.boundary_gains(counts, tree_bins.roots(counts))
    best = scores.agg(F.max_by(F.struct("x", "gain"), F.struct(F.round("gain", 6), -F.col("x"))).alias("b")).select("b.*")
    after = counts.join(F.broadcast(best.select(F.col("x").alias("at"))), F.col("x") > F.col("at")).groupBy("at").agg(F.min("x").alias("next"))
    return best.join(F.broadcast(after), F.col("x") == F.col("at")).select(((F.col("x") + F.col("next")) / 2).alias("threshold"), F.round("gain", 6).alias("gain"))


def tree_bins_q(spark, sf_dir):
    df = _read(spark, sf_dir, "documents").select("doc_id", "n_chars").join(_read(spark, sf_dir, "labels"), "doc_id").withColumn("y", F.col("quality") == 1)
    return spark.createDataFrame([(i, float(t)) for i, t in enumerate(tree_bins.tree_edges(df, {"n_chars": 3}, "y")["n_chars"])], "i int, threshold double")


def _evaluated(spark, sf_dir, rules):
    bits = _binarized(spark, sf_dir)
    return bits.groupBy(*[r.to_column().alias(f"r{k}") for k, r in enumerate(rules)], LABEL).agg(F.count("*").alias("n"))


def literal_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, RULES[:2])


def and_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, [RULES[2], RULES[6]])


def or_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, [RULES[3], RULES[7]])


def nested_eval(spark, sf_dir):
    return _evaluated(spark, sf_dir, [RULES[5]])


def negated_operator(spark, sf_dir):
    return _evaluated(spark, sf_dir, [RULES[4], RULES[2].negate()])


def _postfix_table(spark):
    return spark.createDataFrame([(k, r.to_postfix()) for k, r in enumerate(RULES)], f"rule_id int, postfix {POSTFIX}")


def rule_postfix(spark, sf_dir):
    return _postfix_table(spark).select("rule_id", F.posexplode("postfix").alias("pos", "n")).select("rule_id", "pos", "n.op", "n.value", "n.negated", "n.arity")


def rule_complexity(spark, sf_dir):
    return spark.createDataFrame([(k, len(r)) for k, r in enumerate(RULES)], "rule_id int, complexity int")


def rule_remap(spark, sf_dir):
    mapping = {i: 100 + 2 * i for i in range(23)}
    return spark.createDataFrame([(k, str(r.remap(mapping))) for k, r in enumerate(RULES)], "rule_id int, rule string")


def compress_weights(spark, sf_dir):
    return _compressed(spark, sf_dir)


def confusion_raw(spark, sf_dir):
    return scoring.confusion(_binarized(spark, sf_dir), RULES[3]).select("tp", "fp", "fn", "tn")


def confusion_weighted(spark, sf_dir):
    return scoring.confusion(_compressed(spark, sf_dir), RULES[3]).select("tp", "fp", "fn", "tn")


def f1_score(spark, sf_dir):
    return scoring.confusion(_compressed(spark, sf_dir), RULES[5]).select("f1")


def accuracy_score(spark, sf_dir):
    return scoring.confusion(_compressed(spark, sf_dir), RULES[5]).select("accuracy")


def f1_empty_cases(spark, sf_dir):
    cases = _read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"))
    counts = cases.select("k", F.when(F.col("k") == 3, 2).otherwise(0).cast("long").alias("tp"), F.when(F.col("k") == 1, 4).otherwise(0).cast("long").alias("fp"), F.when(F.col("k") >= 2, 5).otherwise(0).cast("long").alias("fn"))
    return counts.select("k", scoring.f1_column(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def population_scores(spark, sf_dir):
    return scoring.population_table(_compressed(spark, sf_dir), RULES)


def population_scores_raw(spark, sf_dir):
    return scoring.population_table(_binarized(spark, sf_dir), RULES)


def population_topk(spark, sf_dir):
    return population_scores(spark, sf_dir).orderBy(F.desc("f1"), "rule_id").limit(3).select("rule_id", "rule", "f1")


def regularized_scores(spark, sf_dir):
    rows = sorted((r.rule_id, r.f1) for r in population_scores(spark, sf_dir).collect())  # a row a rule
    scores = evolve.regularized([s for _, s in rows], RULES, 0.01)
    return spark.createDataFrame([(k, round(float(s), 6)) for (k, _), s in zip(rows, scores, strict=True)], "rule_id int, score double")


def population_summary(spark, sf_dir):
    return population_scores(spark, sf_dir).agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.min("f1").alias("min_f1"), F.max("f1").alias("max_f1"))


def best_of_generation(spark, sf_dir):
    return population_scores(spark, sf_dir).agg(F.max_by("rule_id", F.struct(F.col("accuracy"), -F.col("rule_id"))).alias("rule_id"), F.max("accuracy").alias("accuracy"))


def literal_scores(spark, sf_dir):
    return population.literal_scores(_compressed(spark, sf_dir))


def best_literal(spark, sf_dir):
    return population.best_literal(_compressed(spark, sf_dir))


def feature_sample(spark, sf_dir):
    features = spark.range(23).select(F.col("id").cast("int").alias("feature_id"))
    return sampling.feature_subset(features, 6, seed=3)


def instance_partition(spark, sf_dir):
    n = _read(spark, sf_dir, "customer").count() // 4
    return sampling.instance_partition(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey", n, 3, seed=5)


def _orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").alias(LABEL))


def stratified_split(spark, sf_dir):
    return experiment.stratified_split(_orders(spark, sf_dir), "o_orderkey", LABEL, 0.2, 7)


def stratified_kfold(spark, sf_dir):
    return experiment.stratified_folds(_orders(spark, sf_dir), "o_orderkey", LABEL, 5, 7)


def _split_config(**more) -> ExperimentConfig:
    return ExperimentConfig(TrainerConfig(_small(), 3, 2), num_runs=2, n_folds=3, base_seed=11, **more)


def _marked(spark, sf_dir):
    return experiment.mark_runs(_orders(spark, sf_dir), "o_orderkey", _split_config())


def marked_runs(spark, sf_dir):
    """Which rows of each run are test rows, and the folds of the others."""
    return _marked(spark, sf_dir).select("run", "o_orderkey", "test", "fold")


def fold_edges(spark, sf_dir):
    """Edges of each run's and fold's training rows."""
    edges, _ = experiment.fit_folds(_marked(spark, sf_dir), ["o_totalprice"], {"o_totalprice": 5}, (), False, 3)
    rows = [(run, fit, i, round(e, 6)) for (run, fit, _), es in edges.items() for i, e in enumerate(sorted(es))]
    return spark.createDataFrame(rows, "run int, fold int, i int, edge double")


def fold_parts(spark, sf_dir):
    """Compressed rows of each run, fold and part, as an experiment trains on them."""
    rows = _marked(spark, sf_dir)
    folds, compressed = experiment.prepare_folds(rows, _split_config(supervised=False), ["o_totalprice"], ())
    task = spark.createDataFrame([(k, f.run, f.fold) for k, f in enumerate(folds)], "task int, run int, fold int")
    return compressed.join(F.broadcast(task), "task").select("run", "fold", "part", LABEL, F.col("codes")[0].alias("bin"), WEIGHT)


def fold_scores(spark, sf_dir):
    rows = stratified_kfold(spark, sf_dir).withColumn("pred", F.col("o_totalprice") > 100000)
    counts = rows.groupBy("fold").agg(*[c.alias(n) for n, c in scoring.confusion_columns(F.col("pred"), F.col(LABEL)).items()])
    return counts.select("*", scoring.f1_column(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def _fold_rows(spark, sf_dir):
    """A table of runs and folds: the validation score is null in each third fold."""
    s = fold_scores(spark, sf_dir).select(F.col("fold"), "f1", "tp", "fp", "fn", "tn")
    runs = s.withColumn("run", F.explode(F.array(*[F.lit(r) for r in range(3)])))
    return runs.select("run", "fold", "tp", "fp", "fn", "tn", F.when((F.col("fold") + F.col("run")) % 3 != 0, F.col("f1") + F.col("run") * 0.01).alias("best_val"), (F.col("f1") + 0.1).alias("best_train"))


def best_fold(spark, sf_dir):
    return results.best_folds(_fold_rows(spark, sf_dir)).select("run", "fold", F.round("best_val", 9).alias("best_val"))


def run_summary(spark, sf_dir):
    b = results.best_folds(_fold_rows(spark, sf_dir))
    return b.select("run", "fold", F.round("mean_val", 6).alias("mean_val"), F.round("mean_train", 6).alias("mean_train"), results.confusion_text(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")).alias("confusion"))


def experiment_summary(spark, sf_dir):
    return results.best_run(results.best_folds(_fold_rows(spark, sf_dir))).select("run", F.round("mean_val", 6).alias("mean_val"))


def trial_attributes(spark, sf_dir):
    folds = _fold_rows(spark, sf_dir)
    counts = F.array("tp", "fp", "fn", "tn")
    rows = folds.select("run", "fold", F.concat(F.lit("And(0, "), "fold", F.lit(")")).alias("best_rule"), "best_val", "best_train", (F.col("best_train") - 0.2).alias("test_score"), counts.alias("val"), counts.alias("test"))
    found = results.attributes(rows)
    return found.select(*[F.round(c, 6).alias(c) for c in ("train_mean", "train_std", "val_mean", "val_std", "test_mean", "test_std")], "best_run", "best_fold", "rule", F.array_join(F.transform("test_scores", lambda x: F.round(x, 6).cast("string")), ",").alias("tests"), F.col("val_counts")[0][0].alias("first_tp"))


def run_statistics(spark, sf_dir):
    return results.statistics(_fold_rows(spark, sf_dir), "best_train", ("run",))


def box_stats(spark, sf_dir):
    return results.statistics(_read(spark, sf_dir, "events").where("value is not null"), "value", ("event_type",))


def roulette_probabilities(spark, sf_dir):
    rows = population_scores(spark, sf_dir).select("rule_id", (F.col("f1") - 0.5).alias("s"))
    ps = sorted((r.rule_id, r.s) for r in rows.collect())  # a row a rule
    chances = RouletteSelection.chances([s for _, s in ps])
    return spark.createDataFrame([(k, round(float(c), 6)) for (k, _), c in zip(ps, chances, strict=True)], "rule_id int, chance double")


def tournament_probabilities(spark, sf_dir):
    return spark.createDataFrame([(i, round(float(c), 6)) for i, c in enumerate(TournamentSelection(10, 0.4).seats)], "seat int, chance double")


SCORES = [0.2, 0.8, 0.5, 0.5, 0.9, 0.1, 0.4, 0.7]  # four rules of the population, then four offspring
PARENTS = [(0, 3), (1, 5), (0, 1), (2, 4)]  # of each offspring; the first four places are lent: two children, two rules each


def feedback_signal(spark, sf_dir):
    found = evolve.feedback_signals(SCORES, 4, PARENTS, 4)
    return spark.createDataFrame([(k // 2, k % 2, round(float(f), 6)) for k, f in enumerate(found)], "population int, place int, feedback double")


def feedback_apply(spark, sf_dir):
    found = evolve.feedback_signals(SCORES, 4, PARENTS, 4).reshape(2, 2)
    kinds = {kind: [evolve.apply_feedback(SCORES, f, kind, 0.5) for f in found] for kind in ("additive", "multiplicative")}
    rows = [(c, i, round(float(kinds["additive"][c][i]), 6), round(float(kinds["multiplicative"][c][i]), 6)) for c in range(2) for i in range(len(SCORES))]
    return spark.createDataFrame(rows, "population int, i int, additive double, multiplicative double")


#: Rule, path, mutation, and what comes out (null: it can't be made). Trees of six features; replacing is between two, or two types.
MUTATION_CASES = [
    ("delete a child", "Or(0, And(1, 2), 3)", (0,), Delete(), "Or(And(1, 2), 3)"),
    ("delete one of two", "Or(0, And(1, 2), 3)", (1, 1), Delete(), "Or(0, 3, 1)"),
    ("delete an operator", "Or(0, ~And(1, 2), 3)", (1,), Delete(), "Or(0, 3)"),
    ("delete the root", "And(0, 1)", (), Delete(), None),
    ("delete a child of a root with two", "And(0, Or(1, 2))", (0,), Delete(), None),
    ("negate a literal", "And(0, ~1)", (1,), Negate(), "And(0, 1)"),
    ("negate the root", "And(0, 1)", (), Negate(), "~And(0, 1)"),
    ("replace a literal", "And(0, ~1)", (1,), ReplaceLiteral(2), "And(0, ~0)"),
    ("remove an operator", "Or(1, And(2, 3), 4)", (1,), RemoveOperator(), "Or(1, 4, 2, 3)"),
    ("remove a negated operator", "~Or(1, ~And(2, 3))", (1,), RemoveOperator(), "~Or(1, 2, 3)"),
    ("remove the root", "Or(1, 2)", (), RemoveOperator(), None),
    ("replace an operator", "Or(1, ~And(2, 3))", (1,), ReplaceOperator(), "Or(1, ~Or(2, 3))"),
    ("replace the root", "Or(1, 2)", (), ReplaceOperator(), "And(1, 2)"),
    ("add a literal to all", "And(0, 1, Or(2, 3))", (), AddLiteral(2), None),
]


def mutation_cases(spark, sf_dir):
    def outcome(rule, path, mutation):
        try:
            return str(mutation.apply(parse(rule), path, np.random.default_rng(0)))
        except MutationError:
            return None

    return spark.createDataFrame([(name, rule, outcome(rule, path, m)) for name, rule, path, m, _ in MUTATION_CASES], "name string, rule string, outcome string")


def random_mutations(spark, sf_dir):
    """What holds for every draw: of 200 promoted and extended rules, how many have the old literal first, a new feature, and two or one nodes more."""
    rng, rule = np.random.default_rng(5), parse("And(3, ~1, Or(0, 2))")
    promoted = [PromoteLiteral(6).apply(rule, (1,), rng).at((1,)) for _ in range(200)]
    added = [AddLiteral(6).apply(rule, (), rng) for _ in range(200)]
    kept = sum(str(r.children[0]) == "~1" and len(r.children) == 2 and r.children[1].value != 1 for r in promoted)
    fresh = sum(str(r).startswith("And(3, ~1, Or(0, 2), ") and r.children[3].value not in (3, 1) and len(r) == len(rule) + 1 for r in added)
    return spark.createDataFrame([(kept, fresh, len({type(r) for r in promoted}), len({r.negated for r in promoted}))], "kept int, fresh int, kinds int, signs int")


#: Two rules, a node of each, and both trees with these exchanged.
SWAP_CASES = [
    ("And(0, Or(1, 2))", (1,), "Or(3, ~4)", (1,), "And(0, ~4)", "Or(3, Or(1, 2))"),
    ("And(0, Or(1, 2))", (), "Or(3, ~4)", (0,), "3", "Or(And(0, Or(1, 2)), ~4)"),
    ("~And(0, 1)", (0,), "~Or(2, 3)", (), "~And(~Or(2, 3), 1)", "0"),
]


def crossover_cases(spark, sf_dir):
    """Exchanged subtrees, the second rule's features renamed first."""
    names = {k: k + 10 for k in range(6)}
    rows = []
    for k, (a, at, b, to, _, _) in enumerate(SWAP_CASES):
        one, two = swap(parse(a), at, parse(b).remap(names), to)
        rows.append((k, str(one), str(two)))
    return spark.createDataFrame(rows, "k int, one string, two string")


def crossover_pairs(spark, sf_dir):
    """Pairs of 41 rules that all mate: 20, no rule twice; children of each and their parents."""
    rules, crossover = [Lit(k) for k in range(41)], Crossover(1.0)
    children, parents = crossover.apply(rules, np.random.default_rng(3))
    apart = len({int(p) for p in parents.ravel()})
    right = sum({c.value for c in children[i : i + 2]} == set(map(int, parents[i])) for i in range(0, len(children), 2))
    return spark.createDataFrame([(len(children), apart, right)], "children int, apart int, exchanged int")


def progress_cases(spark, sf_dir):
    """A population's memory over a series of best scores: the best rule (later ones of equals), and epochs without progress."""
    node = evolve.Population("root", 0, None, None, None, None)
    rows = []
    for epoch, score in enumerate([0.3, 0.5, 0.5, 0.4, 0.4, 0.6, 0.2]):
        node.rules, node.scores = [Lit(epoch)], np.array([score])
        node.remember(0)
        rows.append((epoch, str(node.best), node.best_score, node.stale))
    return spark.createDataFrame(rows, "epoch int, best string, best_score double, stale int")


def fold_metrics(spark, sf_dir):
    """Best scores of folds, from their generations: scores of thirteen epochs of two runs and three folds, some not validated."""
    series = _series(spark, sf_dir).select((F.col("epoch") % 2).cast("int").alias("run"), (F.col("epoch") % 3).cast("int").alias("fold"), "epoch", F.col("score").alias("train_score"), F.when(F.col("epoch") % 5 == 0, F.col("score") - 1).alias("val_score"))
    return results.fold_metrics(series)


def _series(spark, sf_dir):
    """Each customer segment's largest balances, in order of key: series with ups and downs."""
    return _read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("series"), F.col("c_custkey").alias("epoch"), F.col("c_acctbal").alias("score"))


def ema(spark, sf_dir):
    # A share that is no binary fraction, so that no value lies midway between two roundings.
    return reports.moving_average(_series(spark, sf_dir), ["series"], "epoch", "score", span=13)


def regeneration_marks(spark, sf_dir):
    return reports.regeneration_marks(_series(spark, sf_dir), ["series"], "epoch", "score", 5)


def band_stats(spark, sf_dir):
    return reports.band(_read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", top=10)


def peak_epoch(spark, sf_dir):
    return reports.peak_epoch(_series(spark, sf_dir), ["series"], "epoch", "score")


def rank_picks(spark, sf_dir):
    return reports.rank_picks(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


def top_children(spark, sf_dir):
    return reports.top_children(_series(spark, sf_dir), 3, "series", "score")


def _result_tables(spark, sf_dir):
    li = _read(spark, sf_dir, "orders")
    one = li.groupBy(F.col("o_custkey").alias("dataset")).agg((F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("mean_test_score"))
    two = li.where("o_totalprice > 50000").groupBy(F.col("o_custkey").alias("dataset")).agg((F.count_if(F.col("o_orderpriority") <= "3-MEDIUM") / F.count("*")).alias("mean_test_score"))
    return {"a": one, "b": two}


def results_join(spark, sf_dir):
    return reports.join_results(_result_tables(spark, sf_dir))


def key_difference(spark, sf_dir):
    """Customers with orders of just one of two kinds."""
    of = lambda kind: _read(spark, sf_dir, "orders").where(F.col("o_orderpriority") == kind).select(F.col("o_custkey").alias("dataset"))
    return reports.key_difference(of("1-URGENT"), of("5-LOW"))


def best_or_tied(spark, sf_dir):
    return reports.best_or_tied(results_join(spark, sf_dir), ["a", "b"])


def binary_datasets(spark, sf_dir):
    from rulewright.sources.tables import binary_datasets as pick

    kinds = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.count_distinct(F.when(F.col("o_orderpriority") < "3", F.col("o_orderstatus")).otherwise(F.when(F.col("o_orderstatus") == "F", "x").otherwise("y"))).alias("n_classes"))
    return pick(kinds)


def _small(**more) -> EvolutionConfig:
    return EvolutionConfig(population_size=40, strategies=(RandomStrategy(), BestLiteralStrategy(0.5, 0.5)), max_complexity=100, feedback="additive", **more)


def _planted(spark, sf_dir):
    """The binarized line items with a label that an exact rule has."""
    planted = Or((And((Lit(4), Lit(10, True))), Lit(22)))
    return compress(_binarized(spark, sf_dir).withColumn(LABEL, planted.to_column()))


GENERATIONS = T.StructType([T.StructField("path", T.StringType()), T.StructField("epoch", T.IntegerType()), T.StructField("best_rule", T.StringType()), T.StructField("best_score", T.DoubleType())])


def _evolved(spark, sf_dir, config, epochs):
    held = collect(_planted(spark, sf_dir))
    if held is None:
        raise ValueError("too many compressed rows for the driver: train by run_experiment, which scores such tables on Spark")
    history = experiment.train(held, TrainerConfig(config, epochs), np.random.default_rng(4))
    return spark.createDataFrame([(g.path, g.epoch, g.best_rule, float(max(g.train_scores))) for top in history.generations for g in top.flat()], GENERATIONS)


def evolve_flat(spark, sf_dir):
    return _evolved(spark, sf_dir, _small(), 30)


def evolve_hierarchical(spark, sf_dir):
    return _evolved(spark, sf_dir, _small(max_depth=1, num_children=3, sampling=Sampling(0.5), top_k=5), 15)


def experiment_end_to_end(spark, sf_dir):
    df = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("target"))
    config = ExperimentConfig(TrainerConfig(_small(), 5, 2), num_runs=2, n_folds=2)
    return experiment.run_experiment(df, "o_orderkey", "target", config, ("o_orderpriority",)).drop("generations")


def experiment_parts(spark, sf_dir):
    """How many rows, and positive ones, each run and fold trained on, was validated on and tested on."""
    df = _orders(spark, sf_dir).withColumnRenamed(LABEL, "target")
    out = experiment.run_experiment(df, "o_orderkey", "target", _split_config())
    rows = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    there = lambda c: F.col(c)[0] + F.col(c)[2]
    return out.select("run", "fold", *[x for c in ("train", "val", "test") for x in (rows(c).alias(f"{c}_rows"), there(c).alias(f"{c}_true"))])


def rule_predict(spark, sf_dir):
    from rulewright.streaming.score import predict

    df = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    model = Binarizer(4).fit(df, None, ("o_orderpriority",), ("o_orderkey",))
    return predict(df, model, Or((And((Lit(0), Lit(4, True))), Lit(8)))).select("o_orderkey", "pred")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plain = [
        load_target, typed_ingest, bool_passthrough, onehot_category, quantile_onehot, bin_counts, column_strategy_bins, constant_column_bin, feature_dictionary, tree_root_split,
        literal_eval, and_eval, or_eval, nested_eval, negated_operator, rule_postfix, rule_complexity, rule_remap, compress_weights, confusion_raw, confusion_weighted, f1_score, accuracy_score, f1_empty_cases,
        population_scores, population_scores_raw, population_topk, regularized_scores, population_summary, best_of_generation, literal_scores, best_literal, feature_sample, instance_partition,
        stratified_split, stratified_kfold, fold_edges, fold_scores, best_fold, run_summary, experiment_summary, trial_attributes, run_statistics, box_stats, roulette_probabilities, tournament_probabilities,
        feedback_signal, feedback_apply, mutation_cases, random_mutations, crossover_cases, crossover_pairs, progress_cases, fold_metrics, marked_runs, fold_parts, experiment_parts, ema, regeneration_marks, band_stats, peak_epoch, rank_picks, top_children, results_join, key_difference, best_or_tied, binary_datasets, rule_predict,
        evolve_flat, evolve_hierarchical, experiment_end_to_end,
    ]
    return {"flagship": flagship, "quantile_edges": quantile_edges_q, "tree_bins": tree_bins_q} | {f.__name__: f for f in plain}
