"""SQL for the queries, for DuckDB over the same tables."""

from __future__ import annotations

from rulewright.functions.rules import Rule
from rulewright.plans.queries import FLAG, MUTATION_CASES, NUMBERS, PARENTS, RULES, SCORES


def _edges(columns: list[str], bins: list[int], table: str, where: str = "true") -> str:
    lists = ", ".join(f"list_transform(quantile_cont({c}, [{', '.join(str(i / n) for i in range(1, n))}]), lambda v: round(v, 6)) AS e{k}" for k, (c, n) in enumerate(zip(columns, bins, strict=True)))
    return f"SELECT {lists} FROM {table} WHERE {where}"


def _bins(columns: list[str], bins: list[int], first: int = 0) -> str:
    out, at = [], first
    for k, (c, n) in enumerate(zip(columns, bins, strict=True)):
        for i in range(1, n + 1):
            tests = [f"{c} > e{k}[{i - 1}]"] * (i > 1) + [f"{c} <= e{k}[{i}]"] * (i < n)
            out.append(f"coalesce({' AND '.join(tests)}, false) AS f{at}")
            at += 1
    return ", ".join(out)


BITS = f"""e AS ({_edges(NUMBERS, [5] * 4, "lineitem")}),
b AS (SELECT l_linestatus = 'F' AS label, {_bins(NUMBERS, [5] * 4)}, {", ".join(f"{FLAG} = '{v}' AS f{20 + i}" for i, v in enumerate("ANR"))} FROM lineitem, e)"""
F1 = "CASE WHEN tp + fp = 0 AND tp + fn = 0 THEN 1.0 WHEN tp + fp = 0 OR tp + fn = 0 THEN 0.0 ELSE 2.0 * tp / ((tp + fp) + (tp + fn)) END"
ACC = "(tp + tn)::DOUBLE / (tp + fp + fn + tn)"


def _counts(pred: str, label: str = "label") -> str:
    return f"count_if(({pred}) AND {label}) AS tp, count_if(({pred}) AND NOT {label}) AS fp, count_if(NOT ({pred}) AND {label}) AS fn, count_if(NOT ({pred}) AND NOT {label}) AS tn"


def _evaluated(rules: list[Rule]) -> str:
    return f"WITH {BITS} SELECT {', '.join(f'{r.to_sql()} AS r{k}' for k, r in enumerate(rules))}, label, count(*) AS n FROM b GROUP BY ALL"


def _population(tail: str) -> str:
    each = " UNION ALL ".join(f"SELECT {k}::INTEGER AS rule_id, '{r}' AS rule, {len(r)}::INTEGER AS complexity, {_counts(r.to_sql())} FROM b" for k, r in enumerate(RULES))
    return f"WITH {BITS}, c AS ({each}), p AS (SELECT *, {F1} AS f1, {ACC} AS accuracy FROM c) {tail}"


def _ranked(seed: int) -> str:
    return f"r AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS label, row_number() OVER (PARTITION BY o_orderstatus = 'F' ORDER BY md5('{seed}|' || o_orderkey::VARCHAR), o_orderkey) AS rk, count(*) OVER (PARTITION BY o_orderstatus = 'F') AS total FROM orders)"


MARKED = """u AS (SELECT run::INTEGER AS run, o_orderkey, o_totalprice, o_orderstatus = 'F' AS label, row_number() OVER (PARTITION BY run, o_orderstatus = 'F' ORDER BY md5((11 + run)::VARCHAR || '|' || o_orderkey::VARCHAR), o_orderkey) AS rk,
count(*) OVER (PARTITION BY run, o_orderstatus = 'F') AS total FROM orders, range(2) g(run)), v AS (SELECT *, rk - ceil(round(total * 0.2, 6))::BIGINT AS pl FROM u), k AS (SELECT run, o_orderkey, o_totalprice, label, pl <= 0 AS test, CASE WHEN pl > 0 THEN ((pl - 1) % 3)::INTEGER END AS fold FROM v)"""
KFOLD = f"{_ranked(7)}, k AS (SELECT o_orderkey, o_totalprice, label, ((rk - 1) % 5)::INTEGER AS fold FROM r)"
FOLD_SCORES = f"{KFOLD}, c AS (SELECT fold, {_counts('o_totalprice > 100000')} FROM k GROUP BY fold), s AS (SELECT *, {F1} AS f1 FROM c)"
FOLD_ROWS = f"""{FOLD_SCORES}, fr AS (SELECT run::INTEGER AS run, fold, tp, fp, fn, tn, CASE WHEN (fold + run) % 3 != 0 THEN f1 + run * 0.01::DOUBLE END AS best_val, f1 + 0.1::DOUBLE AS best_train FROM s, range(3) g(run)),
bf AS (SELECT *, coalesce(avg(best_val) OVER (PARTITION BY run), 0.0) AS mean_val, avg(best_train) OVER (PARTITION BY run) AS mean_train, row_number() OVER (PARTITION BY run ORDER BY best_val DESC NULLS LAST, fold) AS k1 FROM fr QUALIFY k1 = 1)"""


def _stats(value: str, by: str, source: str) -> str:
    return f"SELECT {by}, round(avg({value}), 6) AS mean, round(stddev_pop({value}), 6) AS std, min({value}) AS min, max({value}) AS max, round(quantile_cont({value}, 0.5), 6) AS median, round(quantile_cont({value}, 0.25), 6) AS q1, round(quantile_cont({value}, 0.75), 6) AS q3, round(quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25), 6) AS iqr FROM {source} GROUP BY {by}"


def _postfix() -> str:
    rows = [f"({k}, {p}, '{op}', {'NULL' if v is None else v}, {str(neg).lower()}, {arity})" for k, r in enumerate(RULES) for p, (op, v, neg, arity) in enumerate(r.to_postfix())]
    return f"(VALUES {', '.join(rows)}) t(rule_id, pos, op, value, negated, arity)"


SERIES = "s AS (SELECT c_mktsegment AS series, c_custkey AS epoch, c_acctbal AS score, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS i FROM customer)"
TWO = """a AS (SELECT o_custkey AS dataset, count_if(o_orderstatus = 'F')::DOUBLE / count(*) AS a FROM orders GROUP BY 1),
bb AS (SELECT o_custkey AS dataset, count_if(o_orderpriority <= '3-MEDIUM')::DOUBLE / count(*) AS b FROM orders WHERE o_totalprice > 50000 GROUP BY 1)"""
TREE = """h AS (SELECT l_quantity AS x, count(*)::DOUBLE AS n, count_if(l_returnflag = 'R')::DOUBLE AS pos FROM lineitem GROUP BY 1),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(n) OVER (ORDER BY x) AS ln, sum(pos) OVER (ORDER BY x) AS lp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM h)"""
FEEDBACK = f"""sc AS (SELECT * FROM (VALUES {", ".join(f"({i}, {s}::DOUBLE)" for i, s in enumerate(SCORES))}) t(i, s)), pa AS (SELECT * FROM (VALUES {", ".join(f"({j}, {p})" for j, p in enumerate(x for pair in PARENTS for x in pair))}) t(j, parent)),
m AS (SELECT avg(s) AS mean, min(s) AS low, max(s) AS high FROM sc),
sg AS (SELECT i - 4 AS child, CASE WHEN s >= mean THEN (s - mean) / (high - mean) ELSE (s - mean) / (mean - low) END AS signal FROM sc, m WHERE i >= 4),
fb AS (SELECT (parent // 2)::INTEGER AS population, (parent % 2)::INTEGER AS place, round(avg(signal), 6) AS feedback, avg(signal) AS avg_signal FROM pa JOIN sg ON child = j // 2 WHERE parent < 4 GROUP BY ALL),
slots AS (SELECT c::INTEGER AS c, p::INTEGER AS p FROM range(2) a(c), range(2) b(p))"""


def _gini(n: str, p: str) -> str:
    return f"({n} - ({p} * {p} + ({n} - {p}) * ({n} - {p})) / {n})"


def _leaf(name: str, where: str) -> str:
    """The best split of the values of h that meet a condition."""
    sums = "lead(x) OVER o AS nx, sum(n) OVER o AS ln, sum(pos) OVER o AS lp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp"
    gain = f"{_gini('tn', 'tp')} - {_gini('ln', 'lp')} - {_gini('(tn - ln)', '(tp - lp)')}"
    return f"""{name} AS (SELECT x, {sums} FROM h WHERE {where} WINDOW o AS (ORDER BY x)),
best_{name} AS (SELECT (x + nx) / 2 AS t, {gain} AS gain FROM {name} WHERE nx IS NOT NULL AND tp > 0 AND tp < tn ORDER BY gain DESC, x LIMIT 1)"""


PEAKS = "SELECT series, max(score) AS v FROM s GROUP BY 1"


def oracle_sql() -> dict[str, str]:
    mapping = {i: 100 + 2 * i for i in range(23)}
    values = lambda rows, names: f"SELECT * FROM (VALUES {', '.join(rows)}) t({names})"
    edge_rows = " UNION ALL ".join(f"SELECT '{c}' AS source_col, i::INTEGER AS i, e{k}[i] AS edge FROM e, range(1, 5) g(i)" for k, c in enumerate(NUMBERS))
    return {
        "flagship": _population("SELECT * FROM p"),
        "load_target": "SELECT doc_id, quality, toxic::BOOLEAN AS label FROM labels",
        "typed_ingest": """WITH l AS (SELECT l_returnflag AS type, l_extendedprice::FLOAT AS amount, (CASE WHEN l_discount < 0.03 THEN 0 ELSE l_quantity END)::FLOAT AS oldbalanceOrg, (CASE WHEN l_discount < 0.05 THEN 0 ELSE l_tax END)::FLOAT AS newbalanceOrig,
(CASE WHEN l_quantity < 10 THEN 0 ELSE l_discount END)::FLOAT AS oldbalanceDest, (CASE WHEN l_quantity < 20 THEN 0 ELSE l_quantity END)::FLOAT AS newbalanceDest, l_linestatus = 'F' AS target FROM lineitem)
SELECT *, oldbalanceOrg = 0 AND newbalanceOrig = 0 AS externalOrig, oldbalanceDest = 0 AND newbalanceDest = 0 AS externalDest FROM l""",
        "bool_passthrough": "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN false ELSE o_totalprice > 150000 END AS f0 FROM orders",
        "onehot_category": "SELECT o_orderkey, " + ", ".join(f"o_orderkey % 11 != 0 AND o_orderpriority = '{v}' AS f{i}" for i, v in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"])) + " FROM orders",
        "quantile_edges": f"WITH e AS ({_edges(NUMBERS, [5] * 4, 'lineitem')}) {edge_rows}",
        "quantile_onehot": f"WITH e AS ({_edges(['c_acctbal', 'c_nationkey'], [4, 4], 'customer')}) SELECT c_custkey, {_bins(['c_acctbal', 'c_nationkey'], [4, 4])} FROM customer, e",
        "bin_counts": f"WITH {BITS} " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS feature, count_if(f{i}) AS n FROM b" for i in range(23)),
        "column_strategy_bins": f"WITH e AS ({_edges(['p_size', 'p_retailprice'], [3, 2], 'part')}) SELECT p_partkey, {_bins(['p_size', 'p_retailprice'], [3, 2])} FROM part, e",
        "constant_column_bin": "SELECT s_suppkey, s_suppkey % 5 != 0 AS f0 FROM supplier",
        "feature_dictionary": f"""WITH e AS ({_edges(['o_totalprice'], [4], 'orders')}), s AS (SELECT e0[1] AS a, e0[2] AS b, e0[3] AS c FROM e),
f AS (SELECT 1 AS o, o_orderpriority AS category, 'o_orderpriority=' || o_orderpriority AS name, 'o_orderpriority' AS source_col, 'category' AS kind, 0 AS k FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 2, NULL, printf('o_totalprice < %.2f', a), 'o_totalprice', 'bin', 0 FROM s UNION ALL SELECT 2, NULL, printf('%.2f <= o_totalprice < %.2f', a, b), 'o_totalprice', 'bin', 1 FROM s
UNION ALL SELECT 2, NULL, printf('%.2f <= o_totalprice < %.2f', b, c), 'o_totalprice', 'bin', 2 FROM s UNION ALL SELECT 2, NULL, printf('%.2f <= o_totalprice', c), 'o_totalprice', 'bin', 3 FROM s
UNION ALL SELECT 3, o_orderstatus, 'o_orderstatus=' || o_orderstatus, 'o_orderstatus', 'category', 0 FROM orders GROUP BY o_orderstatus UNION ALL SELECT 4, NULL, 'big', 'big', 'bool', 0)
SELECT (row_number() OVER (ORDER BY o, k, category) - 1)::INTEGER AS feature_id, name, source_col, kind, category FROM f""",
        "tree_bins": f"""WITH d AS (SELECT n_chars::DOUBLE AS x, quality = 1 AS y FROM documents JOIN labels USING (doc_id)), h AS (SELECT x, count(*)::DOUBLE AS n, count_if(y)::DOUBLE AS pos FROM d GROUP BY 1),
{_leaf("r", "true")}, {_leaf("a", "x < (SELECT t FROM best_r)")}, {_leaf("b", "x > (SELECT t FROM best_r)")},
z AS (SELECT t FROM best_r UNION ALL (SELECT t FROM (SELECT * FROM best_a UNION ALL SELECT * FROM best_b) ORDER BY gain DESC, t LIMIT 1)) SELECT (row_number() OVER (ORDER BY t) - 1)::INTEGER AS i, t AS threshold FROM z""",
        "tree_root_split": f"WITH {TREE} SELECT (x + nx) / 2 AS threshold, round({_gini('tn', 'tp')} - {_gini('ln', 'lp')} - {_gini('(tn - ln)', '(tp - lp)')}, 6) AS gain FROM c WHERE nx IS NOT NULL ORDER BY gain DESC, x LIMIT 1",
        "literal_eval": _evaluated(RULES[:2]),
        "and_eval": _evaluated([RULES[2], RULES[6]]),
        "or_eval": _evaluated([RULES[3], RULES[7]]),
        "nested_eval": _evaluated([RULES[5]]),
        "negated_operator": _evaluated([RULES[4], RULES[2].negate()]),
        "rule_postfix": f"SELECT * FROM {_postfix()}",
        "rule_complexity": f"SELECT rule_id, len(regexp_extract_all(rule, 'And|Or|[0-9]+'))::INTEGER AS complexity FROM (VALUES {', '.join(f"({k}, '{r}')" for k, r in enumerate(RULES))}) t(rule_id, rule)",
        "rule_remap": values([f"({k}, '{r.remap(mapping)}')" for k, r in enumerate(RULES)], "rule_id, rule"),
        "compress_weights": f"WITH {BITS} SELECT *, count(*) AS w FROM b GROUP BY ALL",
        "confusion_raw": f"WITH {BITS} SELECT {_counts(RULES[3].to_sql())} FROM b",
        "confusion_weighted": f"WITH {BITS} SELECT {_counts(RULES[3].to_sql())} FROM b",
        "f1_score": f"WITH {BITS}, c AS (SELECT {_counts(RULES[5].to_sql())} FROM b) SELECT {F1} AS f1 FROM c",
        "accuracy_score": f"WITH {BITS}, c AS (SELECT {_counts(RULES[5].to_sql())} FROM b) SELECT {ACC} AS accuracy FROM c",
        "f1_empty_cases": f"WITH c AS (SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey = 3 THEN 2 ELSE 0 END AS tp, CASE WHEN r_regionkey = 1 THEN 4 ELSE 0 END AS fp, CASE WHEN r_regionkey >= 2 THEN 5 ELSE 0 END AS fn FROM region) SELECT k, {F1} AS f1 FROM c",
        "population_scores": _population("SELECT * FROM p"),
        "population_scores_raw": _population("SELECT * FROM p"),
        "population_topk": _population("SELECT rule_id, rule, f1 FROM p ORDER BY f1 DESC, rule_id LIMIT 3"),
        "regularized_scores": _population("SELECT rule_id, round(f1 - 0.01 * ln(complexity), 6) AS score FROM p"),
        "population_summary": _population("SELECT round(avg(f1), 6) AS mean_f1, min(f1) AS min_f1, max(f1) AS max_f1 FROM p"),
        "best_of_generation": _population("SELECT rule_id, accuracy FROM p ORDER BY accuracy DESC, rule_id LIMIT 1"),
        "literal_scores": (literals := f"WITH {BITS}, c AS (" + " UNION ALL ".join(f"SELECT {i}::INTEGER AS feature, {neg} AS negated, {_counts(f'f{i}' if neg == 'false' else f'NOT f{i}')} FROM b" for i in range(23) for neg in ("false", "true")) + f") SELECT *, {F1} AS f1 FROM c"),
        "best_literal": literals + " ORDER BY f1 DESC, feature, negated LIMIT 1",
        "feature_sample": "WITH p AS (SELECT i::INTEGER AS feature_id FROM range(23) g(i) ORDER BY md5('3|' || i::VARCHAR), i LIMIT 6) SELECT feature_id, (row_number() OVER (ORDER BY feature_id) - 1)::INTEGER AS child_feature FROM p",
        "instance_partition": "WITH n AS (SELECT count(*) // 4 AS n FROM customer), r AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY md5('5|' || c_custkey::VARCHAR), c_custkey) AS k FROM customer) SELECT c_custkey, c_acctbal, ((k - 1) // n)::INTEGER AS child FROM r, n WHERE k <= 3 * n",
        "stratified_split": f"WITH {_ranked(7)} SELECT o_orderkey, o_totalprice, label, rk <= ceil(round(total * 0.2, 6)) AS test FROM r",
        "stratified_kfold": f"WITH {KFOLD} SELECT * FROM k",
        "marked_runs": f"WITH {MARKED} SELECT run, o_orderkey, test, fold FROM k",
        "fold_edges": f"WITH {MARKED}, q AS (SELECT run, g.fit::INTEGER AS fold, quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM k, range(3) g(fit) WHERE NOT test AND g.fit != k.fold GROUP BY ALL) SELECT run, fold, i::INTEGER AS i, round(e[i + 1], 6) AS edge FROM q, range(4) h(i)",
        "fold_parts": f"""WITH {MARKED}, q AS (SELECT run, g.fit::INTEGER AS fit, quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM k, range(3) g(fit) WHERE NOT test AND g.fit != k.fold GROUP BY ALL)
SELECT run, fit AS fold, CASE WHEN test THEN 2 WHEN fold = fit THEN 1 ELSE 0 END::INTEGER AS part, label, len(list_filter(e, lambda v: round(v, 6) < o_totalprice))::INTEGER AS bin, count(*) AS w FROM k JOIN q USING (run) GROUP BY ALL""",
        "experiment_parts": f"WITH {MARKED} SELECT run, g.fit::INTEGER AS fold, " + ", ".join(f"count_if({t}) AS {c}_rows, count_if({t} AND label) AS {c}_true" for c, t in (("train", "NOT test AND fold != g.fit"), ("val", "NOT test AND fold = g.fit"), ("test", "test"))) + " FROM k, range(3) g(fit) GROUP BY ALL",
        "fold_metrics": f"WITH {SERIES} SELECT (epoch % 2)::INTEGER AS run, (epoch % 3)::INTEGER AS fold, max(CASE WHEN epoch % 5 = 0 THEN score - 1 END) AS best_val, max(score) AS best_train FROM s GROUP BY ALL",
        "mutation_cases": values([f"('{n}', '{r}', {'NULL' if o is None else repr(o)})" for n, r, _, _, o in MUTATION_CASES], "name, rule, outcome"),
        "random_mutations": "SELECT 200::INTEGER AS kept, 200::INTEGER AS fresh, 2::INTEGER AS kinds, 2::INTEGER AS signs",
        "crossover_cases": values(["(0, 'And(0, ~14)', 'Or(13, Or(1, 2))')", "(1, '13', 'Or(And(0, Or(1, 2)), ~14)')", "(2, '~And(~Or(12, 13), 1)', '0')"], "k, one, two"),
        "crossover_pairs": "SELECT 40::INTEGER AS children, 40::INTEGER AS apart, 20::INTEGER AS exchanged",
        "progress_cases": values(["(0, '0', 0.3::DOUBLE, 0)", "(1, '1', 0.5, 0)", "(2, '2', 0.5, 0)", "(3, '2', 0.5, 1)", "(4, '2', 0.5, 2)", "(5, '5', 0.6, 0)", "(6, '5', 0.6, 1)"], "epoch, best, best_score, stale"),
        "fold_scores": f"WITH {FOLD_SCORES} SELECT * FROM s",
        "best_fold": f"WITH {FOLD_ROWS} SELECT run, fold, round(best_val, 9) AS best_val FROM bf",
        "run_summary": f"WITH {FOLD_ROWS} SELECT run, fold, round(mean_val, 6) AS mean_val, round(mean_train, 6) AS mean_train, '[TP: ' || tp || ', FP: ' || fp || ', FN: ' || fn || ', TN: ' || tn || ']' AS confusion FROM bf",
        "experiment_summary": f"WITH {FOLD_ROWS} SELECT run, round(mean_val, 6) AS mean_val FROM bf ORDER BY CASE WHEN max(mean_val) OVER () > 0 THEN bf.mean_val ELSE mean_train END DESC, run LIMIT 1",
        "trial_attributes": f"""WITH {FOLD_ROWS}, z AS (SELECT run, fold, best_val, best_train - 0.2::DOUBLE AS t, mean_val, mean_train, tp FROM bf), w AS (SELECT * FROM z ORDER BY mean_val DESC, run LIMIT 1)
SELECT round(avg(mean_train), 6) AS train_mean, round(stddev_pop(mean_train), 6) AS train_std, round(avg(mean_val), 6) AS val_mean, round(stddev_pop(mean_val), 6) AS val_std, round(avg(t), 6) AS test_mean, round(stddev_pop(t), 6) AS test_std,
(SELECT run FROM w) AS best_run, (SELECT fold FROM w) AS best_fold, 'And(0, ' || (SELECT fold FROM w) || ')' AS rule, string_agg(round(t, 6)::VARCHAR, ',' ORDER BY run) AS tests, (SELECT tp FROM z WHERE run = 0) AS first_tp FROM z""",
        "run_statistics": f"WITH {FOLD_ROWS} {_stats('best_train', 'run', 'fr')}",
        "box_stats": _stats("value", "event_type", "events WHERE value IS NOT NULL"),
        "roulette_probabilities": _population(", q AS (SELECT rule_id, f1 - 0.5::DOUBLE AS s FROM p), z AS (SELECT rule_id, s - least(0.0, min(s) OVER ()) AS t FROM q) SELECT rule_id, round(t / sum(t) OVER (), 6) AS chance FROM z"),
        "tournament_probabilities": "SELECT i::INTEGER AS seat, round(CASE WHEN i < 9 THEN 0.4 * pow(0.6, i) ELSE pow(0.6, 9) END, 6) AS chance FROM range(10) g(i)",
        "feedback_signal": f"WITH {FEEDBACK} SELECT c AS population, p AS place, coalesce(feedback, 0) AS feedback FROM slots LEFT JOIN fb ON population = c AND place = p",
        "feedback_apply": f"""WITH {FEEDBACK}, f AS (SELECT c, i, s, CASE WHEN i < 2 THEN coalesce((SELECT avg_signal FROM fb WHERE population = c AND place = i), 0) ELSE 0 END AS f FROM sc, (VALUES (0), (1)) t(c))
SELECT c::INTEGER AS population, i::INTEGER AS i, round(s + 0.5 * f, 6) AS additive, round(s * (1 + 0.5 * f), 6) AS multiplicative FROM f""",
        "ema": f"WITH RECURSIVE {SERIES}, r AS (SELECT series, i, epoch, score AS v FROM s WHERE i = 1 UNION ALL SELECT s.series, s.i, s.epoch, (2.0::DOUBLE / 14) * s.score + (1 - 2.0::DOUBLE / 14) * r.v FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1) SELECT series, epoch, round(v, 6) AS ema FROM r",
        "regeneration_marks": f"""WITH RECURSIVE {SERIES}, r AS (SELECT series, i, epoch, score AS best, 0 AS stale, false AS mark FROM s WHERE i = 1 UNION ALL
SELECT s.series, s.i, s.epoch, CASE WHEN s.score > r.best THEN s.score WHEN r.stale + 1 = 5 THEN '-inf'::DOUBLE ELSE r.best END, CASE WHEN s.score > r.best OR r.stale + 1 = 5 THEN 0 ELSE r.stale + 1 END, s.score <= r.best AND r.stale + 1 = 5
FROM r JOIN s ON s.series = r.series AND s.i = r.i + 1) SELECT series, epoch AS mark FROM r WHERE mark""",
        "band_stats": "WITH k AS (SELECT o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 10) SELECT o_orderpriority, round(avg(o_totalprice), 6) AS mean, round(stddev_pop(o_totalprice), 6) AS std FROM k GROUP BY 1",
        "peak_epoch": f"WITH {SERIES}, t AS ({PEAKS}) SELECT series, min(epoch) AS peak, v AS value FROM s JOIN t USING (series) WHERE score = v GROUP BY series, v",
        "rank_picks": "WITH r AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS k, count(*) OVER () AS n FROM supplier) SELECT p AS pick, s_suppkey, s_acctbal FROM r, (VALUES ('worst'), ('q1'), ('median'), ('q3'), ('best')) t(p) WHERE k = CASE p WHEN 'worst' THEN 0 WHEN 'q1' THEN n // 4 WHEN 'median' THEN n // 2 WHEN 'q3' THEN 3 * n // 4 ELSE n - 1 END",
        "top_children": f"WITH {SERIES} SELECT series, max(score) AS peak FROM s GROUP BY 1 ORDER BY peak DESC, series LIMIT 3",
        "results_join": f"WITH {TWO} SELECT dataset, a, b FROM a JOIN bb USING (dataset)",
        "key_difference": "WITH a AS (SELECT DISTINCT o_custkey AS dataset FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS dataset FROM orders WHERE o_orderpriority = '5-LOW') SELECT dataset, 'left' AS side FROM a WHERE dataset NOT IN (SELECT dataset FROM b) UNION ALL SELECT dataset, 'right' FROM b WHERE dataset NOT IN (SELECT dataset FROM a)",
        "best_or_tied": f"WITH {TWO}, j AS (SELECT a, b, greatest(a, b) AS m FROM a JOIN bb USING (dataset)) SELECT 'a' AS name, count_if(abs(a - m) <= 1e-8 + 1e-5 * abs(m)) AS wins FROM j UNION ALL SELECT 'b', count_if(abs(b - m) <= 1e-8 + 1e-5 * abs(m)) FROM j",
        "binary_datasets": "SELECT o_orderpriority AS dataset FROM orders GROUP BY 1 HAVING count(DISTINCT CASE WHEN o_orderpriority < '3' THEN o_orderstatus WHEN o_orderstatus = 'F' THEN 'x' ELSE 'y' END) = 2",
        "rule_predict": f"WITH e AS ({_edges(['o_totalprice'], [4], 'orders')}), p AS (SELECT o_orderkey, {_bins(['o_totalprice'], [4])}, o_orderpriority = '1-URGENT' AS f4, o_orderpriority = '5-LOW' AS f8 FROM orders, e) SELECT o_orderkey, (f0 AND NOT f4) OR f8 AS pred FROM p",
    }
