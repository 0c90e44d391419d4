"""DuckDB SQL twins of the registered queries, built from shared steps."""

from __future__ import annotations

from checks.catalog import BLOCKED_REPLICATES, BOOTSTRAP_SEED, ORDER_STRATA, REPLICATES, SMALL_TREES
from checks.fixture import (
    EVENTS, FOLD_SEED, FOLDS, ORDERS, OUTCOME_PURPOSE, TREATMENT_PURPOSE, VISIT_PURPOSE,
)
from trialquota.functions.hashing import GAMMA, MASK64, MULTIPLIER_A, MULTIPLIER_B, derive_seed
from trialquota.functions.scores import normal_quantile
from trialquota.operators.splits import DRAW_PURPOSE, SPLIT_PURPOSE
from trialquota.plans.reports import ALL_TIE, CONTRAST_LABELS, POLICY_LABELS
from trialquota.spec import CAPACITIES, CONTRASTS, POLICIES, SCORE_POLICIES

WRAP = "18446744073709551616::UHUGEINT"
E = f"{EVENTS.propensity}::DOUBLE"
NE = f"{1.0 - EVENTS.propensity!r}::DOUBLE"
OUTCOMES = EVENTS.outcomes


def keyed(source: str, row_id: str, seed: int, out: str) -> str:
    """Subquery adding the SplitMix64 key of ``row_id`` as ``out``."""
    start = f"((({row_id})::UHUGEINT + {(seed + GAMMA) & MASK64}::UHUGEINT) % {WRAP})::UBIGINT"
    step = lambda z, shift, factor: f"((xor({z}, {z} >> {shift}))::UHUGEINT * {factor}::UHUGEINT % {WRAP})::UBIGINT"
    return (
        f"(SELECT * EXCLUDE (z_a, z_b, z_c), xor(z_c, z_c >> 31) AS {out} FROM "
        f"(SELECT *, {step('z_b', 27, MULTIPLIER_B)} AS z_c FROM "
        f"(SELECT *, {step('z_a', 30, MULTIPLIER_A)} AS z_b FROM "
        f"(SELECT *, {start} AS z_a FROM {source}))))"
    )


def split_of(key: str) -> str:
    return (
        f"CASE WHEN {key} % 10 IN (0,1,2,3,4,5) THEN 'train' WHEN {key} % 10 IN (6,7) THEN 'validation' "
        f"WHEN {key} % 10 IN (8,9) THEN 'test' END"
    )


def with_split(source: str, seed: int) -> str:
    key = keyed(source, "row_id", derive_seed(seed, SPLIT_PURPOSE), "split_key")
    return f"SELECT * EXCLUDE (split_key), {split_of('split_key')} AS split FROM {key}"


def aipw(y: str, m0: str, m1: str) -> str:
    return f"({m1} - {m0} + treatment * ({y} - {m1}) / {E} - (1 - treatment) * ({y} - {m0}) / {NE})"


def arm_mean(y: str, arm: int) -> str:
    return f"avg({y}::DOUBLE) FILTER (WHERE treatment = {arm})"


def orders_step() -> str:
    source = (
        "(SELECT o_orderkey AS row_id, o_totalprice, c_acctbal, o_orderpriority, o_orderstatus, c_mktsegment, "
        "c_nationkey::VARCHAR AS c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"
    )
    for name, purpose in (("t_key", TREATMENT_PURPOSE), ("c_key", OUTCOME_PURPOSE), ("v_key", VISIT_PURPOSE)):
        source = keyed(source, "row_id", derive_seed(ORDERS.seed, purpose), name)
    drawn = (
        f"(SELECT *, (t_key % 1000 < 850)::INT AS treatment, (c_key % 1000)::BIGINT AS c_draw, "
        f"(v_key % 1000)::BIGINT AS v_draw FROM {source})"
    )
    converted = (
        f"(SELECT *, (c_draw < 50 + treatment * (20 + 60 * (c_mktsegment = 'BUILDING')::INT))::INT AS conversion "
        f"FROM {drawn})"
    )
    return (
        f"SELECT * EXCLUDE (t_key, c_key, v_key, c_draw, v_draw), "
        f"(conversion = 1 OR v_draw < 200 + 40 * treatment)::INT AS visit, "
        f"(treatment = 1 AND v_draw < 300)::INT AS exposure FROM {converted}"
    )


def cell_step(source: str, strata: str) -> str:
    columns = ", ".join(
        f"coalesce({arm_mean(y, arm)}, (SELECT {arm_mean(y, arm)} FROM {source})) AS mu{arm}_{y}"
        for y in OUTCOMES
        for arm in (0, 1)
    )
    return (
        f"SELECT {strata}, count(*) FILTER (WHERE treatment = 0) AS n0, count(*) FILTER (WHERE treatment = 1) AS n1, "
        f"{columns} FROM {source} GROUP BY {strata}"
    )


def pseudo_step() -> str:
    sums = ", ".join(
        f"count(*) FILTER (WHERE treatment = {a}) AS n{a}, "
        f"coalesce(sum(conversion::DOUBLE) FILTER (WHERE treatment = {a}), 0) AS s{a}"
        for a in (0, 1)
    )
    other = lambda c, over: f"(sum({c}) OVER ({over}) - {c})"
    cell = lambda a: f"{other(f's{a}', 'PARTITION BY f3')} / nullif({other(f'n{a}', 'PARTITION BY f3')}, 0)"
    back = lambda a: f"{other(f's{a}', '')} / nullif({other(f'n{a}', '')}, 0)"
    return f"""
SELECT row_id, f1, fold, {aipw('conversion', 'm0', 'm1')} AS pseudo
FROM folded JOIN (
  SELECT f3, fold, coalesce(c0, b0) AS m0, coalesce(c1, b1) AS m1
  FROM (SELECT f3, fold, {cell(0)} AS c0, {cell(1)} AS c1
        FROM (SELECT f3, fold, {sums} FROM folded GROUP BY f3, fold))
  JOIN (SELECT fold, {back(0)} AS b0, {back(1)} AS b1 FROM (SELECT fold, {sums} FROM folded GROUP BY fold))
  USING (fold)
) USING (f3, fold)"""


def long_scores() -> str:
    parts = [
        f"SELECT '{p}' AS policy, row_id, {p} AS score, tie_key, psi_conversion, psi_visit, z FROM keyed_scores"
        for p in SCORE_POLICIES
    ]
    return (
        "SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, tie_key, row_id) AS rank FROM ("
        + " UNION ALL ".join(parts)
        + ")"
    )


def capacity_rows() -> str:
    values = ", ".join(f"({q!r}::DOUBLE)" for q in CAPACITIES)
    return f"SELECT capacity, floor(capacity * n)::BIGINT AS k, n FROM (VALUES {values}) v(capacity), test_size"


def grid_step() -> str:
    parts = []
    for y in OUTCOMES:
        parts.append(
            f"SELECT '{y}' AS outcome, capacity, k, policy, sum(psi_{y}) FILTER (WHERE rank <= k) / any_value(n) AS value "
            f"FROM ranked, capacities GROUP BY capacity, k, policy"
        )
        parts.append(
            f"SELECT '{y}', capacity, k, 'random', k::DOUBLE / any_value(n) * avg(psi_{y}) FROM scored, capacities "
            f"GROUP BY capacity, k"
        )
    return "SELECT outcome, capacity, k, policy, coalesce(value, 0.0) AS value FROM (" + " UNION ALL ".join(parts) + ")"


def contrasts_of(source: str, keys: str) -> str:
    join = " AND ".join(f"l.{k} = r.{k}" for k in keys.split(", "))
    picked = ", ".join(f"l.{k}" for k in keys.split(", "))
    return " UNION ALL ".join(
        f"SELECT {picked}, '{name}' AS name, l.value - r.value AS value FROM {source} l JOIN {source} r "
        f"ON {join} AND l.policy = '{left}' AND r.policy = '{right}'"
        for name, left, right in CONTRASTS
    )


def replicate_step() -> str:
    parts = []
    taken = "least(greatest(k - seen, 0), copies)"
    for y in OUTCOMES:
        parts.append(
            f"SELECT replicate, '{y}' AS outcome, capacity, policy, sum({taken} * psi_{y}) / any_value(n) AS value "
            f"FROM drawn_ranks, capacities GROUP BY replicate, capacity, policy"
        )
        parts.append(
            f"SELECT replicate, '{y}', capacity, 'random', any_value(k)::DOUBLE / any_value(n) * sum(copies * psi_{y}) "
            f"/ any_value(n) FROM drawn_ranks, capacities WHERE policy = 'response' GROUP BY replicate, capacity"
        )
    return " UNION ALL ".join(parts)


def summary_step() -> str:
    both = lambda values, gaps, extra: (
        f"SELECT {extra} outcome, capacity, 'policy_value' AS estimand_type, policy AS name, value FROM {values} "
        f"UNION ALL SELECT {extra} outcome, capacity, 'contrast', name, value FROM {gaps}"
    )
    return f"""
SELECT outcome, capacity, estimand_type, name, any_value(p.value) AS estimate,
       stddev_samp(b.value) AS bootstrap_standard_error,
       quantile_cont(b.value, 0.025) AS ci_lower, quantile_cont(b.value, 0.975) AS ci_upper,
       {REPLICATES}::BIGINT AS bootstrap_replicates
FROM ({both('grid', 'grid_contrasts', '')}) p
JOIN ({both('replicates', 'replicate_contrasts', 'replicate,')}) b USING (outcome, capacity, estimand_type, name)
GROUP BY outcome, capacity, estimand_type, name"""


def sample_summary_step() -> str:
    row = lambda metric, group, value, quantity, unit: (
        f"SELECT '{metric}' AS metric, '{group}' AS \"group\", ({value})::DOUBLE AS value, '{quantity}' AS quantity_type, "
        f"'{unit}' AS unit, 'held_out_test' AS sample_scope FROM test"
    )
    parts = [row("test_rows", "all", "count(*)", "sample_count", "rows")]
    for arm, group in ((0, "control"), (1, "treated")):
        parts.append(row("rows", group, f"count(*) FILTER (WHERE treatment = {arm})", "sample_count", "rows"))
        for y in OUTCOMES:
            events = f"coalesce(sum({y}) FILTER (WHERE treatment = {arm}), 0)"
            parts.append(row(f"{y}_events", group, events, "sample_count", "events"))
            parts.append(row(f"{y}_rate", group, arm_mean(y, arm), "sample_rate", "proportion"))
    return " UNION ALL ".join(parts)


def effect(source: str, y: str, confidence: float) -> str:
    mean = lambda arm: arm_mean(y, arm)
    share = lambda arm: f"var_samp({y}::DOUBLE) FILTER (WHERE treatment = {arm}) / count(*) FILTER (WHERE treatment = {arm})"
    z = f"{normal_quantile(confidence)!r}::DOUBLE"
    return (
        f"SELECT outcome, estimate, standard_error, estimate - {z} * standard_error AS ci_lower, "
        f"estimate + {z} * standard_error AS ci_upper, n_treated, n_control FROM "
        f"(SELECT '{y}' AS outcome, {mean(1)} - {mean(0)} AS estimate, sqrt({share(1)} + {share(0)}) AS standard_error, "
        f"count(*) FILTER (WHERE treatment = 1) AS n_treated, count(*) FILTER (WHERE treatment = 0) AS n_control FROM {source})"
    )


def effect_table_step() -> str:
    parts = " UNION ALL ".join(effect("experiment", y, 0.95) for y in OUTCOMES)
    return (
        f"SELECT *, 'average_treatment_effect' AS quantity_type, 'probability_difference' AS unit, "
        f"'complete_source' AS sample_scope FROM ({parts})"
    )


def continuous(source: str, features) -> str:
    stat = lambda fn, f, arm: f"{fn}({f}) FILTER (WHERE treatment {'=' if arm else '<>'} 1)"
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, 'pooled_smd' AS metric_type, ({stat('avg', f, 1)} - {stat('avg', f, 0)}) / "
        f"sqrt(({stat('var_samp', f, 1)} + {stat('var_samp', f, 0)}) / 2) AS value FROM {source}"
        for f in features
    )


def levels_balance(source: str, features) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS level, count(*) FILTER (WHERE treatment = 1) AS n1, "
        f"count(*) FILTER (WHERE treatment = 0) AS n0 FROM {source} GROUP BY {f}"
        for f in features
    )
    return (
        "SELECT feature, level, p1, p0, CASE WHEN p1 = p0 THEN 0.0 ELSE (p1 - p0) / sqrt((p1 * (1 - p1) + p0 * (1 - p0)) / 2) END AS smd "
        f"FROM (SELECT feature, level, n1 / sum(n1) OVER (PARTITION BY feature) AS p1, "
        f"n0 / sum(n0) OVER (PARTITION BY feature) AS p0 FROM ({counts}))"
    )


def categorical(source: str, features) -> str:
    return (
        "SELECT feature, 'max_abs_one_vs_rest_smd' AS metric_type, max(abs(smd)) AS value FROM "
        f"({levels_balance(source, features)}) GROUP BY feature"
    )


def balance_step() -> str:
    return (
        "SELECT feature, metric_type, abs(value) AS absolute_value, value, 'train_and_validation' AS sample_scope, "
        "'standardized_mean_difference' AS unit FROM ("
        f"{continuous('development', EVENTS.continuous)} UNION ALL {categorical('development', EVENTS.categorical)})"
    )


def integrity(source: str, numeric, text=()) -> str:
    finite = " AND ".join(
        [f"({c} IS NOT NULL AND isfinite({c}))" for c in numeric] + [f"{c} IS NOT NULL" for c in text]
    )
    binary = " AND ".join(f"({c} IS NOT NULL AND {c} IN (0, 1))" for c in EVENTS.binary_columns)
    checks = {
        "row_count": "count(*)",
        "features_finite": f"coalesce(bool_and({finite}), false)",
        "binary_domains_valid": f"coalesce(bool_and({binary}), false)",
        "control_has_no_exposure": "coalesce(bool_and(treatment = 1 OR exposure = 0), false)",
        "conversion_implies_visit": "coalesce(bool_and(conversion = 0 OR visit = 1), false)",
    }
    cast = lambda name, value: f"({value})::DOUBLE" if name == "row_count" else f"({value})::INT::DOUBLE"
    return " UNION ALL ".join(
        f"SELECT '{name}' AS metric, {cast(name, value)} AS value FROM {source}" for name, value in checks.items()
    )


def auc(source: str, score: str, label: str) -> str:
    return f"""
SELECT (sum(r) FILTER (WHERE y = 1) - p * (p + 1) / 2.0) / (p * (n - p)) AS auc, p::BIGINT AS positives, (n - p)::BIGINT AS negatives
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r,
             sum(y) OVER ()::DOUBLE AS p, count(*) OVER ()::DOUBLE AS n
      FROM (SELECT {score} AS s, {label} AS y FROM {source}))
GROUP BY p, n"""


def level_codes(source: str, features, cast: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f}::{cast} AS level, row_number() OVER (ORDER BY {f}) - 1 AS code "
        f"FROM (SELECT DISTINCT {f} FROM {source} WHERE {f} IS NOT NULL)"
        for f in features
    )


def label_case(column: str, labels: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


def position_case(column: str, labels) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {i}" for i, k in enumerate(labels, 1)) + " END::BIGINT"


def range_text() -> str:
    return "format('{:,.1f} to {:,.1f}', ci_lower * 100000, ci_upper * 100000)"


def cell_text() -> str:
    clean = lambda c: f"CASE WHEN abs({c} * 100000) < 0.05 THEN 0.0 ELSE {c} * 100000 END::DOUBLE"
    return f"format('{{:.1f}} [{{:.1f}}, {{:.1f}}]', {clean('estimate')}, {clean('ci_lower')}, {clean('ci_upper')})"


def enriched_step() -> str:
    count = ", ".join(
        f"{c} * n AS test_cohort_incremental_count_{c}" for c in ("estimate", "ci_lower", "ci_upper")
    )
    return (
        "SELECT s.*, floor(capacity * n)::BIGINT AS selected_rows, floor(capacity * n) / n AS selected_fraction_exact, "
        f"'held_out_test' AS sample_scope, 'incremental_outcomes_per_test_row' AS unit, {count}, "
        "'expected_incremental_outcomes_in_test_cohort' AS count_unit, "
        "CASE estimand_type WHEN 'contrast' THEN 'paired_policy_value_difference' ELSE 'held_out_policy_value' END AS quantity_type "
        "FROM summary s, test_size"
    )


STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "experiment": ((), (
        "SELECT event_id AS row_id, value AS f0, dayofmonth(ts)::DOUBLE AS f2, (user_id % 25)::DOUBLE AS f1, "
        "hour(ts)::DOUBLE AS f3, (json_extract_string(props, '$.k')::INT < 85)::INT AS treatment, "
        "(event_type = 'purchase')::INT AS conversion, (event_type IN ('purchase', 'click', 'view'))::INT AS visit, "
        "(json_extract_string(props, '$.k')::INT < 85 AND value > 50)::INT AS exposure FROM events"
    )),
    "split_rows": (("experiment",), with_split("experiment", EVENTS.seed)),
    "development": (("split_rows",), "SELECT * FROM split_rows WHERE split IN ('train', 'validation')"),
    "test": (("split_rows",), "SELECT * FROM split_rows WHERE split = 'test'"),
    "test_size": (("test",), "SELECT count(*)::DOUBLE AS n FROM test"),
    "order_rows": ((), orders_step()),
    "split_orders": (("order_rows",), with_split("order_rows", ORDERS.seed)),
    "order_development": (("split_orders",), "SELECT * FROM split_orders WHERE split IN ('train', 'validation')"),
    "cells": (("development",), cell_step("development", "f3")),
    "folded": (("development",), (
        f"SELECT * EXCLUDE (fold_key), (fold_key % {FOLDS})::BIGINT AS fold FROM "
        f"{keyed('development', 'row_id', FOLD_SEED, 'fold_key')}"
    )),
    "pseudo_rows": (("folded",), pseudo_step()),
    "scored": (("test", "cells", "pseudo_rows"), (
        "SELECT row_id, treatment, conversion, visit, round(mu1_conversion, 12) AS response, "
        "round(mu1_conversion - mu0_conversion, 12) AS t_learner, round(dr, 12) AS dr_learner, "
        f"{aipw('conversion', 'mu0_conversion', 'mu1_conversion')} AS psi_conversion, "
        f"{aipw('visit', 'mu0_visit', 'mu1_visit')} AS psi_visit, "
        f"treatment * conversion / {E} - (1 - treatment) * conversion / {NE} AS z "
        "FROM (SELECT row_id, f1, f3, treatment, conversion, visit FROM test) "
        "JOIN cells USING (f3) JOIN (SELECT f1, avg(pseudo) AS dr FROM pseudo_rows GROUP BY f1) USING (f1)"
    )),
    "keyed_scores": (("scored",), f"SELECT * FROM {keyed('scored', 'row_id', EVENTS.seed, 'tie_key')}"),
    "ranked": (("keyed_scores",), long_scores()),
    "capacities": (("test_size",), capacity_rows()),
    "grid": (("ranked", "scored", "capacities"), grid_step()),
    "grid_contrasts": (("grid",), contrasts_of("grid", "outcome, capacity")),
    "curve": (("ranked",), (
        "SELECT policy, position, position / n AS fraction, gain / n AS cumulative_gain, "
        "CASE WHEN position = n THEN 0.0 ELSE gain / n - position / n * (final / n) END AS centered_qini "
        "FROM (SELECT policy, rank AS position, sum(z) OVER (PARTITION BY policy ORDER BY rank) AS gain, "
        "sum(z) OVER (PARTITION BY policy) AS final, count(*) OVER (PARTITION BY policy)::DOUBLE AS n FROM ranked "
        "UNION ALL SELECT DISTINCT policy, 0, 0.0, 0.0, 1.0 FROM ranked)"
    )),
    "display": (("curve", "test_size"), (
        "SELECT * FROM curve WHERE position IN (SELECT floor(CASE WHEN i = 100 THEN 1.0::DOUBLE ELSE i * 0.01::DOUBLE END * n)::BIGINT "
        "FROM range(101) t(i), test_size)"
    )),
    "coefficients": (("curve",), (
        "SELECT policy, sum((before + centered_qini) * (fraction - previous) / 2) AS coefficient FROM "
        "(SELECT *, lag(centered_qini) OVER w AS before, lag(fraction) OVER w AS previous FROM curve "
        "WINDOW w AS (PARTITION BY policy ORDER BY position)) WHERE before IS NOT NULL GROUP BY policy"
    )),
    "draws": (("test_size",), (
        "SELECT replicate, idx, count(*) AS copies FROM (SELECT (draw // n::BIGINT)::BIGINT AS replicate, "
        "(draw_key % n::UBIGINT)::BIGINT AS idx FROM "
        + keyed(
            f"(SELECT unnest(range({REPLICATES} * n::BIGINT)) AS draw, n FROM test_size)",
            "draw", derive_seed(BOOTSTRAP_SEED, DRAW_PURPOSE), "draw_key",
        )
        + ") GROUP BY replicate, idx"
    )),
    "drawn_ranks": (("draws", "ranked"), (
        "SELECT *, sum(copies) OVER (PARTITION BY policy, replicate ORDER BY rank) - copies AS seen FROM "
        "(SELECT policy, rank, row_number() OVER (PARTITION BY policy ORDER BY row_id) - 1 AS idx, psi_conversion, psi_visit "
        "FROM ranked) JOIN draws USING (idx)"
    )),
    "replicates": (("drawn_ranks", "capacities"), replicate_step()),
    "replicate_contrasts": (("replicates",), contrasts_of("replicates", "replicate, outcome, capacity")),
    "summary": (("grid", "grid_contrasts", "replicates", "replicate_contrasts"), summary_step()),
    "enriched": (("summary", "test_size"), enriched_step()),
    "policy_values": (("enriched",), "SELECT * FROM enriched WHERE estimand_type = 'policy_value'"),
    "policy_contrasts": (("enriched",), "SELECT * FROM enriched WHERE estimand_type = 'contrast'"),
    "sample_summary": (("test",), sample_summary_step()),
    "effects": (("experiment",), effect_table_step()),
    "balance": (("development",), balance_step()),
    "split_counts": (("split_rows",), "SELECT split, count(*) AS \"rows\" FROM split_rows GROUP BY split"),
    "event_integrity": (("experiment",), integrity("experiment", EVENTS.features)),
}


def build(select: str, *needs: str) -> str:
    """Prefix ``select`` with the steps it needs, each after its own needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for need in STEPS[name][0]:
                visit(need)
            ordered.append(name)

    for name in needs:
        visit(name)
    # A step several others read is computed once, not once per reader.
    steps = ", ".join(f"{name} AS MATERIALIZED ({STEPS[name][1]})" for name in ordered)
    return f"WITH {steps} {select}" if ordered else select


def r(column: str, alias: str | None = None, digits: int = 9) -> str:
    return f"round({column}, {digits}) + 0.0::DOUBLE AS {alias or column}"


def _policy_columns() -> str:
    numbers = ["estimate", "bootstrap_standard_error", "ci_lower", "ci_upper", "selected_fraction_exact"] + [
        f"test_cohort_incremental_count_{c}" for c in ("estimate", "ci_lower", "ci_upper")
    ]
    texts = "outcome, capacity, estimand_type, name, bootstrap_replicates, selected_rows, sample_scope, unit, count_unit, quantity_type"
    return texts + ", " + ", ".join(r(c) for c in numbers)


SUMMARY_NUMBERS = ", ".join(r(c) for c in ("estimate", "bootstrap_standard_error", "ci_lower", "ci_upper"))
EVENT_COLUMNS = "row_id, round(f0, 9) + 0.0::DOUBLE AS f0, f2, f1, f3, treatment::BIGINT AS treatment, conversion::BIGINT AS conversion, visit::BIGINT AS visit, exposure::BIGINT AS exposure"


def oracle_queries() -> dict[str, str]:
    effect_numbers = ", ".join(r(c) for c in ("estimate", "standard_error", "ci_lower", "ci_upper"))
    metric = lambda name: build(f"SELECT * FROM event_integrity WHERE metric = '{name}'", "event_integrity")
    ordered_contrasts = [f"response_minus_{x}" for x in ("random", "t_learner", "dr_learner")]
    reversed_sql = (
        "SELECT outcome, capacity, split_part(name, '_minus_', 2) || '_minus_' || split_part(name, '_minus_', 1) AS name, "
        "-estimate AS estimate, -ci_upper AS ci_lower, -ci_lower AS ci_upper FROM policy_contrasts"
    )
    filled = " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS name, count({c}) AS filled_rows FROM experiment"
        for i, c in enumerate(EVENTS.source_columns)
    )
    folds = " UNION ALL ".join(
        f"SELECT {arm}::BIGINT AS arm, {fold}::BIGINT AS fold, count(*) AS \"rows\", sum(conversion)::BIGINT AS conversions FROM folded "
        f"WHERE split = 'train' AND treatment = {arm} AND fold <> {fold}"
        for arm in (0, 1)
        for fold in range(FOLDS)
    )
    codes = level_codes("(SELECT * FROM split_rows WHERE split = 'train')", EVENTS.categorical, "DOUBLE")
    code_of = lambda f: f"(SELECT * FROM ({codes}) WHERE feature = '{f}')"
    cardinality = lambda f: f"(SELECT count(*) FROM {code_of(f)})"
    users = with_split("(SELECT event_id AS row_id, user_id FROM events)", EVENTS.seed)
    models = [f"{y}_m{arm}" for y in OUTCOMES for arm in (0, 1)]
    fitted = lambda names: " UNION ALL ".join(
        f"SELECT '{n}' AS model, true AS rounds_in_range, true AS loss_positive" for n in names
    )
    metadata = build(
        "SELECT model, rounds_in_range, loss_positive, train_rows, validation_rows, train_rows + validation_rows AS development_rows, "
        f"{E} AS propensity, {SMALL_TREES.folds}::BIGINT AS folds, {SMALL_TREES.seed}::BIGINT AS model_seed, "
        f"{SMALL_TREES.fold_seed}::BIGINT AS fold_seed FROM ({fitted([*models, 'dr_learner'])}), "
        "(SELECT count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'validation') AS validation_rows "
        "FROM development)",
        "development",
    )
    guards = " UNION ALL ".join(
        f"SELECT '{g}' AS guard, {leaks} AS input_leaks, {leaks} AS refused"
        for g in ("development_rows", "train_levels", "model_rows", "feature_only")
        for leaks in ("false", "true")
    )
    audit = (
        "SELECT 'header_matches' AS metric, 1.0::DOUBLE AS value, 'integrity_check' AS quantity_type, 'boolean' AS unit, "
        "'complete_source' AS sample_scope UNION ALL "
        "SELECT metric, value, CASE metric WHEN 'row_count' THEN 'sample_count' ELSE 'integrity_check' END, "
        "CASE metric WHEN 'row_count' THEN 'rows' ELSE 'boolean' END, 'complete_source' FROM event_integrity UNION ALL "
        "SELECT split || '_rows', \"rows\"::DOUBLE, 'sample_count', 'rows', split FROM split_counts UNION ALL "
        "SELECT 'maximum_absolute_smd', round(max(absolute_value), 9) + 0.0::DOUBLE, 'descriptive_randomization_diagnostic', "
        "'standardized_mean_difference', 'train_and_validation' FROM balance"
    )
    keys = lambda table, key, source, value: f"SELECT '{table}' AS \"table\", {key} AS key, {value} AS value FROM {source}"
    names = lambda found: "(SELECT unnest([" + ", ".join(f"'{n}'" for n in found) + "]) AS name)"
    outcome_names = lambda found: f"(SELECT unnest([{', '.join(repr(y) for y in OUTCOMES)}]) AS outcome), {names(found)}"
    evaluated = " UNION ALL ".join(
        [
            keys("sample_summary", "concat_ws('|', metric, \"group\")", "sample_summary", "round(value, 9) + 0.0::DOUBLE"),
            keys("average_treatment_effects", "outcome", "effects", "round(estimate, 9) + 0.0::DOUBLE"),
            keys("policy_values", "outcome || '|' || name", outcome_names(POLICIES), f"{len(CAPACITIES)}::DOUBLE"),
            keys("policy_contrasts", "outcome || '|' || name", outcome_names([c[0] for c in CONTRASTS]), f"{len(CAPACITIES)}::DOUBLE"),
            keys("qini_coefficients", "name", names(SCORE_POLICIES), "1.0::DOUBLE"),
            keys("qini_curves", "name", names(SCORE_POLICIES), "101.0::DOUBLE"),
        ]
    )
    values_text = build(f"SELECT {_policy_columns()} FROM policy_values", "policy_values")
    pivot = lambda names: ", ".join(f"max(cell) FILTER (WHERE name = '{n}') AS {n}" for n in names)
    return {
        "s1_csv_scan": build(f"SELECT {EVENT_COLUMNS} FROM experiment", "experiment"),
        "s2_csv_ordinal": build(f"SELECT {EVENT_COLUMNS} FROM experiment", "experiment"),
        "s7_bundle_round_trip": build("SELECT count(*) AS \"rows\", 0.0::DOUBLE AS largest_gap FROM test", "test"),
        "v9_leakage_guards": guards,
        "s2_source_ordinal": "SELECT row_number() OVER () - 1 AS row_id, event_id FROM events",
        "s3_prepared_write": build(f"SELECT {EVENT_COLUMNS}, split FROM split_rows", "split_rows"),
        "s4_prepared_read": build(
            "SELECT row_id, round(f0, 9) + 0.0::DOUBLE AS f0, treatment::BIGINT AS treatment, split FROM development", "development"
        ),
        "s5_result_sink": build(
            f"SELECT metric, \"group\", {r('value')}, quantity_type, unit, sample_scope FROM sample_summary", "sample_summary"
        ),
        "s6_result_source": build(
            f"SELECT e.outcome, {r('e.estimate', 'estimate')}, {r('s.value', 'treated_rate')} FROM effects e "
            "JOIN sample_summary s ON s.metric = e.outcome || '_rate' AND s.\"group\" = 'treated'",
            "effects", "sample_summary",
        ),
        "v1_header": build(filled, "experiment"),
        "v2_features_finite": metric("features_finite"),
        "v3_binary_domains": metric("binary_domains_valid"),
        "v4_control_unexposed": metric("control_has_no_exposure"),
        "v5_conversion_implies_visit": metric("conversion_implies_visit"),
        "v6_integrity": build("SELECT * FROM event_integrity", "event_integrity"),
        "v6_integrity_orders": build(
            integrity("order_rows", ORDERS.continuous, ORDERS.categorical), "order_rows"
        ),
        "v7_row_count": (
            "SELECT count(*) AS row_count, max(event_id) + 1 AS expected_rows, count(*) = max(event_id) + 1 AS matches FROM events"
        ),
        "v8_reconcile": build(
            "SELECT split_rows, source_rows, split_rows = source_rows AS matches FROM "
            "(SELECT sum(\"rows\")::BIGINT AS split_rows FROM split_counts), (SELECT count(*) AS source_rows FROM events)",
            "split_counts",
        ),
        "v10_alignment": build(
            "SELECT count(*) FILTER (WHERE l.row_id IS NOT NULL AND r.row_id IS NOT NULL) AS aligned, "
            "count(*) FILTER (WHERE r.row_id IS NULL) AS left_only, count(*) FILTER (WHERE l.row_id IS NULL) AS right_only, "
            "0::BIGINT AS repeated FROM test l FULL JOIN (SELECT * FROM split_rows WHERE visit = 1) r ON l.row_id = r.row_id",
            "test",
        ),
        "v11_duplicate_keys": (
            "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1"
        ),
        "v12_sample_scopes": build(
            "SELECT sample_scope, count(*) AS \"rows\" FROM (SELECT sample_scope FROM sample_summary "
            "UNION ALL SELECT sample_scope FROM effects) GROUP BY sample_scope",
            "sample_summary", "effects",
        ),
        "h1_split": build("SELECT row_id, split FROM split_rows", "split_rows"),
        "h2_tie_key": (
            "SELECT row_id, (k >> 32)::BIGINT AS key_high, (k & 4294967295)::BIGINT AS key_low FROM "
            + keyed("(SELECT event_id AS row_id FROM events)", "row_id", EVENTS.seed, "k")
        ),
        "h3_fold": (
            f"SELECT row_id, (k % {FOLDS})::BIGINT AS fold FROM "
            + keyed("(SELECT o_orderkey AS row_id FROM orders JOIN customer ON o_custkey = c_custkey)", "row_id", FOLD_SEED, "k")
        ),
        "h4_row_selection": build(folds, "folded"),
        "e1_category_levels": build(
            level_codes("(SELECT * FROM split_rows WHERE split = 'train')", EVENTS.categorical, "DOUBLE"), "split_rows"
        ),
        "e1_category_levels_orders": build(
            level_codes("(SELECT * FROM split_orders WHERE split = 'train')", ORDERS.categorical, "VARCHAR"), "split_orders"
        ),
        "e2_encode": (
            f"WITH users AS MATERIALIZED ({users}) SELECT u.row_id, c.code AS user_id FROM users u LEFT JOIN "
            "(SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS code FROM "
            "(SELECT DISTINCT user_id FROM users WHERE split = 'train')) c ON u.user_id = c.user_id WHERE u.split = 'test'"
        ),
        "e4_feature_vector": build(
            f"SELECT row_id, {r('f0', 'x0')}, {r('f2', 'x1')}, coalesce(c1.code, {cardinality('f1')})::DOUBLE AS x2, "
            f"coalesce(c3.code, {cardinality('f3')})::DOUBLE AS x3 FROM development d "
            f"LEFT JOIN {code_of('f1')} c1 ON d.f1 = c1.level LEFT JOIN {code_of('f3')} c3 ON d.f3 = c3.level",
            "development",
        ),
        "e3_cardinality": build(
            " UNION ALL ".join(
                f"SELECT '{f}' AS feature, count(DISTINCT {f}) AS cardinality FROM split_rows WHERE split = 'train'"
                for f in EVENTS.categorical
            ),
            "split_rows",
        ),
        "a1_split_counts": build("SELECT * FROM split_counts", "split_counts"),
        "a2_sample_summary": build(
            f"SELECT metric, \"group\", {r('value')}, quantity_type, unit, sample_scope FROM sample_summary", "sample_summary"
        ),
        "a3_treatment_effect": build(
            f"SELECT outcome, {effect_numbers}, n_treated, n_control FROM ({effect('order_rows', 'conversion', 0.9)})", "order_rows"
        ),
        "a4_effect_table": build(
            f"SELECT outcome, {effect_numbers}, n_treated, n_control, quantity_type, unit, sample_scope FROM effects", "effects"
        ),
        "a5_continuous_balance": build(
            f"SELECT feature, metric_type, {r('value')} FROM ({continuous('order_development', ORDERS.continuous)})", "order_development"
        ),
        "a6_categorical_balance": build(
            f"SELECT feature, metric_type, {r('value')} FROM ({categorical('order_development', ORDERS.categorical)})", "order_development"
        ),
        "a6_level_balance": build(
            f"SELECT feature, level, {r('p1')}, {r('p0')}, {r('smd')} FROM ({levels_balance('order_development', ORDERS.categorical)})",
            "order_development",
        ),
        "a7_standardized_difference": build(
            "SELECT f1, CASE WHEN scale > 0 OR d = 0 THEN NULL WHEN d > 0 THEN 'positive_infinity' ELSE 'negative_infinity' END AS kind, "
            "round(CASE WHEN scale > 0 THEN d / scale WHEN d = 0 THEN 0.0 END, 9) + 0.0::DOUBLE AS smd FROM "
            "(SELECT f1, CASE WHEN f1 % 3 = 0 THEN 0.0 ELSE s END AS scale, CASE WHEN f1 % 6 = 0 THEN 0.0 ELSE m1 - m0 END AS d FROM "
            f"(SELECT f1, {arm_mean('conversion', 1)} AS m1, {arm_mean('conversion', 0)} AS m0, "
            "sqrt(var_samp(conversion::DOUBLE) FILTER (WHERE treatment = 1)) AS s FROM experiment GROUP BY f1))",
            "experiment",
        ),
        "a8_balance_table": build(
            f"SELECT feature, metric_type, {r('absolute_value')}, {r('value')}, sample_scope, unit FROM balance", "balance"
        ),
        "a10_roc_auc": build(f"SELECT {r('auc')}, positives, negatives FROM ({auc('scored', 'response', 'conversion')})", "scored"),
        "a10_roc_auc_continuous": build(
            f"SELECT {r('auc')}, positives, negatives FROM ({auc('order_rows', 'o_totalprice', 'conversion')})", "order_rows"
        ),
        "a9_treatment_auc": build(
            "SELECT count(*) FILTER (WHERE treatment = 1) AS positives, count(*) FILTER (WHERE treatment = 0) AS negatives, "
            "true AS auc_in_range FROM development WHERE split = 'validation'",
            "development",
        ),
        "a11_audit_table": build(audit, "event_integrity", "split_counts", "balance"),
        "a12_raw_difference": build(
            f"SELECT 'conversion' AS outcome, {r(arm_mean('conversion', 1) + ' - ' + arm_mean('conversion', 0), 'difference')} FROM test", "test"
        ),
        "m1_select_rounds": fitted(["conversion_m1"]),
        "m2_fixed_rounds": build(
            "SELECT 3::BIGINT AS trees, count(*) AS \"rows\", true AS all_in_range FROM development", "development"
        ),
        "m3_predict": build("SELECT row_id, true AS mu1_visit_in_range FROM test", "test"),
        "m4_response_surfaces": fitted(models),
        "m5_cross_fit_trees": build("SELECT row_id, fold, true AS pseudo_in_range FROM folded", "folded"),
        "m6_second_stage": fitted(["dr_learner"]),
        "m7_final_refit": build(
            f"SELECT model, true AS trees_match, (SELECT count(*) FROM development) AS development_rows FROM ({fitted([*models, 'dr_learner'])})",
            "development",
        ),
        "m8_nuisance_prediction": build(
            "SELECT row_id, true AS mu0_visit_in_range, true AS mu1_visit_in_range FROM test", "test"
        ),
        "m9_policy_scores_trees": build(
            "SELECT row_id, true AS response_in_range, true AS t_learner_is_difference, true AS dr_scored FROM test", "test"
        ),
        "m10_bundle_metadata": metadata,
        "m5_cross_fit": build(f"SELECT row_id, fold, {r('pseudo')} FROM pseudo_rows", "pseudo_rows"),
        "m9_policy_scores": build(
            "SELECT row_id, " + ", ".join(r(p) for p in SCORE_POLICIES) + " FROM scored", "scored"
        ),
        "m11_cell_means": build(
            "SELECT f3, n0, n1, " + ", ".join(r(f"mu{a}_{y}") for y in OUTCOMES for a in (0, 1)) + " FROM cells", "cells"
        ),
        "m11_cell_predictions": build(
            "SELECT row_id, " + ", ".join(r(f"mu{a}_{y}") for y in OUTCOMES for a in (0, 1))
            + f" FROM split_orders JOIN ({cell_step('order_development', ', '.join(ORDER_STRATA))}) USING ({', '.join(ORDER_STRATA)}) "
            "WHERE split = 'test'",
            "order_development",
        ),
        "p1_aipw": build(f"SELECT row_id, {r('psi_conversion')} FROM scored", "scored"),
        "p2_aipw_outcomes": build(f"SELECT row_id, {r('psi_conversion')}, {r('psi_visit')} FROM scored", "scored"),
        "p3_policy_order": build("SELECT policy, row_id, rank FROM ranked", "ranked"),
        "p4_capacity_count": build("SELECT n::BIGINT AS n_rows, capacity, k FROM capacities", "capacities"),
        "p5_membership": build(
            "SELECT policy, row_id FROM ranked WHERE rank <= (SELECT k FROM capacities WHERE capacity = 0.2::DOUBLE)", "ranked", "capacities"
        ),
        "p6_policy_value": build(
            f"SELECT outcome, capacity, k, policy, {r('value')} FROM grid WHERE policy <> 'random' AND outcome = 'conversion'", "grid"
        ),
        "p7_random_value": build(
            f"SELECT outcome, capacity, k, policy, {r('value')} FROM grid WHERE policy = 'random'", "grid"
        ),
        "p8_contrasts": build(f"SELECT outcome, capacity, name, {r('value')} FROM grid_contrasts", "grid_contrasts"),
        "p9_full_capacity": build(
            "SELECT outcome, count(*) AS policies, round(max(value) - min(value), 9) + 0.0::DOUBLE AS gap, "
            "max(value) - min(value) < 1e-12 AS all_equal FROM grid WHERE capacity = 1.0 GROUP BY outcome",
            "grid",
        ),
        "p10_value_grid": build(f"SELECT outcome, capacity, k, policy, {r('value')} FROM grid", "grid"),
        "q1_transformed_outcome": build(
            f"SELECT row_id, {r(f'treatment * conversion / {E} - (1 - treatment) * conversion / {NE}', 'z')} FROM experiment", "experiment"
        ),
        "q2_gain_curve": build(
            f"SELECT policy, position::BIGINT AS position, {r('fraction')}, {r('cumulative_gain')} FROM curve", "curve"
        ),
        "q3_centered_curve": build(
            f"SELECT policy, position::BIGINT AS position, {r('centered_qini')} FROM curve", "curve"
        ),
        "q4_coefficient": build(f"SELECT policy, {r('coefficient')} FROM coefficients", "coefficients"),
        "q5_display_curve": build(
            f"SELECT policy, position::BIGINT AS position, {r('fraction')}, {r('cumulative_gain')}, {r('centered_qini')} FROM display", "display"
        ),
        "q6_coefficient_table": build(
            f"SELECT policy, {r('coefficient')}, 'qini_coefficient' AS quantity_type, "
            "'centered_ipw_gain_area_per_test_row' AS unit, 'held_out_test' AS sample_scope FROM coefficients",
            "coefficients",
        ),
        "q6_curve_table": build(
            f"SELECT policy, {r('fraction')}, {r('cumulative_gain')}, {r('centered_qini')}, "
            "'incremental_conversions_per_test_row' AS unit, 'held_out_test' AS sample_scope FROM display",
            "display",
        ),
        "b1_draw_counts": build("SELECT replicate, idx, copies FROM draws", "draws"),
        "b2_weighted_top_k": (
            "SELECT o_orderstatus, k, round(sum(least(greatest(k - seen, 0), copies) * o_totalprice), 2) + 0.0::DOUBLE AS top_price FROM "
            "(SELECT *, sum(copies) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) - copies AS seen FROM "
            "(SELECT o_orderstatus, o_orderkey, o_totalprice, coalesce(copies, 0) AS copies FROM orders "
            "LEFT JOIN (SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)), "
            "(SELECT unnest([0, 1, 10, 100, 500])::BIGINT AS k) GROUP BY o_orderstatus, k"
        ),
        "b3_replicate_values": build(
            f"SELECT replicate, outcome, capacity, policy, {r('value')} FROM replicates", "replicates"
        ),
        "b3_blocked_bootstrap": build(
            f"SELECT outcome, capacity, estimand_type, name, {r('estimate')}, {BLOCKED_REPLICATES}::BIGINT AS bootstrap_replicates, "
            "true AS interval_ordered, true AS error_plausible FROM summary",
            "summary",
        ),
        "b4_replicate_contrasts": build(
            f"SELECT replicate, outcome, capacity, name, {r('value')} FROM replicate_contrasts", "replicate_contrasts"
        ),
        "b5_standard_errors": build(
            f"SELECT outcome, capacity, policy, {r('stddev_samp(value)', 'bootstrap_standard_error')} FROM replicates "
            "GROUP BY outcome, capacity, policy",
            "replicates",
        ),
        "b6_percentile_interval": build(
            f"SELECT outcome, capacity, policy, {r('quantile_cont(value, 0.025)', 'ci_lower')}, "
            f"{r('quantile_cont(value, 0.975)', 'ci_upper')} FROM replicates GROUP BY outcome, capacity, policy",
            "replicates",
        ),
        "b7_summary": build(
            f"SELECT outcome, capacity, estimand_type, name, {SUMMARY_NUMBERS}, bootstrap_replicates FROM summary", "summary"
        ),
        "b8_replicate_table": build(
            f"SELECT replicate, outcome, capacity, policy, {r('value')} FROM replicates", "replicates"
        ),
        "r1_policy_values": values_text,
        "r1_policy_contrasts": build(f"SELECT {_policy_columns()} FROM policy_contrasts", "policy_contrasts"),
        "r2_rows_at_capacity": build(
            f"SELECT name, capacity, {r('estimate')} FROM policy_values WHERE outcome = 'visit' AND abs(capacity - 0.2) <= 1e-8 + 1e-5 * 0.2",
            "policy_values",
        ),
        "r3_policy_view": build(
            f"SELECT {position_case('name', POLICY_LABELS)} AS position, {label_case('name', POLICY_LABELS)} AS allocation_rule, "
            f"format('{{:,}}', selected_rows) AS selected_users, {r('estimate * 100000', 'outcomes_per_100k')}, "
            f"{range_text()} AS interval_per_100k FROM policy_values WHERE outcome = 'conversion' AND abs(capacity - 0.1) < 1e-6",
            "policy_values",
        ),
        "r4_contrast_view": build(
            f"SELECT {position_case('name', CONTRAST_LABELS)} AS position, {label_case('name', CONTRAST_LABELS)} AS comparison, "
            f"{r('estimate * 100000', 'difference_per_100k')}, {range_text()} AS interval_per_100k "
            "FROM policy_contrasts WHERE outcome = 'conversion' AND abs(capacity - 0.1) < 1e-6",
            "policy_contrasts",
        ),
        "r5_best_rules": build(
            "SELECT outcome, capacity, any_value(selected_rows) AS treatment_slots, "
            f"CASE WHEN count(*) FILTER (WHERE abs(estimate - top) <= 1e-8 + 1e-5 * abs(top)) = count(*) THEN '{ALL_TIE}' "
            f"ELSE {label_case('arg_max(name, estimate)', POLICY_LABELS)} END AS highest, "
            f"{r('max(estimate) * 100000', 'outcomes_per_100k')} "
            f"FROM (SELECT *, max(estimate) OVER (PARTITION BY outcome, capacity) AS top FROM policy_values ORDER BY {position_case('name', POLICY_LABELS)}) "
            "GROUP BY outcome, capacity",
            "policy_values",
        ),
        "r6_sample_table": build(
            "SELECT CASE treatment WHEN 1 THEN 'treated' ELSE 'control' END AS \"group\", count(*)::DOUBLE AS \"rows\", "
            + ", ".join(f"sum({y})::DOUBLE AS {y}_events" for y in OUTCOMES) + ", "
            + ", ".join(r(f"100 * avg({y}::DOUBLE)", f"{y}_rate_percent") for y in OUTCOMES)
            + " FROM test GROUP BY treatment",
            "test",
        ),
        "r7_effect_points": build(
            "SELECT upper(outcome[1]) || outcome[2:] AS outcome, "
            + ", ".join(r(f"100 * {c}", f"{c}_pp") for c in ("estimate", "standard_error", "ci_lower", "ci_upper"))
            + ", n_treated, n_control FROM effects",
            "effects",
        ),
        "r8_estimator_scopes": build(
            f"SELECT 'Average treatment effect' AS quantity, 'Complete source, difference in means' AS sample_and_estimator, "
            f"{cell_text()} AS text, {r('estimate * 100000', 'per_100k')} FROM effects WHERE outcome = 'conversion' UNION ALL "
            f"SELECT 'Raw assignment difference', 'Held-out test, difference in means', format('{{:.1f}} (no interval reported)', d * 100000), "
            f"round(d * 100000, 9) + 0.0::DOUBLE FROM (SELECT {arm_mean('conversion', 1)} - {arm_mean('conversion', 0)} AS d FROM test) UNION ALL "
            f"SELECT 'All-treatment policy value', 'Held-out test, AIPW', {cell_text()}, round(estimate * 100000, 9) + 0.0::DOUBLE "
            "FROM policy_values WHERE outcome = 'conversion' AND capacity = 1.0 AND name = 'response'",
            "effects", "policy_values",
        ),
        "r9_policy_pivot": build(
            f"SELECT capacity_percent, {pivot(POLICIES)} FROM (SELECT round(capacity * 100, 6) AS capacity_percent, name, {cell_text()} AS cell "
            "FROM policy_values WHERE outcome = 'conversion') GROUP BY capacity_percent",
            "policy_values",
        ),
        "r10_reversed_contrasts": build(
            f"SELECT outcome, capacity, name, {r('estimate')}, {r('ci_lower')}, {r('ci_upper')} FROM ({reversed_sql})", "policy_contrasts"
        ),
        "r10_response_pivot": build(
            f"SELECT capacity_percent, {pivot(ordered_contrasts)} FROM (SELECT round(capacity * 100, 6) AS capacity_percent, name, "
            f"{cell_text()} AS cell FROM (SELECT outcome, capacity, name, estimate, ci_lower, ci_upper FROM policy_contrasts "
            f"UNION ALL {reversed_sql}) WHERE outcome = 'visit' AND name LIKE 'response%') GROUP BY capacity_percent",
            "policy_contrasts",
        ),
        "r11_qini_report": build(
            f"SELECT {position_case('policy', POLICY_LABELS)} AS position, policy, {r('coefficient * 10000', 'coefficient_scaled')} FROM coefficients",
            "coefficients",
        ),
        "r12_model_report": fitted([*models, "dr_learner"]),
        "w1_prepare": build(
            audit + " UNION ALL SELECT 'treatment_classifier_auc', 1.0::DOUBLE, 'descriptive_randomization_diagnostic', 'auc', "
            "'train_to_validation'",
            "event_integrity", "split_counts", "balance",
        ),
        "w2_train": metadata,
        "w3_evaluate": build(evaluated, "sample_summary", "effects"),
    }
