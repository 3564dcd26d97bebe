"""Queries of experiments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions import stats
from tallymark.operators import experiment
from tallymark.plans.registry import query
from tallymark.plans.views import STEPS, key_part, view

COUNTS = """count(*) FILTER (event = 'reach') AS reached, count(*) FILTER (event = 'choice' AND selected_subject) AS selected, count(*) FILTER (event = 'operation_result') AS operations,
  count(*) FILTER (event = 'operation_result' AND outcome = 'success') AS succeeded, CAST(coalesce(sum(attempts) FILTER (event = 'operation_result'), 0) AS BIGINT) AS attempts,
  count(*) FILTER (event = 'consumption' AND consumed) AS consumed, CAST(coalesce(sum(cost_units) FILTER (event = 'attempt'), 0) AS DOUBLE) AS cost"""


def _wilson(k: str, n: str) -> tuple[str, str]:
    z = stats.Z95
    centre, half = f"(({k} / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n}))", f"({z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z * z} / (4 * {n} * {n})) / (1 + {z * z} / {n}))"
    return f"greatest(0.0, {centre} - {half})", f"least(1.0, {centre} + {half})"


#: The square of the normal quantiles of 0.975 and 0.8, added up.
QUANTILES = (1.959963984540054 + 0.8416212335729143) ** 2


def _power() -> str:
    """The polynomial of two_sided_p, in t."""
    power = repr(stats.ERFC[-1])
    for c in reversed(stats.ERFC[:-1]):
        power = f"({power} * t + {c!r})"
    return power


def _compared(cells: str, keys: str, rate: str = "selection_rate", min_n: int = 100) -> str:
    """The SELECT of compare_arms."""
    k, n = experiment.RATES[rate]
    (l1, u1), (l2, u2) = _wilson("k0", "n0"), _wilson("k", "n")
    same = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", ") if c) or "true"
    inner = f"""SELECT a.*, coalesce(b.k, 0) AS k0, coalesce(b.n, 0) AS n0 FROM (SELECT {keys + ", " if keys else ""}variant_id, {k} AS k, {n} AS n FROM {cells} WHERE variant_id <> 'v0') a
      LEFT JOIN (SELECT {keys + ", " if keys else ""}{k} AS k, {n} AS n FROM {cells} WHERE variant_id = 'v0') b ON {same}"""
    return f"""SELECT *, CASE WHEN NOT (n0 > 0 AND n > 0 AND n0 >= {min_n} AND n >= {min_n}) THEN 'undetermined' WHEN p_value < 0.05 THEN 'significant' ELSE 'null_result' END AS verdict,
    CASE WHEN NOT (n0 > 0 AND n > 0) THEN 'empty arm' WHEN NOT (n0 >= {min_n} AND n >= {min_n}) THEN 'small sample' WHEN p_value >= 0.05 THEN 'no significant difference' END AS reason,
    CASE WHEN n0 > 0 AND n > 0 AND difference <> 0 AND NOT (n0 >= {min_n} AND n >= {min_n} AND p_value < 0.05) THEN CAST(ceil({QUANTILES!r} *
      (q * (1 - q) + k / n * (1 - k / n)) / ((k / n - q) * (k / n - q))) AS BIGINT) END AS required_n,
    CASE WHEN n0 > 0 AND n > 0 AND n0 >= {min_n} AND n >= {min_n} AND p_value < 0.05 THEN CASE WHEN difference > 0 THEN 'improvement' ELSE 'regression' END END AS direction FROM
    (SELECT *, least(1.0, t * exp(-x * x + {_power()})) AS p_value, CASE WHEN k0 > 0 THEN k0 / n0 WHEN n0 < {min_n} OR n < {min_n} THEN difference / 2 + 0.01 ELSE 0.02 END AS q FROM (SELECT *, 1 / (1 + x / 2) AS t FROM (SELECT *, abs(z) / {2**0.5!r} AS x FROM (SELECT *, k / n - k0 / n0 AS difference,
      CASE WHEN n0 > 0 AND n > 0 THEN greatest(-1.0, k / n - k0 / n0 - sqrt((k / n - {l2}) * (k / n - {l2}) + ({u1} - k0 / n0) * ({u1} - k0 / n0))) END AS low,
      CASE WHEN n0 > 0 AND n > 0 THEN least(1.0, k / n - k0 / n0 + sqrt(({u2} - k / n) * ({u2} - k / n) + (k0 / n0 - {l1}) * (k0 / n0 - {l1}))) END AS high,
      CASE WHEN n0 > 0 AND n > 0 THEN CASE WHEN (k + k0) IN (0, n + n0) THEN 0.0 ELSE (k / n - k0 / n0) / sqrt((k + k0) / (n + n0) * (1 - (k + k0) / (n + n0)) * (1 / n0 + 1 / n)) END END AS z FROM ({inner})))))"""


STEPS |= {
    "s_cells": f"SELECT variant_id, {COUNTS} FROM fx_funnel GROUP BY variant_id",
    "s_off": f"SELECT task_id, variant_id, {COUNTS} FROM fx_funnel WHERE environment = 'offline' GROUP BY task_id, variant_id",
    "s_prod": f"SELECT task_id, variant_id, {COUNTS} FROM fx_funnel WHERE environment = 'production' GROUP BY task_id, variant_id",
    "s_rates": "SELECT *, selected / nullif(reached, 0) AS selection_rate, succeeded / nullif(operations, 0) AS operation_success_rate, consumed / nullif(succeeded, 0) AS consumption_rate, cost / nullif(operations, 0) AS cost_per_operation FROM s_cells",
    "s_compared": _compared("s_cells", ""),
    "s_cmp_off": _compared("s_off", "task_id"),
    "s_cmp_prod": _compared("s_prod", "task_id"),
    "s_fake": f"""SELECT variant_id, difference AS consumption_delta, coalesce(difference < -0.005 AND (p_value < 0.05 OR difference < -0.05), false) AS flagged,
      CASE WHEN difference < -0.005 AND p_value < 0.05 THEN 'significant' WHEN difference < -0.05 THEN 'material' END AS kind FROM ({_compared("s_cells", "", "consumption_rate", 0)})""",
    "s_guard": """SELECT variant_id, metric, value, CASE WHEN value IS NULL THEN 'unknown' WHEN value > hi OR value < lo THEN 'breach' ELSE 'pass' END AS status FROM
      (SELECT variant_id, 'selection_rate' AS metric, selection_rate AS value, CAST(NULL AS DOUBLE) AS hi, 0.4 AS lo FROM s_rates UNION ALL SELECT variant_id, 'cost_per_operation', cost_per_operation, 22.0, CAST(NULL AS DOUBLE) FROM s_rates)""",
    "s_margin": """SELECT variant_id, selection_rate - (SELECT selection_rate FROM s_rates WHERE variant_id = 'v0') AS selection_delta, true AS computable,
      100000.0 * (selection_rate - (SELECT selection_rate FROM s_rates WHERE variant_id = 'v0')) * operation_success_rate * consumption_rate * 0.1 * 2.0 - 50.0 AS margin FROM s_rates WHERE variant_id <> 'v0'""",
    "s_improved": "SELECT c.variant_id, c.verdict = 'significant' AND c.direction = 'improvement' AS improved, m.margin, r.cost_per_operation AS cost, r.consumption_rate AS consumption FROM s_compared c JOIN s_margin m ON c.variant_id = m.variant_id JOIN s_rates r ON c.variant_id = r.variant_id",
    "s_dominated": """SELECT b.variant_id, (SELECT min(a.variant_id) FROM s_improved a WHERE b.improved AND a.improved AND a.variant_id <> b.variant_id AND a.margin >= b.margin * 0.98 AND a.cost < b.cost * 0.98
      AND a.consumption >= b.consumption) AS dominated_by FROM s_improved b""",
    "s_calibrated": """SELECT *, CASE WHEN width > 0 THEN transfer - width END AS transfer_low, CASE WHEN width > 0 THEN transfer + width END AS transfer_high,
      CASE WHEN vo IS NULL OR vp IS NULL THEN 'not_comparable' WHEN vp = 'undetermined' THEN 'undetermined' WHEN vp = 'significant' AND difference_off * difference_prod > 0 THEN 'production_confirmed'
        WHEN vp = 'significant' AND difference_off * difference_prod < 0 THEN 'direction_mismatch' WHEN vp = 'null_result' THEN 'transfer_not_established' ELSE 'not_comparable' END AS calibration FROM
      (SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.variant_id, b.variant_id) AS variant_id, a.difference AS difference_off, b.difference AS difference_prod, a.difference - b.difference AS transfer,
        sqrt(coalesce(((a.high - a.low) / 2) ** 2, 0) + coalesce(((b.high - b.low) / 2) ** 2, 0)) AS width, a.high - a.low AS width_off, b.high - b.low AS width_prod, a.verdict AS vo, b.verdict AS vp
        FROM s_cmp_off a FULL JOIN s_cmp_prod b ON a.task_id = b.task_id AND a.variant_id = b.variant_id)""",
    "s_plan": """SELECT harness_id, task_id, variant_id, block, row_number() OVER (PARTITION BY harness_id, task_id ORDER BY block, sha256(concat_ws('|', 'exp-1', '7', harness_id, task_id, CAST(block AS VARCHAR), variant_id))) AS replicate
      FROM (SELECT DISTINCT harness_id FROM fx_funnel), (SELECT DISTINCT task_id FROM fx_funnel), (SELECT DISTINCT variant_id FROM fx_funnel), (SELECT unnest(range(1, 5)) AS block)""",
}


def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_funnel")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.funnel_aggregate(funnel(spark, sf_dir), ["variant_id"])


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.compare_arms(cells(spark, sf_dir), "v0", [])


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = [experiment.compare_arms(experiment.funnel_aggregate(funnel(spark, sf_dir).where(F.col("environment") == e), ["task_id", "variant_id"]), "v0", ["task_id"]) for e in ("offline", "production")]
    return experiment.calibrate(*both, ["task_id", "variant_id"])


LIMITS = [("selection_rate", 0.4, None), ("cost_per_operation", None, 22.0)]


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.guardrails(cells(spark, sf_dir), spark.createDataFrame(LIMITS, "metric string, min double, max double"))


def faulty(rows: DataFrame) -> DataFrame:
    """Faults in a fixed share of rows, by the number in assignment_id."""
    n = F.regexp_extract("assignment_id", r"(\d+)$", 1).cast("long")
    rows = rows.withColumn("event", F.when(n % 17 == 0, "other").otherwise(F.col("event"))).withColumn("task_id", F.when(n % 19 == 0, "").otherwise(F.col("task_id")))
    return rows.withColumn("outcome", F.when(n % 23 == 0, "maybe").otherwise(F.col("outcome")))


@query(
    "validate_funnel",
    """SELECT event, violation, count(*) AS n FROM (SELECT CASE WHEN i % 17 = 0 THEN 'other' ELSE event END AS event,
    CASE WHEN i % 17 = 0 THEN 'event: not an event kind' WHEN i % 19 = 0 THEN 'task_id: required' WHEN i % 23 = 0 AND event IN ('attempt', 'operation_result') THEN 'outcome: not an outcome' END AS violation FROM
    (SELECT event, CAST(regexp_extract(assignment_id, '(\\d+)$', 1) AS BIGINT) AS i FROM fx_funnel)) GROUP BY ALL""",
)
def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.validate_funnel(faulty(funnel(spark, sf_dir))).groupBy("event", "violation").agg(F.count("*").alias("n"))


@query(
    "funnel_aggregate",
    f"SELECT harness_id, task_id, variant_id, CAST(grouping(variant_id, harness_id, task_id) AS BIGINT) AS level, {COUNTS} FROM fx_funnel GROUP BY GROUPING SETS ((variant_id), (harness_id, variant_id), (task_id, variant_id))",
)
def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.funnel_aggregate(funnel(spark, sf_dir), ["variant_id"], ["harness_id", "variant_id"], ["task_id", "variant_id"])


@query("median_steps", "SELECT variant_id, median(steps) AS median_steps FROM (SELECT variant_id, assignment_id, sum(steps) AS steps FROM fx_funnel WHERE event = 'attempt' GROUP BY ALL) GROUP BY variant_id")
def _median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.median_steps(funnel(spark, sf_dir), ["variant_id"])


@query("annotate_strata", "SELECT CASE task_id WHEN 't-1' THEN 'search/hard' WHEN 't-2' THEN 'search/easy' WHEN 't-3' THEN 'edit/easy' ELSE 'unknown/unknown' END AS stratum, count(*) AS n FROM fx_funnel GROUP BY ALL")
def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = spark.createDataFrame([("t-1", "search", "hard"), ("t-2", "search", "easy"), ("t-3", "edit", "easy")], "task_id string, category string, tier string")
    return experiment.annotate_strata(funnel(spark, sf_dir), strata).groupBy("stratum").agg(F.count("*").alias("n"))


_low, _high = _wilson("selected", "reached")


@query("wilson_interval", f"SELECT variant_id, {_low} AS low, {_high} AS high FROM s_cells")
def _interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = stats.wilson("selected", "reached")
    return cells(spark, sf_dir).select("variant_id", low.alias("low"), high.alias("high"))


@query("two_proportion_z", "SELECT variant_id, z FROM s_compared")
def _z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("variant_id", "z")


@query("newcombe_diff", "SELECT variant_id, low, high FROM s_compared")
def _newcombe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).select("variant_id", "low", "high")


@query(
    "required_n",
    f"""SELECT variant_id, uplift, CAST(ceil({QUANTILES!r} * (p * (1 - p) + (p + uplift) * (1 - p - uplift)) / ((p + uplift - p) * (p + uplift - p))) AS BIGINT) AS n FROM
    (SELECT variant_id, u.uplift, selected / reached AS p FROM s_cells, (VALUES (CAST(0.02 AS DOUBLE)), (0.03), (0.05), (0.08)) AS u(uplift))""",
)
def _required(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir).select("variant_id", (F.col("selected") / F.col("reached")).alias("p"), F.explode(F.array(*map(F.lit, (0.02, 0.03, 0.05, 0.08)))).alias("uplift"))
    return rows.select("variant_id", "uplift", stats.required_n("p", F.col("p") + F.col("uplift")).cast("long").alias("n"))


@query("compare_arms", "SELECT variant_id, k, n, k0, n0, difference, low, high, z, p_value, verdict, direction, reason, required_n FROM s_compared")
def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir)


@query("compare_arms_rounded", "SELECT variant_id, round(difference, 4) AS difference, round(low, 4) AS low, round(high, 4) AS high, round(z, 6) AS z, round(p_value, 6) AS p_value, verdict, direction FROM s_compared")
def _rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.rounded(compared(spark, sf_dir)).select("variant_id", "difference", "low", "high", "z", "p_value", "verdict", "direction")


@query("guardrails", "SELECT * FROM s_guard")
def _guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sf_dir)


@query("fake_growth", "SELECT * FROM s_fake")
def _fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.fake_growth(cells(spark, sf_dir), "v0")


@query("margin", "SELECT * FROM s_margin")
def _margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.margin(cells(spark, sf_dir), "v0", 100_000.0, 0.1, 2.0, 50.0)


@query("dominance", "SELECT * FROM s_dominated")
def _dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominated(spark, sf_dir)


def dominated(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, own = compared(spark, sf_dir), cells(spark, sf_dir)
    rates = experiment.with_rates(own).select("variant_id", F.col("cost_per_operation").alias("cost"), F.col("consumption_rate").alias("consumption"))
    earned = experiment.margin(own, "v0", 100_000.0, 0.1, 2.0, 50.0).select("variant_id", "margin")
    rows = c.select("variant_id", "difference", experiment.improved(c).alias("improved"), F.col("variant_id").alias("place")).join(rates, "variant_id").join(earned, "variant_id")
    return experiment.dominance(rows).select("variant_id", "dominated_by")


@query(
    "variant_verdicts",
    """SELECT variant_id, verdict, direction, final, dominated_by, CASE WHEN dominated_by IS NOT NULL THEN concat('do not pick: dominated by ', dominated_by) WHEN final = 'adopt_candidate' THEN 'ship behind a flag'
      WHEN final = 'effective_not_qualified' THEN 'do not ship: guardrail breach' WHEN final = 'unverified_growth' THEN 'do not ship: fix consumption first' WHEN final = 'regression_reject' THEN 'reject'
      WHEN final = 'null_result' THEN 'no action' ELSE 'collect more data' END AS action FROM
    (SELECT c.variant_id, verdict, direction, dominated_by, CASE WHEN verdict = 'significant' AND direction = 'improvement' THEN (CASE WHEN f.flagged THEN 'unverified_growth'
        WHEN c.variant_id IN (SELECT variant_id FROM s_guard WHERE status = 'breach') THEN 'effective_not_qualified' ELSE 'adopt_candidate' END) WHEN verdict = 'significant' THEN 'regression_reject' ELSE verdict END AS final
      FROM s_compared c LEFT JOIN s_fake f ON c.variant_id = f.variant_id LEFT JOIN s_dominated d ON c.variant_id = d.variant_id)""",
)
def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.variant_verdicts(compared(spark, sf_dir), experiment.fake_growth(cells(spark, sf_dir), "v0"), guarded(spark, sf_dir), dominated(spark, sf_dir))


@query("calibrate", "SELECT task_id, variant_id, difference_off, difference_prod, transfer, transfer_low, transfer_high, width_off, width_prod, calibration FROM s_calibrated")
def _calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrated(spark, sf_dir)


@query(
    "reweighting_top3",
    "SELECT * FROM (SELECT variant_id, task_id, row_number() OVER (PARTITION BY variant_id ORDER BY abs(transfer) DESC, width_off DESC, task_id) AS place, transfer, width_off FROM s_calibrated WHERE transfer IS NOT NULL) WHERE place <= 3",
)
def _top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.reweighting_top3(calibrated(spark, sf_dir), "task_id")


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = funnel(spark, sf_dir)
    return experiment.assignment_plan(rows.select("harness_id").distinct(), rows.select("task_id").distinct(), rows.select("variant_id").distinct(), "exp-1", 4, 7)


@query("assignment_plan", "SELECT harness_id, task_id, variant_id, block, replicate, concat_ws('/', 'exp-1', harness_id, task_id, concat('r', lpad(CAST(replicate AS VARCHAR), 4, '0')), variant_id) AS assignment_id FROM s_plan")
def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir)


@query(
    "plan_balance",
    "SELECT CAST(sum(n) AS BIGINT) AS total, max(n) - min(n) <= 1 AS balanced, CAST(sum(n) * 3 * 20 * 2.5 AS DOUBLE) AS max_cost FROM (SELECT variant_id, count(*) AS n FROM s_plan GROUP BY variant_id)",
)
def _balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.plan_balance(planned(spark, sf_dir), 3, 20)


@query(
    "connector_aggregate",
    """SELECT variant_id, CAST(count(*) FILTER (event = 'reach') AS BIGINT) AS reach, count(*) FILTER (event = 'choice' AND selected_subject) AS selected, count(*) FILTER (event = 'operation_result') AS operations,
    count(*) FILTER (event = 'operation_result' AND outcome = 'success') AS operations_succeeded, CAST(coalesce(sum(attempts) FILTER (event = 'operation_result'), 0) AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS consumed,
    'consumption' AS excluded FROM fx_funnel WHERE event <> 'consumption' GROUP BY variant_id""",
)
def _connector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment.connector_aggregate(funnel(spark, sf_dir), {"choice": "export", "execution": "export", "consumption": "local"}, export=True)


PRINTED = "assignment_id attempts environment event harness_id outcome steps task_id variant_id".split()
_digest = "sha256(concat_ws('|', " + ", ".join(f"{key_part(f'CAST({c} AS VARCHAR)')}" for c in PRINTED) + "))"
_lanes = ", ".join(f"CAST(sum(CAST(concat('0x', substr(d, {16 * k + 1}, 16)) AS UBIGINT)) % 18446744073709551616 AS VARCHAR) AS lane{k}" for k in range(4))


@query("table_fingerprint", f"SELECT count(*) AS rows, {_lanes} FROM (SELECT {_digest} AS d FROM fx_funnel)")
def _fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By task, merged: the fingerprint of the whole."""
    rows = funnel(spark, sf_dir).select(*PRINTED)
    out = experiment.table_fingerprint(rows)
    return out.select("rows", *(F.col(f"lane{k}").cast("string").alias(f"lane{k}") for k in range(experiment.LANES)))
