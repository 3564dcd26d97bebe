"""Experiment funnels: aggregation, comparison of arms, verdicts, and calibration of offline against production."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import stats
from tallymark.operators.correlate import part

EVENTS = ("reach", "choice", "attempt", "operation_result", "consumption")
RATES = {"selection_rate": ("selected", "reached"), "operation_success_rate": ("succeeded", "operations"), "consumption_rate": ("consumed", "succeeded")}


def validate_funnel(rows: DataFrame) -> DataFrame:
    """Add the first violation of a funnel event, or null: kind, ids, and what the kind requires."""
    f = F.col
    first = F.coalesce(
        F.when(~F.coalesce(f("event").isin(*EVENTS), F.lit(False)), "event: not an event kind"),
        *(F.when(f(c).isNull() | (f(c) == ""), f"{c}: required") for c in ("assignment_id", "harness_id", "task_id", "variant_id")),
        F.when((f("event") == "choice") & f("selected_subject").isNull(), "selected_subject: required"),
        F.when(f("event").isin("attempt", "operation_result") & ~F.coalesce(f("outcome").isin("success", "failure", "denied", "unknown"), F.lit(False)), "outcome: not an outcome"),
        F.when((f("event") == "attempt") & ~F.coalesce(f("steps") >= 0, F.lit(False)), "steps: below minimum"),
        F.when((f("event") == "operation_result") & ~F.coalesce(f("attempts") >= 1, F.lit(False)), "attempts: below minimum"),
        F.when((f("event") == "consumption") & f("consumed").isNull(), "consumed: required"),
    )
    return rows.withColumn("violation", first)


def annotate_strata(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Add stratum of the task, category/tier; tasks that the dimension lacks are unknown/unknown."""
    known = strata.select("task_id", F.concat_ws("/", "category", "tier").alias("_stratum"))
    return rows.join(known, "task_id", "left").withColumn("stratum", F.coalesce("_stratum", F.lit("unknown/unknown"))).drop("_stratum")


def funnel_aggregate(rows: DataFrame, keys: list[str], *more: list[str]) -> DataFrame:
    """Counts per key set, all sets in one pass: reached, selected, operations, succeeded, attempts, consumed, cost."""
    e = F.col("event")
    counts = [
        F.count_if(e == "reach").alias("reached"), F.count_if((e == "choice") & F.col("selected_subject")).alias("selected"), F.count_if(e == "operation_result").alias("operations"),
        F.count_if((e == "operation_result") & (F.col("outcome") == "success")).alias("succeeded"), F.sum(F.when(e == "operation_result", F.col("attempts")).otherwise(0)).cast("long").alias("attempts"),
        F.count_if((e == "consumption") & F.col("consumed")).alias("consumed"), F.sum(F.when(e == "attempt", F.col("cost_units")).otherwise(0.0)).cast("double").alias("cost"),
    ]
    if not more:
        return rows.groupBy(*keys).agg(*counts)
    every = list(dict.fromkeys(sum(more, list(keys))))
    return rows.groupingSets([keys, *more], *every).agg(F.grouping_id(*every).cast("long").alias("level"), *counts)


def median_steps(rows: DataFrame, keys: list[str]) -> DataFrame:
    per = rows.where("event = 'attempt'").groupBy(*keys, "assignment_id").agg(F.sum("steps").alias("steps"))
    return per.groupBy(*keys).agg(F.percentile("steps", F.lit(0.5)).alias("median_steps"))


def with_rates(cells: DataFrame) -> DataFrame:
    out = cells
    for name, (a, b) in RATES.items():
        out = out.withColumn(name, F.when(F.col(b) > 0, F.col(a) / F.col(b)))
    return out.withColumn("cost_per_operation", F.when(F.col("operations") > 0, F.col("cost") / F.col("operations")))


def compare_arms(cells: DataFrame, baseline: str, within: list[str], rate: str = "selection_rate", alpha: float = 0.05, min_n: int = 100) -> DataFrame:
    """Each variant against the baseline of its cell: difference, interval, z, p_value, verdict, direction, reason and required_n.

    Cells are few rows by now; the baseline's are joined on the cell's key.
    """
    a, b = RATES[rate]
    arms = cells.select(*within, "variant_id", F.col(a).alias("k"), F.col(b).alias("n"))
    base = arms.where(F.col("variant_id") == baseline).select(*within, F.col("k").alias("k0"), F.col("n").alias("n0"))
    arms = arms.where(F.col("variant_id") != baseline)
    met = arms.join(base, within, "left") if within else arms.crossJoin(base)
    met = met.fillna(0, ["k0", "n0"])
    low, high = stats.newcombe("k0", "n0", "k", "n")
    some = (F.col("n0") > 0) & (F.col("n") > 0)
    out = met.withColumn("difference", F.when(some, F.col("k") / F.col("n") - F.col("k0") / F.col("n0"))).withColumn("low", low).withColumn("high", high)
    out = out.withColumn("z", stats.two_proportion_z("k0", "n0", "k", "n"))
    out = out.withColumn("p_value", stats.two_sided_p("z"))
    enough = some & (F.col("n0") >= min_n) & (F.col("n") >= min_n)
    significant = F.col("p_value") < alpha
    verdict = F.when(~enough, "undetermined").when(significant, "significant").otherwise("null_result")
    direction = F.when(verdict == "significant", F.when(F.col("difference") > 0, "improvement").otherwise("regression"))
    reason = F.when(~some, "empty arm").when(~enough, "small sample").when(verdict == "null_result", "no significant difference")
    share = F.col("k0") / F.col("n0")
    # What it would take: without a share in the baseline, a stand-in keeps the formula defined. Its values are fixed by the comparison's rules.
    stand_in = F.when(verdict == "undetermined", F.col("difference") / 2 + 0.01).otherwise(0.02)
    needed = F.when(some & (F.col("difference") != 0) & (verdict != "significant"), stats.required_n(F.when(share > 0, share).otherwise(stand_in), F.col("k") / F.col("n"), alpha))
    return out.withColumn("verdict", verdict).withColumn("direction", direction).withColumn("reason", reason).withColumn("required_n", needed.cast("long"))


def rounded(compared: DataFrame) -> DataFrame:
    """A comparison as it is published: difference and interval to 4 digits, z and p to 6; verdicts come from unrounded values."""
    digits = {"difference": 4, "low": 4, "high": 4, "z": 6, "p_value": 6}
    return compared.withColumns({c: F.round(c, n) for c, n in digits.items()})


def guardrails(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(variant_id, metric, value, status) by thresholds (metric, min, max); no data is unknown."""
    long = with_rates(cells).unpivot(["variant_id"], [*RATES, "cost_per_operation"], "metric", "value")
    met = long.join(limits, "metric")
    bad = (F.col("value") > F.col("max")) | (F.col("value") < F.col("min"))
    status = F.when(F.col("value").isNull(), "unknown").when(F.coalesce(bad, (F.col("value") > F.col("max")), (F.col("value") < F.col("min")), F.lit(False)), "breach").otherwise("pass")
    return met.select("variant_id", "metric", "value", status.alias("status"))


def fake_growth(cells: DataFrame, baseline: str, alpha: float = 0.05) -> DataFrame:
    """Flag variants whose consumption fell: significantly, or by more than five points."""
    out = compare_arms(cells, baseline, [], "consumption_rate", alpha, 0)
    significant, material = F.col("p_value") < alpha, F.col("difference") < -0.05
    flagged = (F.col("difference") < -0.005) & (significant | material)
    kind = F.when(flagged, F.when(significant, "significant").otherwise("material"))
    return out.select("variant_id", F.col("difference").alias("consumption_delta"), F.coalesce(flagged, F.lit(False)).alias("flagged"), kind.alias("kind"))


def margin(cells: DataFrame, baseline: str, opportunity: float | None, conversion: float | None, margin_per_event: float | None, serving_cost: float = 0.0) -> DataFrame:
    """Incremental margin a month: opportunity, change in selection, success, consumption, conversion and margin, less serving.

    Without a parameter it is not computable. Consumption is the variant's own.
    """
    rows = with_rates(cells)
    base = rows.where(F.col("variant_id") == baseline).select(F.col("selection_rate").alias("_base"))
    met = rows.where(F.col("variant_id") != baseline).crossJoin(base).withColumn("selection_delta", F.col("selection_rate") - F.col("_base"))
    known = None not in (opportunity, conversion, margin_per_event)
    value = F.lit(None).cast("double")
    if known:
        value = F.lit(float(opportunity)) * F.col("selection_delta") * F.coalesce("operation_success_rate", F.lit(0.0)) * F.coalesce("consumption_rate", F.lit(0.0)) * float(conversion) * float(margin_per_event) - serving_cost
    return met.select("variant_id", "selection_delta", F.lit(known).alias("computable"), value.alias("margin"))


def dominance(variants: DataFrame) -> DataFrame:
    """dominated_by of each row: the first other one, in manifest order (``place``), that earns no less and costs less.

    Both must be significant improvements. ``variants``: variant_id, place, improved, margin, difference, cost, consumption.
    """
    good = variants.where("improved")
    a, b = good.alias("a"), good.alias("b")
    by_margin = F.col("a.margin").isNotNull() & F.col("b.margin").isNotNull()
    value = F.when(by_margin, F.col("a.margin") >= F.col("b.margin") * 0.98).otherwise(F.coalesce("a.difference", F.lit(0.0)) >= F.coalesce("b.difference", F.lit(0.0)) * 0.98)
    beats = (F.col("a.variant_id") != F.col("b.variant_id")) & value & (F.col("a.cost") < F.col("b.cost") * 0.98) & (F.col("a.consumption") >= F.col("b.consumption"))
    met = b.join(a, beats).groupBy(F.col("b.variant_id").alias("variant_id")).agg(F.min_by(F.col("a.variant_id"), F.col("a.place")).alias("dominated_by"))
    return variants.join(met, "variant_id", "left")


#: What to do about each final word.
ACTIONS = {
    "adopt_candidate": "ship behind a flag",
    "effective_not_qualified": "do not ship: guardrail breach",
    "unverified_growth": "do not ship: fix consumption first",
    "regression_reject": "reject",
    "null_result": "no action",
    "undetermined": "collect more data",
}


def variant_verdicts(compared: DataFrame, flags: DataFrame, breaches: DataFrame, dominated: DataFrame | None = None) -> DataFrame:
    """The final word on each variant, and what to do.

    Only a significant improvement can be flagged as growth that consumption doesn't follow, and then as one that breaks a guardrail;
    a significant regression is rejected; all else keeps the comparison's verdict. Who is dominated is not to be picked, whatever else.
    """
    broken = breaches.where("status = 'breach'").select("variant_id").distinct().withColumn("broken", F.lit(True))
    met = compared.join(flags.select("variant_id", "flagged"), "variant_id", "left").join(broken, "variant_id", "left")
    met = met.join(dominated.select("variant_id", "dominated_by"), "variant_id", "left") if dominated is not None else met.withColumn("dominated_by", F.lit(None).cast("string"))
    flagged, broke = F.coalesce("flagged", F.lit(False)), F.coalesce("broken", F.lit(False))
    final = F.when(F.col("verdict") != "significant", F.col("verdict")).when(F.col("direction") == "regression", "regression_reject")
    final = final.when(flagged, "unverified_growth").when(broke, "effective_not_qualified").otherwise("adopt_candidate")
    action = F.when(F.col("dominated_by").isNotNull(), F.concat(F.lit("do not pick: dominated by "), "dominated_by"))
    for word, what in ACTIONS.items():
        action = action.when(final == word, what)
    return met.select("variant_id", "verdict", "direction", final.alias("final"), "dominated_by", action.alias("action"))


def calibrate(offline: DataFrame, production: DataFrame, keys: list[str]) -> DataFrame:
    """Offline and production comparisons of the same cells: transfer, its interval, and one of five verdicts."""
    side = lambda d, s: d.select(*keys, *(F.col(c).alias(f"{c}_{s}") for c in ("difference", "low", "high", "verdict")))
    met = side(offline, "off").join(side(production, "prod"), keys, "full")
    half = lambda s: F.coalesce(F.pow((F.col(f"high_{s}") - F.col(f"low_{s}")) / 2, F.lit(2.0)), F.lit(0.0))
    width = F.sqrt(half("off") + half("prod"))
    out = met.withColumn("transfer", F.col("difference_off") - F.col("difference_prod"))
    out = out.withColumn("transfer_low", F.when(width > 0, F.col("transfer") - width)).withColumn("transfer_high", F.when(width > 0, F.col("transfer") + width))
    direction = F.coalesce("difference_off", F.lit(0.0)) * F.coalesce("difference_prod", F.lit(0.0))
    missing = F.col("verdict_off").isNull() | F.col("verdict_prod").isNull()
    verdict = F.when(missing, "not_comparable").when(F.col("verdict_prod") == "undetermined", "undetermined").when((F.col("verdict_prod") == "significant") & (direction > 0), "production_confirmed")
    verdict = verdict.when((F.col("verdict_prod") == "significant") & (direction < 0), "direction_mismatch").when(F.col("verdict_prod") == "null_result", "transfer_not_established").otherwise("not_comparable")
    widths = [(F.col(f"high_{s}") - F.col(f"low_{s}")).alias(f"width_{s}") for s in ("off", "prod")]
    return out.select(*keys, "difference_off", "difference_prod", "transfer", "transfer_low", "transfer_high", *widths, verdict.alias("calibration"))


def reweighting_top3(calibrated: DataFrame, condition: str) -> DataFrame:
    """Per variant the three conditions with the most transfer, then the widest offline interval."""
    order = Window.partitionBy("variant_id").orderBy(F.desc(F.abs("transfer")), F.desc("width_off"), condition)
    return calibrated.where("transfer IS NOT NULL").withColumn("place", F.row_number().over(order)).where("place <= 3").select("variant_id", condition, F.col("place").cast("long").alias("place"), "transfer", "width_off")


def assignment_plan(harnesses: DataFrame, tasks: DataFrame, variants: DataFrame, experiment: str, replicates: int, seed: int) -> DataFrame:
    """Every harness and task with blocks that hold each variant once, in an order that a hash of the seed decides."""
    blocks = harnesses.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "block")
    rows = harnesses.crossJoin(tasks).crossJoin(variants).crossJoin(blocks)
    turn = F.sha2(F.concat_ws("|", F.lit(experiment), F.lit(str(seed)), "harness_id", "task_id", F.col("block").cast("string"), "variant_id"), 256)
    order = Window.partitionBy("harness_id", "task_id").orderBy("block", turn)
    out = rows.withColumn("replicate", F.row_number().over(order).cast("long"))
    name = F.concat_ws("/", F.lit(experiment), "harness_id", "task_id", F.concat(F.lit("r"), F.lpad(F.col("replicate").cast("string"), 4, "0")), "variant_id")
    return out.select("harness_id", "task_id", "variant_id", "block", "replicate", name.alias("assignment_id"))


def plan_balance(plan: DataFrame, max_attempts: int, max_steps: int) -> DataFrame:
    """Assignments per arm, whether arms differ by one at most, and the most the plan can cost."""
    arms = plan.groupBy("variant_id").agg(F.count("*").alias("assignments"))
    out = arms.agg(F.sum("assignments").alias("total"), (F.max("assignments") - F.min("assignments") <= 1).alias("balanced"))
    return out.withColumn("max_cost", F.col("total") * F.lit(max_attempts * max_steps * 2.5))


#: The data class of each event kind; fixed by the connection rules.
CLASSES = {"reach": "choice", "choice": "choice", "attempt": "execution", "operation_result": "execution", "consumption": "consumption"}


def connector_aggregate(rows: DataFrame, tiers: dict[str, str], export: bool = False, revoked: bool = False) -> DataFrame:
    """Counts per variant from the data classes (choice, execution, consumption) that a connection allows, and which it left out.

    A class's tier is off, local or export; ``off`` never enters the aggregation, and an export holds the export tier only. A
    revoked connection exports nothing, nor does one without such a class: both raise.
    """
    if export and revoked:
        raise ValueError("the connection is revoked")
    classes = sorted(set(CLASSES.values()))
    allowed = [c for c in classes if tiers.get(c, "off") == "export" or (tiers.get(c, "off") == "local" and not export)]
    if export and not allowed:
        raise ValueError("no data class may be exported")
    e = F.col("event")
    out = rows.where(e.isin(*(k for k, c in CLASSES.items() if c in allowed))).groupBy(F.coalesce("variant_id", F.lit("unknown")).alias("variant_id")).agg(
        F.count_if(e == "reach").alias("reach"), F.count_if((e == "choice") & F.col("selected_subject")).alias("selected"), F.count_if(e == "operation_result").alias("operations"),
        F.count_if((e == "operation_result") & (F.col("outcome") == "success")).alias("operations_succeeded"), F.sum(F.when(e == "operation_result", F.coalesce("attempts", F.lit(0))).otherwise(0)).cast("long").alias("attempts"),
        F.count_if((e == "consumption") & F.col("consumed")).alias("consumed"),
    )
    return out.withColumn("excluded", F.lit(",".join(c for c in classes if c not in allowed)))


#: A row's SHA-256 as so many numbers of 64 bits, each added up modulo 2^64.
LANES = 4
MODULUS = "18446744073709551616"


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text, by name of column, each with its length before it; null is a dash."""
    return F.sha2(F.concat_ws("|", *(part(F.col(f"`{c}`").cast("string")) for c in sorted(columns))), 256)


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, lane0 ... lane3): a digest of a table as a multiset, which neither order nor partitioning changes.

    Lanes are sums modulo 2^64 of the rows' SHA-256, so a repeated row counts, and fingerprints of parts add up: see ``merged``.
    An empty table has zeros. Names of columns are not in the digest, only their order by name.
    """
    digest = row_digest(rows.columns)
    lane = lambda k: F.sum(F.conv(F.substring("_d", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)"))
    whole = F.lit(MODULUS).cast("decimal(20,0)")
    out = rows.select(digest.alias("_d")).agg(F.count("*").alias("rows"), *((F.coalesce(lane(k), F.lit(0)) % whole).cast("decimal(20,0)").alias(f"lane{k}") for k in range(LANES)))
    return out


def merged_fingerprint(parts: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The fingerprint of a table from those of its parts, less those of parts that are gone; equal to computing it anew."""
    names = ["rows", *(f"lane{k}" for k in range(LANES))]
    signed = parts.select(*names, F.lit(1).alias("_s"))
    if gone is not None:
        signed = signed.unionByName(gone.select(*names, F.lit(-1).alias("_s")))
    whole = F.lit(MODULUS).cast("decimal(20,0)")
    lanes = (F.pmod(F.coalesce(F.sum(F.col(f"lane{k}") * F.col("_s")), F.lit(0)).cast("decimal(38,0)"), whole).cast("decimal(20,0)").alias(f"lane{k}") for k in range(LANES))
    return signed.agg(F.coalesce(F.sum(F.col("rows") * F.col("_s")), F.lit(0)).alias("rows"), *lanes)


def improved(compared: DataFrame) -> Column:
    return (compared["verdict"] == "significant") & (compared["direction"] == "improvement")
