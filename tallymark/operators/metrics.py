"""Metrics per project over a window of attempts. Counts come with every ratio; an empty denominator gives null."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVALID = ("health_check", "load_test", "duplicate", "replay", "suspected_invalid")
CORROBORATED = ("corroborated", "independently-corroborated")
#: Upper bounds in milliseconds of the latency buckets but the last.
LATENCY = (("<1s", 1_000), ("1s-10s", 10_000), ("10s-60s", 60_000), ("1m-10m", 600_000))


def window(rows: DataFrame, as_of: str, days: int, at: str = "started_at") -> DataFrame:
    """The trailing window; it has no upper bound."""
    return rows.where(F.col(at).cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b)


def attempt_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(F.count("*").alias("attempts"), F.sum(F.col("eligible").cast("long")).alias("eligible_attempts"))


def operation_count(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("project_id").agg(F.count_distinct("operation_id").alias("operations"), F.count("*").alias("n"))
    return out.select("project_id", "operations", F.when(F.col("operations") == 0, F.col("n")).otherwise(0).alias("legacy_attempt_equivalent"))


def operation_coverage(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("project_id").agg(F.count("operation_id").alias("resolved"), F.count("*").alias("attempts"))
    return out.select("*", (F.col("attempts") - F.col("resolved")).alias("unresolved"), ratio("resolved", "attempts").alias("coverage"))


def resolution_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "resolution").agg(F.count("*").alias("attempts"))


def attempts_per_operation(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("project_id").agg(F.count("*").alias("attempts"), F.count_distinct("operation_id").alias("operations"))
    return out.withColumn("attempts_per_operation", ratio("attempts", "operations"))


def attempt_completion_rate(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("project_id").agg(F.count_if("has_completed").alias("completed"), F.count("*").alias("invoked"))
    return out.withColumn("rate", ratio("completed", "invoked"))


def attempt_success_rate(rows: DataFrame) -> DataFrame:
    """Successes among decided outcomes; unknown and inconsistent ones are counted apart."""
    is_ = lambda *o: F.count_if(F.col("outcome").isin(*o))
    out = rows.where("eligible = 1").groupBy("project_id").agg(is_("success").alias("success"), is_("success", "failure", "denied").alias("decided"), is_("unknown").alias("unknown"), is_("inconsistent").alias("inconsistent"))
    return out.withColumn("rate", ratio("success", "decided"))


def operation_success_rate(rows: DataFrame) -> DataFrame:
    per = rows.where("operation_id IS NOT NULL").groupBy("project_id", "operation_id").agg(F.bool_or(F.col("outcome") == "success").alias("ok"), F.bool_or("has_completed").alias("done"))
    out = per.where("done").groupBy("project_id").agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("completed"))
    return out.withColumn("rate", ratio("succeeded", "completed"))


def outcome_shares(rows: DataFrame) -> DataFrame:
    out = rows.where("eligible = 1").groupBy("project_id").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("success"), F.count_if(F.col("outcome").isin("failure", "denied")).alias("failure"))
    out = out.withColumn("unknown", F.col("n") - F.col("success") - F.col("failure"))
    return out.select("*", *(ratio(c, "n").alias(f"{c}_share") for c in ("success", "failure", "unknown")))


def share_of(rows: DataFrame, condition: Column, name: str) -> DataFrame:
    """How many eligible attempts meet a condition, and their share."""
    out = rows.where("eligible = 1").groupBy("project_id").agg(F.count_if(condition).alias(name), F.count("*").alias("eligible_attempts"))
    return out.withColumn("share", ratio(name, "eligible_attempts"))


def corroborated_share(rows: DataFrame) -> DataFrame:
    return share_of(rows, F.col("evidence").isin(*CORROBORATED), "corroborated")


def qualified_usage(rows: DataFrame) -> DataFrame:
    return share_of(rows, (F.col("usage_context") == "production") & (F.col("validity") == "normal"), "qualified")


def caller_coverage(rows: DataFrame) -> DataFrame:
    return share_of(rows, F.col("caller_known"), "known_callers")


def collection_coverage(rows: DataFrame) -> DataFrame:
    out = share_of(rows, F.col("collection_flagged"), "flagged")
    return out.select("project_id", "flagged", "eligible_attempts", (1 - F.col("share")).alias("coverage"))


def extended_usage(rows: DataFrame) -> DataFrame:
    """Strictly qualified attempts, production ones of unknown validity, and the unknown shares."""
    c, v = F.col("usage_context"), F.col("validity")
    out = rows.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if((c == "production") & (v == "normal")).alias("strict"), F.count_if((c == "production") & (v == "unknown")).alias("extended"), F.count_if(c == "unknown").alias("unknown_context"), F.count_if(v == "unknown").alias("unknown_validity"))
    return out.select("*", ratio("unknown_context", "n").alias("unknown_context_share"), ratio("unknown_validity", "n").alias("unknown_validity_share"))


def evidence_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "evidence").agg(F.count("*").alias("attempts"))


def in_window(keyed: DataFrame, columns: list[str], as_of: str, days: int) -> DataFrame:
    """(project_id, attempt_key, columns) once for each attempt that started in the window; attempts are not derived again."""
    seen = keyed.groupBy("project_id", "attempt_key", *columns).agg(F.min("observed_at").alias("at"))
    start = F.min("at").over(Window.partitionBy("project_id", "attempt_key"))
    return seen.withColumn("at", start).where(F.col("at").cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))).drop("at")


def observer_mix(keyed: DataFrame, as_of: str, days: int) -> DataFrame:
    """Distinct attempts per project and observing principal, from the keyed observations of attempts."""
    return in_window(keyed, ["observer_principal"], as_of, days).groupBy("project_id", "observer_principal").agg(F.count("*").alias("attempts"))


def qualification_mix(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id", "qualification_status").agg(F.count("*").alias("attempts"))


def validity_coverage(rows: DataFrame) -> DataFrame:
    v = F.col("validity")
    out = rows.where("usage_context = 'production'").groupBy("project_id").agg(F.count("*").alias("production"), F.count_if(v == "normal").alias("normal"), F.count_if(v.isin(*INVALID)).alias("invalid"), F.count_if(v == "unknown").alias("unknown"))
    return out.withColumn("classified_share", ratio(F.col("normal") + F.col("invalid"), "production"))


def caller_mix(keyed: DataFrame, as_of: str, days: int) -> DataFrame:
    """Distinct attempts per project and runtime, strength, and both; the level says which of the two is summed over.

    Each attempt is reduced to one row a pair before the grouping sets; then an attempt counts once where it first has the value.
    """
    pair = ["caller_runtime", "identity_strength"]
    seen = in_window(keyed, pair, as_of, days).where("caller_runtime IS NOT NULL")
    first = lambda c: F.row_number().over(Window.partitionBy("project_id", "attempt_key", c).orderBy(*pair)) == 1
    seen = seen.withColumn("_runtime", first("caller_runtime")).withColumn("_strength", first("identity_strength"))
    level = 2 * F.grouping("caller_runtime").cast("long") + F.grouping("identity_strength").cast("long")
    sets = [["project_id", *pair], ["project_id", "caller_runtime"], ["project_id", "identity_strength"]]
    counted = F.when(level == 1, F.count_if("_runtime")).when(level == 2, F.count_if("_strength")).otherwise(F.count("*"))
    return seen.groupingSets(sets, "project_id", *pair).agg(level.alias("level"), counted.alias("attempts"))


def latency_bucket(ms: str | Column) -> Column:
    ms = F.col(ms) if isinstance(ms, str) else ms
    out = F.when(ms.isNull(), F.lit(None).cast("string"))
    for name, end in LATENCY:
        out = out.when(ms < end, name)
    return out.otherwise(">10m")


def latency_stats(obs: DataFrame) -> DataFrame:
    """n, min, max, mean, p50, p95 and buckets per project, from a histogram of whole milliseconds.

    A percentile is the value at place min(n - 1, floor(n p)) of the sorted list, found by running sums over the histogram.
    """
    bars = obs.where("duration_ms IS NOT NULL").groupBy("project_id", "duration_ms").agg(F.count("*").alias("k"))
    order = Window.partitionBy("project_id").orderBy("duration_ms")
    whole = Window.partitionBy("project_id")
    bars = bars.withColumn("upto", F.sum("k").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(whole))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p)), F.col("duration_ms")))
    buckets = [F.sum(F.when(latency_bucket("duration_ms") == name, F.col("k")).otherwise(0)).alias(f"b{i}") for i, name in enumerate([x for x, _ in LATENCY] + [">10m"])]
    out = bars.groupBy("project_id").agg(F.max("n").alias("n"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), (F.sum(F.col("duration_ms") * F.col("k")) / F.sum("k")).alias("mean_ms"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), *buckets)
    return out


def active_clients(rows: DataFrame, strict: bool = True) -> DataFrame:
    if strict:
        rows = rows.where("usage_context = 'production' AND validity = 'normal'")
    return rows.where("client_key IS NOT NULL").groupBy("project_id").agg(F.count_distinct("client_key").alias("clients"))


def active_client_days(rows: DataFrame) -> DataFrame:
    days = rows.where("client_key IS NOT NULL").select("project_id", "client_key", F.to_date("started_at").alias("day")).distinct()
    return days.groupBy("project_id").agg(F.count("*").alias("client_days"))


def repeat_clients(rows: DataFrame, window_days: int) -> DataFrame:
    """Clients active in two windows or more, of those active in any."""
    index = F.floor(F.unix_date(F.to_date("started_at")) / window_days)
    per = rows.where("client_key IS NOT NULL").select("project_id", "client_key", index.alias("i")).distinct().groupBy("project_id", "client_key").agg(F.count("*").alias("windows"))
    return per.groupBy("project_id").agg(F.count_if(F.col("windows") >= 2).alias("repeat_clients"), F.count("*").alias("clients"))


def active_days(rows: DataFrame) -> DataFrame:
    """(project_id, client_key, first, words): a client's first day (days since 1970), and a bit for each active day, by words of 64 days."""
    day = F.unix_date(F.to_date("started_at")).cast("long")
    days = rows.where("client_key IS NOT NULL AND started_at IS NOT NULL").select("project_id", "client_key", day.alias("day"))
    word = F.floor(F.col("day") / 64).cast("long")
    words = days.groupBy("project_id", "client_key", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(day, 64) AS INT))")).alias("bits"), F.min("day").alias("day"))
    # A client has one entry for each 64 days at most.
    return words.groupBy("project_id", "client_key").agg(F.min("day").alias("first"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def active_on(day: Column, words: str = "words") -> Column:
    """Whether a day's bit is set."""
    bits = F.try_element_at(words, F.floor(day / 64).cast("long"))
    return F.coalesce(F.getbit(bits, F.pmod(day, F.lit(64)).cast("int")) == 1, F.lit(False))


def cohort_retention(rows: DataFrame, after: tuple[int, ...] = (7, 30), within: int = 1) -> DataFrame:
    """Per project and month of first use: clients, and those active ON the 7th and 30th day after their first, or on one of the
    ``within`` days that begin with it. No client goes out; attempts are read once, and days are tested by their bits."""
    held = active_days(rows)
    again = lambda d: functools.reduce(lambda a, b: a | b, (active_on(F.col("first") + d + k) for k in range(within)))
    kept = [F.count_if(again(d)).alias(f"d{d}") for d in after]
    cohort = F.date_format(F.date_from_unix_date(F.col("first").cast("int")), "yyyy-MM")
    return held.groupBy("project_id", cohort.alias("cohort")).agg(F.count("*").alias("clients"), *kept)


#: Sizes of sketches: 2^LG entries of a set's, and K of a distribution's.
LG, K = 14, 400


def client_ledger(rows: DataFrame) -> DataFrame:
    """A mergeable row per project and day (project_id, day, clients, members): a sketch that counts clients, and one that intersects."""
    days = rows.where("client_key IS NOT NULL AND started_at IS NOT NULL").select("project_id", "client_key", F.to_date("started_at").alias("day"))
    return days.groupBy("project_id", "day").agg(F.hll_sketch_agg("client_key", F.lit(LG)).alias("clients"), F.theta_sketch_agg("client_key", F.lit(LG)).alias("members"))


def days_between(ledger: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """The ledger's days from first to last, both included; null is open."""
    out = ledger if first is None else ledger.where(F.col("day") >= F.lit(first).cast("date"))
    return out if last is None else out.where(F.col("day") <= F.lit(last).cast("date"))


def active_clients_sketched(ledger: DataFrame, first: str | None = None, last: str | None = None) -> DataFrame:
    """About how many clients each project had in a window of days: a merge of as many small rows, attempts are not read.

    The relative standard error is 0.83 / sqrt(2^LG): 0.65 %.
    """
    return days_between(ledger, first, last).groupBy("project_id").agg(F.hll_sketch_estimate(F.hll_union_agg("clients")).alias("clients"))


def repeat_clients_sketched(ledger: DataFrame, window_days: int, first: str | None = None, last: str | None = None) -> DataFrame:
    """About how many clients each project had in two windows or more, and in any.

    Days are merged to windows; going through them, what a window shares with all before it joins the repeated ones. Exact below 2^LG
    clients; above, an intersection's error is 1 / sqrt(2^LG) of the union it is taken from: 0.8 %.
    """
    index = F.floor(F.unix_date("day") / window_days)
    windows = days_between(ledger, first, last).groupBy("project_id", index.alias("i")).agg(F.theta_union_agg("members").alias("m"))
    # One sketch a window: as many as the time has windows.
    lists = windows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda w: w["m"]).alias("w"))
    start = F.struct(F.get("w", F.lit(0)).alias("seen"), F.theta_difference(F.get("w", F.lit(0)), F.get("w", F.lit(0))).alias("again"))
    join = lambda s, m: F.struct(F.theta_union(s["seen"], m).alias("seen"), F.theta_union(s["again"], F.theta_intersection(s["seen"], m)).alias("again"))
    both = F.aggregate(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), start, join)
    return lists.select("project_id", both.alias("s")).select("project_id", F.theta_sketch_estimate("s.again").alias("repeat_clients"), F.theta_sketch_estimate("s.seen").alias("clients"))


def latency_ledger(obs: DataFrame) -> DataFrame:
    """A mergeable row per project and day (project_id, day, latency): a sketch of durations in milliseconds."""
    rows = obs.where("duration_ms IS NOT NULL").select("project_id", F.to_date("observed_at").alias("day"), F.col("duration_ms").cast("long").alias("ms"))
    return rows.groupBy("project_id", "day").agg(F.kll_sketch_agg_bigint("ms", F.lit(K)).alias("latency"))


def latency_sketched(ledger: DataFrame, first: str | None = None, last: str | None = None, at: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """n and percentiles of each project in a window of days, from merged sketches; a percentile's rank is off by 0.7 % at most (99 %)."""
    merged = days_between(ledger, first, last).groupBy("project_id").agg(F.kll_merge_agg_bigint("latency").alias("s"))
    quantiles = [F.kll_sketch_get_quantile_bigint("s", F.lit(p)).alias(f"p{round(100 * p)}_ms") for p in at]
    return merged.select("project_id", F.kll_sketch_get_n_bigint("s").alias("n"), *quantiles)


def cost_economics(rows: DataFrame, by: tuple[str, ...] = ("project_id", "tool", "caller_known")) -> DataFrame:
    """Cost per capability and class of caller; it stays with the attempt that spent it."""
    out = rows.groupBy(*by).agg(F.sum("cost").alias("cost"), F.count_if(F.col("outcome") == "success").alias("successes"), F.count_distinct("operation_id").alias("operations"))
    return out.select("*", ratio("cost", "successes").alias("cost_per_success"), ratio("cost", "operations").alias("cost_per_operation"))


def delegation_metrics(rows: DataFrame) -> DataFrame:
    """Tasks by how many delegations, the deepest, and whether several harnesses took part."""
    per = rows.groupBy("parent_task_id").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"), F.count_distinct("provider").alias("harnesses"))
    out = per.groupBy("deepest").agg(F.count("*").alias("tasks"), F.sum("n").alias("delegations"), F.count_if(F.col("harnesses") >= 2).alias("cross_harness"))
    return out.withColumn("cross_harness_share", ratio("cross_harness", "tasks"))


def privacy_suppress(rows: DataFrame, rate: str, n: str, least: int = 10) -> DataFrame:
    """Hide a rate whose sample is below the threshold."""
    return rows.withColumn("suppressed", F.col(n) < least).withColumn(rate, F.when(F.col(n) >= least, F.col(rate)))


def strict_qualified(rows: DataFrame) -> DataFrame:
    """The attempts that count strictly: production and normal, by all who said so."""
    return rows.where("usage_context = 'production' AND validity = 'normal'")


def project_report(rows: DataFrame) -> DataFrame:
    """All attempt metrics of a project in one pass: counts, coverages and shares."""
    c, v, o, e = F.col("usage_context"), F.col("validity"), F.col("outcome"), F.col("evidence")
    have = lambda condition, name: F.count_if(condition).alias(name)
    out = rows.groupBy("project_id").agg(
        F.count("*").alias("attempts"), F.count_distinct("operation_id").alias("operations"), F.count("operation_id").alias("resolved"), have(o == "success", "success"), have(o.isin("failure", "denied"), "failure"),
        have(o == "unknown", "outcome_unknown"), have(o == "inconsistent", "outcome_inconsistent"), have(o.isin("success", "failure", "denied"), "decided"), have(F.col("has_completed"), "completed"),
        have(e.isin(*CORROBORATED), "corroborated"), have(e == "independently-corroborated", "independently_corroborated"), have(e == "authenticated", "authenticated"), have(e == "observed", "observed"),
        have((c == "production") & (v == "normal"), "qualified"), have((c == "production") & (v == "unknown"), "extended"), have(c == "unknown", "unknown_context"), have(v == "unknown", "unknown_validity"), have(v.isin(*INVALID), "invalid"),
        have(F.col("qualification_status") == "partially_classified", "partially_classified"), have(F.col("qualification_status") == "inconsistent", "qualification_inconsistent"),
        have(F.col("caller_known"), "known_callers"), have(F.col("collection_flagged"), "flagged"), have(F.col("has_client") & F.col("has_server"), "both_sides"), F.count_distinct("client_key").alias("clients"),
    )
    shares = {"success_rate": ("success", "decided"), "completion_rate": ("completed", "attempts"), "operation_coverage": ("resolved", "attempts"), "attempts_per_operation": ("attempts", "operations"), "corroborated_share": ("corroborated", "attempts"), "qualified_share": ("qualified", "attempts"), "caller_coverage": ("known_callers", "attempts")}
    return out.select("*", *(ratio(a, b).alias(name) for name, (a, b) in shares.items()), (1 - ratio("flagged", "attempts")).alias("collection_coverage"))


def report_sections(keyed: DataFrame, rows: DataFrame, latency: DataFrame, as_of: str, days: int) -> DataFrame:
    """(project_id, section, name, value): the parts of a project's report that are lists, and its latency and validity coverage.

    Sections: observers (attempts per principal), caller_by_runtime, caller_by_strength, evidence, operation_resolution,
    qualification_status, latency (n, min_ms, mean_ms, p50_ms, p95_ms, max_ms) and validity (production, classified, coverage). Rows, not
    lists, so that a project with many principals fills no task.
    """
    part = lambda table, section, name, value: table.select("project_id", F.lit(section).alias("section"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
    callers = caller_mix(keyed, as_of, days)
    out = part(observer_mix(keyed, as_of, days), "observers", "observer_principal", "attempts")
    for section, level, name in (("caller_by_runtime", 1, "caller_runtime"), ("caller_by_strength", 2, "identity_strength")):
        out = out.unionByName(part(callers.where(F.col("level") == level), section, name, "attempts"))
    # Attempts are derived once, and counted by all that these sections ask of them: a few hundred rows a project.
    kinds = rows.groupBy("project_id", "evidence", "resolution", "qualification_status", "usage_context", "validity").agg(F.count("*").alias("k"))
    for section, name in (("evidence", "evidence"), ("operation_resolution", "resolution"), ("qualification_status", "qualification_status")):
        out = out.unionByName(part(kinds.groupBy("project_id", name).agg(F.sum("k").alias("attempts")), section, name, "attempts"))
    figures = latency_stats(latency).unpivot(["project_id"], [F.col(c).cast("double").alias(c) for c in ("n", "min_ms", "mean_ms", "p50_ms", "p95_ms", "max_ms")], "name", "value")
    valid = kinds.where("usage_context = 'production'").groupBy("project_id").agg(F.sum("k").alias("production"), F.sum(F.when(F.col("validity").isin("normal", *INVALID), F.col("k")).otherwise(0)).alias("classified"))
    valid = valid.select("project_id", *(F.col(c).cast("double").alias(c) for c in ("production", "classified")), ratio("classified", "production").alias("coverage"))
    valid = valid.unpivot(["project_id"], ["production", "classified", "coverage"], "name", "value")
    for section, table in (("latency", figures), ("validity", valid)):
        out = out.unionByName(table.select("project_id", F.lit(section).alias("section"), "name", "value"))
    return out


def measurement_label(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """What a published number must say about itself."""
    eligible = F.col("eligible") == 1
    report = rows.groupBy("project_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("usage_context") == "unknown").alias("context"), F.count_if(F.col("validity") == "unknown").alias("validity"),
        F.count_if(eligible & F.col("evidence").isin(*CORROBORATED)).alias("corroborated"), F.count_if(eligible).alias("eligible_attempts"),
    ).where("eligible_attempts > 0")
    report = report.select("project_id", ratio("context", "n").alias("unknown_context_share"), ratio("validity", "n").alias("unknown_validity_share"), ratio("corroborated", "eligible_attempts").alias("share"))
    return report.select("project_id", F.lit("attempt").alias("grain"), F.lit(as_of).alias("as_of"), F.lit(days).cast("long").alias("window_days"), F.lit("observed").alias("coverage_basis"), "unknown_context_share", "unknown_validity_share", F.col("share").alias("corroborated_share"))
