"""Queries of correlation and of the usage metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import correlate, metrics
from tallymark.plans.registry import query
from tallymark.plans.views import AS_OF, DAYS, STEPS, key_part, view


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.dedup_observations(view(spark, sf_dir, "fx_obs"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.keyed(correlate.attempt_events_only(observations(spark, sf_dir)))


def windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.window(correlate.attempts(observations(spark, sf_dir)), AS_OF, DAYS)


#: Each client's first day and all of its days.
_DAYS = "SELECT project_id, client_key, min(CAST(started_at AS DATE)) AS a, list(DISTINCT CAST(started_at AS DATE)) AS days FROM s_w WHERE client_key IS NOT NULL GROUP BY ALL"

#: name: (metric, its SELECT over the windowed attempts w)
SIMPLE = {
    "attempt_counts": (metrics.attempt_counts, "SELECT project_id, count(*) AS attempts, count(*) AS eligible_attempts FROM s_w GROUP BY ALL"),
    "operation_count": (
        metrics.operation_count,
        "SELECT project_id, count(DISTINCT operation_id) AS operations, CASE WHEN count(DISTINCT operation_id) = 0 THEN count(*) ELSE 0 END AS legacy_attempt_equivalent FROM s_w GROUP BY ALL",
    ),
    "operation_coverage": (
        metrics.operation_coverage,
        "SELECT project_id, count(operation_id) AS resolved, count(*) AS attempts, count(*) - count(operation_id) AS unresolved, count(operation_id) / count(*) AS coverage FROM s_w GROUP BY ALL",
    ),
    "resolution_mix": (metrics.resolution_mix, "SELECT project_id, resolution, count(*) AS attempts FROM s_w GROUP BY ALL"),
    "attempts_per_operation": (
        metrics.attempts_per_operation,
        "SELECT project_id, count(*) AS attempts, count(DISTINCT operation_id) AS operations, count(*) / nullif(count(DISTINCT operation_id), 0) AS attempts_per_operation FROM s_w GROUP BY ALL",
    ),
    "attempt_completion_rate": (
        metrics.attempt_completion_rate,
        "SELECT project_id, count(*) FILTER (has_completed) AS completed, count(*) AS invoked, count(*) FILTER (has_completed) / count(*) AS rate FROM s_w GROUP BY ALL",
    ),
    "attempt_success_rate": (
        metrics.attempt_success_rate,
        """SELECT project_id, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome IN ('success', 'failure', 'denied')) AS decided, count(*) FILTER (outcome = 'unknown') AS unknown,
        count(*) FILTER (outcome = 'inconsistent') AS inconsistent, count(*) FILTER (outcome = 'success') / nullif(count(*) FILTER (outcome IN ('success', 'failure', 'denied')), 0) AS rate FROM s_w GROUP BY ALL""",
    ),
    "operation_success_rate": (
        metrics.operation_success_rate,
        """SELECT project_id, count(*) FILTER (ok) AS succeeded, count(*) AS completed, count(*) FILTER (ok) / count(*) AS rate FROM
        (SELECT project_id, operation_id, bool_or(outcome = 'success') AS ok, bool_or(has_completed) AS done FROM s_w WHERE operation_id IS NOT NULL GROUP BY ALL) WHERE done GROUP BY ALL""",
    ),
    "outcome_shares": (
        metrics.outcome_shares,
        """SELECT *, success / n AS success_share, failure / n AS failure_share, unknown / n AS unknown_share FROM (SELECT project_id, count(*) AS n, count(*) FILTER (outcome = 'success') AS success,
        count(*) FILTER (outcome IN ('failure', 'denied')) AS failure, count(*) FILTER (outcome NOT IN ('success', 'failure', 'denied')) AS unknown FROM s_w GROUP BY ALL)""",
    ),
    "corroborated_share": (
        metrics.corroborated_share,
        "SELECT *, corroborated / eligible_attempts AS share FROM (SELECT project_id, count(*) FILTER (evidence IN ('corroborated', 'independently-corroborated')) AS corroborated, count(*) AS eligible_attempts FROM s_w GROUP BY ALL)",
    ),
    "qualified_usage": (
        metrics.qualified_usage,
        "SELECT *, qualified / eligible_attempts AS share FROM (SELECT project_id, count(*) FILTER (usage_context = 'production' AND validity = 'normal') AS qualified, count(*) AS eligible_attempts FROM s_w GROUP BY ALL)",
    ),
    "caller_coverage": (metrics.caller_coverage, "SELECT *, known_callers / eligible_attempts AS share FROM (SELECT project_id, count(*) FILTER (caller_known) AS known_callers, count(*) AS eligible_attempts FROM s_w GROUP BY ALL)"),
    "collection_coverage": (
        metrics.collection_coverage,
        "SELECT *, 1 - flagged / eligible_attempts AS coverage FROM (SELECT project_id, count(*) FILTER (collection_flagged) AS flagged, count(*) AS eligible_attempts FROM s_w GROUP BY ALL)",
    ),
    "extended_usage": (
        metrics.extended_usage,
        """SELECT *, unknown_context / n AS unknown_context_share, unknown_validity / n AS unknown_validity_share FROM (SELECT project_id, count(*) AS n, count(*) FILTER (usage_context = 'production' AND validity = 'normal') AS strict,
        count(*) FILTER (usage_context = 'production' AND validity = 'unknown') AS extended, count(*) FILTER (usage_context = 'unknown') AS unknown_context, count(*) FILTER (validity = 'unknown') AS unknown_validity FROM s_w GROUP BY ALL)""",
    ),
    "evidence_mix": (metrics.evidence_mix, "SELECT project_id, evidence, count(*) AS attempts FROM s_w GROUP BY ALL"),
    "qualification_mix": (metrics.qualification_mix, "SELECT project_id, qualification_status, count(*) AS attempts FROM s_w GROUP BY ALL"),
    "validity_coverage": (
        metrics.validity_coverage,
        """SELECT *, (normal + invalid) / production AS classified_share FROM (SELECT project_id, count(*) AS production, count(*) FILTER (validity = 'normal') AS normal,
        count(*) FILTER (validity NOT IN ('normal', 'unknown')) AS invalid, count(*) FILTER (validity = 'unknown') AS unknown FROM s_w WHERE usage_context = 'production' GROUP BY ALL)""",
    ),
    "active_clients": (metrics.active_clients, "SELECT project_id, count(DISTINCT client_key) AS clients FROM s_w WHERE usage_context = 'production' AND validity = 'normal' AND client_key IS NOT NULL GROUP BY ALL"),
    "active_client_days": (metrics.active_client_days, "SELECT project_id, count(DISTINCT (client_key, CAST(started_at AS DATE))) AS client_days FROM s_w WHERE client_key IS NOT NULL GROUP BY ALL"),
    "cohort_retention": (
        metrics.cohort_retention,
        f"SELECT project_id, strftime(a, '%Y-%m') AS cohort, count(*) AS clients, count(*) FILTER (list_contains(days, a + 7)) AS d7, count(*) FILTER (list_contains(days, a + 30)) AS d30 FROM ({_DAYS}) GROUP BY ALL",
    ),
    "cohort_retention_weekly": (
        lambda rows: metrics.cohort_retention(rows, (7, 30, 60), 7),
        f"""SELECT project_id, strftime(a, '%Y-%m') AS cohort, count(*) AS clients, count(*) FILTER (len(list_filter(days, lambda d: d BETWEEN a + 7 AND a + 13)) > 0) AS d7,
        count(*) FILTER (len(list_filter(days, lambda d: d BETWEEN a + 30 AND a + 36)) > 0) AS d30, count(*) FILTER (len(list_filter(days, lambda d: d BETWEEN a + 60 AND a + 66)) > 0) AS d60 FROM ({_DAYS}) GROUP BY ALL""",
    ),
    "cost_economics": (
        metrics.cost_economics,
        """SELECT *, cost / nullif(successes, 0) AS cost_per_success, cost / nullif(operations, 0) AS cost_per_operation FROM
        (SELECT project_id, tool, caller_known, sum(cost) AS cost, count(*) FILTER (outcome = 'success') AS successes, count(DISTINCT operation_id) AS operations FROM s_w GROUP BY ALL)""",
    ),
    "strict_qualified": (
        lambda rows: metrics.strict_qualified(rows).select("attempt_id", "project_id", "tool", "outcome"),
        "SELECT attempt_id, project_id, tool, outcome FROM s_w WHERE usage_context = 'production' AND validity = 'normal'",
    ),
    "project_report": (
        metrics.project_report,
        """SELECT *, success / nullif(decided, 0) AS success_rate, completed / attempts AS completion_rate, resolved / attempts AS operation_coverage, attempts / nullif(operations, 0) AS attempts_per_operation, corroborated / attempts AS corroborated_share,
        qualified / attempts AS qualified_share, known_callers / attempts AS caller_coverage, 1 - flagged / attempts AS collection_coverage FROM (SELECT project_id, count(*) AS attempts, count(DISTINCT operation_id) AS operations,
        count(operation_id) AS resolved, count(*) FILTER (outcome = 'success') AS success, count(*) FILTER (outcome IN ('failure', 'denied')) AS failure, count(*) FILTER (outcome = 'unknown') AS outcome_unknown,
        count(*) FILTER (outcome = 'inconsistent') AS outcome_inconsistent, count(*) FILTER (outcome IN ('success', 'failure', 'denied')) AS decided, count(*) FILTER (has_completed) AS completed,
        count(*) FILTER (evidence IN ('corroborated', 'independently-corroborated')) AS corroborated, count(*) FILTER (evidence = 'independently-corroborated') AS independently_corroborated, count(*) FILTER (evidence = 'authenticated') AS authenticated,
        count(*) FILTER (evidence = 'observed') AS observed, count(*) FILTER (usage_context = 'production' AND validity = 'normal') AS qualified, count(*) FILTER (usage_context = 'production' AND validity = 'unknown') AS extended,
        count(*) FILTER (usage_context = 'unknown') AS unknown_context, count(*) FILTER (validity = 'unknown') AS unknown_validity, count(*) FILTER (validity NOT IN ('normal', 'unknown')) AS invalid,
        count(*) FILTER (qualification_status = 'partially_classified') AS partially_classified, count(*) FILTER (qualification_status = 'inconsistent') AS qualification_inconsistent,
        count(*) FILTER (caller_known) AS known_callers, count(*) FILTER (collection_flagged) AS flagged, count(*) FILTER (has_client AND has_server) AS both_sides, count(DISTINCT client_key) AS clients FROM s_w GROUP BY ALL)""",
    ),
    "lineage_coverage": (
        correlate.lineage_coverage,
        """SELECT *, complete / nullif(with_task, 0) AS coverage FROM (SELECT project_id, count(task_id) AS with_task, count(*) FILTER (task_id IS NOT NULL AND operation_id IS NOT NULL) AS complete FROM s_w GROUP BY ALL)""",
    ),
    "discrepancy_report": (
        correlate.discrepancy_report,
        """SELECT *, client - server AS delta, both_sides / attempts AS match_rate FROM (SELECT tool, count(*) FILTER (has_client) AS client, count(*) FILTER (has_server) AS server, count(*) FILTER (has_client AND has_server) AS both_sides,
        count(*) FILTER (has_client AND has_server AND outcome <> 'inconsistent') AS agreeing, count(*) AS attempts FROM s_w GROUP BY ALL)""",
    ),
    "retry_chains": (
        correlate.retry_chains,
        """SELECT *, chains / operations AS rate FROM (SELECT project_id, count(*) AS operations, count(*) FILTER (n > 1) AS chains FROM
        (SELECT project_id, operation_id, count(*) AS n FROM s_w WHERE operation_id IS NOT NULL GROUP BY ALL) GROUP BY ALL)""",
    ),
    "resolution_provenance": (
        correlate.resolution_provenance,
        """SELECT operation_id, resolution, CASE WHEN bool_or(ambiguous) THEN 'ambiguous' ELSE 'resolved' END AS status, count(*) AS attempts, list_sort(list(attempt_id)) AS source_attempt_ids,
        concat('op-', resolution) AS rule_id, '1' AS rule_version FROM s_w WHERE operation_id IS NOT NULL GROUP BY operation_id, resolution""",
    ),
    "repeat_clients": (
        lambda rows: metrics.repeat_clients(rows, 30),
        """SELECT project_id, count(*) FILTER (k >= 2) AS repeat_clients, count(*) AS clients FROM (SELECT project_id, client_key, count(DISTINCT CAST(floor((CAST(started_at AS DATE) - DATE '1970-01-01') / 30) AS BIGINT)) AS k
        FROM s_w WHERE client_key IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
    ),
    "privacy_suppress": (
        lambda rows: metrics.privacy_suppress(rows.groupBy("tool", "evidence").agg(F.count("*").alias("n"), F.avg(F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)).alias("rate")), "rate", "n"),
        "SELECT tool, evidence, n, CASE WHEN n >= 10 THEN rate END AS rate, n < 10 AS suppressed FROM (SELECT tool, evidence, count(*) AS n, avg(CASE WHEN outcome = 'success' THEN 1.0 ELSE 0.0 END) AS rate FROM s_w GROUP BY ALL)",
    ),
    "measurement_label": (
        lambda rows: metrics.measurement_label(rows, AS_OF, DAYS),
        f"""SELECT project_id, 'attempt' AS grain, '{AS_OF}' AS as_of, CAST({DAYS} AS BIGINT) AS window_days, 'observed' AS coverage_basis, count(*) FILTER (usage_context = 'unknown') / count(*) AS unknown_context_share,
        count(*) FILTER (validity = 'unknown') / count(*) AS unknown_validity_share, count(*) FILTER (evidence IN ('corroborated', 'independently-corroborated')) / count(*) AS corroborated_share FROM s_w GROUP BY ALL""",
    ),
}
for _name, (_metric, _sql) in SIMPLE.items():
    query(_name, _sql)(lambda spark, sf_dir, metric=_metric: metric(windowed(spark, sf_dir)))


@query("dedup_observations", "SELECT observation_id, observed_at, line_no, tool, outcome FROM s_obs")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("observation_id", "observed_at", "line_no", "tool", "outcome")


@query("attempt_events_only", "SELECT observation_type, count(*) AS n FROM s_obs WHERE observation_type IS NULL OR observation_type IN ('attempt_started', 'attempt_completed') GROUP BY ALL")
def _events_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.attempt_events_only(observations(spark, sf_dir)).groupBy("observation_type").agg(F.count("*").alias("n"))


ATTEMPT = "attempt_id, project_id, tool, n_obs"


@query("match_call_id", f"SELECT {ATTEMPT} FROM s_attempts WHERE matched_by = 'call_id'")
def _call(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.attempts(observations(spark, sf_dir)).where("matched_by = 'call_id'").select(*ATTEMPT.split(", "))


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.keyed(correlate.dedup_observations(view(spark, sf_dir, "fx_trace_obs")))


@query("match_trace_window", "SELECT attempt_key, count(*) AS n_obs, min(observed_at) AS started_at FROM s_keyed_trace WHERE matched_by = 'trace_window' GROUP BY ALL")
def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traced(spark, sf_dir).where("matched_by = 'trace_window'")
    return rows.groupBy("attempt_key").agg(F.count("*").alias("n_obs"), F.min("observed_at").alias("started_at"))


@query("match_singletons", "SELECT attempt_key, observation_id FROM s_keyed_trace WHERE matched_by = 'none'")
def _singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traced(spark, sf_dir).where("matched_by = 'none'").select("attempt_key", "observation_id")


@query("observation_links", "SELECT sha256(attempt_key) AS attempt_id, observation_id FROM s_keyed")
def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.observation_links(observations(spark, sf_dir))


def _column(name: str, columns: str) -> None:
    query(name, f"SELECT attempt_id, {columns} FROM s_attempts")(lambda spark, sf_dir: correlate.attempts(observations(spark, sf_dir)).select("attempt_id", *columns.split(", ")))


for _name, _columns in {
    "resolve_outcome": "outcome",
    "resolve_lifecycle": "lifecycle",
    "attempt_started_at": "started_at",
    "grade_evidence": "evidence",
    "operations_explicit": "operation_id, resolution, ambiguous",
    "resolve_qualification": "usage_context, validity, qualification_status",
}.items():
    _column(_name, _columns)


@query("eligible", "SELECT project_id, tool, 1 AS eligible, count(*) AS attempts FROM s_attempts GROUP BY project_id, tool")
def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.attempts(observations(spark, sf_dir)).groupBy("project_id", "tool", "eligible").agg(F.count("*").alias("attempts"))


@query("operations_unknown", "SELECT project_id, tool, count(*) AS attempts FROM s_attempts WHERE operation_id IS NULL GROUP BY ALL")
def _unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.attempts(observations(spark, sf_dir)).where("operation_id IS NULL").groupBy("project_id", "tool").agg(F.count("*").alias("attempts"))


@query(
    "operations_structural",
    """SELECT attempt_id, first_value(attempt_id) OVER (PARTITION BY project_id, tool, task_id, chain ORDER BY started_at, attempt_key) AS operation_id FROM
    (SELECT *, sum(fresh) OVER (PARTITION BY project_id, tool, task_id ORDER BY started_at, attempt_key) AS chain FROM
    (SELECT *, CASE WHEN lag(outcome) OVER (PARTITION BY project_id, tool, task_id ORDER BY started_at, attempt_key) IN ('failure', 'retry', 'denied') THEN 0 ELSE 1 END AS fresh
    FROM s_attempts WHERE operation_id IS NULL AND task_id <> '' AND started_at IS NOT NULL))""",
)
def _structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = correlate.operations_structural(correlate.attempts(observations(spark, sf_dir)))
    return rows.where("resolution = 'structural'").select("attempt_id", "operation_id")


@query(
    "observer_mix",
    "SELECT s_w.project_id, observer_principal, count(DISTINCT s_w.attempt_key) AS attempts FROM s_keyed JOIN s_w ON s_keyed.attempt_key = s_w.attempt_key GROUP BY ALL",
)
def _observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.observer_mix(keyed(spark, sf_dir), AS_OF, DAYS)


@query(
    "caller_mix",
    """SELECT s_w.project_id, caller_runtime, identity_strength, CAST(grouping(caller_runtime, identity_strength) AS BIGINT) AS level, count(DISTINCT s_w.attempt_key) AS attempts
    FROM s_keyed JOIN s_w ON s_keyed.attempt_key = s_w.attempt_key WHERE caller_runtime IS NOT NULL
    GROUP BY GROUPING SETS ((s_w.project_id, caller_runtime, identity_strength), (s_w.project_id, caller_runtime), (s_w.project_id, identity_strength))""",
)
def _callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.caller_mix(keyed(spark, sf_dir), AS_OF, DAYS)


@query(
    "latency_stats",
    """SELECT project_id, max(n) AS n, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, avg(duration_ms) AS mean_ms,
    min(duration_ms) FILTER (r = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1) AS p50_ms, min(duration_ms) FILTER (r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1) AS p95_ms,
    count(*) FILTER (duration_ms < 1000) AS b0, count(*) FILTER (duration_ms BETWEEN 1000 AND 9999) AS b1, count(*) FILTER (duration_ms BETWEEN 10000 AND 59999) AS b2,
    count(*) FILTER (duration_ms BETWEEN 60000 AND 599999) AS b3, count(*) FILTER (duration_ms >= 600000) AS b4 FROM
    (SELECT project_id, duration_ms, count(*) OVER (PARTITION BY project_id) AS n, row_number() OVER (PARTITION BY project_id ORDER BY duration_ms) AS r FROM s_obs WHERE duration_ms IS NOT NULL) GROUP BY ALL""",
)
def _latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_stats(observations(spark, sf_dir))


STEPS |= {
    "s_seen": "SELECT w.project_id, observer_principal, caller_runtime, identity_strength, w.attempt_key FROM s_keyed k JOIN s_w w ON k.attempt_key = w.attempt_key",
    "s_figures": """
SELECT project_id, max(n) AS n, min(duration_ms) AS min_ms, avg(duration_ms) AS mean_ms, min(duration_ms) FILTER (r = least(n - 1, CAST(floor(n * 0.5) AS BIGINT)) + 1) AS p50_ms,
  min(duration_ms) FILTER (r = least(n - 1, CAST(floor(n * 0.95) AS BIGINT)) + 1) AS p95_ms, max(duration_ms) AS max_ms FROM
(SELECT project_id, duration_ms, count(*) OVER (PARTITION BY project_id) AS n, row_number() OVER (PARTITION BY project_id ORDER BY duration_ms) AS r FROM s_obs WHERE duration_ms IS NOT NULL) GROUP BY ALL""",
    "s_valid": "SELECT project_id, count(*) AS production, count(*) FILTER (validity <> 'unknown') AS classified FROM s_w WHERE usage_context = 'production' GROUP BY ALL",
}


@query(
    "report_sections",
    """SELECT project_id, 'observers' AS section, observer_principal AS name, CAST(count(DISTINCT attempt_key) AS DOUBLE) AS value FROM s_seen GROUP BY ALL UNION ALL
    SELECT project_id, 'caller_by_runtime', caller_runtime, count(DISTINCT attempt_key) FROM s_seen WHERE caller_runtime IS NOT NULL GROUP BY ALL UNION ALL
    SELECT project_id, 'caller_by_strength', identity_strength, count(DISTINCT attempt_key) FROM s_seen WHERE caller_runtime IS NOT NULL GROUP BY ALL UNION ALL
    SELECT project_id, 'evidence', evidence, count(*) FROM s_w GROUP BY ALL UNION ALL SELECT project_id, 'operation_resolution', resolution, count(*) FROM s_w GROUP BY ALL UNION ALL
    SELECT project_id, 'qualification_status', qualification_status, count(*) FROM s_w GROUP BY ALL UNION ALL
    SELECT project_id, 'latency', 'n', n FROM s_figures UNION ALL SELECT project_id, 'latency', 'min_ms', min_ms FROM s_figures UNION ALL SELECT project_id, 'latency', 'mean_ms', mean_ms FROM s_figures UNION ALL
    SELECT project_id, 'latency', 'p50_ms', p50_ms FROM s_figures UNION ALL SELECT project_id, 'latency', 'p95_ms', p95_ms FROM s_figures UNION ALL SELECT project_id, 'latency', 'max_ms', max_ms FROM s_figures UNION ALL
    SELECT project_id, 'validity', 'production', production FROM s_valid UNION ALL SELECT project_id, 'validity', 'classified', classified FROM s_valid UNION ALL SELECT project_id, 'validity', 'coverage', classified / production FROM s_valid""",
)
def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.report_sections(keyed(spark, sf_dir), windowed(spark, sf_dir), observations(spark, sf_dir), AS_OF, DAYS)


@query(
    "sequence_gaps",
    """SELECT source_instance_id, sequence_epoch, p + 1 AS first_missing, source_sequence - 1 AS last_missing FROM
    (SELECT *, lag(source_sequence) OVER (PARTITION BY source_instance_id, sequence_epoch ORDER BY source_sequence) AS p FROM fx_sequence) WHERE source_sequence - p > 1""",
)
def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.sequence_gaps(view(spark, sf_dir, "fx_sequence"))


@query(
    "discrepancy_stages",
    """SELECT *, client - server AS delta, both_sides / attempts AS match_rate FROM (SELECT tool, stage, count(*) FILTER (c) AS client, count(*) FILTER (s) AS server, count(*) FILTER (c AND s) AS both_sides, count(*) AS attempts FROM
    (SELECT attempt_key, tool, stage, bool_or(observer_side = 'client') AS c, bool_or(observer_side = 'server') AS s FROM
    (SELECT attempt_key, tool, 'invoked' AS stage, observer_side FROM s_keyed UNION ALL SELECT attempt_key, tool, 'completed', observer_side FROM s_keyed WHERE observation_type = 'attempt_completed' UNION ALL
    SELECT attempt_key, tool, 'succeeded', observer_side FROM s_keyed WHERE outcome = 'success') GROUP BY ALL) GROUP BY tool, stage)""",
)
def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.discrepancy_stages(observations(spark, sf_dir))


@query(
    "lineage_of_observations",
    """SELECT *, complete / nullif(with_task, 0) AS coverage FROM (SELECT project_id, count(*) AS observations, count(*) FILTER (tool_call_id IS NOT NULL OR trace_id IS NOT NULL) AS tied, count(task_id) AS with_task,
    count(*) FILTER ((tool_call_id IS NOT NULL OR trace_id IS NOT NULL) AND task_id IS NOT NULL AND operation_id IS NOT NULL) AS complete FROM s_obs GROUP BY project_id)""",
)
def _lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.lineage_of_observations(observations(spark, sf_dir))


@query(
    "evidence_vector",
    """SELECT attempt_key, evidence, CASE WHEN signed THEN 'signed' ELSE 'none' END AS authentication, concat(observers, ' observers') AS corroboration,
    CASE WHEN domains > 1 THEN 'distinct-domains' WHEN domains = 1 THEN 'single-domain' ELSE 'unknown' END AS independence, 'UNSUPPORTED' AS attestation FROM
    (SELECT k.attempt_key, min(a.evidence) AS evidence, coalesce(bool_or(signature_valid), false) AS signed, count(DISTINCT (observer_principal, trust_domain)) AS observers, count(DISTINCT trust_domain) AS domains
    FROM s_keyed k JOIN s_attempts a ON k.attempt_key = a.attempt_key GROUP BY k.attempt_key)""",
)
def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.evidence_vector(observations(spark, sf_dir))


#: Calls retry the one 40 numbers before, in runs of four; some of them the one after, which makes cycles. Every eleventh has no id.
RETRY_OF = """CASE WHEN CAST(substr(tool_call_id, 4, 20) AS BIGINT) % 97 = 0 THEN concat('tc-', CAST(substr(tool_call_id, 4, 20) AS BIGINT) + 40)
  WHEN CAST(floor(CAST(substr(tool_call_id, 4, 20) AS BIGINT) / 40) AS BIGINT) % 4 <> 0 THEN concat('tc-', CAST(substr(tool_call_id, 4, 20) AS BIGINT) - 40) END"""

STEPS |= {
    "s_retries": f"""SELECT attempt_key, min(concat_ws('|', 'c', {key_part("project_id")}, {key_part("tool")}, {key_part("retry_of")})) AS retried, min(project_id) AS project_id FROM (SELECT *, {RETRY_OF} AS retry_of FROM s_keyed) WHERE retry_of <> '' GROUP BY attempt_key""",
    "s_ranks": """
WITH RECURSIVE ranks AS (SELECT DISTINCT retried AS attempt_key, retried AS head, CAST(0 AS BIGINT) AS place FROM s_retries WHERE retried NOT IN (SELECT attempt_key FROM s_retries)
  UNION ALL SELECT s.attempt_key, head, place + 1 FROM ranks r JOIN s_retries s ON s.retried = r.attempt_key) SELECT * FROM ranks""",
}


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).withColumn("retry_of", F.expr(RETRY_OF))


@query(
    "retry_relation",
    """SELECT head, min(project_id) AS project_id, count(outcome) AS attempts, max(place) + 1 AS length, arg_max(outcome, (place, started_at, r.attempt_key)) FILTER (outcome IS NOT NULL) AS final_outcome,
    min(place) FILTER (outcome = 'success') AS succeeded_after, bool_or(outcome IS NOT NULL AND place = 0) AS observed FROM s_ranks r LEFT JOIN s_attempts a ON r.attempt_key = a.attempt_key GROUP BY head""",
)
def _retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.retry_relation(retried(spark, sf_dir))


@query("retry_cycles", "SELECT attempt_key FROM s_retries WHERE attempt_key NOT IN (SELECT attempt_key FROM s_ranks)")
def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.retry_cycles(retried(spark, sf_dir))


@query(
    "retry_rate",
    """SELECT *, with_retries / operations AS rate FROM (SELECT project_id, count(DISTINCT operation_id) AS operations, count(DISTINCT operation_id) FILTER (again) AS with_retries FROM
    (SELECT a.project_id, a.operation_id, b.attempt_key IS NOT NULL AS again FROM s_attempts a LEFT JOIN s_retries s ON a.attempt_key = s.attempt_key
    LEFT JOIN s_attempts b ON b.attempt_key = s.retried AND b.operation_id = a.operation_id AND b.project_id = a.project_id AND b.attempt_key <> a.attempt_key WHERE a.operation_id IS NOT NULL) GROUP BY project_id)""",
)
def _retry_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.retry_rate(retried(spark, sf_dir))


@query("active_clients_sketched", "SELECT project_id, count(DISTINCT client_key) AS clients, true AS close FROM s_w WHERE client_key IS NOT NULL GROUP BY ALL")
def _sketched_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact count, and whether the ledger's estimate is within 3 % of it."""
    rows = windowed(spark, sf_dir)
    exact = rows.where("client_key IS NOT NULL").groupBy("project_id").agg(F.count_distinct("client_key").alias("clients"))
    about = metrics.active_clients_sketched(metrics.client_ledger(rows)).withColumnRenamed("clients", "about")
    return exact.join(about, "project_id").select("project_id", "clients", (F.abs(F.col("about") / F.col("clients") - 1) <= 0.03).alias("close"))


@query(
    "repeat_clients_sketched",
    """SELECT project_id, true AS close, count(*) AS clients FROM (SELECT DISTINCT project_id, client_key FROM s_w WHERE client_key IS NOT NULL) GROUP BY ALL""",
)
def _sketched_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clients exactly, and whether the ledger's estimate of those in two months or more is within 3 % of the exact count."""
    rows = windowed(spark, sf_dir)
    exact = metrics.repeat_clients(rows, 30)
    about = metrics.repeat_clients_sketched(metrics.client_ledger(rows), 30).select("project_id", F.col("repeat_clients").alias("about"))
    return exact.join(about, "project_id").select("project_id", (F.abs(F.col("about") - F.col("repeat_clients")) <= 0.03 * F.col("clients")).alias("close"), "clients")


@query("latency_sketched", "SELECT project_id, count(*) AS n, true AS p50_close, true AS p95_close FROM s_obs WHERE duration_ms IS NOT NULL GROUP BY ALL")
def _sketched_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, and whether the sketched percentiles stand within 1 % of their ranks among all durations."""
    obs = observations(spark, sf_dir).where("duration_ms IS NOT NULL")
    about = metrics.latency_sketched(metrics.latency_ledger(obs))
    met = obs.select("project_id", "duration_ms").join(about, "project_id")
    close = lambda c, p: ((F.count_if(F.col("duration_ms") < F.col(c)) <= (p + 0.01) * F.count("*")) & (F.count_if(F.col("duration_ms") <= F.col(c)) >= (p - 0.01) * F.count("*"))).alias(c.replace("_ms", "_close"))
    return met.groupBy("project_id").agg(F.max("n").alias("n"), close("p50_ms", 0.5), close("p95_ms", 0.95))


@query(
    "delegation_metrics",
    """SELECT *, cross_harness / tasks AS cross_harness_share FROM (SELECT deepest, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS delegations, count(*) FILTER (h >= 2) AS cross_harness FROM
    (SELECT parent_task_id, count(*) AS n, max(depth) AS deepest, count(DISTINCT provider) AS h FROM fx_delegation GROUP BY ALL) GROUP BY ALL)""",
)
def _delegations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delegation_metrics(view(spark, sf_dir, "fx_delegation"))
