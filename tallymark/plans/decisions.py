"""Queries of choice, consumption, metering and entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators import choice, consumption, correlate, entities, metering
from tallymark.plans.registry import query
from tallymark.plans.usage import observations
from tallymark.plans.views import STEPS, view

PRESENTED = "candidate_set_id category_id choice_mode context decision_id project_id tool validity".split()
SELECTED = "candidate_set_id category_id choice_mode context decision_authority decision_id project_id rank selection_constraint tool validity".split()


def _first(source: str, at: str, columns: list[str]) -> str:
    tie = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY decision_id, tool ORDER BY line_no, tie, {at}, concat_ws('|', {tie})) AS rn FROM {source}) WHERE rn = 1"


#: Where the window of choices begins.
SINCE = "1996-06-01 00:00:00"

STEPS |= {
    "s_presented": _first("fx_presentations", "presented_at", PRESENTED),
    "s_selected": _first("fx_selections", "selected_at", SELECTED),
    "s_p": f"SELECT * FROM s_presented WHERE context = 'production' AND validity = 'normal' AND presented_at >= TIMESTAMP '{SINCE}'",
    "s_s": f"SELECT * FROM s_selected WHERE context = 'production' AND validity = 'normal' AND selected_at >= TIMESTAMP '{SINCE}'",
    "s_s_ever": "SELECT * FROM s_selected WHERE context = 'production' AND validity = 'normal'",
    "s_pairs": """
SELECT a.decision_id, a.candidate_set_id, a.choice_mode, CASE WHEN a.project_id = b.project_id THEN a.project_id END AS project_id, a.tool AS tool_a, b.tool AS tool_b FROM s_p a JOIN s_p b
ON a.decision_id = b.decision_id AND a.candidate_set_id = b.candidate_set_id AND a.choice_mode = b.choice_mode AND a.tool < b.tool""",
    "s_matrix": """
SELECT *, a_selected / nullif(a_selected + b_selected, 0) AS share_a FROM (SELECT tool_a, tool_b, count(DISTINCT p.decision_id) AS co_presented,
  count(DISTINCT p.decision_id) FILTER (s.tool = tool_a) AS a_selected, count(DISTINCT p.decision_id) FILTER (s.tool = tool_b) AS b_selected
FROM s_pairs p LEFT JOIN s_s s ON p.decision_id = s.decision_id AND p.candidate_set_id = s.candidate_set_id AND p.choice_mode = s.choice_mode AND p.project_id = s.project_id GROUP BY tool_a, tool_b)""",
    # Each result with the first request that names it; ids of results are unique here, and no request names both an id and a tool.
    "s_claimed": """
SELECT r.project_id, r.tool_use_id, r.tool, r.line_no, min(q.line_no) AS ends FROM fx_consumption r LEFT JOIN fx_consumption q
ON q.type = 'request' AND q.project_id = r.project_id AND q.consumed_tool_use_id = r.tool_use_id AND q.line_no > r.line_no WHERE r.type = 'tool_result' GROUP BY ALL""",
    # The requests that name a tool, numbered, with the results of it that no id has claimed yet, the latest first.
    "s_asks": """
SELECT q.project_id, q.mcp_tool AS tool, q.line_no, row_number() OVER (PARTITION BY q.project_id, q.mcp_tool ORDER BY q.line_no) AS n,
  list(r.line_no ORDER BY r.line_no DESC) FILTER (r.line_no IS NOT NULL) AS pending FROM fx_consumption q LEFT JOIN s_claimed r
ON r.project_id = q.project_id AND r.tool = q.mcp_tool AND r.line_no < q.line_no AND (r.ends IS NULL OR r.ends > q.line_no) WHERE q.type = 'request' AND q.mcp_tool IS NOT NULL GROUP BY q.project_id, q.mcp_tool, q.line_no""",
    # Walked one by one: what is pending and younger than the last result taken.
    "s_walk": """
WITH RECURSIVE walk AS (
  SELECT DISTINCT project_id, tool, CAST(0 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS reset, CAST(NULL AS BIGINT) AS request_line, CAST(NULL AS BIGINT) AS result_line, CAST(0 AS BIGINT) AS many FROM s_asks
  UNION ALL
  SELECT project_id, tool, n, CASE WHEN len(open) = 1 THEN line_no ELSE reset END, line_no, CASE WHEN len(open) = 1 THEN open[1] END, CAST(len(open) AS BIGINT)
  FROM (SELECT a.project_id, a.tool, a.n, a.line_no, w.reset, list_filter(coalesce(a.pending, CAST([] AS BIGINT[])), lambda x: x > w.reset) AS open FROM walk w JOIN s_asks a ON a.project_id = w.project_id AND a.tool = w.tool AND a.n = w.n + 1))
SELECT project_id, tool, request_line, result_line, CASE many WHEN 0 THEN 'none' WHEN 1 THEN 'linked' ELSE 'ambiguous' END AS kind FROM walk WHERE n > 0""",
    "s_exact": """
SELECT r.project_id, r.tool_use_id, r.ends AS request_line, r.tool FROM s_claimed r WHERE r.ends IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM s_walk w WHERE w.project_id = r.project_id AND w.result_line = r.line_no)""",
    "s_resolved": """
SELECT o.surface_id, CASE WHEN k.lo IS NULL THEN 'unknown' WHEN k.lo <> k.hi THEN 'ambiguous' ELSE 'resolved' END AS entity_status,
  CASE WHEN k.lo = k.hi THEN k.lo END AS entity_id FROM (SELECT concat('mcp_tool:', tool) AS surface_id FROM s_obs) o
LEFT JOIN (SELECT alias_key, min(entity_id) AS lo, max(entity_id) AS hi FROM fx_alias_map GROUP BY alias_key) k ON o.surface_id = k.alias_key""",
    "s_used": "SELECT DISTINCT tool_call_id FROM s_obs WHERE observer_side = 'server' AND outcome = 'success' AND tool_call_id IS NOT NULL",
    "s_calls": """
SELECT project_id, tool_call_id, CASE WHEN observer_principal LIKE 'claude-otel%' THEN 'OBSERVABLE' WHEN observer_principal LIKE 'codex-hook%' THEN 'UNOBSERVABLE' ELSE 'UNKNOWN' END AS o,
  tool_call_id IN (SELECT tool_call_id FROM s_used) AS used FROM s_obs WHERE observer_side = 'client' AND tool_call_id IS NOT NULL""",
    "s_ledger": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY meter_event_id ORDER BY revision DESC, tie, concat_ws('|', coalesce(billable_event, ''), coalesce(operation_id, ''),
  coalesce(CAST(quantity AS VARCHAR), ''), coalesce(reversal_of, ''), coalesce(supersedes, ''), coalesce(validity, ''))) AS rn FROM fx_meter) WHERE rn = 1""",
}


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return choice.dedup_choice(view(spark, sf_dir, "fx_presentations"), "presented_at"), choice.dedup_choice(view(spark, sf_dir, "fx_selections"), "selected_at")


def used(obs: DataFrame) -> DataFrame:
    """Calls whose result was used: the server reported success."""
    return obs.where("observer_side = 'server' AND outcome = 'success' AND tool_call_id IS NOT NULL").select("project_id", "tool_call_id").distinct()


@query("dedup_choice", "SELECT decision_id, tool, candidate_set_id, choice_mode FROM s_presented")
def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir)[0].select("decision_id", "tool", "candidate_set_id", "choice_mode")


@query("presented_opportunities", "SELECT tool, count(DISTINCT decision_id) AS presented FROM s_p GROUP BY tool")
def _presented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.presented_opportunities(both(spark, sf_dir)[0], SINCE)


@query(
    "selection_rate",
    """SELECT *, selected / presented AS rate FROM (SELECT p.tool, count(DISTINCT p.decision_id) AS presented, count(DISTINCT s.decision_id) AS selected FROM s_p p
    LEFT JOIN s_s_ever s ON p.decision_id = s.decision_id AND p.tool = s.tool AND p.candidate_set_id IS NOT DISTINCT FROM s.candidate_set_id AND p.project_id = s.project_id GROUP BY p.tool)""",
)
def _rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.selection_rate(*both(spark, sf_dir), SINCE)


for _name, _side in {"presentation_share": 0, "selection_share": 1}.items():
    query(_name, f"SELECT category_id, tool, n, n / sum(n) OVER (PARTITION BY category_id) AS share FROM (SELECT category_id, tool, count(DISTINCT decision_id) AS n FROM {('s_p', 's_s')[_side]} GROUP BY ALL)")(
        lambda spark, sf_dir, side=_side: choice.share_in_category(choice.since(both(spark, sf_dir)[side], ("presented_at", "selected_at")[side], SINCE))
    )


@query("head_to_head_matrix", "SELECT * FROM s_matrix")
def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.head_to_head_matrix(*both(spark, sf_dir), SINCE)


@query("head_to_head", "SELECT * FROM s_matrix WHERE tool_a = 'tool-1' AND tool_b = 'tool-4'")
def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.head_to_head(*both(spark, sf_dir), "tool-4", "tool-1", SINCE)


@query(
    "choice_axes",
    """SELECT choice_mode, decision_authority, selection_constraint, CAST(grouping(choice_mode, decision_authority, selection_constraint) AS BIGINT) AS level, count(*) AS n FROM s_s
    GROUP BY CUBE (choice_mode, decision_authority, selection_constraint)""",
)
def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choice.choice_axes(choice.since(both(spark, sf_dir)[1], "selected_at", SINCE))


@query("consumption_exact", "SELECT project_id, tool_use_id, request_line, tool FROM s_exact")
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.consumption_exact(view(spark, sf_dir, "fx_consumption"))


@query(
    "consumption_inferred",
    "SELECT w.project_id, w.tool, w.request_line, w.kind, r.tool_use_id FROM s_walk w LEFT JOIN s_claimed r ON r.project_id = w.project_id AND r.line_no = w.result_line",
)
def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.consumption_inferred(view(spark, sf_dir, "fx_consumption"))


@query("consumption_observed", "SELECT DISTINCT project_id, tool_call_id FROM s_calls WHERE used")
def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return consumption.consumption_observed(obs, used(obs))


@query(
    "observable_runtimes",
    """SELECT CASE WHEN observer_principal LIKE 'claude-otel%' THEN 'claude-code' WHEN observer_principal LIKE 'codex-hook%' THEN 'codex' WHEN observer_principal LIKE 'mcp-wrapper%' THEN 'mcp' END AS runtime,
    CASE WHEN observer_principal LIKE 'claude-otel%' THEN 'OBSERVABLE' WHEN observer_principal LIKE 'codex-hook%' THEN 'UNOBSERVABLE' ELSE 'UNKNOWN' END AS consumed, count(*) AS observations FROM s_obs GROUP BY ALL""",
)
def _runtimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consumption.observable_runtimes(observations(spark, sf_dir))


@query(
    "consumed_rate",
    f"""SELECT *, consumed / nullif(observable, 0) AS rate FROM (SELECT project_id, count(*) FILTER (seen AND used) AS consumed, count(*) FILTER (seen) AS observable, count(*) FILTER (NOT seen) AS unobservable FROM
    (SELECT attempt_key, min(project_id) AS project_id, bool_or(observer_principal LIKE 'claude-otel%' AND observer_side = 'client') AS seen, bool_or(tool_call_id IN (SELECT tool_call_id FROM s_used)) IS TRUE AS used
    FROM s_keyed GROUP BY attempt_key HAVING bool_or(observer_side = 'client') AND min(observed_at) >= TIMESTAMP '{SINCE}') GROUP BY project_id)""",
)
def _consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return consumption.consumed_rate(obs, used(obs), SINCE)


@query(
    "consumed_rate_strict",
    """SELECT *, consumed / nullif(observable, 0) AS rate FROM (SELECT project_id, count(*) FILTER (seen AND used) AS consumed, count(*) FILTER (seen) AS observable, count(*) FILTER (NOT seen) AS unobservable FROM
    (SELECT k.attempt_key, min(k.project_id) AS project_id, bool_or(observer_principal LIKE 'claude-otel%' AND observer_side = 'client') AS seen, bool_or(tool_call_id IN (SELECT tool_call_id FROM s_used)) IS TRUE AS used
    FROM s_keyed k JOIN s_attempts a ON a.attempt_key = k.attempt_key AND a.usage_context = 'production' AND a.validity = 'normal' GROUP BY k.attempt_key HAVING bool_or(observer_side = 'client')) GROUP BY project_id)""",
)
def _consumed_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return consumption.consumed_rate(obs, used(obs), strict=True)


@query("observability_states", "SELECT project_id, CASE WHEN o <> 'OBSERVABLE' THEN o WHEN used THEN 'TRUE' ELSE 'FALSE' END AS state, count(*) AS n FROM s_calls GROUP BY ALL")
def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir)
    return consumption.observability_states(obs, used(obs))


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select(F.concat(F.lit("mcp_tool:"), "tool").alias("surface_id"))
    return entities.resolve_entity(rows, view(spark, sf_dir, "fx_alias_map"))


@query("resolve_entity", "SELECT surface_id, entity_id, entity_status, count(*) AS n FROM s_resolved GROUP BY ALL")
def _resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).groupBy("surface_id", "entity_id", "entity_status").agg(F.count("*").alias("n"))


@query("entity_rollup", "SELECT *, CASE WHEN surfaces > 1 THEN 'merged' ELSE 'surface-only' END AS basis FROM (SELECT entity_id, count(*) AS n, count(DISTINCT surface_id) AS surfaces FROM s_resolved WHERE entity_status = 'resolved' GROUP BY entity_id)")
def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entity_rollup(resolved(spark, sf_dir))


@query("identity_conflict_share", "SELECT *, ambiguous / n AS share FROM (SELECT count(*) FILTER (entity_status = 'ambiguous') AS ambiguous, count(*) AS n FROM s_resolved)")
def _conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.identity_conflict_share(resolved(spark, sf_dir))


POLICY = [("operation_succeeded", "operation", 1, ["replay", "duplicate", "suspected_invalid"]), ("effect_confirmed", "booking", 1, ["none"])]


@query(
    "meter_events",
    """SELECT operation_id, billable_event, CASE billable_event WHEN 'operation_succeeded' THEN 'operation' ELSE 'booking' END AS billable_unit, CAST(1 AS BIGINT) AS quantity, count(*) AS attempts FROM fx_meter
    WHERE billable_event = 'effect_confirmed' OR (billable_event = 'operation_succeeded' AND validity NOT IN ('replay', 'duplicate', 'suspected_invalid')) GROUP BY operation_id, billable_event""",
)
def _meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = spark.createDataFrame(POLICY, "billable_event string, billable_unit string, billable_quantity long, exclusions array<string>")
    return metering.meter_events(view(spark, sf_dir, "fx_meter"), policy)


@query(
    "meter_events_resolved",
    """SELECT operation_id, billable_event, CASE billable_event WHEN 'operation_succeeded' THEN 'operation' ELSE 'booking' END AS billable_unit, CAST(1 AS BIGINT) AS quantity, count(*) AS attempts FROM fx_meter
    WHERE (billable_event = 'effect_confirmed' OR (billable_event = 'operation_succeeded' AND validity NOT IN ('replay', 'duplicate', 'suspected_invalid'))) AND quantity % 3 <> 0 GROUP BY operation_id, billable_event""",
)
def _meter_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what at least a correlation binds to its operation is billed."""
    policy = spark.createDataFrame(POLICY, "billable_event string, billable_unit string, billable_quantity long, exclusions array<string>")
    bound = F.when(F.col("quantity") % 3 == 0, "provider_policy").when(F.col("quantity") % 3 == 1, "correlated").otherwise("explicit_operation_id")
    return metering.meter_events(view(spark, sf_dir, "fx_meter").withColumn("resolution", bound), policy, "correlated")


@query(
    "ledger_balance",
    """SELECT billable_event, count(*) AS events, CAST(sum(quantity) AS BIGINT) AS quantity FROM s_ledger WHERE reversal_of IS NULL AND meter_event_id NOT IN
    (SELECT supersedes FROM s_ledger WHERE supersedes IS NOT NULL UNION ALL SELECT reversal_of FROM s_ledger WHERE reversal_of IS NOT NULL) GROUP BY billable_event""",
)
def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metering.ledger_balance(view(spark, sf_dir, "fx_meter"))


TIERS = [(0, "0.050000"), (100, "0.030000"), (200, "0.020000")]


@query(
    "price_tiers",
    """SELECT operation_id, units, CAST(CAST(CASE WHEN units < 100 THEN 0.05 WHEN units < 200 THEN 0.03 ELSE 0.02 END AS DECIMAL(18,6)) AS VARCHAR) AS unit_price,
    CAST(CAST(CAST(units AS DECIMAL(18,0)) * CASE WHEN units < 100 THEN 0.05 WHEN units < 200 THEN 0.03 ELSE 0.02 END AS DECIMAL(28,6)) AS VARCHAR) AS amount FROM
    (SELECT operation_id, CAST(sum(quantity) AS BIGINT) AS units FROM fx_meter GROUP BY operation_id)""",
)
def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = view(spark, sf_dir, "fx_meter").groupBy("operation_id").agg(F.sum("quantity").alias("units"))
    priced = metering.price_tiers(usage, spark.createDataFrame(TIERS, "unit_from long, unit_price string"))
    return priced.withColumns({c: F.col(c).cast("string") for c in ("unit_price", "amount")})


@query(
    "billing_predicates",
    "SELECT project_id, count(*) FILTER (evidence <> 'observed' AND resolution = 'explicit' AND has_client AND has_server AND validity NOT IN ('replay', 'duplicate')) AS billable, count(*) AS attempts FROM s_attempts GROUP BY project_id",
)
def _billable(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = metering.billing_predicates("authenticated", "explicit", "required", "required")
    return correlate.attempts(observations(spark, sf_dir)).groupBy("project_id").agg(F.count_if(ok).alias("billable"), F.count("*").alias("attempts"))
