"""Inputs of every operator, built from the star schema by SQL that Spark and DuckDB both read.

``view`` gives one as a DataFrame. ``oracle`` completes a SELECT with the common table expressions that it names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
AS_OF, DAYS = "2001-08-02 00:00:00", 3650

VIEWS: dict[str, str] = {
    "fx_attempt_obs": """
SELECT concat('obs-', l_orderkey, '-', l_linenumber, '-', l_suppkey) AS observation_id,
  o_orderdate AS observed_at, l_linenumber AS line_no,
  CASE WHEN l_returnflag='N' THEN 'attempt_started' ELSE 'attempt_completed' END AS observation_type,
  CASE WHEN l_linestatus='O' THEN (CASE WHEN l_suppkey % 2 = 0 THEN concat('codex-hook@td-', l_suppkey % 3) ELSE concat('claude-otel@td-', l_suppkey % 3) END)
       ELSE concat('mcp-wrapper@td-', l_suppkey % 3) END AS observer_principal,
  CASE WHEN l_linestatus='O' THEN 'client' ELSE 'server' END AS observer_side,
  concat('td-', l_suppkey % 3) AS trust_domain,
  concat('proj-', l_orderkey % 5) AS project_id,
  concat('tool-', l_orderkey % 40) AS tool,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE concat('tc-', l_orderkey) END AS tool_call_id,
  CASE WHEN l_orderkey % 22 = 0 THEN concat('tr-', l_orderkey) ELSE NULL END AS trace_id,
  CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('p-', o_custkey) END AS client_key,
  CASE WHEN l_returnflag='N' THEN NULL WHEN l_discount >= 0.10 THEN 'failure' WHEN o_orderstatus='F' THEN 'success' WHEN o_orderstatus='P' THEN 'failure' WHEN l_orderkey % 3 = 0 THEN 'denied' ELSE 'unknown' END AS outcome,
  CASE WHEN l_returnflag='N' THEN NULL ELSE CAST(l_quantity * 120 AS BIGINT) END AS duration_ms,
  CASE WHEN l_tax >= 0.08 THEN 'unknown' WHEN o_custkey % 10 < 7 THEN 'production' WHEN l_discount < 0.01 THEN 'production' ELSE 'test' END AS usage_context,
  CASE WHEN l_tax <= 0.01 THEN 'unknown' WHEN l_quantity >= 49 THEN 'replay' WHEN l_quantity >= 48 THEN 'suspected_invalid' ELSE 'normal' END AS validity,
  CASE WHEN l_suppkey % 5 = 0 THEN 'provider_configuration' ELSE 'collector_derived' END AS validity_source,
  CASE WHEN l_orderkey % 3 = 0 THEN concat('op-', l_orderkey - l_orderkey % 9) ELSE NULL END AS operation_id,
  concat('tk-', o_custkey) AS task_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "fx_trace_obs": """
SELECT concat('e-', event_id) AS observation_id, ts AS observed_at, event_id AS line_no,
  CASE WHEN user_id % 2 = 0 THEN 'client' ELSE 'server' END AS observer_side,
  concat('obs-', user_id % 4) AS observer_principal, concat('td-', user_id % 2) AS trust_domain,
  concat('proj-', user_id % 3) AS project_id, event_type AS tool, CAST(NULL AS VARCHAR(10)) AS tool_call_id,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('tr-', user_id % 3) END AS trace_id
FROM events
""",
    "fx_presentations": """
SELECT concat('d-', l_orderkey) AS decision_id,
  CASE WHEN l_tax >= 0.08 THEN NULL ELSE concat('cs-', l_orderkey) END AS candidate_set_id,
  concat('proj-', l_orderkey % 5) AS project_id, concat('tool-', l_suppkey % 6) AS tool,
  CASE WHEN l_discount >= 0.10 THEN 'sequential' ELSE 'exclusive' END AS choice_mode,
  concat('cat-', l_orderkey % 3) AS category_id, o_orderdate AS presented_at,
  CASE WHEN l_quantity > 45 THEN 'unknown' ELSE 'production' END AS context,
  CASE WHEN l_quantity < 3 THEN 'replay' ELSE 'normal' END AS validity,
  l_linenumber AS line_no, l_partkey AS tie
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "fx_selections": """
SELECT concat('d-', l_orderkey) AS decision_id, concat('cs-', l_orderkey) AS candidate_set_id,
  concat('proj-', l_orderkey % 5) AS project_id, concat('tool-', l_suppkey % 6) AS tool, 1 AS rank,
  CASE WHEN l_discount >= 0.10 THEN 'sequential' ELSE 'exclusive' END AS choice_mode,
  concat('cat-', l_orderkey % 3) AS category_id,
  CASE WHEN l_quantity % 4 = 0 THEN 'policy' WHEN l_quantity % 4 = 1 THEN 'router' ELSE 'model' END AS decision_authority,
  CASE WHEN l_quantity % 4 = 0 THEN 'forced' ELSE 'autonomous' END AS selection_constraint,
  o_orderdate AS selected_at, 'production' AS context,
  CASE WHEN l_quantity < 5 THEN 'replay' ELSE 'normal' END AS validity, l_linenumber AS line_no, l_partkey AS tie
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
""",
    "fx_consumption": """
SELECT event_id AS line_no, ts, concat('proj-', user_id % 3) AS project_id,
  CASE WHEN event_type IN ('view','click','signup') THEN 'tool_result' ELSE 'request' END AS type,
  CASE WHEN event_type IN ('view','click','signup') THEN concat('tu-', event_id) ELSE NULL END AS tool_use_id,
  CASE WHEN event_type IN ('view','click','signup') THEN concat('tool-', user_id % 20) ELSE NULL END AS tool,
  CASE WHEN event_type = 'purchase' THEN concat('tu-', event_id - 1 - user_id % 5) ELSE NULL END AS consumed_tool_use_id,
  CASE WHEN event_type = 'error' THEN concat('tool-', user_id % 20) ELSE NULL END AS mcp_tool, event_id AS seq
FROM events
""",
    "fx_sequence": """
SELECT concat('src-', user_id % 10) AS source_instance_id, substr(CAST(ts AS VARCHAR(30)), 1, 7) AS sequence_epoch,
  event_id AS source_sequence, CASE WHEN value > 60 THEN 3 ELSE 0 END AS dropped_since_last_report
FROM events WHERE event_id % 13 <> 0
""",
    "fx_funnel": """
SELECT concat(CASE WHEN o_orderkey % 5 < 3 THEN 'off/' ELSE 'prod/' END, o_orderkey) AS assignment_id,
  CASE WHEN o_orderkey % 5 < 3 THEN 'offline' ELSE 'production' END AS environment,
  concat('v', o_custkey % 3) AS variant_id, concat('h', o_orderkey % 2) AS harness_id,
  concat('t-', substr(o_orderpriority, 1, 1)) AS task_id, k.event AS event,
  (o_totalprice > 300000 - 30000 * (o_custkey % 3)) AS selected_subject,
  CASE WHEN o_orderstatus = 'F' THEN 'failure' ELSE 'success' END AS outcome,
  1 + o_orderkey % 3 AS attempts, 5 + o_custkey % 9 AS steps, 2.5 * (5 + o_custkey % 9) AS cost_units,
  (o_orderdate < TIMESTAMP '1999-01-01 00:00:00' AND o_orderstatus <> 'F') AS consumed
FROM orders CROSS JOIN (VALUES ('reach'),('choice'),('attempt'),('operation_result'),('consumption')) AS k(event)
WHERE k.event IN ('reach','choice') OR o_totalprice > 300000 - 30000 * (o_custkey % 3)
""",
    "fx_alias_map": """
SELECT concat('mcp_tool:tool-', p_partkey % 45) AS alias_key, concat('github.com/org/', p_partkey % 30) AS entity_id,
  (p_partkey % 4 = 0) AS verified FROM part WHERE p_partkey < 60 AND p_partkey % 9 <> 5
""",
    "fx_meter": """
SELECT concat('me-', l_orderkey, '-', l_linenumber) AS meter_event_id, concat('op-', l_orderkey) AS operation_id,
  CASE WHEN l_returnflag = 'N' THEN 'operation_succeeded' WHEN l_returnflag = 'A' THEN 'result_delivered' ELSE 'effect_confirmed' END AS billable_event,
  CAST(l_quantity AS BIGINT) AS quantity, l_suppkey % 3 + 1 AS revision, l_partkey AS tie,
  CASE WHEN l_partkey % 50 = 0 THEN concat('me-', l_orderkey, '-', l_linenumber - 1) ELSE NULL END AS supersedes,
  CASE WHEN l_partkey % 71 = 0 THEN concat('me-', l_orderkey, '-', l_linenumber + 1) ELSE NULL END AS reversal_of,
  CASE WHEN l_tax > 0.07 THEN 'replay' ELSE 'normal' END AS validity FROM lineitem
""",
    "fx_delegation": """
SELECT concat('dl-', conv_id, '-', turn) AS delegation_id, concat('tk-', conv_id) AS parent_task_id,
  concat('harness-', (conv_id + turn) % 3) AS provider, turn % 4 AS depth FROM conversations WHERE role = 'assistant'
""",
    # Observations with the caller and collection fields that the flat schema also has.
    "fx_obs": """
SELECT *, CASE WHEN duration_ms IS NULL THEN NULL ELSE concat('rt-', duration_ms % 7) END AS caller_runtime,
  CASE WHEN duration_ms IS NULL THEN 'unknown' WHEN duration_ms % 1000 < 300 THEN 'declared' WHEN duration_ms % 1000 < 500 THEN 'correlated' ELSE 'unknown' END AS identity_strength,
  line_no = 6 AS buffer_overflow, CASE WHEN line_no = 7 THEN 2 ELSE 0 END AS dropped,
  duration_ms % 10 = 0 AND line_no = 1 AS signature_valid,
  CASE WHEN outcome IN ('success', 'failure') THEN 'L2' WHEN outcome IS NULL THEN NULL ELSE 'L1' END AS lifecycle,
  CASE WHEN duration_ms IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(duration_ms AS DOUBLE) / 64 END AS cost
FROM fx_attempt_obs
""",
}

#: The derivations that many oracles start from.
STEPS: dict[str, str] = {}


#: Steps that a recursive one reads in each of its rounds.
ONCE = {"s_claimed", "s_asks"}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; it reads only the tables that it names."""
    sql = VIEWS[name]
    names = set(re.findall(r"\w+", sql))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in names}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if v in names}
    for t in used:
        sql = re.sub(rf"\b{t}\b", f"{{{t}}}", sql)
    return spark.sql(sql, **used)


def oracle(select: str) -> str:
    """The SELECT with every view and step that it needs, each once and in order."""
    known, done = VIEWS | STEPS, []

    def need(sql: str) -> None:
        for name in dict.fromkeys(re.findall(r"\w+", sql)):
            if name in known and name not in done:
                need(known[name])
                if name not in done:
                    done.append(name)

    need(select)
    ctes = ",\n".join(f"{name} AS {'MATERIALIZED ' if name in ONCE else ''}({known[name].strip()})" for name in done)
    return f"WITH {ctes}\n{select.strip()}" if done else select.strip()


OBS_COLUMNS = sorted(
    "observation_id observed_at line_no observation_type observer_principal observer_side trust_domain project_id tool tool_call_id trace_id client_key outcome duration_ms "
    "usage_context validity validity_source operation_id task_id caller_runtime identity_strength buffer_overflow dropped signature_valid lifecycle cost".split()
)
TRACE_COLUMNS = sorted("observation_id observed_at line_no observer_side observer_principal trust_domain project_id tool tool_call_id trace_id".split())


def _first(source: str, columns: list[str]) -> str:
    tie = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY observed_at, line_no, concat_ws('|', {tie})) AS rn FROM {source} WHERE observation_id <> '') WHERE rn = 1"


def key_part(x: str) -> str:
    return f"coalesce(CAST(length({x}) AS VARCHAR) || ':' || {x}, '-')"


def _keyed(source: str) -> str:
    group = f"concat_ws('|', 't', {key_part('project_id')}, {key_part('trace_id')}, {key_part('tool')}, CAST(CAST(floor(epoch(observed_at) / 300) AS BIGINT) AS VARCHAR))"
    return f"""
SELECT *, CASE WHEN tool_call_id <> '' THEN concat_ws('|', 'c', {key_part('project_id')}, {key_part('tool')}, {key_part('tool_call_id')})
    WHEN two THEN g ELSE concat_ws('|', 's', observation_id) END AS attempt_key,
  CASE WHEN tool_call_id <> '' THEN 'call_id' WHEN two THEN 'trace_window' ELSE 'none' END AS matched_by
FROM (SELECT *, g IS NOT NULL AND min(observer_side) OVER (PARTITION BY g) <> max(observer_side) OVER (PARTITION BY g) AS two
  FROM (SELECT *, CASE WHEN coalesce(tool_call_id, '') = '' AND trace_id <> '' THEN {group} END AS g FROM {source}))"""


STEPS |= {
    "s_obs": _first("fx_obs", OBS_COLUMNS),
    "s_trace_obs": _first("fx_trace_obs", TRACE_COLUMNS),
    "s_keyed": _keyed("s_obs"),
    "s_keyed_trace": _keyed("s_trace_obs"),
    "s_grouped": """
SELECT attempt_key, min(matched_by) AS matched_by, min(project_id) AS project_id, min(tool) AS tool, CAST(count(*) AS BIGINT) AS n_obs,
  CASE WHEN min(outcome) IS NULL THEN 'unknown' WHEN min(outcome) <> max(outcome) THEN 'inconsistent' ELSE min(outcome) END AS outcome,
  max(coalesce(lifecycle, 'L0')) AS lifecycle, min(observed_at) AS started_at,
  CASE WHEN count(DISTINCT concat_ws('@', observer_principal, trust_domain)) >= 2 AND count(DISTINCT trust_domain) >= 2 THEN 'independently-corroborated'
    WHEN count(DISTINCT concat_ws('@', observer_principal, trust_domain)) >= 2 THEN 'corroborated'
    WHEN coalesce(bool_or(signature_valid), false) THEN 'authenticated' ELSE 'observed' END AS evidence,
  arg_min(operation_id, line_no) FILTER (operation_id IS NOT NULL) AS operation_id, count(DISTINCT operation_id) > 1 AS ambiguous,
  min(task_id) AS task_id, min(client_key) AS client_key,
  CASE WHEN count(DISTINCT usage_context) FILTER (usage_context <> 'unknown') = 0 THEN 'unknown' WHEN count(DISTINCT usage_context) FILTER (usage_context <> 'unknown') > 1 THEN 'inconsistent'
    ELSE min(usage_context) FILTER (usage_context <> 'unknown') END AS usage_context,
  bool_or(usage_context = 'unknown') AS context_unknown,
  count(DISTINCT validity) FILTER (validity <> 'unknown') AS values_said,
  count(DISTINCT validity) FILTER (validity <> 'unknown' AND NOT (validity = 'normal' AND validity_source = 'provider_configuration')) AS values_kept,
  CASE max(CASE WHEN validity = 'normal' AND validity_source = 'provider_configuration' THEN NULL WHEN validity = 'normal' THEN 0 WHEN validity = 'replay' THEN 4 WHEN validity = 'suspected_invalid' THEN 5 END)
    WHEN 0 THEN 'normal' WHEN 4 THEN 'replay' WHEN 5 THEN 'suspected_invalid' ELSE 'unknown' END AS validity,
  bool_or(observation_type = 'attempt_completed') AS has_completed,
  bool_or(identity_strength IN ('declared', 'correlated', 'attested')) AS caller_known, bool_or(buffer_overflow OR dropped > 0) AS collection_flagged,
  bool_or(observer_side = 'client') AS has_client, bool_or(observer_side = 'server') AS has_server, sum(cost) AS cost
FROM s_keyed GROUP BY attempt_key""",
    "s_attempts": """
SELECT *, sha256(attempt_key) AS attempt_id, CASE WHEN operation_id IS NULL THEN 'unknown' ELSE 'explicit' END AS resolution,
  CASE WHEN usage_context = 'inconsistent' THEN 'inconsistent' WHEN (context_unknown AND usage_context <> 'unknown') OR values_kept BETWEEN 1 AND values_said - 1 THEN 'partially_classified'
    WHEN usage_context = 'production' AND validity = 'normal' THEN 'qualified' ELSE 'unknown' END AS qualification_status
FROM s_grouped""",
    "s_w": f"SELECT * FROM s_attempts WHERE started_at >= TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY",
}
