"""Draft metering: billable events, a ledger that survives replays and corrections, tiers and billing predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def meter_events(rows: DataFrame, policy: DataFrame, minimum_resolution: str = "none") -> DataFrame:
    """One billable row per operation and event of the policy.

    ``policy`` has billable_event, billable_unit, billable_quantity and exclusions (array of validities). Rows of an
    excluded validity, rows without an operation, and rows whose ``resolution`` binds them to it less than the minimum bill
    nothing; retries of one operation bill once. The policy has a row for each kind of event and goes to all tasks, as rows
    brought together by their kind would fill a few.
    """
    met = rows.join(F.broadcast(policy), "billable_event").where("operation_id IS NOT NULL").where(~F.coalesce(F.array_contains("exclusions", F.col("validity")), F.lit(False)))
    if minimum_resolution != "none":
        met = met.where(resolution_rank() >= RESOLUTION[minimum_resolution])
    return met.groupBy("operation_id", "billable_event", "billable_unit").agg(F.max("billable_quantity").alias("quantity"), F.count("*").alias("attempts"))


def ledger_balance(ledger: DataFrame) -> DataFrame:
    """Balance per billable event: the highest revision of each meter event, less those superseded or reversed.

    A row that reverses another is itself no charge. Replaying rows changes nothing.
    """
    rest = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(ledger.columns) if c not in ("meter_event_id", "revision", "tie")))
    order = Window.partitionBy("meter_event_id").orderBy(F.desc("revision"), "tie", rest)
    last = ledger.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    gone = last.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("meter_event_id")).unionByName(last.where("reversal_of IS NOT NULL").select(F.col("reversal_of").alias("meter_event_id")))
    live = last.where("reversal_of IS NULL").join(gone, "meter_event_id", "left_anti")
    return live.groupBy("billable_event").agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"))


def price_tiers(usage: DataFrame, tiers: DataFrame, units: str = "units") -> DataFrame:
    """Unit price and amount of each row, by the tier that holds its number of units; prices are decimals."""
    ends = tiers.withColumn("unit_to", F.lead("unit_from").over(Window.orderBy("unit_from")))
    inside = (F.col(units) >= F.col("unit_from")) & (F.col("unit_to").isNull() | (F.col(units) < F.col("unit_to")))
    priced = usage.join(ends, inside).withColumn("unit_price", F.col("unit_price").cast("decimal(18,6)"))
    return priced.withColumn("amount", (F.col(units).cast("decimal(18,0)") * F.col("unit_price")).cast("decimal(28,6)")).drop("unit_from", "unit_to")


#: How strongly each resolution binds attempts to an operation.
RESOLUTION = {"none": 0, "provider_policy": 1, "correlated": 2, "idempotency_key": 3, "explicit_operation_id": 4, "explicit": 4}


def resolution_rank(resolution: str = "resolution") -> Column:
    rank = F.lit(0)
    for name, value in RESOLUTION.items():
        rank = F.when(F.col(resolution) == name, value).otherwise(rank)
    return rank


def billing_predicates(provenance: str = "none", operation_resolution: str = "none", corroboration: str = "none", replay_protection: str = "none") -> Column:
    """Whether an attempt meets a contract's requirements; each is a predicate of its own."""
    ok = F.lit(True)
    if provenance != "none":
        ok &= F.col("evidence") != "observed"
    if operation_resolution != "none":
        ok &= resolution_rank() >= RESOLUTION[operation_resolution]
    if corroboration == "required":
        ok &= F.col("has_client") & F.col("has_server")
    if replay_protection == "required":
        ok &= ~F.col("validity").isin("replay", "duplicate")
    return ok
