"""Surfaces to entities by exact match of ids and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alias_map(registry: DataFrame) -> DataFrame:
    """(alias_key, entity_id) of a registry with ``aliases`` (map) and ``surfaces`` (array of structs with surface_id)."""
    aliases = registry.select("entity_id", F.explode(F.map_values("aliases")).alias("alias_key"))
    surfaces = registry.select("entity_id", F.explode("surfaces").alias("s")).select("entity_id", F.col("s.surface_id").alias("alias_key"))
    return aliases.unionByName(surfaces).where("alias_key <> ''").distinct()


def resolve_entity(rows: DataFrame, aliases: DataFrame, surface: str = "surface_id") -> DataFrame:
    """Add entity_id and entity_status: resolved, unknown (no entity) or ambiguous (several)."""
    keys = aliases.groupBy("alias_key").agg(F.min("entity_id").alias("_low"), F.max("entity_id").alias("_high"))
    met = rows.join(keys, rows[surface] == keys.alias_key, "left").drop("alias_key")
    status = F.when(F.col("_low").isNull(), "unknown").when(F.col("_low") != F.col("_high"), "ambiguous").otherwise("resolved")
    return met.withColumn("entity_status", status).withColumn("entity_id", F.when(status == "resolved", F.col("_low"))).drop("_low", "_high")


def entity_rollup(resolved: DataFrame) -> DataFrame:
    """Rows and surfaces per resolved entity, merged if it has several surfaces."""
    out = resolved.where("entity_status = 'resolved'").groupBy("entity_id").agg(F.count("*").alias("n"), F.count_distinct("surface_id").alias("surfaces"))
    return out.withColumn("basis", F.when(F.col("surfaces") > 1, "merged").otherwise("surface-only"))


def identity_conflict_share(resolved: DataFrame) -> DataFrame:
    out = resolved.agg(F.count_if(F.col("entity_status") == "ambiguous").alias("ambiguous"), F.count("*").alias("n"))
    return out.withColumn("share", F.when(F.col("n") > 0, F.col("ambiguous") / F.col("n")))
