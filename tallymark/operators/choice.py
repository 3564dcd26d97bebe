"""Choice metrics: what was presented, what was selected, and who won against whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict(context: str = "context", validity: str = "validity") -> Column:
    return (F.col(context) == "production") & (F.col(validity) == "normal")


def since(rows: DataFrame, at: str, start: str | None) -> DataFrame:
    """The rows from a start on; without one, all."""
    return rows if start is None else rows.where(F.col(at).cast("timestamp") >= F.lit(start).cast("timestamp"))


def dedup_choice(rows: DataFrame, at: str) -> DataFrame:
    """The first row of each decision and tool, by line_no, tie, time and then the other columns."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sorted(rows.columns) if c not in ("line_no", "tie", at)]
    order = Window.partitionBy("decision_id", "tool").orderBy("line_no", "tie", at, F.concat_ws("|", *rest))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def presented_opportunities(presented: DataFrame, start: str | None = None) -> DataFrame:
    return since(presented, "presented_at", start).where(strict()).groupBy("tool").agg(F.count_distinct("decision_id").alias("presented"))


def selection_rate(presented: DataFrame, selected: DataFrame, start: str | None = None) -> DataFrame:
    """Selected of presented decisions per tool; a tool that was never presented has no row.

    A selection counts for the presentation of the same decision, tool and project whose candidate set is the same, nulls
    included. Both sides are partitioned by decision. A window bounds when decisions were presented, not when they were taken.
    """
    p = since(presented, "presented_at", start).where(strict()).select("decision_id", "tool", "candidate_set_id", "project_id").distinct().alias("p")
    s = selected.where(strict()).select("decision_id", "tool", "candidate_set_id", "project_id").distinct().withColumn("hit", F.lit(True)).alias("s")
    same = (F.col("p.decision_id") == F.col("s.decision_id")) & (F.col("p.tool") == F.col("s.tool")) & F.col("p.candidate_set_id").eqNullSafe(F.col("s.candidate_set_id")) & (F.col("p.project_id") == F.col("s.project_id"))
    joined = p.join(s, same, "left").select("p.tool", "p.decision_id", "hit")
    out = joined.groupBy("tool").agg(F.count_distinct("decision_id").alias("presented"), F.count_distinct(F.when(F.col("hit"), F.col("decision_id"))).alias("selected"))
    return out.withColumn("rate", F.col("selected") / F.col("presented"))


def share_in_category(rows: DataFrame) -> DataFrame:
    """A tool's decisions among those of its category."""
    per = rows.where(strict()).groupBy("category_id", "tool").agg(F.count_distinct("decision_id").alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("category_id")))


def head_to_head_matrix(presented: DataFrame, selected: DataFrame, start: str | None = None) -> DataFrame:
    """For all pairs of tools a < b presented together: decisions, wins of each, and a's share of the wins.

    Together means in one decision, candidate set and mode; a win also needs the project of both presentations. A window bounds
    presentations and selections. Pairs are of the few tools of one decision.
    """
    keys = ["decision_id", "candidate_set_id", "choice_mode", "project_id"]
    p = since(presented, "presented_at", start).where(strict()).where("candidate_set_id IS NOT NULL AND choice_mode IS NOT NULL").select(*keys, "tool").distinct()
    a, b = p.alias("a"), p.alias("b")
    same = (F.col("a.decision_id") == F.col("b.decision_id")) & (F.col("a.candidate_set_id") == F.col("b.candidate_set_id")) & (F.col("a.choice_mode") == F.col("b.choice_mode")) & (F.col("a.tool") < F.col("b.tool"))
    project = F.when(F.col("a.project_id") == F.col("b.project_id"), F.col("a.project_id")).alias("project_id")
    pairs = a.join(b, same).select("a.decision_id", "a.candidate_set_id", "a.choice_mode", project, F.col("a.tool").alias("tool_a"), F.col("b.tool").alias("tool_b"))
    s = since(selected, "selected_at", start).where(strict()).select(*keys, "tool").distinct()
    won = pairs.join(s, keys, "left")
    is_ = lambda c: F.count_distinct(F.when(F.col("tool") == F.col(c), F.col("decision_id")))
    out = won.groupBy("tool_a", "tool_b").agg(F.count_distinct("decision_id").alias("co_presented"), is_("tool_a").alias("a_selected"), is_("tool_b").alias("b_selected"))
    total = F.col("a_selected") + F.col("b_selected")
    return out.withColumn("share_a", F.when(total > 0, F.col("a_selected") / total))


def head_to_head(presented: DataFrame, selected: DataFrame, tool_a: str, tool_b: str, start: str | None = None, **scope: str) -> DataFrame:
    """One pair, within a scope: project_id, choice_mode and category_id narrow presentations, decision_authority and
    selection_constraint narrow selections."""
    for name, value in scope.items():
        if name in ("decision_authority", "selection_constraint"):
            selected = selected.where(F.col(name) == value)
        else:
            presented = presented.where(F.col(name) == value)
    pair = F.col("tool").isin(tool_a, tool_b)
    return head_to_head_matrix(presented.where(pair), selected.where(pair), start)


def choice_axes(selected: DataFrame) -> DataFrame:
    """Selections over mode, authority and constraint, with all subtotals."""
    rows = selected.where(strict())
    return rows.cube("choice_mode", "decision_authority", "selection_constraint").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))
