"""Connected components of a graph of any size, and the candidates of large groups, as joins and aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import discard, staged


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    near = _least(edges)
    moved = edges.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(near.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each node points to one root and no root points on."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    nodes = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, root) of every node but the roots, root the smallest node of its component. Nulls and loops don't count.

    Alternates large-star and small-star steps until the edges are stars. A hub's edges are reduced to a minimum before
    the shuffle and its joins can be split, so no task holds all edges of a node. Each round is written, and frees the one
    before it with its shuffles; the result can be discarded.
    """
    edges = staged(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(edges):
        larger = staged(_large_star(edges).where("u <> v"), "large-star")
        discard(edges)
        edges = staged(_small_star(larger).where("u <> v"), "edges")
        discard(larger)
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.staged_at = edges.staged_at
    return out


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """The components when links (a, b) are added to those of ``roots``, which are discarded."""
    out = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")), "a", "b")
    discard(roots)
    return out


def bucketed(every: DataFrame, small: int) -> DataFrame:
    """Rows (key, id, size) and their heads, for keys that more than one id has; every.size is how much an id weighs.

    Heads are whom all of a bucket are compared with first: the least id; in buckets of more than ``small`` also the largest
    and one by hash. Keys are counted before each join, and the counts written, so a join can be split and a key of many ids
    fills no task.
    """
    shared = every.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    shared = staged(shared.select("key"), "shared")
    rows = staged(every.join(shared.hint("merge"), "key"), "shared-rows")
    out = headed(rows, small)
    discard(shared, rows)
    return out


def headed(rows: DataFrame, small: int) -> DataFrame:
    """Rows (key, id, size) of shared keys with their heads: see ``bucketed``."""
    own = F.struct("id", "size")
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(own).alias("low"), F.max(own).alias("high"), F.min_by(own, F.xxhash64("id")).alias("any"))
    heads = F.when(F.col("n") > small, F.array("low", "high", "any")).otherwise(F.array("low"))
    heads = staged(counts.select("key", heads.alias("heads")), "heads")
    out = staged(rows.join(heads.hint("merge"), "key"), "buckets")
    discard(heads)
    return out


def led(buckets: DataFrame, fits: Column) -> DataFrame:
    """The pairs (a, b), a < b, of the members of buckets with their heads; ``fits`` is a condition on size_a and size_b."""
    pairs = buckets.select("id", "size", F.explode("heads").alias("head")).where("id <> head.id")
    less = F.col("id") < F.col("head.id")
    pick = lambda x, y: F.when(less, x).otherwise(y)
    pairs = pairs.select(pick(F.col("id"), F.col("head.id")).alias("a"), pick(F.col("head.id"), F.col("id")).alias("b"), pick(F.col("size"), F.col("head.size")).alias("size_a"), pick(F.col("head.size"), F.col("size")).alias("size_b"))
    return pairs.where(fits).select("a", "b").distinct()


def unsettled(buckets: DataFrame, roots: DataFrame, *more: str) -> DataFrame:
    """(key, id, size, c, main, n, weight, outside) of the buckets that hold more than one component, and ``more`` columns of theirs.

    c is the row's component and main the one of the most rows; n rows and ``weight`` in all, ``outside`` of which is not in main.
    """
    placed = buckets.select("key", "id", "size", *more).join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "size", F.coalesce("root", "id").alias("c"), *more)
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("weight")).groupBy("key")
    parts = parts.agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.max_by("weight", F.struct("n", "c")).alias("inside"), F.count("*").alias("parts"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    parts = parts.where("parts > 1").select("key", "main", "n", "weight", (F.col("weight") - F.col("inside")).alias("outside"))
    return staged(placed.join(parts, "key"), "unsettled")


def led_again(open_rows: DataFrame, small: int, heads: int, fits: Column, *more: str) -> DataFrame:
    """Pairs (a, b), a < b, of the rows outside the main component of larger unsettled buckets with some rows of other components.

    Those are the least by hash in each of ``heads`` parts of the main component, and in two parts of the rest. Where copies
    gather around no single one of them, this joins most that are left. ``fits`` is a condition on size_a and size_b, and on am0
    and bm0 if ``more`` has m0.
    """
    many = open_rows.where(F.col("n") > small)
    inside = F.col("c") == F.col("main")
    slot = F.when(inside, F.pmod(F.xxhash64("id"), F.lit(heads))).otherwise(heads + F.pmod(F.xxhash64("id"), F.lit(2)))
    chosen = many.groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("id", "size", "c", *more), F.xxhash64("id", F.lit(1))).alias("head"))
    outside = many.where(~inside).select("key", "id", "size", "c", *more).join(chosen, "key").where("c <> head.c")
    less = F.col("id") < F.col("head.id")
    pick = lambda x, y: F.when(less, x).otherwise(y)
    both = lambda c, a, b: (pick(F.col(c), F.col(f"head.{c}")).alias(a), pick(F.col(f"head.{c}"), F.col(c)).alias(b))
    pairs = outside.select(*both("id", "a", "b"), *both("size", "size_a", "size_b"), *(x for m in more for x in both(m, f"a{m}", f"b{m}")))
    return pairs.where(fits).select("a", "b").distinct()


def within_small(open_rows: DataFrame, small: int, fits: Column, *more: str) -> DataFrame:
    """All pairs (a, b), a < b, of different components in unsettled buckets of at most ``small`` rows; ``fits`` and ``more`` as in ``led_again``."""
    few = open_rows.where(F.col("n") <= small)
    side = lambda x: few.select("key", F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("c").alias(f"c_{x}"), *(F.col(m).alias(f"{x}{m}") for m in more))
    return side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & fits).select("a", "b").distinct()


def blocks(open_rows: DataFrame, small: int, block: int, ratio: float, *more: str, weight: str = "size") -> DataFrame:
    """(key, i, j, side, id, size, c) and ``more`` columns: the larger unsettled buckets as blocks that together hold every pair whose sizes fit.

    Sizes fit if the smaller is at least ``ratio`` of the larger: rows are told apart by classes of size as wide as that, and meet their own
    class and the two beside it. Side 0 of a block is a part of what lies outside the bucket's main component, side 1 a part of all
    its rows in one class; each part weighs about ``block`` by the expression ``weight``, so a task holds two of them at a time however
    large the bucket is. A row is copied once for each part that it meets.
    """
    many = open_rows.where(F.col("n") > small).withColumn("class", F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(-math.log(ratio)) + 1e-9).cast("int"))
    rows = ["id", "size", "c", *more]
    near = F.explode(F.array(*(F.col("class") + d for d in (-1, 0, 1)))).alias("class")
    outside = many.where("c <> main").select("key", near, *rows)
    weights = lambda x, name: x.groupBy("key", "class").agg(F.sum(F.expr(weight)).alias(name))
    sizes = weights(outside, "outside").join(weights(many, "inside"), ["key", "class"])
    cut = lambda side: F.ceil(F.col(side) / block).cast("int")
    part = lambda side: F.pmod(F.xxhash64("id"), cut(side)).cast("int")
    others = lambda side: F.explode(F.sequence(F.lit(0), cut(side) - 1))
    key = F.xxhash64("key", "class").alias("key")
    a = outside.join(sizes.hint("merge"), ["key", "class"]).select(key, part("outside").alias("i"), others("inside").alias("j"), F.lit(0).alias("side"), *rows)
    b = many.select("key", "class", *rows).join(sizes.hint("merge"), ["key", "class"]).select(key, others("outside").alias("i"), part("inside").alias("j"), F.lit(1).alias("side"), *rows)
    return a.unionByName(b)
