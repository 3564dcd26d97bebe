"""Exact top-k search by inner product: vectors by descending length, partial sums in rotated space, Cauchy-Schwarz bounds.

An orthogonal rotation from the vectors' SVD puts most of their length into the first dimensions. A candidate's inner product
with a query is at most the partial sum over these, plus the product of both vectors' residual lengths. Candidates come by descending
length: once length times length is below a query's k-th score, all later ones are. Candidates that no bound rules out are scored in
whole numbers, so that results are exact whatever the rounding of the bounds.

Queries and candidates meet in a grid: a task holds a block of queries while a part of the candidates, a range of lengths, passes by.
The longest candidates come first, for all queries; then each query goes only to the parts that its score so far can't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, discard, shared_dir, staged
from tallymark.llm.whitening import usable, whole


@dataclass(frozen=True)
class Config:
    """The ``k`` best of each query. ``scale``: see whitening.whole. Partial sums run over ``dims`` rotated dimensions.

    The grid's blocks hold ``queries``, and its parts ``part`` candidates or, in small tables, as many as give ``spread`` parts.
    Shuffled are every vector once for each block of queries, and every query once for each part that it needs.
    """

    k: int = 5
    scale: int = 256
    dims: int = 24
    queries: int = 1 << 16
    part: int = 1 << 18
    spread: int = 24


#: Scores below this are exact in double precision and in a long.
EXACT = float(1 << 52)


class Best:
    """The best scores so far of a block of queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, rotation: np.ndarray, config: Config):
        self.k, self.dims, self.rotation = config.k, min(config.dims, rotation.shape[1]), rotation
        self.ids, self.x, self.floor = ids, x, floor
        self.head, self.rest, self.length = self.parts(x)
        self.scores = np.full((len(ids), self.k), np.iinfo(np.int64).min)
        self.names = np.full((len(ids), self.k), np.iinfo(np.int64).max)
        self.open = np.arange(len(ids))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First rotated dimensions, length of the rest, and whole length."""
        y = x.astype(float)
        head = y @ self.rotation[:, : self.dims]
        square = np.einsum("ij,ij->i", y, y)
        return head, np.sqrt(np.maximum(square - np.einsum("ij,ij->i", head, head), 0) + 1e-9 * square), np.sqrt(square)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """What a candidate must score at least to count: the k-th score, or what other parts have given already."""
        return np.maximum(self.scores[rows, self.k - 1], self.floor[rows]).astype(float)

    def exact(self, q: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Whole-number scores of pairs. Where they could pass 2^52 they are summed without limits, and held to a long's range."""
        if not len(q) or self.length.max() * self.longest < EXACT:
            return np.einsum("ij,ij->i", self.x[q], x[c])
        top = np.iinfo(np.int64)
        return np.array([min(max(sum(int(a) * int(b) for a, b in zip(self.x[i], x[j], strict=True)), top.min), top.max) for i, j in zip(q, c, strict=True)], np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Candidates, no longer than those before."""
        head, rest, length = self.parts(x)
        self.longest = float(length.max(initial=0))
        at = 0
        while at < len(ids) and len(self.open):
            # The first few set the scores that rule out the others.
            size = 32 if self.scores[self.open[0], self.k - 1] == np.iinfo(np.int64).min and at < 256 else 1024
            some = slice(at, at + size)
            slack = 1e-9 * length[at]
            self.open = self.open[self.length[self.open] * (length[at] + slack) + 1 >= self.least(self.open)]
            for begin in range(0, len(self.open), 2048):
                rows = self.open[begin : begin + 2048]
                bound = self.head[rows] @ head[some].T
                bound += self.rest[rows, None] * rest[None, some]
                bound += (self.length[rows, None] + 1) * slack + 1
                q, c = np.nonzero(bound >= self.least(rows)[:, None])
                for k in range(0, len(q), 1 << 18):
                    self.keep(rows[q[k : k + (1 << 18)]], ids[some], c[k : k + (1 << 18)], x[some])
            at += size

    def keep(self, q: np.ndarray, ids: np.ndarray, c: np.ndarray, x: np.ndarray) -> None:
        """Score pairs, and keep the best k of each query, ties by id; rows come sorted by query."""
        scores, names = self.exact(q, c, x), ids[c]
        good = (names != self.ids[q]) & ((scores > self.scores[q, -1]) | ((scores == self.scores[q, -1]) & (names < self.names[q, -1])))
        q, scores, names = q[good], scores[good], names[good]
        if not len(q):
            return
        rows = np.unique(q)
        q = np.concatenate([q, np.repeat(rows, self.k)])
        scores, names = np.concatenate([scores, self.scores[rows].ravel()]), np.concatenate([names, self.names[rows].ravel()])
        order = np.lexsort((names, ~scores, q))
        q, scores, names = q[order], scores[order], names[order]
        first = np.searchsorted(q, rows)
        best = first[:, None] + np.arange(self.k)
        self.scores[rows], self.names[rows] = scores[best], names[best]

    def results(self) -> pa.RecordBatch:
        row, rank = np.nonzero(self.names != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.names[row, rank]), pa.array(self.scores[row, rank])], names=["query_id", "vec_id", "score"])


def searched(queries: DataFrame, candidates: DataFrame, rotation: np.ndarray, config: Config) -> DataFrame:
    """(query_id, vec_id, score): the best of each query (block, part, id, x, floor) among its part's candidates (block, part, id, x, length)."""
    shared = queries.sparkSession.sparkContext.broadcast(rotation)
    dims = rotation.shape[0]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, best = None, [], None
        for batch in batches:
            block, part, side, ids, floor = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "side", "id", "floor"))
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), dims)
            change = np.flatnonzero((block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])) + 1
            for a, b in zip([0, *change], [*change, len(batch)], strict=True):
                if a == b:
                    continue
                if (block[a], part[a]) != key:
                    if best:
                        yield best.results()
                    key, waiting, best = (block[a], part[a]), [], None
                if side[a] == 0:
                    waiting.append((ids[a:b], x[a:b], floor[a:b]))
                elif waiting or best:
                    if waiting:
                        best = Best(*(np.concatenate(w) for w in zip(*waiting, strict=True)), shared.value, config)
                        waiting = []
                    best.meet(ids[a:b], x[a:b])
        if best:
            yield best.results()

    far = F.lit(0.0)
    own = queries.select("block", "part", F.lit(0).alias("side"), far.alias("order"), "id", "x", "floor")
    other = candidates.select("block", "part", F.lit(1).alias("side"), (-F.col("length")).alias("order"), "id", "x", F.lit(0).cast("long").alias("floor"))
    both = own.unionByName(other).repartition("block", "part").sortWithinPartitions("block", "part", "side", "order", "id")
    return both.mapInArrow(search, "query_id long, vec_id long, score long")


def rotation_of(vectors: DataFrame, dims: int, config: Config) -> np.ndarray:
    """The right singular vectors of the table, as columns; none that is not there."""
    table = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(F.transform("x", lambda c: c.cast("double"))).alias("v")), "v")
    try:
        return RowMatrix(table, numCols=dims).computeSVD(dims).V.toArray()
    except Exception as error:  # MLlib's word for a table of zeros
        if "All singular values are zero" not in str(error) and "requirement failed" not in str(error):
            raise
        return np.zeros((dims, 0))


def top(vectors: DataFrame, is_query: Column, config: Config = Config()) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` best of the other rows by inner product, ties by vec_id; all, if fewer.

    Vectors (vec_id, embedding) that are null or hold null or non-finite entries take no part, nor do rows with a null vec_id. Of rows that
    repeat a vec_id the least vector counts. Shorter vectors count as padded with zeros. Scores beyond a long are held to its range.
    An empty table, or one without queries, gives an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    schema = "query_id long, rank int, vec_id long, score long"
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("id"), whole("embedding", config.scale).alias("x"), is_query.alias("asks"))
    rows = rows.groupBy("id").agg(F.min("x").alias("x"), F.bool_or("asks").alias("asks"))
    square = F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = staged(rows.select("id", "x", F.sqrt(square).alias("length"), F.coalesce("asks", F.lit(False)).alias("asks")), "rows")
    said = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("queries"), F.max(F.size("x")).alias("dims"), F.min(F.size("x")).alias("least")).first()
    if not said["queries"]:
        discard(rows)
        return spark.createDataFrame([], schema)
    dims = max(said["dims"], 1)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))) if said["least"] < dims else F.col("x")
    rotation = rotation_of(rows.select(padded.alias("x")), dims, config)

    parts = max(1, -(-said["n"] // max(min(config.part, said["n"] // config.spread), 1024)))
    ordered = rows.select("id", padded.alias("x"), "length").repartitionByRange(parts, F.desc("length"), "id")
    ordered = staged(ordered.withColumn("part", F.spark_partition_id()), "by-length")
    bounds = [(r["part"], r["most"]) for r in ordered.groupBy("part").agg(F.max("length").alias("most")).orderBy("part").collect()]  # one row a part
    blocks = -(-said["queries"] // config.queries)
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asked = rows.where("asks").select("id", padded.alias("x"), "length", block.alias("block"))

    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    first = bounds[0][0]
    none = F.lit(np.iinfo(np.int64).min).cast("long")
    begun = searched(asked.select("block", F.lit(first).alias("part"), "id", "x", none.alias("floor")), ordered.where(F.col("part") == first).select("*", every), rotation, config)
    found = begun = staged(begun, "first-part")
    if len(bounds) > 1:
        floors = begun.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= config.k, F.min("score")).alias("floor"))
        known = asked.join(floors.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", none))
        rest = F.array(*(F.struct(F.lit(p).alias("part"), F.lit(m).alias("most")) for p, m in bounds[1:]))
        needed = F.filter(rest, lambda b: F.col("length") * b["most"] * (1 + 1e-9) + 1 >= F.col("floor"))
        known = known.select("block", "id", "x", "floor", F.explode(F.transform(needed, lambda b: b["part"])).alias("part"))
        later = staged(searched(known, ordered.where(F.col("part") != first).select("*", every), rotation, config), "later-parts")
        found = begun.unionByName(later)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.k).select("query_id", "rank", "vec_id", "score"), "top")
    discard(rows, ordered, *([begun, later] if len(bounds) > 1 else [begun]))
    return out


def report(embeddings: DataFrame) -> DataFrame:
    """``top`` with every vec_id divisible by 50 as a query; odd rows as there."""
    return top(embeddings, F.col("vec_id") % 50 == 0)
