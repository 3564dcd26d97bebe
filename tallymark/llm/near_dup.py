"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard on full shingle sets, connected components.

Two permutations make the whole signature. The first scatters the shingles over the circle of 2^32 places; the second is
read at that place shifted by k for coordinate k, and each coordinate is the least value. Coordinates are banded; documents
that share a band are candidates.

Equal sets form one class first. In each bucket every class is compared with its heads, which joins most copies. Every pair that
then shares a bucket but not a component is compared too: in small buckets pair by pair, in large ones block by block, where one
pass over a block's sets counts what each of them shares with each outsider. So no candidate is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, discard, shared_dir, staged, without
from tallymark.llm.graph import blocks, bucketed, components, joined, led, unsettled, within_small
from tallymark.llm.wordhash import mixed, shingles, word_hashes


@dataclass(frozen=True)
class Config:
    """Sets of ``words``-word shingles link at a Jaccard similarity of ``percent`` / 100.

    A pair at exactly 0.85 misses all of 20 bands of 4 coordinates with a probability of 4e-7. Unsettled buckets of at most
    ``small`` classes are compared pair by pair, larger ones in blocks of about ``block`` shingles.
    """

    words: int = 5
    percent: int = 85
    bands: int = 20
    rows: int = 4
    small: int = 32
    block: int = 1 << 20


def signature(sets: np.ndarray, size: int) -> np.ndarray:
    """The least value of the second permutation, shifted by k, over the first permutation's places; for each k."""
    places = (mixed(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for i in range(0, len(places), 1024):
        x = places[None, i : i + 1024] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def sketched(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, h (tells the texts of one doc_id apart), n_shingles, node (a digest of the set; null if it is empty) and signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = config.bands * config.rows
        for batch in batches:
            words, at = word_hashes(batch.column(2))
            counts, nodes, signatures = [], [], []
            for i in range(len(batch)):
                own = shingles(words[at[i] : at[i + 1]], config.words)
                counts.append(len(own))
                nodes.append(int(mixed(np.array([np.bitwise_xor.reduce(mixed(own)), own.sum()])).sum().astype(np.int64)) if len(own) else None)
                signatures.append(signature(own, size).astype(np.int32) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.list_(pa.int32()))], names=["doc_id", "h", "n_shingles", "node", "signature"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(sketch, "doc_id long, h long, n_shingles long, node long, signature array<int>")


def confirmed(pairs: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    """The pairs (a, b) of ids whose full sets are similar; ``texts`` has the text of every id."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.empty(0, np.uint64)
        for batch in batches:
            a = batch.column(0).to_pylist()
            fresh = [i for i in range(len(a)) if a[i] != (a[i - 1] if i else leader)]
            heads, at_a = word_hashes(batch.column(2).take(pa.array(fresh, pa.int64())))
            words, at_b = word_hashes(batch.column(3))
            kept, k = [], -1
            for i in range(len(a)):
                if k + 1 < len(fresh) and fresh[k + 1] == i:
                    k += 1
                    leader, own = a[i], shingles(heads[at_a[k] : at_a[k + 1]], config.words)
                other = shingles(words[at_b[i] : at_b[i + 1]], config.words)
                both = len(np.intersect1d(own, other, assume_unique=True))
                kept.append(100 * both >= config.percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept))

    left = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(left.hint("merge"), "b").join(right.hint("merge"), "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(similar, "a long, b long")


def block_links(outside: list[tuple[int, int, np.ndarray]], inside: list[tuple[int, int, np.ndarray]], percent: int) -> Iterator[tuple[int, int]]:
    """The links of a block's (id, component, sorted set) rows between components: one for each outsider and component.

    The sets inside are laid end to end as places in the outsiders' vocabulary; what an outsider shares with all of them is
    one look-up of those places, so a pair costs a few nanoseconds a shingle.
    """
    vocabulary = np.unique(np.concatenate([s for _, _, s in outside]))
    inside = sorted(inside, key=lambda row: len(row[2]))
    sizes = np.array([len(s) for _, _, s in inside])
    ids, roots = np.array([i for i, _, _ in inside]), np.array([c for _, c, _ in inside])
    data = np.concatenate([s for _, _, s in inside])
    place = np.searchsorted(vocabulary, data)
    place[place == len(vocabulary)] = 0
    known = vocabulary[place] == data
    place, owner = place[known], np.repeat(np.arange(len(inside)), sizes)[known]
    begins = np.searchsorted(owner, np.arange(len(inside) + 1))
    mask = np.zeros(len(vocabulary), bool)
    for x, c, own in outside:
        low, high = np.searchsorted(sizes, -(-percent * len(own) // 100)), np.searchsorted(sizes, 100 * len(own) // percent, side="right")
        if low >= high:
            continue
        at = np.searchsorted(vocabulary, own)
        mask[at] = True
        own_places = slice(begins[low], begins[high])
        both = np.bincount(owner[own_places][mask[place[own_places]]] - low, minlength=high - low)
        mask[at] = False
        linked = low + np.flatnonzero((100 * both >= percent * (len(own) + sizes[low:high] - both)) & (roots[low:high] != c))
        for k in linked[np.unique(roots[linked], return_index=True)[1]]:
            yield x, int(ids[k])


def blockwise(rows: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    """Links (a, b) between components in the blocks that graph.blocks made."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            found = list(block_links(*sides, config.percent)) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            words, at = word_hashes(batch.column("text"))
            columns = [batch.column(name).to_pylist() for name in ("key", "i", "j", "side", "id", "c")]
            for n, (key, i, j, side, x, c) in enumerate(zip(*columns, strict=True)):
                if block != (key, i, j):
                    yield links()
                    block, sides = (key, i, j), ([], [])
                sides[side].append((x, c, shingles(words[at[n] : at[n + 1]], config.words)))
        yield links()

    met = rows.join(texts.hint("merge"), "id")
    return met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(compare, "a long, b long")


def judged(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Per row: doc_id, h (a hash of the text), n_shingles, component_id (the smallest doc_id reachable by links, itself included) and kept.

    A null text, or one without words, has an empty set and is linked with nothing. Rows with a null doc_id are not linked
    (their component is null and they are kept). Rows that repeat have equal sets and so share a component; rows of
    one doc_id with different texts each follow their own text. Very long texts are compared whole. An empty table gives an empty
    result, and other columns of ``docs`` play no part. Sets are compared by 64-bit hashes of their shingles.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    sketches = staged(sketched(docs, config), "sketches")
    known = sketches.where("doc_id IS NOT NULL AND node IS NOT NULL")
    first = F.min(F.struct("doc_id", "h", "n_shingles", "signature"))
    classes = staged(known.groupBy(F.col("node").alias("id")).agg(first.alias("first")).select("id", "first.*"), "classes")
    band = lambda k: F.xxhash64(k, *(F.get("signature", k * config.rows + i) for i in range(config.rows)))
    every = classes.select("id", F.col("n_shingles").alias("size"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(config.bands - 1)), band)).alias("key"))
    buckets = bucketed(every, config.small)
    fits = 100 * F.least("size_a", "size_b") >= config.percent * F.greatest("size_a", "size_b")

    # What follows the corpus in size is never broadcast, however small the corpus.
    members = classes.join(buckets.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "doc_id", "h")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    texts = staged(texts.join(members.hint("merge"), ["doc_id", "h"]).select("id", "text").dropDuplicates(["id"]), "texts")

    tested = staged(led(buckets, fits), "led")
    roots = components(staged(confirmed(tested, texts, config), "links"), "a", "b")
    rest = unsettled(buckets, roots)
    pairs = within_small(rest, config.small, fits).join(tested, ["a", "b"], "left_anti")
    more = staged(confirmed(pairs, texts, config).unionByName(blockwise(blocks(rest, config.small, config.block, config.percent / 100), texts, config)), "more-links")
    if not more.isEmpty():
        roots = joined(roots, more)
    discard(buckets, texts, tested, rest, more)

    placed = classes.select("id", "doc_id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    names = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names, "root").select(F.col("id").alias("node"), "component_id")
    out = sketches.select("doc_id", "h", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(named, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def linked(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """``judged`` without the hash."""
    return judged(docs, config).drop("h")


def kept_documents(docs: DataFrame, config: Config = Config(percent=80)) -> DataFrame:
    """The rows of one document of each group, the one with the smallest doc_id; columns as they were.

    Different texts of one doc_id each follow their own text, as in ``judged``.
    """
    return without(docs, judged(docs, config).where("NOT kept"))
