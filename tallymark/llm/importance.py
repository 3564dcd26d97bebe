"""Importance resampling: documents are drawn in proportion to how much likelier the target's n-gram model makes them.

Two generative models count hashed words and word pairs, one over labelled good documents and one over all documents. A
document's log weight is the sum of its features' log ratios; Gumbel noise on top of it turns the k largest into a sample
without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, shared_dir, staged
from tallymark.llm.wordhash import mixed, windows, word_hashes


@dataclass(frozen=True)
class Config:
    """``labelled`` bounds the target's sample (about so many documents, by the hash of their ids); ``keep`` is the share
    drawn, by default the share of good ones among all labels."""

    buckets: int = 1 << 16
    labelled: int = 20_000
    keep: float | None = None
    smoothing: float = 1.0
    seed: int = 7


def features(words: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and of the pairs within each text (a text's last word has none: bucket -1)."""
    single = (mixed(words) % np.uint64(buckets)).astype(np.int64)
    pairs = np.full(len(words), -1, np.int64)
    if len(words) > 1:
        pairs[:-1] = (windows(words, 2) % np.uint64(buckets)).astype(np.int64)
    last = at[1:][at[1:] > at[:-1]] - 1
    pairs[last] = -1
    return single, pairs


def target_ids(labels: DataFrame, limit: int) -> np.ndarray:
    """The ids of about ``limit`` good documents at most, evenly by hash."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    n = good.count()
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    rows = good.where(slot < int(1_000_000 * min(1.0, limit / max(n, 1)))).collect()
    return np.array(sorted(r["doc_id"] for r in rows), np.int64)


def log_ratios(docs: DataFrame, ids: np.ndarray, config: Config) -> np.ndarray:
    """By bucket, the log of the target's over the whole corpus's smoothed probability."""
    size = config.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            words, at = word_hashes(batch.column(1))
            good = np.isin(batch.column(0).fill_null(-1).to_numpy(), ids)
            of = np.repeat(good, np.diff(at))
            for f in features(words, at, size):
                counts[0] += np.bincount(f[f >= 0], minlength=size)
                counts[1] += np.bincount(f[(f >= 0) & of], minlength=size)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], names=["i", "raw", "target"])

    rows = docs.mapInArrow(count, "i long, raw long, target long").groupBy("i").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = np.zeros((2, size))
    for r in rows.toLocalIterator():  # one row a bucket
        counts[:, r["i"]] = r["raw"], r["target"]
    p = np.log(counts + config.smoothing) - np.log(counts.sum(axis=1, keepdims=True) + config.smoothing * size)
    return p[1] - p[0]


def kth_largest(df: DataFrame, column: str, k: int, small: int = 10_000) -> float:
    """The exact k-th largest value, by counting in ever finer bins; at most ``small`` values come to the driver."""
    row = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, above, n = row["lo"], row["hi"], 0, None
    while lo < hi and (n is None or n > small):
        width = (hi - lo) / 4096
        inside = df.where((F.col(column) >= lo) & (F.col(column) <= hi))
        place = F.least(F.floor((F.col(column) - lo) / width), F.lit(4095)).cast("int")
        bins = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in bins:
            if above + n >= k:
                break
            above += n
    if lo == hi:
        return lo
    values = df.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()
    return sorted((r[0] for r in values), reverse=True)[k - above - 1]


def resampled(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> DataFrame:
    """Per row: doc_id, n_features, log_weight, key (with the noise) and kept.

    Null and empty texts have no features and a weight of 1. The noise comes from doc_id and seed, so repeated rows share it and
    are kept or left together; rows that tie with the k-th key are all kept. A null doc_id has the noise of -1. Without labels
    every row is kept; an empty table gives an empty result. Very long texts are read whole; other columns play no part.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    share = config.keep
    if share is None:
        share = labels.where("quality IS NOT NULL").agg(F.avg(F.col("quality").cast("double"))).first()[0]
    ratios = log_ratios(docs, target_ids(labels, config.labelled), config)
    size, seed = config.buckets, config.seed

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(1))
            single, pairs = features(words, at, size)
            each = ratios[single] + np.where(pairs >= 0, ratios[pairs], 0.0)
            sums = np.add.reduceat(np.append(each, 0.0), at[:-1]) * (np.diff(at) > 0)
            n = np.diff(at) + np.maximum(np.diff(at) - 1, 0)
            ids = batch.column(0).fill_null(-1).to_numpy().astype(np.uint64)
            u = (mixed(mixed(ids) + np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5
            noise = -np.log(-np.log(u / 2.0**53))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(sums), pa.array(sums + noise)], names=["doc_id", "n_features", "log_weight", "key"])

    weighed = staged(docs.mapInArrow(weigh, "doc_id long, n_features long, log_weight double, key double"), "weights")
    k = round((1.0 if share is None else share) * weighed.count())
    least = kth_largest(weighed, "key", k) if k else float("inf")
    return weighed.withColumn("kept", F.col("key") >= least)
