"""Benchmark items in training text: rare n-gram seeds, a join on them, then Smith-Waterman alignment over words.

Word counts of the whole corpus say how often a run of item words would turn up by chance. At each place of an item the
shortest run that would turn up less than once is a seed, so a passage that leaked into many documents still has its seeds.
Documents and items that share a seed are joined, and the passage around it is aligned with the item.

The documents are read twice, however many items there are. What tasks are given besides is a Bloom filter of a fixed size: of
the items' words while words are counted, and of the seeds while they are looked for. It only saves rows; the joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, discard, shared_dir, staged, without
from tallymark.llm.wordhash import mixed, windows, word_hashes

#: Bytes that make words: letters, digits and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


@dataclass(frozen=True)
class Config:
    """Runs of ``shortest`` to ``longest`` words seed; an alignment counts from ``score`` of a perfect one's points.

    Items of fewer than ``least`` words name nothing in particular and match only whole. A filter has 2 ** ``bits`` bits.
    """

    shortest: int = 2
    longest: int = 8
    least: int = 8
    score: float = 0.5
    bits: int = 24


MATCH, MISMATCH, GAP = 2, -1, -1


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's points, and where the first such one ends in the text (exclusive)."""
    best, end, step = 0, 0, np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + step) - step
        if (top := int(row.max())) > best:
            best, end = top, int(row.argmax())
    return best, end


class Filter:
    """A Bloom filter of 64-bit numbers with three probes; ``of`` builds one from a column by bit_or over 64-bit chunks."""

    def __init__(self, chunks: np.ndarray):
        self.chunks, self.mask = chunks, np.uint64(len(chunks) * 64 - 1)

    @staticmethod
    def probes(numbers: np.ndarray) -> Iterator[np.ndarray]:
        once = mixed(numbers)
        return (once >> np.uint64(shift) for shift in (0, 20, 40))

    @classmethod
    def of(cls, numbers: DataFrame, bits: int) -> Filter:
        """Of the only column of a table; 2 ** (bits - 6) rows at most come to the driver."""

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy().astype(np.uint64)
                places = np.unique(np.concatenate([p & np.uint64((1 << bits) - 1) for p in cls.probes(own)]))
                chunk, bit = places >> np.uint64(6), np.uint64(1) << (places & np.uint64(63))
                begins = np.flatnonzero(np.diff(chunk, prepend=np.uint64(1 << 63)))
                values = np.bitwise_or.reduceat(bit, begins) if len(begins) else bit
                yield pa.RecordBatch.from_arrays([pa.array(chunk[begins].astype(np.int64)), pa.array(values.astype(np.int64))], names=["chunk", "bits"])

        chunks = np.zeros(1 << (bits - 6), np.int64)
        for row in numbers.mapInArrow(mark, "chunk long, bits long").groupBy("chunk").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            chunks[row["chunk"]] = row["bits"]
        return cls(chunks.astype(np.uint64))

    def which(self, numbers: np.ndarray) -> np.ndarray:
        """The places of the numbers that may be in the filter."""
        left = np.arange(len(numbers))
        for p in self.probes(numbers):
            place = p[left] & self.mask
            left = left[(self.chunks[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
        return left


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, item, words) of each different item with a word; ``item`` numbers the texts, words are 64-bit hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(2), keep=LETTERS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists([words[at[k] : at[k + 1]] for k in range(len(batch))])], names=["item_id", "item", "words"])

    return items.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").mapInArrow(hashed, "item_id long, item long, words array<long>").where(F.size("words") > 0)


def counted(docs: DataFrame, wanted: Filter) -> DataFrame:
    """(word, n): how often each word that the filter lets through stands in the documents; with a null word, all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _ = word_hashes(batch.column(0), keep=LETTERS)
            known, n = np.unique(words, return_counts=True)
            own = wanted.which(known)
            yield pa.RecordBatch.from_arrays([pa.array([*known[own].astype(np.int64), None], pa.int64()), pa.array([*n[own], len(words)], pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def item_seeds(words: np.ndarray, counts: np.ndarray, total: int, config: Config) -> Iterator[tuple[int, int, int]]:
    """(words in the run, its hash, place in the item) of each seed."""
    if len(words) < config.least:
        yield len(words), int(windows(words, len(words))[0]), 0
        return
    summed = np.concatenate([[0], np.cumsum(np.log((counts + 1) / (total + 1)))])
    hashes = {n: windows(words, n) for n in range(config.shortest, min(config.longest, len(words)) + 1)}
    for place in range(len(words) - config.shortest + 1):
        reach = [n for n in hashes if place + n <= len(words)]
        n = next((n for n in reach if summed[place + n] - summed[place] + np.log(total + 1) < 0), None)
        if n is None and place == 0:
            n = reach[-1]
        if n is not None:
            yield n, int(hashes[n][place]), place


def seeds(items: DataFrame, counts: DataFrame, total: int, config: Config) -> DataFrame:
    """(n, hash, item, place) of the seeds of all items."""

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, n = (np.array([p[k] for p in places], t) for k, t in (("word", np.int64), ("n", np.float64)))
                rows += [(n, np.uint64(h).astype(np.int64), item, place) for n, h, place in item_seeds(words.astype(np.uint64), n, total, config)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["n", "hash", "item", "place"])

    placed = items.select("item", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
    placed = placed.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("place", "word", F.coalesce("n", F.lit(0)).alias("n")))).alias("places"))
    return placed.mapInArrow(rare, "n long, hash long, item long, place long")


def hits(docs: DataFrame, wanted: Filter, lengths: list[int]) -> DataFrame:
    """The documents (doc_id, h, text) in which the filter lets a run of one of the lengths through, with these runs: (n, hash, at)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(2), keep=LETTERS)
            n_words = np.diff(at)
            owner, place = np.repeat(np.arange(len(batch)), n_words), np.arange(len(words)) - np.repeat(at[:-1], n_words)
            found = []
            for n in lengths:
                runs = windows(words, n)
                k = wanted.which(runs)
                k = k[owner[k] == owner[k + n - 1]]
                found.append(np.stack([owner[k], np.full(len(k), n), runs[k].astype(np.int64), place[k]]))
            found = np.concatenate([np.empty((4, 0), np.int64), *found], axis=1)
            found = found[:, np.argsort(found[0], kind="stable")]
            rows, ends = np.unique(found[0], return_index=True)
            ends = pa.array(np.append(ends, found.shape[1]), pa.int32())
            columns = [batch.column(c).take(pa.array(rows)) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(ends, pa.array(found[k])) for k in (1, 2, 3))], names=["doc_id", "h", "text", "n", "hash", "at"])

    return docs.mapInArrow(find, "doc_id long, h long, text string, n array<long>, hash array<long>, at array<long>")


def best_passage(item: np.ndarray, words: np.ndarray, starts: list[int], config: Config) -> tuple[float, int, int] | None:
    """(share of a perfect score, first word, end) of the best passage around the places where the item may begin, if it reaches the limit."""
    slack = len(item) // 2 + 2
    best, merged = (0.0, 0, 0), []
    for start in sorted(starts):
        a, b = max(0, start - slack), min(len(words), start + len(item) + slack)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        points, end = aligned(item, words[a:b])
        best = max(best, (points / (MATCH * len(item)), a, a + end))
    if best[0] < (config.score if len(item) >= config.least else 1.0):
        return None
    # Read backwards from its end, the alignment ends where it begins.
    share, a, end = best
    return share, end - aligned(item[::-1], words[a:end][::-1])[1], end


LEAKS = "doc_id long, h long, item_id long, score double, start_word long, end_word long"


def alignments(pairs: DataFrame, config: Config) -> DataFrame:
    """LEAKS of the rows (doc_id, h, text, item_id, words, starts) that align."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, at = word_hashes(batch.column(2), keep=LETTERS)
            rows = []
            for k, (doc, h, item_id, item, starts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5)), strict=True)):
                if best := best_passage(np.array(item, np.int64).astype(np.uint64), words[at[k] : at[k + 1]], starts, config):
                    rows.append((doc, h, item_id, *best))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "h", "item_id", "score", "start_word", "end_word"])

    return pairs.select("doc_id", "h", "text", "item_id", "words", "starts").mapInArrow(align, LEAKS)


def leaks(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): ``leaks_by_text``, the best passage of any text of an id."""
    best = F.max(F.struct("score", "start_word", "end_word")).alias("best")
    return leaks_by_text(docs, items, config).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def leaks_by_text(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """LEAKS: each document (h: a hash of its text) and item that align, with the best passage.

    Whole texts are read where they lie; only documents with a seed are shuffled. Null texts on either side match nothing, as do
    documents with a null doc_id and items with a null item_id; rows that repeat on either side give one row, and different
    texts of one doc_id are told apart, while those of one item_id give their best passage. Very long texts are searched whole. Without documents or items the
    result is empty; other columns play no part. Words are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), F.lower("text").alias("text"))
    items = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.lower("text").alias("text")).distinct()
    items = staged(item_words(items), "items")
    counts = staged(counted(docs, Filter.of(items.select(F.explode("words").alias("word")).distinct(), config.bits)), "item-word-counts")
    total = counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0
    found_at = staged(seeds(items, counts.where("word IS NOT NULL"), total, config), "seeds")
    lengths = sorted(r["n"] for r in found_at.select("n").distinct().collect())  # as many as Config has at most
    seeded = staged(hits(docs, Filter.of(found_at.select("hash").distinct(), config.bits), lengths), "seeded")
    found = seeded.dropDuplicates(["doc_id", "h"])
    runs = found.select("doc_id", "h", F.inline(F.arrays_zip("n", "hash", "at")))
    pairs = runs.join(found_at, ["n", "hash"]).groupBy("doc_id", "h", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("starts"))
    met = pairs.join(found.select("doc_id", "h", "text"), ["doc_id", "h"]).join(items, "item")
    best = F.max(F.struct("score", "start_word", "end_word")).alias("best")
    out = staged(alignments(met, config).groupBy("doc_id", "h", "item_id").agg(best).select("doc_id", "h", "item_id", "best.*"), "leaks")
    discard(items, counts, found_at, seeded)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, config: Config = Config()) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; each text of a doc_id is judged on its own."""
    return without(docs, leaks_by_text(docs, items, config))
