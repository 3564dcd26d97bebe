"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizations of a text are arrays of byte offsets at which their tokens end. Along a diagonal (a fixed shift between the two
indexes) ends agree for as long as tokens are one to one: from a common end on, stretches of the two arrays are compared as a
whole, twice as long each time, and jumped; the first place where they differ ends the stretch. There lies one irregular
group, which two pointers resolve; it changes the shift. Ends are held as steps (the tokens' lengths), so that a stretch of one array
is a few bytes and two of them are compared at once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, discard, shared_dir, staged

#: An id pair as one number: A's id times this, and B's. Vocabularies are smaller.
BASE = 1 << 20


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else one past 255, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers of a task. ``a`` is a tokenizer's JSON, ``b`` a piece model's bytes, ``pattern`` what parts A's words.

    Where A's ids are its merges in order, tiktoken gives the same ids from the same vocabulary in a third of the time.
    """

    def __init__(self, a: str, b: bytes, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        said = json.loads(a)
        vocabulary, special = said["model"]["vocab"], {t["content"]: t["id"] for t in said.get("added_tokens", ())}
        values = byte_of()
        table = {k: bytes(map(values.__getitem__, token)) for token, k in vocabulary.items() if token not in special}
        self.encode_a = self.ranked(said, table, pattern) or self.plain(a)
        self.bytes_a = [table.get(k, b"") for k in range(max([*table, *special.values()]) + 1)]
        for token, k in special.items():
            self.bytes_a[k] = token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) >= BASE:
            raise ValueError(f"a vocabulary has more than {BASE} ids")
        wide = np.uint8 if max(map(len, self.bytes_a + self.bytes_b)) < 256 else np.uint16
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], wide) for t in (self.bytes_a, self.bytes_b))
        self.digits = Digits(max(len(self.bytes_a), len(self.bytes_b)))

    @staticmethod
    def ranked(said: dict, table: dict[int, bytes], pattern: str):
        """A's encoder by ranks, if its model is no more than merges in the order of their ids over the bytes."""
        model, before = said["model"], said.get("pre_tokenizer") or {}
        merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", ()))
        ids = [model["vocab"].get(m) for m in merged]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not said.get("normalizer")
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or ids != list(range(256, 256 + len(ids))) or len(table) != 256 + len(ids):
            return None
        import tiktoken

        encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={x: k for k, x in table.items()}, special_tokens={})
        return lambda texts: [encoding.encode_ordinary(t) for t in texts]

    @staticmethod
    def plain(a: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(a)
        tokenizer.encode_special_tokens = True
        return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B of each text; none where their bytes differ from a space and the text."""
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        for k, text, ids_a, ids_b in zip(some, spaced, self.encode_a(spaced), self.b.encode([texts[k] for k in some], num_threads=1), strict=True):
            if b"".join(map(self.bytes_a.__getitem__, ids_a)) == text.encode() == b"".join(map(self.bytes_b.__getitem__, ids_b)):
                out[k] = (ids_a, ids_b)
        return out


@lru_cache(1)
def pair_of(a: str, b: bytes, pattern: str) -> Pair:
    return Pair(a, b, pattern)


#: Tokens compared at first, and the most whose first difference is looked for; twice as many after each stretch that agrees.
PROBE, NEAR = 8, 64


def aligned(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Groups of two arrays of token lengths (uint8 or uint16) with the same sum, in order, as a flat list of threes: (k, 1, 1) for k
    one-to-one groups in a row, and (1, p, q) for an irregular group of p tokens of a and q of b."""
    out: list[int] = []
    i = j = 0
    n, wide = len(a), a.itemsize
    steps_a, steps_b = a.tobytes(), b.tobytes()
    list_a, list_b = a.tolist(), b.tolist()
    read = int.from_bytes
    while i < n:
        if list_a[i] == list_b[j]:
            begin, size = i, PROBE
            while True:
                x, y = steps_a[wide * i : wide * (i + size)], steps_b[wide * j : wide * (j + size)]
                if x == y:  # jump, and probe twice as far
                    i += size
                    j += size
                    if i >= n:
                        i = n
                        break
                    size *= 2
                elif size > NEAR:
                    size //= 4
                else:
                    differ = read(x, "little") ^ read(y, "little")
                    same = ((differ & -differ).bit_length() - 1) // (8 * wide)
                    i += same
                    j += same
                    break
            out += (i - begin, 1, 1)
            if i == n:
                break
        # Two pointers to the next end in common.
        p, q = i + 1, j + 1
        ahead = list_a[i] - list_b[j]
        while ahead:
            if ahead < 0:
                ahead += list_a[p]
                p += 1
            else:
                ahead -= list_b[q]
                q += 1
        out += (1, p - i, q - j)
        i, j = p, q
    return out


class Digits:
    """Decimal ids as rows of bytes, to write many of them at once."""

    def __init__(self, n: int):
        self.text = np.array([str(k) for k in range(n)], dtype="S")
        self.width = self.text.itemsize
        self.rows = np.pad(self.text.view(np.uint8).reshape(n, self.width), ((0, 0), (0, 1)))
        self.sizes = np.char.str_len(self.text)

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """a1,a2|b1;a3|b2,b3; for groups of p tokens of A and q of B, as bytes; and where each group ends in them."""
        ends_a, ends_b = np.cumsum(p), np.cumsum(q)
        own = np.arange(len(p))
        at_a = np.arange(len(ids_a)) + np.repeat(ends_b - q, p)
        at_b = np.arange(len(ids_b)) + np.repeat(ends_a, q)
        ids, mark = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = ids_a, ids_b
        last = ends_a[own] + ends_b[own]
        mark[last - q - 1], mark[last - 1] = ord("|"), ord(";")
        rows, sizes = self.rows[ids], self.sizes[ids]
        rows[np.arange(len(ids)), sizes] = mark
        ends = np.cumsum(sizes + 1)
        return rows[rows > 0], ends[last - 1]


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of a, token of b) of all that overlap. Each stretch between neighbouring ends lies in one token of either side."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort()
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, counts array<int>"


def alignments(docs: DataFrame, a: str, b: bytes, pattern: str) -> DataFrame:
    """ALIGNED of every (row, doc_id, text): each document's digest, and its distinct id pairs with the number of their links."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b, pattern))

    def flat(found: list, side: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each document's tokens begin, all ids and all lengths."""
        sizes = np.array([len(f[side]) for f in found], np.int64)
        ids = np.fromiter((x for f in found for x in f[side]), np.int64, int(sizes.sum()))
        return np.concatenate([[0], np.cumsum(sizes)]), ids, lengths[ids]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(*shared.value)
        for batch in batches:
            found = pair.tokens(batch.column(2).to_pylist())
            (at_a, ids_a, steps_a), (at_b, ids_b, steps_b) = flat(found, 0, pair.lengths_a), flat(found, 1, pair.lengths_b)
            steps, n_steps = [], []
            for k in range(len(found)):
                own = aligned(steps_a[at_a[k] : at_a[k + 1]], steps_b[at_b[k] : at_b[k + 1]])
                steps += own
                n_steps.append(len(own) // 3)
            times, p, q = np.array(steps, np.int64).reshape(-1, 3).T
            groups = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(n_steps, dtype=np.int64)])]
            data, ends = pair.digits.written(ids_a, ids_b, np.repeat(p, times), np.repeat(q, times))
            ends = np.concatenate([[0], ends])[groups].tolist()
            digests = [sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends, ends[1:], strict=False)]
            i, j = links(np.cumsum(steps_a, dtype=np.int64), np.cumsum(steps_b, dtype=np.int64))
            owner = np.repeat(np.arange(len(found)), np.diff(at_a))[i]
            n_links = np.bincount(owner, minlength=len(found))
            keys = (owner * BASE + ids_a[i]) * BASE + ids_b[j]
            keys.sort()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            offsets = pa.array(np.searchsorted(keys[first], np.arange(len(found) + 1) * BASE * BASE), pa.int32())
            counts = np.diff(first, append=len(keys)).astype(np.int32)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (np.diff(at_a), np.diff(at_b), np.diff(groups), n_links)), pa.array(digests, pa.string())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(keys[first] % (BASE * BASE))), pa.ListArray.from_arrays(offsets, pa.array(counts))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"])

    return docs.mapInArrow(align, ALIGNED)


#: Pairs that hold more than a 2^-18 part of all links are frequent; there can't be more than 2^18 of them.
FREQUENT = 1 << 18


def summed(found: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, n_best, count_sum, pairs, counts) of each document: sums over its frequent pairs, and what of it is not frequent.

    ``frequent`` (pairs, n, best) has at most ``FREQUENT`` rows and goes to all tasks.
    """
    rows = frequent.orderBy("pairs").toPandas()
    shared = found.sparkSession.sparkContext.broadcast((rows["pairs"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            at = batch.column(1).offsets.to_numpy()
            pairs, counts = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            at = at - at[0]
            where = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[where] == pairs if len(known) else np.zeros(len(pairs), bool)
            held = np.where(hit, counts, 0).astype(np.int64)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            one = total(held * (n[where] if len(known) else 1)), total(held * (best[where] if len(known) else 1))
            left = pa.array(np.concatenate([[0], np.cumsum(~hit)])[at], pa.int32())
            columns = [batch.column(0), pa.array(one[1]), pa.array(one[0]), pa.ListArray.from_arrays(left, pa.array(pairs[~hit])), pa.ListArray.from_arrays(left, pa.array(counts[~hit]))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_best", "count_sum", "pairs", "counts"])

    return found.select("row", "pairs", "counts").mapInArrow(add, "row long, n_best long, count_sum long, pairs array<long>, counts array<int>")


def linked(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best is how many links have the highest count of their B id in the corpus, ties included, and count_sum the sum of the counts of
    all links. Null and empty texts, and those whose tokens' bytes differ from a space and the text, have no tokens:
    zeros and an empty digest. Rows that repeat count each time, a null doc_id passes through, very long texts are aligned whole,
    other columns play no part, and an empty table gives an empty result.

    Texts are read and encoded once; what each document keeps are its distinct pairs. Frequent pairs, at most ``FREQUENT`` of them, are
    given to all tasks with their counts, as is the highest count of each B id (as many as B's vocabulary has); only the
    rest meet their counts in a shuffle.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bounded_batches(spark, 1)
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    found = staged(alignments(rows, a, b, pattern), "alignments")
    unfold = F.inline(F.arrays_zip("pairs", "counts"))
    counts = staged(found.select(unfold).groupBy("pairs").agg(F.sum(F.col("counts").cast("long")).alias("n")), "pair-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    highest = counts.groupBy((F.col("pairs") % BASE).alias("b")).agg(F.max("n").alias("highest"))
    known = counts.join(F.broadcast(highest), F.col("pairs") % BASE == F.col("b")).select("pairs", "n", (F.col("n") == F.col("highest")).alias("best"))
    known = staged(known, "known-pairs")
    often = F.col("n") * FREQUENT > total
    partly = staged(summed(found, known.where(often)), "summed")
    rest = partly.select("row", unfold).join(known.where(~often).hint("merge"), "pairs")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("more_best"), F.sum(F.col("counts") * F.col("n")).alias("more_sum"))
    own = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    met = own.join(partly.select("row", "n_best", "count_sum").hint("merge"), "row").join(rest.hint("merge"), "row", "left")
    both = lambda name, more: (F.col(name) + F.coalesce(more, F.lit(0))).alias(name)
    out = staged(met.select("doc_id", "n_a", "n_b", "n_groups", "n_links", both("n_best", "more_best"), both("count_sum", "more_sum"), "groups_sha256"), "linked")
    discard(found, counts, known, partly)
    return out
