"""Training-order materialisation: fixed-length token sequences in shards of a fixed stride, in a keyed random order.

A Feistel network under a key, walked until it lands below the number of sequences, gives each sequence its slot; no slot
is stored, and any of them can be computed again. Shard s holds the slots from s times the shard's length on, record after
record, so a reader resumes at a slot by seeking.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import bounded_batches, exists, setting, shared_dir

#: Byte-level ids: a token is a byte of UTF-8; these two bytes never stand in UTF-8.
END, PAD = 0xFF, 0xFE
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Config:
    """``length`` tokens of ``width`` bytes (1, 2 or 4, little-endian) a sequence, ``shard`` sequences a shard; the shuffle is done in
    ``waves`` of shards, each durable before the next begins. ``pad`` fills the last sequence of a document."""

    length: int = 512
    width: int = 1
    pad: int = PAD
    shard: int = 1 << 16
    waves: int = 4
    key: str = "training-order"

    @property
    def stride(self) -> int:
        return self.length * self.width


def feistel(index: np.ndarray, total: int, key: str, rounds: int = 6) -> np.ndarray:
    """A permutation of 0 .. total - 1 under the key, applied to each index."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}/{r}".encode(), digest_size=8).digest())) for r in range(rounds)]
    out = index.astype(np.uint64)
    walking = np.ones(len(out), bool)
    while walking.any():
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            x = (right + k) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = out >= total
    return out.astype(np.int64)


def byte_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and ``ids``: the bytes of each text (null: none) and END, one unsigned byte a token."""
    return docs.select("doc_id", F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit(bytes([END]))).alias("ids"))


def id_tokens(docs: DataFrame, ids: str, end: int, width: int) -> DataFrame:
    """doc_id and ``ids``: token ids of an array<int> column (null: none) and an end token, each as ``width`` bytes.

    An id that doesn't fit into them is an error, never cut.
    """
    whole = F.concat(F.coalesce(ids, F.array().cast("array<int>")), F.array(F.lit(end)))
    fits = F.forall(whole, lambda t: (t >= 0) & (t < F.lit(1 << (8 * width))))
    digits = lambda t: F.concat(*(F.lpad(F.hex(F.shiftright(t.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)))
    packed = F.unhex(F.array_join(F.transform(whole, digits), ""))
    return docs.select("doc_id", F.when(fits, packed).otherwise(F.raise_error(F.lit(f"a token id needs more than {width} bytes"))).alias("ids"))


def numbered(tokens: DataFrame, config: Config) -> tuple[DataFrame, int, str]:
    """(doc_id, part, index, n_tokens, ids) of each sequence, indexed densely, how many there are, and a digest of the table.

    The index is the place in the table as it is read: sequences are counted by partition first (two numbers for each come to
    the driver: how many, and a hash of its rows and their places). ``tokens`` must read the same way twice, as files do.
    """
    n = F.ceil(F.octet_length("ids") / config.stride).cast("long")
    placed = tokens.select(F.spark_partition_id().alias("p"), n.alias("n"), F.xxhash64(F.monotonically_increasing_id(), "doc_id", "ids").alias("h"))
    rows = placed.groupBy("p").agg(F.sum("n").alias("n"), F.bit_xor("h").alias("h")).collect()
    counts = {r["p"]: r["n"] for r in rows}
    digest = hashlib.blake2b(repr(sorted((r["p"], r["n"], r["h"]) for r in rows)).encode(), digest_size=8).hexdigest()
    begins, total = {}, 0
    for p in sorted(counts):
        begins[p], total = total, total + counts[p]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        at, length = begins.get(p, 0), config.stride
        end = at + counts.get(p, 0)
        for batch in batches:
            ids, parts, indexes, sizes, records = [], [], [], [], []
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in range(0, len(data), length):
                    piece = data[k : k + length]
                    ids.append(doc), parts.append(k // length), indexes.append(at), sizes.append(len(piece) // config.width), records.append(piece)
                    at += 1
            slots = feistel(np.array(indexes, np.int64), total, config.key)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(slots), pa.array(sizes, pa.int64()), pa.array(records, pa.binary())], names=["doc_id", "part", "slot", "n_tokens", "ids"])
        if at != end:
            raise RuntimeError("the table read differently the second time; write it out before ordering it")

    return tokens.select(F.col("doc_id").cast("long"), "ids").mapInArrow(number, "doc_id long, part long, slot long, n_tokens long, ids binary"), total, digest


def shard_writer(folder: str, config: Config):
    """A task's sorted records to its shards' files: under a name of its own, then renamed, so that a retry replaces it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        shard, out, own = None, None, ""
        fill = config.pad.to_bytes(config.width, "little") * config.length

        def close() -> None:
            out.close()
            done = f"{root}/shard-{shard:08d}.bin"
            if store.get_file_info(done).type != fs.FileType.NotFound:
                store.delete_file(done)
            store.move(own, done)

        for batch in batches:
            slots, rows = batch.column("slot").to_pylist(), batch.column("ids").to_pylist()
            checks = []
            for slot, data in zip(slots, rows, strict=True):
                if slot // config.shard != shard:
                    if out:
                        close()
                    shard, own = slot // config.shard, f"{root}/.shard-{uuid.uuid4().hex}"
                    out = store.open_output_stream(own)
                record = data + fill[len(data) :]
                checks.append(zlib.crc32(record))
                out.write(record)
            s = np.array(slots, np.int64)
            columns = [batch.column("slot"), pa.array(s // config.shard), pa.array(s % config.shard * config.stride), batch.column("doc_id"), batch.column("part"), batch.column("n_tokens"), pa.array(checks, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "offset", "doc_id", "part", "n_tokens", "crc32"])
        if out:
            close()

    return write


MANIFEST = "slot long, shard long, offset long, doc_id long, part long, n_tokens long, crc32 long"


def materialised(tokens: DataFrame, folder: str, config: Config = Config()) -> DataFrame:
    """Write all sequences to ``folder``/shard-*.bin, and return the manifest: a row for each sequence.

    slot, shard, offset (bytes in the shard), doc_id, part (of the document), n_tokens (before padding), crc32 (of the record).
    A wave shuffles a range of shards by shard number, sorts each by slot and writes it, then its part of the manifest. When the call
    is repeated with the same table, folder and settings, waves whose part is complete are left as they are; repeating a wave
    rewrites the same bytes and its own part only. A folder of another table, in content or order, or of other settings is refused. Rows that repeat are sequences of their own; a null doc_id passes
    through; an empty table writes nothing.
    """
    from pyarrow import fs

    spark = tokens.sparkSession
    bounded_batches(spark)
    sequences, total, digest = numbered(tokens, config)
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    shards = -(-total // config.shard)
    step = max(1, -(-shards // config.waves))
    plan = hashlib.blake2b(f"{total} {digest} {config}".encode(), digest_size=8).hexdigest()
    others = {f.base_name.split("-")[1] for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("manifest-")} - {plan}
    if others:
        raise ValueError(f"{folder} holds the shards of another table or of other settings; name a new folder")
    parts = []
    for first in range(0, shards, step):
        count = min(step, shards - first)
        parts.append(f"{folder}/manifest-{plan}-{first:08d}")
        if exists(spark, f"{parts[-1]}/_SUCCESS"):
            continue
        wave = sequences.where((F.col("slot") >= first * config.shard) & (F.col("slot") < (first + count) * config.shard))
        wave = wave.repartitionById(count, (F.floor(F.col("slot") / config.shard) - first).cast("int")).sortWithinPartitions("slot")
        with setting(spark, CLEANUP, "true"):
            wave.mapInArrow(shard_writer(folder, config), MANIFEST).write.mode("overwrite").option("compression", "zstd").parquet(parts[-1])
    return spark.read.schema(MANIFEST).parquet(*parts) if parts else spark.createDataFrame([], MANIFEST)


def read_from(folder: str, slot: int, total: int, config: Config = Config()) -> Iterator[bytes]:
    """The records from a slot on, in training order: how a trainer resumes."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    while slot < total:
        with store.open_input_file(f"{root}/shard-{slot // config.shard:08d}.bin") as shard:
            shard.seek(slot % config.shard * config.stride)
            while record := shard.read(config.stride):
                yield record
                slot += 1


def report(spark: SparkSession, docs: DataFrame, config: Config = Config(), folder: str | None = None) -> DataFrame:
    """The manifest of the byte-level tokens of all documents, in a new folder unless one is named; odd rows as in ``materialised``."""
    return materialised(byte_tokens(docs), folder or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}", config)
