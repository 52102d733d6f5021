"""Packing along a space-filling curve.

A document's hashed vector (its token ids, hashed to dimensions) is projected to four
dimensions; their quantiles give a cell of a grid, the cell its place on a
Hilbert curve. Documents are range-sorted by that place and their ids laid end
to end along the curve; cutting every `length` ids gives the sequences, so that only the
last one is padded, and neighbours on the curve share sequences.

The ids are written once. The sort moves only places and counts; the starts
come back to the ids by row number.

Defined results: a null text counts as empty and yields the end id alone; a text of any
length is cut into as many pieces as it needs; ties on the curve, equal texts among them,
are ordered by row; repeated keys and repeated rows are packed as rows each; columns
beside key and text are not read, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_workers, stored
from .wordbpe import loaded

LENGTH = 2_048
DIMS, BITS, BUCKETS = 4, 8, 4_096
SORT_ROWS = 200_000
#: Bounds of a batch of texts: larger ones share more words.
BATCH_ROWS, BATCH_BYTES = 2_048, 8 << 20
# -- the curve -------------------------------------------------------------
def projection(seed: int = 3) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMS)).astype(np.float32)


def of_ids(size: int, proj: np.ndarray) -> np.ndarray:
    """The projection of each id of a vocabulary, by the bucket that it hashes to."""
    ids = np.arange(size, dtype=np.uint64)
    return proj[(ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS].astype(np.float64)


def cells(ids: np.ndarray, lens: np.ndarray, each: np.ndarray) -> np.ndarray:
    """Grid cell of each document, n x DIMS in 0 .. 2**BITS - 1; the ids lie end to end, none has zero of them."""
    if not len(lens):
        return np.zeros((0, DIMS), np.int64)
    sums = np.add.reduceat(each[ids], np.cumsum(lens) - lens, 0)
    z = sums / np.sqrt(lens)[:, None] / 4.0  # repeated ids widen the sums beyond the unit normal
    return np.clip((1 / (1 + np.exp(-1.7 * z)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates, by the transposed-index construction."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


# -- the operator ----------------------------------------------------------
def pack(df: DataFrame, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """The pieces: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, place."""
    spark = df.sparkSession
    for_workers(spark, BATCH_ROWS, BATCH_BYTES)
    src = df.select(F.monotonically_increasing_id().alias("row"), df[key].alias("k"), df[text].cast("string").alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(tokenizer)
        each = of_ids(max(tok.lib.get_vocab_size(), end_id + 1), projection())
        for b in batches:
            if not b.num_rows:
                continue
            ids, n = tok.encode(b.column(2))
            n = n + 1
            ends = np.cumsum(n)
            packed = np.full(int(ends[-1]), end_id, tok.dtype)
            body = np.ones(len(packed), bool)
            body[ends - 1] = False
            packed[body] = ids
            place = hilbert(cells(packed, n, each))
            at = np.concatenate([[0], ends]) * tok.dtype.itemsize
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(place), pa.array(n), lists], ["row", "k", "place", "n", "ids"])

    held = stored(src.mapInArrow(tokens, f"row long, k {kind}, place long, n long, ids binary"), "pack-ids")
    rows = held.count()
    if not rows:
        return spark.createDataFrame([], f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long")
    light = held.select("row", "place", "n").repartitionByRange(max(1, -(-rows // SORT_ROWS)), "place", "row").sortWithinPartitions("place", "row")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            n = b.column(2).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array(ends - n), b.column(2)], ["row", "part", "within", "n"])
            total = int(ends[-1]) if len(ends) else total

    starts = stored(light.withColumn("part", F.spark_partition_id()).mapInArrow(running, "row long, part int, within long, n long"), "pack-starts")
    per = starts.groupBy("part").agg(F.sum("n").alias("n"))  # one row for each range of the sort
    base = per.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    at = starts.join(base, "part").select("row", (F.col("base") + F.col("within")).alias("first"))
    joined = held.join(at.hint("shuffle_hash"), "row").select("k", "ids", "first", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = loaded(tokenizer).dtype
        for b in batches:
            which, out = [], []
            for r, (ids, first) in enumerate(zip(b.column(1), b.column(2).to_pylist(), strict=True)):
                x = np.frombuffer(ids.as_buffer(), dtype).astype("<u4")
                at = 0
                while at < len(x):
                    seq, off = divmod(first + at, length)
                    size = min(length - off, len(x) - at)
                    which.append(r)
                    out.append((at, size, zlib.crc32(x[at : at + size].tobytes()), len(x), seq, off))
                    at += size
            i = pa.array(which, pa.int64())
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0).take(i), *(pa.array(c, pa.int64()) for c in cols), b.column(3).take(i)], [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "place"])

    return joined.mapInArrow(cut, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long")
