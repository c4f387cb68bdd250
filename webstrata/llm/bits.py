"""A bitmap of hashes with a fixed upper size, built by Spark and sent to all tasks.

It lets a pass skip what can't matter before anything is shuffled. It never decides a result: false positives drop out
in the join that follows. Its size follows the number of entries up to ``MOST`` bits (64 MB). Where these would be
filled by more than a third, hardly anything could be skipped: then no bits are gathered, and everything passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.session import stored

LEAST, MOST = 1 << 16, 1 << 29
#: Leading digits of a hash that name its bucket, at most: a million buckets.
BUCKET_DIGITS = 20


def crowded(entries: int) -> bool:
    return entries > MOST // 3


def everything(power: int = 0) -> np.ndarray:
    """A bitmap that all hashes are in."""
    return np.full(max(LEAST, 8 << power) // 64, ~np.uint64(0))


def bitmap(rows: DataFrame, key: Column, entries: int) -> Broadcast:
    """Bits at the low digits of ``key`` (a mixed 64-bit hash) of every row, 16 bits an entry while that fits."""
    if crowded(entries):
        return rows.sparkSession.sparkContext.broadcast(everything())
    bits = min(MOST, max(LEAST, 1 << (16 * max(entries, 1) - 1).bit_length()))
    at = key.bitwiseAND(F.lit(bits - 1))
    words = rows.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr("1L").alias("one"), at.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(one, b)")).alias("v"))
    out = np.zeros(bits // 64, np.uint64)
    found = words.toArrow()
    out[found.column("w").to_numpy()] = found.column("v").to_numpy().view(np.uint64)
    return rows.sparkSession.sparkContext.broadcast(out)


def holds(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the bitmap."""
    at = hashes & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _packed(v: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return (v >> np.uint64(8)).astype("<u4").tobytes() + (v & np.uint64(255)).astype("u1").tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 5
    return (np.frombuffer(blob, "<u4", n).astype(np.uint64) << np.uint64(8)) | np.frombuffer(blob, "u1", n, 4 * n)


def buckets(rows: DataFrame) -> int:
    """Leading digits of a hash that name its bucket: some four for every 32 MB of ``rows``, so that a bucket stays small."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Spark takes a table of unknown size for an enormous one.
    parts = max(len(rows.inputFiles()), rows.sparkSession.sparkContext.defaultParallelism, (size >> 25) if size < 1 << 55 else 0)
    return min(BUCKET_DIGITS, max(5, (4 * parts - 1).bit_length()))


def repeated(rows: DataFrame, hashes) -> Broadcast:
    """Bitmap of the hashes seen more than once over all rows; ``hashes(batch)`` gives a batch's (uint64, repeats kept).

    Every task sends each bucket one block of 40-bit numbers, each number once, or twice if the task saw it again; so
    what is shuffled is five bytes a distinct hash and task, and the hottest hash is two entries a task. Numbers that
    only agree in their first 40 bits pass for repeated, which the bitmap's users have to stand anyway.
    """
    power = buckets(rows)

    def deal(batches):
        held: list[np.ndarray] = []

        def flush():
            v, n = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            held.clear()
            v = np.repeat(v, np.minimum(n, 2))
            bucket = (v >> np.uint64(64 - power)).astype(np.int32)
            low = (v << np.uint64(power)) >> np.uint64(24)
            some, first = np.unique(bucket, return_index=True)
            ends = np.append(first, len(bucket))[1:]
            return pa.record_batch([pa.array(some, pa.int32()), pa.array([_packed(low[a:b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["bucket", "v"])

        size = 0
        for batch in batches:
            held.append(hashes(batch))
            size += len(held[-1])
            if size > 3_000_000:
                yield flush()
                size = 0
        yield flush()

    def meet(table: pa.Table) -> pa.Table:
        v = np.sort(np.concatenate([_unpacked(b) for b in table.column("v").to_pylist()]))
        again = np.unique(v[1:][v[1:] == v[:-1]])
        return pa.table([table.column("bucket").slice(0, 1), pa.array([len(again)], pa.int64()), pa.array([_packed(again)], pa.binary())], names=["bucket", "n", "v"])

    found = stored(rows.mapInArrow(deal, "bucket int, v binary").groupBy("bucket").applyInArrow(meet, "bucket int, n long, v binary"))
    total = found.agg(F.sum("n")).first()[0] or 0
    if crowded(total):
        return rows.sparkSession.sparkContext.broadcast(everything(power).view(np.uint8))
    # Every bucket has a byte at least.
    digits = max(power + 3, min(MOST, max(LEAST, 1 << (16 * max(total, 1) - 1).bit_length())).bit_length() - 1)

    def segment(batches):
        for batch in batches:
            out = []
            for blob in batch.column(1).to_pylist():
                bits = np.zeros(1 << (digits - power), np.uint8)
                bits[(_unpacked(blob) >> np.uint64(40 - (digits - power))).astype(np.int64)] = 1
                out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["bucket", "bits"])

    out = np.zeros((1 << digits) // 8, np.uint8)
    each = len(out) >> power
    assert each >= 1
    for r in found.select("bucket", "v").mapInArrow(segment, "bucket int, bits binary").toLocalIterator():
        out[r["bucket"] * each : (r["bucket"] + 1) * each] = np.frombuffer(r["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out)


def holds_top(bitmap_bytes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bitmap of ``repeated``."""
    digits = (len(bitmap_bytes) * 8).bit_length() - 1
    at = hashes >> np.uint64(64 - digits)
    return (bitmap_bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
