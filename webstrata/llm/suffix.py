"""Suffix-array dedup: every byte covered by a ``LENGTH``-byte string that also starts elsewhere is removed.

Partitioning makes the suffix arrays small without losing a match. Of every LENGTH-byte string the ``ANCHOR``-byte
piece with the smallest hash (its minimizer) is chosen; equal strings choose equal pieces. So strings only need
comparing around equal anchors, in the context that the strings choosing the anchor cover.

1. All documents: hashes of anchors, counted; those seen once are done with (a bitmap of the rest spares the shuffle).
2. Repeated anchors with a hash of their context, counted again. A context seen twice is repeated as a whole.
3. Contexts seen once, whose anchor occurs in other contexts. A LENGTH-byte string around an anchor has half of the other
   bytes on its left or on its right, so contexts that share neither half with another one have no partner. The bytes
   of the others, cut to the halves they share, with one copy of each partner, are grouped by anchor, and the suffix
   array of each anchor's contexts (linear grouping, ``gsaca``, many side by side) brings equal strings together;
   neighbours are compared byte by byte.
4. Covered stretches are joined to their texts, and what is left is hashed.

Scale: what is shuffled is hashes, repeated anchors, ambiguous contexts and, once, the texts for the last join. An
anchor with more than ``MOST_CONTEXTS`` contexts (the edge of a passage many documents share) isn't collected: its
strings are counted by hash over all tasks instead, with partial aggregation.

Defined results: null text counts as empty; texts shorter than LENGTH keep all; repeated rows (same doc_id or not) are
documents of their own, so their strings repeat; matches may overlap and never cross documents; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import bits, kernels
from webstrata.llm.gsaca import suffix_arrays
from webstrata.session import small_batches, stored

LENGTH = 200
ANCHOR = 32
MOST_CONTEXTS = 5_000
#: Contexts per bucket, about; some 0.8 MB of text.
BUCKET = 3_000


def anchors(data: bytes, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of every anchor of one text: hash, context hash, context [start, end) (the strings that choose it), place, and hashes of half the other bytes of a string to its left and its right."""
    if len(data) < length:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    roll = kernels.Rolling(kernels.byte_symbols(np.frombuffer(data, np.uint8)))
    hashes = kernels.mix(roll.all_windows(k))
    at, start, last = kernels.minimizer_runs(hashes, length - k + 1)
    end = last + length
    context = kernels.mix(roll.runs(start, end) ^ kernels.mix((at - start).astype(np.uint64) * np.uint64(4096) + (end - at).astype(np.uint64)))
    half = (length - k) // 2
    # No string of the context has that many bytes on this side: nothing to share there.
    left = np.where(at - start >= half, kernels.mix(roll.runs(np.maximum(at - half, 0), at)), context)
    right = np.where(end - at - k >= length - k - half, kernels.mix(roll.runs(at + k, np.minimum(at + length - half, len(data)))), ~context)
    return hashes[at], context, start, end, at, (left >> np.uint64(32) << np.uint64(32)) | (right >> np.uint64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def anchor_hashes(length: int, k: int):
    return lambda batch: np.concatenate([np.empty(0, np.uint64), *(anchors(t, length, k)[0] for t in texts(batch, 0))])


def occurrences(length: int, k: int, wanted, with_bytes: bool):
    """Passes 2 and 3: anchors in the bitmap, told by anchor; or one place of a context each, with the context's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wanted.value
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            blobs: list[bytes] = []
            docs, hashes = batch.column(0).fill_null(-1).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint32).astype(np.uint64)
            for i, t in enumerate(texts(batch, 2)):
                h, c, start, end, at, sides = anchors(t, length, k)
                if not len(h):
                    continue
                spot = kernels.mix(kernels.mix(docs[i : i + 1]) ^ (hashes[i : i + 1] << np.uint64(32)) ^ start.astype(np.uint64))
                keep = bits.holds(words, h ^ c ^ spot) if with_bytes else bits.holds_top(words, h)
                if not keep.any():
                    continue
                h, c, start, end = h[keep], c[keep], start[keep], end[keep]
                for column, values in zip(rows, (np.full(len(h), i), signed(h), signed(c), start, end, signed(spot[keep]), at[keep] if with_bytes else signed(sides[keep])), strict=True):
                    column.append(values)
                if with_bytes:
                    blobs += [t[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            i, h, c, start, end, spot, more = (np.concatenate([np.empty(0, np.int64), *x]) for x in rows)
            i = pa.array(i)
            out = [batch.column(0).take(i), batch.column(1).take(i), pa.array(h), pa.array(c), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(spot)]
            names = ["doc_id", "th", "h", "c", "a", "b", "spot"]
            if with_bytes:
                yield pa.record_batch([*out, pa.array(more.astype(np.int32)), pa.array(blobs, pa.binary())], names=[*names, "at", "bytes"])
            else:
                yield pa.record_batch([*out, pa.array(more)], names=[*names, "sides"])

    return run


WHERE = "doc_id long, th int, h long, c long, a int, b int, spot long"


def repeated_in_bucket(length: int):
    """Suffix arrays of a bucket's anchors; stretches of contexts seen once that some other place repeats."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("h")
        blobs = table.column("bytes").to_pylist()
        sizes = np.array([len(b) for b in blobs])
        begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        data = np.frombuffer(b"\0".join(blobs) + b"\0", np.uint8)
        text = data.astype(np.int64) + 2
        text[begin + sizes] = 1
        # One text per anchor: its contexts, parted by a symbol below all bytes; the last one ends it.
        h = table.column("h").to_numpy()
        last = np.flatnonzero(np.append(h[1:] != h[:-1], True))
        text[(begin + sizes)[last]] = 0
        order = suffix_arrays(np.split(text, (begin + sizes)[last][:-1] + 1))
        owner = np.repeat(np.arange(len(blobs)), sizes + 1)
        offset = np.arange(len(data)) - begin[owner]
        order = order[offset[order] + length <= sizes[owner[order]]]
        if len(order):
            seen = np.lib.stride_tricks.sliding_window_view(data, length)
            same = np.empty(len(order) - 1, bool)
            for i in range(0, len(same), 20_000):
                same[i : i + 20_000] = (seen[order[i : i + 20_001][:-1]] == seen[order[i + 1 : i + 20_001]]).all(axis=1) if len(order[i : i + 20_001]) > 1 else []
            run_of = np.concatenate([[0], np.cumsum(~same)])
            ids = np.array([-1 if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
            _, doc = np.unique(np.stack([ids, table.column("th").to_numpy().astype(np.int64)]), axis=1, return_inverse=True)
            first = table.column("a").to_numpy().astype(np.int64)
            place = doc.ravel()[owner[order]] * (1 << 32) + first[owner[order]] + offset[order]
            many = (table.column("n").to_numpy() > 1)[owner[order]]
            heads = np.flatnonzero(np.concatenate([[True], run_of[1:] != run_of[:-1]]))
            repeat = (np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)) | np.logical_or.reduceat(many, heads)
            hit = order[repeat[run_of] & ~many]
        else:
            hit = order
        start = np.sort(hit)
        cut = np.flatnonzero(np.concatenate([[True], np.diff(start) > 1])) if len(start) else np.empty(0, np.int64)
        a, b = start[cut], np.append(start[cut[1:] - 1], start[-1:]) if len(start) else start
        own = pa.array(owner[a])
        base = table.column("a").to_numpy().astype(np.int64)[owner[a]] - begin[owner[a]]
        return pa.table([table.column("doc_id").take(own), table.column("th").take(own), pa.array((a + base).astype(np.int32)), pa.array((b + base + length).astype(np.int32))], names=["doc_id", "th", "a", "b"])

    return run


def windows_of(length: int):
    """For crowded anchors: (two hashes, place) of every string of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                if len(data) < length:
                    continue
                symbols = kernels.byte_symbols(np.frombuffer(data, np.uint8))
                h = [kernels.mix(kernels.Rolling(s).all_windows(length)) for s in (symbols, kernels.mix(symbols))]
                at = np.arange(len(data) - length + 1) + batch.column("a")[i].as_py()
                same = pa.array(np.full(len(at), i))
                yield pa.record_batch([pa.array(signed(h[0])), pa.array(signed(h[1])), *(batch.column(c).take(same) for c in ("doc_id", "th", "n")), pa.array(at.astype(np.int32))], names=["w1", "w2", "doc_id", "th", "n", "at"])

    return run


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t, spans in zip(texts(batch, 1), batch.column(2).to_pylist(), strict=True):
            if not spans:
                rows.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
                continue
            gone = kernels.covered(len(t), np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans]))
            edges = np.count_nonzero(np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1)
            left = np.frombuffer(t, np.uint8)[~gone].tobytes()
            rows.append((len(t), int(gone.sum()), int(edges), hashlib.sha256(left).hexdigest()))
        n, removed, spans, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """(doc_id, th, a, b): byte stretches that occur elsewhere too, possibly overlapping; th is a hash of the text."""
    small_batches(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), "text")
    again = bits.repeated(docs.select("text"), anchor_hashes(length, k))
    found = stored(keyed.mapInArrow(occurrences(length, k, again, False), WHERE + ", sides long"))
    # spot: the place of a context, as a hash; the smallest, so that any rerun picks the same.
    contexts = found.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min("spot").alias("spot"), F.min("sides").alias("sides"))
    anchored = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("places"), F.min("n").alias("least"))
    anchored = anchored.filter("places > 1")
    # One row per context; whole: seen twice or more. Others have partners to be told apart from.
    known = stored(contexts.join(anchored, "h").select("h", "c", "n", "spot", "sides", "kinds", "least"))
    whole = found.join(known.filter("n > 1").select("h", "c"), ["h", "c"]).select("doc_id", "th", "a", "b")

    unclear = known.filter("kinds > 1 AND least = 1").select("h", "c", "n", "spot", "kinds", F.shiftright("sides", 32).alias("left"), F.col("sides").bitwiseAND(F.lit(0xFFFFFFFF)).alias("right"))
    for side in ("left", "right"):
        shared = unclear.groupBy("h", side).agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("one")).filter("m > 1 AND one = 1").select("h", side, F.lit(True).alias(f"by_{side}"))
        unclear = unclear.join(shared, ["h", side], "left")
    unclear = unclear.filter("by_left OR by_right").select("h", "c", "n", "spot", "kinds", *(F.coalesce(f"by_{x}", F.lit(False)).alias(f"by_{x}") for x in ("left", "right")))
    unclear = stored(unclear)
    n_unclear = unclear.count()
    wanted = bits.bitmap(unclear, F.col("h").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("spot")), n_unclear)
    held = keyed.mapInArrow(occurrences(length, k, wanted, True), WHERE + ", at int, bytes binary").join(unclear, ["h", "c", "spot"])
    # Only strings with the shared half can have an equal.
    half = (length - k) // 2
    start = F.when(F.col("by_left"), F.col("a")).otherwise(F.greatest(F.col("a"), F.col("at") - half))
    end = F.when(F.col("by_right"), F.col("b")).otherwise(F.least(F.col("b"), F.col("at") + (length - half)))
    held = held.select("h", "c", "doc_id", "th", start.alias("a"), F.substr("bytes", start - F.col("a") + 1, end - start).alias("bytes"), "n", "kinds")
    held = stored(held)
    # A context seen twice is there as a partner, once: rows that agree in doc_id and text have the same place.
    first = held.filter("n > 1").groupBy("h", "c").agg(F.min(F.struct("doc_id", "th", "a", "bytes", "n", "kinds")).alias("x")).select("h", "c", "x.*")
    held = held.filter("n = 1").unionByName(first)
    buckets = max(1, -(-n_unclear // BUCKET))
    small = held.filter(F.col("kinds") <= MOST_CONTEXTS).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets))).select("bucket", "h", "doc_id", "th", "a", "n", "bytes")
    told = small.groupBy("bucket").applyInArrow(repeated_in_bucket(length), "doc_id long, th int, a int, b int")

    crowded = held.filter(F.col("kinds") > MOST_CONTEXTS).select("doc_id", "th", "a", "n", "bytes").mapInArrow(windows_of(length), "w1 long, w2 long, doc_id long, th int, n long, at int")
    spot = F.xxhash64("doc_id", "th", "at")
    twice = crowded.groupBy("w1", "w2").agg((F.min(spot) != F.max(spot)).alias("apart"), F.max("n").alias("most")).filter("apart OR most > 1").select("w1", "w2")
    rest = crowded.filter("n = 1").join(twice, ["w1", "w2"]).select("doc_id", "th", F.col("at").alias("a"), (F.col("at") + length).cast("int").alias("b"))
    return whole.unionByName(told).unionByName(rest)


def touched(keys):
    """(key, doc_id, text, th) of the documents whose key is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.holds(keys.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def untouched_digests(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~bits.holds(keys.value, batch.column(0).to_numpy().view(np.uint64))))
            yield from digest([pa.record_batch([rest.column(1), rest.column(2), pa.nulls(rest.num_rows)], names=["doc_id", "text", "spans"])])

    return run


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; only texts that may have spans are shuffled to meet them."""
    spans = stored(repeats(docs, length, k).groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    keys = bits.bitmap(spans, F.xxhash64("_d", "_h"), spans.count())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("th"))
    keyed = keyed.select(F.xxhash64("doc_id", "th").alias("key"), "doc_id", "text", "th")
    may = keyed.mapInArrow(touched(keys), "key long, doc_id long, text string, th int")
    met = may.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_h")), "left").select("doc_id", "text", "spans")
    return met.mapInArrow(digest, RESULT).unionByName(keyed.mapInArrow(untouched_digests(keys), RESULT))


def op2(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"))
