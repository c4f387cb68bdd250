"""Sharding by sampled splitters, in DataFrame operations only.

Documents are ordered by a key of two hashes, of the text and of the doc_id, so equal texts stand together but can be
cut apart. A size-weighted sample of the keys gives quantile boundaries, and records fall into the ranges between them;
as the key tells copies apart, a hot text is cut by the boundaries like any other stretch, and what comes out overfull on
large tables is subdivided by boundaries of its own. Sums of the ranges then place every record at its byte offset in
the global order, and shards are equal slices of that offset: the ``bytes`` law holds to within one document.

What the sample decides is how evenly work is dealt. It can't change the result: the order is that of the keys.

Scale: each record is shuffled once, as a few numbers without its text. Rows that agree in all of these are counted
before they are ordered, and written out again by the tasks that hold the counts. Ranges follow the number of rows, up to
``RANGES`` by ``RANGES``; their sums and boundaries are the only thing broadcast or ordered in one task.

Defined results: null text has size 8 and CRC 0; repeated rows are separate records; null doc_ids come first among equal
keys; an empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.session import materialise

SHARDS = 24
RANGES = 480
#: Rows of a range, about, once there are more than ``RANGES`` times as many.
RANGE_ROWS = 100_000
SAMPLES_PER_RANGE = 40
#: Parts in which the copies of one row are counted, each by a task of its own.
SALTS = 64


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below ``key``: a balanced tree of comparisons, compiled."""
    if not bounds:
        return F.lit(0)
    half = len(bounds) // 2
    return F.when(key < F.lit(bounds[half]), range_of(key, bounds[:half])).otherwise(range_of(key, bounds[half + 1 :]) + F.lit(half + 1))


def sampled(rows: DataFrame, total: int, ranges: int) -> DataFrame:
    """A size-weighted sample of keys, some ``SAMPLES_PER_RANGE`` a range. The draw hangs on doc_id and key alone, so reruns agree."""
    rate = float(ranges * SAMPLES_PER_RANGE) / max(total, 1)
    u = F.pmod(F.xxhash64("doc_id", "k", F.lit("draw")), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return rows.filter(u < F.col("size") * F.lit(rate))


def quantiles(ranges: int) -> Column:
    return F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and k: 40 bits of the text's hash, then 20 of the doc_id's."""
    number = lambda text, digits: F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftleft(number(text, 10), 20).bitwiseOR(number(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), 5)).alias("k"),
    )


def ranged(rows: DataFrame, n: int, total: int, ranges: int) -> DataFrame:
    """``rows`` with ``range`` and ``part``: where their keys fall between the sampled boundaries, and those inside a range."""
    sample = sampled(rows, total, ranges)
    rows = rows.withColumn("range", range_of(F.col("k"), sorted(set(sample.agg(quantiles(ranges)).first()[0] or []))))
    parts = min(RANGES, -(-n // (ranges * RANGE_ROWS)))
    if parts < 2:
        return rows.withColumn("part", F.lit(0))
    # One row per range, with up to RANGES boundaries.
    inner = sampled(rows, total, ranges * parts).groupBy(F.col("range").alias("_range")).agg(quantiles(parts).alias("_bounds"))
    rows = rows.join(F.broadcast(inner), F.col("range") == F.col("_range"), "left")
    return rows.withColumn("part", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("k"))), F.lit(0))).drop("_range", "_bounds")


def sharded(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of near equal bytes, each gapless from slot 0."""
    rows = materialise(keyed(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cell = ["range", "part"]
    same = ["k", "doc_id", "size", "text_crc32"]
    # Equal rows may change places, so which of them gets a salt doesn't matter.
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    held = materialise(ranged(rows, n, total, ranges).select(*cell, *same, salt).groupBy(*cell, *same, "salt").agg(F.count(F.lit(1)).alias("copies")))
    sums = held.groupBy(*cell).agg(F.sum(F.col("size") * F.col("copies")).alias("cell_size"), F.sum("copies").alias("cell_rows"))
    upto = W.orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = lambda c, over: F.coalesce(F.sum(c).over(over), zero)
    offsets = sums.select(F.col("range").alias("_range"), F.col("part").alias("_part"), before("cell_size", upto).alias("bytes_before"), before("cell_rows", upto).alias("rows_before"))
    inside = W.partitionBy(*cell).orderBy("k", F.col("doc_id").asc_nulls_first(), "size", "text_crc32", "salt").rowsBetween(W.unboundedPreceding, -1)
    placed = held.withColumn("run", before(F.col("size") * F.col("copies"), inside)).withColumn("nth", before("copies", inside))
    placed = placed.join(F.broadcast(offsets), (F.col("range") == F.col("_range")) & (F.col("part") == F.col("_part")))
    placed = placed.select("doc_id", "size", "text_crc32", (F.col("bytes_before") + F.col("run")).alias("bytes"), (F.col("rows_before") + F.col("nth")).alias("at"), F.explode(F.sequence(zero, F.col("copies") - 1)).alias("copy"))
    middle = 2 * (F.col("bytes") + F.col("copy") * F.col("size")) + F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle.cast("double") * shards / (2.0 * max(total, 1))))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("at") + F.col("copy")).alias("at")))
    # One row per shard.
    first = placed.groupBy("shard").agg(F.min("at").alias("first")).withColumnRenamed("shard", "_shard")
    return placed.join(F.broadcast(first), F.col("shard") == F.col("_shard")).select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))


def op8(docs: DataFrame) -> DataFrame:
    return sharded(docs.select("doc_id", "text")).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle() -> str:
    """The same order by plain windows; the CRC bit by bit."""
    return rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, CAST(strlen(t) + 8 AS BIGINT) AS size, (CAST('0x' || substr(md5(t), 1, 10) AS BIGINT) << 20) | CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 5) AS BIGINT) AS k,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(h, '..'), lambda b: [CAST('0x' || b AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS text_crc32 FROM d),
o AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS pos, sum(size) OVER () AS total FROM k WINDOW w AS (ORDER BY k, doc_id NULLS FIRST, size, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, CAST(least({SHARDS - 1}, floor(CAST(2 * upto - size AS DOUBLE) * {SHARDS} / (2.0 * total))) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(pos - min(pos) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
