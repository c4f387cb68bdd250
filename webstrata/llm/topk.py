"""Exact top-k search by three-phase uniform threshold over lists of partial scores.

A vector's components are cut into ``PARTS`` parts, and each part is a column of its own: the list of a part holds the
share of the inner product that this part gives to every (query, vector) pair. Lists are read apart from each other, by
tasks over slices of the vectors. The phases:

1. gather: every slice of every list names its k largest shares per query; the vectors named are scored in full, and
   the k-th best of these scores is at most the query's true k-th best score;
2. cutoff: that score divided by the number of parts is sent to all tasks. A vector none of whose shares reaches it
   totals less, so it can't be among the k best; the others are collected, with the shares that reached it;
3. resolve: the collected vectors' missing shares, and only those, are computed and added; the k best by
   (score, smaller vec_id) are the result.

Scale: tasks follow the number of vectors. Queries are a stated set (vec_id divisible by ``every``) and go round in
blocks of ``QUERY_BYTES``, the only thing sent to all tasks, with one pass over the lists for each block; a block's
cutoffs, one number a query, are all that reaches the driver. What is shuffled is k entries a query and slice, and the
entries that reach the cutoff; fewer parts make that share smaller.

Defined results: vectors that are null, hold a null or a non-finite component take no part; shorter vectors count as
padded with zeros; a query's own id is no candidate (also in repeated rows), other repeated rows are candidates each, and
of several vectors under a query's id the smallest in array order asks; with fewer than k candidates all are returned;
ties go to the smaller vec_id; null ids take no part, as they can't be told apart; an empty table gives an empty result.
Scores are exact: components are whole numbers, added as float64 while sums stay below 2^52; pairs with a larger
component pass every cutoff and are added by whole-number arithmetic. Scores beyond a long count as the nearest long, and
components whose 256-fold is beyond a double as the largest double. Columns other than vec_id and embedding aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.session import stored

K = 5
EVERY = 50
SCALE = 256
PARTS = 2
#: Vectors of a slice, and bytes of queries sent to all tasks at once.
SLICE = 8192
QUERY_BYTES = 1 << 24
#: Queries multiplied with a batch at a time.
TILE = 256
HUGE = float(np.finfo(np.float64).max)
LONG = 2**63


def usable(vectors: DataFrame) -> DataFrame:
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("vec_id").isNotNull()
    return vectors.filter(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * scale), -HUGE, HUGE)


def quantised_column(v: Column, scale: int) -> Column:
    """The same for an array column. Doubles of 2^53 and more are whole."""
    y = lambda x: F.greatest(F.least(x * scale, F.lit(HUGE)), F.lit(-HUGE))
    return F.transform(v.cast("array<double>"), lambda x: F.when(F.abs(y(x)) < float(1 << 53), F.floor(F.when(F.abs(y(x)) < float(1 << 53), y(x))).cast("double")).otherwise(y(x)))


def matrix(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """A column of vectors as rows of quantised components, padded with zeros."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(column)), sizes), at] = quantised(values, scale)
    return out


class Block:
    """A block of queries: ids, components by part, and which are small enough for float64."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, parts: int) -> None:
        self.width = v.shape[1]
        self.most = np.floor(np.sqrt(2.0**52 / max(self.width, 1)))
        self.cuts = np.linspace(0, self.width, parts + 1).astype(int).tolist()
        self.ids, self.v = ids, v
        self.small = (np.abs(v) <= self.most).all(axis=1)

    def part(self, p: int) -> slice:
        return slice(self.cuts[p], self.cuts[p + 1])

    def tiles(self, p: int, ids: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, shares) of part p for all queries, -inf for a query's own id and where float64 may round."""
        small = (np.abs(v) <= self.most).all(axis=1)
        for q in range(0, len(self.ids), TILE):
            shares = np.where(self.small[q : q + TILE, None] & small, np.where(self.small[q : q + TILE, None], self.v[q : q + TILE, self.part(p)], 0) @ np.where(small[:, None], v, 0).T, -np.inf)
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            own = np.flatnonzero((self.ids[at] == ids) & (at >= q) & (at < q + TILE))
            shares[at[own] - q, own] = -np.inf
            yield q, shares


def local_lists(block, p: int, k: int, scale: int):
    """Phase 1: (query, place) of the k largest shares of every query in a slice of list p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        best, where = np.full((len(b.ids), k), -np.inf), np.zeros((len(b.ids), k), np.int64)
        for batch in batches:
            places = batch.column(0).to_numpy()
            for q, shares in b.tiles(p, batch.column(1).to_numpy(), matrix(batch.column(2), b.cuts[p + 1] - b.cuts[p], scale)):
                rows = slice(q, q + len(shares))
                both = np.concatenate([best[rows], shares], axis=1)
                top = np.argpartition(-both, k - 1, axis=1)[:, :k]
                at = np.concatenate([where[rows], np.broadcast_to(places, shares.shape)], axis=1)
                best[rows], where[rows] = np.take_along_axis(both, top, axis=1), np.take_along_axis(at, top, axis=1)
        q, j = np.nonzero(best > -np.inf)
        yield pa.record_batch([pa.array(q.astype(np.int32)), pa.array(where[q, j])], names=["q", "place"])

    return run


def entries(block, cutoff, p: int, parts: int, scale: int):
    """Phase 2: (query, place, bit of the part, share) of what reaches the cutoff in a slice of list p; no bit where float64 may round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, least = block.value, cutoff.value
        for batch in batches:
            places, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = matrix(batch.column(2), b.cuts[p + 1] - b.cuts[p], scale)
            for q, shares in b.tiles(p, ids, v):
                i, j = np.nonzero((shares * parts >= least[q : q + len(shares), None]) & (shares > -np.inf))
                yield pa.record_batch([pa.array((i + q).astype(np.int32)), pa.array(places[j]), pa.array(np.full(len(i), 1 << p, np.int32)), pa.array(shares[i, j].astype(np.int64))], names=["q", "place", "have", "share"])
                large = ~b.small[q : q + len(shares), None] | ~(np.abs(v) <= b.most).all(axis=1)
                i, j = np.nonzero(large & (b.ids[q : q + len(shares), None] != ids))
                yield pa.record_batch([pa.array((i + q).astype(np.int32)), pa.array(places[j]), pa.array(np.zeros(len(i), np.int32)), pa.array(np.zeros(len(i), np.int64))], names=["q", "place", "have", "share"])

    return run


def resolved(block, parts: int, scale: int):
    """Phase 3: (query, vec_id, score) of pairs with their known shares (``have``: bits of these parts), the missing ones added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = block.value
        for batch in batches:
            q, have, score = batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy().copy()
            v = np.concatenate([matrix(batch.column(4 + p), b.cuts[p + 1] - b.cuts[p], scale) for p in range(parts)], axis=1)
            exact = b.small[q] & (np.abs(v) <= b.most).all(axis=1)
            for p in range(parts):
                at = np.flatnonzero(exact & (have >> p & 1 == 0))
                score[at] += np.einsum("ij,ij->i", b.v[q[at], b.part(p)], v[at, b.part(p)]).astype(np.int64)
            for i in np.flatnonzero(~exact).tolist():
                score[i] = max(-LONG, min(LONG - 1, sum(int(x) * int(y) for x, y in zip(b.v[q[i]].tolist(), v[i].tolist(), strict=True))))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score)], names=["q", "vec_id", "score"])

    return run


def sliced(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """The usable vectors, one column a part, in slices; and the longest vector's length."""
    rows = usable(vectors)
    total, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    cuts = np.linspace(0, width, parts + 1).astype(int).tolist()
    columns = [F.slice("embedding", a + 1, b - a).alias(f"p{p}") for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = rows.repartition(max(1, -(-total // SLICE))).select(F.monotonically_increasing_id().alias("place"), "vec_id", *columns)
    return stored(rows), width


def query_blocks(rows: DataFrame, width: int, parts: int, every: int, scale: int) -> Iterator[Block]:
    """All queries in blocks of ``QUERY_BYTES`` or so, ascending ids in each."""
    v = quantised_column(F.concat(*(F.col(f"p{p}") for p in range(parts))), scale)
    asked = stored(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks = -(-asked.count() * 8 * max(width, 1) // QUERY_BYTES)
    for i in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).orderBy("vec_id").toArrow().combine_chunks()
        if held.num_rows:
            yield Block(held.column("vec_id").to_numpy(), matrix(held.column("v").combine_chunks(), width, 1), parts)


def collected(rows: DataFrame, block, parts: int, k: int, scale: int) -> DataFrame:
    """Phases 1 and 2 for one block: (q, place, have, known) of all pairs that can be among the k best."""
    lists = [rows.select("place", "vec_id", f"p{p}") for p in range(parts)]
    heads = lists[0].mapInArrow(local_lists(block, 0, k, scale), "q int, place long")
    for p in range(1, parts):
        heads = heads.unionByName(lists[p].mapInArrow(local_lists(block, p, k, scale), "q int, place long"))
    none = F.lit(0).cast("long")
    known = scored(rows, heads.distinct().select("q", "place", F.lit(0).alias("have"), none.alias("known")), block, parts, scale)
    # The k-th best per query and slice's row is at most the true one.
    kth = known.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("_n") == k).select("q", "score").toArrow()
    least = np.full(len(block.value.ids), -np.inf)
    least[kth.column("q").to_numpy()] = kth.column("score").to_numpy().astype(np.float64)
    cutoff = rows.sparkSession.sparkContext.broadcast(least)
    found = [x.mapInArrow(entries(block, cutoff, p, parts, scale), "q int, place long, have int, share long") for p, x in enumerate(lists)]
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return every.groupBy("q", "place").agg(F.bit_or("have").alias("have"), F.sum("share").alias("known"))


def scored(rows: DataFrame, pairs: DataFrame, block, parts: int, scale: int) -> DataFrame:
    met = pairs.join(rows, "place").select("q", "vec_id", "have", "known", *(f"p{p}" for p in range(parts)))
    return met.mapInArrow(resolved(block, parts, scale), "q int, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query against all other rows."""
    spark = vectors.sparkSession
    rows, width = sliced(vectors, parts)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for queries in query_blocks(rows, width, parts, every, scale):
        block = spark.sparkContext.broadcast(queries)
        ids = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(queries.ids), dtype=np.int32)), "query_id": pa.array(queries.ids)}))
        best = scored(rows, collected(rows, block, parts, k, scale), block, parts, scale)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id")).cast("int")).filter(F.col("rank") <= k)
        out = out.unionByName(stored(best.join(F.broadcast(ids), "q").select("query_id", "rank", "vec_id", "score")))
    return out


def op5(vectors: DataFrame) -> DataFrame:
    return top_k(vectors.select("vec_id", "embedding"))


def oracle() -> str:
    return f"""
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(x * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
