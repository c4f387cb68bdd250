"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each document occurrence gets a virtual finish time: the words of its source up to and including it, in shuffled order,
divided by the source's target. Occurrences of all sources are then taken in order of finish time until the budget (all
sizes together) is used up. A source whose target is above its size comes round again, ``cap`` times at most.

Scale: running sums are two-level (sums of hash ranges, then within a range), so no source, however hot, meets in one
task; the global order is cut by the sums of steps of finish time, and the step in which the budget ends is cut again
until few rows are left to order one by one. What reaches the driver is ``STEPS`` sums at a time.

Defined results: null text has size 0; a document of size 0 is taken 0 words; null sources form one source, last in
order; repeated rows are separate documents; the shuffle goes by doc_id, or by the text where that is null; ties in it
fall to doc_id, then size; an empty table gives an empty result. Input columns other than doc_id, text and source are not read by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
HASH_RANGES_HEX = 3
#: Steps that a stretch of finish times is cut into, and the rows below which it is ordered as it is.
STEPS = 4096
FEW = 50_000
#: Sources whose last places go to every task.
SOURCES = 100_000


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """``source, source_size`` -> with ``target``: shares by weight, none above ``cap`` times its source's size.

    The level at which reshared excess comes to rest is found in closed form: in order of cap / weight, a source is
    full if the level over the weights still open would lift it above its cap. One row per source passes here.
    """
    ranked = sources.withColumn("_rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("_rn") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    by_level = W.orderBy(F.col("_cap") / F.col("_w"), "_rn")
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(by_level.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_open"))
        .withColumn("_order", F.row_number().over(by_level))
    )
    free = F.col("_cap") / F.col("_w") > F.col("_level")
    ranked = ranked.withColumn("_rest", F.min_by(F.when(free, F.col("_level")), F.when(free, F.col("_order"))).over(everything))
    return ranked.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_rest") * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def finish_times(cap: int) -> Column:
    """One entry per round of the source: (finish time, round)."""
    return F.array(*(F.struct(((F.col("cum") + F.lit(e) * F.col("source_size")) / F.col("target")).alias("at"), F.lit(e).alias("round")) for e in range(cap)))


def shuffle_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, rounds (times the document is taken), source, u (its shuffle key), and the ``extra`` columns."""
    rows = docs.select("doc_id", "source", *extra, F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), shuffle_key(seed).alias("u"))
    rows = materialise(rows.withColumn("size", F.coalesce("size", F.lit(0).cast("long"))).withColumn("part", F.substring("u", 1, HASH_RANGES_HEX)))
    key = ["source", "part"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("part_size"))
    # Same partitioning for both levels of the sum; one row per source and range.
    sums = sums.withColumn("before", F.coalesce(F.sum("part_size").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    offsets = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("_source"), F.col("s.part").alias("_part"), "before", "source_size", "target")
    within = W.partitionBy(*key).orderBy("u", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("run", F.sum("size").over(within))
    queue = summed.join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("part") == F.col("_part")))
    queue = queue.withColumn("cum", F.col("before") + F.col("run")).drop("_source", "_part", "before", "run", "part")
    queue = materialise(queue)

    end = cutoff(queue, cap)
    last = F.struct(*(F.lit(v).alias(n) for n, v in zip(("at", "u", "doc_id", "round"), end, strict=True))) if end else None
    order = lambda x: F.struct(x["at"].alias("at"), F.col("u").alias("u"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), x["round"].alias("round"))
    rounds = F.size(F.filter(finish_times(cap), lambda x: x["at"].isNotNull() & (order(x) <= last))) if end else F.lit(0)
    live = (F.col("size") > 0) & (F.col("target") > 0)
    queue = queue.withColumn("rounds", F.when(live, rounds).otherwise(F.lit(0)))
    return queue.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("rounds")).alias("taken"), "rounds", "source", "u", *extra)


def cutoff(queue: DataFrame, cap: int) -> tuple | None:
    """Key of the last occurrence the budget admits, in order of (finish time, shuffle key, doc_id, round)."""
    occurrences = queue.filter("size > 0 AND target > 0").select("size", "u", F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"), F.explode(finish_times(cap)).alias("f"))
    occurrences = occurrences.select("size", "u", "doc_id", "f.at", "f.round")
    key = F.struct("at", "u", "doc_id", "round")
    budget = queue.agg(F.sum("size")).first()[0] or 0
    inside, before = occurrences, 0
    while True:
        low, high, n = inside.agg(F.min("at"), F.max("at"), F.count(F.lit(1))).first()
        if not n or n <= FEW or low == high:
            break
        step = F.least(F.floor((F.col("at") - F.lit(low)) / F.lit((high - low) / STEPS)), F.lit(STEPS - 1))
        sums = inside.groupBy(step.alias("step")).agg(F.sum("size").alias("step_size"), F.max(key).alias("last")).orderBy("step").collect()
        fits, full = None, None
        for r in sums:
            if before + r["step_size"] > budget:
                full = r["step"]
                break
            before, fits = before + r["step_size"], r["last"]
        if full is None:
            return tuple(fits)
        inside = inside.filter(step == full)
    # Few rows, or ties, of which each source has one a round.
    ranked = inside.withColumn("run", F.sum("size").over(W.orderBy("at", "u", "doc_id", "round").rowsBetween(W.unboundedPreceding, 0)))
    best = ranked.filter(F.col("run") + F.lit(before) <= F.lit(budget)).agg(F.max(key).alias("m")).first()["m"]
    if best is None and low is not None:
        best = occurrences.filter(F.col("at") < F.lit(low)).agg(F.max(key).alias("m")).first()["m"]
    return tuple(best) if best is not None else None


def op9(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def repeat_taken(docs: DataFrame) -> DataFrame:
    """The mix itself: every taken document, as often as it is taken, with the input's columns.

    The plan is made over numbers alone. In each round a source is taken up to some place in its shuffled order, so the
    last places, one a source and round, tell of every row by itself how often it is taken, and no text is shuffled.
    Where rows share a place and only some are taken (one doc_id, or none and one text), or sources are more than
    ``SOURCES``, the plan is joined back by doc_id and a hash of the row. There identical rows share one entry: together
    they are repeated as often as the plan takes them all.
    """
    cap = 3
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))
    plan = mixed(docs.select("doc_id", "text", "source", row_hash.alias("_rh")), cap=cap, extra=("_rh",))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    place = lambda u: F.struct(u.alias("u"), F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"))
    at = place(F.col("u"))
    last = plan.filter("rounds > 0").groupBy(F.col("source").alias("_source")).agg(*(F.max(F.when(F.col("rounds") > e, at)).alias(f"_last{e}") for e in range(cap)))
    last = materialise(last)
    torn = plan.filter("size > 0").groupBy("source", at.alias("_at")).agg(F.min("rounds").alias("lo"), F.max("rounds").alias("hi")).filter("lo < hi")
    if last.count() <= SOURCES and torn.limit(1).count() == 0:
        rows = docs.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(row, F.col("source").alias("_s"), place(shuffle_key(SEED)).alias("_at"))
        rows = rows.join(F.broadcast(last), F.col("_s").eqNullSafe(F.col("_source")))
        rounds = sum((F.coalesce(F.col("_at") <= F.col(f"_last{e}"), F.lit(False)).cast("int") for e in range(cap)), F.lit(0))
        return rows.select("_row", rounds.alias("_rounds")).filter("_rounds > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_rounds")))).select("_row.*")
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("_rh").alias("_h")).agg(F.sum("rounds").alias("_rounds"), F.count(F.lit(1)).alias("_same")).filter("_rounds > 0")
    held = docs.select(F.col("doc_id").alias("_doc"), row_hash.alias("_rh"), row).join(plan, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_rh") == F.col("_h")))
    once = held.filter("_same = 1").unionByName(held.filter("_same > 1").dropDuplicates(["_doc", "_rh"]))
    return once.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rounds")))).select("_row.*")


def oracle() -> str:
    return rf"""
WITH r AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
k AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, row_number() OVER (ORDER BY source NULLS LAST) AS rn, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev, row_number() OVER (ORDER BY cap / w, rn) AS o FROM k),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT lev FROM l WHERE cap / w > lev ORDER BY o LIMIT 1) * w, cap)) AS target FROM l),
q AS (SELECT r.doc_id, r.u, r.size, t.source_size, t.target, sum(r.size) OVER (PARTITION BY r.source ORDER BY r.u, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
x AS (SELECT doc_id, u, size, e, CAST(cum + e * source_size AS DOUBLE) / target AS fin FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0),
y AS (SELECT *, sum(size) OVER (ORDER BY fin, u, doc_id, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM x),
z AS (SELECT doc_id, u, count(*) AS n FROM y WHERE total <= (SELECT sum(size) FROM r) GROUP BY doc_id, u)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(q.size * coalesce(z.n, 0) AS BIGINT) AS taken FROM q LEFT JOIN z ON q.u = z.u AND q.doc_id IS NOT DISTINCT FROM z.doc_id
"""
