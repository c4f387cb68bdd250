"""Ratings of findings, versions 2 and 3: pillar costs, weighted score, grade, points attributed to each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.plans import findings
from webstrata.plans.catalog import query
from webstrata.sources import corpus

# Pillars (name, weight) in order, severity bases, confidence factors.
PILLARS = {
    2: [("facts", 0.35), ("metadata", 0.25), ("structured-data", 0.25), ("terminology", 0.15)],
    3: [("access", 0.15), ("facts", 0.30), ("metadata", 0.15), ("structured-data", 0.15), ("terminology", 0.10), ("extractability", 0.15)],
}
SEVERITY = {"high": 45, "medium": 22, "low": 8}
CONFIDENCE = {"confirmed": 1.0, "strong": 0.7, "weak": 0.4}

#: (scan, ord, id, category, severity, confidence, pages affected, pages in all)
FOUND = [
    ("half.example", 0, "contradictory-emails", "facts", "high", "strong", 5, 10),
    ("half.big.example", 0, "contradictory-emails", "facts", "high", "strong", 1500, 3000),
    *(("worst.example", i, f"facts-{i:02d}", "facts", "high", None, 50, 50) for i in range(12)),
    ("mixed.example", 0, "a", "facts", "medium", "weak", 3, 7),
    ("mixed.example", 1, "b", "facts", "low", "strong", 0, 7),
    ("mixed.example", 2, "c", "nobody-knows", "high", None, 1, 7),
    ("mixed.example", 3, "d", "terminology", "low", "weak", 7, 7),
    ("mixed.example", 4, "e", "access", "low", "confirmed", 999999, 7),
    ("mixed.example", 5, "f", "extractability", "medium", "strong", 2, 7),
    ("empty.example", 0, "g", "metadata", "low", "confirmed", 1, 0),
]


def found(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOUND, "scan string, ord long, id string, category string, severity string, confidence string, pages_affected long, total_pages long")


def _case(column: str, table: dict, default: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table.items()) + f" else {default} end"


def _cost(version: int) -> str:
    base = f"cast({_case('severity', SEVERITY, '0')} as double)"
    share = "cast(greatest(pages_affected, 1) as double)"
    if version == 2:
        return f"{base} * case when total_pages = 0 then 1.0e0 else greatest(0.25e0, sqrt(least(1.0e0, {share} / total_pages))) end"
    saturation = "least(cast(total_pages as double), greatest(5.0e0, 0.1e0 * total_pages))"
    reach = f"case when total_pages = 0 then 1.0e0 else 0.35e0 + 0.65e0 * least(1.0e0, {share} / {saturation}) end"
    return f"{base} * {reach} * cast({_case('confidence', CONFIDENCE, '1.0')} as double)"


def _pillar(version: int) -> str:
    return f"case when category in ({', '.join(repr(p) for p, _ in PILLARS[version])}) then category else 'metadata' end"


_GRADE = "case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end"


def pillars(rows: DataFrame, version: int) -> DataFrame:
    """Every pillar of every scan, touched or not: raw cost, score, lost points. Sums are rounded before use, so their order doesn't matter."""
    costs = rows.select("scan", F.expr(_pillar(version)).alias("pillar"), F.expr(_cost(version)).alias("cost"))
    raw = costs.groupBy("scan", "pillar").agg(F.round(F.sum("cost"), 6).alias("raw"), F.count(F.lit(1)).alias("findings"))
    frame = F.explode(F.array(*(F.struct(F.lit(p).alias("pillar"), F.lit(w).alias("weight"), F.lit(i).alias("place")) for i, (p, w) in enumerate(PILLARS[version]))))
    all_ = rows.select("scan").distinct().select("scan", frame.alias("p")).select("scan", "p.*")
    out = all_.join(raw, ["scan", "pillar"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))).withColumn("findings", F.coalesce("findings", F.lit(0).cast("long")))
    out = out.withColumn("score", F.floor(100 - F.least(F.lit(100.0), "raw") + 0.5))
    return out.withColumn("lost", 100 - F.col("score"))


def rating(rows: DataFrame, version: int) -> DataFrame:
    """Weighted score, grade, and the pillar that costs most (ties: the earlier one)."""
    p = pillars(rows, version)
    points = F.col("lost") * F.col("weight")
    worst = F.max_by(F.struct("pillar", points.alias("points")), F.when(F.col("lost") > 0, F.struct(F.round(points, 6).alias("v"), (-F.col("place")).alias("o"))))
    out = p.groupBy("scan").agg(F.floor(F.round(F.sum(F.col("score") * F.col("weight")), 6) + 0.5).alias("score"), worst.alias("w"))
    return out.select("scan", "score", F.expr(_GRADE).alias("grade"), F.col("w.pillar").alias("worst_pillar"), F.coalesce(F.floor(F.col("w.points") + 0.5), F.lit(0).cast("long")).alias("worst_points"))


def attribution(rows: DataFrame, version: int) -> DataFrame:
    """A pillar's lost points dealt to its findings in tenths; the last one takes what rounding left."""
    costs = rows.select("scan", "ord", "id", F.expr(_pillar(version)).alias("pillar"), F.expr(_cost(version)).alias("cost"))
    p = pillars(rows, version).select("scan", "pillar", "raw", "lost")
    share = F.floor(F.round(F.col("cost") / F.when(F.col("raw") == 0, F.lit(1.0)).otherwise(F.col("raw")) * F.col("lost") * 10, 6) + 0.5) / 10
    order = W.partitionBy("scan", "pillar").orderBy("ord")
    met = costs.join(p, ["scan", "pillar"]).withColumn("share", share)
    before = F.coalesce(F.sum("share").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.floor(F.round((F.col("lost") - before) * 10, 6) + 0.5) / 10
    points = F.when(F.lead("ord").over(order).isNull(), rest).otherwise(F.col("share"))
    return met.select("scan", "ord", "id", "pillar", F.round(F.greatest(F.lit(0.0), points), 1).alias("points"))


def _ctes(source: str, version: int) -> str:
    frame = ", ".join(f"('{p}', CAST({w} AS DOUBLE), {i})" for i, (p, w) in enumerate(PILLARS[version]))
    return f"""cost AS (SELECT scan, ord, id, {_pillar(version)} AS pillar, {_cost(version)} AS cost FROM {source}),
pil AS (SELECT *, 100 - score AS lost FROM (SELECT s.scan, f.pillar, f.weight, f.place, coalesce(r.raw, 0.0) AS raw, coalesce(r.n, 0) AS findings, CAST(floor(100 - least(100.0, coalesce(r.raw, 0.0)) + 0.5) AS BIGINT) AS score FROM (SELECT DISTINCT scan FROM {source}) s CROSS JOIN (VALUES {frame}) f(pillar, weight, place) LEFT JOIN (SELECT scan, pillar, round(sum(cost), 6) AS raw, count(*) AS n FROM cost GROUP BY ALL) r ON r.scan = s.scan AND r.pillar = f.pillar))"""


def _rating_sql(version: int, prefix: str, source: str) -> str:
    return f"""WITH {prefix}, {_ctes(source, version)}, sc AS (SELECT scan, CAST(floor(round(sum(score * weight), 6) + 0.5) AS BIGINT) AS score FROM pil GROUP BY scan), wo AS (SELECT scan, pillar, lost * weight AS points, row_number() OVER (PARTITION BY scan ORDER BY round(lost * weight, 6) DESC, place) AS r FROM pil WHERE lost > 0)
SELECT sc.scan, sc.score, {_GRADE} AS grade, wo.pillar AS worst_pillar, CAST(coalesce(floor(wo.points + 0.5), 0) AS BIGINT) AS worst_points FROM sc LEFT JOIN wo ON wo.scan = sc.scan AND wo.r = 1"""


FIXTURE = f"fnd AS (SELECT * FROM {corpus.values(FOUND)} t(scan, ord, id, category, severity, confidence, pages_affected, total_pages))"


def _rated(version: int) -> None:
    @query(f"rating_v{version}", _rating_sql(version, FIXTURE, "fnd"))
    def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rating(found(spark), version)

    pts = "CASE WHEN lead(ord) OVER w IS NULL THEN floor(round((lost - coalesce(sum(share) OVER (PARTITION BY scan, pillar ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * 10, 6) + 0.5) / 10 ELSE share END"

    @query(f"rating_attribution_v{version}", f"WITH {FIXTURE}, {_ctes('fnd', version)}, sh AS (SELECT c.*, p.lost, floor(round(c.cost / CASE WHEN p.raw = 0 THEN 1 ELSE p.raw END * p.lost * 10, 6) + 0.5) / 10 AS share FROM cost c JOIN pil p USING (scan, pillar)) SELECT scan, CAST(ord AS BIGINT) AS ord, id, pillar, round(greatest(0.0, {pts}), 1) AS points FROM sh WINDOW w AS (PARTITION BY scan, pillar ORDER BY ord)")
    def attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
        return attribution(found(spark), version)


_rated(2)
_rated(3)


@query("site_rating", _rating_sql(3, findings.SQL.removeprefix("WITH "), "finding"))
def site_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: pages to findings to a rating per scan."""
    return rating(findings.materialise(findings.site_report(spark, sf_dir)), 3)
