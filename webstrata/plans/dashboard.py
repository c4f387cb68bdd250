"""Site dashboards: sections, depths, headline figures, ranks, differences between scans, folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.plans import graph
from webstrata.plans.catalog import query
from webstrata.plans.content import located
from webstrata.sources import corpus

P = corpus.pages_sql()
H = corpus.pages_sql(by_host=True)
LOC = "loc AS (SELECT *, CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE '(root)' END AS section, CAST(greatest(0, len(string_split(path, '/')) - 2) AS BIGINT) AS depth FROM page)"

#: Dated captures of one site, with the screenshots and pictures found beside the pages: (domain, date, path, bytes, modified ms, screenshot).
SCANS = [
    ("bank.example", "2026-06-01", "bank.example/index.html", 30, 1000, False),
    ("bank.example", "2026-06-01", "bank.example/loans/old.html", 70, 1001, False),
    ("bank.example", "2026-07-01", "bank.example/index.html", 512, 2000, True),
    ("bank.example", "2026-07-01", "bank.example/loans/personal.html", 400, 2001, False),
    ("bank.example", "2026-07-01", "bank.example/loans/mortgages/fixed.html", 60, 2002, False),
    ("bank.example", "2026-08-01", "bank.example/index.html", 500, 3000, True),
    ("bank.example", "2026-08-01", "bank.example/loans/personal.html", 400, 3001, True),
    ("shop.example", "2026-07-15", "shop.example/index.html", 90, 2500, False),
    ("shop.example", "2026-07-15", "shop.example/deals.html", 91, 2600, False),
]
FILES = [("bank.example", "2026-07-01", "bank.example/images/logo.png"), ("bank.example", "2026-07-01", "bank.example/loans/images/a.png"), ("bank.example", "2026-07-01", "bank.example/_assets/images/no.png"), ("shop.example", "2026-07-15", "shop.example/images/x.png")]
SCAN = f"scan AS (SELECT * FROM {corpus.values(SCANS)} t(domain, scan_date, path, size, mtime_ms, screenshot))".replace("True", "true").replace("False", "false")


def scans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCANS, "domain string, scan_date string, path string, size long, mtime_ms long, screenshot boolean")


def rounded(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


@query("sections", f"WITH {P}, {LOC} SELECT scan, section, CAST(count(*) AS BIGINT) AS pages, CAST(sum(size) AS BIGINT) AS size, CAST(floor(sum(size) / count(*) + 0.5) AS BIGINT) AS avg_size FROM loc GROUP BY ALL")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(corpus.pages(spark, sf_dir)).groupBy("scan", "section").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"), rounded(F.sum("size") / F.count(F.lit(1))).alias("avg_size"))


@query("section_share", f"WITH {P}, {LOC}, s AS (SELECT scan, section, count(*) AS pages FROM loc GROUP BY ALL) SELECT scan, section, CAST(floor(100.0 * pages / sum(pages) OVER (PARTITION BY scan) + 0.5) AS BIGINT) AS share FROM s")
def section_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = located(corpus.pages(spark, sf_dir))
    total = p.groupBy("scan").agg(F.count(F.lit(1)).alias("total"))
    return p.groupBy("scan", "section").agg(F.count(F.lit(1)).alias("pages")).join(total, "scan").select("scan", "section", rounded(100.0 * F.col("pages") / F.col("total")).alias("share"))


@query("depth_histogram", f"WITH {P}, {LOC} SELECT scan, depth, CAST(count(*) AS BIGINT) AS pages FROM loc GROUP BY ALL")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(corpus.pages(spark, sf_dir)).groupBy("scan", "depth").agg(F.count(F.lit(1)).alias("pages"))


@query("headline", f"WITH {P}, {LOC} SELECT scan, CAST(count(*) AS BIGINT) AS pages, CAST(sum(size) AS BIGINT) AS total_size, CAST(floor(sum(size) / count(*) + 0.5) AS BIGINT) AS avg_size, CAST(floor(median(size) + 0.5) AS BIGINT) AS median_size, max(depth) AS max_depth FROM loc GROUP BY scan")
def headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A10. The median is exact: its aggregate holds the distinct sizes of a scan, each once."""
    return located(corpus.pages(spark, sf_dir)).groupBy("scan").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("total_size"), rounded(F.sum("size") / F.count(F.lit(1))).alias("avg_size"), rounded(F.median("size")).alias("median_size"), F.max("depth").alias("max_depth"))


@query("scan_headline", f"WITH {SCAN}, f AS (SELECT domain, scan_date, count(*) FILTER (WHERE regexp_matches(path, '/images/[^/]+$') AND NOT regexp_matches(path, '/_assets/')) AS images FROM {corpus.values(FILES)} t(domain, scan_date, path) GROUP BY ALL) SELECT domain, scan_date, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE screenshot) AS BIGINT) AS screenshots, CAST(floor(100.0 * count(*) FILTER (WHERE screenshot) / count(*) + 0.5) AS BIGINT) AS screenshot_coverage, CAST(coalesce(any_value(f.images), 0) AS BIGINT) AS images FROM scan LEFT JOIN f USING (domain, scan_date) GROUP BY ALL")
def scan_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screenshots and pictures per dated scan; offline assets aside."""
    key = ["domain", "scan_date"]
    images = spark.createDataFrame(FILES, "domain string, scan_date string, path string").filter(F.col("path").rlike("/images/[^/]+$") & ~F.col("path").contains("/_assets/")).groupBy(*key).agg(F.count(F.lit(1)).alias("images"))
    out = scans(spark).groupBy(*key).agg(F.count(F.lit(1)).alias("pages"), F.count_if("screenshot").alias("screenshots"))
    return out.join(images, key, "left").select(*key, "pages", "screenshots", rounded(100.0 * F.col("screenshots") / F.col("pages")).alias("screenshot_coverage"), F.coalesce("images", F.lit(0).cast("long")).alias("images"))


@query("size_rank_percentile", f"WITH {H} SELECT scan, pid, size, CAST(rank() OVER (PARTITION BY scan ORDER BY size DESC) AS BIGINT) AS rank_by_size, CASE WHEN count(*) OVER (PARTITION BY scan) = 1 THEN 100 ELSE CAST(floor(100 * percent_rank() OVER (PARTITION BY scan ORDER BY size) + 0.5) AS BIGINT) END AS size_percentile FROM page")
def size_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2, W3 within a scan (one host's capture)."""
    return ranked(corpus.pages(spark, sf_dir, True)).select("scan", "pid", "size", "rank_by_size", "size_percentile")


def ranked(p: DataFrame) -> DataFrame:
    alone = F.count(F.lit(1)).over(W.partitionBy("scan")) == 1
    up = F.percent_rank().over(W.partitionBy("scan").orderBy("size"))
    return p.withColumn("rank_by_size", F.rank().over(W.partitionBy("scan").orderBy(F.desc("size"))).cast("long")).withColumn("size_percentile", F.when(alone, F.lit(100)).otherwise(rounded(100 * up)))


def rate(value: Column, best: Column) -> Column:
    """1 to 20 against the best."""
    return F.when(best <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(20), F.floor(value / best * 20 + 0.5)))).cast("long")


_R = "CAST(CASE WHEN {b} <= 0 THEN 1 ELSE greatest(1, least(20, floor(CAST({v} AS DOUBLE) / {b} * 20 + 0.5))) END AS BIGINT)"


@query(
    "page_attributes",
    f"WITH {graph.IN.replace(P, H)}, {LOC}, {graph.OUT}, o AS (SELECT scan, pid, count(*) AS n FROM outgoing GROUP BY ALL), w AS (SELECT l.*, k.inbound, coalesce(o.n, 0) AS outbound, max(l.size) OVER (PARTITION BY l.scan) AS ms, greatest(1, max(l.depth) OVER (PARTITION BY l.scan)) AS md FROM loc l JOIN linked k USING (scan, pid) LEFT JOIN o USING (scan, pid)) SELECT scan, pid, {_R.format(v='size', b='greatest(1, ms)')} AS size, {_R.format(v='inbound', b='10')} AS inbound_links, {_R.format(v='outbound', b='40')} AS outbound_links, {_R.format(v='(md - depth + 1)', b='(md + 1)')} AS prominence, inbound = 0 AS is_orphan FROM w",
)
def page_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings against the rest of the scan."""
    p = corpus.pages(spark, sf_dir, True)
    key = ["scan", "pid"]
    out = graph.outgoing(graph.X.links(p)).groupBy(*key).agg(F.count(F.lit(1)).alias("outbound"))
    inbound = graph.linked(spark, sf_dir, True).select(*key, "inbound")
    most = located(p).groupBy("scan").agg(F.greatest(F.lit(1), F.max("size")).alias("ms"), F.greatest(F.lit(1), F.max("depth")).alias("md"))
    w = located(p).join(inbound, key).join(out, key, "left").join(most, "scan").withColumn("outbound", F.coalesce("outbound", F.lit(0)))
    return w.select(*key, rate(F.col("size"), F.col("ms")).alias("size"), rate(F.col("inbound"), F.lit(10)).alias("inbound_links"), rate(F.col("outbound"), F.lit(40)).alias("outbound_links"), rate(F.col("md") - F.col("depth") + 1, F.col("md") + 1).alias("prominence"), (F.col("inbound") == 0).alias("is_orphan"))


def _extreme(name: str, direction: str) -> None:
    @query(name, f"WITH {P} SELECT scan, pid, path, size FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY size {direction}, pid) AS r FROM page) WHERE r <= 10")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        size = F.desc("size") if direction == "DESC" else F.asc("size")
        return corpus.pages(spark, sf_dir).select("scan", "pid", "path", "size").withColumn("_r", F.row_number().over(W.partitionBy("scan").orderBy(size, "pid"))).filter("_r <= 10").drop("_r")


_extreme("largest_pages", "DESC")
_extreme("smallest_pages", "ASC")

#: Two captures out of one table: the earlier one lacks every seventh page and has other sizes for every fifth.
NOW, THEN = "page_id % 7 <> 1", "page_id % 7 <> 0"
DIFF = f"now AS (SELECT page_id, url, strlen(html) AS size FROM pages WHERE {NOW}), was AS (SELECT page_id, url, strlen(html) + CASE WHEN page_id % 5 = 0 THEN 11 ELSE 0 END AS size FROM pages WHERE {THEN})"


@query("scan_diff", f"WITH {DIFF} SELECT coalesce(now.page_id, was.page_id) AS page_id, CASE WHEN was.page_id IS NULL THEN 'added' WHEN now.page_id IS NULL THEN 'removed' WHEN now.size <> was.size THEN 'changed' ELSE 'same' END AS state, CAST(now.size - was.size AS BIGINT) AS delta FROM now FULL OUTER JOIN was ON now.page_id = was.page_id")
def scan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full outer join tells added, removed and changed pages."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.octet_length("html").cast("long").alias("size"))
    now = p.filter(NOW).withColumnRenamed("size", "is")
    was = p.filter(THEN).select("page_id", (F.col("size") + F.when(F.col("page_id") % 5 == 0, 11).otherwise(0)).alias("was"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("is") != F.col("was"), "changed").otherwise("same")
    return now.join(was, "page_id", "full_outer").select("page_id", state.alias("state"), (F.col("is") - F.col("was")).alias("delta"))


@query("scan_comparison", f"WITH {SCAN}, d AS (SELECT DISTINCT domain, scan_date FROM scan), a AS (SELECT domain, scan_date, (SELECT max(scan_date) FROM d e WHERE e.domain = d.domain AND e.scan_date < d.scan_date) AS before FROM d), n AS (SELECT a.domain, a.scan_date, a.before, s.path, s.size FROM a JOIN scan s USING (domain, scan_date) WHERE before IS NOT NULL), o AS (SELECT a.domain, a.scan_date, a.before, s.path, s.size FROM a JOIN scan s ON s.domain = a.domain AND s.scan_date = a.before), j AS (SELECT coalesce(n.domain, o.domain) AS domain, coalesce(n.scan_date, o.scan_date) AS scan_date, coalesce(n.before, o.before) AS before, n.size AS ns, o.size AS os FROM n FULL OUTER JOIN o ON n.domain = o.domain AND n.scan_date = o.scan_date AND n.path = o.path) SELECT domain, scan_date, before, CAST(count(ns) - count(os) AS BIGINT) AS page_delta, CAST(coalesce(sum(ns), 0) - coalesce(sum(os), 0) AS BIGINT) AS size_delta, CAST(count(*) FILTER (WHERE os IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (WHERE ns IS NULL) AS BIGINT) AS removed, CAST(count(*) FILTER (WHERE ns <> os) AS BIGINT) AS changed FROM j GROUP BY ALL")
def scan_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan against the latest earlier one of its domain."""
    s = scans(spark)
    dates = s.select("domain", "scan_date").distinct().withColumn("before", F.lag("scan_date").over(W.partitionBy("domain").orderBy("scan_date"))).filter("before is not null")
    now = s.join(dates, ["domain", "scan_date"]).select("domain", "scan_date", "before", "path", F.col("size").alias("ns"))
    old = dates.join(s.select("domain", F.col("scan_date").alias("before"), "path", F.col("size").alias("os")), ["domain", "before"]).select("domain", "scan_date", "before", "path", "os")
    j = now.join(old, ["domain", "scan_date", "before", "path"], "full_outer")
    zero = F.lit(0).cast("long")
    return j.groupBy("domain", "scan_date", "before").agg((F.count("ns") - F.count("os")).alias("page_delta"), (F.coalesce(F.sum("ns"), zero) - F.coalesce(F.sum("os"), zero)).alias("size_delta"), F.count_if(F.col("os").isNull()).alias("added"), F.count_if(F.col("ns").isNull()).alias("removed"), F.count_if(F.col("ns") != F.col("os")).alias("changed"))


@query("page_history", f"WITH {SCAN} SELECT domain, path, scan_date, CAST(size AS BIGINT) AS size, CAST(size - lead(size) OVER (PARTITION BY domain, path ORDER BY scan_date DESC) AS BIGINT) AS delta FROM scan")
def page_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size against the next older capture of the page."""
    older = F.lead("size").over(W.partitionBy("domain", "path").orderBy(F.desc("scan_date")))
    return scans(spark).select("domain", "path", "scan_date", "size", (F.col("size") - older).alias("delta"))


@query("scan_listing", f"WITH {SCAN} SELECT domain, scan_date, CAST(count(*) AS BIGINT) AS pages FROM scan GROUP BY ALL")
def scan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark).groupBy("domain", "scan_date").agg(F.count(F.lit(1)).alias("pages")).orderBy(F.desc("scan_date"), "domain")


@query("latest_scan", f"WITH {SCAN} SELECT domain, max(scan_date) AS latest, CAST(count(DISTINCT scan_date) AS BIGINT) AS scans FROM scan GROUP BY ALL")
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark).groupBy("domain").agg(F.max("scan_date").alias("latest"), F.countDistinct("scan_date").alias("scans"))


@query("scan_token", f"WITH {SCAN} SELECT domain, scan_date, concat(count(*), ':', max(mtime_ms)) AS token FROM scan GROUP BY ALL")
def scan_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans(spark).groupBy("domain", "scan_date").agg(F.concat_ws(":", F.count(F.lit(1)), F.max("mtime_ms")).alias("token"))


@query("scan_tree_counts", f"WITH {P}, x AS (SELECT scan, string_split(path, '/') AS s FROM page), y AS (SELECT scan, s, unnest(range(1, len(s))) AS d FROM x) SELECT scan, array_to_string(s[1:d], '/') AS folder, CAST(d AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE d = len(s) - 1) AS BIGINT) AS own_pages FROM y GROUP BY ALL")
def scan_tree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below every folder, all levels at once; empty folders don't arise."""
    s = F.split("path", "/")
    y = corpus.pages(spark, sf_dir).select("scan", s.alias("s"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(s) - 1))).alias("d"))
    y = y.select("scan", F.array_join(F.slice("s", 1, F.col("d")), "/").alias("folder"), F.col("d").cast("long").alias("depth"), (F.col("d") == F.size("s") - 1).alias("own"))
    return y.groupBy("scan", "folder", "depth").agg(F.count(F.lit(1)).alias("pages"), F.count_if("own").alias("own_pages"))


@query("page_filter", f"WITH {P} SELECT scan, pid, path FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY path, pid) AS r FROM page WHERE contains(lower(path), 'loan') OR contains(lower(path), '/en/')) WHERE r <= 300")
def page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the filter box: substring of the path, any case, first 300."""
    low = F.lower("path")
    hit = corpus.pages(spark, sf_dir).filter(low.contains("loan") | low.contains("/en/"))
    return hit.withColumn("_r", F.row_number().over(W.partitionBy("scan").orderBy("path", "pid"))).filter("_r <= 300").select("scan", "pid", "path")

