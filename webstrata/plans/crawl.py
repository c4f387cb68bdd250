"""Crawl semantics over recorded links and fetches: scope, breadth-first search, sitemaps, outcomes, the job queue."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.plans.catalog import query
from webstrata.session import materialise, table
from webstrata.sources import corpus

SITE = "https://site.example"
LINKS = [(f"{SITE}/", f"{SITE}{p}") for p in ("/a", "/b", "/missing", "/a#fragment", "/logo.png", "/file.pdf", "/private/x")] + [(f"{SITE}/", "https://elsewhere.example/"), (f"{SITE}/a", f"{SITE}/c/"), (f"{SITE}/c", f"{SITE}/d"), (f"{SITE}/b", f"{SITE}/a?utm_source=b"), (f"{SITE}/d", f"{SITE}/e"), (f"{SITE}/private/x", f"{SITE}/y")]
EDGES = f"raw_edge AS (SELECT * FROM {corpus.values(LINKS)} t(src, dst))"
SCOPE = [("include", "help"), ("include", "/blog/"), ("exclude", "/help/archive"), ("exclude", "/branch-finder")]
SCOPED = ["/help", "/help/topics", "/help/archive/1", "/helpful", "/blog/post?x=1", "/blogroll", "/branch-finder", "/"]


def _under(path: str, prefixes: list[str]) -> str:
    clean = ["/" + p.strip().strip("/") for p in prefixes]
    return "(" + " or ".join(f"{path} = '{p}' or starts_with({path}, '{p}/')" for p in clean) + ")" if clean else "false"


def in_scope(D, url: str, include: list[str], exclude: list[str]) -> str:
    """below an included folder (all, if none is named) and below no excluded one; a bad URL is out."""
    path = f"case when {S.pathname(D, url)} = '' then '/' else {S.pathname(D, url)} end"
    inside = _under(f"({path})", include) if include else "true"
    sql = f"({D.like(url, S.URL_HOST)} and {inside} and not {_under(f'({path})', exclude)})"
    return sql.replace("starts_with(", "startswith(") if D.__name__ == "Spark" else sql


@query("crawl_scope", f"SELECT url, {in_scope(Duck, 'url', ['help', '/blog/'], ['/help/archive', '/branch-finder'])} AS in_scope FROM {corpus.values([(SITE + p,) for p in SCOPED] + [('not a url',)])} t(url)")
def crawl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.createDataFrame([(SITE + p,) for p in SCOPED] + [("not a url",)], "url string")
    pick = lambda kind: [p for k, p in SCOPE if k == kind]
    return urls.select("url", F.expr(in_scope(Spark, "url", pick("include"), pick("exclude"))).alias("in_scope"))


def uncrawlable(D, url: str) -> str:
    return f"({D.like(url, S.IMAGE_URL)} or {D.like(url, S.BINARY_URL)})"


URLS = [("https://x.example/a.PNG",), ("https://x.example/a.png.html",), ("https://x.example/p?img=1",), ("https://x.example/d.pdf?x=1",), ("https://x.example/d.pdfx",), ("https://x.example/f.woff2#a",)]


@query("uncrawlable_urls", f"WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM {corpus.values(URLS)} t(url)) SELECT url, {Duck.like('url', S.IMAGE_URL)} AS image, {Duck.like('url', S.BINARY_URL)} AS is_binary, {uncrawlable(Duck, 'url')} AS uncrawlable FROM u")
def uncrawlable_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "pages").select("url").union(spark.createDataFrame(URLS, "url string"))
    return u.select("url", F.expr(Spark.like("url", S.IMAGE_URL)).alias("image"), F.expr(Spark.like("url", S.BINARY_URL)).alias("is_binary"), F.expr(uncrawlable(Spark, "url")).alias("uncrawlable"))


IGNORED = ["/fr/", "utm_", "blog."]


@query("url_ignore_list", f"SELECT url FROM (SELECT trim(url) AS url FROM pages) WHERE url <> '' AND regexp_matches(url, '(?i)^https?://') AND NOT ({' OR '.join(f'''contains(url, '{i}')''' for i in IGNORED)})")
def url_ignore_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, SRC17: a URL list less what holds an ignored part."""
    ignored = F.exists(F.array(*(F.lit(i) for i in IGNORED)), lambda i: F.contains(F.col("url"), i))
    return table(spark, sf_dir, "pages").select(F.trim("url").alias("url")).filter((F.col("url") != "") & F.col("url").rlike("(?i)^https?://") & ~ignored)


def crawl(links: DataFrame, seeds: list[str], max_depth: int, scope: Column, max_pages: int | None = None) -> DataFrame:
    """(url, depth) in breadth-first order. Every round joins the frontier to the links and drops what is known.

    ``max_pages`` cuts by (depth, url), so that reruns agree. Rounds are bounded by ``max_depth``.
    """
    spark = links.sparkSession
    norm = F.expr(S.normal_url(Spark, "url"))
    edges = materialise(links.select(F.expr(S.normal_url(Spark, "src")).alias("src"), F.expr(S.normal_url(Spark, "dst")).alias("url")).filter(scope & ~F.expr(uncrawlable(Spark, "url"))).distinct())
    seen = materialise(spark.createDataFrame([(u,) for u in seeds], "url string").select(norm.alias("url"), F.lit(0).cast("long").alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        frontier = edges.join(frontier.select(F.col("url").alias("src")), "src").select("url").distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = materialise(frontier)
        if frontier.limit(1).count() == 0:
            break
        seen = materialise(seen.unionByName(frontier))
    if max_pages is not None:
        seen = seen.orderBy("depth", "url").limit(max_pages)
    return seen


BFS = f"""{EDGES}, hop AS (SELECT DISTINCT * FROM (SELECT {S.normal_url(Duck, 'src')} AS src, {S.normal_url(Duck, 'dst')} AS url FROM raw_edge) WHERE {S.host(Duck, 'url')} = 'site.example' AND {in_scope(Duck, 'url', [], ['/private'])} AND NOT {uncrawlable(Duck, 'url')}),
walk AS (SELECT '{SITE}/' AS url, 0 AS depth UNION ALL SELECT h.url, w.depth + 1 FROM walk w JOIN hop h ON h.src = w.url WHERE w.depth < 2), seen AS (SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY url)"""


def site_crawl(spark: SparkSession) -> DataFrame:
    scope = F.expr(f"{S.host(Spark, 'url')} = 'site.example' and {in_scope(Spark, 'url', [], ['/private'])}")
    return crawl(spark.createDataFrame(LINKS, "src string, dst string"), [f"{SITE}/"], 2, scope)


@query("crawl_bfs", f"WITH RECURSIVE {BFS} SELECT url, depth FROM seen")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_crawl(spark)


#: What was fetched: (url, status, content type, html); a null status is no answer.
FETCHED = [(f"{SITE}/", 200, "text/html; charset=utf-8", "<p>home"), (f"{SITE}/a", 200, "text/html", "<p>same"), (f"{SITE}/b", 200, "text/html", "<p>same"), (f"{SITE}/missing", 404, "text/html", ""), (f"{SITE}/data", 200, "application/json", "{}"), (f"{SITE}/slow", None, None, None)]
FETCH = f"fetched AS (SELECT * FROM {corpus.values(FETCHED)} t(url, status, content_type, html)), ord AS (SELECT *, row_number() OVER (ORDER BY url) AS n FROM fetched), res AS (SELECT url, CASE WHEN status IS NULL OR status >= 400 THEN 'broken' WHEN content_type IS NOT NULL AND NOT contains(lower(content_type), 'text/html') THEN 'skipped' WHEN row_number() OVER (PARTITION BY status >= 400 OR status IS NULL, content_type, sha1(html) ORDER BY url) > 1 THEN 'duplicate' ELSE 'saved' END AS outcome FROM fetched)"


def outcomes(spark: SparkSession) -> DataFrame:
    """What became of each fetch; the first page of a content is the original."""
    f = spark.createDataFrame(FETCHED, "url string, status int, content_type string, html string")
    broken = F.col("status").isNull() | (F.col("status") >= 400)
    other = F.col("content_type").isNotNull() & ~F.lower("content_type").contains("text/html")
    f = f.withColumn("state", F.when(broken, "broken").when(other, "skipped").otherwise("saved")).withColumn("sha", F.when(F.col("state") == "saved", F.sha1(F.col("html").cast("binary"))))
    first = f.filter("state = 'saved'").groupBy("sha").agg(F.min("url").alias("original"))
    f = f.join(first, "sha", "left")
    return f.select("url", F.when((F.col("state") == "saved") & (F.col("url") != F.col("original")), "duplicate").otherwise(F.col("state")).alias("outcome"))


@query("fetch_outcomes", f"WITH {FETCH} SELECT url, outcome FROM res")
def fetch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark)


@query("crawl_summary", f"WITH {FETCH} SELECT CAST(count(*) AS BIGINT) AS visited, CAST(count(*) FILTER (WHERE outcome = 'broken') AS BIGINT) AS broken, CAST(count(*) FILTER (WHERE outcome = 'duplicate') AS BIGINT) AS duplicates, CAST(count(*) FILTER (WHERE outcome IN ('saved', 'skipped')) AS BIGINT) AS saved FROM res")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that aren't HTML count as saved, as they are neither broken nor duplicates."""
    o = outcomes(spark)
    return o.agg(F.count(F.lit(1)).alias("visited"), F.count_if(F.col("outcome") == "broken").alias("broken"), F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), F.count_if(F.col("outcome").isin("saved", "skipped")).alias("saved"))


#: Sitemaps by URL: an index (which also names itself), a plain and a gzipped child, one of another kind.
_SET = "<?xml version=\"1.0\"?><urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">{}</urlset>"
SITEMAPS = [
    (f"{SITE}/map.xml", False, "<sitemapindex>" + "".join(f"<sitemap><loc>{SITE}/{m}</loc></sitemap>" for m in ("map.xml", "one.xml", "two.xml.gz", "feed.xml", "page.xml")) + "</sitemapindex>"),
    (f"{SITE}/one.xml", False, _SET.format(f"<url><loc>{SITE}/a</loc><lastmod>2026</lastmod></url><url><loc> {SITE}/b?x=1&amp;y=2 </loc></url>")),
    (f"{SITE}/two.xml.gz", True, _SET.format(f"<url><loc>{SITE}/b?x=1&amp;y=2</loc></url><url><loc>{SITE}/c</loc></url>")),
    (f"{SITE}/feed.xml", False, f"<?xml version=\"1.0\"?><!-- <urlset> --><rss><loc>{SITE}/never</loc></rss>"),
    (f"{SITE}/page.xml", False, "not a document"),
]


def map_kind(D) -> str:
    """SRC8: by the root element; anything but a URL set or an index is an error, and gives no URLs."""
    root = D.ext("xml", r"^\s*(?:<\?[^>]*\?>\s*)?(?:<!--[\s\S]*?-->\s*)*<(?:[A-Za-z0-9_]+:)?([A-Za-z0-9_]+)")
    return f"case when {root} in ('urlset', 'sitemapindex') then {root} else 'error' end"


def map_locations(D) -> str:
    return D.map(D.every("xml", "(?i)<loc>([^<]*)</loc>"), "l", "replace(trim(l), '&amp;', '&')")


def unpacked(maps: DataFrame) -> DataFrame:
    """(url, xml) of sitemap bodies, gunzipped by their magic number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "xml": [(gzip.decompress(x) if bytes(x[:2]) == b"\x1f\x8b" else bytes(x)).decode("utf-8", "replace") for x in b["body"]]})

    return maps.mapInPandas(run, "url string, xml string")


def sitemap_locations(maps: DataFrame, start: str, most: int = 50) -> DataFrame:
    """Distinct page URLs reachable from a sitemap; ``most`` sitemaps at most, each read once."""
    xml = materialise(unpacked(maps).withColumn("kind", F.expr(map_kind(Spark))).withColumn("loc", F.expr(map_locations(Spark))))
    seen = materialise(maps.sparkSession.createDataFrame([(start,)], "url string"))
    frontier = seen
    while frontier.limit(1).count():
        frontier = xml.filter("kind = 'sitemapindex'").join(frontier, "url", "left_semi").select(F.explode("loc").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = materialise(frontier)
        seen = materialise(seen.unionByName(frontier).orderBy("url").limit(most))
        frontier = frontier.join(seen, "url", "left_semi")
    return xml.filter("kind = 'urlset'").join(seen, "url", "left_semi").select(F.explode("loc").alias("url")).distinct()


MAPS = f"map AS (SELECT url, xml, {map_kind(Duck)} AS kind, {map_locations(Duck)} AS loc FROM {corpus.values([(u, x) for u, _, x in SITEMAPS])} t(url, xml))"


@query("sitemap_kinds", f"WITH {MAPS} SELECT url, kind, CAST(CASE WHEN kind = 'error' THEN 0 ELSE len(loc) END AS BIGINT) AS locations FROM map")
def sitemap_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: what every fetched sitemap is, and how many locations it names."""
    xml = unpacked(sitemap_bodies(spark)).withColumn("kind", F.expr(map_kind(Spark)))
    return xml.select("url", "kind", F.when(F.col("kind") == "error", 0).otherwise(F.size(F.expr(map_locations(Spark)))).cast("long").alias("locations"))


def sitemap_bodies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, bytearray(gzip.compress(x.encode()) if z else x.encode())) for u, z, x in SITEMAPS], "url string, body binary")


@query("sitemap_urls", f"WITH RECURSIVE {MAPS}, walk AS (SELECT '{SITE}/map.xml' AS url UNION SELECT unnest(m.loc) FROM walk w JOIN map m ON m.url = w.url WHERE m.kind = 'sitemapindex') SELECT DISTINCT unnest(m.loc) AS url FROM walk w JOIN map m ON m.url = w.url WHERE m.kind = 'urlset'")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap_locations(sitemap_bodies(spark), f"{SITE}/map.xml")


ROBOTS = [("a.example", "User-agent: *\nSITEMAP: https://a.example/one.xml\nsitemap: https://a.example/two.xml"), ("b.example", "User-agent: *"), ("c.example", None)]


@query("sitemap_discovery", f"WITH r AS (SELECT * FROM {corpus.values(ROBOTS)} t(host, txt)), s AS (SELECT host, regexp_extract_all(coalesce(txt, ''), '(?im)^sitemap:\\s*(\\S+)', 1) AS m FROM r) SELECT host, unnest(CASE WHEN len(m) > 0 THEN m ELSE ['https://' || host || '/sitemap.xml'] END) AS sitemap FROM s")
def sitemap_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC9: sitemaps named in robots.txt, else the usual place."""
    m = F.expr(r"regexp_extract_all(coalesce(txt, ''), r'(?im)^sitemap:\s*(\S+)', 1)")
    r = spark.createDataFrame(ROBOTS, "host string, txt string").withColumn("m", m)
    return r.select("host", F.explode(F.when(F.size("m") > 0, F.col("m")).otherwise(F.array(F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml"))))).alias("sitemap"))


#: Lifecycle of jobs: (job, sequence, kind, priority, status).
JOBS = [("j1", 1, "spider", False, "queued"), ("j2", 2, "batch", False, "queued"), ("j1", 3, "spider", False, "running"), ("j3", 4, "page", True, "queued"), ("j1", 5, "spider", False, "paused"), ("j3", 6, "page", True, "running"), ("j4", 7, "batch", False, "queued"), ("j5", 8, "page", True, "queued"), ("j3", 9, "page", True, "done"), ("j6", 10, "batch", False, "queued"), ("j6", 11, "batch", False, "cancelled"), ("j1", 12, "spider", False, "running")]
JOB = f"log AS (SELECT * FROM {corpus.values(JOBS)} t(job, seq, kind, priority, status)), job AS (SELECT job, arg_max(kind, seq) AS kind, bool_or(priority) AS priority, arg_max(status, seq) AS status, min(seq) AS queued_at FROM log GROUP BY job)".replace("False", "false").replace("True", "true")


def jobs(spark: SparkSession) -> DataFrame:
    """The state of every job, replayed from its events."""
    log = spark.createDataFrame(JOBS, "job string, seq long, kind string, priority boolean, status string")
    return log.groupBy("job").agg(F.max_by("kind", "seq").alias("kind"), F.bool_or("priority").alias("priority"), F.max_by("status", "seq").alias("status"), F.min("seq").alias("queued_at"))


@query("job_status", f"WITH {JOB} SELECT job, kind, status FROM job")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark).select("job", "kind", "status")


@query("queue_positions", f"WITH {JOB} SELECT job, CAST(row_number() OVER (ORDER BY priority DESC, queued_at) - 1 AS BIGINT) AS place FROM job WHERE status = 'queued'")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority jobs first, each kind in order of arrival."""
    return jobs(spark).filter("status = 'queued'").select("job", (F.row_number().over(W.orderBy(F.desc("priority"), "queued_at")) - 1).cast("long").alias("place"))


@query("queue_display", f"WITH {JOB}, r AS (SELECT *, CASE status WHEN 'running' THEN 0 WHEN 'queued' THEN 1 WHEN 'paused' THEN 2 ELSE 3 END AS band, CASE WHEN status IN ('done', 'failed', 'cancelled') THEN -queued_at ELSE queued_at - CASE WHEN priority THEN 1000 ELSE 0 END END AS o FROM job) SELECT job, status, CAST(row_number() OVER (ORDER BY band, o) AS BIGINT) AS place FROM r")
def queue_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running, then queued in turn, then paused, then finished, newest first."""
    band = F.when(F.col("status") == "running", 0).when(F.col("status") == "queued", 1).when(F.col("status") == "paused", 2).otherwise(3)
    over = F.col("status").isin("done", "failed", "cancelled")
    order = F.when(over, -F.col("queued_at")).otherwise(F.col("queued_at") - F.when(F.col("priority"), 1000).otherwise(0))
    return jobs(spark).select("job", "status", F.row_number().over(W.orderBy(band, order)).cast("long").alias("place"))
