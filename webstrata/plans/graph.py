"""The link graph: kinds, edges, in-degree, orphans, outgoing and incoming lists, discoverability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import extract as X
from webstrata.plans.catalog import query
from webstrata.session import table
from webstrata.sources import corpus

P = corpus.pages_sql()
L = f"{P}, {X.links_sql()}"

#: Crawl artifacts of the made-up sites: links found broken, and who linked where by the crawler's own count.
BROKEN = [("bank.example", "https://bank.example/dead"), ("bank.example", "https://bank.example/gone"), ("bank.example", "https://bank.example/missing-page")]
CRAWLED = [("bank.example", "https://bank.example/loans/personal", "https://bank.example/"), ("bank.example", "https://bank.example/loans/personal", "https://bank.example/never-saved"), ("loans.example", "https://loans.example/offers/", "https://loans.example/unsaved"), ("trio.example", "https://trio.example/a", "https://trio.example/x"), ("trio.example", "https://trio.example/a/", "https://trio.example/y")]
A = f"broken AS (SELECT * FROM {corpus.values(BROKEN)} t(scan, url)), crawled AS (SELECT * FROM {corpus.values(CRAWLED)} t(scan, target_url, source_url))"


def artifacts(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(BROKEN, "scan string, url string"), spark.createDataFrame(CRAWLED, "scan string, target_url string, source_url string")


@query("link_list", f"WITH {L} SELECT scan, pid, pos, tag, href, text, kind, nofollow, ugc, sponsored FROM link")
def link_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(corpus.pages(spark, sf_dir)).select("scan", "pid", "pos", "tag", "href", "text", "kind", "nofollow", "ugc", "sponsored")


@query("href_kind_counts", f"WITH {L} SELECT scan, kind, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT href) AS BIGINT) AS hrefs FROM link GROUP BY ALL")
def href_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(corpus.pages(spark, sf_dir)).groupBy("scan", "kind").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("hrefs"))


@query("link_counters", f"WITH {L} SELECT scan, pid, CAST(count(*) AS BIGINT) AS links, CAST(count(*) FILTER (WHERE nofollow) AS BIGINT) AS nofollow, CAST(count(*) FILTER (WHERE ugc) AS BIGINT) AS ugc, CAST(count(*) FILTER (WHERE sponsored) AS BIGINT) AS sponsored, CAST(count(*) FILTER (WHERE kind <> 'page') AS BIGINT) AS other FROM link GROUP BY ALL")
def link_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(corpus.pages(spark, sf_dir)).groupBy("scan", "pid").agg(F.count(F.lit(1)).alias("links"), F.count_if("nofollow").alias("nofollow"), F.count_if("ugc").alias("ugc"), F.count_if("sponsored").alias("sponsored"), F.count_if(F.col("kind") != "page").alias("other"))


def absolute(D) -> str:
    """Links of captured pages made absolute against their page; fragments become the page's."""
    origin = D.ext("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)")
    bare = D.ext("url", r"^([^#]*)")
    return f"case when {D.like('href', '(?i)^[a-z][a-z0-9+.-]*:')} then href when {D.like('href', '^/')} then concat({origin}, href) when {D.like('href', '^#')} then concat({bare}, href) else concat({origin}, '/', href) end"


@query("links_absolute", f"WITH {L} SELECT scan, pid, pos, {absolute(Duck)} AS target FROM link")
def links_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.links(corpus.pages(spark, sf_dir)).select("scan", "pid", "pos", F.expr(absolute(Spark)).alias("target"))


@query("anchor_text_top", f"WITH {L}, t AS (SELECT scan, lower(text) AS label, count(*) AS n FROM link WHERE text <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY n DESC, label) AS rank FROM t) SELECT scan, label, CAST(n AS BIGINT) AS links FROM r WHERE rank <= 20")
def anchor_text_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.links(corpus.pages(spark, sf_dir)).filter("text <> ''").groupBy("scan", F.lower("text").alias("label")).agg(F.count(F.lit(1)).alias("links"))
    return t.withColumn("_r", F.row_number().over(W.partitionBy("scan").orderBy(F.desc("links"), "label"))).filter("_r <= 20").drop("_r")


def edges(pages: DataFrame) -> DataFrame:
    """A1: one row per (source page, target path): occurrences, first five texts, nofollow only if all are.

    Anchor texts are reduced to their first place before they are gathered, so a row holds five at most.
    """
    target = S.page_path(Spark, Spark.rep("href", "#.*$", ""))
    e = X.links(pages).filter("kind = 'page'").withColumn("target", F.expr(target)).filter("target is not null and target <> path")
    key = ["scan", "path", "target"]
    # One row per text first, then one per edge: the pages are cut once.
    by_text = e.groupBy(*key, "text").agg(F.count(F.lit(1)).alias("n"), F.bool_and("nofollow").alias("nofollow"), F.min("url").alias("url"), F.min(F.struct("pid", "pos")).alias("at"))
    by_text = by_text.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.col("text") == "", "at")))
    five = F.collect_list(F.when((F.col("_n") <= 5) & (F.col("text") != ""), F.struct("_n", "text")))
    return by_text.groupBy(*key).agg(F.sum("n").alias("occurrences"), F.bool_and("nofollow").alias("nofollow"), F.min("url").alias("source_url"), F.transform(F.array_sort(five), lambda x: x["text"]).alias("texts"))


E = f"""{L}, hop AS (SELECT *, {S.page_path(Duck, Duck.rep('href', '#.*$', ''))} AS target FROM link WHERE kind = 'page'),
edge AS (SELECT b.*, coalesce(t.texts, []) AS texts FROM (SELECT scan, path, target, CAST(count(*) AS BIGINT) AS occurrences, bool_and(nofollow) AS nofollow, min(url) AS source_url FROM hop WHERE target IS NOT NULL AND target <> path GROUP BY ALL) b
LEFT JOIN (SELECT scan, path, target, list(text ORDER BY n) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY scan, path, target ORDER BY pid, pos) AS n FROM (SELECT scan, path, target, text, pid, pos, row_number() OVER (PARTITION BY scan, path, target, text ORDER BY pid, pos) AS f FROM hop WHERE text <> '' AND target IS NOT NULL AND target <> path) WHERE f = 1) WHERE n <= 5 GROUP BY ALL) t USING (scan, path, target))"""


@query("inbound_edges", f"WITH {E} SELECT scan, path AS source, target, occurrences, nofollow, array_to_string(texts, '|') AS texts FROM edge")
def inbound_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(corpus.pages(spark, sf_dir)).select("scan", F.col("path").alias("source"), "target", "occurrences", "nofollow", F.array_join("texts", "|").alias("texts"))


def inbound_counts(pages: DataFrame, crawled: DataFrame) -> DataFrame:
    """A2 with J10: sources per target, topped up by the crawl's own counts for targets no saved page links to."""
    seen = edges(pages).groupBy("scan", "target").agg(F.count(F.lit(1)).alias("inbound"))
    extra = crawled.withColumn("target", F.expr(S.page_path(Spark, "target_url"))).join(seen, ["scan", "target"], "left_anti").groupBy("scan", "target").agg(F.count(F.lit(1)).alias("inbound"))
    return seen.unionByName(extra)


IN = f"{E}, {A}, seen AS (SELECT scan, target, count(*) AS inbound FROM edge GROUP BY ALL), inbound AS (SELECT * FROM seen UNION ALL SELECT scan, target, count(*) FROM (SELECT scan, {S.page_path(Duck, 'target_url')} AS target FROM crawled) c WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.scan = c.scan AND s.target = c.target) GROUP BY ALL), linked AS (SELECT p.scan, p.pid, p.path, p.size, CAST(coalesce(i.inbound, 0) AS BIGINT) AS inbound FROM page p LEFT JOIN inbound i ON p.scan = i.scan AND p.path = i.target)"


def linked(spark: SparkSession, sf_dir: str, by_host: bool = False) -> DataFrame:
    """Pages with their in-degree, 0 by default."""
    p = corpus.pages(spark, sf_dir, by_host)
    counts = inbound_counts(p, artifacts(spark)[1]).withColumnRenamed("target", "path")
    return p.select("scan", "pid", "path", "size").join(counts, ["scan", "path"], "left").withColumn("inbound", F.coalesce("inbound", F.lit(0).cast("long")))


@query("in_degree_top10", f"WITH {IN} SELECT scan, path, inbound FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY inbound DESC, path, pid) AS r FROM linked) WHERE r <= 10")
def in_degree_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).withColumn("_r", F.row_number().over(W.partitionBy("scan").orderBy(F.desc("inbound"), "path", "pid"))).filter("_r <= 10").select("scan", "path", "inbound")


@query("orphans", f"WITH {IN} SELECT scan, pid, path FROM linked WHERE inbound = 0")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).filter("inbound = 0").select("scan", "pid", "path")


@query("hubs", f"WITH {IN} SELECT scan, pid, path, inbound FROM linked WHERE inbound > 0")
def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark, sf_dir).filter("inbound > 0").select("scan", "pid", "path", "inbound")


def outgoing(links: DataFrame) -> DataFrame:
    """A3: a page's links by cleaned URL: count, first text that isn't empty, flags of the first; 500 in document order."""
    clean = F.expr(S.bare_url(Spark, "href"))
    out = links.filter("kind = 'page'").withColumn("target_url", clean).filter("target_url <> ''").filter(~F.col("target_url").eqNullSafe(F.expr(Spark.rep("url", "/+$", ""))))
    out = out.groupBy("scan", "pid", "url", "target_url").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.min("pos").alias("pos"),
        F.min_by("text", F.when(F.col("text") != "", F.col("pos"))).alias("text"),
        F.min_by("nofollow", "pos").alias("nofollow"),
        F.min_by("ugc", "pos").alias("ugc"),
        F.min_by("sponsored", "pos").alias("sponsored"),
    )
    place = F.row_number().over(W.partitionBy("scan", "pid", "url").orderBy("pos"))
    out = out.withColumn("_n", place).filter("_n <= 500").drop("_n").withColumn("host", F.expr(S.host(Spark, "target_url")))
    return out.withColumn("internal", F.col("host") == F.expr(S.host(Spark, "url")))


OUT = f"""out1 AS (SELECT *, {S.bare_url(Duck, 'href')} AS target_url FROM link WHERE kind = 'page'),
out2 AS (SELECT scan, pid, url, target_url, count(*) AS occurrences, min(pos) AS pos, arg_min(text, pos) FILTER (WHERE text <> '') AS text, arg_min(nofollow, pos) AS nofollow, arg_min(ugc, pos) AS ugc, arg_min(sponsored, pos) AS sponsored FROM out1 WHERE target_url <> '' AND target_url IS DISTINCT FROM {Duck.rep('url', '/+$', '')} GROUP BY ALL),
outgoing AS (SELECT *, {S.host(Duck, 'target_url')} AS host, {S.host(Duck, 'target_url')} = {S.host(Duck, 'url')} AS internal FROM (SELECT *, row_number() OVER (PARTITION BY scan, pid, url ORDER BY pos) AS n FROM out2) WHERE n <= 500)"""


@query(
    "outgoing_split",
    f"WITH {L}, {A}, {X.meta_sql()}, {OUT}, saved AS (SELECT scan, path, min(title) AS title, min(h1s[1]) AS h1 FROM meta GROUP BY ALL) SELECT o.scan, o.pid, o.target_url, o.host, o.internal, CAST(o.occurrences AS BIGINT) AS occurrences, o.text, o.nofollow, o.ugc, o.sponsored, o.internal AND s.path IS NOT NULL AS scraped, o.internal AND b.url IS NOT NULL AS broken, CASE WHEN o.internal THEN s.title END AS title, CASE WHEN o.internal THEN s.h1 END AS h1 FROM outgoing o LEFT JOIN saved s ON s.scan = o.scan AND s.path = {S.page_path(Duck, 'o.target_url')} LEFT JOIN broken b ON b.scan = o.scan AND b.url = o.target_url",
)
def outgoing_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links joined to saved pages and to the broken list; external ones as they are."""
    p = corpus.pages(spark, sf_dir)
    saved = X.page_meta(p).groupBy("scan", "path").agg(F.min("title").alias("title"), F.min(F.get("h1s", F.lit(0))).alias("h1"))
    broken = artifacts(spark)[0].withColumnRenamed("url", "target_url").withColumn("_b", F.lit(True))
    o = outgoing(X.links(p)).withColumn("path", F.expr(S.page_path(Spark, "target_url")))
    o = o.join(saved.withColumn("_s", F.lit(True)), ["scan", "path"], "left").join(broken, ["scan", "target_url"], "left")
    inside = F.col("internal")
    return o.select("scan", "pid", "target_url", "host", "internal", "occurrences", "text", "nofollow", "ugc", "sponsored", (inside & F.col("_s").isNotNull()).alias("scraped"), (inside & F.col("_b").isNotNull()).alias("broken"), F.when(inside, F.col("title")).alias("title"), F.when(inside, F.col("h1")).alias("h1"))


@query("external_hosts", f"WITH {L}, {OUT} SELECT scan, pid, host, CAST(count(*) AS BIGINT) AS links FROM outgoing WHERE NOT internal GROUP BY ALL")
def external_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outgoing(X.links(corpus.pages(spark, sf_dir))).filter("not internal").groupBy("scan", "pid", "host").agg(F.count(F.lit(1)).alias("links"))


@query("other_links", f"WITH {L} SELECT scan, pid, href, arg_min(kind, pos) AS kind, arg_min(text, pos) AS text, CAST(count(*) AS BIGINT) AS occurrences FROM link WHERE kind <> 'page' GROUP BY scan, pid, url, href")
def other_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = X.links(corpus.pages(spark, sf_dir)).filter("kind <> 'page'").groupBy("scan", "pid", "url", "href")
    return k.agg(F.min_by("kind", "pos").alias("kind"), F.min_by("text", "pos").alias("text"), F.count(F.lit(1)).alias("occurrences")).drop("url")


INCOMING = f"""incoming AS (SELECT p.scan, p.pid, e.path AS source, e.source_url, CAST(len(e.texts) AS BIGINT) AS texts, e.occurrences, e.nofollow, false AS crawl_only FROM page p JOIN edge e ON e.scan = p.scan AND e.target = p.path
UNION ALL SELECT p.scan, p.pid, {S.page_path(Duck, 'c.source_url')}, c.source_url, 0, 1, false, true FROM page p JOIN (SELECT DISTINCT * FROM crawled) c ON c.scan = p.scan AND (c.target_url = p.url OR c.target_url = {Duck.rep('p.url', '/+$', '')} OR c.target_url = p.url || '/')
 WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.scan = p.scan AND e.target = p.path AND e.path = {S.page_path(Duck, 'c.source_url')})
 AND CASE WHEN c.target_url = p.url THEN 0 WHEN c.target_url = {Duck.rep('p.url', '/+$', '')} THEN 1 ELSE 2 END = (SELECT min(CASE WHEN d.target_url = p.url THEN 0 WHEN d.target_url = {Duck.rep('p.url', '/+$', '')} THEN 1 WHEN d.target_url = p.url || '/' THEN 2 END) FROM crawled d WHERE d.scan = p.scan))"""


def incoming(pages: DataFrame, crawled: DataFrame) -> DataFrame:
    """Who links to a page: saved sources, and those only the crawl saw (key: URL, without, with slash)."""
    e = edges(pages)
    saved = pages.select("scan", "pid", F.col("path").alias("target")).join(e, ["scan", "target"]).select("scan", "pid", F.col("path").alias("source"), "source_url", F.size("texts").cast("long").alias("texts"), "occurrences", "nofollow", F.lit(False).alias("crawl_only"))
    bare = Spark.rep("url", "/+$", "")
    keys = pages.select("scan", "pid", "url", F.posexplode(F.array("url", F.expr(bare), F.concat("url", F.lit("/")))).alias("rank", "target_url"))
    hits = keys.join(crawled.distinct(), ["scan", "target_url"])
    best = hits.groupBy("scan", "pid", "url").agg(F.min("rank").alias("rank"))
    only = hits.join(best, ["scan", "pid", "url", "rank"]).withColumn("source", F.expr(S.page_path(Spark, "source_url")))
    only = only.join(saved.select("scan", "pid", "source"), ["scan", "pid", "source"], "left_anti")
    only = only.select("scan", "pid", "source", "source_url", F.lit(0).cast("long").alias("texts"), F.lit(1).cast("long").alias("occurrences"), F.lit(False).alias("nofollow"), F.lit(True).alias("crawl_only"))
    return saved.unionByName(only)


@query("incoming_union_crawl", f"WITH {E}, {A}, {INCOMING} SELECT scan, pid, source, source_url, texts, occurrences, nofollow, crawl_only FROM (SELECT *, row_number() OVER (PARTITION BY scan, pid ORDER BY crawl_only, texts DESC, occurrences DESC, source) AS r FROM incoming) WHERE r <= 100")
def incoming_union_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = incoming(corpus.pages(spark, sf_dir), artifacts(spark)[1])
    order = W.partitionBy("scan", "pid").orderBy("crawl_only", F.desc("texts"), F.desc("occurrences"), "source")
    return i.withColumn("_r", F.row_number().over(order)).filter("_r <= 100").drop("_r")


def _status(noindex: str, away: str) -> str:
    return f"case when {noindex} and followed > 0 then 'noindex-but-linked' when {noindex} then 'noindex' when {away} then 'canonicalised-away' when total = 0 then 'orphan' when followed = 0 then 'nofollow-links-only' else 'indexable-and-linked' end"


def _notes(D, noindex: str, nofollow: str, away: str) -> str:
    array = "array" if D.__name__ == "Spark" else "list_value"
    rules = [
        (f"{noindex} and followed > 0", "'noindex but linked'"),
        (f"{noindex} and followed = 0 and total > 0", "'noindex, nofollow links only'"),
        (f"not {noindex} and total = 0", "'orphan'"),
        (f"not {noindex} and total > 0 and followed = 0", "'all links nofollow'"),
        (f"{nofollow} and internal > 0", "concat('nofollow, internal links: ', cast(internal as varchar(20)))"),
        (away, "concat('canonical: ', canonical)"),
        ("h1_count = 0", "'no h1'"),
        ("h1_count > 1", "concat('h1s: ', cast(h1_count as varchar(20)))"),
        ("description is null", "'no description'"),
        ("length(description) > 160", "'description long'"),
        ("length(description) < 50", "'description short'"),
        ("title is null", "'no title'"),
    ]
    listed = f"{array}({', '.join(f'case when {c} then {t} end' for c, t in rules)})"
    return D.join(D.keep(listed, "n", "n is not null"), "; ")


AWAY = "(canonical is not null and {bare_c} <> {bare_u})"
_S = ("array_contains(directives, 'noindex')", "array_contains(directives, 'nofollow')", AWAY.format(bare_c=Spark.rep("canonical", "/+$", ""), bare_u=Spark.rep("url", "/+$", "")))
_D = ("list_contains(directives, 'noindex')", "list_contains(directives, 'nofollow')", AWAY.format(bare_c=Duck.rep("canonical", "/+$", ""), bare_u=Duck.rep("url", "/+$", "")))


@query(
    "discoverability",
    f"WITH {E}, {A}, {X.meta_sql()}, {OUT}, {INCOMING}, i AS (SELECT scan, pid, count(*) AS total, count(*) FILTER (WHERE NOT nofollow) AS followed FROM incoming GROUP BY ALL), o AS (SELECT scan, pid, count(*) AS internal FROM outgoing WHERE internal GROUP BY ALL), j AS (SELECT m.*, coalesce(i.total, 0) AS total, coalesce(i.followed, 0) AS followed, coalesce(o.internal, 0) AS internal FROM meta m LEFT JOIN i USING (scan, pid) LEFT JOIN o USING (scan, pid)) SELECT scan, pid, CAST(total AS BIGINT) AS total, CAST(followed AS BIGINT) AS followed, CAST(internal AS BIGINT) AS internal, {_status(_D[0], _D[2])} AS status, {_notes(Duck, *_D)} AS notes FROM j",
)
def discoverability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether and how a page can be found."""
    p = corpus.pages(spark, sf_dir)
    i = incoming(p, artifacts(spark)[1]).groupBy("scan", "pid").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("nofollow")).alias("followed"))
    o = outgoing(X.links(p)).filter("internal").groupBy("scan", "pid").agg(F.count(F.lit(1)).alias("internal"))
    zero = F.lit(0).cast("long")
    j = X.page_meta(p).join(i, ["scan", "pid"], "left").join(o, ["scan", "pid"], "left").withColumns({c: F.coalesce(c, zero) for c in ("total", "followed", "internal")})
    return j.select("scan", "pid", "total", "followed", "internal", F.expr(_status(_S[0], _S[2])).alias("status"), F.expr(_notes(Spark, *_S)).alias("notes"))


@query("bounded_reverse_links", f"WITH {E} SELECT scan, target, path AS source FROM (SELECT *, row_number() OVER (PARTITION BY scan, target ORDER BY path) AS n FROM edge) WHERE n <= 25")
def bounded_reverse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(corpus.pages(spark, sf_dir))
    return e.withColumn("_n", F.row_number().over(W.partitionBy("scan", "target").orderBy("path"))).filter("_n <= 25").select("scan", "target", F.col("path").alias("source"))


DRIFT = f"""label AS (SELECT scan, target, {S.squeeze(Duck, 'lower(text)')} AS label, min(text) AS display, count(*) AS n FROM (SELECT scan, target, unnest(texts) AS text FROM edge) GROUP BY ALL),
drift AS (SELECT scan, target, count(*) AS labels, array_to_string(list(label ORDER BY n DESC, label), ' | ') AS names FROM label WHERE length(label) >= 3 AND label NOT IN ({", ".join(f"'{w}'" for w in S.WAYFINDING)}) GROUP BY ALL HAVING count(*) >= 3)"""


def drift(pages: DataFrame) -> DataFrame:
    """Targets called by three or more different names; wayfinding words don't count."""
    t = edges(pages).select("scan", "target", F.explode("texts").alias("text"))
    t = t.groupBy("scan", "target", F.expr(S.squeeze(Spark, "lower(text)")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = t.filter((F.char_length("label") >= 3) & ~F.col("label").isin(*S.WAYFINDING))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "label"))), lambda x: x["label"]), " | ")
    return t.groupBy("scan", "target").agg(F.count(F.lit(1)).alias("labels"), names.alias("names")).filter("labels >= 3")


@query("terminology_drift", f"WITH {E}, {DRIFT} SELECT scan, target, CAST(labels AS BIGINT) AS labels, names FROM drift")
def terminology_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift(corpus.pages(spark, sf_dir))


@query("content_dedupe", "SELECT first, CAST(count(*) AS BIGINT) AS copies, h AS sha FROM (SELECT sha1(text) AS h, min(doc_id) OVER (PARTITION BY sha1(text)) AS first FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash to its first document."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.groupBy(F.sha1(F.col("text").cast("binary")).alias("sha")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
