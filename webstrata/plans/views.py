"""What the site's pages show: links by region, ordered and capped lists, shares, page names behind findings, sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import dom
from webstrata.operators import extract as X
from webstrata.plans import access, dashboard, documents, findings, graph, rating
from webstrata.plans.catalog import query
from webstrata.plans.content import located
from webstrata.session import materialise
from webstrata.sources import corpus

P = corpus.pages_sql()

# --- Links by region ------------------------------------------------------


def link_regions(pages: DataFrame) -> DataFrame:
    """scan, pid, href, text, region: the region of the first link of a page with that target and text."""
    r = documents.over_pages(pages, dom.regions, "pos long, href string, text string, region string", ["pos", "href", "text", "region"])
    return r.groupBy("scan", "pid", "href", "text").agg(F.min_by("region", "pos").alias("region"))


def edge_regions(pages: DataFrame) -> DataFrame:
    """Scan, path, target, region: content if any of a page's links to the target stands there, else that of the first."""
    target = F.expr(S.page_path(Spark, Spark.rep("href", "#.*$", "")))
    e = X.links(pages).filter("kind = 'page'").withColumn("target", target).filter("target is not null and target <> path")
    e = e.join(link_regions(pages), ["scan", "pid", "href", "text"], "left").withColumn("region", F.coalesce("region", F.lit("content")))
    any_ = F.when(F.bool_or(F.col("region") == "content"), "content").otherwise(F.min_by("region", F.struct("pid", "pos")))
    return e.groupBy("scan", "path", "target").agg(any_.alias("region"))


_TOKEN = r"(?i)<nav[\s>]|</nav>|<footer[\s>]|</footer>|<header[\s>]|</header>|<a\s[^>]*?>[\s\S]*?</a>|<area\s[^>]*?/?>"


def _depth(tag: str) -> str:
    return f"sum(CASE WHEN regexp_matches(tok, '(?i)^<{tag}[\\s>]') THEN 1 WHEN regexp_matches(tok, '(?i)^</{tag}') THEN -1 ELSE 0 END) OVER (PARTITION BY scan, pid, url ORDER BY i)"


REGION = f"""tok AS (SELECT scan, pid, url, unnest(range(0, len(t))) AS i, unnest(t) AS tok FROM (SELECT *, {Duck.every('html', _TOKEN, 0)} AS t FROM page)),
dep AS (SELECT *, CASE WHEN {_depth('nav')} > 0 THEN 'nav' WHEN {_depth('footer')} > 0 THEN 'footer' WHEN {_depth('header')} > 0 THEN 'header' ELSE 'content' END AS region FROM tok),
raw_reg AS (SELECT scan, pid, i, region, CASE WHEN regexp_matches(tok, '(?i)^<area') THEN 'area' ELSE 'a' END AS tag, CASE WHEN regexp_matches(tok, '(?i)^<area') THEN {Duck.ext('tok', S.AREA)} ELSE {Duck.ext('tok', S.ANCHOR)} END AS attrs, {Duck.ext('tok', S.ANCHOR, 2)} AS body FROM dep WHERE regexp_matches(tok, '(?i)^<(?:a|area)\\s')),
reg AS (SELECT scan, pid, href, text, arg_min(region, i) AS region FROM (SELECT scan, pid, i, region, tag, {', '.join(f'{e} AS {c}' for c, e in X.link_columns(Duck).items() if c in ('href', 'text'))} FROM raw_reg) GROUP BY ALL),
er AS (SELECT h.scan, h.path, h.target, CASE WHEN bool_or(coalesce(r.region, 'content') = 'content') THEN 'content' ELSE arg_min(r.region, (h.pid, h.pos)) END AS region FROM hop h LEFT JOIN reg r ON r.scan = h.scan AND r.pid = h.pid AND r.href = h.href AND r.text = h.text WHERE h.target IS NOT NULL AND h.target <> h.path GROUP BY ALL)"""
SAVED = f"{X.meta_sql()}, saved AS (SELECT scan, path, min(title) AS title, min(h1s[1]) AS h1 FROM meta GROUP BY ALL)"
INCOMING = f"{graph.E}, {graph.A}, {REGION}, {SAVED}, {graph.INCOMING}"


@query(
    "incoming_ordered",
    f"WITH {INCOMING} SELECT scan, pid, source, region, title, h1, occurrences, crawl_only, CAST(place AS BIGINT) AS place FROM (SELECT i.*, coalesce(e.region, 'content') AS region, s.title, s.h1, row_number() OVER (PARTITION BY i.scan, i.pid ORDER BY coalesce(e.region, 'content') <> 'content', i.texts DESC, i.occurrences DESC, i.source) AS place FROM incoming i JOIN page p ON p.scan = i.scan AND p.pid = i.pid AND (i.crawl_only OR p.path <> i.source) LEFT JOIN er e ON e.scan = i.scan AND e.path = i.source AND e.target = p.path LEFT JOIN saved s ON s.scan = i.scan AND s.path = i.source) WHERE place <= 100",
)
def incoming_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who links to a page, with the region of the link and the source's own title and heading; links in content first."""
    p = corpus.pages(spark, sf_dir)
    saved = X.page_meta(p).groupBy("scan", F.col("path").alias("source")).agg(F.min("title").alias("title"), F.min(F.get("h1s", F.lit(0))).alias("h1"))
    i = graph.incoming(p, graph.artifacts(spark)[1]).join(p.select("scan", "pid", F.col("path").alias("target")), ["scan", "pid"])
    i = i.join(edge_regions(p).withColumnRenamed("path", "source"), ["scan", "source", "target"], "left").withColumn("region", F.coalesce("region", F.lit("content")))
    i = i.filter("crawl_only or source <> target").join(saved, ["scan", "source"], "left")
    order = W.partitionBy("scan", "pid").orderBy(F.col("region") != "content", F.desc("texts"), F.desc("occurrences"), "source")
    return i.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 100").select("scan", "pid", "source", "region", "title", "h1", "occurrences", "crawl_only", "place")


@query(
    "page_link_counts",
    f"""WITH {INCOMING}, {graph.OUT}, i AS (SELECT i.scan, i.pid, count(*) AS incoming, count(*) FILTER (WHERE coalesce(e.region, 'content') = 'content') AS incoming_content FROM incoming i JOIN page p ON p.scan = i.scan AND p.pid = i.pid LEFT JOIN er e ON e.scan = i.scan AND e.path = i.source AND e.target = p.path GROUP BY ALL),
o AS (SELECT o.scan, o.pid, count(*) FILTER (WHERE internal) AS internal, count(*) FILTER (WHERE NOT internal) AS external, count(DISTINCT host) FILTER (WHERE NOT internal) AS external_hosts, count(*) FILTER (WHERE internal AND b.url IS NOT NULL) AS broken_out, count(*) FILTER (WHERE internal AND b.url IS NULL AND s.path IS NULL) AS not_scraped, count(*) FILTER (WHERE nofollow) AS nofollow FROM outgoing o LEFT JOIN saved s ON s.scan = o.scan AND s.path = {S.page_path(Duck, 'o.target_url')} LEFT JOIN broken b ON b.scan = o.scan AND b.url = o.target_url GROUP BY ALL),
x AS (SELECT scan, pid, count(DISTINCT href) AS other FROM link WHERE kind <> 'page' GROUP BY ALL), t AS (SELECT scan, pid, count(*) > 500 AS truncated FROM out2 GROUP BY ALL)
SELECT p.scan, p.pid, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in ('incoming', 'incoming_content', 'internal', 'external', 'external_hosts', 'other', 'broken_out', 'not_scraped', 'nofollow'))}, CAST(coalesce(incoming, 0) - coalesce(incoming_content, 0) AS BIGINT) AS incoming_chrome, coalesce(truncated, false) AS truncated FROM page p LEFT JOIN i USING (scan, pid) LEFT JOIN o USING (scan, pid) LEFT JOIN x USING (scan, pid) LEFT JOIN t USING (scan, pid)""",
)
def page_link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's counters of links in and out, and whether its own list was cut."""
    p = corpus.pages(spark, sf_dir)
    key = ["scan", "pid"]
    links = X.links(p)
    target = p.select(*key, F.col("path").alias("target"))
    i = graph.incoming(p, graph.artifacts(spark)[1]).join(target, key).join(edge_regions(p).withColumnRenamed("path", "source"), ["scan", "source", "target"], "left")
    i = i.groupBy(*key).agg(F.count(F.lit(1)).alias("incoming"), F.count_if(F.coalesce("region", F.lit("content")) == "content").alias("incoming_content"))
    saved = p.select("scan", "path").distinct().withColumn("_s", F.lit(True))
    broken = graph.artifacts(spark)[0].withColumnRenamed("url", "target_url").withColumn("_b", F.lit(True))
    o = graph.outgoing(links).withColumn("path", F.expr(S.page_path(Spark, "target_url"))).join(saved, ["scan", "path"], "left").join(broken, ["scan", "target_url"], "left")
    inside, dead, kept = F.col("internal"), F.col("_b").isNotNull(), F.col("_s").isNotNull()
    o = o.groupBy(*key).agg(F.count_if(inside).alias("internal"), F.count_if(~inside).alias("external"), F.countDistinct(F.when(~inside, F.col("host"))).alias("external_hosts"), F.count_if(inside & dead).alias("broken_out"), F.count_if(inside & ~dead & ~kept).alias("not_scraped"), F.count_if("nofollow").alias("nofollow"))
    x = links.filter("kind <> 'page'").groupBy(*key).agg(F.countDistinct("href").alias("other"))
    clean = links.filter("kind = 'page'").withColumn("target_url", F.expr(S.bare_url(Spark, "href"))).filter("target_url <> ''").filter(~F.col("target_url").eqNullSafe(F.expr(Spark.rep("url", "/+$", ""))))
    t = clean.groupBy(*key).agg((F.countDistinct("target_url") > 500).alias("truncated"))
    out = p.select(*key)
    for df in (i, o, x, t):
        out = out.join(df, key, "left")
    counts = ["incoming", "incoming_content", "internal", "external", "external_hosts", "other", "broken_out", "not_scraped", "nofollow"]
    out = out.na.fill(0, counts).na.fill(False, ["truncated"])
    return out.select(*key, *counts, (F.col("incoming") - F.col("incoming_content")).alias("incoming_chrome"), "truncated")


#: A site's own group of links, which comes before the defaults; the default header is switched off.
OWN = [{"name": "Top list", "selectors": ["nav ul", "<<<broken"]}]
_OWN_TOKEN = _TOKEN + r"|<ul[\s>]|</ul>"


@query("link_groups", f"WITH {P}, tok AS (SELECT scan, pid, url, unnest(range(0, len(t))) AS i, unnest(t) AS tok FROM (SELECT *, {Duck.every('html', _OWN_TOKEN, 0)} AS t FROM page)), dep AS (SELECT *, CASE WHEN {_depth('nav')} > 0 AND {_depth('ul')} > 0 THEN 'Top list' WHEN {_depth('nav')} > 0 THEN 'nav' WHEN {_depth('footer')} > 0 THEN 'footer' ELSE 'content' END AS region FROM tok) SELECT scan, pid, region, CAST(count(*) AS BIGINT) AS links FROM dep WHERE regexp_matches(tok, '(?i)^<(?:a|area)\\s[^>]*href') GROUP BY ALL")
def link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by the groups in force: the site's own, then the defaults that are left."""
    return documents.links_by_region(corpus.pages(spark, sf_dir), dom.chrome_groups(OWN, ("header",)))


#: A site's own rules for questions, one of them no selector; and what they find on the made-up pages.
RULES = [{"container": "dl", "question": "dt", "answer": "dd"}, {"question": "<<<broken", "answer": "p"}, {"question": "summary", "answer": "details p"}]
RULED = [("faq.example", 1, "Who runs it?", "A small team of people who like it."), ("faq.example", 1, "Can I leave?", "You can leave at any time you want.")]


@query("qa_rules", f"SELECT scan, CAST(pid AS BIGINT) AS pid, question, answer FROM {corpus.values(RULED)} t(scan, pid, question, answer)")
def qa_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3, T5e: question and answer pairs by the selectors that a site names, in a container or one after another."""
    pages = corpus.pages(spark, sf_dir).select("scan", "pid", "html").unionByName(spark.createDataFrame(documents.FAQ, "scan string, pid long, url string, html string").drop("url"))
    pairs = documents.over_pages(pages, lambda html: dom.questions(html, RULES), "extractor string, pos long, question string, answer string", ["extractor", "pos", "question", "answer"])
    return pairs.filter("extractor = 'rule'").select("scan", "pid", "question", "answer")


# --- Ordered and capped lists ---------------------------------------------


@query("diff_lists", f"WITH {dashboard.DIFF}, j AS (SELECT coalesce(now.page_id, was.page_id) AS page_id, CASE WHEN was.page_id IS NULL THEN 'added' WHEN now.page_id IS NULL THEN 'removed' WHEN now.size <> was.size THEN 'changed' ELSE 'same' END AS state, CAST(now.size - was.size AS BIGINT) AS delta FROM now FULL OUTER JOIN was ON now.page_id = was.page_id) SELECT state, page_id, delta, CAST(place AS BIGINT) AS place, CAST(total AS BIGINT) AS total FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY CASE WHEN state = 'changed' THEN -abs(delta) ELSE 0 END, page_id) AS place, count(*) OVER (PARTITION BY state) AS total FROM j WHERE state <> 'same') WHERE place <= CASE WHEN state = 'changed' THEN 20 ELSE 50 END")
def diff_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: up to 50 added and removed pages, the 20 that changed most, and how many there are."""
    d = dashboard.scan_diff(spark, sf_dir).filter("state <> 'same'")
    total = d.groupBy("state").agg(F.count(F.lit(1)).alias("total"))
    place = F.row_number().over(W.partitionBy("state").orderBy(F.when(F.col("state") == "changed", -F.abs("delta")).otherwise(0), "page_id"))
    return d.withColumn("place", place.cast("long")).filter("place <= case when state = 'changed' then 20 else 50 end").join(F.broadcast(total), "state").select("state", "page_id", "delta", "place", "total")


@query("orphan_list", f"WITH {graph.IN} SELECT scan, pid, path FROM (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY path, pid) AS r FROM linked WHERE inbound = 0) WHERE r <= 50")
def orphan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the first 50 orphans of a scan."""
    return graph.linked(spark, sf_dir).filter("inbound = 0").withColumn("_r", F.row_number().over(W.partitionBy("scan").orderBy("path", "pid"))).filter("_r <= 50").select("scan", "pid", "path")


@query("outgoing_order", f"WITH {graph.L}, {graph.A}, {graph.OUT} SELECT o.scan, o.pid, o.target_url, CAST(row_number() OVER (PARTITION BY o.scan, o.pid, o.url, o.internal ORDER BY CASE WHEN o.internal AND b.url IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN o.internal THEN '' ELSE o.host END, o.target_url) AS BIGINT) AS place FROM outgoing o LEFT JOIN broken b ON b.scan = o.scan AND b.url = o.target_url")
def outgoing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Internal links broken ones first, then by URL; external ones by host and URL."""
    broken = graph.artifacts(spark)[0].withColumnRenamed("url", "target_url").withColumn("_b", F.lit(True))
    o = graph.outgoing(X.links(corpus.pages(spark, sf_dir))).join(broken, ["scan", "target_url"], "left")
    order = W.partitionBy("scan", "pid", "url", "internal").orderBy(F.when(F.col("internal") & F.col("_b").isNotNull(), 0).otherwise(1), F.when(F.col("internal"), "").otherwise(F.col("host")), "target_url")
    return o.select("scan", "pid", "target_url", F.row_number().over(order).cast("long").alias("place"))


@query("tree_order", f"WITH {P}, x AS (SELECT DISTINCT scan, string_split(path, '/') AS s FROM page), n AS (SELECT DISTINCT scan, array_to_string(s[1:d], '/') AS parent, s[d + 1] AS name, CASE WHEN d = len(s) - 1 THEN 'page' ELSE 'dir' END AS type FROM (SELECT scan, s, unnest(range(0, len(s))) AS d FROM x)) SELECT scan, parent, name, type, CAST(row_number() OVER (PARTITION BY scan, parent ORDER BY CASE WHEN type = 'page' THEN 0 ELSE 1 END, name) AS BIGINT) AS place FROM n")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of every folder, pages before folders, each by name."""
    s = F.split("path", "/")
    n = corpus.pages(spark, sf_dir).select("scan", s.alias("s")).distinct().select("scan", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("d"))
    n = n.select("scan", F.array_join(F.slice("s", 1, F.col("d")), "/").alias("parent"), F.get("s", F.col("d")).alias("name"), F.when(F.col("d") == F.size("s") - 1, "page").otherwise("dir").alias("type")).distinct()
    order = W.partitionBy("scan", "parent").orderBy(F.when(F.col("type") == "page", 0).otherwise(1), "name")
    return n.withColumn("place", F.row_number().over(order).cast("long"))


_SEVERITY = "case severity when 'high' then 0 when 'medium' then 1 else 2 end"


@query("findings_order", f"{findings.SQL} SELECT scan, id, severity, pages_affected, CAST(row_number() OVER (PARTITION BY scan ORDER BY {_SEVERITY}, pages_affected DESC, ord) AS BIGINT) AS place FROM finding")
def findings_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as they are shown: by severity, then by the pages they touch."""
    order = W.partitionBy("scan").orderBy(F.expr(_SEVERITY), F.desc("pages_affected"), "ord")
    return findings.site_report(spark, sf_dir).select("scan", "id", "severity", "pages_affected", F.row_number().over(order).cast("long").alias("place"))


@query("depth_share", f"WITH {P}, {dashboard.LOC}, d AS (SELECT scan, depth, count(*) AS pages FROM loc GROUP BY ALL) SELECT scan, depth, CAST(floor(100.0 * pages / sum(pages) OVER (PARTITION BY scan) + 0.5) AS BIGINT) AS share FROM d")
def depth_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a scan's pages at every depth."""
    p = located(corpus.pages(spark, sf_dir))
    total = p.groupBy("scan").agg(F.count(F.lit(1)).alias("total"))
    return p.groupBy("scan", "depth").agg(F.count(F.lit(1)).alias("pages")).join(total, "scan").select("scan", "depth", dashboard.rounded(100.0 * F.col("pages") / F.col("total")).alias("share"))


# --- Page names behind findings -------------------------------------------


@query("evidence_pages", f"{findings.SQL}, pg AS (SELECT scan, id, key, page, row_number() OVER (PARTITION BY scan, id, key ORDER BY page) AS r FROM (SELECT DISTINCT scan, id, key, page FROM ev)), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan, id ORDER BY n DESC, value, key) AS r FROM gr) WHERE r <= 12) SELECT tp.scan, tp.id, tp.value, CAST(tp.n AS BIGINT) AS n, array_to_string(list(pg.page ORDER BY pg.r), ',') AS pages FROM tp JOIN pg ON pg.scan = tp.scan AND pg.id = tp.id AND pg.key = tp.key AND pg.r <= 8 GROUP BY tp.scan, tp.id, tp.key, tp.value, tp.n")
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve largest groups behind every finding, each with up to eight of its pages."""
    rows, _ = findings.evidence(corpus.pages(spark, sf_dir), graph.artifacts(spark)[0], access.site_files(spark))
    rows = materialise(rows)
    key = ["scan", "id", "key"]
    groups = rows.groupBy(*key).agg(F.min("value").alias("value"), F.countDistinct("page").alias("n"))
    top = groups.withColumn("_r", F.row_number().over(W.partitionBy("scan", "id").orderBy(F.desc("n"), "value", "key"))).filter("_r <= 12").drop("_r")
    # Only eight pages of a group are gathered.
    pages = rows.select(*key, "page").distinct().withColumn("_p", F.row_number().over(W.partitionBy(*key).orderBy("page"))).filter("_p <= 8")
    pages = pages.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "page"))), lambda x: x["page"]), ",").alias("pages"))
    return top.join(pages, key).select("scan", "id", "value", "n", "pages")


# --- Sentences --------------------------------------------------------------

# How pillars are called, by version of the rating.
LABELS = {
    2: {"facts": "Contradictory facts", "metadata": "Metadata conflicts", "structured-data": "Structured data", "terminology": "Terminology drift"},
    3: {"access": "Access & rendering", "facts": "Fact consistency", "metadata": "Metadata integrity", "structured-data": "Structured data", "terminology": "Terminology & entities", "extractability": "Extractability"},
}


def _verdict(version: int) -> str:
    label = "case pillar " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS[version].items()) + " end"
    words = "':'" if version == 2 else "case when lost >= 50 then ' are your biggest cost —' else ' cost you the most —' end"
    found = "concat(cast(n as varchar(20)), case when n = 1 then ' finding' else ' findings' end, ' losing ', cast(cast(floor(points + 0.5) as bigint) as varchar(20)), ' weighted points.')"
    return f"case when pillar is null then 'No coherence problems found — the site speaks with one voice.' else concat({label}, {words}, ' ', {found}) end"


def _verdicts(version: int) -> None:
    sql = f"WITH {rating.FIXTURE}, {rating._ctes('fnd', version)}, wo AS (SELECT scan, pillar, lost, findings AS n, lost * weight AS points, row_number() OVER (PARTITION BY scan ORDER BY round(lost * weight, 6) DESC, place) AS r FROM pil WHERE lost > 0) SELECT s.scan, {_verdict(version)} AS verdict FROM (SELECT DISTINCT scan FROM fnd) s LEFT JOIN wo ON wo.scan = s.scan AND wo.r = 1"

    @query(f"rating_verdict_v{version}", sql)
    def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The pillar that costs most, in a sentence."""
        p = rating.pillars(rating.found(spark), version).withColumn("points", F.col("lost") * F.col("weight"))
        worst = F.max_by(F.struct("pillar", "lost", F.col("findings").alias("n"), "points"), F.when(F.col("lost") > 0, F.struct(F.round("points", 6).alias("v"), (-F.col("place")).alias("o"))))
        return p.groupBy("scan").agg(worst.alias("w")).select("scan", "w.*").select("scan", F.expr(_verdict(version)).alias("verdict"))


_verdicts(2)
_verdicts(3)


def _sentences(D, noindex: str, nofollow: str, away: str) -> str:
    """The notes on a page, in the order in which they are shown."""
    n = lambda c: f"cast({c} as varchar(20))"
    unfollowed = "(total - followed)"
    rules = [
        (f"{noindex} and followed > 0", f"concat('Excluded from search by meta robots noindex, but still reachable — ', {n('followed')}, ' followed internal link', case when followed = 1 then ' points' else 's point' end, ' here.')"),
        (f"{noindex} and followed = 0 and {unfollowed} > 0", f"concat('noindex, and the only ', {n(unfollowed)}, ' internal link', case when {unfollowed} = 1 then '' else 's' end, ' pointing here ', case when {unfollowed} = 1 then 'is' else 'are' end, ' nofollow.')"),
        (f"not {noindex} and total = 0", "'Orphan: no page in this scan links here, so crawlers can only find it via a sitemap or external link.'"),
        (f"not {noindex} and total > 0 and followed = 0", f"concat('Every one of the ', {n('total')}, ' internal links pointing here is nofollow — link equity is not passed.')"),
        (f"{nofollow} and internal > 0", f"concat('meta robots nofollow: the ', {n('internal')}, ' internal link', case when internal = 1 then '' else 's' end, ' on this page are not followed.')"),
        (away, "concat('Canonical points elsewhere (', canonical, ') — this URL is not the indexed version.')"),
        ("h1_count = 0", "'No H1 heading.'"),
        ("h1_count > 1", f"concat({n('h1_count')}, ' H1 headings — expected one.')"),
        ("coalesce(description, '') = ''", "'No meta description.'"),
        ("length(description) > 160", f"concat('Meta description is ', {n('length(description)')}, ' characters — likely truncated in results.')"),
        ("length(description) between 1 and 49", f"concat('Meta description is only ', {n('length(description)')}, ' characters.')"),
        ("coalesce(title, '') = ''", "'No <title>.'"),
    ]
    listed = f"{'array' if D.__name__ == 'Spark' else 'list_value'}({', '.join(f'case when {c} then {t} end' for c, t in rules)})"
    return D.join(D.keep(listed, "n", "n is not null"), " ")


@query(
    "discoverability_notes",
    f"WITH {graph.E}, {graph.A}, {X.meta_sql()}, {graph.OUT}, {graph.INCOMING}, i AS (SELECT scan, pid, count(*) AS total, count(*) FILTER (WHERE NOT nofollow) AS followed FROM incoming GROUP BY ALL), o AS (SELECT scan, pid, count(*) AS internal FROM outgoing WHERE internal GROUP BY ALL), j AS (SELECT m.*, coalesce(i.total, 0) AS total, coalesce(i.followed, 0) AS followed, coalesce(o.internal, 0) AS internal FROM meta m LEFT JOIN i USING (scan, pid) LEFT JOIN o USING (scan, pid)) SELECT scan, pid, {_sentences(Duck, *graph._D)} AS notes FROM j",
)
def discoverability_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.pages(spark, sf_dir)
    i = graph.incoming(p, graph.artifacts(spark)[1]).groupBy("scan", "pid").agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("nofollow")).alias("followed"))
    o = graph.outgoing(X.links(p)).filter("internal").groupBy("scan", "pid").agg(F.count(F.lit(1)).alias("internal"))
    j = X.page_meta(p).join(i, ["scan", "pid"], "left").join(o, ["scan", "pid"], "left").na.fill(0, ["total", "followed", "internal"])
    return j.select("scan", "pid", F.expr(_sentences(Spark, *graph._S)).alias("notes"))
