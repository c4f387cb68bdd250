"""Queries over document trees: link regions, question and answer pairs, chunks; and a squarified treemap."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import dom
from webstrata.operators import extract as X
from webstrata.plans.catalog import query
from webstrata.plans.content import located
from webstrata.plans.dashboard import LOC, P
from webstrata.session import small_batches
from webstrata.sources import corpus

FAQ = [
    ("faq.example", 1, "https://faq.example/", '<html><body><script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"How much is it?","acceptedAnswer":{"text":"<p>It is free of charge.</p>"}}]}</script><details><summary>Can I leave?</summary><p>You can leave at any time you want.</p></details><dl><dt>Who runs it?</dt><dd>A small team of people who like it.</dd><dt>Note</dt><dd>This one is not asked as a question at all.</dd></dl><h2>How much is it?</h2><p>Another answer that comes too late to count.</p><h3>Where are you?</h3><p>In a town by the sea, near the harbour.</p><p>Second part.</p><h3>Next</h3></body></html>'),
]


#: Rows, and characters of the markup they come from, at which a Python worker hands its rows on; a page's stay together.
HELD, MARKUP = 1000, 8_000_000


def over_pages(pages: DataFrame, read: Callable[[str], Iterable[tuple]], ddl: str, names: list[str]) -> DataFrame:
    """Rows that ``read`` makes of each page's tree; only keys and markup travel to Python."""
    columns = ["scan", "pid", *names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, markup = [], 0
            for s, p, h in zip(b["scan"], b["pid"], b["html"], strict=True):
                held += [(s, p, *r) for r in read(h or "")]
                markup += len(h or "")
                if len(held) >= HELD or (held and markup >= MARKUP):
                    yield pd.DataFrame(held, columns=columns)
                    held, markup = [], 0
            if held:
                yield pd.DataFrame(held, columns=columns)

    small_batches(pages.sparkSession)
    return pages.select("scan", "pid", "html").mapInPandas(run, f"scan string, pid long, {ddl}")


def links_by_region(pages: DataFrame, groups: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """scan, pid, region, links. A page's links are counted where its tree is; rows of one page are added up."""
    r = over_pages(pages, lambda html: Counter(r[3] for r in dom.regions(html, groups)).items(), "region string, links long", ["region", "links"])
    return r.groupBy("scan", "pid", "region").agg(F.sum("links").alias("links"))


@query("link_regions", f"WITH {P}, {X.links_sql()}, n AS (SELECT scan, pid, CAST(len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?i)<nav[^>]*>[\\s\\S]*?</nav>', 0), ''), '(?i)<a\\s[^>]*href', 0)) AS BIGINT) AS nav, CAST(len(regexp_extract_all(array_to_string(regexp_extract_all(html, '(?i)<footer[^>]*>[\\s\\S]*?</footer>', 0), ''), '(?i)<a\\s[^>]*href', 0)) AS BIGINT) AS footer, CAST(len(regexp_extract_all(html, '(?i)<(?:a|area)\\s[^>]*href', 0)) AS BIGINT) AS total FROM page) SELECT scan, pid, region, n AS links FROM (SELECT scan, pid, 'nav' AS region, nav AS n FROM n UNION ALL SELECT scan, pid, 'footer', footer FROM n UNION ALL SELECT scan, pid, 'content', total - nav - footer FROM n) WHERE n > 0")
def link_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by region of the page."""
    return links_by_region(corpus.pages(spark, sf_dir))


#: What a reader finds on the made-up pages; captured pages hold no question of any of the four kinds.
ANSWERS = [
    ("bank.example", 2, "heading", "How do I apply?", "Fill in the form and wait for a call. 1 2024"),
    ("faq.example", 1, "details", "Can I leave?", "You can leave at any time you want."),
    ("faq.example", 1, "jsonld", "How much is it?", "It is free of charge."),
    ("faq.example", 1, "heading", "Where are you?", "In a town by the sea, near the harbour. Second part."),
    ("faq.example", 1, "dl", "Who runs it?", "A small team of people who like it."),
]


@query("qa_pairs", f"SELECT scan, CAST(pid AS BIGINT) AS pid, extractor, question, answer FROM {corpus.values(ANSWERS)} t(scan, pid, extractor, question, answer)")
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer pairs of a site; the first of each question, in order of page and extractor."""
    pages = corpus.pages(spark, sf_dir).select("scan", "pid", "html").unionByName(spark.createDataFrame(FAQ, "scan string, pid long, url string, html string").drop("url"))
    pairs = over_pages(pages, dom.questions, "extractor string, pos long, question string, answer string", ["extractor", "pos", "question", "answer"])
    key = Spark.rep(Spark.rep("lower(question)", r"[^\w\s]", ""), r"\s+", " ")
    pairs = pairs.withColumn("key", F.expr(key)).filter("key <> ''")
    first = pairs.groupBy("scan", "key").agg(F.min(F.struct("pid", "pos", "extractor", "question", "answer")).alias("f"))
    return first.select("scan", "f.pid", "f.extractor", "f.question", "f.answer")


def _chunks_sql() -> str:
    """Cut at headings by patterns instead of a tree: the made-up and captured pages are well-formed enough for that."""
    clean = "html"
    for gone in ("script", "style", "nav", "footer", "header"):
        clean = Duck.rep(clean, rf"(?i)<{gone}\b[^>]*>[\s\S]*?</{gone}>", "")
    clean = Duck.rep(clean, r"<!--[\s\S]*?-->", "")
    plain = lambda e: Duck.rep(Duck.rep(e, r"(?i)<p\b[^>]*>|</(?:p|a|table|time|ul|ol|dl|div|h[4-6]|pre|blockquote|article|main|body|html)\s*>", " "), "<[^>]*>", "")

    def text(e: str, spaced: bool = True) -> str:
        e = plain(e) if spaced else Duck.rep(e, "<[^>]*>", "")
        for name, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
            e = f"replace({e}, '{name}', {char})"
        return S.squeeze(Duck, e)

    main, body = Duck.ext(clean, r"(?i)<main\b[^>]*>([\s\S]*?)</main>"), r"(?i)<body[^>]*>([\s\S]*)"
    return f"""WITH {P}, c AS (SELECT scan, pid, unnest(range(2, len(s) + 1)) AS i, unnest(s[2:]) AS part FROM (SELECT scan, pid, regexp_split_to_array({clean}, '(?i)<h[1-3]\\b[^>]*>') AS s FROM page)),
t AS (SELECT scan, pid, i, {text(Duck.ext('part', r'(?i)^([\s\S]*?)</h[1-3]'))} AS heading, {text(Duck.ext('part', r'(?i)^[\s\S]*?</h[1-3]\s*>([\s\S]*)$'))} AS text FROM c),
k AS (SELECT * FROM t WHERE heading <> '' AND length(text) >= {2 * dom.LEAST}),
b AS (SELECT scan, pid, CASE WHEN {main} <> '' THEN {text(main, False)} WHEN {Duck.like(clean, '(?i)<body')} THEN {text(Duck.ext(clean, body), False)} ELSE {text(clean, False)} END AS text FROM page)
SELECT scan, pid, CAST(row_number() OVER (PARTITION BY scan, pid ORDER BY i) - 1 AS BIGINT) AS pos, heading, text FROM k
UNION ALL SELECT scan, pid, 0, NULL, text FROM b WHERE length(text) >= {2 * dom.LEAST} AND NOT EXISTS (SELECT 1 FROM k WHERE k.scan = b.scan AND k.pid = b.pid)"""


@query("page_chunks", _chunks_sql())
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading-scoped chunks of every page."""
    return over_pages(corpus.pages(spark, sf_dir), dom.chunks, "pos long, heading string, text string", ["pos", "heading", "text"])


def strip_length(areas: list[float], side: float) -> int:
    """How many of the (descending) areas stand side by side along ``side`` before their worst aspect ratio gets worse."""
    filled, best = 0.0, float("inf")
    for n, area in enumerate(areas):
        filled += area
        square = (filled / side) ** 2
        # Of a strip, only the first and the last cell can be the least square.
        ratio = max(areas[0] / square, square / area)
        if ratio > best:
            return n
        best = ratio
    return len(areas)


def squarified(values: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles for descending values: strips along the shorter side of what is left, as square as they can be."""
    total, cells = sum(values), []
    left = [v * w * h / total for v in values] if total > 0 else []
    while left:
        side = min(w, h)
        strip, left = (n := strip_length(left, side)) and left[:n], left[n:]
        depth, along = sum(strip) / side, 0.0
        for area in strip:
            cells.append((x, y + along, depth, area / depth) if side == h else (x + along, y, area / depth, depth))
            along += area / depth
        if side == h:
            x, w = x + depth, w - depth
        else:
            y, h = y + depth, h - depth
    return cells


def _treemap_sql() -> str:
    ratio = lambda row: f"greatest({row}[1] / pow(list_sum({row}) / side, 2), pow(list_sum({row}) / side, 2) / {row}[-1])"
    more = "list_append(strip, areas[i])"
    cell = lambda a: f"list_transform(range(1, len(strip) + 1), lambda k: {a})"
    along = "coalesce(list_sum(strip[1:k - 1]), 0) / depth"
    return f"""WITH RECURSIVE {P}, {LOC}, s AS (SELECT scan, section, CAST(sum(size) AS DOUBLE) AS size FROM loc GROUP BY ALL),
a AS (SELECT scan, list(section ORDER BY size DESC, section) AS names, list(size * 6000 / total ORDER BY size DESC, section) AS areas FROM (SELECT *, sum(size) OVER (PARTITION BY scan) AS total FROM s) GROUP BY scan),
r AS (SELECT scan, areas, 1 AS i, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y, CAST(100 AS DOUBLE) AS w, CAST(60 AS DOUBLE) AS h, CAST([] AS DOUBLE[]) AS strip, CAST([] AS DOUBLE[][]) AS cells FROM a
UNION ALL SELECT scan, areas, CASE WHEN takes THEN i + 1 ELSE i END, CASE WHEN takes OR w < h THEN x ELSE x + depth END, CASE WHEN takes OR w >= h THEN y ELSE y + depth END, CASE WHEN takes OR w < h THEN w ELSE w - depth END, CASE WHEN takes OR w >= h THEN h ELSE h - depth END, CASE WHEN takes THEN {more} ELSE [] END,
  CASE WHEN takes THEN cells WHEN w >= h THEN list_concat(cells, {cell(f'[x, y + {along}, depth, strip[k] / depth]')}) ELSE list_concat(cells, {cell(f'[x + {along}, y, strip[k] / depth, depth]')}) END
  FROM (SELECT *, coalesce(list_sum(strip), 0) / side AS depth, i <= len(areas) AND (len(strip) = 0 OR {ratio(more)} <= {ratio('strip')}) AS takes FROM (SELECT *, least(w, h) AS side FROM r) WHERE i <= len(areas) OR len(strip) > 0)),
f AS (SELECT r.scan, names, cells FROM r JOIN a USING (scan) WHERE len(cells) = len(a.areas))
SELECT scan, names[k] AS section, round(cells[k][1], 6) AS x, round(cells[k][2], 6) AS y, round(cells[k][3], 6) AS w, round(cells[k][4], 6) AS h FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM f)"""


@query("treemap_layout", _treemap_sql())
def treemap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a scan as cells of a 100 by 60 map. One row per section is all a group holds."""
    s = located(corpus.pages(spark, sf_dir)).groupBy("scan", "section").agg(F.sum("size").cast("double").alias("size"))

    def layout(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "section"], ascending=[False, True]).reset_index(drop=True)
        cells = squarified(pdf["size"].tolist(), 0.0, 0.0, 100.0, 60.0)
        return pdf[["scan", "section"]].assign(**{c: [round(r[i], 6) for r in cells] for i, c in enumerate("xywh")})

    return s.groupBy("scan").applyInPandas(layout, "scan string, section string, x double, y double, w double, h double")


#: The groups that are left: the site's own, then the defaults but for the one switched off.
GROUPS = [(0, "Mega menu", ".mega a,<<<broken"), *((i, n, ",".join(dom.CHROME[n])) for i, n in ((1, "nav"), (2, "header")))]


@query("chrome_groups", f"SELECT CAST(place AS BIGINT) AS place, name, selectors FROM {corpus.values(GROUPS)} t(place, name, selectors)")
def chrome_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups in force for a site with one group of its own and one default switched off."""
    groups = dom.chrome_groups([{"name": "Mega menu", "selectors": [".mega a", "<<<broken"]}, {"name": "Off", "selectors": ["x"], "enabled": False}], ("footer",))
    return spark.createDataFrame([(i, n, ",".join(s)) for i, (n, s) in enumerate(groups)], "place long, name string, selectors string")
