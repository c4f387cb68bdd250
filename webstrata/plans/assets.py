"""Assets of saved pages: references, stable names, offline rewriting, and the small formatters of reports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.plans.catalog import query
from webstrata.session import table
from webstrata.sources import corpus

PAGES = [
    ("https://s.example/p/index.html", '<link rel="stylesheet" href="/css/main.css?v=2"><link rel="canonical" href="/x"><link rel="icon" href="fav.ico"><img src="img/Photo One.png" srcset="img/a.png 1x, https://cdn.example/b.png 2x"><script src="https://cdn.example/app.js"></script><video poster="/v.jpg" src="data:video/mp4"></video><div style="background:url(\'/bg.png\')"></div><iframe src="/no.html"></iframe>'),
    ("https://s.example/q", '<img src="//cdn.example/c.webp"><img src="img/Photo One.png"><style>a{background:url(#frag)} b{background:url( "d/e.svg" )}</style>'),
]
P = f"apage AS (SELECT url, html FROM pages UNION ALL SELECT * FROM {corpus.values(PAGES)} t(url, html))"


def pages_with_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured pages, and two made-up ones with what these lack."""
    return table(spark, sf_dir, "pages").select("url", "html").union(spark.createDataFrame(PAGES, "url string, html string"))


# Where assets are named.
EXTRACTORS = [r"(?i)<(?:img|script|source|video|audio|embed)\b[^>]*?\ssrc\s*=\s*\x22([^\x22]+)\x22", r"(?i)<video\b[^>]*?\sposter\s*=\s*\x22([^\x22]+)\x22", r"(?i)url\(\s*[\x27\x22]?([^\x27\x22)]+)[\x27\x22]?\s*\)"]
SRCSET = r"(?i)\ssrcset\s*=\s*\x22([^\x22]+)\x22"
STYLED = r"stylesheet|icon|preload|apple-touch"


def resolve(D, raw: str, base: str) -> str:
    """A reference against its page's URL: absolute, scheme-relative, root-relative, or beside the page."""
    origin = D.ext(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)")
    folder = D.ext(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)")
    scheme = D.ext(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)")
    full = f"case when {D.like(raw, '(?i)^https?://')} then {raw} when {D.like(raw, '^//')} then concat({scheme}, {raw}) when {D.like(raw, '^/')} then concat({origin}, {raw}) else concat({folder}, {raw}) end"
    return f"replace({full}, ' ', '%20')"


def _refs(D) -> str:
    concat = "concat" if D.__name__ == "Spark" else "list_concat"
    split = "split" if D.__name__ == "Spark" else "string_split"
    links = D.map(D.keep(D.every("html", r"(?i)<link\b([^>]*?)>"), "a", D.like(f"lower({S.attribute(D, 'a', 'rel')})", STYLED)), "a", S.attribute(D, "a", "href"))
    sets = D.map(D.every("html", SRCSET), "s", D.map(f"{split}(s, ',')", "c", D.ext("trim(c)", r"^(\S+)")))
    parts = [*(D.every("html", p) for p in EXTRACTORS), links, f"flatten({sets})"]
    whole = parts[0]
    for p in parts[1:]:
        whole = f"{concat}({whole}, {p})"
    return D.map(whole, "r", S.trimmed(D, "r"))


_KEPT = "raw <> '' and not {d} and not {h}"


@query("asset_refs", f"WITH {P}, r AS (SELECT DISTINCT url, unnest({_refs(Duck)}) AS raw FROM apage) SELECT url, raw, {resolve(Duck, 'raw', 'url')} AS target FROM r WHERE {_KEPT.format(d=Duck.like('raw', '^data:'), h=Duck.like('raw', '^#'))}")
def asset_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page loads, each reference once."""
    p = pages_with_assets(spark, sf_dir)
    r = p.select("url", F.explode(F.expr(_refs(Spark))).alias("raw")).distinct().filter(F.expr(_KEPT.format(d=Spark.like("raw", "^data:"), h=Spark.like("raw", "^#"))))
    return r.select("url", "raw", F.expr(resolve(Spark, "raw", "url")).alias("target"))


CSS = [("https://s.example/css/main.css", "@import url('base.css'); @import \"more.css\"; a{background:url(../i/x.png)} b{background:url(data:abc)} c{background:url('/y.png')}")]


@query("css_refs", f"WITH c AS (SELECT * FROM {corpus.values(CSS)} t(url, css)), r AS (SELECT url, unnest(list_concat({Duck.every('css', EXTRACTORS[2])}, {Duck.every('css', r'(?i)@import' + chr(92) + r's+(?:url' + chr(92) + r'()?' + chr(92) + r's*[\x27\x22]([^\x27\x22]+)[\x27\x22]')})) AS raw FROM c) SELECT DISTINCT {resolve(Duck, 'trim(raw)', 'url')} AS target FROM r WHERE NOT starts_with(trim(raw), 'data:')")
def css_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url() and @import targets of a style sheet."""
    imports = r"(?i)@import\s+(?:url\()?\s*[\x27\x22]([^\x27\x22]+)[\x27\x22]"
    c = spark.createDataFrame(CSS, "url string, css string").select("url", F.explode(F.expr(f"concat({Spark.every('css', EXTRACTORS[2])}, {Spark.every('css', imports)})")).alias("raw"))
    return c.filter("not startswith(trim(raw), 'data:')").select(F.expr(resolve(Spark, "trim(raw)", "url")).alias("target")).distinct()


# File endings by content type.
ENDINGS = {"text/css": ".css", "text/javascript": ".js", "application/javascript": ".js", "image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/webp": ".webp", "image/svg+xml": ".svg", "image/x-icon": ".ico", "font/woff2": ".woff2", "font/woff": ".woff", "font/ttf": ".ttf"}
NAMED = [("https://s.example/load.php?only=styles", "text/css; charset=utf-8"), ("https://s.example/a/Photo%20One.PNG", ""), ("https://s.example/", "image/png"), ("https://s.example/font", "font/woff2"), ("https://s.example/x.tar.gz", "application/x-gzip")]


def _stem(D) -> str:
    base = D.ext(S.pathname(D, "url"), "([^/]*)/*$")
    return f"{'substring' if D.__name__ == 'Spark' else 'substr'}({D.rep(f'''case when {base} = '' then 'asset' else {base} end''', '(?i)[^a-z0-9._-]+', '-')}, 1, 60)"


def _name(D) -> str:
    stem = _stem(D)
    own = D.ext(stem, r"[^.](\.[^.]*)$")
    kind = "lower(trim(split_part(content_type, ';', 1)))"
    typed = f"case {kind} " + " ".join(f"when '{k}' then '{v}'" for k, v in ENDINGS.items()) + " else '' end"
    sub = "substring" if D.__name__ == "Spark" else "substr"
    bare = f"{sub}({stem}, 1, cast(length({stem}) - length({own}) as int))"
    return f"concat(case when {bare} = '' then 'asset' else {bare} end, '-', {sub}(sha1(url), 1, 10), case when {typed} <> '' then {typed} else {own} end)"


@query("asset_names", f"SELECT url, {_name(Duck)} AS name FROM {corpus.values(NAMED)} t(url, content_type)")
def asset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A readable stem, a hash of the URL, and the ending its content type asks for."""
    return spark.createDataFrame(NAMED, "url string, content_type string").select("url", F.expr(_name(Spark)).alias("name"))


def _image(D) -> str:
    return D.rep(D.rep("lower(src)", "^https?://", ""), "[^a-z0-9.]+", "-")


@query("image_names", f"WITH {P} SELECT DISTINCT src, {_image(Duck)} AS name FROM (SELECT unnest({Duck.every('html', EXTRACTORS[0])}) AS src FROM apage) WHERE regexp_matches(src, '^https?://')")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages_with_assets(spark, sf_dir)
    return p.select(F.explode(F.expr(Spark.every("html", EXTRACTORS[0]))).alias("src")).filter(F.col("src").rlike("^https?://")).distinct().select("src", F.expr(_image(Spark)).alias("name"))


def escaped(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("chr(39)", "&#39;")):
        e = f"replace({e}, {a if a.startswith('chr') else chr(39) + a + chr(39)}, '{b}')"
    return e


@query("escape_html", f"SELECT item_id, {escaped('coalesce(text, chr(39) || chr(60))')} AS escaped FROM benchmark UNION ALL SELECT -1, {escaped('chr(60) || chr(97) || chr(39) || chr(38)')}")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id"), F.expr(escaped("coalesce(text, '<')")).alias("escaped"))
    return b.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("item_id"), F.expr(escaped("concat('<a', chr(39), '&')")).alias("escaped")))


def _size(D) -> str:
    """Tenths in whole numbers, half up, so that no engine's formatting decides."""
    whole = (lambda t: f"cast({t} div 10 as string)") if D.__name__ == "Spark" else (lambda t: f"cast({t} // 10 as varchar)")
    tenth = (lambda t: f"cast({t} % 10 as string)") if D.__name__ == "Spark" else (lambda t: f"cast({t} % 10 as varchar)")
    shown = lambda unit, name: f"concat({whole(t(unit))}, '.', {tenth(t(unit))}, ' {name}')"
    t = lambda unit: f"cast(floor(size * 10 / {unit}.0e0 + 0.5) as bigint)"
    return f"case when size < 1024 then concat(cast(size as varchar(20)), ' B') when size < 1048576 then {shown(1024, 'KB')} else {shown(1048576, 'MB')} end"


@query("fmt_size", f"WITH s AS (SELECT page_id, CAST(strlen(html) AS BIGINT) * 50 AS size FROM pages) SELECT page_id, {_size(Duck)} AS shown FROM s")
def fmt_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", (F.octet_length("html").cast("long") * 50).alias("size")).select("page_id", F.expr(_size(Spark)).alias("shown"))



@query("output_folders", f"SELECT url, concat('output/', CASE WHEN {S.host(Duck, 'url')} = '' THEN 'unknown' ELSE {S.host(Duck, 'url')} END, '/2026-08-01') AS folder FROM (SELECT url FROM pages UNION ALL SELECT 'nonsense')")
def output_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a scan is kept."""
    u = table(spark, sf_dir, "pages").select("url").union(spark.range(1).select(F.lit("nonsense")))
    host = F.expr(S.host(Spark, "url"))
    return u.select("url", F.concat(F.lit("output/"), F.when(host == "", "unknown").otherwise(host), F.lit("/2026-08-01")).alias("folder"))


# What a rewritten page may load, and the hints that would reach out before that.
POLICY = "<meta http-equiv=\"Content-Security-Policy\" content=\"default-src 'self' data: blob: 'unsafe-inline' 'unsafe-eval'; img-src 'self' data: blob:; media-src 'self' data: blob:; font-src 'self' data:; style-src 'self' data: 'unsafe-inline'; script-src 'self' data: 'unsafe-inline' 'unsafe-eval'; connect-src 'none'; frame-src 'none'; form-action 'none'\">"
HINTS = r"(?i)<link\b[^>]*rel\s*=\s*\x22(?:preconnect|dns-prefetch|prefetch|prerender)\x22[^>]*>"
HEAD = r"(?i)(<head[^>]*>)"
#: What the fetches of the made-up pages' assets recorded; others came without a type.
TYPES = [("https://cdn.example/c.webp", "image/webp"), ("https://s.example/d/e.svg", "image/svg+xml; charset=utf-8")]


def offline(html: str, names: dict[str, str]) -> str:
    """References replaced where they are a whole value, longest first; a policy first in the head; hints taken out."""
    for raw in sorted(names, key=lambda r: (-len(r), r)):
        whole = re.compile(rf"(?<=[\x22\x27(,\s]){re.escape(raw)}(?=[\x22\x27)\s,>])")
        html = whole.sub(lambda _, to=names[raw]: to, html)
    headed, n = re.subn(HEAD, lambda m: f"{m[1]}\n{POLICY}", html, count=1)
    return re.sub(HINTS, "", headed if n else f"{POLICY}\n{html}")


def _local(D) -> str:
    return f"concat('_assets/', {_name(D)})"


_ESCAPED = r"regexp_replace(raw, '([.*+?^${}()|\[\]\\])', '\\\1', 'g')"


@query(
    "offline_rewrite",
    rf"""WITH RECURSIVE {P}, r AS (SELECT DISTINCT url, unnest({_refs(Duck)}) AS raw FROM apage), k AS (SELECT url AS page, raw, {resolve(Duck, 'raw', 'url')} AS url FROM r WHERE {_KEPT.format(d=Duck.like('raw', '^data:'), h=Duck.like('raw', '^#'))}),
m AS (SELECT page, raw, {_local(Duck)} AS local, row_number() OVER (PARTITION BY page ORDER BY length(raw) DESC, raw) AS i FROM (SELECT k.*, coalesce(t.content_type, '') AS content_type FROM k LEFT JOIN {corpus.values(TYPES)} t(url, content_type) USING (url))),
w AS (SELECT url, html, 0 AS i FROM apage UNION ALL SELECT w.url, regexp_replace(w.html, concat('([\x22\x27(,\s])', {_ESCAPED}, '([\x22\x27)\s,>])'), concat('\1', m.local, '\2'), 'g'), w.i + 1 FROM w JOIN m ON m.page = w.url AND m.i = w.i + 1),
z AS (SELECT url, arg_max(html, i) AS html FROM w GROUP BY url)
SELECT url, regexp_replace(CASE WHEN regexp_matches(html, '{HEAD}') THEN regexp_replace(html, '{HEAD}', concat('\1', chr(10), '{POLICY.replace("'", "''")}')) ELSE concat('{POLICY.replace("'", "''")}', chr(10), html) END, '{HINTS}', '', 'g') AS html FROM z""",
)
def offline_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = asset_refs(spark, sf_dir)
    refs = refs.join(asset_names_of(spark, refs), "target").groupBy("url").agg(F.map_from_entries(F.collect_list(F.struct("raw", "local"))).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"url": b["url"], "html": [offline(h or "", dict(n or {})) for h, n in zip(b["html"], b["names"], strict=True)]})

    # Of pages with one URL the first one stands, the made-up ones last.
    first = F.min_by("html", F.struct(F.col("html").isNull(), F.col("page_id").isNull(), "page_id", "html")).alias("html")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(PAGES, "url string, html string"), allowMissingColumns=True)
    return pages.groupBy("url").agg(first).join(refs, "url", "left").select("url", "html", "names").mapInPandas(run, "url string, html string")


def asset_names_of(spark: SparkSession, refs: DataFrame) -> DataFrame:
    """target, local: the file that a reference's target was saved as, by the type its fetch recorded."""
    types = spark.createDataFrame(TYPES, "url string, content_type string")
    named = refs.select(F.col("target").alias("url")).distinct().join(F.broadcast(types), "url", "left").na.fill("", ["content_type"])
    return named.select(F.col("url").alias("target"), F.expr(_local(Spark)).alias("local"))


WCAG = [("a.html", "image-alt", 3), ("a.html", "label", 1), ("b.html", "image-alt", 2)]


@query("audit_summary", f"SELECT page, CAST(count(*) AS BIGINT) AS violations, CAST(sum(nodes) AS BIGINT) AS nodes FROM {corpus.values(WCAG)} t(page, rule, nodes) GROUP BY page")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations and elements per page of a recorded accessibility audit."""
    return spark.createDataFrame(WCAG, "page string, rule string, nodes long").groupBy("page").agg(F.count(F.lit(1)).alias("violations"), F.sum("nodes").alias("nodes"))
