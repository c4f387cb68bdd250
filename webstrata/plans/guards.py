"""What a request may ask for: options and their defaults, edits of jobs, scan paths, targets, live excludes, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import extract as X
from webstrata.plans import access
from webstrata.plans.catalog import query
from webstrata.session import table
from webstrata.sources import corpus

P = corpus.pages_sql()


def chosen(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


def taken(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*(F.expr(e).alias(c) for c, e in columns.items()))


#: Parameters as they come in, all text: (id, rate_limit, max_depth, path_prefix, concurrency, max_pages, screenshot, download_images, offline, cookies).
PARAMS = [
    ("none", None, None, None, None, None, None, None, None, None),
    ("zero", "0", "0", "", "0", "0", "false", "no", "false", "false"),
    ("given", "250", "5", "/help", "4", "20", "true", "true", "true", "true"),
    ("odd", "fast", "deep", None, "-2", "1.5", "TRUE", "1", "yes", None),
    ("empty", "", "", None, "", "", "", "", "", ""),
]
NAMES = ["id", "rate_limit", "max_depth", "path_prefix", "concurrency", "max_pages", "screenshot", "download_images", "offline", "cookies"]
#: What holds where nothing usable is asked for.
RATE, DEPTH = 1000, 2


def option_columns() -> dict[str, str]:
    """Numbers as numbers, an explicit depth 0 kept, flags true only as ``true``, offline copies unless declined."""
    number = lambda c: f"try_cast({c} as double)"
    flag = lambda c, default: f"case when {c} is null then {default} else {c} = 'true' end"
    positive = lambda c: f"case when {number(c)} > 0 then {number(c)} end"
    return {
        "id": "id",
        "rate_limit": f"coalesce(nullif({number('rate_limit')}, cast(0 as double)), cast({RATE} as double))",
        "max_depth": f"case when max_depth <> '' then coalesce({number('max_depth')}, cast({DEPTH} as double)) else cast({DEPTH} as double) end",
        "path_prefix": "nullif(path_prefix, '')",
        "concurrency": positive("concurrency"),
        "max_pages": positive("max_pages"),
        "screenshot": flag("screenshot", "false"),
        "download_images": flag("download_images", "false"),
        "offline": flag("offline", "true"),
        "cookie_dismissal": flag("cookies", "true"),
    }


@query("run_options", f"SELECT {chosen(option_columns())} FROM {corpus.values(PARAMS)} t({', '.join(NAMES)})")
def run_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.createDataFrame(PARAMS, ", ".join(f"{n} string" for n in NAMES)), option_columns())


#: Edits of queued jobs; null where a field isn't in the request. ``url`` may not be edited.
EDITS = [("a", "500", None, None, None, None), ("b", None, "3", "true", "no", None), ("c", "slow", None, None, None, None), ("d", None, None, None, None, "https://x.example/"), ("e", "", "1e2", "false", "true", "https://x.example/"), ("f", "2", "none", None, None, None)]
EDIT_NAMES = ["id", "rate_limit", "max_depth", "screenshot", "download_images", "url"]


def edit_columns() -> dict[str, str]:
    """four fields may be edited; numbers must be numbers (an empty one is 0)."""
    number = lambda c: f"case when trim({c}) = '' then cast(0 as double) else try_cast({c} as double) end"
    bad = " or ".join(f"({c} is not null and {number(c)} is null)" for c in ("rate_limit", "max_depth"))
    nothing = " and ".join(f"{c} is null" for c in EDIT_NAMES[1:5])
    status = f"case when {nothing} then 400 when {bad} then 400 else 200 end"
    only = lambda e: f"case when {status} = 200 then {e} end"
    return {"id": "id", "status": status, "rate_limit": only(number("rate_limit")), "max_depth": only(number("max_depth")), "screenshot": "coalesce(screenshot = 'true', false)", "download_images": "coalesce(download_images = 'true', false)"}


@query("job_edits", f"SELECT {chosen(edit_columns())} FROM {corpus.values(EDITS)} t({', '.join(EDIT_NAMES)})")
def job_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.createDataFrame(EDITS, ", ".join(f"{n} string" for n in EDIT_NAMES)), edit_columns())


ROOT = "/srv/output"
ASKED = ["bank.example/2026-07-01", "../secrets", "bank.example/../../etc/passwd", "", ".", "/etc/passwd", "/srv/output/x", "/srv/outputs/x", "a/./b//c/", "a/b/../c", "..%2f..", "../output/y"]


def scan_path(D) -> str:
    """a scan's folder below the root, or null where the name leads out of it."""
    whole = S.dot_free(D, f"case when scan like '/%' then scan else concat('{ROOT}/', scan) end")
    return f"case when {whole} = '{ROOT}' or {whole} like '{ROOT}/%' then {whole} end"


@query("scan_paths", f"WITH s AS (SELECT * FROM {corpus.values([(a,) for a in ASKED])} t(scan) UNION ALL SELECT concat({S.host(Duck, 'url')}, '/../', {S.host(Duck, 'url')}, '/2026-08-01') FROM pages) SELECT scan, {scan_path(Duck)} AS folder FROM s")
def scan_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.expr(S.host(Spark, "url"))
    s = spark.createDataFrame([(a,) for a in ASKED], "scan string").union(table(spark, sf_dir, "pages").select(F.concat(host, F.lit("/../"), host, F.lit("/2026-08-01"))))
    return s.select("scan", F.expr(scan_path(Spark)).alias("folder"))


TARGETS = [("https://good.example/a",), ("http://mixed.example/",), ("ftp://good.example/x",), ("file:///etc/passwd",), ("nonsense",), ("http://10.0.0.8/admin",), ("https://8.8.8.8/",), ("https://nowhere.example/",), ("http://[::1]/",)]
LOOKUP = [("good.example", "8.8.8.8"), ("good.example", "1.1.1.1"), ("mixed.example", "8.8.4.4"), ("mixed.example", "192.168.0.9")]


def blocked(D, ip: str) -> str:
    v4 = access._V4
    part = lambda n: f"try_cast({D.ext(ip, v4, n)} as int)"
    return f"case when {D.like(ip, v4)} then {access._blocked(part(1), part(2))} else {ip} in ('::', '::1') or {D.like(ip, '^(?:fe80|fc|fd)')} end"


def verdict(D) -> str:
    """protocol, then a literal address, then all that the name resolves to."""
    literal = f"({D.like('host', r'^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$')} or {D.like('host', '^[0-9a-f:]*:[0-9a-f:.]*$')})"
    return f"case when scheme = '' then 'not a URL' when scheme not in ('http', 'https') then 'protocol' when {literal} then case when {blocked(D, 'host')} then 'private address' else 'allowed' end when answers = 0 then 'does not resolve' when hidden > 0 then 'private address' else 'allowed' end"


def target_columns(D) -> dict[str, str]:
    host = D.rep(D.rep(D.ext("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"), r"^\[", ""), r"\]$", "")
    return {"url": "url", "scheme": f"lower({D.ext('url', '^([a-zA-Z][a-zA-Z0-9+.-]*):')})", "host": f"lower({host})"}


@query("scrape_targets", f"WITH t AS (SELECT {chosen(target_columns(Duck))} FROM (SELECT * FROM {corpus.values(TARGETS)} t(url) UNION ALL SELECT url FROM pages)), l AS (SELECT host, count(*) AS answers, count(*) FILTER (WHERE {blocked(Duck, 'ip')}) AS hidden FROM {corpus.values(LOOKUP)} t(host, ip) GROUP BY host), j AS (SELECT t.*, coalesce(answers, 0) AS answers, coalesce(hidden, 0) AS hidden FROM t LEFT JOIN l USING (host)) SELECT url, {verdict(Duck)} AS verdict FROM j")
def scrape_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = taken(spark.createDataFrame(TARGETS, "url string").union(table(spark, sf_dir, "pages").select("url")), target_columns(Spark))
    found = spark.createDataFrame(LOOKUP, "host string, ip string").groupBy("host").agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.expr(blocked(Spark, "ip"))).alias("hidden"))
    return t.join(found, "host", "left").na.fill(0, ["answers", "hidden"]).select("url", F.expr(verdict(Spark)).alias("verdict"))


EXCLUDES = ["/en/", "es/12", " /old.html ", "/bad path", "/a?b=1", "", "/" + "x" * 301, "//fr//"]


def exclude_columns(D) -> dict[str, str]:
    """F16: trimmed, one slash before and none after; only simple paths are taken."""
    norm = f"concat('/', {D.rep('trim(raw)', '^/+|/+$', '')})"
    return {"raw": "raw", "path": norm, "valid": f"trim(raw) <> '' and {D.like(norm, r'^/[A-Za-z0-9_./%-]{0,300}$')}"}


@query("exclude_paths", f"SELECT {chosen(exclude_columns(Duck))} FROM {corpus.values([(e,) for e in EXCLUDES])} t(raw)")
def exclude_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.createDataFrame([(e,) for e in EXCLUDES], "raw string"), exclude_columns(Spark))


@query("live_excludes", f"WITH x AS (SELECT path FROM (SELECT {chosen(exclude_columns(Duck))} FROM {corpus.values([(e,) for e in EXCLUDES])} t(raw)) WHERE valid) SELECT page_id, EXISTS (SELECT 1 FROM x WHERE {S.pathname(Duck, 'url')} = x.path OR starts_with({S.pathname(Duck, 'url')}, x.path || '/')) AS excluded FROM pages")
def live_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages that the excludes in force would keep from being queued or, queued already, from being fetched. A few excludes, all sent along."""
    x = exclude_paths(spark, sf_dir).filter("valid").select("path")
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(S.pathname(Spark, "url")).alias("at"))
    hit = p.join(F.broadcast(x), (F.col("at") == F.col("path")) | F.col("at").startswith(F.concat("path", F.lit("/"))), "left_semi").select("page_id", F.lit(True).alias("_x"))
    return p.join(hit, "page_id", "left").select("page_id", F.col("_x").isNotNull().alias("excluded"))


@query("same_host_links", f"WITH {P}, {X.links_sql()} SELECT scan, pid, CAST(count(*) FILTER (WHERE {S.host(Duck, 'href')} = {S.host(Duck, 'url')}) AS BIGINT) AS same_host, CAST(count(*) FILTER (WHERE {S.host(Duck, 'href')} <> {S.host(Duck, 'url')}) AS BIGINT) AS other_host FROM link WHERE kind = 'page' GROUP BY ALL")
def same_host_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: links that stay on their page's host."""
    same = F.expr(f"{S.host(Spark, 'href')} = {S.host(Spark, 'url')}")
    return X.links(corpus.pages(spark, sf_dir)).filter("kind = 'page'").groupBy("scan", "pid").agg(F.count_if(same).alias("same_host"), F.count_if(~same).alias("other_host"))


def folder_columns(D) -> dict[str, str]:
    """The path of a URL (the text itself where it is none) and the folder that an exclude of it would name."""
    path = f"case when not {D.like('url', S.URL_HOST)} then url when {S.pathname(D, 'url')} = '' then '/' else {S.pathname(D, 'url')} end"
    folder = D.ext(D.rep(f"({path})", "/+$", ""), "^(.+)/[^/]*$")
    return {"url": "url", "path": path, "folder": f"case when {folder} = '' then '/' else {folder} end"}


@query("url_folders", f"SELECT {chosen(folder_columns(Duck))} FROM (SELECT url FROM pages UNION ALL SELECT * FROM (VALUES ('no url'), ('https://h.example'), ('https://h.example/a/b/c//'), ('a/b')) t(url))")
def url_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = spark.createDataFrame([("no url",), ("https://h.example",), ("https://h.example/a/b/c//",), ("a/b",)], "url string")
    return taken(table(spark, sf_dir, "pages").select("url").union(odd), folder_columns(Spark))


def shown_columns(D) -> dict[str, str]:
    """A page's path below its site, and the link to its details, escaped as browsers do."""
    code = "url_encode(path)"
    for raw, char in (("+", "'%20'"), ("%7E", "'~'"), ("%21", "'!'"), ("%27", "chr(39)"), ("%28", "'('"), ("%29", "')'"), ("%2A", "'*'")):
        code = f"replace({code}, '{raw}', {char})"
    return {"scan": "scan", "pid": "pid", "site_path": f"concat('/', {D.ext('path', '^[^/]*/(.*)$')})", "href": f"concat('/page.html?scan=', scan, '&path=', {code})"}


@query("page_hrefs", f"WITH {P} SELECT {chosen(shown_columns(Duck))} FROM page")
def page_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(corpus.pages(spark, sf_dir), shown_columns(Spark))


SOURCES = ["en/12", "/es/", "loans/personal.html", "index"]


def is_source(D) -> str:
    """a page named outright, below a named folder, or named without its ending; no name, no source."""
    rel = D.ext("path", "^[^/]*/(.*)$")
    bare = lambda e: D.rep(e, "(?i)[.]html?$", "")
    starts = "startswith" if D.__name__ == "Spark" else "starts_with"
    one = lambda p: f"{rel} = '{p}' or {starts}({rel}, '{p.rstrip('/')}/') or {bare(rel)} = {bare(repr(p))}"
    return " or ".join(one(p.lstrip("/")) for p in SOURCES) or "false"


@query("qa_sources", f"WITH {P} SELECT scan, pid, path FROM page WHERE {is_source(Duck)}")
def qa_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.pages(spark, sf_dir).filter(is_source(Spark)).select("scan", "pid", "path")


#: What a scan's folder holds, as a recursive listing names it.
HELD = [("bank.example/2026-07-01", p) for p in ("bank.example/index.html", "bank.example/_assets/frame.html", "bank.example/images/a.HTML", "bank.example/notes.htm", "all-links.txt", "images\\logo.png")]


def listed_columns(D) -> dict[str, str]:
    """SRC5, SRC16: every file of a scan by its path below the output, slashes forward; the audit takes all .html files, assets too."""
    return {"file": "concat(scan, '/', replace(path, chr(92), '/'))", "audited": D.like("path", r"[.]html$")}


@query("scan_files", f"SELECT {chosen(listed_columns(Duck))} FROM {corpus.values(HELD)} t(scan, path)")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.createDataFrame(HELD, "scan string, path string"), listed_columns(Spark))


#: Settings by environment, and what holds without them.
SETTINGS = [("DS_MAX_ANALYZED_PAGES", 5000), ("DS_MAX_TRACKED_LINKS", 100000), ("DS_CRAWL_CONCURRENCY", 3), ("DS_PAGE_TIMEOUT_MS", 30000), ("DS_JOB_TIMEOUT_MINUTES", 60)]
ENVIRONMENT = [("DS_CRAWL_CONCURRENCY", "6"), ("DS_PAGE_TIMEOUT_MS", "soon"), ("DS_JOB_TIMEOUT_MINUTES", "0")]


@query("settings", f"SELECT s.name, CAST(coalesce(nullif(try_cast(e.value AS BIGINT), 0), s.fallback) AS BIGINT) AS value FROM {corpus.values(SETTINGS)} s(name, fallback) LEFT JOIN {corpus.values(ENVIRONMENT)} e(name, value) USING (name)")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from the environment, or the default where there is none or it is 0."""
    s, e = spark.createDataFrame(SETTINGS, "name string, fallback long"), spark.createDataFrame(ENVIRONMENT, "name string, value string")
    return s.join(e, "name", "left").select("name", F.expr("coalesce(nullif(try_cast(value as bigint), 0L), fallback)").alias("value"))


def resolving(D) -> list[dict[str, str]]:
    """A link against its page, in steps: its parts; its path against the page's; dot segments out; spaces escaped."""
    scheme = "^([a-zA-Z][a-zA-Z0-9+.-]*):"
    return [
        {"way": f"case when {D.like('href', scheme)} then 'own' when href like '//%' then 'host' when href like '/%' then 'root' when href like '#%' then 'part' when href like '?%' then 'query' else 'near' end", "origin": D.ext("url", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"), "page_path": f"case when {S.pathname(D, 'url')} = '' then '/' else {S.pathname(D, 'url')} end", "page_query": D.ext("url", r"^[^?#]*(\?[^#]*)")},
        {"whole": f"case way when 'own' then href when 'host' then concat({D.ext('url', scheme)}, ':', href) when 'root' then concat(origin, href) when 'part' then concat(origin, page_path, page_query, href) when 'query' then concat(origin, page_path, href) else concat(origin, {D.rep('page_path', '[^/]*$', '')}, href) end"},
        {"base": D.ext("whole", "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)"), "named": f"case when {S.pathname(D, 'whole')} = '' then '/' else {S.pathname(D, 'whole')} end", "more": D.ext("whole", "^[^?#]*(.*)$")},
        {"target": f"case when base = '' then whole else concat(lower(base), replace(concat({S.dot_free(D, 'named')}, case when {D.like('named', '(?:^|/)[.]{0,2}$')} then '/' else '' end), ' ', '%20'), replace(more, ' ', '%20')) end"},
    ]


ODD = [(1, "https://o.example/a/b/page?q=1#f", h) for h in ("../c", "./d/./e/../f", "../../../../g", "?r=2", "#s", "//cdn.example/x/../y", "h i.html", "/k/../l/", "HTTPS://O.example/M/./n", "mailto:x@o.example", "p/..", ".")]


def _resolved_sql() -> str:
    rows = f"SELECT pid, url, href FROM link UNION ALL SELECT CAST(pid AS BIGINT), url, href FROM {corpus.values(ODD)} t(pid, url, href)"
    for step in resolving(Duck):
        rows = f"SELECT *, {chosen(step)} FROM ({rows})"
    return f"WITH {P}, {X.links_sql()} SELECT pid, url, href, target FROM ({rows})"


@query("links_resolved", _resolved_sql())
def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.links(corpus.pages(spark, sf_dir)).select("pid", "url", "href").unionByName(spark.createDataFrame(ODD, "pid long, url string, href string"))
    for step in resolving(Spark):
        rows = rows.select("*", *(F.expr(e).alias(c) for c, e in step.items()))
    return rows.select("pid", "url", "href", "target")
