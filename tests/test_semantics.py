"""What the analyses have to say about small sites, stated by hand."""

import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Spark
from webstrata.jobs import Queue
from webstrata.operators import dom
from webstrata.operators import extract as X
from webstrata.plans import access, assets, crawl, dashboard, documents, findings, graph, rating
from webstrata.plans.catalog import CATALOG
from webstrata.sources import captures, corpus
from webstrata.streaming import ingest


def pages_of(spark, *rows):
    df = spark.createDataFrame(list(rows), "scan string, pid long, url string, html string")
    return df.select("scan", "pid", "url", F.expr(S.page_path(Spark, "url")).alias("path"), "html", F.octet_length("html").cast("long").alias("size"))


def one(spark, sql):
    return spark.sql(f"select {sql}").first()[0]


@pytest.mark.parametrize(
    ("url", "path"),
    [
        ("https://A.example/", "a.example/index.html"),
        ("https://a.example", "a.example/index.html"),
        ("https://a.example/x/", "a.example/x.html"),
        ("https://a.example/x.htm?y=1#z", "a.example/x.htm"),
        ("not a url", None),
    ],
)
def test_page_path(spark, url, path):
    assert one(spark, S.page_path(Spark, f"'{url}'")) == path


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("https://a.example/p/?utm_source=x&b=2&a=1#t", "https://a.example/p?a=1&b=2"),
        ("https://a.example/?gclid=1", "https://a.example/"),
        ("https://a.example/p?page=2", "https://a.example/p?page=2"),
    ],
)
def test_normal_url(spark, url, normal):
    assert one(spark, S.normal_url(Spark, f"'{url}'")) == normal


def test_phone_format_is_no_conflict(spark):
    p = pages_of(spark, ("s", 1, "https://s.example/", "<p>0800 111 2222</p>"), ("s", 2, "https://s.example/b", "<p>0800 1112222 and +44 800 111 2222</p>"))
    none = spark.createDataFrame([], "scan string, url string")
    files = spark.createDataFrame([("x", "robots.txt", None), ("x", "llms.txt", None)], "scan string, name string, text string")
    ids = {r.id for r in findings.report(p, none, files).collect()}
    assert "contradictory-phone-numbers" not in ids


def test_findings_of_the_loan_site(spark):
    got = {r.id: r for r in findings.site_report(spark, "/root/testdata/sf0.001").filter("scan = 'loans.example'").collect()}
    assert got["contradictory-phone-numbers"].severity == "medium"
    assert got["contradictory-postcodes"].pages_affected == 2
    assert got["duplicate-titles"].pages_affected == 2 and got["duplicate-titles"].severity == "high"
    assert got["missing-h1"].pages_affected == 1 and got["multiple-h1"].pages_affected == 1
    assert got["noindex-pages"].pages_affected == 1 and got["canonical-conflicts"].pages_affected == 1
    assert got["invalid-structured-data"].pages_affected == 1
    assert got["organization-name-conflict"].severity == "high"
    assert got["access-blanket-disallow"].pages_affected == 999999
    assert "no-structured-data" not in got


def test_findings_of_the_trio(spark):
    got = {r.id: r for r in findings.site_report(spark, "/root/testdata/sf0.001").filter("scan = 'trio.example'").collect()}
    assert got["temporal-stale-copyright"].pages_affected == 2
    assert got["temporal-mixed-copyright-years"].pages_affected == 3
    assert got["jsonld-page-phone-mismatch"].pages_affected == 1
    assert got["inconsistent-sameas"].pages_affected == 2


def test_pages_are_stripped_once(spark):
    """Profile, facts and copyright year share one text; what each says is the same as alone."""
    rows = [("s", 1, "https://a.example/", "a", "<script>x</script><p>Ring&nbsp;0800 111\u00a02222 &AMP; \u3000 a&amp;b.\u2003\ufeff</p>© 2019 <img alt='0141 555 0192'>" + " \n" * 20000), ("s", 2, "u", "b", "plain"), ("s", 3, "v", "c", None)]
    pages = spark.createDataFrame(rows, "scan string, pid long, url string, path string, html string")
    read = findings.stated(pages)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"html#\d+, \(\?i\)<script\[", plan)) == 1
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(X.listed(read), X.facts(pages)) and X.listed(read).count() == 1
    assert same(read.select(*X.KEY, *X.PROFILE), X.profile(pages))
    assert same(read.filter("year is not null").select("scan", "pid", "path", "year"), findings.content.dated(pages))
    shown = pages.select(F.expr(S.shown(Spark, S.extract_text(Spark, "html"))).alias("a"), F.expr(S.visible_text(Spark, "html")).alias("b"))
    assert shown.filter("not (a <=> b)").count() == 0 and shown.first().b.startswith("Ring 0800 111 2222 & a&b. © 2019")


def test_ratings(spark):
    v2 = {r.scan: r for r in rating.rating(rating.found(spark), 2).collect()}
    assert v2["half.example"].score == v2["half.big.example"].score
    assert v2["worst.example"].worst_pillar == "facts"
    p = {(r.scan, r.pillar): r for r in rating.pillars(rating.found(spark), 2).collect()}
    assert p["worst.example", "facts"].score == 0
    for version in (2, 3):
        lost = {(r.scan, r.pillar): r.lost for r in rating.pillars(rating.found(spark), version).collect() if r.findings}
        dealt: dict = {}
        for r in rating.attribution(rating.found(spark), version).collect():
            dealt[r.scan, r.pillar] = dealt.get((r.scan, r.pillar), 0) + r.points
        assert {k: round(v, 1) for k, v in dealt.items()} == {k: float(v) for k, v in lost.items()}


def test_inbound_edges(spark):
    p = pages_of(
        spark,
        ("s", 1, "https://s.example/", '<a href="https://s.example/d">Deals</a>'),
        ("s", 2, "https://s.example/h", '<a href="https://s.example/d">Deals</a><a href="https://s.example/d#t" rel="nofollow">Top</a><a href="https://s.example/h">self</a>'),
        ("s", 3, "https://s.example/d", "<a href='https://s.example/'>Home</a><a href=unquoted>no</a>"),
    )
    e = {(r.path, r.target): r for r in graph.edges(p).collect()}
    assert set(e) == {("s.example/index.html", "s.example/d.html"), ("s.example/h.html", "s.example/d.html"), ("s.example/d.html", "s.example/index.html")}
    both = e["s.example/h.html", "s.example/d.html"]
    assert both.occurrences == 2 and both.nofollow is False and both.texts == ["Deals", "Top"]


def test_crawl_rules(spark):
    got = {r.url: r.depth for r in crawl.site_crawl(spark).collect()}
    site = crawl.SITE
    assert got == {f"{site}/": 0, f"{site}/a": 1, f"{site}/b": 1, f"{site}/missing": 1, f"{site}/c": 2}


def test_scope(spark):
    rows = {r.url: r.in_scope for r in crawl.crawl_scope(spark, "").collect()}
    inside = {u.removeprefix(crawl.SITE) for u, ok in rows.items() if ok}
    assert inside == {"/help", "/help/topics", "/blog/post?x=1"}


def test_robots():
    assert access.parse("User-agent: a\nUser-agent: b\nDisallow: /\nUser-agent: c\nDisallow:")["c"] == [("disallow", "")]
    assert access.parse("User-agent: A # x\nAllow: /p:q")["a"] == [("allow", "/p:q")]


def test_regions():
    html = '<header><nav><a href="/n">N</a></nav><a href="/h">H</a></header><main><a href="/m">M</a></main><div class="site-footer"><nav><a href="/f">F</a></nav><a href="/g">G</a></div>'
    assert [r[3] for r in dom.regions(html)] == ["nav", "header", "content", "nav", "footer"]
    own = dom.chrome_groups([{"name": "Mine", "selectors": ["<<<", "main a"]}])
    assert dom.regions(html, own)[2][3] == "Mine"


def test_questions():
    pairs = dom.questions(documents.FAQ[0][3])
    assert [p[0] for p in pairs] == ["jsonld", "details", "dl", "heading", "heading"]
    assert pairs[0][2:] == ("How much is it?", "It is free of charge.")
    assert pairs[-1][3] == "In a town by the sea, near the harbour. Second part."
    ruled = dom.questions("<div class=q>A?</div><div class=a>B</div>", [{"question": ".q", "answer": ".a"}])
    assert ruled == [("rule", 0, "A?", "B")]


def test_chunks():
    got = dom.chunks("<nav>x</nav><h1>T</h1><p>" + "word " * 20 + "</p><h2>Short</h2><p>no</p><footer>f</footer>")
    assert [(c[1], c[2][:9]) for c in got] == [("T", "word word")]
    assert dom.chunks("<body>" + "plain " * 10 + "</body>")[0][1] is None


def test_chunks_and_answers_are_whole():
    """No text below a heading ends early, however long it is."""
    long = "word " * 2000 + "end"
    assert dom.chunks(f"<h1>T</h1><p>{long}</p>")[0][2] == long
    assert dom.chunks(f"<body>{long}</body>")[0][2] == long
    assert len(documents._chunks_sql().split("substr(")) == 1
    asked = f"<details><summary>Q?</summary>{long}</details><dl><dt>Why?</dt><dd>{long}</dd></dl><h2>Why?</h2><p>{long}</p>"
    ruled = dom.questions(asked, [{"container": "dl", "question": "dt", "answer": "dd"}])
    assert [(p[0], p[3] == long) for p in ruled] == [(e, True) for e in ("details", "dl", "heading", "rule")]


def test_chunks_keep_references_without_semicolon():
    html = "<h1>One&amp; two&amp</h1><p>" + "word " * 10 + "&lt;b&gt; &copy &am &ampx; a&b</p>"
    assert dom.chunks(html) == [(0, "One& two&amp", "word " * 10 + "<b> &copy &am &ampx; a&b")]
    assert dom.squeeze("\ufeff a\u00a0\u3000b\n") == "a b"


def test_over_pages_hands_rows_on(spark):
    """What a Python worker holds is bounded by rows and by markup, however many pages a batch has."""
    import pandas as pd

    class Pages:
        sparkSession = spark
        select = lambda self, *_: self
        mapInPandas = staticmethod(lambda run, ddl: run)

    def sizes(html, rows):
        run = documents.over_pages(Pages(), lambda h: [(h[:1],)] * rows, "x string", ["x"])
        return [len(d) for d in run(iter([pd.DataFrame({"scan": "s", "pid": range(3000), "html": html})]))]

    assert sum(sizes("a", 10)) == 30000 and max(sizes("a", 10)) <= documents.HELD + 10
    assert sum(sizes("a" * 100_000, 1)) == 3000 and max(sizes("a" * 100_000, 1)) <= documents.MARKUP // 100_000


def test_queue_never_runs_more_than_it_may():
    """A job asked to pause keeps its place until its gate; another starts only then, and it goes on before new ones."""
    import threading
    import time

    from webstrata.jobs import Queue

    q, lock, now, most = Queue(concurrent=2), threading.Lock(), [0], [0]

    def work(progress, params, gate):
        for _ in range(5):
            with lock:
                now[0] += 1
                most[0] = max(most[0], now[0])
            time.sleep(0.02)
            with lock:
                now[0] -= 1
            gate()

    held = [q.submit("slow", work) for _ in range(5)]
    time.sleep(0.03)
    held += [q.submit("fast", work, priority=True) for _ in range(3)]
    assert all(j.over.wait(20) for j in held) and all(j.status == "done" for j in held)
    assert most[0] <= 2


def test_offline_rewrite():
    html = assets.offline('<head></head><img src="a.png"><img src="a.png.bak"><link rel="preconnect" href="x">', {"a.png": "_assets/1.png"})
    assert 'src="_assets/1.png"' in html and 'src="a.png.bak"' in html and "preconnect" not in html and "Content-Security-Policy" in html


def test_offline_rewrite_of_pages_with_one_url(spark, tmp_path):
    """The first page of a URL stands, in whatever order files are read (large ones first); so does the SQL in one thread."""
    import duckdb
    import pandas as pd

    (tmp_path / "pages.parquet").mkdir()
    page = lambda i, n: (i, "https://a.example/p", f'<head></head><img src="/{i}.png">' + "".join(f"{i} {k} " for k in range(n)))
    for i, rows in enumerate(([page(1, 1)], [page(2, 50000), (3, "https://a.example/q", None)])):
        pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / f"pages.parquet/{i}.parquet")
    got = {r.url: r.html for r in assets.offline_rewrite(spark, str(tmp_path)).collect()}
    assert "1 0 " in got["https://a.example/p"]
    c = duckdb.connect()
    c.execute("SET threads=1")
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == dict(c.execute(CATALOG["offline_rewrite"][1]).fetchall())


def test_treemap():
    cells = documents.squarified([6.0, 6.0, 4.0, 3.0, 2.0, 2.0, 1.0], 0, 0, 6, 4)
    assert round(sum(w * h for _, _, w, h in cells), 6) == 24
    assert all(w > 0 and h > 0 for _, _, w, h in cells)


def test_captures(spark, tmp_path):
    root = tmp_path / "output"
    for path, text in {"b.example/2026-07-01/b.example/index.html": "<!-- https://b.example/ -->\n<html></html>", "b.example/2026-07-01/b.example/images/x.html": "no", "b.example/2026-07-01/b.example/loans/a.htm": "<p>"}.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    assert {(r.domain, r.scan_date, r.path) for r in captures.page_files(spark, str(root)).collect()} == {("b.example", "2026-07-01", "b.example/index.html"), ("b.example", "2026-07-01", "b.example/loans/a.htm")}
    assert {r.path: r.url for r in captures.page_contents(spark, str(root)).collect()} == {"b.example/index.html": "https://b.example/", "b.example/loans/a.htm": None}
    (root / "l.json").write_text('{"u": ["a", "b"]}')
    assert captures.incoming_links(spark, str(root / "l.json")).count() == 2
    (root / "urls.txt").write_text("https://a.example/ \n\nhttps://b.example/\n")
    assert [r.url for r in captures.url_list(spark, str(root / "urls.txt"), ["https://b.example/"]).collect()] == ["https://a.example/"]
    report = captures.audit_pages(spark.createDataFrame([("a<b", 'x"y', 2)], "page string, rule string, nodes long")).first().html
    assert "a&lt;b" in report and "x&quot;y" in report


def test_stream_refresh(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, "https://s.example/", '<title>T</title><a href="https://s.example/x">x</a>')], ingest.PAGES)
    rows.coalesce(1).write.parquet(folder)
    ingest.refresh(ingest.page_stream(spark, folder), out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(f"{out}/meta").first().title == "T"
    rows.coalesce(1).write.mode("append").parquet(folder)
    ingest.refresh(ingest.page_stream(spark, folder), out, str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(f"{out}/links").count() == 2


def test_queue_order_and_limits():
    q, done, gate = Queue(concurrent=1), [], threading.Event()

    def hold(progress, params, at):
        gate.wait(5)
        return done.append(params["n"])

    jobs = [q.submit("x", hold, {"n": n}) for n in "abc"]
    assert [j.status for j in jobs] == ["running", "queued", "queued"]
    assert q.move(jobs[2].id, 0) and q.place(jobs[2].id) == 0
    assert q.update(jobs[1].id, n="B") and q.cancel("nobody") is False
    gate.set()
    for j in jobs:
        assert j.over.wait(5)
    assert done == ["a", "c", "B"]


def test_queue_preemption_failure_and_cancel():
    q, log = Queue(concurrent=1), []

    def slow(progress, params, at):
        for i in range(200):
            at()
            log.append("s")
            time.sleep(0.005)

    a = q.submit("slow", slow)
    time.sleep(0.05)
    b = q.submit("quick", lambda p, params, at: log.append("b"), priority=True)
    assert b.over.wait(5) and b.status == "done"
    assert q.cancel(a.id) and a.over.wait(5) and a.status == "cancelled"
    c = q.submit("bad", lambda *x: 1 / 0)
    assert c.over.wait(5) and c.status == "failed" and "zero" in c.error


def test_empty_corpus(spark):
    p = corpus.pages(spark, "/root/testdata/sf0.001").limit(0)
    assert X.page_meta(p).count() == 0 and graph.edges(p).count() == 0 and X.jsonld(p).count() == 0
    assert dashboard.located(p).count() == 0
