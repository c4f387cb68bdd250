"""Every training-data query that SQL can express against its SQL, and op1 on malformed pages."""

import duckdb
import pytest

from tests.test_queries import SF, duck, table  # noqa: F401  (a fixture)
from webstrata.llm import queries, warc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, duck, name):  # noqa: F811
    got = queries.queries()[name](spark, SF).toPandas()
    want = duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) > 0
    assert table(got) == table(want)


PAGES = [
    (1, "https://a.example/x/y?q#t", '<html lang="en"><head><title> A &amp; B </title></head><body><script>no</script><p>One&nbsp;two &#233;&#x1F600; &lt;b&gt; &#38;lt; &amp;amp; &#0; &#xD800; &#x110000; & &bogus; </p><a href="/r">r</a><a href=\'z\'>z</a></body></html>'),
    (2, None, None),
    (1, "https://a.example/x/y?q#t", ""),
    (1, "https://a.example/x/y?q#t", ""),
    (3, "u", "<p>un<b>closed"),
    (None, "//host/a", "<head>never closed <p>still <script>gone <p>gone too"),
    (4, "http://h.example", "<!-- open <p>gone"),
    (5, "http://h.example/a/b", "x < y <3 <a<a href='q'>t</a> <A HREF=\"//c.example/d\">u</A> <a href='#f'>v</a><a href='mailto:w'>w</a><style>s</style>" + "<td" * 3000),
    (6, "http://h.example/é/b#z", "<HEAD>h<BODY class='c'>text&copy;&middot;\r\n\t  two\n\n three&#10;four <template>t</template><noscript>n</noscript>"),
    (7, "http://h.example/", "<script>" * 2000 + "x"),
    (8, "http://h.example/", "&#20013;&#22269;" * 3000),
    (9, "http://h.example/", "<header>kept</header> <title>a<b>c</title>"),
]


def test_op1_malformed_pages(spark):
    df = spark.createDataFrame([(*p, 7, "clash", b"x") for p in PAGES], "page_id long, url string, html string, record_id long, block string, text binary").repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", PAGES)
    got = warc.op1(df).toPandas()
    assert table(got) == table(con.sql(warc.oracle()).df()) and len(got) == 2 * len(PAGES)
    assert warc.op1(df.limit(0)).count() == 0
    text = {r.page_id: r.block for r in got[got.warc_type == "conversion"].itertuples() if r.block}
    assert "&lt; &amp;" in text[1] and text[8] == "中国" * 3000


def test_op1_given_headers(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "HTTP/1.1 203 OK\r\nServer: s\r\n\r\n"), (2, "u", "<p>x", None)], "page_id long, url string, html string, http_headers string")
    out = {r.page_id: r for r in warc.derivatives(warc.responses(df)).filter("warc_type = 'metadata'").collect()}
    assert "source-http-header: Server: s\r\n" in out[1].block and out[1].http_headers.startswith("HTTP/1.1 203")
    assert "source-http-header: HTTP/1.1 200 OK\r\n" in out[2].block
