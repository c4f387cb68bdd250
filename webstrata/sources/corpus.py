"""Captured pages as one table, keyed by scan: the ``pages`` table and small made-up sites with what it lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.session import table


def _org(**fields: str) -> str:
    return '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Organization",' + ",".join(f'"{k}":{v}' for k, v in fields.items()) + "}</script>"


#: (scan, page number, url, html). Scans stand for one capture of one site.
SITES: list[tuple[str, int, str, str]] = [
    ("loans.example", 1, "https://loans.example/", "<html lang=\"en-GB\"><head><title>Loan Co | Home</title><meta name=\"description\" content=\"All about Loan Co and what it does for its many customers.\">" + _org(name='"Loan Co"', telephone='"0800 111 2222"') + "</head><body><h1>Loan Co</h1><p>Ring 0800 111 2222. Main office SW1A 1AA. From £12.50 or £ 99.</p><a href=\"https://loans.example/rates\">Rate table</a> <a href='https://loans.example/rates#top' rel='nofollow'>Rates today</a></body></html>"),
    ("loans.example", 2, "https://loans.example/contact", "<html><head><title>Contact | Loan Co</title><meta name='description' content='Ways to get in touch with the Loan Co team on any day.'>" + _org(name='"Loan Company Group"', telephone='"0333 444 5555"', email='"desk@loans.example"') + "</head><body><h1>Contact us</h1><p>Ring 0333 444 5555 or write to help@loans.example. Branch M1 4WB.</p><a href=\"https://loans.example/rates\">Our rates</a><a href=\"mailto:help@loans.example\">Write</a><a href=\"tel:03334445555\">Ring</a></body></html>"),
    ("loans.example", 3, "https://loans.example/rates", "<html><head><title>Rates | Loan Co</title><meta name=\"description\" content=\"One description for two pages.\"><script type=\"application/ld+json\">{ not json at all }</script></head><body><p>Rates of the day.</p></body></html>"),
    ("loans.example", 4, "https://loans.example/offers", "<html><head><title>Rates | Loan Co</title><meta name=\"description\" content=\"One description for two pages.\"></head><body><h1>Offers</h1><h1>More offers</h1><a href=\"https://loans.example/rates\">Rate offers</a><a href=\"javascript:chat()\">Chat</a><a href=\"#main\">Skip</a></body></html>"),
    ("loans.example", 5, "https://loans.example/old/legacy", "<html><head><title>Old page</title><meta name=\"robots\" content=\"NOINDEX, follow\"><link rel=\"canonical\" href=\"https://loans.example/\"></head><body><h1>Gone</h1><a href=\"https://loans.example/rates\">read more</a></body></html>"),
    ("bank.example", 1, "https://bank.example/", "<html><nav><a href=\"https://bank.example/loans/personal\">Personal loans</a></nav><main><a href=\"https://bank.example/loans/personal#rates\">Personal loans</a><a href=\"https://bank.example/missing-page\">Nowhere</a><a href=\"https://other.example/\" rel=\"nofollow sponsored\">Partner</a><a href=\"https://other.example/terms\"><span>Terms</span>&nbsp;page</a></main><footer><a href=\"https://cdn.example/asset\" rel=\"ugc\">CDN</a></footer><map><area href=\"https://bank.example/loans/fixed\" alt=\"Zone one\"></map></html>"),
    ("bank.example", 2, "https://bank.example/loans/personal", "<html lang=en><head><title>Personal loans | Bank</title><meta name=\"description\" content=\"Compare rates of personal loans and apply online within minutes of reading this page.\"><meta name=\"robots\" content=\"none\"><link rel=\"canonical\" href=\"https://bank.example/loans/personal/\"></head><body><h1>Personal loans</h1><h2>How do I apply?</h2><p>Fill in the form and wait for a call.</p><img src=\"a.png\" alt=\"Call 0141 555 0192 now\"><table><tr><td>1</td></tr></table><time>2024</time></body></html>"),
    ("bank.example", 3, "https://bank.example/loans/fixed", "<html><body><p>f</p><a href=\"https://bank.example/\">Home</a><a href=\"https://bank.example/loans/personal\" rel=\"nofollow\">Loans, personal</a></body></html>"),
    ("trio.example", 1, "https://trio.example/a", "<html><head><title>A</title>" + _org(name='"Trio Ltd"', telephone='"0141 555 0192"', sameAs='["https://link.example/company/trio"]') + "</head><body><h1>A</h1><p>Ring 0141 555 0192.</p><p>© 2026</p></body></html>"),
    ("trio.example", 2, "https://trio.example/b", "<html><head><title>B</title>" + _org(name='"Trio Ltd"', telephone='"0141 555 0300"', sameAs='["https://data.example/wiki/Q1/"]') + "</head><body><h1>B</h1><p>Ring 0141 555 0192.</p><p>© 2021 - 2023</p></body></html>"),
    ("trio.example", 3, "https://trio.example/c", "<html><head><title>C</title></head><body><h1>C</h1><p>Copyright 2022</p></body></html>"),
    ("graph.example", 1, "https://graph.example/", "<html><head><title>Graph</title><script type=\"application/ld+json\">{\"@graph\":[{\"@type\":[\"Corporation\",\"Thing\"],\"name\":\"Graph Inc\"},{\"@type\":\"Person\",\"name\":\"P\"}]}</script></head><body><article><h1>Graph</h1></article></body></html>"),
]


def pages(spark: SparkSession, sf_dir: str, by_host: bool = False) -> DataFrame:
    """scan, pid, url, path, html, size. Captured pages form one scan (``web``), or one per host."""
    scan = S.host(Spark, "url") if by_host else "'web'"
    held = table(spark, sf_dir, "pages").select(F.expr(scan).alias("scan"), F.col("page_id").alias("pid"), "url", "html")
    made = spark.createDataFrame(SITES, "scan string, pid long, url string, html string")
    return held.unionByName(made).select("scan", "pid", "url", F.expr(S.page_path(Spark, "url")).alias("path"), "html", F.octet_length("html").cast("long").alias("size"))


def quoted(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows) + ")"


def pages_sql(by_host: bool = False) -> str:
    scan = S.host(Duck, "url") if by_host else "'web'"
    return f"page AS (SELECT scan, pid, url, {S.page_path(Duck, 'url')} AS path, html, CAST(strlen(html) AS BIGINT) AS size FROM (SELECT {scan} AS scan, page_id AS pid, url, html FROM pages UNION ALL SELECT scan, CAST(pid AS BIGINT), url, html FROM {values(SITES)} t(scan, pid, url, html)))"
