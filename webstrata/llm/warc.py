"""WARC derivative builder: response records -> linked ``metadata`` and ``conversion`` (plain text) records.

Both derivatives carry WARC-Refers-To (the response's record id), its target URI, the source's HTTP headers and its
payload digest; block digests are SHA-1 in Base32, as WARC files write them. Record ids are name-based, so a rerun, or
a task that runs twice, writes the same records.

Scale: one narrow projection per page and one explode into two records; no shuffle, no key, hence no skew.

Defined results: null or empty html gives a metadata record without title or outlinks and a conversion record with an
empty block (both still written, so every response has its two derivatives); a null url gives an empty target URI;
repeated rows repeat their records under the same ids; malformed markup is cut by the patterns below, never dropped;
an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
# The Base32 alphabet and the named entities that are decoded.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}

#: The one head of a page, up to its end or the body; and what else is never shown, to the end of the page if left open.
HEAD = r"(?is)\A(.*?)<head\b.*?(?:</head\s*>|(<body\b))"
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
# A tag ends at the next bracket of either kind, so markup left open costs no rescan.
BLOCK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|main|aside|blockquote|pre|hr|dl|dt|dd|figure|figcaption|form|option|title|body|html)\b[^<>]*>"
TAG = r"<[a-zA-Z/!?][^<>]*>"
ENTITY = r"&(?:#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5})|nbsp|lt|gt|quot|apos|copy|middot|amp);"
TITLE = r"(?i)<title\b[^<>]*>([^<]*)"
LANG = r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([a-zA-Z-]+)"
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']([^\"'<>]*)[\"']"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once, behind a generator; a plain projection would be copied into every use."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.select("*", made).select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"_once.{n}").alias(n) for n in columns))


def base32_of_hex(digest: Column) -> Column:
    """Base32 of 40 hex digits, five digits (four letters) at a time."""
    group = lambda i: F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, by: F.substr(F.lit(BASE32), F.shiftright(v, by).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*(letter(group(i), by) for i in range(8) for by in (15, 10, 5, 0)))


def record_id(*name: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *name))
    cut = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in cut)), F.lit(">"))


def code_point(entity: Column) -> Column:
    digits = F.regexp_replace(F.substring(entity, 3, 9), "[;xX]", "")
    cp = F.when(F.substring(entity, 3, 1).isin("x", "X"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = (cp > 0) & ~cp.between(0xD800, 0xDFFF) & (cp <= 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(cp.cast("long")), 8, "0")), "UTF-32")).otherwise(F.lit("�"))


def bare_text(html: Column) -> Column:
    """Markup and hidden parts out, block ends as line ends."""
    shown = F.regexp_replace(F.regexp_replace(html, HEAD, "$1 $2"), HIDDEN, " ")
    return F.regexp_replace(F.regexp_replace(shown, BLOCK, "\n"), TAG, "")


def decoded(entity: Column) -> Column:
    out = F.when(entity.startswith("&#"), code_point(entity))
    for name, char in ENTITIES.items():
        out = out.when(entity == name, F.lit(char))
    return out


def tidy_text(t: Column) -> Column:
    """Entities decoded, each once, and white space collapsed."""
    between, found = F.split(t, ENTITY), F.transform(F.regexp_extract_all(t, F.lit(ENTITY), 0), decoded)
    t = F.when(t.contains("&"), F.array_join(F.zip_with(between, found, lambda x, e: F.concat(x, F.coalesce(e, F.lit("")))), "")).otherwise(t)
    # A single space, the usual case, is left as it is.
    t = F.regexp_replace(t, r"[ \t\r\f\x0B\x{00a0}]{2,}|[\t\r\f\x0B\x{00a0}]", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^[ \n]+|[ \n]+$", "")


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as WARC response records: id, target URI, date, HTTP headers, payload and digests.

    A column ``http_headers`` (status line and headers as received) is kept as it is; the pages table has none, so there,
    and where it is null, the headers are those that its content implies.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    if "http_headers" in pages.columns:
        headers = F.coalesce(F.col("http_headers"), headers)
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("target_uri"), html.alias("payload"), headers.alias("http_headers"))
    out = once(out, _hex=F.sha1(F.col("payload").cast("binary")))
    out = once(out, payload_digest=F.concat(F.lit("sha1:"), base32_of_hex(F.col("_hex")))).drop("_hex")
    return out.withColumn("record_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), "target_uri", "payload_digest")).withColumn("date", F.lit(date))


def absolute(href: Column, uri: Column) -> Column:
    """An outlink against its page: absolute as it is, ``//host`` and ``/path`` completed, others against the folder."""
    origin = F.regexp_extract(uri, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(uri, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)", 1)
    base = F.regexp_extract(uri, r"^([^#]*)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(uri, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(base, href))
        .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(origin, F.lit("/"))), href))
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Response records -> their metadata and conversion records, each with headers, block and digests."""
    payload, uri = F.col("payload"), F.col("target_uri")
    title = F.trim(F.regexp_replace(F.regexp_extract(payload, TITLE, 1), r"[ \t\r\n\f]+", " "))
    lang = F.regexp_extract(payload, LANG, 1)
    cut = once(records, title=title, lang=lang, hrefs=F.regexp_extract_all(payload, F.lit(LINK), 1), bare=bare_text(payload)).drop("payload")
    cut = once(cut, text=tidy_text(F.col("bare"))).drop("bare")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    fields = F.concat(
        F.when(F.col("title") != "", line("title", F.col("title"))).otherwise(F.lit("")),
        F.when(F.col("lang") != "", line("languages", F.col("lang"))).otherwise(F.lit("")),
        line("source-payload-digest", F.col("payload_digest")),
        F.array_join(F.transform(F.filter(F.split("http_headers", "[\r\n]+"), lambda h: h != ""), lambda h: F.concat(F.lit("source-http-header: "), h, F.lit("\r\n"))), ""),
        F.array_join(F.transform("hrefs", lambda h: F.concat(F.lit("outlink: "), absolute(h, uri), F.lit(" L a/@href\r\n"))), ""),
    )
    both = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block"), F.size("hrefs").cast("long").alias("n_outlinks")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block"), F.lit(0).cast("long").alias("n_outlinks")),
    )
    out = cut.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "http_headers", F.col("payload_digest").alias("source_digest"), F.explode(both).alias("r"))
    out = once(out.select("page_id", "refers_to", "target_uri", "date", "http_headers", "source_digest", "r.*"), _hex=F.sha1(F.col("block").cast("binary")))
    return out.select(
        "page_id",
        "warc_type",
        record_id(F.col("warc_type"), F.col("refers_to")).alias("record_id"),
        "refers_to",
        "target_uri",
        "date",
        "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        F.concat(F.lit("sha1:"), base32_of_hex(F.col("_hex"))).alias("block_digest"),
        "source_digest",
        "http_headers",
        "n_outlinks",
        "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """Each derivative as the text of a WARC/1.1 record, ready for a text or binary sink."""
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    source = F.array_join(F.filter(F.split("http_headers", "[\r\n]+"), lambda h: h != ""), "; ")
    return records.select(
        "record_id",
        F.concat(
            F.lit("WARC/1.1\r\n"),
            head("WARC-Type", F.col("warc_type")),
            head("WARC-Record-ID", F.col("record_id")),
            head("WARC-Refers-To", F.col("refers_to")),
            head("WARC-Target-URI", F.col("target_uri")),
            head("WARC-Date", F.col("date")),
            head("WARC-Block-Digest", F.col("block_digest")),
            head("X-Source-Payload-Digest", F.col("source_digest")),
            head("X-Source-HTTP-Headers", source),
            head("Content-Type", F.col("content_type")),
            head("Content-Length", F.col("content_length").cast("string")),
            F.lit("\r\n"),
            F.col("block"),
            F.lit("\r\n\r\n"),
        ).alias("record"),
    )


def op1(pages: DataFrame) -> DataFrame:
    """All derivatives of all pages, blocks included: what ``serialised`` writes is in these columns."""
    return derivatives(responses(pages.select("page_id", "url", "html")))


def oracle() -> str:
    """DuckDB's reading of the same records."""
    entities = " ".join(f"WHEN '{name}' THEN '{char.replace(chr(39), chr(39) * 2)}'" for name, char in ENTITIES.items())
    quoted = lambda pattern: pattern.replace("'", "''")
    base32 = lambda digest: f"list_aggregate(list_transform(range(0, 32), lambda i: '{BASE32}'[1 + ((CAST('0x' || substr({digest}, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31)]), 'string_agg', '')"
    uuid = lambda name: f"'<urn:uuid:' || regexp_replace(md5({name}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-') || '>'"
    return rf"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, 'sha1:' || {base32("sha1(html)")} AS source_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS http_headers FROM p),
r AS (SELECT *, {uuid("'response' || chr(31) || coalesce(CAST(page_id AS VARCHAR), '') || chr(31) || target_uri || chr(31) || source_digest")} AS refers_to,
  trim(regexp_replace(regexp_extract(html, '{quoted(TITLE)}', 1), '[ \t\r\n\f]+', ' ', 'g'), ' ') AS title, regexp_extract(html, '{quoted(LANG)}', 1) AS lang, regexp_extract_all(html, '{quoted(LINK)}', 1) AS hrefs,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '{quoted(HEAD)}', '\1 \2'), '{quoted(HIDDEN)}', ' ', 'g'), '{quoted(BLOCK)}', chr(10), 'g'), '{quoted(TAG)}', '', 'g') AS bare FROM d),
e AS (SELECT *, regexp_split_to_array(bare, '{ENTITY}') AS between, list_transform(regexp_extract_all(bare, '{ENTITY}'), lambda e: CASE WHEN e[3] IN ('x', 'X') THEN CAST('0x' || e[4:-2] AS INTEGER) WHEN e[2] = '#' THEN CAST(e[3:-2] AS INTEGER) END) AS points, regexp_extract_all(bare, '{ENTITY}') AS found FROM r),
t AS (SELECT *, array_to_string(list_transform(between, lambda x, i: x || coalesce(CASE WHEN found[i][2] = '#' THEN CASE WHEN points[i] > 0 AND points[i] <= 1114111 AND points[i] NOT BETWEEN 55296 AND 57343 THEN chr(points[i]) ELSE chr(65533) END ELSE CASE found[i] {entities} END END, '')), '') AS loose FROM e),
x AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(loose, '[ \t\r\f\x0B\x{{00a0}}]{{2,}}|[\t\r\f\x0B\x{{00a0}}]', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS text,
  regexp_extract(target_uri, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(target_uri, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/(?:[^?#]*/)?)', 1) AS folder, regexp_extract(target_uri, '^([^#]*)', 1) AS base, regexp_extract(target_uri, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) AS scheme FROM t),
f AS (SELECT *, CASE WHEN title <> '' THEN 'title: ' || title || chr(13) || chr(10) ELSE '' END || CASE WHEN lang <> '' THEN 'languages: ' || lang || chr(13) || chr(10) ELSE '' END || 'source-payload-digest: ' || source_digest || chr(13) || chr(10) ||
  array_to_string(list_transform(list_filter(regexp_split_to_array(http_headers, '[\r\n]+'), lambda h: h <> ''), lambda h: 'source-http-header: ' || h || chr(13) || chr(10)), '') ||
  array_to_string(list_transform(hrefs, lambda h: 'outlink: ' || CASE WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN scheme || h WHEN starts_with(h, '/') THEN origin || h WHEN starts_with(h, '#') THEN base || h ELSE CASE WHEN folder <> '' THEN folder ELSE origin || '/' END || h END || ' L a/@href' || chr(13) || chr(10)), '') AS fields FROM x),
b AS (SELECT page_id, refers_to, target_uri, http_headers, source_digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, fields AS block, CAST(len(hrefs) AS BIGINT) AS n_outlinks FROM f
  UNION ALL SELECT page_id, refers_to, target_uri, http_headers, source_digest, 'conversion', 'text/plain; charset=utf-8', text, 0 FROM f)
SELECT page_id, warc_type, {uuid("warc_type || chr(31) || refers_to")} AS record_id, refers_to, target_uri, '{DATE}' AS date, content_type, CAST(strlen(block) AS BIGINT) AS content_length, 'sha1:' || {base32("sha1(block)")} AS block_digest, source_digest, http_headers, n_outlinks, block FROM b
"""
