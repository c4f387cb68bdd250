"""Pages to narrow tables: metadata, links, facts, structured data, extraction profile. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark

#: (column, SQL over page columns) of T1, for either engine.
KEY = ("scan", "pid", "url", "path")


def meta_columns(D) -> dict[str, str]:
    metas, links = D.every("html", S.META), D.every("html", S.LINK)

    def content(name: str) -> str:
        found = D.keep(metas, "m", f"lower({S.loose_attribute(D, 'm', 'name')}) = '{name}'")
        return f"(case when {D.size(found)} > 0 then nullif({S.loose_attribute(D, D.first(found), 'content')}, '') end)"

    canonical = D.keep(links, "m", f"lower({S.loose_attribute(D, 'm', 'rel')}) = 'canonical'")
    return {
        "title": f"nullif({S.inner_text(D, D.ext('html', S.TITLE))}, '')",
        "h1s": D.keep(D.map(D.every("html", S.H1), "h", S.inner_text(D, "h")), "h", "h <> ''"),
        "h2_count": D.size(D.every("html", r"(?i)<h2[\s>]", 0)),
        "description": content("description"),
        "robots_raw": content("robots"),
        "googlebot_raw": content("googlebot"),
        "canonical": f"(case when {D.size(canonical)} > 0 then nullif({S.loose_attribute(D, D.first(canonical), 'href')}, '') end)",
        "lang": f"nullif({S.loose_attribute(D, D.ext('html', '(?i)<html' + chr(92) + 's([^>]*)>'), 'lang')}, '')",
    }


def directives(D) -> str:
    """Robots directives present, in fixed order; ``none`` counts as noindex and nofollow."""
    split = "split" if D.__name__ == "Spark" else "string_split"
    tokens = D.map(f"{split}(lower(concat(coalesce(robots_raw, ''), ',', coalesce(googlebot_raw, ''))), ',')", "t", "trim(t)")
    has = "array_contains" if D.__name__ == "Spark" else "list_contains"
    one = [f"case when {has}({tokens}, '{d}')" + (f" or {has}({tokens}, 'none')" if d in ("noindex", "nofollow") else "") + f" then '{d}' end" for d in S.ROBOTS]
    return D.keep(f"{'array' if D.__name__ == 'Spark' else 'list_value'}({', '.join(one)})", "d", "d is not null")


def page_meta(pages: DataFrame) -> DataFrame:
    """Title, headings, description, robots, canonical and language of every page."""
    out = pages.select(*KEY, "size", *(F.expr(e).alias(c) for c, e in meta_columns(Spark).items()))
    return out.withColumn("directives", F.expr(directives(Spark))).withColumn("h1_count", F.size("h1s").cast("long"))


def meta_sql() -> str:
    inner = ", ".join(f"{e} AS {c}" for c, e in meta_columns(Duck).items())
    return f"meta AS (SELECT *, {directives(Duck)} AS directives, CAST(len(h1s) AS BIGINT) AS h1_count FROM (SELECT scan, pid, url, path, size, {inner} FROM page))"


def link_columns(D) -> dict[str, str]:
    href = S.attribute(D, "attrs", "href")
    rel = f"lower({S.attribute(D, 'attrs', 'rel')})"
    text = f"{'substring' if D.__name__ == 'Spark' else 'substr'}({S.inner_text(D, 'body')}, 1, 120)"
    return {
        "href": S.trimmed(D, href),
        "text": f"case when {text} = '' and tag = 'area' then {D.ext('attrs', '(?i)alt' + chr(92) + 's*=' + chr(92) + 's*' + chr(92) + 'x22([^' + chr(92) + 'x22]*)' + chr(92) + 'x22')} else {text} end",
        "nofollow": D.like(rel, r"(?:^|\s)nofollow(?:\s|$)"),
        "ugc": D.like(rel, r"(?:^|\s)ugc(?:\s|$)"),
        "sponsored": D.like(rel, r"(?:^|\s)sponsored(?:\s|$)"),
    }


def links(pages: DataFrame) -> DataFrame:
    """One row per <a> and <area> with a quoted href; ``pos`` is document order, areas after anchors."""
    # The arrays are cut in a projection of their own, so that no lambda repeats the scan of the page.
    cut = pages.select(*KEY, F.explode(F.array(F.struct(F.expr(Spark.every("html", S.ANCHOR, 1)).alias("a"), F.expr(Spark.every("html", S.ANCHOR, 2)).alias("b"), F.expr(Spark.every("html", S.AREA, 1)).alias("r")))).alias("c"))
    rows = F.concat(
        F.zip_with("c.a", "c.b", lambda a, b: F.struct(F.lit("a").alias("tag"), a.alias("attrs"), b.alias("body"))),
        F.transform("c.r", lambda a: F.struct(F.lit("area").alias("tag"), a.alias("attrs"), F.lit("").alias("body"))),
    )
    out = cut.select(*KEY, F.posexplode(rows).alias("pos", "m")).select(*KEY, F.col("pos").cast("long").alias("pos"), "m.*")
    out = out.select(*KEY, "pos", "tag", *(F.expr(e).alias(c) for c, e in link_columns(Spark).items()))
    return out.filter("href <> ''").withColumn("kind", F.expr(S.href_kind(Spark, "href")))


def links_sql() -> str:
    columns = ", ".join(f"{e} AS {c}" for c, e in link_columns(Duck).items())
    return f"""raw_link AS (SELECT scan, pid, url, path, 'a' AS tag, unnest(range(0, len(a))) AS pos, unnest(a) AS attrs, unnest(b) AS body FROM (SELECT *, {Duck.every('html', S.ANCHOR, 1)} AS a, {Duck.every('html', S.ANCHOR, 2)} AS b FROM page)
UNION ALL SELECT scan, pid, url, path, 'area', n + unnest(range(0, len(r))), unnest(r), '' FROM (SELECT *, len({Duck.every('html', S.ANCHOR, 1)}) AS n, {Duck.every('html', S.AREA, 1)} AS r FROM page)),
link AS (SELECT *, {S.href_kind(Duck, 'href')} AS kind FROM (SELECT scan, pid, url, path, CAST(pos AS BIGINT) AS pos, tag, {columns} FROM raw_link) WHERE href <> '')"""


FACTS = {"phone": S.phones, "email": S.emails, "postcode": S.postcodes, "price": S.prices}


def facts(pages: DataFrame) -> DataFrame:
    """(kind, value) facts of every page's visible text, once per page."""
    text = pages.select(*KEY, F.explode(F.array(F.expr(S.visible_text(Spark, "html")))).alias("text"))
    return listed(text.select(*KEY, kinds("text").alias("kinds")))


def kinds(text: str) -> Column:
    """What a text states, by kind."""
    return F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f(Spark, text)).alias("found")) for k, f in FACTS.items()))


def listed(stated: DataFrame) -> DataFrame:
    return stated.select(*KEY, F.explode("kinds").alias("k")).select(*KEY, "k.kind", F.explode("k.found").alias("value"))


def facts_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT scan, pid, url, path, '{k}' AS kind, unnest({f(Duck, 'text')}) AS value FROM visible" for k, f in FACTS.items())
    return f"visible AS (SELECT scan, pid, url, path, {S.visible_text(Duck, 'html')} AS text FROM page), fact AS ({parts})"


def jsonld(pages: DataFrame) -> DataFrame:
    """Every JSON-LD block: its nodes (array and @graph members flattened, containers kept), or one invalid row.

    ``node`` is null on invalid rows, which carry the block's first 80 characters.
    """
    blocks = pages.select(*KEY, F.posexplode(F.expr(Spark.every("html", S.LD))).alias("block", "raw")).withColumn("raw", F.expr(S.trimmed(Spark, "raw")))
    parsed = blocks.withColumn("v", F.try_parse_json("raw"))
    top = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    nodes = parsed.filter("v is not null").select(*KEY, "block", F.posexplode(top).alias("at", "n"))
    graph = F.coalesce(F.try_variant_get("n", "$['@graph']", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    nodes = nodes.select(*KEY, "block", "at", F.posexplode(F.concat(F.array("n"), graph)).alias("sub", "node")).filter(F.schema_of_variant("node").startswith("OBJECT"))
    string = lambda name: F.when(F.schema_of_variant(F.try_variant_get("node", f"$['{name}']", "variant")) == "STRING", F.try_variant_get("node", f"$['{name}']", "string"))
    same = F.try_variant_get("node", "$.sameAs", "variant")
    good = nodes.select(
        *KEY,
        "block",
        (F.col("at") * 1000 + F.col("sub")).cast("long").alias("ord"),
        F.lit(None).cast("string").alias("invalid"),
        F.coalesce(F.try_variant_get("node", "$['@type']", "string"), F.lit("")).alias("type"),
        *(string(n).alias(n) for n in ("name", "telephone", "email", "legalName")),
        F.when(F.schema_of_variant(same).startswith("ARRAY"), F.try_variant_get(same, "$", "array<string>")).when(F.schema_of_variant(same) == "STRING", F.array(F.try_variant_get(same, "$", "string"))).alias("same_as"),
    )
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("type", "string"), ("name", "string"), ("telephone", "string"), ("email", "string"), ("legalName", "string"), ("same_as", "array<string>"))]
    bad = parsed.filter("v is null").select(*KEY, "block", F.lit(0).cast("long").alias("ord"), F.substring("raw", 1, 80).alias("invalid"), *nothing)
    return good.unionByName(bad)


def jsonld_sql() -> str:
    string = lambda n: f"CASE WHEN json_type(node, '$.\"{n}\"') = 'VARCHAR' THEN node->>'$.\"{n}\"' END AS {n}"
    return f"""ld_raw AS (SELECT scan, pid, url, path, unnest(range(0, len(b))) AS block, {S.trimmed(Duck, 'unnest(b)')} AS raw FROM (SELECT *, {Duck.every('html', S.LD)} AS b FROM page)),
ld_top AS (SELECT scan, pid, url, path, block, unnest(range(0, len(t))) AS spot, unnest(t) AS n FROM (SELECT *, CASE WHEN json_type(raw) = 'ARRAY' THEN CAST(CAST(raw AS JSON) AS JSON[]) ELSE [CAST(raw AS JSON)] END AS t FROM ld_raw WHERE json_valid(raw))),
ld_node AS (SELECT scan, pid, url, path, block, spot, unnest(range(0, len(g))) AS sub, unnest(g) AS node FROM (SELECT *, list_concat([n], coalesce(CAST(CASE WHEN json_type(n, '$."@graph"') = 'ARRAY' THEN n->'$."@graph"' END AS JSON[]), [])) AS g FROM ld_top)),
ld AS (SELECT scan, pid, url, path, block, CAST(spot * 1000 + sub AS BIGINT) AS ord, NULL AS invalid, coalesce(node->>'$."@type"', '') AS type, {string('name')}, {string('telephone')}, {string('email')}, {string('legalName')},
  CASE WHEN json_type(node, '$.sameAs') = 'ARRAY' THEN CAST(node->'$.sameAs' AS VARCHAR[]) WHEN json_type(node, '$.sameAs') = 'VARCHAR' THEN [node->>'$.sameAs'] END AS same_as FROM ld_node WHERE json_type(node) = 'OBJECT'
UNION ALL SELECT scan, pid, url, path, block, CAST(0 AS BIGINT), substr(raw, 1, 80), NULL, NULL, NULL, NULL, NULL, NULL FROM ld_raw WHERE NOT json_valid(raw))"""


def profile_columns(D) -> dict[str, str]:
    headings = D.keep(D.map(D.every("html", S.H123), "h", S.extract_text(D, "h")), "h", "h <> ''")
    fact = S.facty(D)
    alts = D.keep(D.map(D.every("html", r"(?i)<img[^>]*\balt\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]"), "a", f"case when {D.like('a', fact)} then {D.ext('a', fact)} else '' end"), "a", "a <> ''")
    return {
        "has_main": D.like("html", r"(?i)<(?:main|article)[\s>]"),
        "headings": D.size(headings),
        "question_headings": D.size(D.keep(headings, "q", D.like("q", S.QUESTION))),
        "has_table": D.like("html", r"(?i)<table[\s>]"),
        "has_time": D.like("html", r"(?i)<time[\s>]"),
        "text": S.extract_text(D, "html"),
        "alts": alts,
    }


def profile(pages: DataFrame) -> DataFrame:
    """What a machine reader can take from a page; facts that only image texts state."""
    return stripped(pages).select(*KEY, *PROFILE)


PROFILE = ("has_main", "headings", "question_headings", "has_table", "has_time", "text_length", "image_facts")


def stripped(pages: DataFrame) -> DataFrame:
    """Profile of every page, with its ``text``: pages are stripped of their markup once."""
    columns = profile_columns(Spark)
    text = F.explode(F.array(F.expr(columns.pop("text")))).alias("text")
    out = pages.select(*KEY, *(F.expr(e).alias(c) for c, e in columns.items()), text)
    return out.select(*KEY, *PROFILE[:5], F.char_length("text").cast("long").alias("text_length"), F.expr("filter(alts, a -> not contains(text, a))").alias("image_facts"), "text")


def profile_sql() -> str:
    inner = ", ".join(f"{e} AS {c}" for c, e in profile_columns(Duck).items())
    return f"profile AS (SELECT scan, pid, url, path, has_main, headings, question_headings, has_table, has_time, CAST(length(text) AS BIGINT) AS text_length, list_filter(alts, lambda a: NOT contains(text, a)) AS image_facts FROM (SELECT *, {inner} FROM page))"
