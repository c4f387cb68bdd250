"""Queries over page content: metadata, URLs, facts, structured data, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import extract as X
from webstrata.plans.catalog import query
from webstrata.session import table
from webstrata.sources import corpus

P = corpus.pages_sql()
META = f"WITH {P}, {X.meta_sql()}"


@query("page_meta", f"{META} SELECT scan, pid, title, CAST(length(title) AS BIGINT) AS title_length, array_to_string(h1s, '|') AS h1s, h1_count, h2_count, description, canonical, lang, robots_raw, array_to_string(directives, ',') AS directives FROM meta")
def page_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.page_meta(corpus.pages(spark, sf_dir))
    return m.select("scan", "pid", "title", F.char_length("title").cast("long").alias("title_length"), F.array_join("h1s", "|").alias("h1s"), "h1_count", "h2_count", "description", "canonical", "lang", "robots_raw", F.array_join("directives", ",").alias("directives"))


@query("robots_directives", f"{META} SELECT scan, d AS directive, CAST(count(*) AS BIGINT) AS pages FROM (SELECT scan, unnest(directives) AS d FROM meta) GROUP BY scan, d")
def robots_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.page_meta(corpus.pages(spark, sf_dir))
    return m.select("scan", F.explode("directives").alias("directive")).groupBy("scan", "directive").agg(F.count(F.lit(1)).alias("pages"))


def _length_flag(column: str) -> str:
    return f"case when {column} is null then 'missing' when length({column}) > 160 then 'long' when length({column}) < 50 then 'short' else 'fine' end"


@query("title_length_flags", f"{META} SELECT scan, {_length_flag('description')} AS description_flag, CASE WHEN title IS NULL THEN 'missing' WHEN length(title) > 60 THEN 'long' ELSE 'fine' END AS title_flag, CAST(count(*) AS BIGINT) AS pages FROM meta GROUP BY ALL")
def title_length_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.page_meta(corpus.pages(spark, sf_dir))
    title = F.when(F.col("title").isNull(), "missing").when(F.char_length("title") > 60, "long").otherwise("fine")
    return m.groupBy("scan", F.expr(_length_flag("description")).alias("description_flag"), title.alias("title_flag")).agg(F.count(F.lit(1)).alias("pages"))


@query("page_title_lang_rollup", f"{META} SELECT scan, coalesce(lang, '(none)') AS lang, CAST(count(*) AS BIGINT) AS pages, CAST(count(DISTINCT title) AS BIGINT) AS titles FROM meta GROUP BY ALL")
def page_title_lang_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = X.page_meta(corpus.pages(spark, sf_dir))
    return m.groupBy("scan", F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("title").alias("titles"))


@query("page_path_section_depth", f"WITH {P} SELECT scan, pid, path, CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[2] ELSE '(root)' END AS section, CAST(greatest(0, len(string_split(path, '/')) - 2) AS BIGINT) AS depth FROM page")
def page_path_section_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(corpus.pages(spark, sf_dir)).select("scan", "pid", "path", "section", "depth")


def located(pages: DataFrame) -> DataFrame:
    """Pages with their section (first folder below the host) and depth."""
    parts = F.split("path", "/")
    return pages.withColumn("section", F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise(F.lit("(root)"))).withColumn("depth", F.greatest(F.lit(0), F.size(parts) - 2).cast("long"))


URLS = [("https://A.Example/page/?b=2&a=1&utm_source=x#top",), ("https://a.example/page?a=1&b=2",), ("https://a.example/?gclid=1",), ("https://a.example/x///?fbclid=9&q=1",), ("https://a.example",)]


@query("url_normalized", f"WITH u AS (SELECT url FROM pages UNION ALL SELECT * FROM {corpus.values(URLS)} t(url)) SELECT url, {S.normal_url(Duck, 'url')} AS normal FROM u")
def url_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url").union(spark.createDataFrame(URLS, "url string"))
    return urls.select("url", F.expr(S.normal_url(Spark, "url")).alias("normal"))


@query("fact_list", f"WITH {P}, {X.facts_sql()} SELECT scan, pid, kind, value FROM fact")
def fact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facts(corpus.pages(spark, sf_dir)).select("scan", "pid", "kind", "value")


_DOC = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest({f(Duck, S.squeeze(Duck, 'text'))}) AS value FROM documents" for k, f in X.FACTS.items())


@query("document_facts", f"SELECT doc_id, kind, value FROM ({_DOC})")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.expr(S.squeeze(Spark, "text")))).alias("text"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.expr(f(Spark, "text")).alias("found")) for k, f in X.FACTS.items()))
    return text.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", F.explode("k.found").alias("value"))


@query("jsonld_nodes", f"WITH {P}, {X.jsonld_sql()} SELECT scan, pid, CAST(block AS BIGINT) AS block, ord, invalid, type, name, telephone, email, array_to_string(same_as, ' ') AS same_as FROM ld")
def jsonld_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.jsonld(corpus.pages(spark, sf_dir)).select("scan", "pid", F.col("block").cast("long").alias("block"), "ord", "invalid", "type", "name", "telephone", "email", F.array_join("same_as", " ").alias("same_as"))


@query(
    "jsonld_coverage",
    f"WITH {P}, {X.jsonld_sql()}, h AS (SELECT scan, count(DISTINCT pid) FILTER (WHERE invalid IS NULL) AS w, count(DISTINCT pid) FILTER (WHERE invalid IS NOT NULL) AS b FROM ld GROUP BY scan), t AS (SELECT scan, count(*) AS n FROM page GROUP BY scan) SELECT scan, CAST(n AS BIGINT) AS pages, CAST(coalesce(w, 0) AS BIGINT) AS with_jsonld, CAST(coalesce(b, 0) AS BIGINT) AS invalid, CAST(floor(100.0 * coalesce(w, 0) / n + 0.5) AS BIGINT) AS coverage FROM t LEFT JOIN h USING (scan)",
)
def jsonld_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.pages(spark, sf_dir)
    held = X.jsonld(p).groupBy("scan").agg(F.countDistinct(F.when(F.col("invalid").isNull(), F.col("pid"))).alias("w"), F.countDistinct(F.when(F.col("invalid").isNotNull(), F.col("pid"))).alias("b"))
    out = p.groupBy("scan").agg(F.count(F.lit(1)).alias("pages")).join(held, "scan", "left")
    with_ = F.coalesce("w", F.lit(0))
    return out.select("scan", "pages", with_.alias("with_jsonld"), F.coalesce("b", F.lit(0)).alias("invalid"), F.floor(100.0 * with_ / F.col("pages") + 0.5).alias("coverage"))


@query("extractability_profile", f"WITH {P}, {X.profile_sql()} SELECT scan, pid, has_main, headings, question_headings, has_table, has_time, text_length, array_to_string(image_facts, '|') AS image_facts FROM profile")
def extractability_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.profile(corpus.pages(spark, sf_dir)).select("scan", "pid", "has_main", "headings", "question_headings", "has_table", "has_time", "text_length", F.array_join("image_facts", "|").alias("image_facts"))


@query("question_headings", f"WITH {P}, h AS (SELECT scan, pid, unnest({Duck.map(Duck.every('html', S.H123), 'h', S.extract_text(Duck, 'h'))}) AS heading FROM page) SELECT scan, pid, heading FROM h WHERE heading <> '' AND {Duck.like('heading', S.QUESTION)}")
def question_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = corpus.pages(spark, sf_dir).select("scan", "pid", F.explode(F.expr(Spark.map(Spark.every("html", S.H123), "h", S.extract_text(Spark, "h")))).alias("heading"))
    return h.filter(F.expr(f"heading <> '' and {Spark.like('heading', S.QUESTION)}"))


@query("conversation_questions", f"SELECT conv_id, turn, text FROM conversations WHERE {Duck.like('text', S.QUESTION)}")
def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter(F.expr(Spark.like("text", S.QUESTION))).select("conv_id", "turn", "text")


def question_key(D, e: str) -> str:
    return D.rep(D.rep(f"lower({S.squeeze(D, e)})", r"[^\w\s]", ""), r"\s+", " ")


@query("question_keys", f"WITH k AS (SELECT conv_id, turn, {question_key(Duck, 'text')} AS key FROM conversations WHERE {Duck.like('text', S.QUESTION)}) SELECT conv_id, turn, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY conv_id, turn) AS n FROM k WHERE key <> '') WHERE n = 1")
def question_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of each identity, punctuation and accents aside."""
    k = table(spark, sf_dir, "conversations").filter(F.expr(Spark.like("text", S.QUESTION))).select("conv_id", "turn", F.expr(question_key(Spark, "text")).alias("key")).filter("key <> ''")
    first = k.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("f"))
    return first.select("f.conv_id", "f.turn", "key")


YEAR = 2026


def years(D) -> str:
    return D.keep(D.map(D.every("text", S.COPYRIGHT), "y", "cast(y as bigint)"), "y", f"y between 1995 and {YEAR + 1}")


YEARS = f"visible AS (SELECT scan, pid, url, path, {S.visible_text(Duck, 'html')} AS text FROM page), dated AS (SELECT scan, pid, path, list_max({years(Duck)}) AS year FROM visible WHERE len({years(Duck)}) > 0)"


def dated(pages: DataFrame) -> DataFrame:
    """Newest copyright year of every page that states one."""
    # A generator, so that the filter below doesn't strip the page again.
    text = pages.select(*X.KEY, F.explode(F.array(F.expr(S.visible_text(Spark, "html")))).alias("text"))
    return text.select("scan", "pid", "path", F.array_max(F.expr(years(Spark))).alias("year")).filter("year is not null")


@query("copyright_years", f"WITH {P}, {YEARS} SELECT scan, year, CAST(count(*) AS BIGINT) AS pages, year <= {YEAR - 2} AS stale FROM dated GROUP BY ALL")
def copyright_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(corpus.pages(spark, sf_dir)).groupBy("scan", "year").agg(F.count(F.lit(1)).alias("pages")).withColumn("stale", F.col("year") <= YEAR - 2)
