"""Captures on disk: saved page files, their sizes, text artifacts, and the sinks that write them as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Spark

FILE = "path string, modificationTime timestamp, length long, content binary"


def page_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC1, SRC2, SRC6, A28: (domain, scan_date, path, size, mtime_ms) of saved pages, contents unread; asset folders aside."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[hH][tT][mM]*").load(root)
    parts = F.split(F.regexp_extract("path", f"{root.rstrip('/')}/(.*)$", 1), "/")
    rel = F.array_join(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2)), "/")
    out = files.select(F.get(parts, F.lit(0)).alias("domain"), F.get(parts, F.lit(1)).alias("scan_date"), rel.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime_ms"))
    return out.filter(F.col("path").rlike(r"(?i)\.html?$") & ~F.concat(F.lit("/"), "path").rlike("/(?:images|_assets)/"))


def page_contents(spark: SparkSession, root: str) -> DataFrame:
    """SRC3, SRC4: saved pages with the URL their first line names."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[hH][tT][mM]*").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("html"))
    parts = F.split(F.regexp_extract("file", f"{root.rstrip('/')}/(.*)$", 1), "/")
    url = F.nullif(F.regexp_extract(F.substring("html", 1, 2048), r"^<!--\s*(https?://\S+)\s*-->", 1), F.lit(""))
    out = files.select(F.get(parts, F.lit(0)).alias("domain"), F.get(parts, F.lit(1)).alias("scan_date"), F.array_join(F.slice(parts, 3, F.greatest(F.lit(0), F.size(parts) - 2)), "/").alias("path"), url.alias("url"), "html")
    return out.filter(~F.concat(F.lit("/"), "path").rlike("/(?:images|_assets)/"))


def url_list(spark: SparkSession, path: str, ignored: list[str] | None = None) -> DataFrame:
    """SRC7, SRC14: lines of a text file, trimmed, blanks and exact ignores dropped."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    drop = spark.createDataFrame([(i.strip(),) for i in ignored or []], "url string")
    return lines.join(F.broadcast(drop), "url", "left_anti") if ignored else lines


def incoming_links(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: a JSON map of target to sources, as rows."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("target_url", "sources")).select("target_url", F.explode("sources").alias("source_url"))


def write_pages(pages: DataFrame, out: str) -> None:
    """SNK1: pages partitioned by scan; a scan written again replaces itself only."""
    pages.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "scan_date").parquet(out)


def write_crawl(out: str, visited: DataFrame, broken: DataFrame, incoming: DataFrame, duplicates: DataFrame) -> None:
    """SNK2: the crawl's four artifacts as tables."""
    for name, df in (("all_links", visited), ("broken_links", broken), ("incoming_links", incoming), ("duplicates", duplicates)):
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def as_json(df: DataFrame) -> DataFrame:
    """SNK7: rows as JSON documents."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def audit_pages(violations: DataFrame) -> DataFrame:
    """SNK6: (page, html) audit reports; every text is escaped."""
    from webstrata.plans.assets import escaped

    row = F.concat(F.lit("<li>"), F.expr(escaped("rule")), F.lit(": "), F.col("nodes").cast("string"), F.lit("</li>"))
    listed = violations.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("items"))
    return listed.select("page", F.concat(F.lit("<!DOCTYPE html><title>"), F.expr(escaped("page")), F.lit("</title><ul>"), "items", F.lit("</ul>")).alias("html"))


def image_urls(pages: DataFrame) -> DataFrame:
    """SNK4: distinct pictures of pages, ready to be fetched."""
    return pages.select(F.explode(F.expr(Spark.every("html", r"(?i)<img\b[^>]*?\ssrc\s*=\s*\x22(https?://[^\x22]+)\x22"))).alias("src")).distinct()


def hosts(urls: DataFrame, domain: str) -> DataFrame:
    """F8: URLs of one host."""
    return urls.filter(F.expr(S.host(Spark, "url")) == domain)
