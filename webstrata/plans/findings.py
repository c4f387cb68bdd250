"""The catalogue of findings: evidence rows of every check, one aggregation, and a table of rules over its counts.

Each check yields rows (scan, id, key, value, page). Counting them gives, per scan and id, ``g`` different keys, ``a``
pages and ``c`` rows; per scan there are ``t`` pages, ``w`` with structured data, ``q`` with question headings, ``m``
with dates, ``y`` with a copyright year, ``o`` with an organisation and ``s`` with sameAs links. RULES say when a
finding holds, how severe it is and how many pages it counts for, in SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from webstrata.functions import scalars as S
from webstrata.functions.dialect import Duck, Spark
from webstrata.operators import extract as X
from webstrata.plans import access, content, graph
from webstrata.plans.catalog import query
from webstrata.session import materialise
from webstrata.sources import corpus

#: (id, category, confidence, holds, severity, pages counted), in the order ratings take them.
RULES = [
    ("contradictory-phone-numbers", "facts", "strong", "g >= 2", "case when g > 3 then 'high' else 'medium' end", "a"),
    ("contradictory-postcodes", "facts", "strong", "g >= 2", "case when g > 3 then 'high' else 'medium' end", "a"),
    ("contradictory-emails", "facts", "strong", "g >= 2", "case when g > 3 then 'high' else 'medium' end", "a"),
    ("price-spread", "facts", "weak", "g > 1", "'low'", "a"),
    ("duplicate-titles", "metadata", None, "g > 0", "case when a > t * 0.2 then 'high' else 'medium' end", "a"),
    ("duplicate-h1s", "metadata", None, "g > 0", "case when a > t * 0.2 then 'high' else 'medium' end", "a"),
    ("duplicate-descriptions", "metadata", None, "g > 0", "case when a > t * 0.2 then 'high' else 'medium' end", "a"),
    ("missing-titles", "metadata", None, "a > 0", "case when a > t * 0.3 then 'high' else 'low' end", "a"),
    ("missing-descriptions", "metadata", None, "a > 0", "case when a > t * 0.3 then 'high' else 'low' end", "a"),
    ("missing-h1", "metadata", None, "a > 0", "case when a > t * 0.3 then 'high' else 'low' end", "a"),
    ("multiple-h1", "metadata", None, "a > 0", "case when a > t * 0.3 then 'high' else 'low' end", "a"),
    ("title-h1-mismatch", "metadata", None, "a > 0", "'low'", "a"),
    ("canonical-conflicts", "metadata", None, "a > 0", "'medium'", "a"),
    ("noindex-pages", "metadata", None, "a > 0", "'low'", "a"),
    ("no-structured-data", "structured-data", None, "w = 0", "'high'", "t"),
    ("partial-structured-data", "structured-data", None, "w > 0 and floor(100.0 * w / t + 0.5) < 80", "case when floor(100.0 * w / t + 0.5) < 40 then 'high' else 'medium' end", "a"),
    ("invalid-structured-data", "structured-data", None, "w > 0 and a > 0", "'high'", "a"),
    ("organization-name-conflict", "structured-data", None, "g >= 2", "'high'", "a"),
    ("organization-telephone-conflict", "structured-data", None, "g >= 2", "'high'", "a"),
    ("organization-email-conflict", "structured-data", None, "g >= 2", "'high'", "a"),
    ("organization-legalName-conflict", "structured-data", None, "g >= 2", "'high'", "a"),
    ("temporal-stale-copyright", "facts", "confirmed", "a > 0", "case when a > y * 0.5 then 'medium' else 'low' end", "a"),
    ("temporal-mixed-copyright-years", "facts", "confirmed", "g > 1", "'low'", "y"),
    ("no-organization-entity", "structured-data", "confirmed", "w > 0 and o = 0", "'medium'", "t"),
    ("jsonld-page-phone-mismatch", "structured-data", "strong", "c > 0", "'medium'", "c"),
    ("no-sameas-anchoring", "structured-data", "confirmed", "o > 0 and s = 0", "'low'", "o"),
    ("inconsistent-sameas", "structured-data", "strong", "g > 1", "'low'", "a"),
    ("anchor-terminology-drift", "terminology", "weak", "g > 0", "case when g > 10 then 'medium' else 'low' end", "g"),
    ("access-blanket-disallow", "access", "confirmed", "a > 0", "'high'", "999999"),
    ("access-inconsistent-ai-policy", "access", "strong", "a > 0", "'low'", "1"),
    ("access-no-llms-txt", "access", "confirmed", "a > 0", "'low'", "1"),
    ("access-oversized-pages", "access", "confirmed", "a > 0", "'low'", "a"),
    ("access-broken-links", "access", "confirmed", "c > 0", "case when c >= 10 then 'medium' else 'low' end", "c"),
    ("extract-no-semantic-main", "extractability", "strong", "a > t * 0.2", "case when a > t * 0.8 then 'medium' else 'low' end", "a"),
    ("extract-no-question-headings", "extractability", "strong", "q = 0 and t >= 5", "'low'", "t"),
    ("extract-facts-in-images", "extractability", "weak", "a > 0", "'medium'", "a"),
    ("extract-no-dates", "extractability", "weak", "m = 0 and t >= 5", "'low'", "t"),
]
OVERSIZED = 2 * 1024 * 1024
FACT_IDS = {"phone": "contradictory-phone-numbers", "postcode": "contradictory-postcodes", "email": "contradictory-emails", "price": "price-spread"}


def _by_rule(index: int) -> str:
    return "case id " + " ".join(f"when '{r[0]}' then {r[index]}" for r in RULES) + " end"


def _quoted(index: int) -> str:
    return "case id " + " ".join(f"when '{r[0]}' then '{r[index]}'" for r in RULES if r[index]) + " end"


_ORD = "case id " + " ".join(f"when '{r[0]}' then {i}" for i, r in enumerate(RULES)) + " end"


def fact_key(D) -> str:
    return f"case kind when 'phone' then {S.phone_key(D, 'value')} when 'postcode' then upper({D.rep('value', r'\s+', '')}) else value end"


def _mismatch(D) -> str:
    low = lambda e: f"lower({S.squeeze(D, e)})"
    head = D.first("h1s")
    prefix = "split_part(title, '|', 1)"
    return f"title is not null and h1_count = 1 and not {D.contains(low('title'), low(head))} and not {D.contains(low(head), low(prefix))}"


def _away(D) -> str:
    return f"canonical is not null and {D.rep('canonical', '/+$', '')} <> {D.rep('url', '/+$', '')}"


def _org_key(D, field: str) -> str:
    return S.phone_key(D, "telephone") if field == "telephone" else f"lower({S.squeeze(D, field)})"


def _same_key(D) -> str:
    kept = D.keep("same_as", "u", "u is not null and trim(u) <> ''")
    sort = "array_sort" if D.__name__ == "Spark" else "list_sort"
    return D.join(f"{sort}({D.map(kept, 'u', D.rep('lower(trim(u))', '/+$', ''))})", " ")


def stated(pages: DataFrame) -> DataFrame:
    """Profile, facts and newest copyright year of every page, from one text."""
    text = X.stripped(pages)
    text = text.select(*X.KEY, *X.PROFILE, F.explode(F.array(F.expr(S.shown(Spark, "text")))).alias("text"))
    return text.select(*X.KEY, *X.PROFILE, X.kinds("text").alias("kinds"), F.array_max(F.expr(content.years(Spark))).alias("year"))


def evidence(pages: DataFrame, broken: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All evidence rows, and the counts per scan. Metadata, facts and nodes are extracted once each."""
    meta = materialise(X.page_meta(pages).drop("size"))
    read = materialise(stated(pages))
    facts, profile, dated = X.listed(read), read, read.filter("year is not null")
    ld = materialise(X.jsonld(pages))
    page = F.col("pid").cast("string").alias("page")

    def rows(df: DataFrame, id_: str | Column, key: str | Column, value: str | Column | None = None) -> DataFrame:
        as_col = lambda x: x if isinstance(x, Column) else F.expr(x)
        key = as_col(key)
        return df.select("scan", (F.lit(id_) if isinstance(id_, str) else id_).alias("id"), key.alias("key"), (key if value is None else as_col(value)).alias("value"), page)

    ids = F.create_map(*(F.lit(x) for kv in FACT_IDS.items() for x in kv))
    dup = F.explode(F.concat(F.array(F.struct(F.lit("duplicate-titles").alias("id"), F.expr(S.squeeze(Spark, "title")).alias("v")), F.struct(F.lit("duplicate-descriptions").alias("id"), F.expr(S.squeeze(Spark, "description")).alias("v"))), F.transform("h1s", lambda h: F.struct(F.lit("duplicate-h1s").alias("id"), h.alias("v")))))
    dups = meta.select("scan", "pid", dup.alias("d")).select("scan", "pid", "d.id", F.col("d.v").alias("key")).filter("key is not null and key <> ''")
    often = dups.groupBy("scan", "id", "key").agg(F.countDistinct("pid").alias("n")).filter("n > 1").drop("n")
    good = ld.filter("invalid is null")
    with_ld = good.select("scan", "pid").distinct()
    org = good.filter(F.expr(Spark.like("type", S.ORG)))
    same = org.withColumn("key", F.expr(_same_key(Spark))).filter("key <> ''")
    phones = facts.filter("kind = 'phone'").groupBy("scan", "pid").agg(F.collect_set(F.expr(S.phone_key(Spark, "value"))).alias("keys"))
    miss = org.filter(F.trim("telephone") != "").join(phones, ["scan", "pid"]).filter(~F.expr(f"array_contains(keys, {S.phone_key(Spark, 'telephone')})"))
    drift = graph.drift(pages)
    policy = materialise(access.policies(files))
    out = [
        rows(facts, ids[F.col("kind")], fact_key(Spark), "value"),
        rows(dups.join(often, ["scan", "id", "key"]), F.col("id"), F.col("key")),
        *(rows(meta.filter(test), id_, F.lit(label)) for id_, test, label in (("missing-titles", "title is null", "title"), ("missing-descriptions", "description is null", "meta description"), ("missing-h1", "h1_count = 0", "H1 heading"), ("multiple-h1", "h1_count > 1", "more than one H1"), ("noindex-pages", "array_contains(directives, 'noindex')", "noindex"))),
        rows(meta.filter(_mismatch(Spark)), "title-h1-mismatch", "concat(title, ' vs ', get(h1s, 0))"),
        rows(meta.filter(_away(Spark)), "canonical-conflicts", "concat(url, ' -> ', canonical)"),
        rows(pages, "no-structured-data", F.lit("no JSON-LD")),
        rows(pages.join(with_ld, ["scan", "pid"], "left_anti"), "partial-structured-data", F.lit("pages without JSON-LD")),
        rows(ld.filter("invalid is not null"), "invalid-structured-data", F.col("invalid")),
        *(rows(org.filter(f"trim({f}) <> ''"), f"organization-{f}-conflict", _org_key(Spark, f), S.squeeze(Spark, f)) for f in ("name", "telephone", "email", "legalName")),
        rows(dated.filter(f"year <= {content.YEAR - 2}"), "temporal-stale-copyright", "concat('© ', cast(year as string))"),
        rows(dated, "temporal-mixed-copyright-years", "concat('© ', cast(year as string))"),
        rows(pages, "no-organization-entity", F.lit("no Organization")),
        rows(miss, "jsonld-page-phone-mismatch", S.squeeze(Spark, "telephone")),
        rows(org, "no-sameas-anchoring", F.lit("no sameAs")),
        rows(same, "inconsistent-sameas", F.col("key")),
        drift.select("scan", F.lit("anchor-terminology-drift").alias("id"), F.col("target").alias("key"), F.col("names").alias("value"), F.col("target").alias("page")),
        *(policy.filter(test).select("scan", F.lit(id_).alias("id"), F.expr(value).alias("key"), F.expr(value).alias("value"), F.lit(p).alias("page")) for id_, test, value, p in (("access-blanket-disallow", "blanket", "'Disallow: /'", "robots.txt"), ("access-inconsistent-ai-policy", "not blanket and ai_policy = 'partial'", "names", "robots.txt"), ("access-no-llms-txt", "no_llms", "'llms.txt not found'", "llms.txt"))),
        rows(pages.filter(F.col("size") > OVERSIZED), "access-oversized-pages", "format_string('%.1f MB', size / 1048576.0)"),
        broken.select("scan", F.lit("access-broken-links").alias("id"), F.col("url").alias("key"), F.col("url").alias("value"), F.col("url").alias("page")),
        rows(profile.filter("not has_main"), "extract-no-semantic-main", F.lit("No <main>/<article>")),
        rows(pages, "extract-no-question-headings", F.lit("No question headings found")),
        rows(profile.filter("size(image_facts) > 0"), "extract-facts-in-images", F.get("image_facts", F.lit(0))),
        rows(pages, "extract-no-dates", F.lit("No <time> elements found")),
    ]
    union = out[0]
    for df in out[1:]:
        union = union.unionByName(df)
    counts = [with_ld.groupBy("scan").agg(F.count(F.lit(1)).alias("w")), profile.groupBy("scan").agg(F.count_if(F.col("question_headings") > 0).alias("q"), F.count_if("has_time").alias("m")), dated.groupBy("scan").agg(F.count(F.lit(1)).alias("y")), org.groupBy("scan").agg(F.countDistinct("pid").alias("o")), same.groupBy("scan").agg(F.countDistinct("pid").alias("s"))]
    stats = pages.groupBy("scan").agg(F.count(F.lit(1)).alias("t"))
    for c in counts:
        stats = stats.join(c, "scan", "left")
    return union, stats.na.fill(0)


def report(pages: DataFrame, broken: DataFrame, files: DataFrame) -> DataFrame:
    """scan, ord, id, category, severity, confidence, pages_affected, total_pages, evidence (12 largest groups)."""
    rows, stats = evidence(pages, broken, files)
    rows = materialise(rows)
    groups = rows.groupBy("scan", "id", "key").agg(F.min("value").alias("value"), F.countDistinct("page").alias("n"))
    top = groups.withColumn("_r", F.row_number().over(W.partitionBy("scan", "id").orderBy(F.desc("n"), "value", "key"))).filter("_r <= 12")
    text = F.concat("value", F.lit(" ("), "n", F.lit(")"))
    listed = top.groupBy("scan", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("v")))), lambda x: x["v"]), "; ").alias("evidence"))
    counted = rows.groupBy("scan", "id").agg(F.countDistinct("key").alias("g"), F.countDistinct("page").alias("a"), F.count(F.lit(1)).alias("c"))
    met = counted.join(listed, ["scan", "id"]).join(stats, "scan")
    return met.filter(F.expr(_by_rule(3))).select("scan", F.expr(_ORD).cast("long").alias("ord"), "id", F.expr(_quoted(1)).alias("category"), F.expr(_by_rule(4)).alias("severity"), F.expr(_quoted(2)).alias("confidence"), F.expr(_by_rule(5)).cast("long").alias("pages_affected"), F.col("t").alias("total_pages"), "evidence")


def site_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(corpus.pages(spark, sf_dir), graph.artifacts(spark)[0], access.site_files(spark))


def _sql() -> str:
    page = "CAST(pid AS VARCHAR)"
    parts = [f"SELECT scan, CASE kind {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in FACT_IDS.items())} END AS id, {fact_key(Duck)} AS key, value, {page} AS page FROM fact"]
    parts.append(f"SELECT scan, id, key, key, page FROM (SELECT *, count(DISTINCT page) OVER (PARTITION BY scan, id, key) AS n FROM (SELECT scan, 'duplicate-titles' AS id, {S.squeeze(Duck, 'title')} AS key, {page} AS page FROM meta UNION ALL SELECT scan, 'duplicate-descriptions', {S.squeeze(Duck, 'description')}, {page} FROM meta UNION ALL SELECT scan, 'duplicate-h1s', unnest(h1s), {page} FROM meta) WHERE key <> '') WHERE n > 1")

    def add(source: str, test: str, id_: str, key: str, value: str | None = None, p: str = page) -> None:
        parts.append(f"SELECT scan, '{id_}', {key}, {value or key}, {p} FROM {source} WHERE {test}")

    for id_, test, label in (("missing-titles", "title IS NULL", "title"), ("missing-descriptions", "description IS NULL", "meta description"), ("missing-h1", "h1_count = 0", "H1 heading"), ("multiple-h1", "h1_count > 1", "more than one H1"), ("noindex-pages", "list_contains(directives, 'noindex')", "noindex")):
        add("meta", test, id_, f"'{label}'")
    add("meta", _mismatch(Duck), "title-h1-mismatch", "concat(title, ' vs ', h1s[1])")
    add("meta", _away(Duck), "canonical-conflicts", "concat(url, ' -> ', canonical)")
    add("page", "true", "no-structured-data", "'no JSON-LD'")
    add("page p", "NOT EXISTS (SELECT 1 FROM good g WHERE g.scan = p.scan AND g.pid = p.pid)", "partial-structured-data", "'pages without JSON-LD'")
    add("ld", "invalid IS NOT NULL", "invalid-structured-data", "invalid")
    for f in ("name", "telephone", "email", "legalName"):
        add("org", f"trim({f}) <> ''", f"organization-{f}-conflict", _org_key(Duck, f), S.squeeze(Duck, f))
    add("dated", f"year <= {content.YEAR - 2}", "temporal-stale-copyright", "concat('© ', year)")
    add("dated", "true", "temporal-mixed-copyright-years", "concat('© ', year)")
    add("page", "true", "no-organization-entity", "'no Organization'")
    add("org", f"trim(telephone) <> '' AND EXISTS (SELECT 1 FROM fact f WHERE f.scan = org.scan AND f.pid = org.pid AND kind = 'phone') AND NOT EXISTS (SELECT 1 FROM fact f WHERE f.scan = org.scan AND f.pid = org.pid AND kind = 'phone' AND {S.phone_key(Duck, 'f.value')} = {S.phone_key(Duck, 'org.telephone')})", "jsonld-page-phone-mismatch", S.squeeze(Duck, "telephone"))
    add("org", "true", "no-sameas-anchoring", "'no sameAs'")
    add("org", f"{_same_key(Duck)} <> ''", "inconsistent-sameas", _same_key(Duck))
    add("drift", "true", "anchor-terminology-drift", "target", "names", "target")
    add("policy", "blanket", "access-blanket-disallow", "'Disallow: /'", None, "'robots.txt'")
    add("policy", "NOT blanket AND ai_policy = 'partial'", "access-inconsistent-ai-policy", "names", None, "'robots.txt'")
    add("policy", "no_llms", "access-no-llms-txt", "'llms.txt not found'", None, "'llms.txt'")
    add("page", f"size > {OVERSIZED}", "access-oversized-pages", "printf('%.1f MB', size / 1048576.0)")
    add("broken", "true", "access-broken-links", "url", None, "url")
    add("profile", "NOT has_main", "extract-no-semantic-main", "'No <main>/<article>'")
    add("page", "true", "extract-no-question-headings", "'No question headings found'")
    add("profile", "len(image_facts) > 0", "extract-facts-in-images", "image_facts[1]")
    add("page", "true", "extract-no-dates", "'No <time> elements found'")
    return f"""WITH {graph.E}, {graph.A}, {graph.DRIFT}, {X.meta_sql()}, {X.facts_sql()}, {X.jsonld_sql()}, {X.profile_sql()},
dated AS (SELECT scan, pid, path, list_max({content.years(Duck)}) AS year FROM visible WHERE len({content.years(Duck)}) > 0), {access.R},
good AS (SELECT * FROM ld WHERE invalid IS NULL), org AS (SELECT * FROM good WHERE {Duck.like('type', S.ORG)}),
ev AS ({' UNION ALL '.join(parts)}),
st AS (SELECT scan, count(*) AS t, (SELECT count(DISTINCT pid) FROM good g WHERE g.scan = p.scan) AS w, (SELECT count(*) FROM profile g WHERE g.scan = p.scan AND question_headings > 0) AS q, (SELECT count(*) FROM profile g WHERE g.scan = p.scan AND has_time) AS m, (SELECT count(*) FROM dated g WHERE g.scan = p.scan) AS y, (SELECT count(DISTINCT pid) FROM org g WHERE g.scan = p.scan) AS o, (SELECT count(DISTINCT pid) FROM org g WHERE g.scan = p.scan AND {_same_key(Duck)} <> '') AS s FROM page p GROUP BY scan),
gr AS (SELECT scan, id, key, min(value) AS value, count(DISTINCT page) AS n FROM ev GROUP BY ALL),
ls AS (SELECT scan, id, array_to_string(list(concat(value, ' (', n, ')') ORDER BY r), '; ') AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY scan, id ORDER BY n DESC, value, key) AS r FROM gr) WHERE r <= 12 GROUP BY ALL),
ct AS (SELECT scan, id, count(DISTINCT key) AS g, count(DISTINCT page) AS a, count(*) AS c FROM ev GROUP BY ALL),
finding AS (SELECT scan, CAST({_ORD} AS BIGINT) AS ord, id, {_quoted(1)} AS category, {_by_rule(4)} AS severity, {_quoted(2)} AS confidence, CAST({_by_rule(5)} AS BIGINT) AS pages_affected, CAST(t AS BIGINT) AS total_pages, evidence FROM ct JOIN ls USING (scan, id) JOIN st USING (scan) WHERE {_by_rule(3)})"""


SQL = _sql()


@query("consistency_report", f"{SQL} SELECT * FROM finding")
def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of every scan."""
    return site_report(spark, sf_dir)


@query("findings_summary", f"{SQL} SELECT scan, CAST(count(*) AS BIGINT) AS findings, CAST(count(*) FILTER (WHERE severity = 'high') AS BIGINT) AS high, CAST(count(*) FILTER (WHERE severity = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (WHERE severity = 'low') AS BIGINT) AS low, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM finding GROUP BY scan")
def findings_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = site_report(spark, sf_dir)
    return f.groupBy("scan").agg(F.count(F.lit(1)).alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
