"""Crawler access: robots.txt rules, the policy towards AI crawlers, blocked addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webstrata.plans.catalog import query
from webstrata.sources import corpus

# User agents of AI crawlers.
AI_CRAWLERS = ["GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "Claude-Web", "Google-Extended", "PerplexityBot", "CCBot", "Applebot-Extended", "Bytespider", "meta-externalagent"]

#: Fetched site files; a null text was not found.
FILES = [
    ("loans.example", "robots.txt", "# all out\nUser-agent: *\nDisallow: /\n"),
    ("loans.example", "llms.txt", None),
    ("bank.example", "robots.txt", "User-agent: GPTBot\nUser-agent: CCBot # two\nDisallow: /\nSitemap: https://bank.example/map.xml\n\nUser-agent: *\nDisallow:\nAllow: /open:door\n"),
    ("bank.example", "llms.txt", "# Bank"),
    ("trio.example", "robots.txt", "".join(f"User-agent: {a}\n" for a in AI_CRAWLERS) + "Disallow: /\nUser-agent: *\nDisallow: /admin\n"),
    ("trio.example", "llms.txt", "hello"),
    ("graph.example", "robots.txt", None),
    ("graph.example", "llms.txt", None),
]
S = f"site_file AS (SELECT * FROM {corpus.values(FILES)} t(scan, name, text))"


def site_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "scan string, name string, text string")


def parse(text: str) -> dict[str, list[tuple[str, str]]]:
    """Agents to rules. A user-agent line after rules begins a new group; empty groups stay, and shadow ``*``."""
    groups: dict[str, list[tuple[str, str]]] = {}
    agents: list[str] = []
    for line in re.split(r"\r?\n", text):
        field, mark, value = line.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            if any(groups.get(a) for a in agents):
                agents = []
            agents.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif field in ("allow", "disallow"):
            for a in agents:
                groups[a].append((field, value))
    return groups


def rules(files: DataFrame) -> DataFrame:
    """(scan, agent, pos, rule, path); an agent without rules has one row with a null rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, a, i, r, p) for s, t in zip(batch["scan"], batch["text"], strict=True) for a, found in parse(t).items() for i, (r, p) in enumerate(found or [(None, None)])]
            yield pd.DataFrame(rows, columns=["scan", "agent", "pos", "rule", "path"])

    return files.filter("name = 'robots.txt' and text is not null").select("scan", "text").mapInPandas(run, "scan string, agent string, pos long, rule string, path string")


R = f"""{S}, line AS (SELECT scan, n, trim(regexp_replace(l, '#.*$', '')) AS l FROM (SELECT scan, unnest(range(0, len(x))) AS n, unnest(x) AS l FROM (SELECT scan, string_split(replace(text, chr(13), ''), chr(10)) AS x FROM site_file WHERE name = 'robots.txt' AND text IS NOT NULL))),
fld AS (SELECT scan, n, lower(trim(regexp_extract(l, '^([^:]*)', 1))) AS f, trim(regexp_extract(l, '^[^:]*:(.*)$', 1)) AS v FROM line WHERE l <> ''),
rel AS (SELECT *, lag(f) OVER (PARTITION BY scan ORDER BY n) AS pf FROM fld WHERE f IN ('user-agent', 'allow', 'disallow')),
grp AS (SELECT *, sum(CASE WHEN f = 'user-agent' AND coalesce(pf, 'allow') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY scan ORDER BY n) AS g FROM rel),
rob AS (SELECT u.scan, lower(u.v) AS agent, CASE WHEN r.n IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY u.scan, u.v ORDER BY r.n) - 1 END AS pos, r.f AS rule, r.v AS path FROM grp u LEFT JOIN grp r ON r.scan = u.scan AND r.g = u.g AND r.f <> 'user-agent' WHERE u.f = 'user-agent'),
agent AS (SELECT scan, agent, bool_or(coalesce(rule = 'disallow' AND path = '/', false)) AND NOT bool_or(coalesce(rule = 'allow' AND path <> '', false)) AS blocked FROM rob GROUP BY ALL),
bot AS (SELECT s.scan, b.name, coalesce(a.blocked, w.blocked, false) AS blocked FROM (SELECT scan FROM site_file WHERE name = 'robots.txt' AND text IS NOT NULL) s CROSS JOIN (SELECT unnest([{", ".join(f"'{a}'" for a in AI_CRAWLERS)}]) AS name) b LEFT JOIN agent a ON a.scan = s.scan AND a.agent = lower(b.name) LEFT JOIN agent w ON w.scan = s.scan AND w.agent = '*'),
pol AS (SELECT scan, count(*) FILTER (WHERE blocked) AS blocked, array_to_string(list_sort(list(name) FILTER (WHERE blocked)), ', ') AS names FROM bot GROUP BY scan),
policy AS (SELECT f.scan, CASE WHEN f.text IS NULL THEN 'absent' ELSE 'present' END AS robots, CASE WHEN p.blocked = 12 THEN 'all-blocked' WHEN p.blocked > 0 THEN 'partial' WHEN p.blocked = 0 THEN 'open' END AS ai_policy, p.blocked, p.names, coalesce((SELECT bool_and(a.blocked) AND bool_or(a.agent = '*') FROM agent a WHERE a.scan = f.scan), false) AS blanket, l.text IS NULL AS no_llms FROM site_file f JOIN site_file l ON l.scan = f.scan AND l.name = 'llms.txt' LEFT JOIN pol p ON p.scan = f.scan WHERE f.name = 'robots.txt')"""


@query("robots_rules", f"WITH {R} SELECT scan, agent, CAST(pos AS BIGINT) AS pos, rule, path FROM rob")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(site_files(spark))


def policies(files: DataFrame) -> DataFrame:
    """What robots.txt says to AI crawlers (named group, else ``*``), and whether all are kept out."""
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    agent = rules(files).groupBy("scan", "agent").agg((yes((F.col("rule") == "disallow") & (F.col("path") == "/")) & ~yes((F.col("rule") == "allow") & (F.col("path") != ""))).alias("blocked"))
    robots = files.filter("name = 'robots.txt'").select("scan", F.col("text").isNotNull().alias("present"))
    bots = robots.filter("present").select("scan", F.explode(F.array(*(F.lit(a) for a in AI_CRAWLERS))).alias("bot")).withColumn("agent", F.lower("bot"))
    star = agent.filter("agent = '*'").select("scan", F.col("blocked").alias("star"))
    bots = bots.join(agent, ["scan", "agent"], "left").join(star, "scan", "left").withColumn("out", F.coalesce("blocked", "star", F.lit(False)))
    counted = bots.groupBy("scan").agg(F.count_if("out").alias("blocked"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("out"), F.col("bot")))), ", ").alias("names"))
    blanket = agent.groupBy("scan").agg((F.bool_and("blocked") & F.bool_or(F.col("agent") == "*")).alias("blanket"))
    llms = files.filter("name = 'llms.txt'").select("scan", F.col("text").isNull().alias("no_llms"))
    policy = F.when(F.col("blocked") == len(AI_CRAWLERS), "all-blocked").when(F.col("blocked") > 0, "partial").when(F.col("blocked") == 0, "open")
    out = robots.join(llms, "scan").join(counted, "scan", "left").join(blanket, "scan", "left")
    return out.select("scan", F.when(F.col("present"), "present").otherwise("absent").alias("robots"), policy.alias("ai_policy"), "blocked", "names", F.coalesce("blanket", F.lit(False)).alias("blanket"), "no_llms")


@query("ai_policy", f"WITH {R} SELECT scan, robots, ai_policy, CAST(coalesce(blocked, 0) AS BIGINT) AS blocked, coalesce(names, '') AS names, blanket, no_llms FROM policy")
def ai_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies(site_files(spark)).withColumn("blocked", F.coalesce("blocked", F.lit(0).cast("long"))).withColumn("names", F.coalesce("names", F.lit("")))


ADDRESSES = ["127.0.0.1", "10.1.2.3", "172.16.0.1", "172.32.0.1", "192.168.4.5", "169.254.169.254", "100.64.0.1", "100.128.0.1", "224.0.0.1", "8.8.8.8", "0.0.0.0", "::1", "::", "fe80::1", "fd00::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.4.4"]


def _blocked(a: str, b: str) -> str:
    return f"({a} in (0, 10, 127) or {a} >= 224 or ({a} = 172 and {b} between 16 and 31) or ({a} = 192 and {b} = 168) or ({a} = 169 and {b} = 254) or ({a} = 100 and {b} between 64 and 127))"


_V4 = r"^(?:::ffff:)?([0-9]+)\.([0-9]+)\.[0-9]+\.[0-9]+$"
_DUCK = "CASE WHEN regexp_matches(ip, '{p}') THEN {b} ELSE ip IN ('::', '::1') OR regexp_matches(ip, '^(?:fe80|fc|fd)') END".format(p=_V4, b=_blocked(f"CAST(regexp_extract(ip, '{_V4}', 1) AS INT)", f"CAST(regexp_extract(ip, '{_V4}', 2) AS INT)"))


@query("ssrf_blocked", f"SELECT ip, {_DUCK} AS blocked FROM {corpus.values([(a,) for a in ADDRESSES])} t(ip)")
def ssrf_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses a scan must never reach, mapped ones included."""
    ips = spark.createDataFrame([(a,) for a in ADDRESSES], "ip string")
    part = lambda n: f"try_cast(regexp_extract(ip, r'{_V4}', {n}) as int)"
    v6 = F.col("ip").isin("::", "::1") | F.col("ip").rlike("^(?:fe80|fc|fd)")
    return ips.select("ip", F.when(F.col("ip").rlike(_V4), F.expr(_blocked(part(1), part(2)))).otherwise(v6).alias("blocked"))


HOSTS = [("a.example", "8.8.8.8"), ("a.example", "1.1.1.1"), ("b.example", "8.8.8.8"), ("b.example", "10.0.0.1"), ("c.example", "::1")]


@query("ssrf_hosts", f"SELECT host, NOT bool_or({_DUCK}) AS allowed FROM {corpus.values(HOSTS)} t(host, ip) GROUP BY host")
def ssrf_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a host may be scanned only if all its addresses are public."""
    part = lambda n: f"try_cast(regexp_extract(ip, r'{_V4}', {n}) as int)"
    v6 = F.col("ip").isin("::", "::1") | F.col("ip").rlike("^(?:fe80|fc|fd)")
    bad = F.when(F.col("ip").rlike(_V4), F.expr(_blocked(part(1), part(2)))).otherwise(v6)
    return spark.createDataFrame(HOSTS, "host string, ip string").groupBy("host").agg((~F.bool_or(bad)).alias("allowed"))
