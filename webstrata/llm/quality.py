"""Quality rules: one threshold table compiled into one projection, without user functions.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Repeated rows, ties and null
ids are judged row by row. Only the columns named below are read, so extra or clashing input columns do no harm
(``keep_clean`` returns the input columns unchanged). An empty table gives an empty result. No shuffle takes place,
whatever the key distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

# Frequent function words of the four languages in the corpus.
STOP_WORDS = (
    "the of and to in is that it for was on are be by with as this "
    "le la les de des du et un une en que qui est dans pour par "
    "der die das und den von zu mit ist nicht ein eine auf "
    "el los las y por para con del una como al"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= value <= high``; a null value (nothing to divide by) passes."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None


#: The threshold table. Values are SQL over the measures of ``measures``.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", 2.0, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words / n_words", 0.05, None),
    Rule("alphabetic_words", "n_alpha_words / n_words", 0.6, None),
    Rule("duplicate_lines", "n_dup_line_words / n_words", None, 0.3),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.9),
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for use in higher-order functions, where a repeated expression would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


#: Places in the low bits of a window's code; texts of more words go the slow way.
PLACE_BITS = 20


def covered_words(places: Column) -> Column:
    """Words under 3-word windows at the given ascending places."""
    start = F.struct(F.lit(-3).cast("long").alias("at"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(places, start, lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["at"])).alias("n")), lambda a: a["n"])


def repeat_words_by_string(words: Column) -> Column:
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.array_join(F.slice(words, i + 1, 3), " ").alias("k"), i.cast("long").alias("i")))

    def places(s: Column) -> Column:
        near = lambda x, i: F.coalesce(x["k"] == F.get(s, i - 1)["k"], F.lit(False)) | F.coalesce(x["k"] == F.get(s, i + 1)["k"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, near), lambda x: x["i"]))

    return covered_words(let(F.array_sort(windows), places))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted as codes of (hash, place), and neighbours with one hash are compared word by word. A text in
    which two different windows share a hash, or of more words than a code has places, is sorted by the windows themselves.
    """
    one = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    codes = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.shiftleft(one(i), PLACE_BITS).bitwiseOR(i.cast("long"))))
    tag = lambda x: F.shiftright(x, PLACE_BITS)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))

    def fast(c: Column) -> Column:
        same = lambda x, other: F.coalesce(tag(x) == tag(other), F.lit(False))
        window = lambda x: F.slice(words, place(x).cast("int") + 1, 3)
        twins = F.filter(c, lambda x, i: same(x, F.get(c, i - 1)) | same(x, F.get(c, i + 1)))

        def settled(t: Column) -> Column:
            clash = F.exists(F.transform(t, lambda x, i: F.struct(x.alias("x"), F.get(t, i + 1).alias("y"))), lambda p: same(p["x"], p["y"]) & (window(p["x"]) != window(p["y"])))
            return F.when(clash, repeat_words_by_string(words)).otherwise(covered_words(F.sort_array(F.transform(t, place))))

        return let(twins, settled)

    few = F.size(words) < (1 << PLACE_BITS)
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).when(few, let(codes, fast)).otherwise(repeat_words_by_string(words))


def words_of(lines: Column) -> Column:
    return F.regexp_count(F.array_join(lines, "\n"), F.lit(r"[^\x20\x09-\x0D]+"))


def measures(text: Column) -> Column:
    """All counts of one text as a struct; words, lines and characters are each cut once."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_alpha_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.when(F.size(x) > F.size(F.array_distinct(x)), words_of(x) - words_of(F.array_distinct(x))).otherwise(0).cast("long").alias("n_dup_line_words"),
            F.size(F.filter(x, lambda y: y.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(x, lambda y: y.rlike(r"^[\x20\x09-\x0D]*[-*•]\x20"))).cast("long").alias("n_bullet_lines"),
        ),
    )
    return F.struct(
        of_words.alias("w"),
        of_lines.alias("l"),
        F.char_length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )


def passes(rule: Rule) -> Column:
    value = F.expr(f"try_divide({', '.join(rule.value.split(' / '))})" if " / " in rule.value else rule.value)
    ok = F.lit(True)
    if rule.low is not None:
        ok &= value >= F.lit(float(rule.low))
    if rule.high is not None:
        ok &= value <= F.lit(float(rule.high))
    return F.coalesce(ok, F.lit(True))


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``keep`` columns, the measures, ``base_failed``, ``kept`` and the names of the rules that failed."""
    # A generator evaluates the measures once, whatever later projections and filters ask of them.
    out = docs.select(*keep, F.explode(F.array(measures(F.col(text)))).alias("_m"))
    names = ("w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "l.n_dup_line_words", "w.n_repeat_words", "w.n_stop_words", "w.n_alpha_words", "l.n_lines", "l.n_ellipsis_lines", "l.n_bullet_lines")
    out = out.select(*keep, *(F.col(f"_m.{n}").alias(n.split(".")[-1]) for n in names))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    failed = F.array_join(F.filter(F.array(*(F.when(~passes(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()), ",")
    return out.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def keep_clean(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns. The verdict is one projection and one filter."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    judged = judge(docs.select(row, F.col("text")), ("_row",), rules)
    return judged.filter("kept").select("_row.*")


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def _sql_rule(rule: Rule) -> str:
    parts = rule.value.split(" / ")
    value = f"(CAST({parts[0]} AS DOUBLE) / nullif({parts[1]}, 0))" if len(parts) == 2 else f"CAST({parts[0]} AS DOUBLE)"
    tests = [f"{value} {sign} {float(bound)}" for sign, bound in ((">=", rule.low), ("<=", rule.high)) if bound is not None]
    return f"coalesce({' AND '.join(tests)}, true)"


def oracle() -> str:
    """DuckDB's reading of the same contract, by unnested windows instead of sorted arrays."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    failed = ", ".join(f"CASE WHEN NOT {_sql_rule(r)} THEN '{r.name}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
m AS (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
  len(w) - coalesce(list_sum(list_transform(list_distinct(l), lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0) AS n_dup_line_words,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha_words,
  len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]\x20'))) AS n_bullet_lines FROM w),
f AS (SELECT m.*, coalesce(c.n, 0) AS n_repeat_words FROM m LEFT JOIN c USING (rid)),
j AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM j
"""
