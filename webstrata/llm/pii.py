"""Information-theoretic sanitisation of personal data.

Base finds (e-mail, IP, card, phone) are the protected entities. Words anywhere in a document with an entity are terms
that may give it away. Over the whole corpus, with n(x) counting documents, a term discloses

    PMI(e; t) = log2(N n(e,t) / (n(e) n(t)))   of the   IC(e) = log2(N / n(e))   bits that identify the entity;

from ``THRESHOLD`` of IC on, every occurrence of the term becomes a span of its own: ``term`` if it is to be
generalised, ``gone`` if it is to be removed because it determines an entity (PMI = IC). Base spans stay as they are.
``op3`` reports all these words of every text as ``disclosing``. Its ``spans`` hold those of documents with an entity
that at least ``SUPPORT`` documents show together with one; ``sanitised`` marks the terms with that support in every
text.

Scale: narrow passes. Documents shrink to spans and entities in the first. Entities of one document, kept apart by a
bitmap, are not paired with the words: such a document marks its words as seen with one, which says all about their
pairs. Pairs and entities of several documents are counted by partial aggregation, so an entity in a third of all
documents meets as one row per task and pair; the count of documents per term covers the candidate terms (bitmaps
keep out most others). Flagged terms meet their places in a join, at any number; ``sanitised`` sends up to
``SMALL`` of them to the tasks.

Defined results: a null text is an empty one; repeated rows are documents of their own; null doc_ids are kept; ties in
start follow the order of kinds; texts of any length are scanned in linear time; an empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import bits
from webstrata.session import materialise, small_batches

#: The last two again: terms without support.
KINDS = ("email", "ip", "card", "phone", "term", "gone", "term", "gone")
SUPPORT = 2
THRESHOLD = 0.8
#: Up to so many terms (some 10 MB) go to every task; beyond, they are joined.
SMALL = 200_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"\w+")


def emails(t: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the run of its characters before it."""
    done, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > done and t[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(t, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = t.find("@", done if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base finds, in order of start, then kind."""
    out = [(a, 0, b, t[a:b].lower()) for a, b in emails(t)] if "@" in t else []
    if DIGIT.search(t):
        for m in IP.finditer(t):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
        for m in CARD.finditer(t):
            if m.end() - m.start() >= 14 and 14 <= len(d := NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end(), d))
        if "+" in t:
            for m in PHONE.finditer(t):
                if 10 <= len(d := NO_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end(), d))
    return sorted(out)


def entity(kind: int, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def words(t: str, spans: list[tuple[int, int, int, str]], wanted=None) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the words of a text that no base span touches; of the wanted ones, if told."""
    ends, end = [], 0
    for _, _, b, _ in spans:
        end = max(end, b)
        ends.append(end)
    i = 0
    for m in TERM.finditer(t) if wanted is None else [m for m in TERM.finditer(t) if m[0].lower() in wanted]:
        a, b = m.span()
        while i < len(spans) and ends[i] <= a:
            i += 1
        if b - a >= 3 and not (i < len(spans) and spans[i][0] < b) and not m[0].isdigit():
            yield m[0].lower(), a, b


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


FOUND = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base", pa.string()), ("entities", pa.list_(pa.int64()))])
FOUND_DDL = "doc_id long, th long, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", base string, entities array<long>"


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> counts, base spans and entities; no text leaves."""
    for batch in batches:
        rows = []
        for t in batch.column(2).to_pylist():
            spans = base_spans(t) if t else []
            n = Counter(s[1] for s in spans)
            rows.append((n[0], n[1], n[2], n[3], joined([s[:3] for s in spans]), sorted({entity(s[1], s[3]) for s in spans})))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(list(c), f.type) for c, f in zip(columns, list(FOUND)[2:], strict=True))], schema=FOUND)


def together(shared, single: bool):
    """Texts -> the entities of each that other documents may show too, whether it has others, and its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            es, alone, ts = [], [], []
            for t in batch.column(0).to_pylist():
                if t and (spans := base_spans(t)):
                    e = np.array(sorted({entity(s[1], s[3]) for s in spans}), np.int64)
                    held = bits.holds(shared.value, e.view(np.uint64))
                    if single or held.any():
                        es.append(e[held].tolist())
                        alone.append(not held.all())
                        ts.append(sorted({w for w, _, _ in words(t, spans)}))
            yield pa.record_batch([pa.array(es, pa.list_(pa.int64())), pa.array(alone, pa.bool_()), pa.array(ts, pa.list_(pa.string()))], names=["e", "alone", "t"])

    return run


def term_hash(t: str) -> int:
    return int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([term_hash(t) for t in batch.column(0).to_pylist()], pa.int64())], names=["h"])


def bitmaps(terms: DataFrame) -> tuple:
    """Of the terms' hashes, by either half: one alone passes one in some twenty of all other words."""
    h = materialise(terms.select("t").mapInArrow(hashed, "h long"))
    n = h.count()
    return bits.bitmap(h, F.col("h"), n), bits.bitmap(h, F.shiftrightunsigned("h", 32), n)


def passing(wanted: tuple, terms: list[str]) -> list[bool]:
    h = np.array([term_hash(t) for t in terms], np.int64).view(np.uint64)
    return (bits.holds(wanted[0].value, h) & bits.holds(wanted[1].value, h >> np.uint64(32))).tolist()


def count_terms(wanted: tuple):
    """Documents per term, counted within the task first; only terms in the bitmaps leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            terms = list(counts)
            terms = [t for t, ok in zip(terms, passing(wanted, terms), strict=True) if ok]
            out = pa.record_batch([pa.array(terms, pa.string()), pa.array([counts[t] for t in terms], pa.int64())], names=["t", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    counts.update({w.lower() for w in TERM.findall(t)})
            if len(counts) > 500_000:
                yield flush()
        yield flush()

    return run


def scanned(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text"))
    return materialise(rows.mapInArrow(scan, FOUND_DDL).withColumn("rid", F.monotonically_increasing_id()))


def disclosing(docs: DataFrame, found: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """(e, t, n_et, share): pairs of ``support`` documents whose term gives away at least ``threshold`` of the entity's information.

    With a support of 1, the entities that only one document shows are a null e together: their pairs with a term are
    all alike (n_et = n_e = 1).
    """
    total = found.count()
    # An entity in fewer than ``support`` documents has no pair in so many.
    entities = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= max(support, 2))
    entities = materialise(entities)
    shared = bits.bitmap(entities, F.col("e"), entities.count())
    seen = docs.select("text").mapInArrow(together(shared, support < 2), "e array<long>, alone boolean, t array<string>")
    # A null entity stands for any: it counts the documents with entities that have the term.
    seen = seen.select(F.explode(F.array_append("e", F.lit(None).cast("long"))).alias("e"), "alone", "t").select("e", "alone", F.explode("t").alias("t"))
    counted = seen.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"), F.max("alone").alias("alone"))
    counted = materialise(counted.filter((F.col("n_et") >= support) | F.col("e").isNull()))
    pmi = lambda n_t: F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e").cast("double") * n_t))
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    # No term is in fewer documents than in those with entities: what falls short by that count can't disclose.
    least = counted.filter("e is null").select("t", F.col("n_et").alias("least"))
    # The bitmap may hold an entity of one document: it has no count.
    pairs = counted.filter("e is not null").join(entities, "e", "left").select("e", "t", "n_et", F.coalesce("n_e", F.lit(1)).alias("n_e"))
    if support < 2:
        one = F.lit(1).cast("long")
        pairs = pairs.union(counted.filter("e is null and alone").select("e", "t", one.alias("n_et"), one.alias("n_e")))
    pairs = pairs.join(least, "t")
    pairs = materialise(pairs.filter((ic > 0) & (pmi(F.col("least")) >= ic * (threshold - 1e-9))).select("e", "t", "n_et", "n_e"))
    wanted = bitmaps(pairs.select("t").distinct())
    n_t = docs.select("text").mapInArrow(count_terms(wanted), "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    scored = pairs.join(n_t, "t").withColumn("share", F.when(ic > 0, pmi(F.col("n_t")) / ic))
    return scored.filter(F.col("share") >= threshold).select("e", "t", "n_et", "share")


def flagged_terms(pairs: DataFrame) -> DataFrame:
    """(t, k): every disclosing term and its kind, the stronger of all its entities; two more without support."""
    kind = F.when(F.max("share") >= 1.0 - 1e-9, F.lit(5)).otherwise(F.lit(4))
    return materialise(pairs.groupBy("t").agg((kind + F.when(F.max("n_et") < SUPPORT, F.lit(2)).otherwise(F.lit(0))).alias("k")))


def few_terms(flagged: DataFrame) -> dict[str, int] | None:
    few = flagged.limit(SMALL + 1).collect()
    return {r["t"]: r["k"] for r in few} if len(few) <= SMALL else None


def term_spans(t: str, spans: list[tuple[int, int, int, str]], kinds: dict[str, int]) -> list[tuple[int, int, int]]:
    return [(a, kinds[w], b) for w, a, b in words(t, spans, kinds)]


def occurrences(kept: tuple):
    """(doc_id, th, text) -> (doc_id, th, term, start, end) of the words in the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        size = 0
        for batch in batches:
            at, ts, starts, ends = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                each = {w.lower() for w in TERM.findall(t)} if t else set()
                new = [w for w in each if w not in known]
                known.update(zip(new, passing(kept, new), strict=True))
                size += sum(map(len, new)) + 100 * len(new)
                if held := {w for w in each if known[w]}:
                    for w, a, b in words(t, base_spans(t), held):
                        at.append(i)
                        ts.append(w)
                        starts.append(a)
                        ends.append(b)
                if size > 20_000_000:
                    known.clear()
                    size = 0
            at = pa.array(at, pa.int64())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(ts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["d", "h", "t", "a", "b"])

    return run


def with_terms(docs: DataFrame, found: DataFrame, flagged: DataFrame) -> DataFrame:
    """``found`` with ``terms``: the start, kind and end of disclosing words. Terms meet by a join, at any number."""
    kept = bitmaps(flagged)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    hits = rows.mapInArrow(occurrences(kept), "d long, h long, t string, a int, b int").join(flagged, "t")
    hits = hits.groupBy("d", "h").agg(F.array_sort(F.collect_set(F.struct("a", "k", "b"))).alias("terms"))
    return found.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left").drop("d", "h")


def all_spans(base: str, terms: list | None) -> list[tuple[int, int, int]]:
    out = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
    return sorted(out + [(x["a"], x["k"], x["b"]) for x in terms or []])


COUNTS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone")
RESULT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, n_disclosing long, disclosing string"


def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, terms = batch.column("base").to_pylist(), [x or [] for x in batch.column("terms").to_pylist()]
        told = [[y for y in x if y["k"] < 6] if b else [] for b, x in zip(base, terms, strict=True)]
        yield pa.record_batch(
            [
                *(batch.column(c) for c in COUNTS),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([joined(all_spans(b, x)) for b, x in zip(base, told, strict=True)], pa.string()),
                pa.array([len(x) for x in told], pa.int64()),
                pa.array([len(x) for x in terms], pa.int64()),
                pa.array([joined(all_spans("", x)) for x in terms], pa.string()),
            ],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "n_disclosing", "disclosing"],
        )


def op3(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    found = scanned(docs)
    flagged = flagged_terms(disclosing(docs, found, support=1))
    return with_terms(docs, found, flagged).select(*COUNTS, "base", "terms").mapInArrow(result, RESULT_DDL)


def rewritten(t: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind, disclosing words by ``[TERM]`` or nothing; overlapping spans count as one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += (t[at:a], "" if k == 5 else f"[{KINDS[k].upper()}]")
        at = max(at, b)
    return "".join((*out, t[at:]))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with clean texts, all columns kept.

    Up to ``SMALL`` disclosing terms, every task finds the spans of its texts again and no text is shuffled; beyond
    that, the spans are joined to the texts by doc_id and a hash of the text.
    """
    found = scanned(docs)
    flagged = flagged_terms(disclosing(docs, found))
    columns = docs.columns
    plain = docs.select(*(F.col(f"`{c}`") for c in columns))
    at = columns.index("text")
    kinds = few_terms(flagged)
    if kinds is not None:

        def clean(t: str | None) -> str | None:
            if not t:
                return t
            spans = base_spans(t)
            return rewritten(t, sorted([s[:3] for s in spans] + term_spans(t, spans, kinds)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], pa.string())
                yield pa.record_batch([texts if i == at else batch.column(i) for i in range(len(columns))], names=columns)

        return plain.mapInArrow(run, docs.schema)

    spans = with_terms(docs, found, flagged).filter("base <> '' or terms is not null").groupBy(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).agg(F.first("base").alias("_base"), F.first("terms").alias("_terms"))
    keyed = plain.withColumn("_th", F.xxhash64("text")).join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True)
            texts = pa.array([rewritten(t, all_spans(b or "", x)) if b or x else t for t, b, x in parts], pa.string())
            yield pa.record_batch([texts if i == at else batch.column(i) for i in range(len(columns))], names=columns)

    return keyed.select(*(F.col(f"`{c}`") for c in columns), "_base", "_terms").mapInArrow(apply, docs.schema)
