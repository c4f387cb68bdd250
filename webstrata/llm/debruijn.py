"""Substring dedup by de Bruijn compaction over word k-mers.

Every window of ``WINDOW`` words is an edge between the (WINDOW - 1)-word nodes it starts and ends with. Only edges that
several documents have matter; each carries the smallest doc_id that has it as its colour.

1. Edges are dealt by anchors: the ``ANCHOR``-word piece with the smallest hash in an edge. Equal edges have equal anchors,
   and neighbouring edges of a text mostly the same one: such a run of edges is compacted where it is found. Anchors are
   counted first; those seen once carry no repeated edge (a bitmap of the others spares the rest).
2. Runs are counted by anchor and content. One that several documents have is a path of the graph. Where an anchor has
   runs of several contents, the graph forks within a run, and the edges of the first document with each content stand
   alone: those seen again (a bitmap, as in 1) meet the smallest doc_id of their equals.
3. Compaction: the degrees of the nodes between paths are counted, and a path goes on across a node that one path enters
   and one leaves, of one colour. As all paths so joined lie one after another in the document of their colour, no
   pointers need to be followed: whatever document passes through them has them in a row, at one distance from the source.
4. The coordinates of the compacted paths in their source are joined to that document's text, which gives a check of the
   words, by other symbols than the edges' hashes; what another document has is removed only where its own words have the
   same.

Scale: rows of hashes and coordinates are all that is shuffled before the texts' joins, of which each text that may change
takes part in one, and each source in another. A path in a third of all documents is pre-aggregated to a row per task, and
its join back is an ordinary join that adaptive execution splits; the spans asked of one source are gathered once each.

Defined results: null text has no words; documents under WINDOW words keep all; equal doc_ids (repeated rows) do not
remove each other; a null doc_id is neither smaller nor larger, so such rows keep all and remove nothing; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.llm import bits, kernels
from webstrata.session import small_batches, stored

WINDOW = 13
ANCHOR = 6


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def runs(data: bytes, window: int, k: int) -> tuple[kernels.Rolling | None, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Rolling hash over the words; of every run of edges with one anchor: the anchor's hash, the run's, both end nodes' (32 bits each), first word and word after the last; the number of words."""
    words = kernels.token_hashes(data)
    n = len(words)
    if n < window:
        return None, *(np.empty(0, np.uint64),) * 3, *(np.empty(0, np.int64),) * 2, n
    roll = kernels.Rolling(words)
    hashes = kernels.mix(roll.all_windows(k))
    at, a, last = kernels.minimizer_runs(hashes, window - k + 1)
    b = last + window
    content = kernels.mix(roll.runs(a, b) ^ kernels.mix((at - a).astype(np.uint64) * np.uint64(1 << 32) + (b - a).astype(np.uint64)))
    start, end = kernels.mix(roll.runs(a, a + window - 1)), kernels.mix(roll.runs(b - window + 1, b))
    return roll, hashes[at], content, (start >> np.uint64(32) << np.uint64(32)) | (end >> np.uint64(32)), a, b, n


def anchor_hashes(window: int, k: int):
    return lambda batch: np.concatenate([np.empty(0, np.uint64), *(runs(t, window, k)[1] for t in texts(batch, 0))])


def occurrences(window: int, k: int, wanted):
    """Runs with an anchor in the bitmap: (doc_id, text hash, anchor, content, end nodes, place in its document, first word, word after the last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column(1).to_numpy().astype(np.int64)
            rows: list[list] = [[] for _ in range(7)]
            for i, t in enumerate(texts(batch, 2)):
                _, h, c, ends, a, b, _ = runs(t, window, k)
                keep = bits.holds_top(wanted.value, h) if len(h) else np.empty(0, bool)
                if keep.any():
                    for column, values in zip(rows, (np.full(int(keep.sum()), i), signed(h[keep]), signed(c[keep]), signed(ends[keep]), (th[i] << 32) | a[keep], a[keep], b[keep]), strict=True):
                        column.append(values)
            i, h, c, ends, place, a, b = (np.concatenate([np.empty(0, np.int64), *x]) for x in rows)
            yield placed(batch, i, [h, c, ends, place], a, b, ["h", "c", "ends", "place"])

    return run


def placed(batch: pa.RecordBatch, i: np.ndarray, hashes: list[np.ndarray], a: np.ndarray, b: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Rows of documents ``i`` of a batch, with hashes and the words [a, b) they stand for."""
    at = pa.array(i)
    return pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, hashes), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "th", *names, "a", "b"])


def head_edges(t: bytes, doc_id: int, window: int, k: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the edges of a document's forking runs that it is the first to have."""
    roll, h, c, _, a, b, n = runs(t, window, k)
    keep = bits.holds(words, h ^ c ^ np.uint64(doc_id % 2**64)) if len(h) else np.empty(0, bool)
    if not keep.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(kernels.covered(n, a[keep], b[keep] - window + 1))
    return kernels.mix(roll.runs(at, at + window)), at


def edge_hashes(window: int, k: int, heads):
    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        ids = batch.column(0).to_pylist()
        return np.concatenate([np.empty(0, np.uint64), *(head_edges(t, i, window, k, heads.value)[0] for i, t in zip(ids, texts(batch, 2), strict=True))])

    return hashes


def branching_edges(window: int, k: int, heads, again):
    """Edges of forking runs that may occur elsewhere, in the run's first document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.int64)
            rows: list[list] = [[] for _ in range(4)]
            for i, t in enumerate(texts(batch, 2)):
                e, at = head_edges(t, ids[i], window, k, heads.value)
                keep = bits.holds_top(again.value, e)
                for column, values in zip(rows, (np.full(int(keep.sum()), i), signed(e[keep]), (th[i] << 32) | at[keep], at[keep]), strict=True):
                    column.append(values)
            i, e, place, a = (np.concatenate([np.empty(0, np.int64), *x]) for x in rows)
            yield placed(batch, i, [e, place], a, a + window, ["e", "place"])

    return run


SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("words", pa.int64())]))
CHAIN = "doc_id long, th int, a int, b int, first long, th0 int, a0 int"


def chained(window: int):
    """A document's repeated paths -> its compacted ones: those in a row, at one distance from one source, unless the graph branches between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            x = batch.column(2).flatten()
            a, b, first, place, goes_on = (x.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "first", "source", "goes_on"))
            th0, a0 = place >> 32, place & 0xFFFFFFFF
            by = np.lexsort((b, a, a - a0, th0, first, doc))
            a, b, first, th0, a0, goes_on, doc = (v[by] for v in (a, b, first, th0, a0, goes_on, doc))
            same = np.zeros(len(a), bool)
            same[1:] = (doc[1:] == doc[:-1]) & (first[1:] == first[:-1]) & (th0[1:] == th0[:-1]) & (a[1:] - a0[1:] == a[:-1] - a0[:-1]) & (a[1:] <= b[:-1] - window + 1) & goes_on[1:]
            head = np.flatnonzero(~same)
            end = np.maximum.reduceat(b, head) if len(head) else b
            at = pa.array(doc[head])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(v.astype(t)) for v, t in ((a[head], np.int32), (end, np.int32), (first[head], np.int64), (th0[head], np.int32), (a0[head], np.int32)))], names=["doc_id", "th", "a", "b", "first", "th0", "a0"])

    return run


def checks(data: bytes) -> kernels.Rolling:
    """Rolling hash over the words by other symbols than those that edges are told apart by."""
    raw = np.frombuffer(data, np.uint8)
    start, end = kernels.token_bounds(raw)
    return kernels.Rolling(kernels.mix(kernels.Rolling(kernels.mix(kernels.byte_symbols(raw))).runs(start, end) ^ (end - start).astype(np.uint64)))


def of_row(column: pa.Array, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, ...]]:
    """The fields of a column of lists of structs, row by row; a null is an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x = column.flatten()
    fields = [x.field(n).to_numpy(zero_copy_only=False) for n in names]
    for at, n in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
        yield tuple(f[at : at + n] for f in fields)


def source_checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text, spans) -> the check of the words of every span."""
    for batch in batches:
        rows: list[list] = [[np.empty(0, np.int64)] for _ in range(4)]
        for i, (t, (a0, n)) in enumerate(zip(texts(batch, 2), of_row(batch.column(3), ("a0", "n")), strict=True)):
            found = checks(t).runs(a0.astype(np.int64), a0.astype(np.int64) + n)
            for column, values in zip(rows, (np.full(len(a0), i), a0, n, signed(kernels.mix(found))), strict=True):
                column.append(values)
        i, a0, n, words = (np.concatenate(x) for x in rows)
        at = pa.array(i)
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(a0.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(words)], names=["first", "th0", "a0", "n", "words"])


def repeats(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """``CHAIN``: stretches of words [a, b) on paths that the document ``first`` (with a smaller doc_id) has from its word a0 on."""
    keyed = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("th"), "text")
    again = bits.repeated(keyed.select("text"), anchor_hashes(window, k))
    found = stored(keyed.mapInArrow(occurrences(window, k, again), "doc_id long, th int, h long, c long, ends long, place long, a int, b int"))
    source = F.min_by("place", "doc_id").alias("source")
    paths = stored(found.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("ends").alias("ends"), source))
    shared = paths.filter("first < last").select("h", "c", "first", "source", F.shiftright("ends", 32).alias("start"), F.col("ends").bitwiseAND(F.lit(0xFFFFFFFF)).cast("long").alias("end"))
    shared = shared.withColumn("start", F.col("start").bitwiseAND(F.lit(0xFFFFFFFF)))
    # Nodes that one path enters and one leaves, with the colour of either.
    enters = shared.groupBy(F.col("end").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("first").alias("colour")).filter("n_in = 1")
    leaves = shared.groupBy(F.col("start").alias("node")).agg(F.count(F.lit(1)).alias("n_out")).filter("n_out = 1")
    inner = enters.join(leaves, "node").select(F.col("node").alias("start"), "colour")
    shared = shared.join(inner, "start", "left").select("h", "c", "first", "source", F.coalesce(F.col("colour") == F.col("first"), F.lit(False)).alias("goes_on"))
    whole = found.select("doc_id", "th", "h", "c", "a", "b").join(shared, ["h", "c"]).filter("doc_id > first").select("doc_id", "th", "a", "b", "first", "source", "goes_on")

    forks = paths.groupBy("h").agg((F.min("c") != F.max("c")).alias("forks"), F.min("first").alias("lo"), F.max("last").alias("hi")).filter("forks AND lo < hi").select("h")
    first = stored(paths.join(forks, "h").select("h", "c", "first"))
    heads = bits.bitmap(first, F.col("h").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("first")), first.count())
    again = bits.repeated(keyed, edge_hashes(window, k, heads))
    edges = stored(keyed.mapInArrow(branching_edges(window, k, heads, again), "doc_id long, th int, e long, place long, a int, b int"))
    met = edges.groupBy("e").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), source).filter("first < last").select("e", "first", "source")
    apart = edges.join(met, "e").filter("doc_id > first").select("doc_id", "th", "a", "b", "first", "source", F.lit(True).alias("goes_on"))
    of_doc = whole.unionByName(apart).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "first", "source", "goes_on")).alias("paths"))
    return of_doc.mapInArrow(chained(window), CHAIN)


def verifiable(docs: DataFrame, chains: DataFrame) -> DataFrame:
    """doc_id, th, spans (a, b, check of the source's words there) of all documents with chains."""
    at = ["first", "th0", "a0", "n"]
    chains = stored(chains.withColumn("n", F.col("b") - F.col("a")))
    asked = stored(chains.select(*at).distinct().groupBy("first", "th0").agg(F.collect_list(F.struct("a0", "n")).alias("spans")))
    keys = bits.bitmap(asked, F.xxhash64("first", "th0"), asked.count())
    keyed = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("th"))
    held = keyed.select(F.xxhash64("doc_id", "th").alias("key"), "doc_id", "text", "th").mapInArrow(touched(keys), "key long, doc_id long, text string, th int")
    held = held.select(F.col("doc_id").alias("first"), F.col("th").alias("th0"), "text").join(asked, ["first", "th0"])
    known = held.mapInArrow(source_checks, "first long, th0 int, a0 int, n int, words long").distinct()
    return chains.join(known, at).groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "b", "words")).alias("spans"))


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t, (a, b, expected) in zip(texts(batch, 1), of_row(batch.column(2), ("a", "b", "words")), strict=True):
            words, removed = t.split(), 0
            n = len(words)
            if len(a):
                a, b = a.astype(np.int64), b.astype(np.int64)
                same = signed(kernels.mix(checks(t).runs(a, b))) == expected
                gone = kernels.covered(n, a[same], b[same])
                removed = int(gone.sum())
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            rows.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
        n, removed, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def touched(keys):
    """(key, doc_id, text, th) of the documents whose key is in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bits.holds(keys.value, batch.column(0).to_numpy().view(np.uint64))))

    return run


def untouched_digests(keys):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~bits.holds(keys.value, batch.column(0).to_numpy().view(np.uint64))))
            yield from digest([pa.record_batch([rest.column(1), rest.column(2), pa.nulls(rest.num_rows, SPANS)], names=["doc_id", "text", "spans"])])

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; only texts that may have spans are shuffled to meet them.

    ``window`` is any number of words from k on.
    """
    if not 1 <= k <= window:
        raise ValueError(f"a window of {window} words holds no piece of {k}")
    small_batches(docs.sparkSession)
    spans = stored(verifiable(docs, repeats(docs, window, k)))
    keys = bits.bitmap(spans, F.xxhash64("doc_id", "th"), spans.count())
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("th"))
    keyed = keyed.select(F.xxhash64("doc_id", "th").alias("key"), "doc_id", "text", "th")
    met = keyed.mapInArrow(touched(keys), "key long, doc_id long, text string, th int").join(spans, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return met.mapInArrow(digest, RESULT).unionByName(keyed.mapInArrow(untouched_digests(keys), RESULT))


def op6(docs: DataFrame) -> DataFrame:
    return deduplicated(docs.select("doc_id", "text"))


def oracle(window: int = WINDOW) -> str:
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS k FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM w WHERE len(w) >= {window} AND doc_id IS NOT NULL)),
r AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM g) WHERE doc_id > first),
c AS (SELECT rid, list(DISTINCT i + o) AS gone FROM r, range({window}) v(o) GROUP BY rid),
f AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM w LEFT JOIN c USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM f
"""
