"""N-gram Jaccard join in metric space: pivots, Voronoi regions and triangle-inequality windows, exact.

Jaccard distance d is a metric; two documents link when d <= EPS = 1 - threshold. Almost all pairs of documents are at
a distance near 1, where any pivot drawn at random is as far as any other. So pivots come from the documents' own
neighbourhoods, and what makes neighbours is exact:

1. Equal sets are one class, joined by their hash; only one document of each class goes on.
2. Pivots. The range of shingle hashes is cut into segments, so many (``Schemes``) that two linked sets must agree
   wholly in one that isn't empty. The smallest document among those that agree in a segment is a pivot, and all of
   them are its candidates; linked documents are candidates of a common pivot. Unrelated documents don't agree in whole
   segments, so regions hold neighbours only, and the work follows the input.
3. Voronoi regions. A document's home is the pivot it agrees with in most segments, the nearest as far as segments
   tell; its distance to it is computed. Within EPS (the pivot's ball) it links. A document near the boundary stays in
   the regions of its other pivots too: those where the members' components still differ.
4. Windows. In such a region all distances to the pivot are computed, then the pivot is done with; others can only link
   inside the window |d(x,p) - d(y,p)| <= EPS, and only those of different components need comparing.
5. Recursion. A region small enough for a task goes on there with a next pivot. A larger one takes many pivots at once,
   is cut into their Voronoi regions, in which boundary documents (d(x,p) <= d(x,home) + 2 EPS) are replicated, and
   each of these goes on alike. Where that doesn't tell documents apart the region stays whole and the number of pivots
   doubles, so rounds stay logarithmic.

What can't link is told from sketches first: the parity of the number of shingles in each of some 2n buckets. Two sets
differ in no fewer shingles than their sketches do in bits, so pairs whose sketches differ too much, and members of a
region without a possible partner in another component, go no further; the texts of all others are compared. Sketches
are a tenth of the texts or less, and of a region of any number of members pairs of blocks are compared side by side.

Links are verified on the sets themselves. Components come from iterated minimum labels with pointer jumping; copies
are never expanded into pairs.

Rows are told apart by a hash of doc_id and text, never by doc_id alone, and a class is named by the least hash among its
rows; a hash that stands for two different sets is noticed, and another salt taken.

Defined results: null or wordless text has no shingles, n_shingles 0, and is its own component; with fewer words than
SIZE the whole sequence is the one shingle; rows that share a doc_id, or have none, are documents of their own and link
by their texts; component_id and class_id are the smallest doc_id of the component and the class, null where no member
has one (so one id can name several components); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.llm import bits, kernels
from webstrata.session import materialise, small_batches, stored

SIZE = 4
PERCENT = 85
#: Shingles of the members of a region that is collected: 8 MB.
MOST = 1 << 20
#: Pivots that a larger region takes in its first round.
PIVOTS = 16
#: Members, and shingles of members, in a block of sketches; a region of more than ``BLOCKS`` blocks is cut first.
BLOCK, BLOCK_HELD, BLOCKS = 8192, 1 << 24, 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(data: bytes, size: int) -> np.ndarray:
    """Distinct hashes of the word n-grams of a text, A-Z lower-cased, ascending."""
    words = kernels.token_hashes(LOWER[np.frombuffer(data, np.uint8)].tobytes())
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(size, n)
    grams = kernels.mix(kernels.Rolling(words).all_windows(k) ^ np.uint64(k))
    return np.unique(grams)


class Schemes:
    """How the range of hashes is cut into segments, by the size of a set.

    Sizes fall into levels such that linked sets are in one level or in neighbouring ones; a pair uses the cut of the
    larger set's level. There at most ``most`` shingles are in one set only, so of the segments at most so many differ,
    and a set with more segments that aren't empty agrees in one of these with all it links to. Sets that leave too many
    empty (a few very small ones) also go by their first shingles in the order of hashes, of which linked sets share one.
    """

    def __init__(self, percent: int) -> None:
        self.percent, self.low, self.made = percent, [1], {}

    def cut(self, level: int) -> tuple[int, int]:
        """Most shingles in which linked sets differ, and number of segments."""
        if level not in self.made:
            p, largest, least = self.percent, self.low[level + 1] - 1, self.low[max(level - 1, 0)]
            most = 2 * largest * (100 - p) // (100 + p)
            n = most + 1
            while most and n < 3 * (most + 1):
                empty = n * math.exp(-least / n)
                if n - empty - 3 * math.sqrt(empty) > most:
                    break
                n += 1 + n // 64
            self.made[level] = (most, n)
        return self.made[level]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Hashes of the segments of one set (ascending), in the cut of its own level and of the next."""
        if not len(s):
            return s
        while len(self.low) < 3 or self.low[-3] <= len(s):
            self.low.append(self.low[-1] * 100 // self.percent + 1)
        level = bisect.bisect_right(self.low, len(s)) - 1
        mixed, high, out = kernels.mix(s ^ np.uint64(0xA24BAED4963EE407)), s >> np.uint64(32), []
        for at in (level, level + 1):
            most, n = self.cut(at)
            segment = (high * np.uint64(n)) >> np.uint64(32)
            first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            out.append(kernels.mix(np.add.reduceat(mixed, first) ^ kernels.mix(segment[first] + np.uint64((at + 1) << 32))))
            if len(first) <= most:
                prefix = len(s) - -(-self.percent * len(s) // 100) + 1
                out.append(kernels.mix(mixed[:prefix] ^ np.uint64(at + 1)))
        return np.concatenate(out)


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection with 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    need = least_overlap(len(a), len(b), percent)
    if min(len(a), len(b)) < need:
        return False
    return len(np.intersect1d(a, b, assume_unique=True)) >= need


def sketch(s: np.ndarray) -> bytes:
    """Parity of the number of shingles in each bucket, of which there are 2n to 4n (a power of two, 64 at least)."""
    buckets = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(blob: bytes, length: int) -> int:
    """A sketch in as many buckets as one of ``length`` bytes has."""
    v, bits = int.from_bytes(blob, "little"), 8 * len(blob)
    while bits > 8 * length:
        bits //= 2
        v = (v >> bits) ^ (v & ((1 << bits) - 1))
    return v


def may_link(percent: int):
    """(x, y, n_x, n_y, sketch of x, sketch of y) -> the pairs (x, y) whose sketches don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for m, n, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                short, need = min(len(a), len(b)), least_overlap(m, n, percent)
                ok.append(need <= min(m, n) and (folded(a, short) ^ folded(b, short)).bit_count() <= m + n - 2 * need)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return run


def with_partner(percent: int):
    """Of two blocks of a region, or one: the members that may link to one of another component, told by sketches."""

    def run(table: pa.Table) -> pa.Table:
        n, block = table.column("n").to_numpy(), table.column("block").to_numpy()
        _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
        blobs = table.column("sketch").to_pylist()
        short = min(map(len, blobs))
        bits = np.array([np.frombuffer(folded(b, short).to_bytes(short, "little"), "<u8") for b in blobs])
        if block.min() < block.max():
            some, others = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        else:
            # Pairs of different components have a member outside the largest one.
            some, others = np.flatnonzero(comp != np.argmax(np.bincount(comp))), np.arange(len(n))
        columns = np.ascontiguousarray(bits[others].T)
        keep = np.zeros(len(n), bool)
        step = max(1, (1 << 18) // max(len(others), 1))
        for at in range(0, len(some), step):
            i = some[at : at + step]
            total = n[i][:, None] + n[others]
            # Bits less in which the sketches may differ; below 0 a link is ruled out.
            need = -(-percent * total // (100 + percent))
            left = total - 2 * need
            left[(comp[i][:, None] == comp[others]) | (need > np.minimum(n[i][:, None], n[others]))] = -1
            for w, column in enumerate(columns):
                left -= np.bitwise_count(bits[i, w][:, None] ^ column)
                if w % 4 == 3 and left.max() < 0:
                    break
            ok = left >= 0
            keep[i[ok.any(axis=1)]] = True
            keep[others[ok.any(axis=0)]] = True
        return table.select(["s", "cid"]).filter(pa.array(keep))

    return run


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def row_key(salt: int) -> Column:
    """What tells rows apart: equal for rows with one doc_id and one text only, but for chance (see ``told_apart``)."""
    return F.xxhash64(F.lit(salt), F.col("doc_id").isNull(), F.col("doc_id").cast("long"), "text")


def firsts_in(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which rows of a batch are in the bitmap, repeated rows once."""
    once = np.zeros(len(ids), bool)
    once[np.unique(ids, return_index=True)[1]] = True
    return once & bits.holds(wanted, ids.view(np.uint64))


def to_classes(size: int):
    """doc_id, row key, size of the shingle set and two hashes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2 = [], [], []
            for t in texts(batch, 2):
                s = shingles(t, size)
                n.append(len(s))
                s1.append(s.sum(dtype=np.uint64))
                s2.append(kernels.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *(pa.array(signed(np.array(x, np.uint64))) for x in (s1, s2))], names=["doc_id", "id", "n_shingles", "s1", "s2"])

    return run


def head_signatures(size: int, percent: int, reps):
    """Batch (id, text) -> set and signatures of each of its heads of classes, of other rows empty ones."""
    schemes = Schemes(percent)

    def run(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        heads = firsts_in(batch.column(0).to_numpy(zero_copy_only=False), reps.value).tolist()
        sets = [shingles(t, size) if head else np.empty(0, np.uint64) for t, head in zip(texts(batch, 1), heads, strict=True)]
        return [(s, schemes.signatures(s)) for s in sets]

    return run


def candidates(size: int, percent: int, reps, again):
    """(signature, document) for the signatures that some other document may have among its own.

    The first of a document's rows has the size of its set and its sketch too.
    """
    signatures = head_signatures(size, percent, reps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = signatures(batch)
            found = [s[bits.holds_top(again.value, s)] for _, s in made]
            who = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in found])
            n, sketches = [], []
            for (s, _), f in zip(made, found, strict=True):
                if len(f):
                    n += [len(s)] + [None] * (len(f) - 1)
                    sketches += [sketch(s)] + [None] * (len(f) - 1)
            yield pa.record_batch([pa.array(signed(np.concatenate([np.empty(0, np.uint64), *found]))), pa.array(who), pa.array(n, pa.int64()), pa.array(sketches, pa.binary())], names=["s", "cid", "n", "sketch"])

    return run


def texts_of(wanted):
    """(document, text) of the documents in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = firsts_in(batch.column(0).to_numpy(zero_copy_only=False), wanted.value)
            yield pa.record_batch([batch.column(0), batch.column(1)], names=["cid", "text"]).filter(pa.array(take))

    return run


def measured(size: int):
    """(x, y, text of x, text of y) -> (x, y, sizes of their sets, shingles in common); rows with one y are cut once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.empty(0, np.uint64)
        for batch in batches:
            n_x, n_y, common = [], [], []
            for y, a, b in zip(batch.column(1).to_pylist(), texts(batch, 2), texts(batch, 3), strict=True):
                if y != last:
                    last, known = y, shingles(b, size)
                s = shingles(a, size)
                n_x.append(len(s))
                n_y.append(len(known))
                common.append(len(np.intersect1d(s, known, assume_unique=True)))
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in (n_x, n_y, common))], names=["x", "y", "n_x", "n_y", "common"])

    return run


def within_region(size: int, percent: int):
    """The recursion inside a region: pivots, balls and windows over members whose components still differ."""
    eps = 1 - percent / 100 + 1e-9

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("cid").to_pylist()
        sets = [shingles(t or b"", size) for t in table.column("text").cast(pa.binary()).to_pylist()]
        n = len(ids)
        sizes = np.array([len(s) for s in sets])
        _, comp = np.unique(table.column("comp").to_numpy(), return_inverse=True)
        symbols, flat = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(n), sizes)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(symbols), bool)
        # Members of small components first: once the others are all of one, nothing is left to compare.
        left = np.argsort(np.bincount(comp)[comp], kind="stable")
        links: list[tuple[int, int]] = []

        def join(a: int, b: int) -> None:
            if comp[a] != comp[b]:
                links.append((ids[a], ids[b]))
                comp[comp == comp[b]] = comp[a]

        while len(left) > 1 and (comp[left] != comp[left[0]]).any():
            p = left[0]
            own = flat[begin[p] : begin[p + 1]]
            mark[own] = True
            common = np.bincount(owner, weights=mark[flat], minlength=n)[left].astype(np.int64)
            mark[own] = False
            d = 1 - common / (sizes[left] + sizes[p] - common)
            ball = 100 * common >= percent * (sizes[left] + sizes[p] - common)
            for x in left[ball]:
                join(p, x)
            inner, outer = left[ball], left[~ball]
            reach = outer[d[~ball] <= 2 * eps]
            for y, dy in zip(reach, d[~ball][d[~ball] <= 2 * eps], strict=True):
                for x in inner[np.abs(d[ball] - dy) <= eps]:
                    if comp[x] != comp[y] and linked(sets[x], sets[y], percent):
                        join(x, y)
            left = outer
        x, y = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(cid, comp): smallest id reachable over ``links(x, y)``; ids without a link are absent.

    Every round, each id takes the smallest label among its own, its neighbours' and its label's label (pointer
    jumping). Only labels and links move; rounds grow with the logarithm of the longest path.
    """
    edges = stored(links.select("x", "y").union(links.select("y", "x")).distinct())
    labels = edges.groupBy(F.col("x").alias("cid")).agg(F.min("y").alias("least")).select("cid", F.least("least", "cid").alias("comp"))
    labels = materialise(labels)
    while True:
        near = edges.join(labels, edges["y"] == labels["cid"]).groupBy("x").agg(F.min("comp").alias("near"))
        up = labels.select(F.col("cid").alias("_c"), F.col("comp").alias("up"))
        then = labels.join(near, labels["cid"] == near["x"], "left").join(up, F.col("comp") == F.col("_c"), "left")
        then = materialise(then.select("cid", F.least("comp", F.coalesce("near", "comp"), F.coalesce("up", "comp")).alias("comp"), F.col("comp").alias("was")))
        changed = then.filter("comp < was").limit(1).count()
        labels = then.select("cid", "comp")
        if not changed:
            return labels


def cut_regions(large: DataFrame, small: DataFrame, with_partners, distances, n_pivots: int, reach: float) -> tuple[DataFrame, DataFrame]:
    """One round over regions too large for a task: links with some ``n_pivots`` pivots each, and the regions left.

    Members without a possible partner leave first, and only what is still too large is cut. Documents go to the Voronoi region of their nearest pivot, and to those of all pivots that are not further than it
    by more than ``reach``; two linked documents meet in the home of either. A region that would more than double that
    way stays whole.
    """
    large = with_partners(large)
    small = small.select("s", "cid", "n_shingles").unionByName(large.filter(F.col("held") <= MOST).select("s", "cid", "n_shingles"))
    large = large.filter(F.col("held") > MOST)
    if large.limit(1).count() == 0:
        return large.select(F.col("cid").alias("x"), F.col("cid").alias("y")), stored(small)
    draw = F.pmod(F.xxhash64("cid", "s", F.lit(n_pivots)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    least = large.groupBy("s").agg(F.min("cid").alias("cid"))
    pivots = stored(large.filter(draw * F.col("members") < n_pivots).select("s", "cid").unionByName(least).distinct())
    rest = stored(large.select("s", "cid", "n_shingles", "members").join(pivots, ["s", "cid"], "left_anti"))
    apart = large.select("s", F.col("cid").alias("x")).join(pivots.select("s", F.col("cid").alias("y")), "s").filter("x <> y")
    known = stored(distances(apart.select("x", "y").distinct()))
    at = rest.withColumnRenamed("cid", "x").join(pivots.select("s", F.col("cid").alias("y")), "s").join(known, ["x", "y"])
    home = at.groupBy("s", "x").agg(F.min("d").alias("home"))
    cells = stored(at.join(home, ["s", "x"]).filter(F.col("d") <= F.col("home") + F.lit(reach)).select("s", "members", F.xxhash64("s", "y").alias("cell"), F.col("x").alias("cid"), "n_shingles"))
    whole = cells.groupBy("s").agg((F.count(F.lit(1)) > 2 * F.max("members")).alias("whole"))
    split = cells.join(whole.filter("NOT whole"), "s", "left_semi").select(F.col("cell").alias("s"), "cid", "n_shingles")
    same = rest.join(whole.filter("whole"), "s", "left_semi").select("s", "cid", "n_shingles")
    return known.filter("near").select("x", "y"), stored(small.unionByName(split).unionByName(same))


def told_apart(rows: DataFrame) -> bool:
    """Whether every row key stands for one doc_id and one set."""
    several = F.count("doc_id").between(1, F.count(F.lit(1)) - 1)
    for c in ("doc_id", "n_shingles", "s1", "s2"):
        several = several | (F.min(c) < F.max(c))
    return rows.groupBy("id").agg(several.alias("several")).filter("several").limit(1).count() == 0


def grouped(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """doc_id, id (its row key), n_shingles, component_id, class_id, comp (one key a component; null without shingles) of every row, and the salt of the row keys."""
    small_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for salt in itertools.count():
        keyed = named.select("doc_id", row_key(salt).alias("id"), "text")
        rows = stored(keyed.mapInArrow(to_classes(size), "doc_id long, id long, n_shingles long, s1 long, s2 long"))
        if told_apart(rows):
            break
    keyed = keyed.select("id", "text")
    key = ["n_shingles", "s1", "s2"]
    classes = stored(rows.filter("n_shingles > 0").groupBy(*key).agg(F.min("id").alias("cid"), F.min("doc_id").alias("class_id")))
    reps = bits.bitmap(classes, F.col("cid"), classes.count())
    signatures = head_signatures(size, percent, reps)
    again = bits.repeated(keyed, lambda batch: np.concatenate([np.empty(0, np.uint64), *(s for _, s in signatures(batch))]))
    found = stored(keyed.mapInArrow(candidates(size, percent, reps, again), "s long, cid long, n long, sketch binary"))
    sketches = found.filter("sketch is not null").groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    found = found.select("s", "cid")
    pivots = found.groupBy("s").agg(F.min("cid").alias("pivot"), F.max("cid").alias("last")).filter("pivot < last").select("s", "pivot")
    touching = stored(found.join(pivots, "s").filter("cid <> pivot").groupBy("cid", "pivot").agg(F.count(F.lit(1)).alias("agree")))

    def held(ids: DataFrame) -> DataFrame:
        """cid and text of the documents ``ids``."""
        ids = stored(ids.distinct())
        some = keyed.mapInArrow(texts_of(bits.bitmap(ids, F.col("cid"), ids.count())), "cid long, text string")
        return some.groupBy("cid").agg(F.first("text").alias("text")).join(ids, "cid", "left_semi")

    def distances(pairs: DataFrame) -> DataFrame:
        """x, y, d, near (whether they link) of pairs (x, y). Texts move, which take half the room of their sets."""
        rows = held(pairs.select(F.col("x").alias("cid"))).withColumnRenamed("cid", "x").withColumnRenamed("text", "text_x")
        ends = held(pairs.select(F.col("y").alias("cid"))).withColumnRenamed("cid", "y").withColumnRenamed("text", "text_y")
        met = pairs.join(rows, "x").join(ends, "y").select("x", "y", "text_x", "text_y")
        made = met.mapInArrow(measured(size), "x long, y long, n_x long, n_y long, common long")
        union = F.col("n_x") + F.col("n_y") - F.col("common")
        return made.select("x", "y", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= percent * union).alias("near"))

    def near(pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) that link."""
        x, y = (sketches.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "xy")
        met = pairs.join(x, "x").join(y, "y").select("x", "y", "n_x", "n_y", "sketch_x", "sketch_y")
        return distances(stored(met.mapInArrow(may_link(percent), "x long, y long"))).filter("near").select("x", "y")

    def with_partners(left: DataFrame) -> DataFrame:
        """The regions without the members that can link to none of another component; ``members`` and ``held`` anew."""
        n_blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("held") / BLOCK_HELD), F.lit(1)).cast("long")
        left = left.withColumn("blocks", n_blocks)
        dealt = left.filter(F.col("blocks") <= BLOCKS).withColumn("block", F.pmod(F.xxhash64("cid", "s"), "blocks"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        cells = dealt.select("s", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "cid", "comp", "block").join(sketches, "cid")
        some = cells.groupBy("s", "lo", "hi").applyInArrow(with_partner(percent), "s long, cid long").distinct()
        kept = left.join(some, ["s", "cid"], "left_semi").unionByName(left.filter(F.col("blocks") > BLOCKS)).select("s", "cid", "n_shingles", "comp")
        kept = stored(kept)
        return stored(kept.join(kept.groupBy("s").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("held")), "s"))

    def labelled(rows: DataFrame, labels: DataFrame, name: str, comp: str) -> DataFrame:
        of = labels.select(F.col("cid").alias(name), F.col("comp").alias(comp))
        return rows.join(of, name, "left").withColumn(comp, F.coalesce(comp, name))

    homes = stored(touching.groupBy("cid").agg(F.max(F.struct("agree", (-F.xxhash64("pivot")).alias("_h"), "pivot")).alias("h")).select(F.col("cid").alias("x"), F.col("h.pivot").alias("y")))
    links = stored(near(homes))
    labels = components(links)
    # Boundary documents: their other pivots, where components still differ.
    others = touching.select(F.col("cid").alias("x"), F.col("pivot").alias("y")).join(homes, ["x", "y"], "left_anti")
    others = labelled(labelled(others, labels, "x", "c_x"), labels, "y", "c_y").filter("c_x <> c_y").select("x", "y")
    links = stored(links.unionByName(near(stored(others))))
    labels = components(links)

    # A pivot has met its region and leaves it.
    left, n_pivots = stored(touching.select(F.col("pivot").alias("s"), "cid").join(classes.select("cid", "n_shingles"), "cid")), PIVOTS
    mixed = F.xxhash64("cid").cast("decimal(20,0)")
    while True:
        at = labelled(left, labels, "cid", "comp")
        # Regions with the same members are one: told by their number and a sum of hashes.
        regions = at.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum(mixed).alias("sign"), F.sum("n_shingles").alias("held"))
        regions = regions.filter("lo < hi").groupBy("members", "sign").agg(F.min("s").alias("s"), F.max("held").alias("held"))
        left = stored(at.join(regions.select("s", "members", "held"), "s").select("s", "cid", "n_shingles", "comp", "members", "held"))
        large = left.filter(F.col("held") > MOST)
        if large.limit(1).count() == 0:
            break
        met, left = cut_regions(large, left.filter(F.col("held") <= MOST), with_partners, distances, n_pivots, 2 * (1 - percent / 100) + 1e-9)
        links = stored(links.unionByName(met))
        labels = components(links)
        n_pivots *= 2
    left = with_partners(left)
    inner = left.select("s", "cid", "comp").join(held(left.select("cid")), "cid").groupBy("s").applyInArrow(within_region(size, percent), "x long, y long")
    inner = stored(inner)
    if inner.limit(1).count():
        labels = components(links.unionByName(inner))
    named = classes.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    least = named.groupBy("comp").agg(F.min("class_id").alias("component_id"))
    named = named.join(least, "comp").select(*key, "comp", "component_id", "class_id")
    bare = F.col("n_shingles") == 0
    out = rows.join(named, key, "left")
    own = [F.when(bare, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")]
    return out.select("doc_id", "id", "n_shingles", *own, "comp"), salt


def joined(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id of every document."""
    return grouped(docs, size, percent)[0].select("doc_id", "n_shingles", "component_id", "class_id")


def op4(docs: DataFrame) -> DataFrame:
    return joined(docs.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def oracle(size: int = SIZE, percent: int = PERCENT) -> str:
    """Every pair that shares a shingle, counted; components by transitive closure."""
    zipped = ", ".join(f"w[{i + 1}:len(w) - {size - 1 - i}]" for i in range(size))
    whole = " || ' ' || ".join(f"t[{i + 1}]" for i in range(size))
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(list_zip({zipped}), lambda t: {whole})) END AS s FROM w),
c AS (SELECT s, min(rid) AS cid, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
g AS (SELECT cid, n, hash(g) AS g FROM (SELECT cid, n, unnest(s) AS g FROM c)),
q AS (SELECT a.cid AS a, b.cid AS b FROM g a JOIN g b ON a.g = b.g AND a.cid < b.cid AND a.n * 100 >= b.n * {percent} AND b.n * 100 >= a.n * {percent} GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
p AS (SELECT a, b FROM q UNION ALL SELECT b, a FROM q),
r AS (SELECT cid AS a, cid AS b FROM c UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT s.rid, s.doc_id, len(s.s) AS n, c.cid FROM s LEFT JOIN c ON s.s = c.s),
k AS (SELECT r.a AS cid, min(m.doc_id) AS component_id FROM r JOIN m ON r.b = m.cid GROUP BY r.a)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE k.component_id END AS component_id FROM m LEFT JOIN k USING (cid)
"""


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near-duplicates: of every component one row with the smallest doc_id stays.

    Which of several such rows is settled by their row keys. Wordless rows stay, once for each doc_id; without a
    doc_id each stays.
    """
    found, salt = grouped(docs.select("doc_id", "text"), size, percent)
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "id")
    bare = found.filter("comp is null")
    keep = found.filter("comp is not null").groupBy("comp").agg(F.min(row).alias("r")).select("r.id")
    keep = keep.unionByName(bare.filter("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("id")).select("id"))
    keep = keep.unionByName(bare.filter("doc_id is null").select("id").distinct()).select(F.col("id").alias("_keep"))
    columns = docs.columns
    of_row = docs.withColumn("_id", row_key(salt))
    # Wordless rows without a doc_id are all kept, so equal ones of them must not count as one.
    lone = F.col("doc_id").isNull() & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    held = of_row.join(keep, F.col("_id") == F.col("_keep")).withColumn("_lone", F.when(lone, F.monotonically_increasing_id()))
    return held.dropDuplicates(["_id", "_lone"]).select(*(F.col(f"`{c}`") for c in columns))
