"""SentencePiece encoding and decoding with exact n-best segmentation over the piece lattice.

Per segment (a run of spaces and the characters after it, or a line end; no piece spans such a cut) the forward Viterbi pass gives the
best score of every prefix. A backward A* then starts at the segment's end with f = (score of the suffix built so far)
+ (forward score of the prefix left), which is exact, so hypotheses leave the queue in order of their true score. The
n best of a text come from the same search over its segments: the n - 1 smallest losses decide which segments may leave
their best path, and a queue over their own n-best lists yields the sums in order.

The vocabulary (a SentencePiece model file) is a parameter and is read where the tasks run; it is never copied. Pieces
are weighed by the scores in the file. In a BPE model these are ranks of merges: the best path over them is the best of
the lattice, as defined here, and need not be the sequence that merging by rank would give.
Characters without a piece fall back to byte pieces, at the lowest score of the vocabulary less 10.

Scale: documents are encoded one by one, without a shuffle. A worker remembers the segments it has solved up to
``REMEMBERED`` bytes a generation, whatever their lengths; single segments above a thousandth of that aren't kept. The
n best of some short segments are remembered too. ``segmented`` returns the ids of all n segmentations, ``op7`` their
digests. Whether ids decode to the text is found segment by segment, as no piece or byte sequence spans a cut.

Defined results: a null text encodes like an empty one, to no pieces, with score 0 and one segmentation; ties prefer
the piece that starts first (the longer last piece), then fewer changes; repeated rows repeat; very long runs without a
space are one segment, handled in time linear in their length; an empty table gives an empty result; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
#: Bytes of segments that a Python worker remembers, about, in each of two generations.
REMEMBERED = 96 << 20
#: Segments whose n best are remembered, and their length at most.
LISTS, LIST_CHARS = 4000, 32
SPACE = "▁"


class Lattice:
    """Pieces and scores of one model, with Viterbi, n-best A*, encoding and decoding."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.score = {i: float(sp.get_score(i)) for i in range(n) if not special[i]}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.edge = {p: (self.score[i], i) for p, i in self.ids.items()}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((s for s in self.score.values() if s > -1e8), default=0.0) - 10.0
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        splits = not any(inner.search(p) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.cut = re.compile(rf"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall if splits else (lambda s: [s] if s else [])
        self.best: dict[str, tuple[bytes, float, float, int, bool]] = {}
        self.older: dict[str, tuple[bytes, float, float, int, bool]] = {}
        self.held = 0
        self.lists: dict[tuple[str, int], list[tuple[float, list[str]]]] = {}
        # A node: score and id of the piece that ends here, or None, and the lookup of its children.
        nodes: dict[str, dict[str, tuple]] = {p[:k]: {} for p in self.ids for k in range(len(p) + 1)} | {"": {}}
        for prefix in sorted(nodes, key=len, reverse=True):
            if prefix:
                i = self.ids.get(prefix, -1)
                nodes[prefix[:-1]][prefix[-1]] = (self.score.get(i), i, nodes[prefix].get)
        self.trie = nodes[""]

    def forward(self, s: str) -> tuple[list[float], list[int]]:
        """Best score of every prefix, and where its last piece starts (the first of equals)."""
        score, start = [0.0], [0]
        edge, longest = self.edge.get, self.longest
        for end in range(1, len(s) + 1):
            top, at = -1e300, -1
            for b in range(end - longest if end > longest else 0, end):
                e = edge(s[b:end])
                if e is not None and score[b] + e[0] > top:
                    top, at = score[b] + e[0], b
            if s[end - 1 : end] not in self.edge and score[end - 1] + self.unknown > top:
                top, at = score[end - 1] + self.unknown, end - 1
            score.append(top)
            start.append(at)
        return score, start

    def edges(self, s: str, end: int) -> Iterator[tuple[int, float]]:
        """All (start, score) of pieces that end here; the byte fallback where the character has no piece."""
        for b in range(max(0, end - self.longest), end):
            e = self.edge.get(s[b:end])
            if e is not None:
                yield b, e[0]
        if s[end - 1 : end] not in self.edge:
            yield end - 1, self.unknown

    def to_ids(self, piece: str) -> list[int]:
        found = self.ids.get(piece)
        return [found] if found is not None else [self.bytes.get(b, 0) for b in piece.encode("utf-8", "surrogatepass")]

    def first(self, s: str) -> tuple[bytes, float, float, int, bool]:
        """Best path's ids (little-endian int32), its score, the loss of the second best (inf without one), pieces, whether the ids decode to ``s``."""
        got = self.best.get(s)
        if got is None:
            got = self.older.get(s) or self.solve(s)
            # A string, its ids, two numbers, and their places in the dictionary.
            size = 400 + 4 * len(s) + len(got[0])
            if size > REMEMBERED // 1000:
                return got
            self.held += size
            if self.held > REMEMBERED:
                self.older, self.best, self.held = self.best, {}, size
            self.best[s] = got
        return got

    def solve(self, s: str) -> tuple[bytes, float, float, int, bool]:
        """One pass over the lattice, pieces found by walking the trie from every start."""
        n, root, unknown = len(s), self.trie.get, self.unknown
        score, start, second, piece = [-1e300] * (n + 1), [0] * (n + 1), [-1e300] * (n + 1), [-1] * (n + 1)
        score[0] = 0.0
        chars = [*s, None]
        for b in range(n):
            here, node, end = score[b], root(chars[b]), b + 1
            if node is None or node[0] is None:
                # no piece for the character alone: its bytes
                v = here + unknown
                if v > score[end]:
                    second[end], score[end], start[end], piece[end] = score[end], v, b, -1
                elif v > second[end]:
                    second[end] = v
            while node is not None:
                v, i, child = node
                if v is not None:
                    v += here
                    if v > score[end]:
                        second[end], score[end], start[end], piece[end] = score[end], v, b, i
                    elif v > second[end]:
                        second[end] = v
                node = child(chars[end])
                end += 1
        path: list[int] = []
        end, loss = n, 1e300
        while end:
            if score[end] - second[end] < loss:
                loss = score[end] - second[end]
            if piece[end] < 0:
                path += reversed(self.to_ids(s[start[end] : end]))
            else:
                path.append(piece[end])
            end = start[end]
        path.reverse()
        return array("i", path).tobytes(), score[n], loss if loss < 1e200 else float("inf"), len(path), self.plain(path) == s

    def nbest(self, s: str, n: int) -> list[tuple[float, list[str]]]:
        """The n best segmentations of one segment, by backward A*."""
        if not s:
            return [(0.0, [])]
        score, _ = self.forward(s)
        queue: list[tuple] = [(-score[-1], 0, len(s), 0.0, None)]
        made, out = 0, []
        while queue and len(out) < n:
            _, _, end, suffix, path = heapq.heappop(queue)
            if end == 0:
                pieces = []
                while path:
                    pieces.append(path[0])
                    path = path[1]
                out.append((suffix, pieces))
                continue
            for b, v in self.edges(s, end):
                made += 1
                heapq.heappush(queue, (-(score[b] + v + suffix), made, b, suffix + v, (s[b:end], path)))
        return out

    def segments(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join(self.first(s)[0] for s in self.segments(text)), "<i4").tolist()

    def plain(self, ids: list[int]) -> str:
        """The characters of the pieces, spaces marked."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                raw.append(self.of_byte[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(self.pieces[i])
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.plain(ids).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text

    def short_nbest(self, s: str, n: int) -> list[tuple[float, list[str]]]:
        """``nbest``, remembered for short segments."""
        if len(s) > LIST_CHARS:
            return self.nbest(s, n)
        got = self.lists.get((s, n))
        if got is None:
            if len(self.lists) >= LISTS:
                self.lists.clear()
            got = self.lists[s, n] = self.nbest(s, n)
        return got

    def text_nbest(self, segments: list[str], firsts: list[tuple], n: int, losses: tuple[float, ...] | None = None) -> list[tuple[float, dict[int, list[str]]]]:
        """The n best sums over segments: (loss against the best, changed segments)."""
        losses = np.array([f[2] for f in firsts] if losses is None else losses)
        near = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2]) if 1 < n <= len(losses) else np.arange(len(losses))
        losses = list(zip(losses[near].tolist(), near.tolist(), strict=True))
        open_ = [i for x, i in heapq.nsmallest(n - 1, losses) if x < float("inf")]
        lists = [[(firsts[i][1] - v, p) for v, p in self.short_nbest(segments[i], n)] for i in open_]
        out, seen = [], {(0,) * len(open_)}
        queue = [(0.0, (0,) * len(open_))]
        while queue and len(out) < n:
            loss, at = heapq.heappop(queue)
            out.append((loss, {i: lists[k][j][1] for k, (i, j) in enumerate(zip(open_, at, strict=True)) if j}))
            for k, j in enumerate(at):
                then = (*at[:k], j + 1, *at[k + 1 :])
                if j + 1 < len(lists[k]) and then not in seen:
                    seen.add(then)
                    heapq.heappush(queue, (sum(lists[q][r][0] for q, r in enumerate(then)), then))
        return out


@lru_cache(maxsize=2)
def lattice(model: str) -> Lattice:
    made = Lattice(model)
    # The trie stays as long as the worker: not to be searched for garbage again and again.
    gc.freeze()
    return made


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_segments", pa.int64()), ("n_pieces", pa.int64()), ("score", pa.float64()), ("n_best", pa.int32()), ("nbest_scores", pa.string()), ("ids_sha256", pa.string()), ("second_sha256", pa.string()), ("round_trip", pa.bool_())])
DDL = "doc_id long, n_segments long, n_pieces long, score double, n_best int, nbest_scores string, ids_sha256 string, second_sha256 string, round_trip boolean"


def encode_text(lat: Lattice, text: str, n: int) -> tuple[tuple, list[bytes]]:
    """The columns of SCHEMA after doc_id, digests of all n in ``nbest_sha256``, and the ids of the n best (little-endian int32)."""
    segments = lat.segments(text)
    known = lat.best.get
    firsts = [known(s) or lat.first(s) for s in segments]
    parts, scores, losses, counts, decode = zip(*firsts, strict=True) if firsts else ((),) * 5
    raw = b"".join(parts)
    score = float(sum(scores))
    best = lat.text_nbest(segments, firsts, n, losses)
    ends = 4 * np.cumsum(counts, dtype=np.int64)
    found = []
    for _, changed in best:
        ids, cut = [], 0
        for i in sorted(changed):
            ids += (raw[cut : ends[i] - len(parts[i])], array("i", [x for p in changed[i] for x in lat.to_ids(p)]).tobytes())
            cut = ends[i]
        found.append(b"".join((*ids, raw[cut:])))
    digests = [hashlib.sha256(x).hexdigest() for x in found]
    # Where a segment doesn't decode to itself, or the text has the mark of a space, the whole is decoded.
    if SPACE not in text and all(decode):
        same = True
    else:
        same = lat.decode(np.frombuffer(raw, "<i4").tolist()) == text
    nbest_scores = ",".join([f"{score - loss:.3f}" for loss, _ in best])
    return (len(segments), len(raw) // 4, score, len(best), nbest_scores, digests[0], digests[1] if len(digests) > 1 else None, same, ",".join(digests)), found


def encode_row(lat: Lattice, text: str, n: int) -> tuple:
    """What ``segmented`` returns for a text, after doc_id."""
    row, found = encode_text(lat, text, n)
    return (*row, [np.frombuffer(x, "<i4").tolist() for x in found])


def nested(found: list[list[bytes]]) -> pa.Array:
    """Per row a list of lists of ids."""
    flat = [x for row in found for x in row]
    outer, inner = (np.concatenate([[0], np.cumsum(n)]).astype(np.int32) for n in ([len(row) for row in found], [len(x) // 4 for x in flat]))
    lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4"), pa.int32()))
    return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), lists)


def segmented(docs: DataFrame, model: str = MODEL, n: int = N_BEST, with_ids: bool = True) -> DataFrame:
    """Per document: segments, pieces, the scores and digests of its n best segmentations, round trip; their ids in ``nbest_ids``, the best first."""
    schema = [*SCHEMA, pa.field("nbest_sha256", pa.string())]
    names = [f.name for f in schema] + (["nbest_ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model)
        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.slice(at, 500)
                rows, found = [], []
                for t in some.column(1).to_pylist():
                    row, ids = encode_text(lat, t or "", n)
                    rows.append(row)
                    if with_ids:
                        found.append(ids)
                columns = [some.column(0).cast(pa.int64()), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema[1:], strict=True))]
                yield pa.record_batch(columns + ([nested(found)] if with_ids else []), names=names)

    ddl = DDL + ", nbest_sha256 string" + (", nbest_ids array<array<int>>" if with_ids else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, ddl)


def op7(docs: DataFrame) -> DataFrame:
    return segmented(docs, with_ids=False)
