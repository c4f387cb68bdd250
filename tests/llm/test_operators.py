"""Every training-data operator against a brute-force reading of its contract, on hard small tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webstrata.llm import bits, debruijn, jaccard, mix, pieces, pii, quality, shards, suffix, topk, warc
from webstrata.llm.gsaca import suffix_array

DDL = "doc_id long, text string, lang string, source string, n_chars long, h string, size string, shard int, th string, bucket int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(seed=3):
    """Nulls, empties, a long text, exact and near copies, shared passages, repeated rows, clashing columns."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdefgéü") for _ in range(rnd.randint(2, 7))) for _ in range(400)] + ["the", "of", "and", "to", "in"] * 20
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage = text(60)
    base = text(180)
    words = base.split()
    near = []
    for i in range(12):
        w = list(words)
        w[(i * 13) % len(w)] = f"edit{i}"
        near.append(" ".join(w))
    texts = [None, "", "   \n", "one", "two words", text(3000), base, base, base.upper(), *near, *(f"{text(20)}\n{passage} {text(15)}" for _ in range(6)), "ab " * 400, "x" * 1500, "x" * 700, text(90) + " mail bob.q@mail.example.com or +1 (234) 555-0199, ip 10.0.0.255 card 4539 1488 0343 6467 end", "secret zorbo bob.q@mail.example.com " + text(60), "secret zorbo bob.q@mail.example.com here " + text(60)]
    out = [(i * 7, t, "en", f"s{i % 4}" if i % 5 else None, 1, "h", "size", 9, "th", 1) for i, t in enumerate(texts)]
    return out + [out[6], (None, "a null id " + passage, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_repeats(held, length):
    texts = [(r[0], (r[1] or "").encode()) for r in held]
    seen = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    want = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(want, key=repr)


def test_op2(docs):
    assert collected(suffix.op2(docs)) == brute_repeats(rows(), 200)


@pytest.mark.parametrize(("length", "k"), [(40, 9), (23, 8), (12, 6)])
def test_op2_other_lengths(spark, length, k):
    """Periodic texts, few letters, strings that repeat in part only, repeated rows and null ids."""
    rnd = random.Random(length)
    text = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    shared = [text(rnd.randint(8, 70), "abcdefgh") for _ in range(12)]
    held = [(i, "".join(rnd.choice(shared) + text(rnd.randint(0, 6), "xyz") for _ in range(rnd.randint(0, 9)))) for i in range(60)]
    held += [(70, "ab" * 90), (71, "abc" * 30), (72, "a" * 100), (None, shared[0] + "é" + shared[1] * 3), (None, shared[1] * 2), held[3], held[3], (3, None)]
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    assert collected(suffix.deduplicated(df, length, k)) == brute_repeats(held, length)


def test_op2_crowded_anchor(docs, monkeypatch):
    want = collected(suffix.op2(docs))
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", 2)
    assert collected(suffix.op2(docs)) == want


def test_suffix_array():
    rnd = random.Random(5)
    for _ in range(400):
        x = [rnd.randint(1, rnd.choice([1, 2, 5])) for _ in range(rnd.randint(0, 50))] + [0]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i, x=x: x[i:])


def brute_pii(t):
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 14 <= len(digits) <= 19 and luhn) or (k == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_op3(docs):
    got = pii.op3(docs).collect()
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert len(got) == len(rows())
    for r in rows():
        if r[0] is None:
            continue
        spans, g = brute_pii(r[1] or ""), by_id[r[0]]
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = collections.Counter(k for _, k, _ in spans)
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == (n[0], n[1], n[2], n[3])
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) <= set(g.spans.split(",")) | {""}
        assert spans or not g.n_terms
    told = [r for r in got if r.n_terms]
    texts = dict((r[0], r[1]) for r in rows())
    assert any("zorbo" in {texts[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(","))} for r in told)


def entity_of(kind, value):
    return (kind, value.lower() if kind == 0 else value if kind == 1 else re.sub(r"[^0-9]", "", value))


def brute_terms(texts):
    """Every disclosing term and whether it is to go, by counting all pairs of entities and words over all texts."""
    n_e, n_t, n_et = (collections.Counter() for _ in range(3))
    for t in texts:
        t = t or ""
        spans = brute_pii(t)
        entities = {entity_of(k, t[a:b]) for a, k, b in spans}
        terms = {m[0].lower() for m in re.finditer(r"\w+", t) if len(m[0]) >= 3 and not m[0].isdigit() and not any(a < m.end() and m.start() < b for a, _, b in spans)}
        n_e.update(entities)
        n_t.update({w.lower() for w in re.findall(r"\w+", t)})
        n_et.update(itertools.product(entities, terms))
    share = collections.defaultdict(float)
    for (e, w), n in n_et.items():
        if n >= 2 and n_e[e] < len(texts):
            share[w] = max(share[w], math.log2(len(texts) * n / (n_e[e] * n_t[w])) / math.log2(len(texts) / n_e[e]))
    return {w: x >= 1 - 1e-9 for w, x in share.items() if x >= 0.8}


def brute_marked(t, terms):
    """All spans of a text: base ones, and the disclosing words that no base span touches."""
    spans = brute_pii(t)
    found = [(m.start(), 5 if terms[m[0].lower()] else 4, m.end()) for m in re.finditer(r"\w+", t) if len(m[0]) >= 3 and m[0].lower() in terms and not m[0].isdigit() and not any(a < m.end() and m.start() < b for a, _, b in spans)]
    return sorted(spans + found)


def brute_rewritten(t, terms):
    out, at = "", 0
    for a, k, b in brute_marked(t, terms):
        if a >= at:
            out += t[at:a] + ("" if k == 5 else f"[{pii.KINDS[k].upper()}]")
        at = max(at, b)
    return out + t[at:]


@pytest.mark.parametrize("small", [200_000, 0])
def test_pii_terms_against_counting_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(pii, "SMALL", small)
    rnd = random.Random(12)
    vocabulary = [f"word{i}" for i in range(60)]
    people = [f"p{i}@mail{i}.example" for i in range(6)]
    held = [(r[0], r[1]) for r in rows()]
    for i in range(120):
        who = i % 9
        marks = [f"Alias{who}", "CLUB" if who < 2 else "club7"] if who < 6 and rnd.random() < 0.8 else []
        held.append((1000 + i, " ".join([*marks, *(rnd.choice(vocabulary) for _ in range(20)), *([f"mail {people[who]} now"] if who < 6 else [])])))
    terms = brute_terms([t for _, t in held])
    assert len(terms) > 5 and len(set(terms.values())) == 2
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    want = collections.Counter()
    for d, t in held:
        spans = brute_marked(t or "", terms) if brute_pii(t or "") else []
        want[d, ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)] += 1
    assert collections.Counter((r.doc_id, r.spans) for r in pii.op3(df).collect()) == want
    assert collections.Counter((r.doc_id, r.text) for r in pii.sanitised(df).collect()) == collections.Counter((d, t and brute_rewritten(t, terms)) for d, t in held)


def test_pii_patterns_agree_with_the_plain_ones():
    rnd = random.Random(9)
    for _ in range(3000):
        t = "".join(rnd.choice("ab1.@-+ ()255 0") for _ in range(rnd.randint(0, 40)))
        assert [s[:3] for s in pii.base_spans(t)] == brute_pii(t), t


def test_sanitised_both_ways(docs, monkeypatch):
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    few = collected(pii.sanitised(narrow))
    assert any("[EMAIL]" in (r[1] or "") for r in few) and not any("bob.q@" in (r[1] or "") for r in few)
    monkeypatch.setattr(pii, "SMALL", 0)
    assert collected(pii.sanitised(narrow)) == few


@pytest.mark.parametrize("small", [200_000, 0])
def test_pii_terms_far_from_the_entity(spark, monkeypatch, small):
    """A word discloses from anywhere in a document, and is marked wherever it stands."""
    monkeypatch.setattr(pii, "SMALL", small)
    far = "the and of to in was for on that with as it"
    texts = [f"Zorbo {far} mail bob.q@mail.example.com {far} zorbo", f"zorbo {far} mail bob.q@mail.example.com {far}", f"{far} no mail but zorbo"] + [f"{far} mail no but filler{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    spans = {r.doc_id: [tuple(x.split(":")) for x in r.spans.split(",") if x] for r in pii.op3(df).collect()}
    marked = {i: [texts[i][int(a) : int(b)] for k, a, b in s if k in ("term", "gone")] for i, s in spans.items()}
    assert marked[0] == ["Zorbo", "zorbo"] and marked[1] == ["zorbo"]
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert not any("zorbo" in clean[i].lower() for i in range(3)) and clean[2] == f"{far} no mail but [TERM]"
    assert all(clean[i] == texts[i] for i in range(3, 43))


@pytest.mark.parametrize("most", [bits.MOST, 0])
def test_op3_entities_and_pairs_of_one_document(spark, monkeypatch, most):
    """However few documents show a pair, it counts, and its term is told in every text, whether or not the bitmap tells entities apart."""
    monkeypatch.setattr(bits, "MOST", most)
    rnd = random.Random(21)
    held = [(r[0], r[1]) for r in rows()]
    for i in range(150):
        who = [f"own{i}@mail.example"] * (i % 5 == 0) + [f"p{i % 3}@mail.example"] * (i % 4 == 0)
        held.append((1000 + i, " ".join([*(f"word{rnd.randint(0, 40)}" for _ in range(12)), *(f"rare{rnd.randint(0, 150)}" for _ in range(3)), *who])))
    n_e, n_t, n_et = (collections.Counter() for _ in range(3))
    for _, t in held:
        spans = brute_pii(t or "")
        n_e.update(entities := {entity_of(k, t[a:b]) for a, k, b in spans})
        n_t.update({w.lower() for w in re.findall(r"\w+", t or "")})
        n_et.update(itertools.product(entities, {m[0].lower() for m in re.finditer(r"\w+", t or "") if len(m[0]) >= 3 and not m[0].isdigit() and not any(a < m.end() and m.start() < b for a, _, b in spans)}))
    share = collections.defaultdict(float)
    for (e, w), n in n_et.items():
        share[w] = max(share[w], math.log2(len(held) * n / (n_e[e] * n_t[w])) / math.log2(len(held) / n_e[e]))
    terms = {w: x >= 1 - 1e-9 for w, x in share.items() if x >= 0.8}
    supported = brute_terms([t for _, t in held])
    assert all(terms[w] == gone for w, gone in supported.items()) and len(set(terms.values())) == 2 and len(terms) > len(supported) + 20
    want = collections.Counter()
    for d, t in held:
        marked = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_marked(t or "", terms) if k > 3]
        want[d, len(marked), ",".join(marked), ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in brute_marked(t or "", supported)) if brute_pii(t or "") else ""] += 1
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    assert collections.Counter((r.doc_id, r.n_disclosing, r.disclosing, r.spans) for r in pii.op3(df).collect()) == want


def brute_components(size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in rows():
        w = WORD.findall((r[1] or "").translate(low))
        sets.setdefault(r[0], {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = {i: i for i in sets}
    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            old, new = sorted((label[a], label[b]), key=lambda x: (x is None, x))[::-1]
            label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("size", "percent", "most", "pivots"), [(4, 85, 1 << 20, 16), (5, 80, 1 << 20, 16), (4, 97, 2, 2), (4, 30, 2, 2), (5, 80, 2, 1)])
def test_op4(docs, monkeypatch, size, percent, most, pivots):
    monkeypatch.setattr(jaccard, "MOST", most)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    want = brute_components(size, percent)
    for r in jaccard.joined(docs.filter("doc_id is not null"), size, percent).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r


@pytest.mark.parametrize("percent", [30, 80, 85, 97])
def test_linked_sets_share_a_signature(percent):
    rnd = np.random.default_rng(percent)
    schemes = jaccard.Schemes(percent)
    for _ in range(3000):
        n = int(rnd.integers(1, 60 if rnd.random() < 0.7 else 900))
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(n) > rnd.random() * (1 - percent / 100)], rnd.integers(0, 2**64, int(rnd.integers(0, 2 + n * (100 - percent) // 100)), dtype=np.uint64)]))
        if len(b) and jaccard.linked(a, b, percent):
            assert len(np.intersect1d(schemes.signatures(a), schemes.signatures(b))), (n, len(b))


def template(n_docs, words, own, seed=8):
    """Pages of one template, each with some words of its own: near the threshold to one another, but not linked."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for d in range(n_docs):
        w = list(base)
        for i in sorted(rnd.sample(range(0, words, 5), own)):
            w[i] = f"d{d}x{i}"
        out.append((d, " ".join(w)))
    return out


def test_op4_rounds_over_a_template(spark, monkeypatch):
    """A region whose members don't link takes a number of rounds that grows with the logarithm of its size only."""
    monkeypatch.setattr(jaccard, "MOST", 500)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rounds, cut = [], jaccard.cut_regions
    monkeypatch.setattr(jaccard, "cut_regions", lambda *a: rounds.append(1) or cut(*a))
    held = template(40, 200, 6) + [(100 + i, f"extra {t}") for i, t in template(40, 200, 6)[:3]]
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    sets = {i: set(zip(*(t.split()[k:] for k in range(4)), strict=False)) for i, t in held}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            label = {k: min(label[a], label[b]) if v in (label[a], label[b]) else v for k, v in label.items()}
    assert len(set(label.values())) > 20
    assert {r.doc_id: r.component_id for r in jaccard.joined(df, 4, 85).collect()} == label
    assert 1 <= len(rounds) <= 7


def test_op4_members_without_partners_are_not_compared(spark, monkeypatch):
    """Of regions too large for a task only members that may link by their sketches go on, so no text of others moves."""
    monkeypatch.setattr(jaccard, "MOST", 500)
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    compared, measured = [], jaccard.measured
    cells, within = spark.sparkContext.accumulator(0), jaccard.within_region

    def counted(*a):
        run = within(*a)

        def wrapped(table):
            cells.add(table.num_rows)
            return run(table)

        return wrapped

    monkeypatch.setattr(jaccard, "within_region", counted)
    monkeypatch.setattr(jaccard, "measured", lambda size: compared.append(size) or measured(size))
    held = template(40, 200, 10) + [(100, template(40, 200, 10)[3][1] + " more"), (101, "so " + template(40, 200, 10)[3][1])]
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.joined(df, 4, 85).collect()}
    assert got == {d: 3 if d >= 100 else d for d, _ in held}
    assert len(compared) <= 2 and cells.value <= 6


@pytest.mark.parametrize("percent", [30, 80, 85, 97])
def test_sketches_rule_out_no_link(percent):
    rnd = np.random.default_rng(percent)
    sets = []
    for _ in range(150):
        n = int(rnd.integers(1, 60 if rnd.random() < 0.5 else 900))
        a = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        sets += [a] + [np.unique(np.concatenate([a[rnd.random(len(a)) > x * (1 - percent / 100)], rnd.integers(0, 2**64, 1 + int(x * n * (100 - percent)) // 100, dtype=np.uint64)])) for x in (0.2, 0.5, 1.0)]
    pairs = list(itertools.combinations(range(len(sets)), 2))
    sketches = [jaccard.sketch(s) for s in sets]
    cut = [[i for i, _ in pairs], [j for _, j in pairs], [len(sets[i]) for i, _ in pairs], [len(sets[j]) for _, j in pairs], [sketches[i] for i, _ in pairs], [sketches[j] for _, j in pairs]]
    (out,) = jaccard.may_link(percent)([pa.record_batch([pa.array(c) for c in cut], names=["x", "y", "n_x", "n_y", "a", "b"])])
    passed = set(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    linked = {(i, j) for i, j in pairs if jaccard.linked(sets[i], sets[j], percent)}
    assert linked <= passed and len(linked) > 50
    if percent >= 80:
        assert len(passed) < len(pairs) / 10
    for blocks in (1, 3):
        comp = [k // 8 if k % 8 else -1 for k in range(len(sets))]
        kept = set()
        for lo, hi in itertools.combinations_with_replacement(range(blocks), 2):
            at = [k for k in range(len(sets)) if k % blocks in (lo, hi)]
            rows = {"s": [0] * len(at), "cid": at, "n": [len(sets[k]) for k in at], "comp": [comp[k] for k in at], "sketch": [sketches[k] for k in at], "block": [k % blocks for k in at]}
            kept |= set(jaccard.with_partner(percent)(pa.table(rows)).column("cid").to_pylist())
        assert {k for i, j in linked if comp[i] != comp[j] for k in (i, j)} <= kept


def test_op4_null_ids_stay(docs):
    assert jaccard.op4(docs).count() == len(rows())


def without_ids(spark):
    """Every text of ``rows`` under a null or a repeated id, and what links them: (rows, table, component of each row)."""
    held = [(None if i % 3 == 0 else i % 4, r[1]) for i, r in enumerate(rows())] + [(77, "  "), (77, None)]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in held:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(held)))
    for a, b in itertools.combinations(label, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    return held, spark.createDataFrame(held, "doc_id long, text string").repartition(3), sets, label


def test_op4_null_and_repeated_ids(spark):
    held, df, sets, label = without_ids(spark)
    least = {x: min((i for (i, _), y in zip(held, label, strict=True) if x == y and i is not None), default=None) for x in label}
    want = collections.Counter((i, len(s), least[x] if s else i) for (i, _), s, x in zip(held, sets, label, strict=True))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df, 5, 80).collect()) == want


def test_one_of_each_null_and_repeated_ids(spark):
    held, df, sets, label = without_ids(spark)
    got = [tuple(r) for r in jaccard.one_of_each(df).collect()]
    order = lambda i: (i is None, i or 0)
    left = collections.defaultdict(list)
    for (i, t), s, x in zip(held, sets, label, strict=True):
        if s:
            left[x].append((i, t))
    for members in left.values():
        least = min((i for i, _ in members), key=order)
        assert sum(g in members for g in got) == 1 and any(g in members and g[0] == least for g in got)
    bare = [i for (i, _), s in zip(held, sets, strict=True) if not s]
    assert sorted((i for i, t in got if not WORD.search(t or "")), key=order) == sorted([i for i in bare if i is None] + list({i for i in bare if i is not None}), key=order)


def test_row_keys_that_clash_are_salted_anew(spark, monkeypatch):
    _, df, _, _ = without_ids(spark)
    want = collected(jaccard.joined(df, 5, 80))
    good = jaccard.row_key
    monkeypatch.setattr(jaccard, "row_key", lambda salt: good(salt) if salt else good(salt) % 4)
    assert collected(jaccard.joined(df, 5, 80)) == want


def test_repeated_in_more_buckets_than_bytes(spark, monkeypatch):
    """A few repeats, as thousands of files would deal them."""
    monkeypatch.setattr(bits, "buckets", lambda rows: 14)
    seen = np.random.default_rng(6).integers(0, 2**63, 600, dtype=np.uint64) * np.uint64(2)
    df = spark.createDataFrame([(int(x),) for x in [*seen, *seen[:50]] for x in [x.view(np.int64)]], "h long").repartition(3)
    found = bits.repeated(df, lambda batch: batch.column(0).to_numpy().view(np.uint64)).value
    assert bits.holds_top(found, seen[:50]).all() and bits.holds_top(found, seen[50:]).sum() < 50


def test_crowded_bitmaps_pass_everything(spark, docs, monkeypatch):
    """Beyond their size bitmaps fall away, and results stay as they are."""
    want = [collected(op(docs)) for op in (suffix.op2, debruijn.op6)]
    monkeypatch.setattr(bits, "MOST", 3)
    hashes = np.random.default_rng(1).integers(0, 2**63, 100, dtype=np.uint64)
    assert bits.holds(bits.bitmap(docs, F.xxhash64("doc_id"), 50).value, hashes).all()
    assert [collected(op(docs)) for op in (suffix.op2, debruijn.op6)] == want


def test_op5(spark):
    rnd = np.random.default_rng(4)
    v = [(i, [float(np.float32(x)) for x in rnd.normal(size=7)]) for i in range(0, 260, 5)] + [(3, [0.5] * 7), (4, [0.5] * 7), (8, [0.5] * 4), (7, None), (9, [1.0, None] + [0.0] * 5), (11, [float("nan")] * 7), (12, [float("inf")] * 7), (13, []), (None, [1.0] * 7), (50, v2 := [9.0] * 7)]
    del v2
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    ok = [(i, np.floor(256 * np.array(e, dtype=np.float32).astype(float)).astype(np.int64)) for i, e in v if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    width = 7
    pad = lambda e: np.concatenate([e, np.zeros(width - len(e), np.int64)]).astype(np.int64)
    asks = {}
    for i, e in ok:
        if i % 50 == 0 and (i not in asks or list(e) < list(asks[i])):
            asks[i] = e
    want = []
    for q, e in asks.items():
        found = sorted((-int(pad(e) @ pad(c)), i) for i, c in ok if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    assert collected(topk.op5(df)) == sorted(want, key=repr)
    assert topk.op5(df.limit(0)).count() == 0
    extra = df.withColumn("place", F.lit("x")).withColumn("q", F.lit(1)).withColumn("score", F.lit(None).cast("string"))
    assert collected(topk.op5(extra)) == sorted(want, key=repr)


def test_op5_large_components(spark):
    """One large component changes nothing for the others; scores beyond a long count as the nearest long."""
    rnd = np.random.default_rng(11)
    v = [(i, [float(x) for x in rnd.normal(size=6)]) for i in range(0, 300, 3)]
    v += [(301, [1e17, 0.0, 0.0, 0.0, 0.0, 0.0]), (302, [0.0] * 5 + [-1e300]), (400, [0.0, 0.0, 1.7e308, 0.0, 0.0, -3.0]), (303, [3e5, -3e5, 1.0, 2.0, 3e5, 0.0])]
    whole = {i: [int(min(max(math.floor(x * 256) if abs(x) < 1e300 else x * 256, -topk.HUGE), topk.HUGE)) for x in e] for i, e in v}
    want = []
    for q in [i for i in whole if i % 50 == 0]:
        scores = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], e, strict=True)))) for i, e in whole.items() if i != q}
        want += [(q, n + 1, i, scores[i]) for n, i in enumerate(sorted(scores, key=lambda i: (-scores[i], i))[:5])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    assert collected(topk.op5(df)) == sorted(want, key=repr)


def test_op5_blocks_and_cutoff(spark, monkeypatch):
    """Several blocks of queries agree with one; the cutoff keeps most pairs from being scored in full."""
    rnd = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(x) for x in rnd.normal(size=16)]) for i in range(1500)], "vec_id long, embedding array<float>")
    want = collected(topk.op5(df))
    rows, width = topk.sliced(df, topk.PARTS)
    (queries,) = topk.query_blocks(rows, width, topk.PARTS, topk.EVERY, topk.SCALE)
    pairs = topk.collected(rows, spark.sparkContext.broadcast(queries), topk.PARTS, topk.K, topk.SCALE)
    assert len(queries.ids) == 30 and pairs.count() < 30 * 1500 / 4
    monkeypatch.setattr(topk, "QUERY_BYTES", 900)
    monkeypatch.setattr(topk, "SLICE", 200)
    assert collected(topk.op5(df)) == want


@pytest.mark.parametrize(("window", "k"), [(13, 6), (20, 6), (40, 6), (3, 3), (1, 1)])
def test_op6(docs, window, k):
    first = {}
    for r in rows():
        if r[0] is not None:
            w = WORD.findall(r[1] or "")
            for i in range(len(w) - window + 1):
                x = tuple(w[i : i + window])
                first[x] = min(first.get(x, r[0]), r[0])
    want = []
    for r in rows():
        w = WORD.findall(r[1] or "")
        gone = set()
        if r[0] is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < r[0]:
                    gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert collected(debruijn.deduplicated(docs, window, k)) == sorted(want, key=repr)


def test_op7(docs):
    lat = pieces.lattice(pieces.MODEL)

    def every(s, end):
        return [(0.0, [])] if end == 0 else [(a + v, [*p, s[b:end]]) for b, v in lat.edges(s, end) for a, p in every(s, b)]

    for word in ("▁hello", "▁▁▁a", "▁é日x", "\n", "▁"):
        want = sorted((a for a, _ in every(word, len(word))), reverse=True)
        assert [round(a, 3) for a, _ in lat.nbest(word, 6)] == [round(a, 3) for a in want[:6]]
        if len(want) > 1:
            assert abs(lat.first(word)[1] - lat.first(word)[2] - want[1]) < 1e-6
    text = "ab cat\nthe"
    segments = lat.segments(text)
    best = sum(lat.first(s)[1] for s in segments)
    want = sorted((a for a, _ in every("▁ab▁cat\nthe", 11)), reverse=True)[:8]
    assert [round(best - loss, 3) for loss, _ in lat.text_nbest(segments, [lat.first(s) for s in segments], 8)] == [round(a, 3) for a in want]
    for t in ("", " a  b ", "naïve 日本 \U0001f600\t\n", "x" * 900):
        assert lat.decode(lat.encode(t)) == t
    got = pieces.op7(docs).collect()
    assert len(got) == len(rows()) and all(r.round_trip for r in got)


def test_op7_memory_is_bounded_in_bytes(monkeypatch):
    """Lines without a space are segments of any length: what is remembered stays within its bytes, and results stay."""
    monkeypatch.setattr(pieces, "REMEMBERED", 200_000)
    lat = pieces.Lattice(pieces.MODEL)
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("日本語中国abc") for _ in range(n)) for n in [5, 20, 30] * 200 + [20_000]]
    for t in lines:
        assert lat.decode(lat.encode(t)) == t
        assert all(sum(400 + 4 * len(k) + len(v[0]) for k, v in d.items()) <= 200_000 for d in (lat.best, lat.older))
    fresh = pieces.Lattice(pieces.MODEL)
    assert all(fresh.encode(t) == lat.encode(t) for t in lines[:50])


def test_op8(docs):
    got = shards.op8(docs).collect()
    assert len(got) == len(rows())
    total = sum(r.size for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for k, held in by.items():
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert 0 <= k < 24
    biggest = max(r.size for r in got)
    assert all(abs(sum(r.size for r in held) - total / 24) <= 2 * biggest for held in by.values())
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    again = {(r.doc_id, r.slot, r.shard) for r in shards.op8(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.slot, r.shard) for r in got}


def test_op8_hot_text_and_even_law(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    per = collections.Counter()
    for r in shards.op8(df).collect():
        per[r.shard] += r.size
    assert len(per) == 24 and max(per.values()) - min(per.values()) <= 40
    assert shards.op8(df.limit(0)).count() == 0


def test_op8_copies_of_one_row_and_inner_ranges(spark, docs, monkeypatch):
    """Rows equal in all columns are cut apart; ranges cut again give the same shards."""
    df = spark.createDataFrame([(5, "same text")] * 2000 + [(i, f"text {i}") for i in range(1000)], "doc_id long, text string").repartition(7)
    got = shards.op8(df).collect()
    per = collections.Counter()
    for r in got:
        per[r.shard] += r.size
    assert len(got) == 3000 and len(per) == 24 and max(per.values()) - min(per.values()) <= 40
    assert all(sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got))) for k in per)
    want = collected(shards.op8(docs))
    monkeypatch.setattr(shards, "RANGE_ROWS", 1)
    monkeypatch.setattr(shards, "RANGES", 5)
    assert collected(shards.sharded(docs, 24, 5).select("doc_id", "size", "text_crc32", F.lit("bytes"), "shard", "slot", F.lit(None))) == want


def test_op9(docs):
    got = mix.op9(docs).collect()
    assert len(got) == len(rows())
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    source = {}
    for r in rows():
        source.setdefault((r[0], len(WORD.findall(r[1] or ""))), r[3])
    taken = collections.Counter()
    for r in got:
        s = source[r.doc_id, r.size]
        assert abs(r.target - target[s]) < 1e-6 and r.source_size == sizes[s]
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    biggest = max(r.size for r in got)
    assert sum(taken.values()) <= sum(sizes.values())
    assert all(abs(taken[s] - target[s]) <= 3 * biggest for s in sizes)
    assert collected(mix.op9(docs.repartition(7))) == sorted((tuple(r) for r in got), key=repr)
    assert mix.op9(docs.limit(0)).count() == 0


def test_op9_cutoff_in_small_steps(spark, docs, monkeypatch):
    """Cut again and again down to single rows, the budget ends at the same document; null ids with many texts too."""
    nulls = spark.createDataFrame([(None if i % 2 else i, f"w {i} " * (i % 9), "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string").repartition(3)
    want = [collected(mix.op9(d)) for d in (docs, nulls)]
    monkeypatch.setattr(mix, "STEPS", 3)
    monkeypatch.setattr(mix, "FEW", 1)
    assert [collected(mix.op9(d)) for d in (docs, nulls)] == want


def test_op10(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.op10(docs).collect()}
    for r in rows():
        t = r[1] or ""
        w = WORD.findall(t)
        windows = collections.defaultdict(list)
        for i in range(len(w) - 2):
            windows[tuple(w[i : i + 3])].append(i)
        repeated = {i + o for at in windows.values() if len(at) > 1 for i in at for o in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        g = got[r[0], len(w), sum(map(len, w))]
        assert (g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert g.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w))
        assert not (g.base_failed and g.kept)


def test_op10_short_repeated_line_is_no_reason(spark):
    """A short line said twice in a long text passes; a text of repeated lines, or one without function words, does not."""
    rnd = random.Random(2)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) if i % 3 else "the" for i in range(n))
    short, long = line(4), line(60)
    held = [(1, f"{short}\n{line(150)}\n{short}"), (2, f"{long}\n{line(40)}\n{long}"), (3, line(150).replace("the", "xqz"))]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(held, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].n_dup_lines == 1 and got[1].n_dup_line_words == 4
    assert "duplicate_lines" in got[2].failed_rules and got[2].n_dup_line_words == 60
    assert got[3].failed_rules == "stop_words"


def test_op10_slow_path(docs, monkeypatch):
    want = collected(quality.op10(docs))
    monkeypatch.setattr(quality, "PLACE_BITS", 3)
    assert collected(quality.op10(docs)) == want


def test_op1(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x/y?q#t", '<html lang="en"><head><title> A &amp; B </title></head><body><script>no</script><p>One&nbsp;two &#233;&#x1F600; &lt;b&gt;</p><a href="/r">r</a><a href=\'z\'>z</a></body></html>', 5), (2, None, None, 6), (1, "https://a.example/x/y?q#t", "", 5), (3, "u", "<p>un<b>closed", 1)], "page_id long, url string, html string, record_id long")
    r = warc.derivatives(warc.responses(pages)).collect()
    assert len(r) == 8 and {x.warc_type for x in r} == {"metadata", "conversion"}
    conv = next(x for x in r if x.page_id == 1 and x.warc_type == "conversion" and x.content_length)
    assert conv.block == "One two é\U0001f600 <b>\nrz"
    meta = next(x for x in r if x.page_id == 1 and x.warc_type == "metadata" and "title" in x.block)
    assert "title: A &amp; B\r\n" in meta.block and "outlink: https://a.example/r L a/@href" in meta.block and "outlink: https://a.example/x/z L" in meta.block
    assert meta.refers_to == conv.refers_to and meta.record_id != conv.record_id
    import base64

    assert conv.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(conv.block.encode()).digest()).decode()
    raw = warc.serialised(warc.derivatives(warc.responses(pages))).collect()
    assert all(x.record.startswith("WARC/1.1\r\n") and "WARC-Refers-To: <urn:uuid:" in x.record for x in raw)


@pytest.mark.parametrize("op", [suffix.op2, pii.op3, jaccard.op4, debruijn.op6, pieces.op7, quality.op10])
def test_empty_tables(docs, op):
    assert op(docs.limit(0)).count() == 0
