"""The pipeline's stages one by one, and the whole against a plain reading of what must hold."""

import collections
import hashlib
import importlib
import itertools
import re

import pytest

from tests.llm.test_operators import DDL, WORD, brute_rewritten, brute_terms, rows
from webstrata.llm import mix, pieces, quality

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).select("doc_id", "text", "lang", "source", "n_chars").repartition(3)


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "target_mix", "piece_encoding"]
    kept = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = after.collect()
        docs = after
    assert all(len(WORD.findall(r.text)) >= 50 for r in kept["quality_rules"])
    ids = [r.doc_id for r in kept["near_duplicates"]]
    assert len(ids) == len(set(ids)) and set(ids) < {r.doc_id for r in kept["quality_rules"]}
    assert not any("bob.q@" in r.text for r in kept["personal_data"])
    assert len(kept["personal_data"]) == len(kept["near_duplicates"])
    clean = {r.doc_id: r.text for r in kept["personal_data"]}
    again = collections.Counter(r.doc_id for r in kept["target_mix"])
    assert all(r.text == clean[r.doc_id] for r in kept["target_mix"]) and max(again.values()) <= 3
    assert len(kept["piece_encoding"]) == len(kept["target_mix"])
    assert all(r.round_trip for r in kept["piece_encoding"])


def test_empty(spark, docs):
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def kept_by_rules(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    if len(w) < 50:
        return False
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {i + o for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for o in range(3)}
    share = {
        "mean_word_length": sum(map(len, w)) / len(w),
        "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / len(w),
        "stop_words": sum(x.lower() in quality.STOP_WORDS for x in w) / len(w),
        "alphabetic_words": sum(any(c.isalpha() for c in x) for x in w) / len(w),
        "duplicate_lines": (len(w) - sum(len(WORD.findall(x)) for x in set(lines))) / len(w),
        "ellipsis_lines": sum(bool(re.search(r"(?:\.\.\.|…)\s*$", x)) for x in lines) / len(lines),
        "bullet_lines": sum(bool(re.search(r"^\s*[-*•] ", x)) for x in lines) / len(lines),
    }
    return 100 * len(repeated) <= 50 * len(w) and all((r.low is None or share[r.name] >= r.low) and (r.high is None or share[r.name] <= r.high) for r in quality.RULES)


def one_of_each(docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, _ in docs:
        w = WORD.findall(t.translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    label = list(range(len(docs)))
    for a, b in itertools.combinations(label, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            label = [label[a] if x == label[b] else x for x in label]
    return [min((d for d, x in zip(docs, label, strict=True) if x == y), key=lambda d: (d[0] is None, d[0] or 0)) for y in set(label)]


def mixed(docs):
    """doc_id, text of every occurrence that the mix takes, by sorting all finish times."""
    size = lambda t: len(WORD.findall(t))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    total = sum(size(t) for _, t, _ in docs)
    order = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    source = {s: sum(size(t) for _, t, x in docs if x == s) for s in order}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(total)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 3 * source[s]}
        for s in full or free:
            target[s] = min(3.0 * source[s], level * weight[s])
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    queue = []
    for s in order:
        cum = 0
        for u, d, n, t in sorted((md5(f"mix-1:{d if d is not None else 'null:' + md5(t)}"), -1 if d is None else d, size(t), t) for d, t, x in docs if x == s):
            cum += n
            queue += [((cum + e * source[s]) / target[s], u, d, e, n, t) for e in range(3)]
    out, used = [], 0
    for _, _, d, _, n, t in sorted(queue):
        used += n
        if used > total:
            break
        out.append((None if d == -1 else d, t))
    return out


def test_run_against_a_plain_reading(spark, docs, tmp_path):
    """All five stages after one another, each worked out by hand on what the one before kept."""
    extra = [r.asDict() for r in docs.filter("doc_id is not null and length(text) > 400").collect()]
    more = [(5000 + i, f"{r['text']} the and of to {i}" + (" Zorbian mail eve@shop.example" if i % 4 == 0 else ""), "en", f"s{i % 5}", 1) for i, r in enumerate(extra)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    held = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    held = one_of_each([d for d in held if kept_by_rules(d[1])])
    assert len(held) > 8
    terms = brute_terms([t for _, t, _ in held])
    held = [(d, brute_rewritten(t, terms), s) for d, t, s in held]
    lat = pieces.lattice(pieces.MODEL)
    want = sorted(((d, *pieces.encode_row(lat, t, pieces.N_BEST)) for d, t in mixed(held)), key=repr)
    assert sorted((tuple(r) for r in pipeline.run(spark, str(tmp_path)).collect()), key=repr) == want and len(want) > 8


def test_mix_without_shuffling_texts(spark, docs, monkeypatch):
    """Last places of sources give the same rows as the plan joined back, and texts pass no exchange."""
    narrow = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(9000 + i, f"word {i} " * (i % 7), "en", f"s{i % 3}" if i % 4 else None, 1) for i in range(300)], docs.schema))
    narrow = narrow.localCheckpoint()
    out = mix.repeat_taken(narrow)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    got = collections.Counter(tuple(r) for r in out.collect())
    monkeypatch.setattr(mix, "SOURCES", -1)
    assert collections.Counter(tuple(r) for r in mix.repeat_taken(narrow).collect()) == got and len(got) > 100 and max(got.values()) > 1


def test_pieces_return_the_segmentations(docs):
    """The n best themselves, not their digests only."""
    lat = pieces.lattice(pieces.MODEL)
    texts = [r.text for r in docs.select("text").collect()]
    got = [r for r in pieces.segmented(docs).collect()]
    assert collections.Counter(lat.decode(r.nbest_ids[0]) for r in got) == collections.Counter(t or "" for t in texts)
    price = lambda ids: sum(lat.score[i] for i in ids)
    for r in got:
        assert len(r.nbest_ids) == r.n_best == len(set(map(tuple, r.nbest_ids))) and len(r.nbest_ids[0]) == r.n_pieces
        assert [hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() for ids in r.nbest_ids] == r.nbest_sha256.split(",")
        assert r.ids_sha256 == r.nbest_sha256.split(",")[0] and r.second_sha256 == (r.nbest_sha256.split(",") + [None])[1]
        assert len({lat.decode(ids) for ids in r.nbest_ids}) == 1
        if all(i in lat.score for ids in r.nbest_ids for i in ids):
            assert all(abs(price(ids) - float(x)) < 0.01 for ids, x in zip(r.nbest_ids, r.nbest_scores.split(","), strict=True))
