"""SimHash, near copies, repeated substrings, nearest neighbours, components: against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import ann as A
from siltstone.llm import nearcopies as N
from siltstone.llm import simhash as H
from siltstone.llm import substrings as B
from siltstone.llm.graph import connected_components


def components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in combinations(range(n), 2):
        if root(i) != root(j) and linked(i, j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def plain_fingerprint(text, width=3):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    f = [plain_fingerprint(r.text) for r in rows]
    root = components(len(rows), lambda i, j: (f[i] ^ f[j]).bit_count() <= 2)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted(str((r.doc_id, f"{x:016x}", least.get(k))) for r, x, k in zip(rows, f, root, strict=True))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in H.near_duplicates(odd_docs).collect()) == want
    assert H.near_duplicates(no_docs).count() == 0


def test_links_keep_components_of_dense_groups(spark, monkeypatch):
    rng = random.Random(5)
    values = {0, (1 << 64) - 1}
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(80):  # chains and clusters within two bits
            values.add(x)
            x ^= 1 << rng.randrange(64) if rng.random() < 0.7 else (1 << rng.randrange(64) | 1 << rng.randrange(64))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    for bits, large, small in ((1, H.LARGE, H.SMALL), (2, H.LARGE, H.SMALL), (2, 20, H.SMALL), (2, 20, 4), (2, H.LARGE, 4)):
        monkeypatch.setattr(H, "LARGE", large)
        monkeypatch.setattr(H, "SMALL", small)
        root = components(len(values), lambda i, j, b=bits: ((values[i] ^ values[j]) & ((1 << 64) - 1)).bit_count() <= b)
        marked = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, fp long")
        got = {r.fp: r.component_id for r in H.classes(marked, bits).collect()}
        assert [got[v] for v in values] == root


def test_tally_counts_shared_positional_bytes():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 63, 20, np.uint64)
    b = a ^ np.uint64(0xFF00000000000001)
    want = [[sum(x == y for x, y in zip(int(p).to_bytes(8), int(q).to_bytes(8), strict=True)) for q in b] for p in a]
    assert H.tally(a, b).tolist() == want and all(want[k][k] == 6 for k in range(20))
    assert all(len(set(H.SHARED[k]) & set(range(8))) == (4 if k < 6 else 6) for k in range(42))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 700)] + [(rng.randrange(800, 900), rng.randrange(800, 900)) for _ in range(60)] + [(3, 3), (1, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {frozenset(e) for e in edges}
    root = components(900, lambda i, j: frozenset((i, j)) in linked)
    assert got == {i: r for i, r in enumerate(root) if i != r}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copies(spark, odd_docs, no_docs):
    rng = random.Random(9)
    rows = []
    for k in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(30, 400))]
        rows.append((100 + 10 * k, " ".join(base)))
        for c in range(rng.randrange(4)):
            new = list(base)
            for _ in range(max(1, len(base) * c // 150)):
                new[rng.randrange(len(new))] = "edit"
            rows.append((100 + 10 * k + c + 1, " ".join(new)))
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_docs.unionByName(more, allowMissingColumns=True)
    kept = N.keep_one(docs)
    all_rows = docs.select("doc_id", "text").collect()
    sets = [set(N.shingles((r.text or "").encode()).tolist()) for r in all_rows]
    root = components(len(all_rows), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    least = {}
    for r, k in zip(all_rows, root, strict=True):
        key = (r.doc_id is None, r.doc_id or 0)
        least[k] = min(least.get(k, key), key)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(least.values())
    assert kept.columns == docs.columns and N.keep_one(no_docs).count() == 0


def test_no_link_of_a_dense_group_is_lost(spark):
    """Pairs just above and below the threshold, in a group where all members share most shingles: as brute force."""
    rng = random.Random(11)
    base = [f"v{rng.randrange(5000)}" for _ in range(260)]
    rows = []
    for k in range(260):
        new = list(base)
        for _ in range(rng.choice((2, 4, 5, 5, 6, 6, 7, 9))):
            new[rng.randrange(len(new))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(new)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = [set(N.shingles(t.encode()).tolist()) for _, t in rows]
    root = components(len(rows), lambda i, j: jaccard(sets[i], sets[j]) >= 0.8)
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == sorted(set(root)) and 1 < len(set(root)) < 260


@pytest.mark.parametrize("block", [1 << 22, 1000])
def test_members_outside_a_large_lists_largest_class(spark, monkeypatch, block):
    """One list of all documents, and rounds that find nothing: each two members meet nevertheless."""
    monkeypatch.setattr(N, "list_keys", lambda least: np.zeros(1, np.int64))
    monkeypatch.setattr(N, "_tallied", lambda pairs, least: pairs.select("a", "b").where("a < a"))
    monkeypatch.setattr(N, "WHOLE", 2)
    monkeypatch.setattr(N, "BLOCK_BYTES", block)
    words = lambda group, k: " ".join(f"w{group}x{n}" for n in range(60 + 2 * k))
    docs = spark.createDataFrame([(10 * group + k, words(group, k)) for group in range(5) for k in range(4)], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(docs).collect()) == [0, 10, 20, 30, 40]


def test_first_near():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, n, np.uint64)) for n in (1, 5, 30, 60, 60, 90, 40)]
    for similarity in (0.2, 0.5, 0.8):
        want = [next((k for k, b in enumerate(sets[:5]) if jaccard(set(a.tolist()), set(b.tolist())) >= similarity), -1) for a in sets]
        assert N.first_near(sets, sets[:5], similarity) == want


def plain_repeats(texts, length):
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("large", [4096, 2])
def test_repeated_substrings(spark, odd_docs, no_docs, large):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ü") for _ in range(420))
    extra = [(200 + k, "".join(rng.choice("ijkl mn") for _ in range(rng.randrange(0, 300))) + passage[rng.randrange(60) : rng.randrange(250, 420)] + "".join(rng.choice("ijkl") for _ in range(rng.randrange(80)))) for k in range(14)]
    extra += [(300, "=" * 700), (301, "ab" * 400), (302, passage + passage)]
    docs = odd_docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(str((r.doc_id, *x)) for r, x in zip(rows, plain_repeats([(r.text or "").encode() for r in rows], 200), strict=True))
    got = B.remove_repeats(docs, large=large)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got.collect()) == want
    assert B.remove_repeats(no_docs).count() == 0


def test_repeats_in_a_text_of_several_chunks(spark):
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(300)
    before = noise(B.CHUNK - 150)  # the passage lies across the end of the first chunk
    long = before + passage + noise(B.CHUNK) + passage + noise(500)
    got = {r.doc_id: r for r in B.remove_repeats(spark.createDataFrame([(1, long), (2, "x" + passage), (3, noise(400))], "doc_id long, text string")).collect()}
    assert (got[1].n_bytes, got[1].n_removed, got[1].n_spans) == (len(long), 600, 2) and got[1].kept_sha256 == hashlib.sha256(long.replace(passage, "").encode()).hexdigest()
    assert (got[2].n_removed, got[3].n_removed) == (300, 0)


def test_units_cover_every_string_once():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    seen = np.concatenate([np.arange(s, s + c) for start, count, *_ in B.units(data) for s, c in zip(start, count, strict=True)])
    assert (seen == np.arange(5000 - 199)).all()
    step, B.CHUNK = B.CHUNK, 700
    try:
        cut = np.concatenate([np.arange(s, s + c) for start, count, *_ in B.units(data) for s, c in zip(start, count, strict=True)])
    finally:
        B.CHUNK = step
    assert (cut == seen).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=16).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=40), st.integers(8, 16))
def test_deep_shallow_keeps_prefixes_together(rows, shallow):
    data = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 16)
    order = B.deep_shallow(data, np.zeros(len(rows), np.int64), shallow - shallow % 8)
    assert sorted(order.tolist()) == list(range(len(rows)))
    for length in range(1, 17):
        prefixes = [rows[i][:length] for i in order]
        assert sum(a != b for a, b in zip(prefixes, prefixes[1:], strict=False)) + 1 == len(set(prefixes))


def test_answers_of_many_lists_are_merged_in_steps_that_do_not_grow_with_their_square(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rng.integers(-3, 4, (400, 4)))]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 20, 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_distinct" not in plan
    want = [(q, place, i, s) for q in range(0, 400, 20) if any(rows[q][1]) for place, (s, i) in enumerate(sorted(((-float(np.dot(rows[q][1], v)), i) for i, v in rows if i != q and any(v)))[:5], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, -r.score) for r in got.collect()) == want


def test_first_best():
    rng = random.Random(4)
    rows = [(rng.randrange(6), rng.randrange(12), float(rng.randrange(5))) for _ in range(300)]
    want = []
    for of in range(6):
        best = {}
        for _, i, s in (r for r in rows if r[0] == of):
            best[i] = max(best.get(i, s), s)
        want += [(of, i, s) for s, i in sorted((-s, i) for i, s in best.items())[:4]]
    at = A.first_best(*(np.array(c) for c in zip(*rows, strict=True)), 4)
    assert [(o, i, -s) for o, i, s in (rows[k] for k in at)] == want


def test_nearest_neighbours_exact_on_few_lists(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12))
    v[50:350] = v[50]  # a hot vector
    v[400] = 3 * v[401]
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0, None] * 6), (1080, [1.0] * 5), (None, [1.0] * 12), rows[60]]
    got: dict = {}
    clash = {c: F.lit(1) for c in ("vec", "ids", "list", "at", "query_id", "rank", "score", "part", "wave", "found")}  # names that the operator uses
    for r in A.search(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumns(clash)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    found = total = 0
    for q, answers in got.items():
        s = (v * v[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert len(answers) == 20 and [a for a, _ in answers] == [i for i, _ in sorted(answers, key=lambda x: (-x[1], x[0]))]
        assert all(abs(x - s[i]) < 1e-9 for i, x in answers)
        found, total = found + len(set(order) & {i for i, _ in answers}), total + 20
    assert found / total >= 0.9
    hot = [i for i, _ in got[60]]
    assert set(range(50, 60)) <= set(hot)  # ties go to smaller ids


def test_nearest_neighbours_small_and_empty(spark):
    kind = "vec_id long, embedding array<float>"
    assert A.search(spark.createDataFrame([], kind)).count() == 0
    got = A.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.0, 1.0])], kind)).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert A.search(spark.createDataFrame([(0, [1.0, 0.0])], kind)).count() == 0


def test_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got: dict = {}
    for r in A.op9_ann(spark, small).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & set([i for i in ids[np.lexsort((ids, -(v @ v[k])))] if i != q][:20])) / 20 for k, q in enumerate(ids) if q % 20 == 0]
    assert np.mean(hits) >= 0.9


def test_probes_are_tuned_on_vectors_outside_the_fit(spark, monkeypatch):
    monkeypatch.setattr(A, "SAMPLE", 300)  # fewer vectors than two for each of the 188 lists
    monkeypatch.setattr(A, "LIST_SIZE", 32)
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    got: dict = {}
    for r in A.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    score = v[::20] @ v.T
    score[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    hits = [len(got[20 * k] & set(np.argsort(-s)[:20].tolist())) / 20 for k, s in enumerate(score)]
    assert np.mean(hits) >= 0.92
