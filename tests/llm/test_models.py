"""Language, quality and mixing."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import langid as L
from siltstone.llm import mixing as M
from siltstone.llm import quality as Q
from siltstone.llm.queries import ORACLE_SQL, QUERIES


def plain_ppm(docs):
    """Counts by context as they come, and code lengths by their definition."""
    count = {}
    for d in docs:
        d = b"\0\0\0" + d
        for i in range(3, len(d)):
            for k in range(4):
                at = count.setdefault(d[i - k : i], {})
                at[d[i]] = at.get(d[i], 0) + 1

    def probability(context, byte):
        mass, out = 1.0, set()
        for k in range(3, -1, -1):
            left = {b: n for b, n in count.get(context[3 - k :], {}).items() if b not in out}
            if left:
                total = sum(left.values()) + len(left)
                if byte in left:
                    return mass * left[byte] / total
                mass *= len(left) / total
                out |= set(left)
        return mass / (256 - len(out))

    return probability


def test_code_lengths_by_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    samples = {"a": [b"abababac" * 6, b"abba cab"], "b": ["hier und dort wörds".encode() * 2, b"x"], "c": [bytes(rng.integers(0, 256, 400).astype(np.uint8))], "d": [b""]}
    model = L.fit(samples)
    texts = [b"abac abab", b"", b"x", b"die Katze h\xc3\xb6rt", bytes(rng.integers(0, 256, 60).astype(np.uint8)), b"abababac" * 40, b"\0\0a"]
    for lang, tree in zip(model.langs, model.trees, strict=True):
        p = plain_ppm(samples[lang])
        want = [-sum(np.log2(p((b"\0\0\0" + t)[i : i + 3], t[i])) for i in range(len(t))) for t in texts]
        for chunk in (L.CHUNK, 7, 3):
            monkeypatch.setattr(L, "CHUNK", chunk)
            assert np.allclose(L.code_lengths(model, texts)[:, model.langs.index(lang)], want, rtol=1e-5, atol=1e-3)
        for context in (b"aba", b"\0\0\0", b"zzz", b"ba "):  # the probabilities of all bytes add up
            strings = np.array([int.from_bytes(context + bytes([x])) for x in range(256)], np.uint32)
            assert np.exp2(-tree.bits(strings)).sum() == pytest.approx(1.0, abs=1e-4)


def test_a_text_of_several_chunks(spark):
    model = L.fit({"en": [b"the cat sat on the mat " * 30], "de": ["der Hund lag auf der Wiese ".encode() * 30]})
    text = "the cat " * 200_000 + "der Hund auf der Wiese " * 10
    got = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    want = L.code_lengths(model, [text.encode()])[0]
    assert len(text) > 3 * L.CHUNK and got.lang_pred == "en" and got.bits_per_byte == pytest.approx(want.min() / len(text))


def test_every_language_is_learnt_within_the_bounds(spark):
    docs = spark.createDataFrame([(i, f"lang{i % 90} " * (5 if i % 90 else 400), f"l{i % 90:02d}") for i in range(3000)] + [(9000, "long " * 20_000, "rare"), (9001, None, "empty"), (None, "x", "noid")], "doc_id long, text string, lang string")
    got = L.sample(docs)
    assert len(got) == 91 and "rare" in got and len(got["rare"][0]) <= L.TEXT_BYTES
    bounded = L.sample(docs, total_bytes=91 * 4096)
    assert len(bounded) == 91 and max(sum(map(len, v)) for v in bounded.values()) < 91 * 512 and all(len(t) <= 512 for v in bounded.values() for t in v)


def test_language_on_odd_rows(spark, odd_docs, no_docs):
    model = L.fit({"en": [b"one two words here and there " * 30], "de": ["hier und dort im Text wörds ".encode() * 30]})
    got = {r.doc_id: r for r in L.identify(odd_docs, model, ["doc_id"]).collect()}
    assert got[6].lang_pred == got[7].lang_pred == got[8].lang_pred == "und" and got[7].score == 0 and got[11].lang_pred == "en" and got[12].lang_pred == "de"
    assert len(L.identify(odd_docs, model, ["doc_id"]).collect()) == odd_docs.count() and L.identify(no_docs, model, ["doc_id"]).count() == 0
    kept = L.keep_known(odd_docs, model)
    assert kept.columns == odd_docs.columns and not {6, 7, 8} & {r.doc_id for r in kept.collect()} and {9, 11, 12} <= {r.doc_id for r in kept.collect()}
    nothing = L.train(no_docs)
    assert {r.lang_pred for r in L.identify(odd_docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_language_held_out(spark, small, documents):
    got = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, small).collect()}
    rows = documents.collect()
    assert len(got) == len(rows) and all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= got[r.doc_id].score <= 1 for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.95


def test_quality_held_out(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, small).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for i, r in got.items())
    held = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) >= 0.8


def test_quality_by_brute_force(spark, small, documents):
    """The whole way without the operator's code for packing and scoring: plain Zstandard calls and the curve."""
    import zstandard

    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = Q.sample(documents, labels)
    known = {r.doc_id: r.quality for r in labels.collect()}
    usable = [r for r in documents.collect() if r.doc_id in known and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    assert sorted(rows) == sorted((r.text[:16_000].encode(), known[r.doc_id]) for r in usable)  # fewer than the bound: all of them
    model = Q.fit(rows)

    def size(text, data):
        more = {"dict_data": zstandard.ZstdCompressionDict(data)} if data else {}
        packer = zstandard.ZstdCompressor(level=Q.LEVEL, write_content_size=False, write_dict_id=False, **more)
        return sum(len(packer.compress(text[lo : lo + Q.BLOCK])) for lo in range(0, len(text), Q.BLOCK))

    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, small).collect()}
    for r in documents.collect():
        text = (r.text or "").encode()
        x = ((size(text, model.bad) - size(text, model.good)) / len(text), size(text, b"") / len(text)) if text else (0.0, 0.0)
        want = 1 / (1 + np.exp(-(model.intercept + x[0] * model.slopes[0] + x[1] * model.slopes[1])))
        assert got[r.doc_id].score == pytest.approx(want, abs=0.02) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_quality_on_odd_rows(spark, odd_docs, no_docs):
    model = Q.fit([(b"good words of prose " * 20 + bytes([65 + i]), 1) for i in range(20)] + [(b"### $$$ %%% &&& " * 20 + bytes([65 + i]), 0) for i in range(20)])
    rows = Q.score(odd_docs.select("doc_id", "text"), model, ["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    good, bad = model.probability(np.array([Q.Packers(model).sizes(t) for t in (b"good words of prose " * 19 + b"!", b"### $$$ %%% &&& " * 19 + b"!")]))
    assert good > 0.7 > bad
    assert Q.score(no_docs, Q.fit([]), ["doc_id"]).count() == 0
    assert {round(r.score, 6) for r in Q.score(odd_docs, Q.fit([(b"x", 1)]), ["doc_id"]).collect()} == {round(2 / 3, 6)}


def test_raking_meets_its_targets(spark):
    rng = np.random.default_rng(2)
    cells = [(s, lang, t, float(rng.integers(1, 1000))) for s in "abcd" for lang in "xyz" for t in "pq"]
    targets = {"source": {"a": 0.5}, "lang": {"x": 0.2, "y": 0.2, "gone": 0.3}, "topic": {"p": 0.9, "q": 0.1}}
    got = M.rake(spark.createDataFrame(cells, "source string, lang string, topic string, mass double"), targets, sweeps=40, tolerance=1e-9).collect()
    total = sum(r.mass for r in got)
    share = lambda d, v: sum(r.mass / total * r.ratio for r in got if r[d] == v)
    assert share("source", "a") == pytest.approx(0.5, abs=1e-6) and share("topic", "p") == pytest.approx(0.9, abs=1e-6)
    assert max(r.residual for r in got) < 1e-8
    apart = M.rake(spark.createDataFrame([("a", "x", 5.0), ("b", "y", 5.0)], "source string, lang string, mass double"), {"source": {"a": 0.9}, "lang": {"x": 0.1}}, sweeps=5).collect()
    assert apart[0].residual == pytest.approx(0.8)  # both at once can't be met, and that is told
    assert share("lang", "x") == pytest.approx(0.2, abs=1e-6) and share("lang", "z") == pytest.approx(0.6, abs=1e-6)  # the language that is not there leaves its share to the rest


def test_topics(spark):
    texts = {"The bank, a MARKET and one hospital": "finance", "bank court": "prose", "court bank court bank": "law", "riverbank embankment": "prose", "Die Regierung, die Wahlen": "politics", "a | b licensed under": "license", "software,software | x": "technology", None: "prose", "": "prose"}
    got = {r.t: r.topic for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.topic_of(F.col("t")).alias("topic")).collect()}
    assert got == texts
    assert spark.createDataFrame([("my own words",)], "t string").select(M.topic_of(F.col("t"), {"mine": ("own", "word")}).alias("topic")).first().topic == "mine"


def test_mixing_on_odd_rows(spark, odd_docs, no_docs):
    rows = M.calibrate(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.probability <= 1 <= r.weight for r in rows)
    assert {r.source for r in rows} >= {M.NONE} and M.calibrate(no_docs).count() == 0
    drawn = M.sample(odd_docs)
    assert drawn.columns == odd_docs.columns and sorted(str(r.doc_id) for r in drawn.collect()) == sorted(str(r.doc_id) for r in rows if r.sampled)
    assert M.sample(no_docs).count() == 0


def test_values_beside_a_full_set_of_targets_keep_their_share(spark):
    langs = {"en": 30.0, "de": 25.0, "fr": 15.0, "es": 10.0, "it": 15.0, M.NONE: 5.0}
    cells = spark.createDataFrame(list(langs.items()), "lang string, mass double")
    got = {r.lang: r.target for r in M.shares(cells, "lang", M.TARGETS["lang"]).collect()}
    assert got == pytest.approx({"en": 0.4, "de": 0.16, "fr": 0.144, "es": 0.096, "it": 0.15, M.NONE: 0.05})
    docs = spark.createDataFrame([(i, "word " * 50, ("en", "de", "fr", "es", "it", None)[i % 6], "src0" if i % 8 == 0 else "src1") for i in range(600)], "doc_id long, text string, lang string, source string")
    assert {r.lang for r in M.sample_unweighted(docs).collect()} == {"en", "de", "fr", "es", "it", None}


def test_the_pipelines_draw_meets_its_targets_unweighted(spark):
    import corpus_pipeline as C

    # A source and a language with less than their targets ask for at the usual rate, in cells of their own.
    docs = spark.createDataFrame([(i, "word " * 50, "de" if i % 25 == 0 else ("en", "fr", "es")[i % 3], "src0" if i % 20 == 0 else "src1") for i in range(9000)], "doc_id long, text string, lang string, source string")
    rows = C.mix_sources(spark, docs, "").collect()
    share = lambda name, v: sum(getattr(r, name) == v for r in rows) / len(rows)
    assert share("source", "src0") == pytest.approx(0.12, abs=0.02) and share("lang", "de") == pytest.approx(0.2, abs=0.02) and len(rows) > 1200
    cells = spark.createDataFrame([(s, lang, "prose", m) for s, lang, m in (("src0", "en", 3.0), ("src0", "de", 5.0), ("b", "en", 60.0), ("b", "de", 20.0), ("b", "fr", 7.0), ("b", "es", 5.0))], "source string, lang string, topic string, mass double")
    got = M.chances(cells, M.TARGETS).collect()
    kept = sum(r.mass * r.p for r in got)
    assert max(r.p for r in got) <= 1 and sum(r.mass * r.p for r in got if r.source == "src0") / kept == pytest.approx(0.12, abs=1e-3) and kept > 30


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df, found = QUERIES[name](spark, small), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    order = sorted(columns)
    assert sorted(df.columns) == order
    show = lambda x: f"{x:.4g}" if isinstance(x, float) else str(x)
    want = sorted(tuple(show(r[columns.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(show(r[c]) for c in order) for r in df.collect()) == want


def test_queries_read_whole_tables(spark, small, documents):
    for name in ("op3_simhash", "op6_pii_surrogates", "op7_repeated_substrings"):
        assert QUERIES[name](spark, small).select("doc_id").distinct().count() == documents.count()


def test_pipeline_stages(spark, small, documents, odd_docs):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    out = C.run(spark, small)
    assert out.columns == documents.columns and 0 < out.count() < documents.count() and not out.where(F.col("text").rlike(r"@mail\d")).join(documents, ["doc_id", "text"], "left_semi").count()
    docs = odd_docs
    for _, stage in C.STAGES:
        docs = stage(spark, docs, small)
        assert docs.columns == odd_docs.columns and docs.count() <= odd_docs.count()
