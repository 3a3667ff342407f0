from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import columns as C
from siltstone.operators import health as HE
from siltstone.operators import index as IX
from siltstone.operators import search as SE
from siltstone.operators import store as ST
from siltstone.operators import units as U
from siltstone.sources import UnsupportedSource, config, github, llms_txt, local, reader, website

COLUMNS = "id string, type string, framework string, module_path string, heading_hierarchy array<string>, content string, related_symbols array<string>, definition_symbols array<string>, relevance_decay double, unit_seq bigint"


@pytest.fixture(scope="module")
def units(spark):
    rows = [
        ("u1", "api", "fa", "fa.core", ["Core", "Widget"], "The Widget class runs the main loop.", ["Widget", "run()"], ["widget"], 1.0, 1),
        ("u2", "example", "fa", "fa.core", ["Core"], "Use the widget here. The main loop starts.", ["widget"], [], 1.0, 2),
        ("u3", "concept", "fa", "fa.notes_x", ["Notes"], "The main loop changed in the last release.", ["Loop"], [], 0.3, 3),
        ("u4", "pitfall", "fa", "fa.core", ["Core", "Traps"], "Never call run twice.", ["run"], [], 1.0, 4),
        ("u5", "api", "fb", "fb.café", ["Café"], "The main LOOP of café — the main loop.", ["widget"], ["widget"], 1.0, 5),
    ]
    return spark.createDataFrame(rows, COLUMNS).persist()


@pytest.mark.parametrize("query", ["main loop", "loop", "The MAIN loop", "cafe", "loop main", '"run" twice', "café", "cafë"])
def test_bm25_agrees_with_sqlite(units, query, tmp_path):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(content, module_path, related_symbols, heading_hierarchy)")
    for r in units.orderBy("unit_seq").collect():
        db.execute("INSERT INTO f(rowid, content, module_path, related_symbols, heading_hierarchy) VALUES (?,?,?,?,?)", (r.unit_seq, r.content, r.module_path, " ".join(r.related_symbols), " ".join(r.heading_hierarchy)))
    want = db.execute("SELECT rowid, -rank FROM f WHERE f MATCH ? ORDER BY rank, rowid", ('"' + query.replace('"', '""') + '"',)).fetchall()
    for index in (IX.build(units), IX.build(units).save(str(tmp_path)) and IX.load(units.sparkSession, str(tmp_path))):
        got = IX.keyword_search(index, query).orderBy("rank").collect()
        assert [(f"u{i}", pytest.approx(s, abs=1e-9)) for i, s in want] == [(r.id, r.score) for r in got]


def test_keyword_filters_come_after_statistics(units):
    index = IX.build(units)
    whole = {r.id: r.score for r in IX.keyword_search(index, "main loop").collect()}
    part = {r.id: r.score for r in IX.keyword_search(index, "main loop", framework="fa").collect()}
    assert set(part) == {"u1", "u2", "u3"} and all(part[k] == pytest.approx(whole[k]) for k in part)
    assert IX.keyword_search(index, " .-$ ").count() == 0 and IX.keyword_search(index, "").count() == 0


def test_index_can_be_stored(units, tmp_path):
    saved = IX.build(units).save(str(tmp_path))
    loaded = IX.load(saved.units.sparkSession, str(tmp_path))
    assert IX.keyword_search(loaded, "main loop").orderBy("rank").first().id == "u5"


def _vectors(spark, units):
    rows = [("u1", [1.0, 0.0]), ("u2", [0.8, 0.6]), ("u3", [0.0, 1.0]), ("u4", [0.0, 0.0]), ("u5", [1.0, 0.0])]
    return spark.createDataFrame(rows, "id string, embedding array<float>").join(units.select("id", "framework", "type", "unit_seq"), "id")


def test_semantic_ties_zero_vectors_and_filters(spark, units):
    v = _vectors(spark, units)
    assert [r.id for r in SE.semantic_search(v, [1.0, 0.0]).orderBy("rank").collect()] == ["u1", "u5", "u2", "u3"]
    assert [r.id for r in SE.semantic_search(v, [1.0, 0.0], framework="fb").collect()] == ["u5"]


def test_hybrid_decay_and_bundle(spark, units):
    index, v = IX.build(units), _vectors(spark, units)
    got = SE.hybrid_search(index, v, "main loop", [0.0, 1.0], 4).orderBy("rank").collect()
    assert got[-1].id == "u3" or got[0].id != "u3"  # first by meaning, but an old release note
    assert len({r.id for r in got}) == len(got) <= 4 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    buckets = SE.bundle(index, v, "main loop", [1.0, 0.0], 1).collect()
    assert {r.type for r in buckets} >= {"api", "example"} and all(r.bucket_rank == 1 for r in buckets)
    for bad in (0, 51):
        with pytest.raises(ValueError, match="top_k"):
            SE.bundle(index, v, "x", [1.0, 0.0], bad)


def test_lookup(units):
    symbols = U.symbols(units)
    got = {(r.section, r.ord): r.id for r in SE.lookup(units, symbols, "WIDGET()").collect()}
    assert got[("match", 1)] == "u1" and got[("example", 1)] == "u2" and {v for (s, _), v in got.items() if s == "related"} == {"u4", "u5"}
    inside = {r.id for r in SE.lookup(units, symbols, "widget", framework="fa").where("section = 'related'").collect()}
    assert inside == {"u4"} and SE.lookup(units, symbols, "none").count() == 0


def test_browse(units):
    got = SE.browse_modules(units, U.symbols(units), "fa").orderBy("module_path").collect()
    assert [(r.module_path, r.n_units, r.symbols) for r in got] == [("fa.core", 3, ["run", "widget"]), ("fa.notes_x", 1, ["loop"])]
    assert {r.id for r in SE.browse_units(units, "fa", "NOTES_").collect()} == {"u3"} and SE.browse_units(units, "fa", "n_t").count() == 1


def test_smart(spark, units):
    args = (IX.build(units), units, U.symbols(units), _vectors(spark, units))
    assert "match" in {r.section for r in SE.smart(*args, "widget", [1.0, 0.0]).collect()}
    assert "match" not in {r.section for r in SE.smart(*args, "unknownword", [1.0, 0.0]).collect()}


def _health(spark, rows, symbols=(), system="sphinx"):
    units = spark.createDataFrame([("f", t, c, d) for t, c, d in rows], "framework string, type string, content string, relevance_decay double")
    sym = spark.createDataFrame([("s", "u", "f", i, 0) for i in symbols], schema.SYMBOLS)
    return HE.health(units, sym, spark.createDataFrame([("f", system)], "framework string, doc_system string")).first()


@pytest.mark.parametrize(
    ("rows", "symbols", "system", "score", "signal"),
    [
        ([(t, "x" * 500, 1.0) for t in ("api", "example", "concept", "pitfall")], [1], "sphinx", 100, "4/4 type diversity"),
        ([("concept", "x" * 200, 1.0)] * 10, [], "generic_md", 55, "no api or example units"),
        ([("api", "x" * 500, 1.0)] * 98 + [("example", "x" * 500, 1.0)] * 2, [1], "sphinx", 80, "98% units are api (mono-type)"),
        ([("api", "x" * 500, 1.0)] * 20 + [("example", "x" * 500, 1.0)], [1], "sphinx", 80, "95% units are api (mono-type)"),
        ([("api", "x" * 500, 1.0)] * 19 + [("example", "x" * 500, 1.0)], [1], "sphinx", 100, "parser: sphinx"),
        ([("api", "x" * 49, 1.0)] * 6 + [("example", "x" * 50, 1.0)] * 4, [1], "sphinx", 65, "60% stub units (<50 chars)"),
        ([("api", "{{x}}" + "y" * 400, 1.0)] * 5 + [("example", "x" * 400, 1.0)] * 5, [1], "sphinx", 85, "50% units have unresolved template placeholders"),
        ([("api", "x" * 400, 0.3)] * 6 + [("example", "x" * 400, 1.0)] * 4, [1], "sphinx", 90, "60% units are changelog/release notes"),
        ([("api", "x" * 400, 1.0), ("example", "x" * 400, 1.0)], [0] * 11, "sphinx", 80, "no definition sites for symbol lookup"),
        ([("api", "x" * 400, 1.0), ("example", "x" * 400, 1.0)], [0] * 10, "sphinx", 100, "parser: sphinx"),
    ],
)
def test_health(spark, rows, symbols, system, score, signal):
    got = _health(spark, rows, symbols, system)
    assert (got.score, signal in got.signals) == (score, True)


def test_health_of_unknown_and_gate(spark, units):
    wanted = spark.createDataFrame([("fa",), ("none",)], "framework string")
    got = {r.framework: r for r in HE.health(units, U.symbols(units), None, wanted).collect()}
    assert got["none"].score == 0 and got["none"].grade == "F" and got["none"].signals == ["no units ingested"]
    scores = spark.createDataFrame([("a", 79), ("b", 80), ("c", 10)], "framework string, score int")
    sources = spark.createDataFrame([("c", True)], "name string, health_exclude boolean")
    assert {r.framework: r.accepted for r in HE.gate(scores, sources).collect()} == {"a": False, "b": True, "c": True}
    assert all(r.accepted for r in HE.gate(scores, None, 0).collect())


def test_freshness(spark):
    v = "framework string, version_key string"
    got = HE.freshness(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", None)], v), spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", None), ("e", "1")], v))
    assert {r.framework: r.state for r in got.collect()} == {"a": "current", "b": "outdated", "c": "skipped", "d": "outdated", "e": "outdated"}


def test_detect_and_pre_detect(spark):
    rows = [("s", "a.rst", ".. autoclass:: A", "rst"), ("m", "a.md", "text\n!!! note\n    x", "markdown"), ("g", "a.md", "text", "markdown"), ("r", "a.html", '<body class="rustdoc">', "html"), ("t", "a.html", '<div class="tsd-x">', "html"), ("both", "a.md", "::: a.b", "markdown"), ("both", "b.md", ".. class:: A", "markdown")]
    got = {r.framework: r.doc_system for r in U.detect(spark.createDataFrame(rows, schema.RAW_DOCS)).collect()}
    assert got == {"s": "sphinx", "m": "mkdocs", "g": "generic_md", "r": "rustdoc", "t": "typedoc", "both": "sphinx"}


def test_columns(spark):
    one = spark.range(1).select(
        C.human_size(F.lit(1023)).alias("a"), C.human_size(F.lit(1536)).alias("b"), C.short_version(F.lit("")).alias("c"), C.short_version(F.lit("abcdef0123456789")).alias("d"), C.snippet(F.lit("\n  hello world  \nx"), 8).alias("e"),
        C.http_version(F.lit(None).cast("string"), F.lit("Tue")).alias("f"), C.url_to_filepath(F.lit("https://h/a/docs/x/?q=1"), "/docs").alias("g"), C.url_to_filepath(F.lit("https://h/")).alias("h"), C.percent(F.lit(0.125)).alias("i"),
        C.unit_id(F.lit("fw"), F.lit("a.md"), F.array(F.lit("A"), F.lit("B")), F.lit("x")).alias("j"), C.short_date(F.lit("2024-03-05 10:00:00").cast("timestamp")).alias("k"), C.human_size(F.lit(5 * 1024**4)).alias("l"),
    ).first()
    from siltstone.functions.documents import unit_id

    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g, one.h, one.i) == ("1023 B", "1.5 KB", "-", "abcdef012345", "hello w…", "mod:Tue", "x/?q=1.md", "index.md", "12%")
    assert one.j == unit_id("fw", "a.md", ["A", "B"], "x") and one.k == "03-05" and one.l == "5.0 TB"


def test_links(spark):
    html = """<a href="/a?x=1">1</a><a href='b/'>2</a><a HREF=../c>3</a><a href="#f">4</a><a href="mailto:x">5</a><a href="https://other/x">6</a><a href="//h.example/d.css">7</a><a href="//h.example/docs/e">8</a>"""
    pages = spark.createDataFrame([("https://h.example/docs/x", html)], "url string, html string")
    assert {r.link for r in website.links(pages).collect()} == {"https://h.example/a", "https://h.example/docs/b", "https://h.example/c", "https://h.example/docs/e"}
    assert {r.link for r in website.links(pages, "https://h.example/docs").collect()} == {"https://h.example/docs/b", "https://h.example/docs/e"}


def test_crawl_cap_and_sql(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (9, 8)], "page long, link long")
    start = spark.createDataFrame([(0,)], "url long")
    assert {(r.url, r.depth) for r in website.crawl(edges, start).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}
    assert {r.url for r in website.crawl(edges, start, max_pages=2).collect()} == {0, 1}
    edges.createOrReplaceTempView("crawl_edges")
    assert {(r.page, r.depth) for r in spark.sql(website.reachable_sql("crawl_edges", 0, 4)).collect()} == {(0, 0), (1, 1), (2, 1), (3, 2)}


def test_website_urls_and_versions(spark):
    sitemap = spark.createDataFrame([("s", '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> https://h/docs/a </loc></url><url><loc>https://h/b</loc></url></urlset>')], "framework string, content string")
    assert [r.url for r in website.sitemap_urls(sitemap, "/docs").collect()] == ["https://h/docs/a"]
    assert [r.url for r in website.resolve_urls(spark, {"urls": ["b", "a"]}, None, None).collect()] == ["a", "b"]
    assert [r.url for r in website.resolve_urls(spark, {"url": "https://h/x"}, None, None).collect()] == ["https://h/x"]
    assert website.is_site(5) and not website.is_site(4) and website.is_site(0, typedoc=True)


def test_llms(spark):
    got = [r.c for r in spark.createDataFrame([("https://h/docs/",), ("https://h",)], "u string").select(llms_txt.candidates(F.col("u")).alias("c")).collect()]
    assert got == [["https://h/docs/llms-full.txt", "https://h/docs/llms.txt", "https://h/llms-full.txt", "https://h/llms.txt"], ["https://h/llms-full.txt", "https://h/llms.txt"]]
    docs = spark.createDataFrame([("good", "l", "\n".join(f"# H{i}\n{'word ' * 60}" for i in range(12)), "markdown"), ("few", "l", "# H\nx", "markdown"), ("page", "l", "<!DOCTYPE html><html>", "markdown")], schema.RAW_DOCS)
    assert {r.framework: r.ok for r in llms_txt.good_enough(docs).collect()} == {"good": True, "few": False, "page": False}


def test_config(spark, tmp_path):
    app = config.app_config({"data_dir": "~/x", "sources": {"a": {"urls": '["u"]'}, "b": {"repo": "o/r"}, "c": {"urls": "broken"}}})
    assert not app["data_dir"].startswith("~") and app["sources"]["a"]["urls"] == ["u"] and app["sources"]["c"]["urls"] == [] and app["min_health_score"] == 80
    assert {r["name"]: r["kind"] for r in config.resolve(config.table(spark, app)).collect()} == {"a": "website", "b": "github", "c": "auto"}
    with pytest.raises(UnsupportedSource):
        reader("auto")
    assert github.remote_version('{"sha": "' + "a" * 40 + '"}', 200) == "a" * 12 and github.remote_version("", 403) is None


def test_local_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# A\nx")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.txt").write_text("no")
    got = local.read(spark, "fw", str(tmp_path)).collect()
    assert [(r.source_file, r.content_type) for r in got] == [("d/a.md", "markdown")]
    before = local.fingerprint(spark, str(tmp_path))
    (tmp_path / "e.md").write_text("new")
    assert len(before) == 12 and before != local.fingerprint(spark, str(tmp_path)) and len(local.fingerprint(spark, str(tmp_path / "d"))) == 12


def test_fetch_uses_the_cache(spark):
    urls = spark.createDataFrame([("f", u) for u in ("https://h/a", "https://h/b", "https://h/c")], "framework string, url string")
    cache = spark.createDataFrame([("f", "https://h/a", "e", "old")], schema.PAGE_CACHE)
    fetch = lambda url, etag: (304, etag, "") if etag else (200, "n", "new") if url.endswith("b") else (500, None, "x")
    docs, pages = website.fetch_pages(urls, cache, fetch, lambda t: t)
    assert {r.source_file: r.content for r in docs.collect()} == {"a.md": "old", "b.md": "new"} and pages.count() == 2


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([("fw", "a.md", "# A\ntext one\n## B\ntext two", "markdown"), ("fx", "a.md", "# A\ntext", "markdown")], schema.RAW_DOCS)
    store = ST.Store(spark, str(tmp_path))
    store.insert(U.ingest(docs))
    ids = [r.id for r in store.units().orderBy("framework", "unit_seq").collect()]
    assert len(ids) == 3 and [r.id for r in store.get(ids[2], "none", ids[0]).collect()] == [ids[2], ids[0]]
    store.insert(U.ingest(docs))  # the same again changes nothing
    assert store.units().count() == 3
    store.replace("fw", U.ingest(docs.where("framework = 'fw'").withColumn("content", F.lit("# A\nnew"))))
    assert sorted(r.content for r in store.units().collect()) == ["new", "text"]
    store.set_version("fw", "v1", "mkdocs")
    store.set_version("fw", "v2", "mkdocs")
    assert store.version("fw") == "v2" and store.version("no") is None and store.versions().count() == 1
    assert store.clear_framework("fw") == 1 and store.version("fw") is None and store.units().count() == 1
    store.clear_all()
    assert store.units().count() == 0 and ST.Store(spark, str(tmp_path)).units().count() == 0


def test_store_publishes_one_framework_at_a_time(spark, tmp_path):
    docs = lambda fw, *texts: spark.createDataFrame([(fw, f"{i}.md", f"# T\n{t}", "markdown") for i, t in enumerate(texts)], schema.RAW_DOCS)
    vectors = lambda u: u.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), "framework", "type", "unit_seq", "source_file")
    store = ST.Store(spark, str(tmp_path), kept=2)
    store.insert(U.ingest(docs("fa", "one", "two").unionByName(docs("fb", "three"))), vectors, ("v", "mkdocs"))
    before, other = store.units(), set(store.units("fb").inputFiles())
    store.replace("fa", U.ingest(docs("fa", "one")), vectors, ("w", "mkdocs"))
    ids = {r.id for r in store.units().collect()}
    assert len(ids) == 2 and {r.id for r in store.read("vectors").collect()} == ids  # the vector of a unit that is gone went with it
    assert {r.id for r in store.index().units.collect()} == ids and IX.keyword_search(store.index(), "two").count() == 0 and IX.keyword_search(store.index(), "one").count() == 1
    assert set(store.units("fb").inputFiles()) == other  # not written again
    assert before.count() == 3  # taken before, and still readable
    assert store.version("fa") == "w" and {r.framework: r.version_key for r in store.versions().collect()} == {"fa": "w", "fb": "v"}
    old = store.units("fa").inputFiles()[0].removeprefix("file://")
    for text in ("x", "y", "z"):
        store.replace("fa", U.ingest(docs("fa", text)))
    import os

    assert not os.path.exists(old) and set(store.units("fb").inputFiles()) == other and len(store._numbers()) == 2
    store.replace_files(U.ingest(docs("fa", "new", "more")), docs("fa", "new", "more"))
    assert sorted(r.content for r in store.units("fa").collect()) == ["more", "new"]


def test_equal_scores_are_ordered_by_place(spark):
    rows = spark.createDataFrame([("fw", f"{name}.md", "# T\nthe same words", "markdown") for name in "dbaec"], schema.RAW_DOCS)
    made = U.ingest(rows).repartition(3)
    files = {r.id: r.source_file for r in made.collect()}
    for index in (IX.build(made), IX.build(made).stored()):
        assert [files[r.id] for r in IX.keyword_search(index, "same words", 3).orderBy("rank").collect()] == ["a.md", "b.md", "c.md"]
    near = made.select("*", F.array(F.lit(1.0)).alias("embedding"))
    assert [files[r.id] for r in SE.semantic_search(near, [1.0], 3).orderBy("rank").collect()] == ["a.md", "b.md", "c.md"]


def test_batch_finds_whole_phrases(spark, units, tmp_path):
    asked = spark.createDataFrame([(1, ["the", "main", "loop"]), (2, ["main"]), (3, ["loop", "the"]), (4, []), (5, ["none", "main"]), (6, ["main", "loop", "of", "café", "the", "main"])], "qid long, words array<string>")
    asked = asked.unionByName(spark.createDataFrame([(7, ["main", "loop", "of", "cafe", "the", "main"]), (8, ["the", "the"])], "qid long, words array<string>"))
    got = {}
    for r in IX.keyword_batch(IX.build(units), asked, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    for qid, words in ((1, "the main loop"), (2, "main"), (7, "main loop of café the main")):
        assert got[qid] == [(r.id, pytest.approx(r.score)) for r in IX.keyword_search(IX.build(units), words).orderBy("rank").collect()]
    assert set(got) == {1, 2, 7}


def test_numbers_over_several_ranges(spark):
    from siltstone.operators.ranking import numbered

    rows = spark.range(1000).select((F.col("id") % 3).alias("s"), (F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    got = numbered(rows, "s", F.desc("x")).collect()
    for s in range(3):
        assert [r.x for r in sorted((r for r in got if r.s == s), key=lambda r: r.ord)] == sorted((r.x for r in got if r.s == s), reverse=True) and sorted(r.ord for r in got if r.s == s) == list(range(1, 1 + sum(r.s == s for r in got)))


def test_marks_are_folded(spark):
    words = {"hôtel": "hotel", "naïf": "naif", "NOËL": "noel", "Ångström": "angstrom", "čeština": "cestina", "łódź": "łodz", "Việt": "viet", "ñandú": "nandu", "plain": "plain", "straße": "straße"}
    got = {r.w: r.f for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", C.fold(F.col("w")).alias("f")).collect()}
    assert got == words


def test_registered_parser_and_extractor(spark):
    from siltstone.functions.documents import Section, Unit

    U.register_parser("lines", lambda text, path: [Section(line, 1, [line], line) for line in text.split("\n")])
    U.register_extractor("lines", lambda sections, fw, path, lang: [Unit(["concept"], fw, s.hierarchy, s.content.upper()) for s in sections])
    docs = spark.createDataFrame([("fw", "a", "x\ny", "markdown")], schema.RAW_DOCS)
    assert sorted(r.content for r in U.ingest(docs, "lines").collect()) == ["X", "Y"]


def test_library(spark, tmp_path):
    from siltstone.engine import Library, to_json

    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "01-a.md").write_text("# Alpha\n\nintro\n\n## `Widget`\n\n```python\nclass Widget:\n    pass\n```\n")
    lib = Library(spark, str(tmp_path / "lib"), config.app_config({"min_health_score": 0, "sources": {"fw": {"path": str(folder), "language": "python"}}}))
    assert lib.ingest()["fw"]["accepted"] and lib.search("class widget").count() >= 1 and lib.lookup("widget").first().section == "match"
    assert lib.browse("fw").count() == 1 and lib.stats().count() == 4 and lib.health().first().framework == "fw" and "fw" in to_json(lib.browse("fw", "a")).first().value
    assert lib.update(spark.createDataFrame([("fw", "other")], "framework string, version_key string")) == ["fw"]
    with pytest.raises(KeyError):
        lib.ingest("nope")
    with pytest.raises(ValueError, match="confirmed"):
        lib.nuke()
    assert lib.remove("fw") == 2
    strict = Library(spark, str(tmp_path / "lib2"), config.app_config({"min_health_score": 101, "sources": {"fw": {"path": str(folder)}}}))
    assert not strict.ingest()["fw"]["accepted"] and strict.store.units().count() == 0


def test_reporters():
    import io
    import json

    from siltstone.reporter import JsonReporter, PlainReporter, reporter

    out = io.StringIO()
    plain = PlainReporter(out)
    plain.update("a", "reading")
    plain.update("a", "done", units=3)
    assert out.getvalue() == "a: done units=3\n"
    out = io.StringIO()
    JsonReporter(out).update("a", "reading")
    assert json.loads(out.getvalue()) == {"source": "a", "phase": "reading"} and isinstance(reporter(True, out), JsonReporter)


def test_stream_gives_each_unit_once(spark, tmp_path):
    from siltstone.streaming.ingest import read_stream, start, units_stream

    docs = spark.createDataFrame([("fw", f"{i}.md", f"# A{i % 2}\nsame", "markdown") for i in range(4)], schema.RAW_DOCS).withColumn("arrived", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    for k in range(2):
        docs.write.parquet(str(tmp_path / f"in/{k}"))
    stream = units_stream(spark.readStream.schema(docs.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))
    q = stream.select("id").writeStream.format("memory").queryName("stream_units").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("stream_units").count() == 4
    store = ST.Store(spark, str(tmp_path / "store"))
    start(read_stream(spark, str(tmp_path / "in/0")), store, str(tmp_path / "c2")).awaitTermination()
    assert store.units().count() == 4
