"""Sources against a server and a repository of this machine."""

from __future__ import annotations

import io
import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siltstone import sources
from siltstone.cli import main
from siltstone.engine import Library
from siltstone.service import Service, answer, server
from siltstone.sources import UnsupportedSource, config, github, llms_txt, website
from siltstone.sources.http import http_fetch


class Site:
    """A site whose pages, marks and log a test can change."""

    def __init__(self):
        self.pages: dict[str, str] = {}
        self.status: dict[str, int] = {}
        self.etags, self.log = True, []
        site = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self, body: bool) -> None:
                site.log.append((self.command, self.path))
                text = site.pages.get(self.path)
                status = site.status.get(self.path, 404 if text is None else 200)
                data = (text or "").encode()
                etag = f'"{abs(hash(text))}"' if site.etags and status == 200 else None
                if etag and self.headers.get("If-None-Match") == etag:
                    status, data = 304, b""
                self.send_response(status)
                if etag:
                    self.send_header("ETag", etag)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                if body and status == 200:
                    self.wfile.write(data)

            def do_GET(self):
                self._answer(True)

            def do_HEAD(self):
                self._answer(False)

            def log_message(self, *args):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = "http://127.0.0.1:{}".format(self.server.server_address[1])
        threading.Thread(target=self.server.serve_forever, daemon=True).start()


@pytest.fixture
def site():
    out = Site()
    yield out
    out.server.shutdown()
    out.server.server_close()


def entry(**fields):
    return config.source("fw", fields)


#: A lambda, as workers can't import this module.
quick = lambda url, etag=None, method="GET": http_fetch(url, etag, method, timeout=3.0, waits=(0,))


LONG = "\n".join(f"# H{i}\n{'word ' * 60}" for i in range(12))


def test_probing_order(spark, site):
    with pytest.raises(UnsupportedSource):
        sources.resolve(spark, entry(url=f"{site.url}/docs"), quick)
    site.pages["/sitemap.xml"] = "<urlset/>"
    kind, found = sources.resolve(spark, entry(url=f"{site.url}/docs"), quick)
    assert kind == "website" and found["sitemap"] == f"{site.url}/sitemap.xml"
    site.pages["/docs"] = "".join(f'<a href="/docs/p{i}">x</a>' for i in range(5))
    kind, found = sources.resolve(spark, entry(url=f"{site.url}/docs"), quick)
    assert kind == "website" and found["url"] == f"{site.url}/docs/*"
    site.pages["/docs/llms.txt"] = "# too little\nx"
    site.pages["/llms.txt"] = LONG
    kind, found = sources.resolve(spark, entry(url=f"{site.url}/docs"), quick)
    assert kind == "llms_txt" and found["url"] == f"{site.url}/llms.txt"
    site.pages["/docs/llms-full.txt"] = "<!DOCTYPE html>" + LONG
    assert sources.resolve(spark, entry(url=f"{site.url}/docs"), quick)[1]["url"] == f"{site.url}/llms.txt"
    kind, found = sources.resolve(spark, entry(url="https://github.com/o/r/tree/v2/site/docs/"), quick)
    assert (kind, found["repo"], found["branch"], found["docs_path"]) == ("github", "o/r", "v2", "site/docs")
    assert sources.resolve(spark, entry(repo="o/r"), quick)[1]["docs_path"] == "docs"


def test_typedoc_start_page_is_a_site(spark, site):
    site.pages["/api"] = '<div class="tsd-page-title"><h1>x</h1></div>'
    assert sources.resolve(spark, entry(url=f"{site.url}/api"), quick)[1]["url"] == f"{site.url}/api/*"


def test_llms_txt_version(spark, site):
    site.pages["/llms.txt"] = LONG
    source = entry(url=f"{site.url}/llms.txt", type="llms_txt")
    docs, version = llms_txt.read(spark, source, quick)
    assert docs.first()["content"] == LONG and version.startswith('etag:"') and version == llms_txt.check_version(spark, source, quick)
    site.etags = False
    plain = llms_txt.read(spark, source, quick)[1]
    assert len(plain) == 12 and plain == llms_txt.check_version(spark, source, quick)
    with pytest.raises(OSError, match="can't be read"):
        llms_txt.read(spark, source | {"url": f"{site.url}/none"}, quick)
    assert llms_txt.check_version(spark, source | {"url": f"{site.url}/none"}, quick) is None


def test_crawl_fetches_each_page_once_and_uses_the_cache(spark, site, tmp_path):
    page = lambda n, *links: f"<h1>Page {n}</h1><p>{'text ' * 30}</p>" + "".join(f'<a href="{x}">l</a>' for x in links)
    site.pages |= {"/d": page(0, "/d/a", "/d/b", "/other", "/d/x.css"), "/d/a": page(1, "/d/b", "/d/c#s"), "/d/b": page(2, "/d"), "/d/c": page(3, "/d/gone"), "/other": page(9)}
    lib = Library(spark, str(tmp_path / "lib"), config.app_config({"min_health_score": 0, "sources": {"fw": {"url": f"{site.url}/d/*", "url_filter": "/d"}}}), fetch=quick)
    first = lib.ingest()["fw"]
    gets = sorted(p for m, p in site.log if m == "GET")
    assert gets == ["/d", "/d/a", "/d/b", "/d/c", "/d/gone"] and first["accepted"]
    assert {r.source_file for r in lib.store.units().select("source_file").distinct().collect()} == {"index.md", "a.md", "b.md", "c.md"}
    assert lib.store.read("pages", "fw").count() == 4
    assert lib.remote().first().version_key == first["version"] and lib.update() == []
    before = lib.store.units()
    assert before.count() == 4
    site.pages["/d/c"] = page("3, changed", "/d/gone", "/d/new")
    site.pages["/d/new"] = page(4)
    site.log.clear()
    assert lib.update() == ["fw"]
    assert any("changed" in r.heading_hierarchy[0] for r in lib.store.units().collect()) and lib.store.units().count() == 5
    assert before.count() == 4  # what was read before is still there
    assert http_fetch(f"{site.url}/d/a", next(r.etag for r in lib.store.read("pages", "fw").collect() if r.url.endswith("/d/a"))).status == 304


def test_crawl_has_its_limit(spark, site):
    for k in range(12):
        site.pages[f"/d/{k}"] = f'<a href="/d/{k + 1}">n</a><a href="/d/{k + 2}">n</a>'
    site.pages["/d"] = '<a href="/d/0">n</a>'
    none = spark.createDataFrame([], "framework string, url string, etag string, body string")
    assert website.crawl_pages(f"{site.url}/d", "fw", none, quick, max_pages=6).count() == 6


def test_sitemap_source_and_version(spark, site):
    site.pages["/sitemap.xml"] = f'<urlset xmlns="x"><url><loc>{site.url}/d/a</loc></url><url><loc>{site.url}/e</loc></url></urlset>'
    site.pages["/d/a"] = "<h1>A</h1><p>body</p>"
    kind, found = sources.resolve(spark, entry(sitemap=f"{site.url}/sitemap.xml", url_filter="/d"), quick)
    docs, version, pages = sources.read(spark, kind, found, quick)
    assert [(r.source_file, r.content) for r in docs.collect()] == [("a.md", "# A\n\nbody")] and pages.count() == 1
    assert sources.remote_versions(spark, {"fw": found}, quick).first().version_key == version
    site.pages["/sitemap.xml"] = "<urlset/>"
    assert sources.remote_versions(spark, {"fw": found}, quick).first().version_key != version
    assert website.discover_sitemap(f"{site.url}/d", quick) == f"{site.url}/sitemap.xml"


def test_busy_server_is_asked_again(site):
    site.pages["/x"], site.status["/x"] = "late", 503
    assert http_fetch(f"{site.url}/x", waits=(0, 0)).status == 503 and len(site.log) == 2
    del site.status["/x"]
    assert http_fetch(f"{site.url}/x").body == "late" and http_fetch("http://127.0.0.1:1/x", waits=(0,)) is None and http_fetch("no address", waits=(0,)) is None


@pytest.fixture
def repository(tmp_path, monkeypatch):
    """o/r on a branch master: docs, another folder, and a file that is no text."""
    root = tmp_path / "hub"
    work = root / "o/r"
    (work / "docs/deep").mkdir(parents=True)
    (work / "site").mkdir()
    (work / "docs/a.md").write_text("# A\n\ntext of a\n")
    (work / "docs/deep/b.md").write_text("# B\n\ntext of b\n")
    (work / "docs/bad.md").write_bytes(b"\xff\xfe")
    (work / "docs/c.txt").write_text("no")
    (work / "site/s.md").write_text("# S\n\nsite\n")
    (work / "README.md").write_text("# R\n\nroot\n")

    def git(*args):
        return subprocess.run(["git", "-C", str(work), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q", "-b", "master")
    git("add", "-A")
    git("commit", "-q", "-m", "one")
    monkeypatch.setattr(github, "ROOT", f"file://{root}")
    return work, git


def test_repository_from_an_address_and_again(spark, repository, tmp_path):
    work, git = repository
    settings = config.app_config({"min_health_score": 0, "sources": {"fw": {"url": "https://github.com/o/r"}}})
    head = lambda: git("rev-parse", "HEAD")

    def api(url, etag=None, method="GET"):
        return (200, None, json.dumps({"sha": head()})) if url.endswith("/commits/master") else (404, None, "")

    lib = Library(spark, str(tmp_path / "lib"), settings, fetch=api)
    got = lib.ingest()["fw"]
    assert got["version"] == head()[:12] and sorted(r.source_file for r in lib.store.units().collect()) == ["docs/a.md", "docs/deep/b.md"]
    assert lib.update() == []
    (work / "docs/a.md").write_text("# A\n\nnew text\n")
    git("commit", "-q", "-a", "-m", "two")
    assert lib.update() == ["fw"] and "new text" in {r.content for r in lib.store.units().collect()} and lib.store.units().count() == 2
    docs, _ = github.read(spark, entry(url="https://github.com/o/r/tree/master/site"))
    assert [r.source_file for r in docs.collect()] == ["site/s.md"]
    with pytest.raises(OSError, match="cloned"):
        github.read(spark, entry(repo="o/none"))
    assert github.check_version(entry(repo="o/r"), lambda url: (403, None, "")) is None and github.check_version(entry(repo="o/r"), lambda url: None) is None


@pytest.fixture
def library(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Alpha\n\nintro to the hôtel\n\n## `Widget`\n\n```python\nclass Widget:\n    pass\n```\n")
    (folder / "b.md").write_text("# Beta\n\nhow to use a `Widget`, step by step\n")
    path = tmp_path / "config.json"
    path.write_text(json.dumps({"data_dir": str(tmp_path / "data"), "min_health_score": 0, "sources": {"fw": {"path": str(folder), "language": "python"}}}))
    return path, lambda settings: Library(spark, settings["data_dir"], settings)


def test_command_line(library, tmp_path):
    path, make = library

    def call(*argv):
        out = io.StringIO()
        return main([*argv, "--config", str(path)], make, out), out.getvalue()

    assert json.loads(call("ingest")[1])["fw"]["accepted"]
    assert json.loads(call("Widget")[1])["match"]["heading_hierarchy"] == ["Alpha", "`Widget`"]
    assert set(json.loads(call("step", "by", "step", "-k", "2")[1])) == {"api", "example", "concept", "pitfall"}
    assert [u["source_file"] for u in json.loads(call("search", "hotel", "-k", "1")[1])] == ["a.md"]
    assert json.loads(call("lookup", "widget", "--no-related")[1])["related"] == []
    code, text = call("lookup", "nothing")
    assert code == 1 and json.loads(text)["error"] == "NotFound"
    code, text = call("lookup", "nothing", "--pretty")
    assert code == 1 and text.startswith("NotFound: ")
    assert [m["name"] for m in json.loads(call("browse", "fw")[1])["modules"]] == ["fw.a", "fw.b"] and "[concept] fw Beta" in call("browse", "fw", "-m", "b", "--pretty")[1]
    assert json.loads(call("frameworks")[1]) == ["fw"] and json.loads(call("status")[1])[0]["state"] == "current" and json.loads(call("status", "--no-check")[1])[0]["state"] == "unknown"
    assert {r["table"] for r in json.loads(call("usage")[1])} >= {"units", "vectors", "postings"} and all(r["bytes"] > 0 for r in json.loads(call("usage")[1]))
    assert json.loads(call("update")[1]) == {"updated": []} and call("ingest", "-f", "nope")[0] == 1 and call("nuke")[0] == 1
    assert json.loads(call("remove", "fw")[1])["removed"] == 3 and json.loads(call("stats")[1]) == []
    assert json.loads(call("nuke", "--yes")[1]) == {"state": "empty"}
    fresh = tmp_path / "new/config.json"
    out = io.StringIO()
    assert main(["init", "--config", str(fresh)], make, out) == 0 and config.load(str(fresh))["sources"]
    assert main(["init", "--config", str(fresh)], make, out) == 0 and '"kept"' in out.getvalue()
    assert main(["stats", "--config", str(tmp_path / "none.json")], make, out) == 1


def test_service_over_http(library):
    path, make = library
    lib = make(config.load(str(path)))
    lib.ingest()
    service = Service(lib)
    running = server(service)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    get = lambda address: http_fetch("http://127.0.0.1:{}{}".format(running.server_address[1], address), waits=(0,), timeout=60)
    try:
        assert json.loads(get("/lookup/Widget%28%29").body)["match"]["framework"] == "fw" and get("/lookup/none").status == 404
        assert len(json.loads(get("/search?q=widget&top_k=2").body)) == 2
    finally:
        running.shutdown()
        running.server_close()
    assert answer(service, "/search?q=x&top_k=0")[0] == 422 and answer(service, "/search?q=x&top_k=101")[0] == 422 and answer(service, "/bundle?q=x&top_k=51")[0] == 422
    assert answer(service, "/search")[0] == 422 and answer(service, "/search?q=x&top_k=a")[0] == 422 and answer(service, "/search?q=x&type=z")[0] == 422
    assert answer(service, "/nothing")[0] == 404 and answer(service, "/lookup")[0] == 404 and answer(service, "/browse?framework=fw&module=b")[1]["units"][0]["source_file"] == "b.md"
    assert answer(service, "/lookup/widget?include_examples=maybe")[0] == 422 and answer(service, "/frameworks") == (200, ["fw"])
