from __future__ import annotations

from siltstone.functions import html as H


def test_markdown_tolerates_unclosed_tags():
    assert H.markdown_of(H.tree("<p>a <b>b<p>c<ul><li>1<li>2</ul><a href='/x'>l</a>")).count("* ") == 2
    assert H.markdown_of(H.tree("<pre>x = 1\n  y</pre>")) == "```\nx = 1\n  y\n```"
    assert H.html_to_markdown("") == "" and H.markdown_of(H.tree("<img src=a><script>x()</script>")) == ""


def test_page_is_trimmed():
    page = "<h1>Loading</h1><p>nav</p><h1>Title</h1><p>body</p><p>Was this helpful?</p><p>more</p>"
    assert H.html_to_markdown(page) == "# Title\n\nbody"


def test_selectors():
    root = H.tree("<div class='a b'><p id='x'><span class='c'>t</span></p></div><span class='c'>u</span>")
    assert [n.text() for n in root.select(".a .c")] == ["t"] and len(root.select("span.c, #x")) == 3 and root.first("div > p").attrs["id"] == "x" and root.first("div > span") is None


def test_rustdoc_item_module_and_method():
    page = '<body><section id="main-content"><div class="main-heading"><h1>Struct <a>net</a>::<a>Client</a><button>x</button></h1></div><pre class="rust">pub struct Client</pre><div class="docblock"><p>A client.</p></div><details class="method-toggle"><summary><section class="method"><h4 class="code-header">pub fn get(&amp;self)</h4></section></summary><div class="docblock">Gets.</div></details></section></body>'
    got = H.rustdoc_sections(page, "net/latest/net/struct.Client.html")
    assert got[0].hierarchy == ["net", "Client"] and got[0].content == "```rust\npub struct Client\n```\n\nA client." and got[1].hierarchy == ["net", "Client", "get"]
    listing = H.rustdoc_sections('<body><section id="main-content"><h1>Crate net</h1><div class="item-table"><div class="item-name"><a>Client</a></div><div class="desc">does</div></div></section></body>', "net/index.html")
    assert [(s.heading, s.content) for s in listing] == [("Client", "does")]
    assert H.rust_module("a\\latest\\a\\b\\fn.x.html") == "a::b" and H.rust_module("latest/all.html") == "unknown"


def test_typedoc_member_and_fallback():
    page = '<ul class="tsd-breadcrumb"><li>core</li></ul><div class="tsd-page-title"><h1>Class A</h1></div><section class="tsd-member-group"><h2>Methods</h2><section class="tsd-panel tsd-member"><h3>run<code class="tsd-tag">x</code></h3><div class="tsd-signature">run(): void</div></section></section>'
    assert [(s.heading, s.hierarchy) for s in H.typedoc_sections(page, "")] == [("A.run", ["core", "A", "run"])]
    assert H.typedoc_sections("<h1>Namespace n</h1>", "") == []
    assert len(H.typedoc_sections("<body><h1>Function f</h1><p>" + "word " * 20 + "</p></body>", "")) == 1
