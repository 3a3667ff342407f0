"""HTML with the standard library: a small tree, Markdown, and the generated reference formats."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import groupby, takewhile

from . import patterns as P
from .documents import Section

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIPPED = {"script", "style", "head", "template", "noscript", "title"}
#: An open one of these ends at the next of its kind.
CLOSES_ITSELF = {"p": {"p", "li", "dt", "dd"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "table", "details", "summary", "dl", "dt", "dd", "figure", "form", "fieldset", "body", "html", "tr"}


class Node:
    """An element; ``children`` holds elements and strings."""

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    @property
    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def matches(self, simple: str) -> bool:
        """A compound of tag, .class and #id."""
        for kind, name in re.findall(r"([.#]?)([\w-]+)", simple):
            if kind == "." and name not in self.classes or kind == "#" and self.attrs.get("id") != name or not kind and self.tag != name:
                return False
        return True

    def select(self, selectors: str) -> list[Node]:
        """Elements below that match any of the comma-separated descendant selectors, in document order."""
        chains = [s.replace(">", " > ").split() for s in selectors.split(",")]
        return [n for n in self.walk() if any(n._fits(c) for c in chains)]

    def _fits(self, chain: list[str]) -> bool:
        if not self.matches(chain[-1]):
            return False
        rest, node = chain[:-1], self.parent
        while rest:
            direct = rest[-1] == ">"
            want = rest[-2] if direct else rest[-1]
            while node is not None and not node.matches(want):
                if direct:
                    return False
                node = node.parent
            if node is None:
                return False
            rest, node = rest[: -2 if direct else -1], node.parent
        return True

    def first(self, selectors: str) -> Node | None:
        return next(iter(self.select(selectors)), None)

    def remove(self) -> None:
        if self.parent is not None and self in self.parent.children:
            self.parent.children.remove(self)

    def strings(self) -> Iterator[str]:
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))

    def text(self, between: str = "") -> str:
        """Stripped strings, joined."""
        return between.join(s.strip() for s in self.strings() if s.strip())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag, attrs):
        closing = CLOSES_ITSELF.get(tag, set())
        node = self.at
        while node.parent is not None and node.tag not in ("ul", "ol", "table", "dl", "div", "section", "body"):
            if node.tag in closing:
                self.at = node.parent
                break
            node = node.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # else: an end without a start
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def markdown_of(node: Node | None, links: bool = True) -> str:
    """Headings, lists, emphasis, code and links as Markdown; images are dropped, lines are not wrapped."""
    if node is None:
        return ""
    out: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if callable(x):
            x()
        elif isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
        elif x.tag not in SKIPPED:
            before, after = _around(x, links)
            if x.tag == "pre":
                out += ["\n\n```\n", "".join(x.strings()).strip("\n"), "\n```\n\n"]
                continue
            out.append(before)
            stack.append((lambda s: lambda: out.append(s))(after))
            stack.extend(reversed(x.children))
    lines, fenced = [], False
    for line in "".join(out).split("\n"):
        fenced ^= line.startswith("```")
        lines.append(line.rstrip() if fenced else line.strip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _around(x: Node, links: bool) -> tuple[str, str]:
    if m := re.fullmatch(r"h([1-6])", x.tag):
        return f"\n\n{'#' * int(m[1])} ", "\n\n"
    if x.tag == "li":
        ordered = x.parent is not None and x.parent.tag == "ol"
        number = 1 + sum(1 for c in x.parent.children[: x.parent.children.index(x)] if isinstance(c, Node) and c.tag == "li") if ordered else 0
        return (f"\n{number}. " if ordered else "\n* "), "\n"
    if x.tag in ("strong", "b"):
        return "**", "**"
    if x.tag in ("em", "i"):
        return "_", "_"
    if x.tag in ("code", "tt"):
        return "`", "`"
    if x.tag == "a" and links and x.attrs.get("href"):
        return "[", f"]({x.attrs['href']})"
    if x.tag == "br":
        return "  \n", ""
    if x.tag == "hr":
        return "\n\n* * *\n\n", ""
    if x.tag == "blockquote":
        return "\n\n> ", "\n\n"
    if x.tag in ("td", "th"):
        return "", " | "
    return ("\n\n", "\n\n") if x.tag in BLOCKS else ("", "")


def html_to_markdown(html: str) -> str:
    """A page as Markdown, from its first level-one heading (but no "Loading" one) to the last footer line."""
    lines = markdown_of(tree(html)).split("\n")
    start = next((k for k, line in enumerate(lines) if line.startswith("# ") and "Loading" not in line), 0)
    end = next((k for k in range(len(lines) - 1, start, -1) if any(w in lines[k].strip().lower() for w in P.FOOTER_WORDS)), len(lines))
    return "\n".join(lines[start:end]).strip()


def rust_module(source_file: str) -> str:
    """The module of an item's file: the folders above it, each once where the same name follows itself."""
    steps = re.sub(r"\.html$", "", source_file.replace("\\", "/")).split("/")
    above = takewhile(lambda step: not re.match(P.RUST_ITEM, step), steps)
    return "::".join(name for name, _ in groupby(step for step in above if step not in ("latest", "all", "index"))) or "unknown"


class Parts:
    """The nodes of a page by role.  A node below a member counts for that member and for the page (None)."""

    def __init__(self, root: Node, roles: dict[str, str]):
        self.members: list[Node] = []
        self._found: dict[tuple[int | None, str], list[Node]] = {}
        by_role = [(role, [s.replace(">", " > ").split() for s in selectors.split(",")]) for role, selectors in roles.items()]
        stack: list[tuple[Node, tuple[Node, ...]]] = [(c, ()) for c in reversed(root.children) if isinstance(c, Node)]
        while stack:
            node, inside = stack.pop()
            own = [role for role, chains in by_role if any(node._fits(chain) for chain in chains)]
            for role in own:
                for owner in (None, *inside):
                    self._found.setdefault((owner and id(owner), role), []).append(node)
            if "member" in own:
                self.members.append(node)
                inside = (*inside, node)
            stack.extend((c, inside) for c in reversed(node.children) if isinstance(c, Node))

    def all(self, role: str, owner: Node | None = None) -> list[Node]:
        return self._found.get((owner and id(owner), role), [])

    def one(self, role: str, owner: Node | None = None) -> Node | None:
        return next(iter(self.all(role, owner)), None)


#: How a node of a role is written; the language is that of the format.
Writer = Callable[[Node, str], str]


def _prose(node: Node, language: str) -> str:
    return markdown_of(node, links=False)


def _code(node: Node, language: str) -> str:
    return f"```{language}\n{text}\n```" if (text := node.text()) else ""


def _spaced_code(node: Node, language: str) -> str:
    return f"```{language}\n{text}\n```" if (text := node.text(" ")) else ""


def _returned(node: Node, language: str) -> str:
    return f"**Returns:** {node.text()}"


@dataclass(frozen=True)
class Format:
    """Where the pages of a generated reference keep what.  Selectors, words and limits are fixed values.

    ``body`` and ``member`` tell what a section is made of, in order: the role, whether only its first node counts, how it
    is written, and a role without which it does not count."""

    language: str
    title: str
    spacing: str
    noise: str
    scope: tuple[str, ...]
    roles: dict[str, str]
    body: tuple[tuple[str, bool, Writer, str], ...]
    member: tuple[tuple[str, bool, Writer, str], ...]
    heading: str
    least: int = 0

    def text(self, parts: Parts, pieces: tuple[tuple[str, bool, Writer, str], ...], owner: Node | None = None) -> str:
        written = (write(node, self.language) for role, single, write, needs in pieces if not needs or parts.one(needs, owner) for node in parts.all(role, owner)[: 1 if single else None])
        return "\n\n".join(w for w in written if w).strip()


RUSTDOC = Format(
    language="rust",
    title=r"(?i)^(Struct|Enum|Trait|Function|Type\s+Alias|Constant|Macro|Module)\s+(.+)",
    spacing=" ",
    noise="button, .copy-path, .src-content, .sidebar, nav, .sub-heading, .out-of-band, .anchor, .toggle-wrapper summary, .notable-traits",
    scope=("#main-content", ".main-heading", "body"),
    roles={
        "head": ".main-heading h1, h1.fqn, h1", "signature": "pre.rust, .item-decl pre", "text": ".docblock", "member": "details.method-toggle, section.method, section.tymethod",
        "line": "h4.code-header, h3.code-header, .method-signature", "summary": "summary h4, summary h3", "entry": ".item-table .item-name, .item-row", "gloss": ".desc",
    },
    body=(("signature", True, _code, ""), ("text", True, _prose, "")),
    member=(("text", True, _prose, ""),),
    heading="fn {name}::{called}",
)
TYPEDOC = Format(
    language="typescript",
    title=r"^(Class|Interface|Enumeration|Type [Aa]lias|Namespace|Function|Variable)\s+(.+)",
    spacing="",
    noise="nav, .tsd-breadcrumb, footer, .tsd-sources, .tsd-generator, h3 code.tsd-tag",
    scope=(),
    roles={
        "head": ".tsd-page-title h1, h1", "hierarchy": ".tsd-panel.tsd-hierarchy", "top": ".tsd-panel > .tsd-comment", "member": ".tsd-member-group section.tsd-member, .tsd-member-group .tsd-panel.tsd-member",
        "line": "h3.tsd-anchor-link, h3", "signature": ".tsd-signature", "text": ".tsd-comment", "has_parameters": ".tsd-parameters-title", "parameters": "ul.tsd-parameter-list", "returns": "h4.tsd-returns-title",
    },
    body=(("hierarchy", True, _prose, ""), ("top", True, _prose, "")),
    member=(("signature", False, _spaced_code, ""), ("text", False, _prose, ""), ("parameters", True, _prose, "has_parameters"), ("returns", True, _returned, "")),
    heading="{name}.{called}",
    least=10,
)


def _page(html: str, fmt: Format) -> tuple[Node, Node | None, Parts, tuple[str, str] | None]:
    """The tree, the part of it that is read, its nodes by role, and the kind and name that the title says."""
    root = tree(html)
    for node in root.select(fmt.noise):
        node.remove()
    scope = next((found for s in fmt.scope if (found := root.first(s))), None) if fmt.scope else root
    head = root.first(fmt.roles["head"])
    said = re.match(fmt.title, head.text(fmt.spacing)) if head else None
    return root, scope, Parts(scope or root, fmt.roles), (said[1].lower().split()[0], said[2].strip()) if said else None


def _listed(parts: Node, module: str) -> list[Section]:
    """What a module's page lists: each entry's link, and the gloss that comes before the next entry."""
    out: list[Section] = []
    for node in parts.walk():
        if any(node._fits(s.split()) for s in RUSTDOC.roles["entry"].split(",")) and (link := node.first("a")) and (label := link.text()):
            if not out or out[-1].heading != label:
                out.append(Section(label, 2, [module, label], ""))
        elif out and not out[-1].content and node.matches(RUSTDOC.roles["gloss"]):
            out[-1].content = node.text()
    return out


def _called(line: Node) -> str:
    """The name in a method's line: behind ``fn``, else before the first bracket."""
    text = line.text(" ")
    name = next((m[1] for pattern in (r"\bfn\s+(\w+)", r"^[^(]*?(\S+)\s*\(") if (m := re.search(pattern, text))), "")
    return name if name.isidentifier() else ""


def rustdoc_sections(html: str, source_file: str) -> list[Section]:
    """An item's page: the item and its methods; a module's page: what it lists."""
    _, scope, parts, title = _page(html, RUSTDOC)
    module = rust_module(source_file)
    if scope is None:
        return []
    name = re.split(r"\s*::\s*", title[1])[-1].strip(" :") if title else ""
    if not name:
        return _listed(scope, module)
    content = RUSTDOC.text(parts, RUSTDOC.body)
    out = [Section(f"{title[0]} {name}", 1, [module, name], content)] if content else []
    for member in parts.members:
        line = parts.one("line", member) or parts.one("summary", member)
        if line is not None and (called := _called(line)):
            text = "\n\n".join(x for x in (_spaced_code(line, RUSTDOC.language), RUSTDOC.text(parts, RUSTDOC.member, member)) if x)
            out.append(Section(RUSTDOC.heading.format(name=name, called=called), 2, [module, name, called], text))
    return out


def typedoc_sections(html: str, source_file: str) -> list[Section]:
    """A class's or function's page: its description and its members; lists of links give nothing."""
    crumbs = [text for crumb in tree(html).select(".tsd-breadcrumb li") if (text := crumb.text())]
    root, _, parts, title = _page(html, TYPEDOC)
    if title is None or title[0] in ("namespace", "module"):
        return []
    kind, name = title
    path = [".".join(crumbs) or name, name]
    out = [Section(f"{kind} {name}", 1, path, TYPEDOC.text(parts, TYPEDOC.body))] if parts.one("hierarchy") or parts.one("top") else []
    for member in parts.members:
        line, content = parts.one("line", member), TYPEDOC.text(parts, TYPEDOC.member, member)
        if line is not None and (called := line.text().strip()) and len(content) >= TYPEDOC.least:
            out.append(Section(TYPEDOC.heading.format(name=name, called=called), 2, [*path, called], content))
    if out:
        return out
    whole = markdown_of(root.first("#tsd-content, .container-main-content") or root.first("body"))
    return [Section(f"{kind} {name}", 1, path, whole[: P.MAX_UNIT_CHARS])] if len(whole) > 30 else []
