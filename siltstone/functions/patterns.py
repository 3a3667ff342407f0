r"""Patterns and word lists of the documentation formats.

Fixed values: results depend on each of them, so they are kept together and as they are used.
All are in the dialect that Python and RE2 share; ``(?m)`` and ``(?s)`` stand inside, so any engine can read them.
"""

from __future__ import annotations

# --- headings and front matter
HEADING = r"(?m)^(#{1,6})\s+(.+?)(?:\s+\{.*\})?\s*$"
FRONT_MATTER = r"(?s)\A---\s*\n.*?\n---\s*\n"
RST_HEADING = r"""(?m)^(?P<overline>[=\-~^"'`]+\n)?(?P<title>[^\n]+)\n(?P<underline>[=\-~^"'`]+)$"""

# --- symbols by language: one group matches in each alternative
_MOD = r"(?:public\s+|private\s+|protected\s+)?"
_CS = r"(?:public\s+|private\s+|protected\s+|internal\s+)?"
PYTHON = r"(?m)(?:^|\n)\s*(?:async\s+)?def\s+(\w+)\s*\(|(?:^|\n)\s*class\s+(\w+)[\s(:]|(?:^|\n)\s*@(\w+)"
RUST = r"(?m)(?:^|\n)\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]|(?:^|\n)\s*(?:pub\s+)?struct\s+(\w+)|(?:^|\n)\s*(?:pub\s+)?trait\s+(\w+)|(?:^|\n)\s*(?:pub\s+)?enum\s+(\w+)|(?:^|\n)\s*impl(?:<[^>]*>)?\s+(\w+)"
JS = r"(?m)(?:^|\n)\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*[<(]|(?:^|\n)\s*(?:export\s+)?class\s+(\w+)[\s{<]|(?:^|\n)\s*(?:export\s+)?interface\s+(\w+)[\s{<]|(?:^|\n)\s*(?:export\s+)?type\s+(\w+)\s*[<=]|(?:^|\n)\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=|(?:^|\n)\s*(?:export\s+)?enum\s+(\w+)"
GO = r"(?m)(?:^|\n)\s*func\s+(?:\([^)]*\)\s+)?(\w+)\s*[<(\[]|(?:^|\n)\s*type\s+(\w+)\s+(?:struct|interface|func)|(?:^|\n)\s*(?:var|const)\s+(\w+)\s"
C = (
    r"(?m)(?:^|\n)\s*(?:static\s+|inline\s+|extern\s+|virtual\s+)*(?:unsigned\s+|signed\s+|const\s+)*(?:\w+[\s*&]+)+(\w+)\s*\(|(?:^|\n)\s*(?:typedef\s+)?struct\s+(\w+)|(?:^|\n)\s*(?:typedef\s+)?enum\s+(\w+)|(?:^|\n)\s*(?:typedef\s+)?union\s+(\w+)"
    r"|(?:^|\n)\s*class\s+(\w+)[\s:{]|(?:^|\n)\s*namespace\s+(\w+)|(?:^|\n)\s*template\s*<[^>]*>\s*class\s+(\w+)|(?:^|\n)\s*#define\s+(\w+)"
)
JAVA = rf"(?m)(?:^|\n)\s*{_MOD}(?:static\s+)?(?:abstract\s+)?(?:final\s+)?class\s+(\w+)|(?:^|\n)\s*{_MOD}interface\s+(\w+)|(?:^|\n)\s*{_MOD}enum\s+(\w+)|(?:^|\n)\s*{_MOD}(?:static\s+)?(?:abstract\s+)?(?:final\s+)?(?:synchronized\s+)?(?:\w+(?:<[^>]*>)?[\s*&]*\s+)(\w+)\s*\(|(?:^|\n)\s*@(\w+)"
CSHARP = (
    rf"(?m)(?:^|\n)\s*{_CS}(?:static\s+)?(?:abstract\s+)?(?:sealed\s+)?(?:partial\s+)?class\s+(\w+)|(?:^|\n)\s*{_CS}interface\s+(\w+)|(?:^|\n)\s*{_CS}enum\s+(\w+)|(?:^|\n)\s*{_CS}struct\s+(\w+)|(?:^|\n)\s*{_CS}delegate\s+\w+\s+(\w+)"
    rf"|(?:^|\n)\s*{_CS}(?:static\s+)?(?:async\s+)?(?:virtual\s+)?(?:override\s+)?(?:\w+(?:<[^>]*>)?[\s*&]*\s+)(\w+)\s*\(|(?:^|\n)\s*\[(\w+)"
)
LANGUAGES = {"python": PYTHON, "rust": RUST, "javascript": JS, "typescript": JS, "js": JS, "ts": JS, "go": GO, "golang": GO, "c": C, "cpp": C, "c++": C, "java": JAVA, "csharp": CSHARP, "c#": CSHARP}

# --- directives
AUTODOC = r"(?m)\.\.\s+(?:auto(?:class|function|method|attribute|data|exception)|(?:py:)?(?:function|class|method|attribute|data|exception|decorator))::\s+([~]?[\w.]+)"
AUTODOC_QUALIFIED = r"(?m)\.\.\s+(?:auto(?:class|function|method|attribute|data|exception)|(?:py:)?(?:function|class|method|attribute|data|exception|decorator))::\s+([\w.]+)"
AUTODOC_SPLIT = r"(?m)^\.\.\s+(auto(?:class|function|method|attribute|module|data|exception)|(?:py:)?(?:function|class|method|attribute|data|exception|decorator|module))::\s+([~]?[\w.]+)"
MKDOCSTRINGS = r"(?m)^:::\s+([\w.]+)"
INLINE_CODE = r"`(\$?\w+)`"

# --- classification
RST_API = r"\.\.\s+(?:auto(?:class|function|method|attribute|module|data|exception)|(?:py:)?(?:function|class|method|attribute|data|exception|decorator|module)|(?:js|rb|c|cpp):(?:function|class|method|attribute|data))::"
RST_PITFALL = r"\.\.\s+(?:warning|danger|deprecated|caution)::"
MKDOCS_PITFALL = r"(?mi)^!!!?\s+(?:warning|danger|caution|failure)\b"
MKDOCS_EXAMPLE = r"(?mi)^!!!?\s+(?:example|quote)\b"
BLOCKS_PITFALL = r"(?mi)^///\s+(?:warning|danger|caution)\b"
API_HEADING = r"(?i)\b(?:API\s+Reference|Parameters|Returns?|Raises?|Attributes?|Signature|Arguments?)\b"
DEFINITION = r"(?m)(?:^|\n)\s*(?:(?:async\s+)?def\s+\w+\s*\(|class\s+\w+[\s(:]|(?:pub\s+)?(?:async\s+)?fn\s+\w+\s*[<(]|(?:pub\s+)?struct\s+\w+|(?:pub\s+)?trait\s+\w+|(?:pub\s+)?enum\s+\w+|(?:export\s+)?(?:function|const|let|var)\s+\w+|interface\s+\w+)"
CODE_NAMES = r"(?:async\s+)?def\s+(\w+)\s*\(|class\s+(\w+)[\s(:{]|(?:export\s+)?function\s+(\w+)\s*[<(]|interface\s+(\w+)[\s{<]|(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]|(?:pub\s+)?struct\s+(\w+)|(?:pub\s+)?trait\s+(\w+)|(?:pub\s+)?enum\s+(\w+)"
PITFALL_WORDS = r"(?i)\b(?:breaking\s+change|deprecated|DEPRECATED|removed\s+in|no\s+longer\s+supported|backwards?\s*incompatible|gotcha|pitfall|footgun)\b"

# --- code blocks, in the order in which they are listed
CODE_BLOCKS = (
    r"(?s)```[\w]*\n(.*?)```",
    r"(?m)::[ \t]*\n\n((?:[ \t]+.+\n?)+)",
    r"(?m)\.\.\s+(?:code-block|sourcecode)::\s*\w*\s*\n((?:[ \t]+.+\n?|\s*\n)+)",
    r"(?m)(?:^|\n\n)((?:    .+\n)+)",
)

# --- cleaning: (pattern, what takes its place), in order
CLEANING = (
    (r"(?s)<!--.*?-->", ""),
    (r"\{\*[^{}]*?\*\}|\{!\s*[^{}]*?\s*!\}", ""),
    (r"(?m)\s*\{\s*#[\w-]+(?:\s+[^{}]*)?\s*\}\s*$", ""),
    (r"""(?m)^///\s+\w+(?:\s+["'][^"'\n]*["'])?\s*$""", ""),
    (r"(?m)^///\s*$", ""),
    (
        r"(?m)^\.\.\s+(?:auto(?:class|function|method|attribute|module|data|exception)|(?:py:)?(?:function|class|method|attribute|data|exception|decorator|module)"
        r"|seealso|versionchanged|versionadded|deprecated|note|warning|tip|hint|todo|attention|caution|danger|important|admonition)::\s*[^\n]*$",
        "",
    ),
    (r"(?m)^\s+:[a-z-]+:.*$", ""),
    (r"(?m)^:::\s+[\w.]+\s*\n(?:\s+\w+:.*\n)*", ""),
    (r"<(?:img|br|hr|wbr|input|source|track)(?:\s+[^>]*)?/?>", ""),
    (r"</?(?:dfn|span|abbr|small|sup|sub|kbd|var|cite|mark|ins|del|s|u|i|b|em|strong)(?:\s+[^>]*)?>", ""),
    (r"\n{3,}", "\n\n"),
)

# --- documentation systems
SPHINX = r"(?m)^\.\.\s+(?:auto)?(?:class|function|method|attribute|module)::"
MKDOCS = r"(?m)^:::\s+[\w.]+|^!!!?\s+(?:note|tip|warning|example|info|danger|caution)\b|^///\s+(?:note|tip|warning|info|details|check)\b"
RUSTDOC_MARKS = ('class="rustdoc"', "Copy item path", 'name="generator" content="rustdoc"')
TYPEDOC_MARK = 'class="tsd-'

# --- paths and links
DECAYED_PATHS = ("release", "changelog", "migration", "whatsnew", "changes")
DECAY = 0.3
PATH_PREFIXES = ("docs/en/docs/", "documentation/docs/", "doc/build/", "docs/source/", "docs/", "doc/", "content/")
HREF = r"""(?i)href\s*=\s*(?:"([^"#]*)"|'([^'#]*)'|([^\s>#]+))"""
STATIC_SUFFIXES = (".css", ".js", ".svg", ".png", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".map")
FOOTER_WORDS = ("was this helpful", "updated ", "next steps", "cookie")
RUST_ITEM = r"^(struct|enum|trait|fn|type|constant|macro|attr)\."

# --- limits
SPLIT_LEVEL, MAX_UNIT_CHARS, MAX_LINK = 2, 8000, 500
