"""The command line: ``python -m siltstone WORDS...`` asks, the other verbs keep the library in order.

A first word that is no verb begins a question.  Answers are JSON where the output is no terminal; ``--json`` and
``--pretty`` say otherwise.  Errors are told the same way, and end with status 1.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Callable
from typing import Any, TextIO

from siltstone.engine import Library
from siltstone.reporter import reporter
from siltstone.service import NotFound, Service, server
from siltstone.sources import UnsupportedSource, config

HOME = "~/.siltstone"
#: Names of a module that people are shown.
SHOWN_SYMBOLS = 5
#: What ``init`` writes.
TEMPLATE = {"data_dir": f"{HOME}/data", "min_health_score": 80, "sources": {"example": {"path": "/path/to/markdown", "language": "python"}}}


def _parser() -> argparse.ArgumentParser:
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config", default=f"{HOME}/config.json", help="the configuration, JSON or YAML")
    form = shared.add_mutually_exclusive_group()
    form.add_argument("--json", dest="json", action="store_true", default=None, help="answer in JSON")
    form.add_argument("--pretty", dest="json", action="store_false", help="answer for people")
    parser = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)

    def verb(name: str, help: str, *arguments: tuple[tuple[str, ...], dict[str, Any]]) -> None:
        sub = verbs.add_parser(name, help=help, parents=[shared])
        for names, options in arguments:
            sub.add_argument(*names, **options)

    words = (("words",), {"nargs": "+"})
    one = (("-f", "--framework"), {"default": None})
    top = lambda n: (("-k", "--top-k"), {"type": int, "default": n})
    verb("query", "look a word up, or search for several", words, one, top(5))
    verb("search", "the best units", words, one, (("-t", "--type"), {"default": None}), top(5))
    verb("bundle", "the best units of each type", words, one, top(5))
    verb("lookup", "a symbol", (("symbol",), {}), one, (("--no-related",), {"action": "store_true"}), (("--no-examples",), {"action": "store_true"}))
    verb("browse", "modules, or a module's units", (("framework",), {}), (("-m", "--module"), {"default": None}))
    verb("frameworks", "the names of what is there")
    verb("stats", "counts by framework and type")
    verb("status", "health, versions and what is outdated", (("--no-check",), {"action": "store_true", "help": "do not ask the sources"}))
    verb("usage", "bytes on disk by table and framework")
    verb("ingest", "read sources", one, (("--rebuild",), {"action": "store_true", "help": "replace what is there"}))
    verb("update", "read anew what is outdated")
    verb("remove", "take a framework out", (("framework",), {}))
    verb("nuke", "take everything out", (("--yes",), {"action": "store_true"}))
    verb("serve", "answer over HTTP", (("--host",), {"default": None}), (("--port",), {"type": int, "default": None}))
    verb("init", "write a first configuration")
    return parser


def verbs() -> set[str]:
    return set(next(a for a in _parser()._actions if isinstance(a, argparse._SubParsersAction)).choices)


def parse(argv: list[str]) -> argparse.Namespace:
    known = argv and (argv[0] in verbs() or argv[0] in ("-h", "--help"))
    return _parser().parse_args(argv if known or not argv else ["query", *argv])


def _line(value: Any) -> str:
    """A value for people: a unit by its place and first line, other rows by their fields."""
    if isinstance(value, dict) and "content" in value:
        first = next((x.strip() for x in (value["content"] or "").split("\n") if x.strip()), "")
        return f"[{value['type']}] {value['framework']} {' > '.join(value['heading_hierarchy'] or [])}\n    {first[:100]}"
    if isinstance(value, dict) and "symbols" in value:
        names, more = value["symbols"][:SHOWN_SYMBOLS], len(value["symbols"]) - SHOWN_SYMBOLS
        return f"{value['name']}: {', '.join(names)}{f' (+{more})' if more > 0 else ''}"
    return "  ".join(f"{k}={v}" for k, v in value.items()) if isinstance(value, dict) else str(value)


def render(value: Any, as_json: bool, out: TextIO) -> None:
    if as_json:
        print(json.dumps(value, ensure_ascii=False, default=str), file=out)
    elif isinstance(value, dict) and any(isinstance(v, (list, dict)) for v in value.values()) and "content" not in value:
        for name, part in value.items():
            print(f"{name}:", file=out)
            for n, x in enumerate(part if isinstance(part, list) else [part], 1):
                print(f"  {n}. {_line(x)}", file=out)
    else:
        for n, x in enumerate(value, 1) if isinstance(value, list) else [(0, value)]:
            print(f"{n}. {_line(x)}" if n else _line(x), file=out)


def _init(path: str) -> dict[str, str]:
    path = os.path.expanduser(path)
    if os.path.exists(path):
        return {"config": path, "state": "kept"}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(TEMPLATE, f, indent=2)
    return {"config": path, "state": "written"}


def run(args: argparse.Namespace, library: Callable[[dict[str, Any]], Library], as_json: bool, out: TextIO) -> Any:
    if args.verb == "init":
        return _init(args.config)
    path = os.path.expanduser(args.config)
    if not os.path.exists(path):
        raise FileNotFoundError(f"there is no configuration at {path}; init writes one")
    settings = config.load(path)
    lib = library(settings)
    lib.reporter = reporter(as_json)
    service, words = Service(lib), " ".join(getattr(args, "words", []))
    actions: dict[str, Callable[[], Any]] = {
        "query": lambda: service.query(words, args.framework, args.top_k),
        "search": lambda: service.search(words, args.framework, args.type, args.top_k),
        "bundle": lambda: service.bundle(words, args.framework, args.top_k),
        "lookup": lambda: service.lookup(args.symbol, args.framework, not args.no_related, not args.no_examples),
        "browse": lambda: service.browse(args.framework, args.module),
        "frameworks": service.frameworks,
        "stats": service.stats,
        "status": lambda: service.status(not args.no_check),
        "usage": lambda: [r.asDict() for r in lib.usage().collect()],
        "ingest": lambda: lib.ingest(args.framework, args.rebuild),
        "update": lambda: {"updated": lib.update()},
        "remove": lambda: {"framework": args.framework, "removed": lib.remove(args.framework)},
        "nuke": lambda: lib.nuke(args.yes) or {"state": "empty"},
    }
    if args.verb != "serve":
        return actions[args.verb]()
    running = server(service, args.host or settings["host"], args.port or settings["port"])
    render({"serving": "http://{}:{}".format(*running.server_address[:2])}, as_json, out)
    try:
        running.serve_forever()
    except KeyboardInterrupt:
        pass
    finally:
        running.server_close()
    return None


def _library(settings: dict[str, Any]) -> Library:
    from siltstone.session import session

    return Library(session(os.environ.get("SPARK_MASTER") or "local[*]"), settings["data_dir"], settings)


def main(argv: list[str] | None = None, library: Callable[[dict[str, Any]], Library] = _library, out: TextIO | None = None) -> int:
    out = out or sys.stdout
    args = parse(sys.argv[1:] if argv is None else argv)
    as_json = args.json if args.json is not None else not out.isatty()
    try:
        value = run(args, library, as_json, out)
    except (NotFound, LookupError, ValueError, UnsupportedSource, OSError) as e:
        kind, text = type(e).__name__, str(e.args[0]) if isinstance(e, KeyError) and e.args else str(e)
        render({"error": kind, "message": text} if as_json else f"{kind}: {text}", as_json, out)
        return 1
    if value is not None:
        render(value, as_json, out)
    return 0
