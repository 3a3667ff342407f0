"""What callers outside Python see: answers as plain values, over HTTP and on the command line.

One running session serves all requests.  Answers are bounded by the request (top_k) or are one symbol's or one module's
rows; they come to the driver as JSON.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.engine import Library, to_json
from siltstone.operators.search import check_top_k
from siltstone.schema import UNIT_TYPES

#: What a unit shows.
SHOWN = ("id", "type", "framework", "module_path", "heading_hierarchy", "content", "related_symbols", "language", "source_file")


class NotFound(LookupError):
    """There is no such symbol, framework or address."""


def values(df: DataFrame) -> list[dict[str, Any]]:
    return [json.loads(r["value"]) for r in to_json(df).collect()]


def _unit(row: dict[str, Any]) -> dict[str, Any]:
    return {k: row.get(k) for k in SHOWN}


class Service:
    """The read queries of a library as plain values."""

    def __init__(self, library: Library):
        self.library = library

    def search(self, q: str, framework: str | None = None, type: str | None = None, top_k: int = 10) -> list[dict[str, Any]]:
        if type is not None and type not in UNIT_TYPES:
            raise ValueError(f"type must be one of {', '.join(UNIT_TYPES)}, not {type!r}")
        return [_unit(r) for r in values(self.library.search(q, framework, type, check_top_k(top_k)))]

    def lookup(self, symbol: str, framework: str | None = None, include_related: bool = True, include_examples: bool = True) -> dict[str, Any]:
        rows = values(self.library.lookup(symbol, framework, include_related, include_examples).orderBy("section", "ord"))
        found = {section: [_unit(r) for r in rows if r["section"] == section] for section in ("match", "related", "example")}
        if not found["match"]:
            raise NotFound(f"no unit has the symbol {symbol!r}")
        return {"match": found["match"][0], "related": found["related"], "examples": found["example"]}

    def browse(self, framework: str, module: str | None = None) -> dict[str, Any]:
        rows = values(self.library.browse(framework, module))
        if module:
            return {"framework": framework, "module": module, "units": [_unit(r) for r in rows]}
        return {"framework": framework, "modules": [{"name": r["module_path"], "description": r.get("description", ""), "symbols": r["symbols"]} for r in rows]}

    def bundle(self, q: str, framework: str | None = None, top_k: int = 5) -> dict[str, Any]:
        found = self.library.bundle(q, framework, check_top_k(top_k, 50)).select("id", "bucket_rank")
        rows = values(found.join(self.library.store.units(), "id").orderBy("bucket_rank"))
        return {kind: [_unit(r) for r in rows if r["type"] == kind] for kind in UNIT_TYPES}

    def query(self, q: str, framework: str | None = None, top_k: int = 5) -> dict[str, Any]:
        """One word is looked up, and searched for if there is no such symbol; more words are searched for."""
        if len(q.split()) == 1:
            try:
                return self.lookup(q, framework)
            except NotFound:
                pass
        return self.bundle(q, framework, top_k)

    def frameworks(self) -> list[str]:
        return [r["framework"] for r in self.library.store.units().select("framework").distinct().orderBy("framework").collect()]

    def stats(self) -> list[dict[str, Any]]:
        return values(self.library.stats().orderBy(F.asc_nulls_last("framework"), F.asc_nulls_last("type")))

    def status(self, check: bool = False) -> list[dict[str, Any]]:
        return values(self.library.status(self.library.remote() if check else None).orderBy("framework"))


def _flag(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise ValueError(f"{text!r} is neither true nor false")
    return text.lower() in ("true", "1")


#: Parameters by address: whether each is needed, and what it is.
ROUTES: dict[str, dict[str, tuple[bool, type | Any]]] = {
    "search": {"q": (True, str), "framework": (False, str), "type": (False, str), "top_k": (False, int)},
    "lookup": {"framework": (False, str), "include_related": (False, _flag), "include_examples": (False, _flag)},
    "browse": {"framework": (True, str), "module": (False, str)},
    "bundle": {"q": (True, str), "framework": (False, str), "top_k": (False, int)},
    "query": {"q": (True, str), "framework": (False, str), "top_k": (False, int)},
    "frameworks": {},
    "stats": {},
    "status": {"check": (False, _flag)},
}


def answer(service: Service, address: str) -> tuple[int, Any]:
    """Status and value for one GET: 404 for what is not there, 422 for parameters that are wrong."""
    parts = urlsplit(address)
    name, _, rest = parts.path.strip("/").partition("/")
    if name not in ROUTES or bool(rest) != (name == "lookup"):
        return 404, {"detail": f"nothing at {parts.path}"}
    given = {k: v[-1] for k, v in parse_qs(parts.query, keep_blank_values=True).items()}
    try:
        for key, (needed, _) in ROUTES[name].items():
            if needed and key not in given:
                raise ValueError(f"{key} is missing")
        args = {key: ROUTES[name][key][1](value) for key, value in given.items() if key in ROUTES[name]}
        return 200, getattr(service, name)(*([unquote(rest)] if rest else []), **args)
    except NotFound as e:
        return 404, {"detail": str(e)}
    except ValueError as e:
        return 422, {"detail": str(e)}


def server(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server that answers with the library of ``service``; the caller starts and ends it."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:  # noqa: N802
            try:
                status, value = answer(service, self.path)
            except Exception as e:  # the request fails, not the server
                status, value = 500, {"detail": f"{type(e).__name__}: {e}"[:500]}
            body = json.dumps(value, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
