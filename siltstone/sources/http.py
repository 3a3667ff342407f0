"""Requests over HTTP, with nothing but the standard library."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple
from urllib import error, request

#: Answers of busy servers, and the seconds to wait before each attempt; fixed values.
BUSY, WAITS, TIMEOUT = (429, 502, 503, 504), (0, 2, 4, 8), 15.0


class Answer(NamedTuple):
    status: int
    etag: str | None
    body: str
    modified: str | None = None


#: Given a URL and an etag: an answer (status, etag, body, ...), or None if it can't be reached.
Fetch = Callable[..., "Answer | tuple[int, str | None, str] | None"]


def http_fetch(url: str, etag: str | None = None, method: str = "GET", timeout: float = TIMEOUT, waits: tuple[int, ...] = WAITS) -> Answer | None:
    """A page; busy servers are asked again, then told as what they are; None where there is no server."""
    last: Answer | None = None
    for wait in waits:
        time.sleep(wait)
        try:
            with request.urlopen(request.Request(url, headers={"If-None-Match": etag} if etag else {}, method=method), timeout=timeout) as r:
                return Answer(r.status, r.headers.get("ETag"), r.read().decode("utf-8", "replace"), r.headers.get("Last-Modified"))
        except error.HTTPError as e:
            last = Answer(e.code, e.headers.get("ETag") or etag, "", None)
            if e.code not in BUSY:
                return last
        except (OSError, ValueError):
            return last
    return last
