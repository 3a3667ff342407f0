"""Progress of an ingest: one line at the end, one event a change, or a line that is painted again."""

from __future__ import annotations

import json
import sys
import threading
import time
from typing import TextIO


class PlainReporter:
    """One line for each source that ends."""

    def __init__(self, out: TextIO | None = None):
        self.out, self.lock, self.state = out or sys.stderr, threading.Lock(), {}

    def update(self, source: str, phase: str, **detail) -> None:
        with self.lock:
            before = self.state.get(source, {})
            self.state[source] = {"phase": phase, "since": before.get("since", time.time()), **detail}
            self.changed(source)

    def changed(self, source: str) -> None:
        now = self.state[source]
        if now["phase"] in ("done", "failed", "skipped"):
            detail = " ".join(f"{k}={v}" for k, v in now.items() if k not in ("phase", "since"))
            print(f"{source}: {now['phase']} {detail}".rstrip(), file=self.out, flush=True)


class JsonReporter(PlainReporter):
    """A JSON line for each change."""

    def changed(self, source: str) -> None:
        print(json.dumps({"source": source} | {k: v for k, v in self.state[source].items() if k != "since"}), file=self.out, flush=True)


class LiveReporter(PlainReporter):
    """All sources on one line, painted again at each change."""

    def changed(self, source: str) -> None:
        self.out.write("\r\x1b[K" + "  ".join(f"{s}: {x['phase']}" for s, x in sorted(self.state.items())))
        self.out.flush()


def reporter(json_mode: bool = False, out: TextIO | None = None) -> PlainReporter:
    """JSON if asked for, a live line on a terminal, else plain lines."""
    stream = out or sys.stderr
    return JsonReporter(stream) if json_mode else LiveReporter(stream) if stream.isatty() else PlainReporter(stream)
