"""Callbacks around calls and sessions, and a bounded cache of query vectors."""

from __future__ import annotations

import logging
import time
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager

log = logging.getLogger(__name__)
#: Events that a hook may ask for.
EVENTS = ("tool_call", "session_start", "session_end")


class Hooks:
    """Callbacks by event. One that fails is logged and does not stop the call or the others."""

    def __init__(self):
        self.known: dict[str, list[Callable[[dict], None]]] = {e: [] for e in EVENTS}

    def on(self, event: str, f: Callable[[dict], None]) -> None:
        if event not in self.known:
            raise ValueError(f"no event {event}")
        self.known[event].append(f)

    def emit(self, event: str, **what) -> None:
        for f in self.known[event]:
            try:
                f({"event": event, **what})
            except Exception:  # noqa: BLE001 - a hook must not break what it watches
                log.exception("hook of %s failed", event)

    @contextmanager
    def call(self, tool: str, **what):
        """Tells a call with how long it took and whether it went well."""
        start, ok = time.monotonic(), True
        try:
            yield
        except BaseException:
            ok = False
            raise
        finally:
            self.emit("tool_call", tool=tool, ok=ok, seconds=time.monotonic() - start, **what)


class QueryVectors:
    """Vectors of the last queries, least lately used ones dropped first; a model and its query are one key."""

    def __init__(self, embed: Callable[[str, str], list[float]], size: int = 256):
        self.embed, self.size, self.kept = embed, size, OrderedDict()

    def get(self, model: str, query: str) -> list[float]:
        key = (model, query)
        if key in self.kept:
            self.kept.move_to_end(key)
        else:
            self.kept[key] = self.embed(model, query)
            if len(self.kept) > self.size:
                self.kept.popitem(last=False)
        return self.kept[key]
