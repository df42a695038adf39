"""Events around writes and queries: start, stop and exception, for any number of handlers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock

Handler = Callable[[tuple[str, str], dict, dict], None]
EVENTS = [(kind, phase) for kind in ("write", "query") for phase in ("start", "stop", "exception")]

_handlers: dict[str, tuple[frozenset[tuple[str, str]], Handler]] = {}
_lock = Lock()


def attach(name: str, handler: Handler, events: list[tuple[str, str]] | None = None) -> None:
    with _lock:
        if name in _handlers:
            raise ValueError(f"handler {name!r} is attached already")
        _handlers[name] = frozenset(events or EVENTS), handler


def detach(name: str) -> bool:
    with _lock:
        return _handlers.pop(name, None) is not None


def emit(event: tuple[str, str], measures: dict, meta: dict) -> None:
    with _lock:
        own = [h for wanted, h in _handlers.values() if event in wanted]
    for handler in own:
        handler(event, measures, meta)


@contextmanager
def span(kind: str, **meta: object) -> Iterator[dict]:
    """Emits start, then stop with the duration in nanoseconds and what the block puts into the dict it gets; or exception."""
    began, more = time.monotonic_ns(), {}
    emit((kind, "start"), {"system_time": time.time_ns()}, dict(meta))
    try:
        yield more
    except BaseException as error:
        emit((kind, "exception"), {"duration": time.monotonic_ns() - began}, {**meta, "kind": type(error).__name__, "reason": str(error)})
        raise
    emit((kind, "stop"), {"duration": time.monotonic_ns() - began, **more}, dict(meta))
