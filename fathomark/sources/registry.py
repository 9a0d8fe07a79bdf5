"""Kinds of stores by name, with the settings they need; and messages between those who share one."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from threading import RLock
from typing import Any, Protocol

from fathomark.errors import NotFoundError


@dataclass(frozen=True)
class Setting:
    name: str
    description: str = ""
    default: str = ""
    required: bool = False


class Broadcaster(Protocol):
    def broadcast(self, topic: str, payload: bytes) -> None: ...

    def subscribe(self, topic: str, handler: Callable[[bytes], None]) -> None: ...


class LocalBroadcaster:
    """Within one process: handlers are called in order, and a failing one doesn't stop the others."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[Callable[[bytes], None]]] = defaultdict(list)

    def broadcast(self, topic: str, payload: bytes) -> None:
        for handler in list(self._handlers[topic]):
            try:
                handler(payload)
            except Exception:  # noqa: BLE001, S112  fire and forget
                continue

    def subscribe(self, topic: str, handler: Callable[[bytes], None]) -> None:
        self._handlers[topic].append(handler)


@dataclass(frozen=True)
class Plugin:
    name: str
    factory: Callable[..., Any]
    settings: tuple[Setting, ...] = ()
    start: Callable[[Any], None] | None = None

    def open(self, values: Mapping[str, str] | None = None, *args: Any, broadcaster: Broadcaster | None = None, **options: Any) -> Any:
        """The store, started; settings without a value take their default."""
        values = dict(values or {})
        missing = [s.name for s in self.settings if s.required and not values.get(s.name)]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        options |= {s.name: values.get(s.name, s.default) for s in self.settings}
        store = self.factory(*args, **options)
        if broadcaster is not None:
            store.broadcaster = broadcaster
        if self.start is not None:
            self.start(store)
        return store


_lock, _plugins = RLock(), {}


def register(plugin: Plugin) -> None:
    with _lock:
        if plugin.name in _plugins:
            raise ValueError(f"{plugin.name!r} is registered already")
        _plugins[plugin.name] = plugin


def plugin(name: str) -> Plugin:
    with _lock:
        if name not in _plugins:
            raise NotFoundError(name)
        return _plugins[name]


def plugin_names() -> list[str]:
    with _lock:
        return sorted(_plugins)
