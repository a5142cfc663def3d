"""Memory of bounded size inside workers."""

from __future__ import annotations

from collections.abc import Callable

_HELD: dict[str, object] = {}


class Memo(dict):
    """``memo[key]`` computes and keeps ``make(key)``. At most twice ``limit`` values are kept: when ``limit`` new ones have
    come, the older ones go, but for those that were asked for again."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self._make, self._limit, self._older = make, limit, {}

    def __missing__(self, key):
        if len(self) >= self._limit:
            self._older = dict(self)
            self.clear()
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value


def held(key: str, make: Callable):
    """What ``make()`` gave for ``key`` in this Python worker; a worker holds the last one only."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]
