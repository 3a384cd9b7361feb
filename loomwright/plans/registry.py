"""A registry of named things; a name that is taken raises KeyError."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self._kinds: dict[str, dict[str, object]] = {}

    def add(self, kind: str, name: str, value):
        of = self._kinds.setdefault(kind, {})
        if name in of:
            raise KeyError(f"{kind} {name} is registered already")
        of[name] = value
        return value

    def register(self, kind: str, name: str):
        return lambda value: self.add(kind, name, value)

    def get(self, kind: str, name: str):
        return self._kinds.get(kind, {})[name]

    def names(self, kind: str) -> list[str]:
        return list(self._kinds.get(kind, {}))


REGISTRY = Registry()
