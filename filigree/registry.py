"""Named implementations of an operator: what a configuration chooses by a key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class Registry:
    """Keys to callables. A key can be taken once; an unknown one is told with those there are."""

    def __init__(self, kind: str):
        self.kind = kind
        self._made: dict[str, Callable[..., Any]] = {}

    def register(self, key: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def put(f: Callable[..., Any]) -> Callable[..., Any]:
            if key in self._made:
                raise ValueError(f"{self.kind} {key!r} is registered already")
            self._made[key] = f
            return f

        return put

    def __getitem__(self, key: str) -> Callable[..., Any]:
        if key not in self._made:
            raise KeyError(f"no {self.kind} {key!r}; there are {', '.join(self.available())}")
        return self._made[key]

    def __contains__(self, key: str) -> bool:
        return key in self._made

    def __iter__(self) -> Iterator[str]:
        return iter(self.available())

    def build(self, key: str, *args: Any, **options: Any) -> Any:
        return self[key](*args, **options)

    def available(self) -> list[str]:
        return sorted(self._made)


SOURCES = Registry("source")
SAMPLERS = Registry("sampler")
ENCODERS = Registry("encoder")
EMBEDDERS = Registry("embedder")
SCORERS = Registry("scoring function")
SEARCHES = Registry("search")
DETECTORS = Registry("outlier detector")
GENERATORS = Registry("graph generator")
CALLBACKS = Registry("callback")
