"""Inputs bound to DataFrames, with fallbacks that are built when they are first demanded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Source = Callable[[], DataFrame]


class Unbound(LookupError):
    """E5006: an input without a document or fallback was demanded."""


class Inputs:
    def __init__(self, fallbacks: dict[str, Source] | None = None):
        self._fallbacks, self._bound = dict(fallbacks or {}), {}

    def bind(self, name: str, df: DataFrame) -> None:
        self._bound[name] = df

    def unbind(self, name: str) -> None:
        self._bound.pop(name, None)

    def demand(self, name: str) -> DataFrame:
        if name not in self._bound:
            if name not in self._fallbacks:
                raise Unbound(f"E5006: input {name} is not bound")
            self._bound[name] = self._fallbacks[name]()
        return self._bound[name]

    def code(self, name: str) -> str | None:
        """The code that demanding the input would report."""
        return None if name in self._bound or name in self._fallbacks else "E5006"
