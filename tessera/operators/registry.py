"""Named generators: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame


class Generator(Protocol):
    """What a generator is: takes a DataFrame and options, gives a DataFrame (for workbooks: a cell grid)."""

    def __call__(self, rows: DataFrame, **options: object) -> DataFrame: ...


_KNOWN: dict[str, Generator] = {}


def register(name: str) -> Callable[[Generator], Generator]:
    def keep(f: Generator) -> Generator:
        _KNOWN[name] = f
        return f

    return keep


def create(name: str) -> Generator:
    """The generator of that name; KeyError for an unknown one."""
    return _KNOWN[name]


def names() -> list[str]:
    return sorted(_KNOWN)
