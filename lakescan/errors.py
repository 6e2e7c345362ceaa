"""Exceptions by condition; each is the built-in type that callers expect."""

from __future__ import annotations

from collections.abc import Iterable


def need_columns(have: Iterable[str], names: Iterable[str], kind: type[Exception] = KeyError) -> None:
    """Raise at call time, rather than when the plan is analysed."""
    have = list(have)
    if missing := [n for n in names if n not in have]:
        raise kind(f"no column {', '.join(map(repr, missing))} among {', '.join(have)}")


def need_unique(names: Iterable[str]) -> None:
    seen: set[str] = set()
    for n in names:
        if n in seen:
            raise ValueError(f"column {n!r} occurs twice")
        seen.add(n)
