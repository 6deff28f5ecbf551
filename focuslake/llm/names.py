"""Names of columns inside an operator."""

from __future__ import annotations


def plain(columns: list[str]) -> list[str]:
    """Names by position, which no name that an operator uses inside can clash with."""
    return [f"in_{i}" for i in range(len(columns))]
