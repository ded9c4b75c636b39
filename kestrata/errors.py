"""Errors of the table engine; ``reason`` is what the scalar calls report."""

from __future__ import annotations


class TableError(ValueError):
    def __init__(self, reason: object) -> None:
        super().__init__(str(reason))
        self.reason = reason
