"""Queries by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, function: Callable, sql: str | None = None) -> None:
        if name in self.functions:
            raise ValueError(f"{name} is already there")
        self.functions[name] = function
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def wrap(f: Callable) -> Callable:
            self.add(name or f.__name__, f, sql)
            return f

        return wrap
