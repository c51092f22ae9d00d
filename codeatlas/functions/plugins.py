"""Plug-ins: named functions over symbols and over lines of text, kept apart from failures."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Registry:
    """Text visitors ``(line, path, number) -> html or None`` and symbol visitors ``(name) -> text or None`` by kind."""

    def __init__(self, blacklist: tuple[str, ...] = (), settings: dict[str, dict[str, str]] | None = None):
        self.blacklist, self.settings = set(blacklist), settings or {}
        self.text: dict[str, Callable] = {}
        self.symbols: dict[str, dict[str, Callable]] = {}

    def add(self, name: str, init: Callable[[dict[str, str]], dict]) -> bool:
        """Ask a plug-in for its visitors; one that is barred or fails is left out."""
        if name in self.blacklist:
            return False
        try:
            made = init(self.settings.get(name, {}))
        except Exception:
            log.exception("plug-in %s", name)
            return False
        if "text" in made:
            self.text[name] = made["text"]
        for kind, visitor in made.get("symbols", {}).items():
            self.symbols.setdefault(kind, {})[name] = visitor
        return True

    def visit_lines(self, lines: DataFrame) -> DataFrame:
        """(path, line, line_text) with the joined output of all text visitors."""
        visitors = list(self.text.values())

        def visit(text: pd.Series, path: pd.Series, line: pd.Series) -> pd.Series:
            return pd.Series(["".join(_safe(v, t, p, n) for v in visitors) for t, p, n in zip(text, path, line)])

        return lines.withColumn("marks", _typed3(visit)(F.col("line_text"), F.col("path"), F.col("line")))

    def visit_symbols(self, symbols: DataFrame) -> DataFrame:
        """(kind, name) with the joined output of the visitors of its kind."""
        by_kind = {k: list(v.values()) for k, v in self.symbols.items()}

        def visit(kind: pd.Series, name: pd.Series) -> pd.Series:
            return pd.Series(["".join(_safe(v, n) for v in by_kind.get(k, [])) for k, n in zip(kind, name)])

        return symbols.withColumn("marks", _typed2(visit)(F.col("kind"), F.col("name")))


def _safe(visitor: Callable, *args) -> str:
    try:
        return visitor(*args) or ""
    except Exception:
        return ""


def _typed2(f: Callable) -> Callable[..., Column]:
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return f(a, b)

    return F.pandas_udf(run, "string")


def _typed3(f: Callable) -> Callable[..., Column]:
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return f(a, b, c)

    return F.pandas_udf(run, "string")
