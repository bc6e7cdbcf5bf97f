"""Addresses of tiles: a resolver is anything that takes key columns by name and gives a column.

    sources.urls.template("http://a/{z}/{x}/{y}.png")          from a template
    lambda z, x, y: F.concat(F.lit("http://"), ..., y)          or from code

Every source that makes addresses takes a template or a resolver.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class UrlResolver(Protocol):
    def __call__(self, **keys: Column) -> Column:
        """The address of the tile with these keys; null where there is none."""


def template(text: str, every: bool = False) -> UrlResolver:
    """A resolver that puts keys in the place of their names in braces: of the first of each, or of every one."""

    def resolve(**keys: Column) -> Column:
        parts: list = [text]
        for name, value in keys.items():
            mark, k = f"{{{name}}}", 0
            while k < len(parts):
                if isinstance(parts[k], str) and mark in parts[k]:
                    before, _, after = parts[k].partition(mark)
                    parts[k : k + 1] = [before, value.cast("string"), after]
                    if not every:
                        break
                k += 1
        return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))

    return resolve


def resolved(urls: str | UrlResolver, every: bool = False, **keys: Column) -> Column:
    """The address that a template or a resolver gives for keys."""
    return (template(urls, every) if isinstance(urls, str) else urls)(**keys)
