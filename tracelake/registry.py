"""Registration of queries with their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Named relations that oracle texts can use.
RELATIONS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) under a name; sql is its twin and can use RELATIONS."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracle(name: str) -> str:
    """The twin as one statement: the relations it uses stand before it."""
    text, need = ORACLES[name], []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\bfx_\w+", sql)):
            if word in RELATIONS and word not in need:
                visit(RELATIONS[word])
                if word not in need:
                    need.append(word)

    visit(text)
    heads = [f"{w} AS ({RELATIONS[w].strip()})" for w in need]
    body = text.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if m:
        return "WITH RECURSIVE " + ", ".join([*heads, body[m.end() :]])
    return ("WITH RECURSIVE " + ", ".join(heads) + " " if heads else "") + body
