"""Registry of named queries: a Spark callable and, where SQL can express it, the same question as plain SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from staylens.session import ship_package
from staylens.sources.adapters import ORACLE_VIEWS, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def present(df: DataFrame) -> DataFrame:
    """Comparable output: doubles at six decimals, dates and timestamps as ISO text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_views(sql: str) -> str:
    """Prefix the SQL with the adapter views it mentions, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in ORACLE_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    ctes = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in ORACLE_VIEWS if n in needed]
    body = sql.strip()
    if not ctes:
        return body
    recursive = bool(re.match(r"WITH\s+RECURSIVE\s", body, re.I))
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    head = "WITH RECURSIVE " if recursive else "WITH "
    rest = ", " + body[match.end():] if match else " " + body
    return head + ", ".join(ctes) + rest


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return register


def callable_for(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn = QUERIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return present(fn(Tables(spark, sf_dir)))

    run.__name__ = name
    return run
