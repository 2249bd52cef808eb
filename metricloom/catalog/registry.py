"""Registration of queries with their output columns, survey ids and comparison SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.catalog.views import VIEW_SQL

TIME_FORMATS = {"t": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"), "d": ("yyyy-MM-dd", "%Y-%m-%d")}


@dataclass(frozen=True)
class Query:
    """``out`` lists ``column:kind``: t time, d date, i integer, s text, b boolean, a digit for rounded doubles."""

    name: str
    ids: str
    out: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def columns(self) -> list[tuple[str, str]]:
        return [tuple(item.split(":")) for item in self.out.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(spark, sf_dir).select(*[_spark_column(c, kind) for c, kind in self.columns()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        body = ", ".join(_sql_column(c, kind) for c, kind in self.columns())
        return f"{with_views(self.sql)} SELECT {body} FROM result"


def _spark_column(name: str, kind: str):
    c = F.col(name)
    if kind in TIME_FORMATS:
        c = F.date_format(c, TIME_FORMATS[kind][0])
    elif kind.isdigit():
        # Adding 0.0 turns a negative zero into zero.
        c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
    else:
        c = c.cast({"i": "bigint", "s": "string", "b": "boolean"}[kind])
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    if kind in TIME_FORMATS:
        value = f"strftime(CAST({name} AS TIMESTAMP), '{TIME_FORMATS[kind][1]}')"
    elif kind.isdigit():
        value = f"round(CAST({name} AS DOUBLE), {kind}) + 0.0"
    else:
        value = f"CAST({name} AS {dict(i='BIGINT', s='VARCHAR', b='BOOLEAN')[kind]})"
    return f"{value} AS {name}"


def with_views(sql: str) -> str:
    """A WITH clause holding the input views the text names, and the text itself as ``result``."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in VIEW_SQL.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                needed.append(name)

    visit(sql)
    parts = [f"{name} AS ({VIEW_SQL[name]})" for name in needed]
    return "WITH " + ", ".join([*parts, f"result AS ({sql})"])


QUERIES: dict[str, Query] = {}


def register(name: str, ids: str, out: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, ids, out, build, sql)
        return build

    return add
