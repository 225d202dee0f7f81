"""All registered queries of the library, gathered from the operator families.

A query applies an operator to the whole of its test tables. ``FIXTURES`` adapt those tables to the shapes that the
operators expect (intervals, reads, variants, ...); they are SQL that both Spark and DuckDB run.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FIXTURES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "datamash_grouped"


class Inputs:
    """Tables and fixtures as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in FIXTURES:
            return self.sql(FIXTURES[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """SQL over tables and fixtures."""
        used = set(re.findall(rf"\b(?:FROM|JOIN)\s+({'|'.join([*TABLES, *FIXTURES])})\b", text))
        marked = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", text) if used else text
        return self.spark.sql(marked, **{u: getattr(self, u) for u in used})


def oracle(sql: str) -> str:
    """SQL with the fixtures that it uses as common table expressions before its own."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                add(FIXTURES[name])
                needed.append(name)

    add(sql)
    if not needed:
        return sql
    before = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {before}, {body[15:]}"
    return f"WITH {before}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {before} {body}"


def register(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    """A query by the name of its operator; ``sql`` is the equivalent DuckDB text over tables and fixtures."""
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = oracle(sql)


for _family in ("tables", "intervals", "sequences", "reads", "variants", "alignments", "statistics", "omics", "annotation", "kernels", "further", "trimming", "mapping", "graphs"):
    importlib.import_module(f"spindrift.queries.{_family}")
