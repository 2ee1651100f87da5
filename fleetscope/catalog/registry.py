"""Query registry and the views the queries read.

A view is one SQL text for both engines. ``$each(n)`` stands for the numbers 1..n as rows, the
only construct the two spell differently.
"""

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}
QUERIES: dict[str, object] = {}
ORACLES: dict[str, tuple[str, str]] = {}

_EACH = {"spark": r"explode(sequence(1, \1))", "duckdb": r"unnest(generate_series(1, \1))"}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def _words(sql: str) -> set[str]:
    return set(re.findall(r"\b[a-z][a-z_0-9]*\b", sql))


def closure(sql: str) -> list[str]:
    """Views that a text needs, each after those it builds on. ``q_<name>`` is the SQL of another query."""
    found: list[str] = []

    def visit(text):
        for name in sorted(_words(text)):
            body = body_of(name)
            if body is not None and name not in found:
                visit(body)
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def body_of(name: str) -> str | None:
    if name in VIEWS:
        return VIEWS[name]
    if name.startswith("q_") and name[2:] in ORACLES:
        return ORACLES[name[2:]]
    return None


def render(sql: str, engine: str) -> str:
    """The text with its views in front."""
    names = closure(sql)
    text = sql.strip()
    if names:
        head = "WITH " + ",\n".join(f"{n} AS (\n{body_of(n)}\n)" for n in names)
        text = f"{head},\n{text[5:]}" if text.startswith("WITH ") else f"{head}\n{text}"
    return re.sub(r"\$each\(([^)]*)\)", _EACH[engine], text)


class Source:
    """Tables and views of one data folder for Spark."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._registered: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        rendered = render(text, "spark")
        for name in _words(rendered) & set(TABLES):
            if name not in self._registered:
                self.table(name).createOrReplaceTempView(name)
                self._registered.add(name)
        return self.spark.sql(rendered)

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return register


def oracle_texts() -> dict[str, str]:
    return {name: render(sql, "duckdb") for name, sql in ORACLES.items()}
