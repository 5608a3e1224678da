"""Read-only SQL over the index tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

ROWS = 500


def guard(spark: SparkSession, query: str) -> None:
    """Only SELECT or WITH, and only a plan without commands: WITH ... INSERT begins with an allowed word too."""
    first = re.match(r"\s*(\w+)", query)
    if not first or first[1].upper() not in ("SELECT", "WITH"):
        raise ValueError("only SELECT and WITH queries are allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query).toString()
    if re.search(r"(?m)^[\s:+'|-]*(Insert|Create|Drop|Delete|Update|Merge|Truncate|Alter|Set|Cache|Load|Add|Replace|Describe|Show)\w*", plan):
        raise ValueError("only queries that read are allowed")


def read_query(spark: SparkSession, query: str) -> DataFrame:
    guard(spark, query)
    return spark.sql(query)


def as_text(df: DataFrame, rows: int = ROWS) -> str:
    """Tab-separated text with a header; a note if there are `rows` rows or more."""
    got = df.limit(rows + 1).collect()
    lines = ["\t".join(df.columns)] + ["\t".join("" if v is None else str(v) for v in r) for r in got[:rows]]
    return "\n".join(lines + ["… (truncated; add LIMIT)"] * (len(got) >= rows))


def table_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError("Invalid table name")
    return name


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def describe_table(spark: SparkSession, name: str) -> str:
    if not spark.catalog.tableExists(table_name(name)):
        return f"Not found: {name}"
    schema = spark.table(name).schema
    return f"CREATE TABLE {name} ({schema.toDDL()})\n" + "\n".join(f"{f.name}\t{f.dataType.simpleString()}" for f in schema)
