"""Where runnable queries and their SQL counterparts are kept.

Results leave in plain types so two engines can be compared value by value:
decimals as doubles, dates and times as text, arrays as comma-joined text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixtures import FIXTURE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
OPERATOR: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def shape(body: str, columns: str) -> str:
    """Wrap a SELECT over the fixture so its columns leave in the same plain types.

    ``$`` marks money and rates, ``@`` dates, ``!`` times, ``#`` whole numbers.
    """
    out = []
    for token in columns.split():
        mark, name = (token[0], token[1:]) if token[0] in "$@!#" else ("", token)
        out.append({
            "$": f"CAST({name} AS DOUBLE) AS {name}",
            "@": f"strftime({name}, '%Y-%m-%d') AS {name}",
            "!": f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}",
            "#": f"CAST({name} AS BIGINT) AS {name}",
            "": name,
        }[mark])
    return f"WITH {FIXTURE_SQL}, result_rows AS ({body}) SELECT {', '.join(out)} FROM result_rows"


def query(name: str, operator: str, sql: str | None = None, columns: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``operator`` names the inventory entries it shows."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
        OPERATOR[name] = operator
        if sql is not None:
            ORACLE[name] = shape(sql, columns) if columns else sql
        return fn
    return register
