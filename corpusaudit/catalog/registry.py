"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit import adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, str] = {}

_WIDER = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}


def widened(df: DataFrame) -> DataFrame:
    """Numbers as bigint and double, so that both engines name the same types."""
    return df.select(
        *[F.col(name).cast(_WIDER.get(kind, kind)) if kind in _WIDER else F.col(name) for name, kind in df.dtypes]
    )


def query(name: str, sql: str | None = None):
    """Register a function of ``read``, which loads a view and knows the session."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def read(view: str) -> DataFrame:
                return adapters.view(spark, sf_dir, view)

            read.spark, read.sf_dir = spark, sf_dir
            return widened(fn(read))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        MODULES[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def v(name: str) -> str:
    """A view as a SQL source with the view's name as alias."""
    return f"{adapters.view_sql(name)} {name}" if name in adapters.VIEWS else name


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """Constant rows as a SQL source; ``columns`` starts with the alias."""

    def cell(x: object) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, (int, float)):
            return f"cast({x!r} as {'bigint' if isinstance(x, int) else 'double'})"
        return quoted(x)  # type: ignore[arg-type]

    body = ", ".join("(" + ", ".join(cell(x) for x in row) + ")" for row in rows)
    return f"(VALUES {body}) {columns}"


def names(items: list[str]) -> str:
    return ", ".join(quoted(i) for i in items)


#: Suffix, base name and stem of a path, as DuckDB expressions over ``p``.
def sql_basename(p: str) -> str:
    return f"regexp_replace({p}, '(?s)^.*/', '')"


def sql_suffix(p: str) -> str:
    return f"regexp_extract({sql_basename(p)}, '(?s)^.+([.][^.]+)$', 1)"


def sql_stem(p: str) -> str:
    return f"substr({sql_basename(p)}, 1, length({sql_basename(p)}) - length({sql_suffix(p)}))"


def sql_language(p: str, scheme: str) -> str:
    """Scalar subquery for the language of a path."""
    from corpusaudit import dims

    pairs = [(e, l) for e, l in dims.LANGUAGE_SCHEMES[scheme].items()]
    whens = " ".join(f"WHEN {quoted(e)} THEN {quoted(l)}" for e, l in pairs)
    return f"(CASE lower({sql_suffix(p)}) {whens} END)"
