"""Named queries over the driver's tables, each an operator applied to grids made from them, with its SQL.

Grids: v is an aggregate of lineitem by (key % 48, key % 48). `a`, `b`: quantities; `b` lacks every 11th cell's data;
`c`, `d`: classes 1 to 5; `f`: friction 1 to 4 with barriers; `p`, `q`: shares 0 to 1; `s`: sparse features.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.grid import Grid
from ..plans.registry import create

SIZE = 48
CELL = f"CAST(l_orderkey % {SIZE} AS INT) AS row, CAST(l_partkey % {SIZE} AS INT) AS col"
HOLE = f"(l_orderkey % {SIZE} + l_partkey % {SIZE}) % 11 = 0"
#: Values of each grid, in SQL that both engines read alike.
VALUES = {
    "a": "CAST(SUM(l_quantity) AS DOUBLE)",
    "b": f"CAST(CASE WHEN {HOLE} THEN NULL ELSE SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 1 END) END AS DOUBLE)",
    "c": "CAST(SUM(l_linenumber) % 5 + 1 AS DOUBLE)",
    "d": "CAST((SUM(l_linenumber) + COUNT(*) % 2) % 5 + 1 AS DOUBLE)",
    "f": "CAST(CASE WHEN SUM(l_linenumber) % 13 = 0 THEN 0 ELSE SUM(l_linenumber) % 4 + 1 END AS DOUBLE)",
    "p": "(SUM(l_linenumber) % 101) / 100.0",
    "q": "(SUM(l_suppkey) % 101) / 100.0",
    "s": "CAST(CASE WHEN SUM(l_suppkey) % 37 = 0 THEN 1 + SUM(l_linenumber) % 3 ELSE 0 END AS DOUBLE)",
}
GRID_SQL = {k: f"SELECT {CELL}, CAST({v} AS DOUBLE) AS v FROM lineitem GROUP BY l_orderkey % {SIZE}, l_partkey % {SIZE}" for k, v in VALUES.items()}
TRANSFORM = (1000.0, 5000.0, 10.0, -10.0, 0.0, 0.0)


def grid(spark: SparkSession, sf_dir: str, name: str, size: int = SIZE) -> Grid:
    """A grid of size x size cells; the catalogue's SQL is for SIZE."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [(F.col(c) % size).cast("int").alias(n) for c, n in (("l_orderkey", "row"), ("l_partkey", "col"))]
    value = VALUES[name].replace(HOLE, f"(first(l_orderkey) % {size} + first(l_partkey) % {size}) % 11 = 0")
    return Grid(items.groupBy(*keys).agg(F.expr(value).cast("double").alias("v")), size, size, TRANSFORM)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that sums in another order compare equal; no negative zero."""
    return df.select(*(F.round(F.col(c) + F.lit(0.0), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def frame(x) -> DataFrame:
    return x.df if isinstance(x, Grid) else x


def add(name: str, run: Callable, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(frame(run(spark, sf_dir)))
    if sql:
        ORACLES[name] = sql


def with_grids(names: str, body: str) -> str:
    return "WITH " + ", ".join(f"{k} AS ({GRID_SQL[k]})" for k in names) + body


def local_case(op: str, grids: str, value: str | dict, suffix: str = "", as_list: bool = False, **params) -> None:
    """A per-cell operator against SQL expressions over the grids' names (a.v is written a)."""

    def run(spark, sf_dir):
        own = [grid(spark, sf_dir, g) for g in grids]
        return create(op)(own, **params) if as_list else create(op)(*own, **params)

    values = value if isinstance(value, dict) else {"v": value}
    source = grids[0] + "".join(f" JOIN {g} USING (row, col)" for g in dict.fromkeys(grids[1:]) if g != grids[0])
    cells = ", ".join(f"{g}.v AS {g}v" for g in dict.fromkeys(grids))
    out = ", ".join(f"ROUND(CAST({e} AS DOUBLE) + 0.0, 6) AS {n}" for n, e in values.items())
    sql = with_grids(dict.fromkeys(grids), f", x AS (SELECT row, col, {cells} FROM {source}) SELECT row, col, {out} FROM x")
    add(f"{op.lower()}{'_' + suffix if suffix else ''}", run, sql)


def case(name: str, op: str, grids: str, sql: str | None, pick: Callable = lambda create_, own: create_(*own), **params) -> None:
    """An operator on grids, with the rest of its SQL after the grids' definitions."""

    def run(spark, sf_dir):
        return pick(lambda *x, **k: create(op)(*x, **(params | k)), [grid(spark, sf_dir, g) for g in grids])

    add(name, run, with_grids(dict.fromkeys(grids), sql) if sql else None)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _fill()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _fill()
    return dict(ORACLES)


def _fill() -> None:
    if not QUERIES:
        from . import cases

        cases.register()
