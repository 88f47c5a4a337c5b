"""A small table store over temporary views: SQL, filters, computed columns, inserts, updates and deletes as rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Database:
    def __init__(self, spark: SparkSession, prefix: str = "db_"):
        self.spark, self.prefix, self._tables = spark, prefix, {}

    def _view(self, name: str) -> str:
        return f"{self.prefix}{name}"

    def create_table(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self._view(name))
        self._tables[name] = df

    def drop_table(self, name: str) -> bool:
        return self._tables.pop(name, None) is not None and self.spark.catalog.dropTempView(self._view(name))

    def tables(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ValueError(f"no table {name}")
        return self._tables[name]

    def columns(self, name: str) -> list[str]:
        return self.table(name).columns

    def column_types(self, name: str) -> dict[str, str]:
        return dict(self.table(name).dtypes)

    def row_count(self, name: str) -> int:
        return self.table(name).count()

    def query(self, sql: str) -> DataFrame:
        """SQL over the tables by their own names, in braces: SELECT * FROM {name}."""
        return self.spark.sql(sql, **self._tables)

    def select_all(self, name: str, order_by: str | None = None) -> DataFrame:
        return self.table(name).orderBy(F.expr(order_by)) if order_by else self.table(name)

    def filter(self, name: str, where: str, order_by: str | None = None) -> DataFrame:
        out = self.table(name).where(where)
        return out.orderBy(F.expr(order_by)) if order_by else out

    def insert(self, name: str, rows: DataFrame) -> None:
        self.create_table(name, self.table(name).unionByName(rows, allowMissingColumns=True))

    def update(self, name: str, values: dict[str, str], where: str) -> None:
        """values: expressions by column."""
        t = self.table(name)
        hit = F.coalesce(F.expr(where), F.lit(False))
        self.create_table(name, t.select(*(F.when(hit, F.expr(values[c])).otherwise(F.col(c)).cast(k).alias(c) if c in values else F.col(c) for c, k in t.dtypes)))

    def delete_rows(self, name: str, where: str) -> None:
        self.create_table(name, self.table(name).where(~F.coalesce(F.expr(where), F.lit(False))))

    def calculate_field(self, name: str, column: str, expression: str) -> None:
        self.create_table(name, self.table(name).withColumn(column, F.expr(expression)))

    def import_csv(self, name: str, path: str, header: bool = True) -> None:
        """Types come from the first data row: long, else double, else text. A column with later values that don't fit is widened, so none is lost."""
        raw = self.spark.read.option("header", header).csv(path)
        raw = raw if header else raw.toDF(*(f"COL{k + 1}" for k in range(len(raw.columns))))
        kinds = ("long", "double")
        fits = raw.agg(*(F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(k).isNotNull()).alias(f"{n}_{k}") for n, c in enumerate(raw.columns) for k in kinds)).head()
        first = raw.limit(1).collect()

        def kind(n: int, x) -> str:
            for k, cast in zip(kinds, (int, float)):
                try:
                    cast(x)
                except (TypeError, ValueError):
                    continue
                if fits[f"{n}_{k}"]:
                    return k
            return "string"

        names = {c: kind(n, first[0][c]) if first else "string" for n, c in enumerate(raw.columns)}
        self.create_table(name, raw.select(*(F.col(f"`{c}`").try_cast(k).alias(c) for c, k in names.items())))

    def export_csv(self, name: str, path: str) -> None:
        self.table(name).write.option("header", True).option("quoteAll", True).csv(path)
