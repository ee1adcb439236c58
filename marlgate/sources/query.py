"""Read-only access to a lake: structured queries and SQL, both lazy DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlgate.sources.registry import ROLES, Table, table_of

# Logical nodes that change something or run a command.
FORBIDDEN = ("Insert", "Create", "Drop", "Alter", "Delete", "Update", "Merge", "Replace", "Truncate", "Load", "Set", "Reset", "Cache", "Uncache", "Refresh", "Repair", "Analyze", "Append", "Overwrite", "Add", "Rename", "Call", "Use", "Execute", "Clear", "Recover", "Comment", "Script")
READING = ("ShowTables", "ShowColumns", "DescribeRelation", "DescribeQuery", "Explain", "ShowViews", "ShowNamespaces", "ShowFunctions", "DescribeColumn", "DescribeFunction")


def select_rows(
    df: DataFrame, fields: str | Sequence[str] | None = None, filters: Mapping[str, object] | None = None, start: str | None = None, end: str | None = None,
    limit: int | None = None, date_column: str | None = None, order: Sequence[str] = (),
) -> DataFrame:
    """Projection, equality or membership filters, an inclusive date range, an order and a limit after it.

    A filter of None matches nothing, as in SQL; an empty list gives no rows. With a ``year`` partition the range also
    prunes partitions. Unknown fields, a range without a date column and a negative limit are errors.
    """
    chosen = [f.strip() for f in fields.split(",")] if isinstance(fields, str) else list(fields) if fields is not None else df.columns
    unknown = [c for c in [*chosen, *(filters or {})] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    for name, value in (filters or {}).items():
        if isinstance(value, (list, tuple, set, frozenset)):
            df = df.where(F.col(name).isin(list(value))) if value else df.where(F.lit(False))
        else:
            df = df.where(F.col(name) == F.lit(value))
    if start is not None or end is not None:
        if date_column is None:
            raise ValueError("this table has no date column")
        for bound, compare in ((start, Column.__ge__), (end, Column.__le__)):
            if bound is not None:
                df = df.where(compare(F.col(date_column), F.lit(bound)))
                year = next((p for p in ("year", "report_year") if p in df.columns), None)
                if year and isinstance(bound, str) and bound[:4].isdigit():
                    df = df.where(compare(F.col(year), F.lit(int(bound[:4]))))
    by = [c for c in order if c in df.columns]
    df = df.orderBy(*by) if by else df
    if limit is not None:
        if limit < 0:
            raise ValueError("a limit can't be negative")
        df = df.limit(limit)
    return df.select(*[F.col(f"`{c}`") for c in chosen])


def check_read_only(spark: SparkSession, text: str) -> None:
    """Refuse a statement whose parsed plan, or any plan inside it, writes or runs a command."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if not name.startswith(READING) and (name.startswith(FORBIDDEN) or name.endswith("Command") or name.endswith("Statement")):
            raise PermissionError(f"only reading statements are allowed, not {name}")
        for children in (node.children(), node.innerChildren()):
            items = children.iterator()
            while items.hasNext():
                child = items.next()
                if hasattr(child, "children") and "logical" in child.getClass().getName() or "catalyst.analysis" in child.getClass().getName():
                    waiting.append(child)


class LocalData:
    """The lake under a folder: ``<folder>/<path>`` holds each table as (partitioned) Parquet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        spec = table_of(name)
        reader = self.spark.read
        if not spec.open_measures:
            schema = spec.schema()
            for p in spec.partition:
                if p not in schema.names:
                    schema = schema.add(p, T.IntegerType())
            reader = reader.schema(schema)
        return reader.parquet(f"{self.folder}/{spec.path}")

    def role(self, name: str) -> DataFrame:
        """Stock and fund tables of one kind together."""
        frames = [self.read(t) for t in ROLES[name]]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def query(self, name: str, fields=None, filters=None, start=None, end=None, limit=None) -> DataFrame:
        spec = table_of(name)
        order = [c for c in (spec.date_column, "ts_code") if c and c in spec.columns]
        return select_rows(self.read(name), fields if fields is not None else [*spec.columns], filters, start, end, limit, spec.date_column, order)

    def register(self, names: Sequence[str]) -> None:
        for name in names:
            self.read(name).createOrReplaceTempView(name)

    def sql(self, text: str, args: list | dict | None = None) -> DataFrame:
        check_read_only(self.spark, text)
        return self.spark.sql(text, args=args) if args is not None else self.spark.sql(text)


def inventory(frames: Mapping[str, tuple[DataFrame, Table]]) -> list[DataFrame]:
    """For each table: rows, first and last date, by partition."""
    out = []
    for name, (df, spec) in frames.items():
        date = F.col(spec.date_column) if spec.date_column else F.lit(None).cast("string")
        out.append(df.groupBy(*[p for p in spec.partition if p in df.columns]).agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date")).withColumn("table_name", F.lit(name)))
    return out
