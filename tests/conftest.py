from __future__ import annotations

import os
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from marlgate.session import local_session

    session = local_session(cores=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def plain(value):
    if value is None or value != value:
        return None
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def spark_rows(frame) -> Counter:
    names = sorted(frame.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in frame.collect())


def sql_rows(folder: str, text: str) -> Counter:
    import duckdb

    connection = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        path = os.path.join(folder, file)
        inside = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS FROM read_parquet('{inside}')")
    cursor = connection.execute(text)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def variant(folder: str, kind: str, tables: list[str]) -> str:
    """Copies of the test tables that strain operators: ``empty``, ``nulls`` (each column null once), ``doubled``, ``clash``."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    for name in tables:
        rows = pq.read_table(f"{DATA}/{name}.parquet")
        if kind == "empty":
            rows = rows.slice(0, 0)
        elif kind == "nulls":
            base, parts = rows.slice(0, 400), [rows.slice(0, 400)]
            for i, field in enumerate(rows.schema):
                piece = base.slice(7 * i % 300, 3)
                parts.append(piece.set_column(i, field, pa.nulls(len(piece), field.type)))
            parts.append(pa.table({f.name: pa.nulls(2, f.type) for f in rows.schema}, schema=rows.schema))
            rows = pa.concat_tables(parts)
        elif kind == "doubled":
            rows = pa.concat_tables([rows, rows.slice(0, 200)])
        elif kind == "clash":
            names = ["day", "price", "series", "snapshot", "item", "n", "x", "v", "k", "leaf", "range", "covered", "saved", "window", "fill", "shard", "size", "key", "uses", "kind", "load", "rows", "column", "value", "bucket", "place", "_n", "q", "f", "found", "number", "unit", "fold", "levels", "low", "high", "ref", "count"]
            for extra in names:
                if extra not in rows.column_names:
                    rows = rows.append_column(extra, pa.array(["clash"] * len(rows)))
        pq.write_table(rows, os.path.join(folder, f"{name}.parquet"))
    return folder
