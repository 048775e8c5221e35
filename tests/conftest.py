"""One local session for all tests, and the comparison with DuckDB."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(x):
    """A value that compares alike from both engines."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def sorted_rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql():
    """Asserts that a DataFrame has the rows that DuckDB gives for a query on the same tables."""
    import duckdb

    def check(df, sql: str, sf_dir: str) -> int:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for file in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted_rows(names, found.fetchall())
        got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
        assert sorted(df.columns) == sorted(names)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a == b
        return len(got)

    return check
