"""Tables of an SQLite file as DataFrames: ranges of row ids are read by tasks of their own."""

from __future__ import annotations

import contextlib
import sqlite3
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that one task reads, about; rows are handed on in batches of BATCH.
ROWS_PER_TASK, BATCH = 200_000, 5000


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_names(path: str) -> list[str]:
    with contextlib.closing(_open(path)) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]


def _kind(declared: str) -> T.DataType:
    """The type of a column by what its declaration says, as SQLite's affinities go."""
    low = declared.lower()
    if "int" in low or "bool" in low:
        return T.LongType()
    if "char" in low or "clob" in low or "text" in low or "date" in low or "time" in low:
        return T.StringType()
    if "blob" in low:
        return T.BinaryType()
    return T.DoubleType() if any(x in low for x in ("real", "floa", "doub", "num", "dec")) else T.StringType()


def read_table(spark: SparkSession, path: str, table: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows of a table with row ids. The path has to be one that executors see too; the file is opened for reading only.

    Columns get the type that they are declared with; a value of another type becomes null, a declared time stays text.
    """
    with contextlib.closing(_open(path)) as db:
        columns = db.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
        if not columns:
            raise ValueError(f"no table {table!r} in {path}")
        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
    schema = T.StructType([T.StructField(c[1], _kind(c[2])) for c in columns])
    if low is None:
        return spark.createDataFrame([], schema)
    kinds = {T.LongType: int, T.StringType: str, T.BinaryType: bytes, T.DoubleType: (int, float)}
    wanted = [kinds[type(f.dataType)] for f in schema]
    floats = [isinstance(f.dataType, T.DoubleType) for f in schema]
    query = f"SELECT {', '.join(_quoted(c[1]) for c in columns)} FROM {_quoted(table)} WHERE rowid BETWEEN ? AND ?"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in batch["id"]:
                with contextlib.closing(_open(path)) as db:
                    found = db.execute(query, (int(start), int(start) + rows_per_task - 1))
                    while rows := found.fetchmany(BATCH):
                        typed = [[(float(v) if real else v) if isinstance(v, kind) else None for v in column] for column, kind, real in zip(zip(*rows, strict=True), wanted, floats, strict=True)]
                        yield pd.DataFrame({f.name: pd.Series(v, dtype=object) for f, v in zip(schema, typed, strict=True)})

    tasks = (high - low) // rows_per_task + 1
    return spark.range(low, high + 1, rows_per_task, numPartitions=min(tasks, 10_000)).select(F.col("id")).mapInPandas(read, schema)
