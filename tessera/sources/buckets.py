"""Keyed tables in buckets: an upsert rewrites the buckets of its keys only, and takes effect all at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.versions import Versions

#: Buckets of a new table. A bucket is what an upsert of one row reads and writes; choose them so that each has a few files.
BUCKETS = 64


class BucketTable:
    """Rows under keys, in buckets by a hash of the key. A version names the folder that holds each bucket."""

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.versions = Versions(spark, root)
        self._new = buckets

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _stored(self, entries: dict, buckets: list[int] | None = None) -> DataFrame:
        held = entries.get("held", {})
        of = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in held.items() if buckets is None or int(b) in buckets]
        if not of:
            return self.spark.createDataFrame([], self.schema)
        # Columns that an older bucket lacks are null.
        return self.spark.read.schema(self.schema).parquet(*of)

    def read(self, version: int | None = None) -> DataFrame:
        return self._stored(self.versions.read(version)[1])

    def _touched(self, keys: DataFrame, n: int) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(n)).distinct().collect())

    def _replace(self, version: int, entries: dict, buckets: list[int], rows: DataFrame) -> int:
        n, folder = entries["buckets"], uuid.uuid4().hex
        to = f"{self.root}/data/{folder}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("bucket", self._bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(to)
        fs, _ = self.versions.path(to)
        held = {b: f for b, f in entries["held"].items() if int(b) not in buckets}
        # A bucket that lost its last row has no folder.
        held |= {str(b): folder for b in buckets if fs.exists(self.versions.path(f"{to}/bucket={b}")[1])}
        return self.versions.commit(version, {"buckets": n, "held": held})

    def _open(self) -> tuple[int, dict]:
        version, entries = self.versions.read()
        return version, entries or {"buckets": self._new, "held": {}}

    def upsert(self, rows: DataFrame) -> int:
        """Put rows in by key and return the version; rows hold a key once. Other buckets are neither read nor written."""
        version, entries = self._open()
        buckets = self._touched(rows, entries["buckets"])
        if not buckets:
            return version
        kept = self._stored(entries, buckets).join(rows.select(*self.keys), self.keys, "left_anti")
        return self._replace(version, entries, buckets, kept.select(rows.columns).unionByName(rows) if set(rows.columns) == set(self.schema.names) else kept.unionByName(rows, allowMissingColumns=True))

    def delete(self, keys: DataFrame) -> int:
        """Take out the rows whose keys, or whose values in those columns of keys that keys has, are in keys."""
        version, entries = self._open()
        whole = set(self.keys) <= set(keys.columns)
        buckets = self._touched(keys, entries["buckets"]) if whole else [int(b) for b in entries["held"]]
        buckets = [b for b in buckets if str(b) in entries["held"]]
        if not buckets:
            return version
        kept = self._stored(entries, buckets).join(keys.distinct(), keys.columns, "left_anti")
        return self._replace(version, entries, buckets, kept)

    def replace_under(self, column: str, owners: DataFrame, rows: DataFrame) -> int:
        """Everything under the owners (one column) gives way to rows, in one version: a file's issues, symbols or chunks.

        The column has to be the first key; where it is the only part of the key that is hashed, nothing else is touched.
        """
        version, entries = self._open()
        if self.keys != [column]:
            raise ValueError(f"{column} is not what rows are dealt by")
        buckets = self._touched(owners.select(column), entries["buckets"])
        if not buckets:
            return version
        kept = self._stored(entries, buckets).join(owners.select(column).distinct(), column, "left_anti")
        return self._replace(version, entries, buckets, kept.unionByName(rows.join(owners.select(column).distinct(), column, "left_semi"), allowMissingColumns=True))

    def vacuum(self, keep: int = 1) -> int:
        """Delete the files that none of the last `keep` versions names."""
        named = {f for entries in self.versions.forget(keep) for f in entries["held"].values()}
        return self.versions.sweep("data", named)
