"""Writers: tables under a warehouse root, staging and promotion, graphs, syntheses and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.schemas import empty


class Warehouse:
    """Parquet tables of one repository below a root. All paths go through Hadoop's file systems, so any store will do."""

    def __init__(self, spark: SparkSession, root: str, repo: str = "default"):
        if any(part in ("", ".", "..") for part in repo.split("/")) or repo.startswith("/"):
            raise ValueError(f"unsafe repository path {repo!r}")
        self.spark, self.base = spark, f"{root.rstrip('/')}/{repo}"
        self.live, self.staging = f"{self.base}/live", f"{self.base}/_staging"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def remove(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.delete(p, True)

    def read(self, table: str, staged: bool = False) -> DataFrame:
        """A table, or an empty one. Where a swap was stopped halfway, what stands aside is read."""
        base = self.staging if staged else self.live
        if not self.exists(base) and self.exists(f"{base}__old"):
            base = f"{base}__old"
        path = f"{base}/{table}"
        if not self.exists(path) and self.exists(f"{path}__old"):
            path = f"{path}__old"
        return self.spark.read.option("mergeSchema", "true").parquet(path) if self.exists(path) else empty(self.spark, table)

    def write(self, df: DataFrame, table: str, *, staged: bool = False, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
        """Write a table. What is read from the table itself goes to a new folder first, so a failed job leaves the old one."""
        path = f"{self.staging if staged else self.live}/{table}"
        if mode == "append":
            df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)
            return
        fresh = f"{path}__new"
        df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(fresh)
        self._swap(fresh, path)

    def _swap(self, fresh: str, path: str) -> None:
        """fresh takes the place of path. What was there stands aside until then: a stop in between loses neither."""
        fs, new = self._fs(fresh)
        _, old = self._fs(path)
        _, aside = self._fs(f"{path}__old")
        if fs.exists(old):
            fs.delete(aside, True)
            if not fs.rename(old, aside):
                raise OSError(f"{path} can't be moved")
        if not fs.rename(new, old):
            if fs.exists(aside):
                fs.rename(aside, old)
            raise OSError(f"{fresh} can't be moved")
        fs.delete(aside, True)

    def replace_partitions(self, df: DataFrame, table: str, key: str) -> None:
        """Overwrite only the partitions of the keys in df."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{self.live}/{table}")

    def clear(self, *tables: str) -> None:
        for table in tables:
            self.remove(f"{self.live}/{table}")

    def prepare_staging(self) -> None:
        """An empty staging area with a copy of what is live."""
        self.remove(self.staging)
        fs, live = self._fs(self.live)
        _, staging = self._fs(self.staging)
        if fs.exists(live):
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, live, fs, staging, False, True, self.spark._jsc.hadoopConfiguration())
        else:
            fs.mkdirs(staging)

    def promote(self) -> None:
        """Staging becomes live; what was live goes when it has."""
        self._swap(self.staging, self.live)

    def save_embedding_model(self, provider: str, model: str) -> None:
        """Remember what the vectors were made by, and when."""
        row = self.spark.createDataFrame([(provider, model)], "provider string, model string")
        self.write(row.withColumn("indexed_at", F.current_timestamp()), "embedding_model")

    def embedding_model(self) -> DataFrame:
        """(provider, model, indexed_at): one row, or none."""
        return self.read("embedding_model")

    def forget_embedding_model(self) -> None:
        self.clear("embedding_model")

    def incomplete(self) -> bool:
        """A staging area is left: a build did not end."""
        return self.exists(self.staging)


def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Nodes by id and edges by ends, as JSON lines, and one row of counts."""
    nodes.orderBy("id").write.mode("overwrite").json(f"{root}/nodes")
    edges.orderBy("source", "target").write.mode("overwrite").json(f"{root}/edges")
    counts = nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))
    counts.withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").json(f"{root}/metadata")


def synthesis_row(parts: DataFrame) -> DataFrame:
    """(content, hash) of one synthesis row: its JSON and the first 16 hex digits of that text's SHA-256."""
    content = F.to_json(F.struct(*parts.columns))
    return parts.select(content.alias("content"), F.substring(F.sha2(content, 256), 1, 16).alias("hash"))


def read_synthesis(rows: DataFrame, ddl: str) -> DataFrame:
    """The columns of ddl from rows (content, hash) that synthesis_row made; rows whose JSON is broken or has another hash are left out."""
    own = F.substring(F.sha2(F.col("content"), 256), 1, 16) == F.col("hash")
    return rows.where(own).select(F.from_json("content", ddl).alias("s")).where("s is not null").select("s.*")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)
