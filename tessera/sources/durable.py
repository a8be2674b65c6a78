"""Tables kept between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where the session names none, a local one in local mode, refused elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


class Kept:
    """Parquet tables of one run: a table written here is read by later steps, so nothing before it is done twice."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_folder(spark), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
