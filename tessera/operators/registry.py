"""Repositories and settings as keyed tables: each change is a new table made from the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.incremental import delete, upsert

# What an update of a repository may change.
UPDATABLE = [
    "display_name", "head_commit", "branch", "last_pulled", "last_generated", "generation_duration_secs", "files_processed", "pages_generated",
    "generation_provider", "generation_model", "embedding_provider", "embedding_model", "status", "error_message",
]


def add_repos(repos: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """repos with new (origin_url, source_type, local_path, display_name); ids go on from the largest there is.

    Addresses are unique: a new row whose address is known, or comes again later in order of addresses and paths, is left out.
    """
    # A registry's new rows come from a person, a few at a time: one window over them is no bottleneck.
    first = F.row_number().over(Window.partitionBy("origin_url").orderBy("local_path", "display_name"))
    fresh = new.withColumn("_n", first).where("_n = 1").join(repos.select("origin_url"), "origin_url", "left_anti")
    last = repos.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = fresh.crossJoin(F.broadcast(last)).withColumn("id", F.col("_last") + F.row_number().over(Window.orderBy("origin_url")))
    given = ["id", "origin_url", "source_type", "local_path", "display_name"]
    other = {"created_at": now, "status": F.lit("pending")}
    made = numbered.select(*(F.col(f.name).cast(f.dataType) if f.name in given else other.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in repos.schema))
    return repos.unionByName(made)


def get_repo(repos: DataFrame, repo_id: int) -> DataFrame:
    return repos.where(F.col("id") == repo_id)


def list_repos(repos: DataFrame) -> DataFrame:
    return repos.orderBy("created_at", "id")


def find_by_url(repos: DataFrame, origin_url: str) -> DataFrame:
    return repos.where(F.col("origin_url") == origin_url)


def update_repo(repos: DataFrame, repo_id: int, **fields) -> DataFrame:
    """repos with fields of one of them changed; only UPDATABLE ones that the table has, others are passed over."""
    types = {f.name: f.dataType for f in repos.schema}
    own = F.col("id") == repo_id
    return repos.withColumns({k: F.when(own, (v if isinstance(v, Column) else F.lit(v)).cast(types[k])).otherwise(F.col(k)) for k, v in fields.items() if k in UPDATABLE and k in types})


def delete_repo(repos: DataFrame, repo_id: int) -> DataFrame:
    return repos.where(~F.col("id").eqNullSafe(repo_id))


def set_settings(settings: DataFrame, rows: DataFrame) -> DataFrame:
    """settings (key, value) with rows put in by key; of a key that rows hold twice the last by `seq` counts, if there is one."""
    if "seq" in rows.columns:
        rows = rows.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return upsert(settings.select(rows.columns), rows, ["key"])


def get_setting(settings: DataFrame, key: str) -> DataFrame:
    """(value): one row, or none."""
    return settings.where(F.col("key") == key).select("value")


def delete_settings(settings: DataFrame, keys: DataFrame) -> DataFrame:
    return delete(settings, keys.select("key"))


def active_repo(settings: DataFrame, repos: DataFrame, key: str = "active_repo_id") -> DataFrame:
    """The record of the repository that a setting names; none without the setting or the record."""
    return repos.join(get_setting(settings, key).select(F.col("value").cast("bigint").alias("id")), "id", "left_semi")
