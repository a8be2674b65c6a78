"""Keyed upserts, change detection, orphans, and decisions what to make anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.corpus import depth, excluded
from tessera.operators.summaries import directory_signature_deep
from tessera.operators.symbols import last_wins

__all__ = ["last_wins", "upsert", "delete", "replace_by", "changed_files", "changed_directories", "needs_synthesis", "with_placeholders", "orphans", "cleanup_counts", "notes_for", "newer_notes", "list_notes", "job_states", "cancel", "sweep_orphans", "recent_jobs", "mismatch", "mismatches"]


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in by key: an anti-join and a union; rows must hold a key once (see last_wins)."""
    return table.join(rows.select(*keys), keys, "left_anti").select(rows.columns).unionByName(rows)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    """table without the rows whose key is in keys."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def replace_by(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with everything under the keys of rows replaced by rows: a file's issues or index entries."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(table.columns).unionByName(rows.select(table.columns))


def newer_notes(notes: DataFrame, pages: DataFrame, *, any_scope: bool = False) -> DataFrame:
    """(target) pages with a note on them written after they were made. A page's scope is its type, unless any scope counts."""
    match = (pages["target"] == notes["target"]) & (notes["updated_at"] > pages["generated_at"])
    if not any_scope:
        match = match & (pages["type"] == notes["scope"])
    return pages.join(notes, match, "left_semi").select("target", "type")


def changed_files(files: DataFrame, pages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """files (path, hash) with `regenerate` and `reason`: no page yet, another hash, or a newer note."""
    stored = pages.where(F.col("type") == "file").select(F.col("target").alias("path"), F.col("source_hash").alias("_stored"), F.lit(True).alias("_page"))
    out = files.join(stored, "path", "left")
    if notes is not None:
        fresh = newer_notes(notes, pages).where(F.col("type") == "file").select(F.col("target").alias("path"), F.lit(True).alias("_note")).distinct()
        out = out.join(fresh, "path", "left")
    else:
        out = out.withColumn("_note", F.lit(None).cast("boolean"))
    reason = F.when(F.col("_page").isNull(), "new").when(~F.col("_stored").eqNullSafe(F.col("hash")), "changed").when(F.col("_note"), "note").otherwise("unchanged")
    return out.withColumn("reason", reason).withColumn("regenerate", F.col("reason") != "unchanged").drop("_stored", "_page", "_note")


def changed_directories(files: DataFrame, summaries: DataFrame, pages: DataFrame) -> DataFrame:
    """(directory, signature, regenerate, depth): directories whose files or children's purposes differ from what their page was made of; deepest first."""
    now = directory_signature_deep(files, summaries)
    stored = pages.where(F.col("type") == "directory").select(F.col("target").alias("directory"), F.col("source_hash").alias("_stored"))
    out = now.join(stored, "directory", "left").withColumn("regenerate", ~F.col("_stored").eqNullSafe(F.col("signature"))).drop("_stored")
    return out.withColumn("depth", depth(F.col("directory"))).orderBy(F.desc("depth"), "directory")


def needs_synthesis(files: DataFrame, directories: DataFrame, has_synthesis: bool) -> DataFrame:
    """One row (regenerate): anything was made anew, or there is no synthesis yet."""
    both = files.select("regenerate").union(directories.select("regenerate"))
    return both.agg(F.coalesce(F.bool_or("regenerate"), F.lit(False)).alias("any")).select((F.col("any") | F.lit(not has_synthesis)).alias("regenerate"))


def with_placeholders(fresh: DataFrame, skipped: DataFrame) -> DataFrame:
    """fresh summaries and, for skipped files, rows of their stored purpose and layer (utility without) and no dependencies."""
    none = F.array().cast("array<string>")
    rows = skipped.select("file_path", "purpose", F.coalesce("layer", F.lit("utility")).alias("layer"), none.alias("key_abstractions"), none.alias("internal_deps"), none.alias("external_deps"))
    return fresh.unionByName(rows)


def orphans(pages: DataFrame, sources: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Pages whose source (column `source`) is gone from sources (path) or is excluded now; pages that name no source stay."""
    named = pages.where(F.col("source").isNotNull())
    gone = named.join(sources.select(F.col("path").alias("source")), "source", "left_anti")
    if patterns:
        gone = gone.unionByName(named.join(sources.select(F.col("path").alias("source")), "source", "left_semi").where(excluded(F.col("source"), patterns)))
    return gone


def cleanup_counts(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(type, deleted): orphans by type, and all workflow pages, which are always made anew."""
    rows = gone.select("type").unionAll(pages.where(F.col("type") == "workflow").select("type"))
    return rows.groupBy("type").agg(F.count("*").alias("deleted"))


def notes_for(notes: DataFrame, scope: str, target: str) -> DataFrame:
    """Notes on a target, and general ones; newest first."""
    return notes.where(((F.col("scope") == scope) & (F.col("target") == target)) | (F.col("scope") == "general")).orderBy(F.desc("updated_at"), F.desc("seq"))


def list_notes(notes: DataFrame, scope: str | None = None) -> DataFrame:
    rows = notes if scope is None else notes.where(F.col("scope") == scope)
    return rows.orderBy(F.desc("updated_at"), F.desc("seq"))


def job_states(events: DataFrame, order: list[str], key: str = "id") -> DataFrame:
    """The latest row of each job: one aggregate with partial maxima, no sort."""
    others = [c for c in events.columns if c not in (key, *order)]
    newest = F.max(F.struct(*order, *others)).alias("_s")
    return events.groupBy(key).agg(newest).select(key, *(F.col(f"_s.{c}").alias(c) for c in (*order, *others)))


def cancel(states: DataFrame, job: str, now: Column) -> DataFrame:
    """The row that cancels a job, to be appended; none if it is unknown or has ended."""
    return states.where((F.col("id") == job) & F.col("status").isin("pending", "running")).withColumn("status", F.lit("cancelled")).withColumn("completed_at", now)


def sweep_orphans(states: DataFrame, now: Column) -> DataFrame:
    """states in which jobs left pending or running by a stopped process have failed."""
    open_ = F.col("status").isin("pending", "running")
    return states.withColumn("error_message", F.when(open_, "interrupted by restart").otherwise(F.col("error_message"))).withColumn("completed_at", F.when(open_, now).otherwise(F.col("completed_at"))).withColumn("status", F.when(open_, "failed").otherwise(F.col("status")))


def recent_jobs(states: DataFrame, n: int = 20) -> DataFrame:
    return states.orderBy(F.desc("started_at"), "id").limit(n)


def mismatch(stored: DataFrame, provider: str, model: str) -> DataFrame:
    """One row (mismatch): the index was made by another provider or model; false without an index."""
    different = ~(F.col("provider").eqNullSafe(F.lit(provider)) & F.col("model").eqNullSafe(F.lit(model)))
    return stored.agg(F.coalesce(F.bool_or(different), F.lit(False)).alias("mismatch"))


def mismatches(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mismatch) for each row of wanted (keys, provider, model): its index (keys, provider, model) was made by another; false without one."""
    held = stored.select(*keys, F.struct("provider", "model").alias("_held"))
    other = F.col("_held").isNotNull() & ~F.struct("provider", "model").eqNullSafe(F.col("_held"))
    return wanted.join(held, keys, "left").select(*keys, other.alias("mismatch"))
