"""A build of a knowledge base from a tree of files: the phases in order, each a table of the warehouse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import chunking, corpus, incremental, parsing, symbols
from tessera.operators.segments import SegmentedIndex
from tessera.params import DEFAULT, Params
from tessera.schemas import TABLES, conform
from tessera.sources.buckets import BucketTable
from tessera.sources.durable import Kept
from tessera.sources.sinks import Warehouse

PHASES = ("scan", "parse", "graph", "pages", "cleanup", "index")
PageWriter = Callable[[DataFrame, DataFrame], DataFrame]
Embed = Callable[[DataFrame], DataFrame]
Progress = Callable[[str, int, int], None]


def begin(store: Warehouse, mode: str, job: DataFrame) -> None:
    """Staging of a build: empty for a full one, what is live for an incremental one; the build's job row is in it either way."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    jobs = store.read("jobs")
    if mode == "full":
        jobs = jobs.limit(0)
        store.remove(store.staging)
    else:
        store.prepare_staging()
    store.write(incremental.upsert(jobs, conform(job, "jobs"), ["id"]), "jobs", staged=True)


def choose_mode(store: Warehouse, wanted: str | None = None) -> str:
    """incremental where pages of an earlier build are live, unless full is wanted; a first build is full."""
    if wanted == "full" or store.read("pages").isEmpty():
        return "full"
    return "incremental"


def cleanup(pages: DataFrame, sources: DataFrame, notes: DataFrame, patterns: list[str] | None = None) -> dict[str, DataFrame]:
    """pages and notes without orphans and workflow pages, and counts of what went by type (notes as `note`).

    An orphan's source (of a page) or target (of a file's note) is gone from sources, or excluded now.
    """
    gone = incremental.orphans(pages, sources, patterns)
    kept = pages.where(~F.col("type").eqNullSafe("workflow")).join(gone.select("path"), "path", "left_anti")
    lost = incremental.orphans(notes.where("scope = 'file'").withColumn("source", F.col("target")), sources, patterns)
    left = notes.join(lost.select("scope", "target"), ["scope", "target"], "left_anti")
    counts = incremental.cleanup_counts(pages, gone.where(~F.col("type").eqNullSafe("workflow")))
    counts = counts.unionByName(lost.agg(F.lit("note").alias("type"), F.count("*").alias("deleted")).where("deleted > 0"))
    return {"pages": kept, "notes": left, "counts": counts}


def parse_changed(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """texts (file_path, content, source_hash) parsed; rows of an earlier build whose file has the same hash are taken over."""
    if "source_hash" not in stored.columns:
        return parsing.parse(texts).join(texts.select("file_path", "source_hash"), "file_path")
    same = stored.join(texts.select("file_path", "source_hash"), ["file_path", "source_hash"], "left_semi")
    fresh = texts.join(stored.select("file_path", "source_hash"), ["file_path", "source_hash"], "left_anti")
    return same.unionByName(parsing.parse(fresh).join(fresh.select("file_path", "source_hash"), "file_path"))


def code_index(found: DataFrame, refs: DataFrame, texts: DataFrame) -> DataFrame:
    """The code index of symbols with ids and references as parsed."""
    scope = F.element_at(F.split(F.substring_index("source", "::", -1), r"\."), -1)
    calls = refs.where("reference_type = 'calls'").select("file_path", scope.alias("symbol_name"), F.element_at(F.split("target", r"\."), -1).alias("callee"), "ordinal")
    hashed = found.join(texts.select("file_path", "source_hash"), "file_path")
    return symbols.build_index(hashed.withColumnRenamed("source_hash", "_hash"), calls, F.col("_hash"))


def page_index(store: Warehouse) -> SegmentedIndex:
    """The full-text index of a warehouse's pages."""
    return SegmentedIndex(store.spark, f"{store.base}/index")


def chunk_table(store: Warehouse) -> BucketTable:
    return BucketTable(store.spark, f"{store.base}/chunks", TABLES["chunks"], ["path"])


def vector_table(store: Warehouse) -> BucketTable:
    return BucketTable(store.spark, f"{store.base}/vectors", TABLES["vectors"], ["path"])


def update_index(store: Warehouse, params: Params = DEFAULT, embed: Embed | None = None) -> int:
    """Bring chunks, vectors and the index up to the pages that are live: what is new or changed goes in, lost pages go out.

    What changed is seen by comparing pages with what the index holds, and the index comes last: a build that stopped before
    is made up for. Only buckets and segments of those pages are written. `embed` gives (chunk_id, embedding) for chunks.
    """
    index, pages = page_index(store), store.read("pages").where("path is not null and content is not null")
    held = pages.select("path", fn.content_hash(F.col("content")).alias("hash"))
    keep = Kept(store.spark)
    stale, gone = (keep(x) for x in index.changes(held))
    changed = held.join(stale, "path", "left_semi")
    chunks = keep(chunking.chunk_pages(pages.join(stale, "path", "left_semi").select("path", "content"), params=params))
    touched = stale.union(gone)
    chunk_table(store).replace_under("path", touched, chunks)
    if embed is not None:
        made = embed(chunks.select("chunk_id", "content")).select(F.col("chunk_id").alias("id"), "embedding")
        rows = chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("document"), "type", "path", "title").join(made, "id")
        vector_table(store).replace_under("path", touched, rows)
    return index.update(chunks, changed, gone)


def record_progress(store: Warehouse, job_id: str) -> Progress:
    """A callback that appends (id, phase, step, total, at) to a build's feed, which jobs.read_progress reads as a stream."""

    def tell(phase: str, step: int, total: int) -> None:
        row = store.spark.range(1).select(F.lit(job_id).alias("id"), F.lit(phase).alias("phase"), F.lit(step).alias("step"), F.lit(total).alias("total"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(f"{store.base}/progress")

    return tell


def run(
    spark: SparkSession,
    store: Warehouse,
    files: DataFrame,
    job: DataFrame,
    *,
    wanted: str | None = None,
    user_patterns: list[str] | None = None,
    page_of: PageWriter | None = None,
    embed: Embed | None = None,
    progress: Progress | None = None,
    params: Params = DEFAULT,
) -> DataFrame:
    """Build staging from files (path, length, content), promote it, bring the index up to it, and return counts of the cleanup.

    Every phase writes its table and the next one reads that: nothing is parsed twice, and a lost executor costs one phase.
    `page_of` makes pages (columns of the table pages) from (file_path, content, source_hash) of files and their parsed rows:
    it gets the files whose page is missing, of another hash or older than a note, all of them in a full build. An
    incremental build parses changed files only, and the index writes changed pages only. `progress` is told each phase.
    """
    tell = progress or (lambda *_: None)
    tell("scan", 0, len(PHASES))
    mode = choose_mode(store, wanted)
    begin(store, mode, job)
    # Texts are tested and hashed once: all phases need their hashes, two need what they hold.
    keep = Kept(spark)
    texts = corpus.included(files, user_patterns, params).select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"))
    texts = keep(texts.withColumn("source_hash", fn.content_hash(F.col("content"))))
    tell("parse", 1, len(PHASES))
    store.write(parse_changed(texts, store.read("parsed", staged=True)), "parsed", staged=True)
    parsed = store.read("parsed", staged=True)
    tell("graph", 2, len(PHASES))
    found = symbols.with_node_id(parsing.symbols_of(parsed))
    store.write(conform(found, "symbols"), "symbols", staged=True)
    named = found.select("id", "name", F.when(F.col("parent").isNotNull(), F.concat_ws(".", "parent", "name")).otherwise(F.col("name")).alias("qualified"))
    refs = symbols.resolve(parsing.references_of(parsed), named)
    nodes, edges = symbols.build_graph(found, refs, [F.col("line"), F.col("ordinal")])
    store.write(conform(nodes, "nodes"), "nodes", staged=True)
    store.write(conform(edges, "edges"), "edges", staged=True)
    store.write(conform(code_index(found, parsing.references_of(parsed), texts), "code_index"), "code_index", staged=True)
    tell("pages", 3, len(PHASES))
    if page_of is not None:
        pages, notes = store.read("pages", staged=True), store.read("notes", staged=True)
        wanted_pages = incremental.changed_files(texts.select(F.col("file_path").alias("path"), F.col("source_hash").alias("hash")), pages, notes).where("regenerate").select(F.col("path").alias("file_path"))
        made = keep(conform(page_of(texts.join(wanted_pages, "file_path", "left_semi"), parsed), "pages"))
        store.write(incremental.upsert(pages, made, ["path"]), "pages", staged=True)
    tell("cleanup", 4, len(PHASES))
    done = cleanup(store.read("pages", staged=True).withColumn("source", F.when(F.col("type") == "file", F.col("target"))), texts.select(F.col("file_path").alias("path")), store.read("notes", staged=True), user_patterns)
    # Counts come of both tables as they were, so they are written first.
    for table in ("counts", "pages", "notes"):
        rows = done[table]
        store.write(conform(rows, table) if table != "counts" else rows, table, staged=True)
    store.promote()
    tell("index", 5, len(PHASES))
    update_index(store, params, embed)
    tell("done", len(PHASES), len(PHASES))
    return store.read("counts")
