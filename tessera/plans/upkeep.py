"""Queries of what is kept up to date: the index in segments, builds, bucketed tables, migrations and sessions as a stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import search
from tessera.operators.segments import SegmentedIndex
from tessera.params import DEFAULT
from tessera.plans import build, catalog, pages, views
from tessera.plans.catalog import query
from tessera.plans.views import table
from tessera.schemas import TABLES, conform
from tessera.sources import migrations
from tessera.sources.buckets import BucketTable
from tessera.sources.durable import shared_folder
from tessera.sources.sinks import Warehouse
from tessera.streaming import sessions

# Documents as files: later some are changed and some are gone.
_THEN = "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'the thing ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM documents WHERE doc_id % 11 <> 0"
_MATCH = catalog._MATCH.replace("FROM documents", "FROM t")


def _then(spark, d):
    rows = table(spark, d, "documents").where("doc_id % 11 <> 0")
    return rows.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("the thing "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))))


_PAGE_PATH = "'files/' || source || '-' || lang || '-' || CAST(doc_id AS VARCHAR(20)) || '-py.md'"
_SCORE = catalog._SCORE.format(idf="ln((docs - n + 0.5) / (n + 0.5) + 1)")


@query(f"SELECT doc_id, round({_SCORE}, 6) AS score FROM c, s WHERE matches > 0", t=_THEN, m=_MATCH, c=catalog._COUNTED, s=catalog._STATS)
def fts_index_upkeep(spark, d):
    """Scores from an index of all documents after an update: changed texts indexed anew, lost ones out, the rest untouched."""
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/index", id_col="path", text_cols=("text",))
    rows = lambda df: df.select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    for now in (rows(table(spark, d, "documents")), rows(_then(spark, d))):
        held = now.select("path", fn.content_hash(F.col("text")).alias("hash"))
        stale, gone = index.changes(held)
        index.update(now, held.join(stale, "path", "left_semi"), gone)
    return index.bm25(catalog.PHRASE, clamp=False).select(F.col("id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT 'src/' || CAST(doc_id AS VARCHAR) || '.txt' AS target, sha256(text) AS source_hash, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version, true AS indexed FROM t", t=_THEN)
def incremental_build(spark, d):
    """Two builds of documents as files: which build made each file's page, and whether the index holds that page as it is."""
    store = Warehouse(spark, shared_folder(spark))
    files = lambda df: df.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text")).select("path", F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    for number, now in enumerate((table(spark, d, "documents"), _then(spark, d)), 1):
        job = spark.range(1).select(F.lit(f"j{number}").alias("id"), F.lit("build").alias("type"), F.lit("running").alias("status"))
        write = lambda texts, parsed, n=number: pages.file_pages(texts, parsed).withColumn("status", F.lit(str(n)))
        build.run(spark, store, files(now), job, page_of=write, params=replace(DEFAULT, max_file_size_kb=1 << 20, minified_line_length=1 << 30))
    made = store.read("pages").select("path", "target", "source_hash", F.col("status").cast("int").alias("version"), fn.content_hash(F.col("content")).alias("hash"))
    held = build.page_index(store).owners().select(F.col("owner").alias("path"), "hash", F.lit(True).alias("held"))
    return made.join(held, ["path", "hash"], "left").select("target", "source_hash", "version", F.coalesce("held", F.lit(False)).alias("indexed"))


@query("SELECT o_custkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'late' ELSE max(o_orderpriority) END AS content, count(*) AS n FROM orders WHERE o_custkey % 9 <> 4 GROUP BY o_custkey")
def bucket_upserts(spark, d):
    """A bucketed table after two upserts and a delete by key."""
    store = BucketTable(spark, f"{shared_folder(spark)}/t", "id long, content string, n long", ["id"], buckets=16)
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("content"), F.count("*").alias("n"))
    store.upsert(rows)
    store.upsert(rows.where("id % 5 = 0").withColumn("content", F.lit("late")))
    store.delete(rows.where("id % 9 = 4").select("id"))
    return store.read()


@query("SELECT path, target, source_hash, CAST(doc_id % 2 AS VARCHAR) AS layer, strpos(text, chr(10) || '---' || chr(10)) > 0 AS cut FROM (SELECT 'files/' || source || '-' || lang || '-' || CAST(doc_id AS VARCHAR) || '-py.md' AS path, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.py' AS target, sha256(text) AS source_hash, doc_id, text FROM documents)")
def saved_pages(spark, d):
    """Pages of all documents, written with a frontmatter into buckets, and read back."""
    store = BucketTable(spark, f"{shared_folder(spark)}/pages", TABLES["pages"], ["path"], buckets=16)
    rows = views.rows(spark, d, f"SELECT {_PAGE_PATH} AS path, 'file' AS type, path AS target, text AS content, doc_id FROM ({views.PATHS}) p").withColumn("source_hash", fn.content_hash(F.col("content")))
    store.upsert(pages.page_rows(rows, layer=(F.col("doc_id") % 2).cast("string"), commit="c1", generated=F.lit("2026-01-01 00:00:00").cast("timestamp")))
    front = fn.frontmatter(F.col("content"))
    return store.read().select("path", front["source"].alias("target"), "source_hash", front["layer"].alias("layer"), F.contains(fn.frontmatter_body(F.col("content")), F.lit("\n---\n")).alias("cut"))


@query("SELECT scope, target, arg_max(content, (updated_at, seq)) AS content, 6 AS version FROM n GROUP BY scope, target", n=views.NOTES)
def migrated_notes(spark, d):
    """Notes of the first layout, several for a target, brought to the last one."""
    store = Warehouse(spark, shared_folder(spark))
    store.write(conform(views.sql_view(spark, d, "notes"), "notes"), "notes")
    migrations.migrate(store)
    return store.read("notes").select("scope", "target", "content", F.lit(migrations.stored_version(store)).alias("version"))


@query(catalog.ORACLE_SQL["session_ttl"])
def session_stream(spark, d):
    """The sessions of session_ttl as a stream with state: each ends by a later turn or by its timer."""
    root = shared_folder(spark)
    turns = lambda df: df.select(F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    # A turn long after all others moves the watermark on, so that all timers are due.
    last = table(spark, d, "events").agg(F.max("ts").alias("ts")).select(F.lit(None).cast("string").alias("user"), (F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ts"), F.lit(-1).cast("long").alias("seq"))
    rows, folder = turns(table(spark, d, "events")), f"{root}/turns"
    rows.write.parquet(folder)
    before = spark.conf.get(sessions.STATE_STORE[0], None)
    spark.conf.set(*sessions.STATE_STORE)
    try:
        for step in range(2):
            if step:
                last.write.mode("append").parquet(folder)
            stream = spark.readStream.schema(rows.schema).parquet(folder)
            ended = sessions.session_events(stream).writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").option("path", f"{root}/ended").format("parquet").trigger(availableNow=True).start()
            ended.awaitTermination()
    finally:
        spark.conf.unset(sessions.STATE_STORE[0]) if before is None else spark.conf.set(sessions.STATE_STORE[0], before)
    return spark.read.schema(sessions.OUTPUT).parquet(f"{root}/ended").where("user is not null").select("user", "session", "n", F.col("first_seq").alias("first_event"))


@query(catalog.ORACLE_SQL["fts_bm25_topk"])
def fts_compacted_index(spark, d):
    """The question of fts_bm25_topk from an index that was filled in several updates, merged and swept."""
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/index", id_col="path", text_cols=("text",))
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    for k in range(5):
        part = rows.where(F.col("doc_id") % 5 == k)
        index.update(part, part.select("path", fn.content_hash(F.col("text")).alias("hash")))
    index.compact()
    index.vacuum()
    scored = index.bm25(catalog.PHRASE, clamp=False).select(F.col("id").cast("long").alias("doc_id"), "score")
    return search.top_k(scored, 20, F.desc("score"), F.asc("doc_id")).select("doc_id", F.round("score", 6).alias("score"))
