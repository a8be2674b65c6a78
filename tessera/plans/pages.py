"""Pages from what a build knows without a model: file pages with frontmatter, and their upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import incremental
from tessera.schemas import conform
from tessera.sources.sinks import Warehouse


def page_rows(pages: DataFrame, *, layer: Column | None = None, plain: bool = False, commit: str = "", generated: Column | None = None) -> DataFrame:
    """Rows of the table pages from (path, type, target, content, source_hash): content gets a frontmatter unless plain, metadata is JSON."""
    at = F.current_timestamp() if generated is None else generated
    layer = F.lit(None).cast("string") if layer is None else layer
    stamp = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.col("content") if plain else fn.with_frontmatter(F.col("target"), F.col("type"), F.lit(commit), stamp, layer, F.col("content"))
    meta = F.to_json(F.struct(F.col("source_hash"), layer.alias("layer"), fn.word_count(F.col("content")).alias("word_count")))
    return conform(pages.select("path", "type", "target", body.alias("content"), "source_hash", meta.alias("metadata"), at.alias("generated_at"), F.lit("complete").alias("status")), "pages")


def save_pages(store: Warehouse, pages: DataFrame, *, staged: bool = False) -> None:
    """Put page rows in by path."""
    store.write(incremental.upsert(store.read("pages", staged), pages, ["path"]), "pages", staged=staged)


def file_pages(texts: DataFrame, parsed: DataFrame) -> DataFrame:
    """One page for each file of texts (file_path, content, source_hash): its size and language, imports and symbols by line."""
    line = lambda s: F.concat(F.lit("- `"), F.concat_ws(".", s["parent"], s["name"]), F.lit("` ("), s["symbol_type"], F.lit(", lines "), s["start_line"].cast("string"), F.lit("-"), s["end_line"].cast("string"), F.lit(")"))
    section = lambda head, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"\n## {head}\n\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    known = texts.join(parsed.drop("source_hash"), "file_path", "left")
    body = F.concat(
        F.lit("# "), F.col("file_path"), F.lit("\n\n"), F.coalesce("language", F.lit("text")), F.lit(", "), F.coalesce(F.col("line_count"), F.lit(0)).cast("string"), F.lit(" lines.\n"),
        section("Imports", F.transform(F.array_sort(F.array_distinct(F.coalesce("imports", F.array().cast("array<string>")))), lambda x: F.concat(F.lit("- "), x))),
        section("Symbols", F.coalesce(F.transform("symbols", line), F.array().cast("array<string>"))),
        section("Synopsis", F.when(F.col("synopsis").isNotNull(), F.array("synopsis")).otherwise(F.array().cast("array<string>"))),
    )
    path = F.concat(F.lit("files/"), fn.page_slug(F.col("file_path")), F.lit(".md"))
    return page_rows(known.select(path.alias("path"), F.lit("file").alias("type"), F.col("file_path").alias("target"), body.alias("content"), "source_hash"))
