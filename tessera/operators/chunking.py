"""Texts to chunks: markdown sections, word windows, lines and symbols."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.params import DEFAULT, Params

#: Words of a window and words that two neighbours share, when a section is too long.
WINDOW_WORDS, OVERLAP_WORDS = 1333, 133
#: Files that one task packs, about, and chunks that a worker hands on at once.
FILES_PER_TASK, ROWS_AT_ONCE = 4_000, 1_000


def sections(pages: DataFrame, *, key: list[str], text_col: str = "content") -> DataFrame:
    """(key, ordinal, header, level, content): pages cut before each `##` or `###` line; leading text has no header."""
    parts = F.filter(F.split(F.col(text_col), r"(?m)(?=^#{2,3}\s)"), lambda p: p != "")
    rows = pages.select(*key, F.posexplode(parts).alias("ordinal", "content"))
    head = r"\A(#{2,3})\s+([^\n]*)"
    header = F.when(F.col("content").rlike(head), F.trim(F.regexp_extract("content", head, 2))).otherwise("")
    return rows.select(*key, "ordinal", header.alias("header"), F.length(F.regexp_extract("content", head, 1)).alias("level"), "content")


def section_bounds(lines: DataFrame, *, key: list[str]) -> DataFrame:
    """lines (key, line, text) to (key, start, end, header): each header line to the line before the next header."""
    headers = lines.where(F.col("text").rlike(r"^#{2,3}\s"))
    last = lines.groupBy(*key).agg(F.max("line").alias("_last"))
    nxt = F.lead("line").over(Window.partitionBy(*key).orderBy("line"))
    return headers.withColumn("_next", nxt).join(last, key).select(*key, F.col("line").alias("start"), F.coalesce(F.col("_next") - 1, F.col("_last")).alias("end"), F.trim(F.regexp_replace("text", "^#+", "")).alias("header"))


def section_body(content: Column) -> Column:
    """A section's text without its heading line."""
    return fn.strip(F.when(content.startswith("#"), F.regexp_replace(content, r"\A[^\n]*(?:\n|\z)", "")).otherwise(content))


def word_windows(text: Column, size: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Windows of words, each but the first starting `overlap` words before the end of the one before; the last ends the text."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    step = size - overlap
    starts = F.when(F.size(words) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(F.size(words) - overlap - 1, F.lit(0)), F.lit(step)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def chunk_id(path: Column, header: Column, index: Column) -> Column:
    base = F.concat(F.lit("wiki_"), fn.chunk_slug(F.replace(path, F.lit(".md"), F.lit(""))), F.lit("_"), fn.chunk_slug(header))
    return F.when(index > 0, F.concat(base, F.lit("_"), index.cast("string"))).otherwise(base)


def chunk_pages(pages: DataFrame, *, keep_frontmatter: bool = False, params: Params = DEFAULT, window: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> DataFrame:
    """pages (path, content) to chunks: one per section, or windows of its words if it is over the token limit.

    The index runs over a page's chunks; it is in the id from the second on.
    """
    pages = pages.withColumn("content", F.col("content") if keep_frontmatter else fn.frontmatter_body(F.col("content")))
    pages = pages.withColumn("title", fn.title(F.col("content"), F.col("path"))).withColumn("type", fn.page_type(F.col("path")))
    rows = sections(pages, key=["path", "title", "type"]).withColumn("body", section_body(F.col("content"))).where("body <> ''")
    pieces = F.when(fn.token_estimate(F.col("body")) <= params.chunk_tokens, F.array("body")).otherwise(word_windows(F.col("body"), window, overlap))
    rows = rows.select("path", "title", "type", "ordinal", "header", F.posexplode(pieces).alias("part", "body"))
    rows = rows.withColumn("chunk_index", F.row_number().over(Window.partitionBy("path").orderBy("ordinal", "part")) - 1)
    name = F.when(F.col("header") == "", "Introduction").otherwise(F.col("header"))
    content = F.concat(F.lit("[Document: "), F.col("title"), F.lit(" | Section: "), name, F.lit("]\n\n"), F.col("body"))
    return rows.select(chunk_id(F.col("path"), name, F.col("chunk_index")).alias("chunk_id"), "path", "title", "type", name.alias("section_header"), "chunk_index", fn.token_estimate(content).alias("token_count"), content.alias("content"))


def enrich(chunks: DataFrame, layers: DataFrame, symbols: DataFrame, imports: DataFrame, entry_points: DataFrame, *, source_col: str = "source_path") -> DataFrame:
    """chunks with layer, symbols (those the chunk mentions), imports and entry_points of their source file.

    layers (file_path, layer), symbols (file_path, name), imports (file_path, target), entry_points (file_path, name):
    each is gathered per file before its join.
    """
    gather = lambda rows, column, name: rows.groupBy("file_path").agg(F.array_sort(F.collect_set(column)).alias(name))
    out = chunks.withColumnRenamed(source_col, "file_path").join(layers.select("file_path", "layer").dropDuplicates(["file_path"]), "file_path", "left")
    for rows, column, name in ((symbols, "name", "symbols"), (imports, "target", "imports"), (entry_points, "name", "entry_points")):
        out = out.join(gather(rows, column, name), "file_path", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    mentioned = F.filter("symbols", lambda s: F.contains(F.col("content"), s))
    return out.withColumn("symbols", mentioned).withColumnRenamed("file_path", source_col)


def _line_chunks(content: str, max_tokens: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    lines = content.split("\n")
    step, start = max(1, int(max_tokens * 4 / max(len(content) / len(lines), 1))), 0
    while True:
        end = min(start + step, len(lines))
        size = sum(map(len, lines[start:end])) + end - start - 1
        while size // 4 > max_tokens * 1.2 and end > start + 1:
            end -= 1
            size -= len(lines[end]) + 1
        yield start + 1, end, "\n".join(lines[start:end])
        if end == len(lines):
            return
        start = end - overlap if end - overlap > start else end


def _frames(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of ROWS_AT_ONCE, so a worker does not hold the chunks of a whole batch."""
    while held := list(itertools.islice(rows, ROWS_AT_ONCE)):
        yield pd.DataFrame(held, columns=columns)


def chunk_lines(files: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """files (file_path, content) to (file_path, chunk_index, start_line, end_line, content).

    How many lines a chunk has depends on its own lengths, so this one folds in Python, over Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = ((path, k, *chunk) for path, content in zip(batch["file_path"], batch["content"], strict=True) if content for k, chunk in enumerate(_line_chunks(content, params.chunk_tokens, params.chunk_overlap_lines)))
            yield from _frames(rows, ["file_path", "chunk_index", "start_line", "end_line", "content"])

    return files.select("file_path", "content").mapInPandas(run, "file_path string, chunk_index int, start_line int, end_line int, content string")


def chunk_symbols(files: DataFrame, symbols: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Consecutive symbols of a file packed, with the lines between them, up to the token limit; files without symbols by lines.

    Returns chunk_lines' columns and `symbols`.
    """
    # Texts may be far larger than their compressed bytes, by which adaptive execution would put partitions together.
    deal = math.ceil(files.count() / FILES_PER_TASK) or 1
    own = symbols.repartition(deal, "file_path").groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("own"))

    def pack(content: str, own) -> Iterator[tuple[int, int, str, list[str]]]:
        lines = content.split("\n")
        first, last, names = 0, 0, []
        for s in own:
            size = sum(map(len, lines[first - 1 : s["end_line"]])) + s["end_line"] - first if names else 0
            if names and size // 4 > params.chunk_tokens:
                yield first, last, "\n".join(lines[first - 1 : last]), names
                names = []
            if not names:
                first, last = s["start_line"], s["end_line"]
            last = max(last, s["end_line"])
            names = [*names, s["name"]]
        if names:
            yield first, last, "\n".join(lines[first - 1 : last]), names

    def chunks(batch: pd.DataFrame) -> Iterator[tuple]:
        for path, content, found in zip(batch["file_path"], batch["content"], batch["own"], strict=True):
            if content:
                made = pack(content, found) if found is not None and len(found) else ((*c, []) for c in _line_chunks(content, params.chunk_tokens, params.chunk_overlap_lines))
                yield from ((path, k, *c) for k, c in enumerate(made))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _frames(chunks(batch), ["file_path", "chunk_index", "start_line", "end_line", "content", "symbols"])

    schema = "file_path string, chunk_index int, start_line int, end_line int, content string, symbols array<string>"
    return files.select("file_path", "content").repartition(deal, "file_path").join(own, "file_path", "left").mapInPandas(run, schema)


def call_snippet(content: Column, line: Column, before: int = 10, after: int = 10) -> Column:
    """Lines around a call, from the nearest definition above it within reach; the file's tail if the line is past its end."""
    lines = F.split(content, "\n", -1)
    n = F.size(lines)
    low = F.greatest(line - before, F.lit(1))
    high = F.least(line + after, n)
    heads = F.filter(F.sequence(low, F.greatest(line, low)), lambda i: F.try_element_at(lines, i).rlike(r"^\s*(?:async def|def|class) "))
    start = F.coalesce(F.array_max(heads), low)
    inside = F.array_join(F.slice(lines, start, F.greatest(high - start + 1, F.lit(0))), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(n - after + 1, F.lit(1)), after), "\n")
    return F.when(content.isNull() | (content == "") | (line < 1), "").when(line > n, tail).otherwise(inside)


def source_lines(content: Column, path: Column, first: Column, last: Column, budget: int = 500) -> Column:
    """Lines first..last (from 1) under a header, cut to four characters a token, at a line end if that is past the middle."""
    lines = F.slice(F.split(content, "\n", -1), F.greatest(first, F.lit(1)), F.greatest(last - F.greatest(first, F.lit(1)) + 1, F.lit(0)))
    text = F.concat(F.lit("# "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"), F.array_join(lines, "\n"))
    room = budget * 4
    cut = F.substring(text, 1, room)
    at = F.length(cut) - F.instr(F.reverse(cut), "\n")
    return F.when(F.length(text) <= room, text).otherwise(F.when((at > room / 2) & (F.instr(cut, "\n") > 0), F.substr(cut, F.lit(1), at)).otherwise(cut))
