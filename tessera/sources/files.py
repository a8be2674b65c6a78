"""Readers: source trees, pages, logs, notes, stored graphs and dimensions. Every one is a Spark source: paths may be in any store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions import text as fn
from tessera.operators import corpus
from tessera.params import DEFAULT, Params
from tessera.schemas import conform, schema


def read_tree(spark: SparkSession, root: str, params: Params = DEFAULT) -> DataFrame:
    """(path, length, modificationTime, content) of all files below a root; the size limit keeps larger contents unread."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= params.max_file_size_kb * 1024)
    base = root.rstrip("/").removeprefix("file://")
    return rows.withColumn("path", F.regexp_replace(F.col("path"), rf"^(?:file:)?/*{_quoted(base.lstrip('/'))}/", ""))


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def read_ignore(spark: SparkSession, path: str) -> list[str]:
    """Patterns of an ignore file: blank lines and comments off. As long as the file that a person keeps."""
    rows = spark.read.text(path).select(F.trim("value").alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    return [r["p"] for r in rows.collect()]


def lossy_text(content):
    """Bytes as text, undecodable ones dropped; a replacement character that the file itself holds stays. Null stays null."""

    @pandas_udf("string")
    def decoded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return decoded(content)


def scan_texts(spark: SparkSession, root: str, patterns: list[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """(file_path, content, hash, language) of the files that belong to the corpus."""
    kept = corpus.scan(read_tree(spark, root, params), patterns, params)
    return kept.select(F.col("path").alias("file_path"), lossy_text(F.col("content")).alias("content"), corpus.language(F.col("path")).alias("language")).withColumn("hash", fn.content_hash(F.col("content")))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of all markdown pages below a root."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    base = root.rstrip("/").removeprefix("file://").lstrip("/")
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), rf"^(?:file:)?/*{_quoted(base)}/", "").alias("path"), F.col("value").alias("content"))


def page(pages: DataFrame, path: str) -> DataFrame:
    """One page with word_count and the source path that its first heading quotes."""
    head = fn.group(F.col("content"), r"(?m)^#\s+[^\n]*?[`\"]([^`\"\n]+)[`\"]")
    return pages.where(F.col("path") == path).select("path", "content", fn.word_count(F.col("content")).alias("word_count"), head.alias("source_path"))


def page_tree(pages: DataFrame) -> DataFrame:
    """(type, stems): pages by type, sorted."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.md$", "")
    return pages.groupBy(fn.page_type(F.col("path")).alias("type")).agg(F.array_sort(F.collect_list(stem)).alias("stems"))


def read_graph(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) stored by sinks.write_graph."""
    return spark.read.schema(schema("nodes")).json(f"{root}/nodes"), spark.read.schema(schema("edges")).json(f"{root}/edges")


def read_json_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A JSON lines file or folder as a table of the schema; broken lines give null rows, which are dropped."""
    return conform(spark.read.schema(schema(table)).option("mode", "DROPMALFORMED").json(path), table)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("llm_log")).json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (entries): lines of a log that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "").agg(F.count("*").alias("entries"))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """Notes kept as files with a frontmatter; files without scope or target are skipped."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True)
    rows = rows.withColumn("m", fn.frontmatter(F.col("value"))).where("m is not null")
    out = rows.select(F.col("m")["scope"].alias("scope"), F.coalesce(F.col("m")["target"], F.lit("")).alias("target"), fn.strip(fn.frontmatter_body(F.col("value"))).alias("content"), F.col("m")["author"].alias("author"), fn.parse_time(F.col("m")["updated_at"]).alias("updated_at"))
    return conform(out.where("scope is not null"), "notes")


def dimension(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """(library, language, category, display): the library dimension, from rows or a YAML file read on the driver."""
    return spark.createDataFrame(rows, "library string, language string, category string, display string")


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """The dimension from a YAML text language -> category -> [library: display] or {library: {display}}."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("PyYAML is needed to read a YAML dimension") from e
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    rows = []
    for lang, categories in (yaml.safe_load(text) or {}).items():
        for category, libraries in (categories or {}).items():
            pairs = libraries.items() if isinstance(libraries, dict) else [(x, x) for x in libraries or []]
            rows += [(str(k), lang, category, str(v.get("display", k) if isinstance(v, dict) else v)) for k, v in pairs]
    return dimension(spark, rows)


def manifest(files: DataFrame) -> DataFrame:
    """One row (name, version, description, dependencies) of package.json, overridden by pyproject.toml. files: (file_path, content)."""
    js = F.from_json("content", "name string, version string, description string, dependencies map<string,string>")
    field = lambda k: fn.group(F.col("content"), rf'(?m)^{k}\s*=\s*["\']([^"\'\n]*)["\']')
    listed = F.regexp_extract_all(fn.group(F.col("content"), r"(?s)\ndependencies\s*=\s*\[(.*?)\]"), F.lit(r"[\"']([A-Za-z0-9_.-]+)"), 1)
    npm = files.where(F.col("file_path") == "package.json").select(F.lit(0).alias("p"), js.alias("m")).select("p", "m.name", "m.version", "m.description", F.map_keys("m.dependencies").alias("dependencies"))
    py = files.where(F.col("file_path") == "pyproject.toml").select(F.lit(1).alias("p"), field("name").alias("name"), field("version").alias("version"), field("description").alias("description"), listed.alias("dependencies"))
    rows = npm.unionByName(py)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("p"))).alias(c)
    return rows.agg(last("name"), last("version"), last("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("dependencies", F.array().cast("array<string>")))))).alias("dependencies"))
