"""Rows to text: trees, lists, tables and diagrams, each as one ordered aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.corpus import ancestors, depth
from tessera.operators.graph import diagram_useful, diagram_valid


def listing(rows: DataFrame, line: Column, order: list[str], by: list[str] | None = None, *, empty: str = "") -> DataFrame:
    """One text of lines in an order (for each key): meant for the bounded lists of a page."""
    gathered = F.array_sort(F.collect_list(F.struct(*order, line.alias("_line"))))
    text = F.array_join(F.transform(gathered, lambda x: x["_line"]), "\n").alias("text")
    out = rows.groupBy(*by).agg(text) if by else rows.agg(text)
    return out.withColumn("text", F.when(F.col("text") == "", empty).otherwise(F.col("text")))


def file_tree(files: DataFrame) -> DataFrame:
    """Directories and files, sorted by path, two blanks for each level."""
    every = files.select(F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    name = F.regexp_extract("path", "([^/]*)$", 1)
    leaf = files.select("path", F.lit(True).alias("_file"))
    rows = every.join(leaf, "path", "left").withColumn("_line", F.concat(F.repeat(F.lit("  "), depth(F.col("path"))), name, F.when(F.col("_file"), "").otherwise("/")))
    return listing(rows, F.col("_line"), ["path"])


def symbol_list(symbols: DataFrame, by: list[str] | None = None) -> DataFrame:
    line = F.concat(F.lit("- **"), F.col("name"), F.lit("** ("), F.col("symbol_type"), F.lit(") line "), F.col("start_line").cast("string"))
    return listing(symbols, line, ["start_line", "name"], by, empty="No symbols.")


def bullet_list(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    return listing(rows, F.concat(F.lit("- "), F.col(column)), [column], by, empty="None.")


def table(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """A markdown table."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    body = listing(rows, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), order)
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"
    return body.select(F.concat(F.lit(head + "\n"), "text").alias("text"))


def call_sites_text(best: DataFrame, others: DataFrame, by: list[str]) -> DataFrame:
    """The best call's snippet, fenced, and where else a symbol is called. best: (by, caller_file, line, language, snippet)."""
    more = listing(others, F.concat(F.lit("- "), F.col("caller_file"), F.lit(":"), F.col("line").cast("string")), ["nth"], by).withColumnRenamed("text", "_more")
    head = F.concat(F.lit("Called in `"), F.col("caller_file"), F.lit("` line "), F.col("line").cast("string"), F.lit("\n```"), F.col("language"), F.lit("\n"), F.col("snippet"), F.lit("\n```"))
    return best.join(more, by, "left").select(*by, F.concat(head, F.coalesce(F.concat(F.lit("\nAlso called in:\n"), "_more"), F.lit(""))).alias("text"))


def component_diagram(components: DataFrame, between: DataFrame) -> DataFrame:
    nodes = components.select(F.lit(1).alias("k"), F.col("component").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("component")), F.lit('["'), fn.diagram_label(F.col("component")), F.lit('"]')).alias("line"))
    arrows = between.select(F.lit(2).alias("k"), F.concat_ws("\0", "from", "to").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("from")), F.lit(" -->|"), F.col("n").cast("string"), F.lit("| "), fn.diagram_id(F.col("to"))).alias("line"))
    body = listing(nodes.unionByName(arrows), F.col("line"), ["k", "s"])
    return body.select(F.concat(F.lit("flowchart TD\n"), "text").alias("diagram"))


def layer_diagram(files: DataFrame, between: DataFrame, per_layer: int = 5) -> DataFrame:
    """Layers as boxes of their first files, and arrows between layers. files: (layer, file); between: (from, to)."""
    own = files.groupBy("layer").agg(F.slice(F.array_sort(F.collect_set("file")), 1, per_layer).alias("files"))
    inner = F.array_join(F.transform("files", lambda f: F.concat(F.lit("        "), fn.diagram_id(f), F.lit('["'), fn.diagram_label(f), F.lit('"]'))), "\n")
    boxes = own.select(F.lit(1).alias("k"), F.col("layer").alias("s"), F.concat(F.lit("    subgraph "), fn.diagram_id(F.col("layer")), F.lit("\n"), inner, F.lit("\n    end")).alias("line"))
    arrows = between.select(F.lit(2).alias("k"), F.concat_ws("\0", "from", "to").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("from")), F.lit(" --> "), fn.diagram_id(F.col("to"))).alias("line"))
    return listing(boxes.unionByName(arrows), F.col("line"), ["k", "s"]).select(F.concat(F.lit("flowchart TD\n"), "text").alias("diagram"))


def class_diagram(methods: DataFrame) -> DataFrame:
    """Classes with their methods. methods: (class, methods)."""
    members = F.array_join(F.transform("methods", lambda m: F.concat(F.lit("        +"), fn.diagram_id(m), F.lit("()"))), "\n")
    line = F.concat(F.lit("    class "), fn.diagram_id(F.col("class")), F.lit(" {\n"), members, F.lit("\n    }"))
    return listing(methods, line, ["class"]).select(F.concat(F.lit("classDiagram\n"), "text").alias("diagram"))


def import_diagram(imports: DataFrame) -> DataFrame:
    line = F.concat(F.lit("    "), fn.diagram_id(F.col("source")), F.lit(" --> "), fn.diagram_id(F.col("target")))
    return listing(imports, line, ["source", "target"]).select(F.concat(F.lit("flowchart LR\n"), "text").alias("diagram"))


def append_diagrams(pages: DataFrame, diagrams: DataFrame) -> DataFrame:
    """pages (path, content) with their valid and useful diagrams (path, pos, kind, diagram) at the end."""
    useful = F.when(F.col("kind") == "layers", diagram_useful(F.col("diagram"), "layers")).when(F.col("kind") == "classes", diagram_useful(F.col("diagram"), "classes")).otherwise(diagram_useful(F.col("diagram")))
    good = diagrams.where(diagram_valid(F.col("diagram")) & useful)
    text = listing(good, F.concat(F.lit("\n\n```mermaid\n"), "diagram", F.lit("\n```")), ["pos"], ["path"]).withColumnRenamed("text", "_d")
    return pages.join(text, "path", "left").withColumn("content", F.concat("content", F.coalesce("_d", F.lit("")))).drop("_d")
