"""Aggregates over file and directory summaries, call-site choice, batches and workflow groups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as fn
from tessera.operators.corpus import is_test_snippet, parent

LAYERS = ["api", "domain", "infrastructure", "utility", "config", "test"]
# Name prefixes and kinds by which entry points are grouped.
NAME_PREFIXES = ["sync_", "export_", "import_", "process_", "handle_", "create_", "update_", "delete_", "get_", "list_", "validate_", "send_", "fetch_", "load_", "save_"]
KIND_NAMES = {"cli_command": "CLI Commands", "api_route": "API Routes", "main_function": "Main Entry Points", "background_task": "Background Tasks"}


def code_metrics(summaries: DataFrame, contents: DataFrame) -> DataFrame:
    """(layer, files, lines), a last row with a null layer for all: files with no content count no lines."""
    lines = contents.select("file_path", F.coalesce(fn.lines_metric(F.col("content")), F.lit(0)).alias("n"))
    return summaries.join(lines, "file_path", "left").rollup("layer").agg(F.count("*").alias("files"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"))


def files_by_layer(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("layer").agg(F.array_sort(F.collect_list("file_path")).alias("files"))


def merge_layers(parts: DataFrame) -> DataFrame:
    """(layer, files, purpose) of maps made in batches (batch, layer, purpose, files): files once in batch order, the longest purpose (of equals the first by text)."""
    rows = parts.select("layer", "batch", F.posexplode("files").alias("pos", "file"))
    firsts = rows.groupBy("layer", "file").agg(F.min(F.struct("batch", "pos")).alias("at"))
    files = firsts.groupBy("layer").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"]).alias("files"))
    said = parts.groupBy("layer").agg(F.min(F.struct((-F.length("purpose")).alias("n"), "purpose")).alias("p")).select("layer", "p.purpose")
    return said.join(files, "layer", "left").withColumn("files", F.coalesce("files", F.array().cast("array<string>")))


def first_components(parts: DataFrame) -> DataFrame:
    """The first component of each name, by batch and position."""
    return parts.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("batch", "pos"))).where("_n = 1").drop("_n")


def directory_signature(files: DataFrame) -> DataFrame:
    """(directory, signature): SHA-256 of `name:hash` of its own files, sorted, with bars between. files: (path, hash)."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    part = F.concat(name, F.lit(":"), F.col("hash"))
    return files.groupBy(parent(F.col("path")).alias("directory")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "|"), 256).alias("signature"))


def directory_signature_deep(files: DataFrame, children: DataFrame) -> DataFrame:
    """The same with `child:purpose` of its directories after two bars. children: (directory, purpose)."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    own = files.groupBy(parent(F.col("path")).alias("directory")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(name, F.lit(":"), F.col("hash")))), "|").alias("f"))
    below = children.where("directory <> ''").groupBy(parent(F.col("directory")).alias("directory")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("directory"), F.lit(":"), F.col("purpose")))), "|").alias("c"))
    both = own.join(below, "directory", "full_outer")
    return both.select("directory", F.sha2(F.concat(F.coalesce("f", F.lit("")), F.lit("||"), F.coalesce("c", F.lit(""))), 256).alias("signature"))


def tech_stack(dependencies: DataFrame, dimension: DataFrame) -> DataFrame:
    """(language, category, names): known libraries among dependencies (name); case and underscores aside. dimension: (library, language, category, display)."""
    plain = lambda c: F.replace(F.lower(F.trim(F.col(c))), F.lit("_"), F.lit("-"))
    known = dimension.withColumn("_key", plain("library"))
    used = dependencies.select(plain("name").alias("_key")).distinct()
    return used.join(known, "_key").groupBy("language", "category").agg(F.array_sort(F.collect_set("display")).alias("names"))


def connection_counts(imports: DataFrame, n: int = 30) -> DataFrame:
    """(path, connections): files that import it and files it imports, the n of most."""
    ends = imports.select(F.col("source").alias("path")).unionAll(imports.select(F.col("target").alias("path")))
    return ends.groupBy("path").agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "path").limit(n)


def summary_tokens(files: DataFrame, directories: DataFrame, tokens_per_char: float = 0.25) -> DataFrame:
    """One row (tokens): summaries' lengths, half as much again for structure, as tokens; whole at each step."""
    size = lambda rows, *columns: rows.agg(F.coalesce(F.sum(sum((F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns), F.lit(0))), F.lit(0)).alias("n"))
    both = size(files, "file_path", "purpose").union(size(directories, "directory_path", "purpose")).agg(F.sum("n").alias("n"))
    return both.select(F.floor(F.floor(F.col("n") * 1.5) * tokens_per_char).cast("long").alias("tokens"))


def methods_per_class(symbols: DataFrame, classes: int = 15, methods: int = 5) -> DataFrame:
    """(class, methods): the first classes and of each its first methods, by line."""
    rows = symbols.where((F.col("symbol_type") == "method") & F.col("parent").isNotNull())
    nth = F.row_number().over(Window.partitionBy("file_path", "parent").orderBy("start_line", "name"))
    kept = rows.withColumn("_n", nth).where(F.col("_n") <= methods)
    out = kept.groupBy("file_path", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "name"))), lambda x: x["name"]).alias("methods"), F.min("start_line").alias("_at"))
    return out.orderBy("file_path", "_at", "parent").limit(classes).select("file_path", F.col("parent").alias("class"), "methods")


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def fixed_batches(rows: DataFrame, order: list[Column], n: int, keys: list[str] | None = None) -> DataFrame:
    """rows with `batch`: consecutive groups of n in an order."""
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(window) - 1) / n).cast("int"))


def greedy_batches(rows: DataFrame, keys: list[str], order: list[str], limit: int, tokens_col: str = "tokens") -> DataFrame:
    """rows (keys, order, tokens) with `batch`: a new one begins where the next item would pass the limit.

    The running sum starts anew with each batch, so it is a fold over the ordered items of a key; keys run in parallel.
    """
    item = F.struct(*order, F.col(tokens_col).cast("long").alias("tokens"))
    gathered = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    step = lambda a, x: F.struct(
        F.when((a["n"] > 0) & (a["used"] + x["tokens"] > limit), a["batch"] + 1).otherwise(a["batch"]).alias("batch"),
        F.when((a["n"] > 0) & (a["used"] + x["tokens"] > limit), x["tokens"]).otherwise(a["used"] + x["tokens"]).alias("used"),
        (a["n"] + 1).alias("n"),
        F.concat(a["out"], F.array(F.when((a["n"] > 0) & (a["used"] + x["tokens"] > limit), a["batch"] + 1).otherwise(a["batch"]))).alias("out"),
    )
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))
    folded = gathered.withColumn("b", F.aggregate("items", start, step, lambda a: a["out"]))
    return folded.select(*keys, F.explode(F.arrays_zip("items", "b")).alias("z")).select(*keys, "z.items.*", F.col("z.b").alias("batch"))


def greedy_batches_long(rows: DataFrame, keys: list[str], order: list[str], limit: int, tokens_col: str = "tokens") -> DataFrame:
    """greedy_batches for keys of many items: the same fold over rows sorted in their partitions, in Arrow batches.

    The fold needs a key's items one after another, so one task has them all, but it holds one batch: sorting spills.
    """
    names = [*keys, *order]
    source = rows.select(*names, F.col(tokens_col).cast("long").alias("tokens"))
    source = source.repartition(*keys).sortWithinPartitions(*names, "tokens")
    n = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, batch, used = None, 0, 0
        for part in batches:
            out = []
            columns = [c.to_pylist() for c in part.columns[:n]]
            for own, t in zip(zip(*columns, strict=True), part.column(part.num_columns - 1).to_pylist(), strict=True):
                if own != key:
                    key, batch, used = own, 0, 0
                elif used + t > limit:
                    batch, used = batch + 1, 0
                used += t
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], names=[*part.schema.names, "batch"])

    schema = T.StructType([*source.schema.fields, T.StructField("batch", T.IntegerType())])
    return source.mapInArrow(fold, schema)


def rank_call_sites(sites: DataFrame, *, by: list[str]) -> DataFrame:
    """sites (by, target_file, caller_file, line, ...) with `tier` and `place`: callers in other files before own ones, tests last in each, then file and line."""
    inside, test = F.col("caller_file").eqNullSafe(F.col("target_file")), is_test_snippet(F.col("caller_file"))
    tier = 1 + F.when(inside, 2).otherwise(0) + F.when(test, 1).otherwise(0)
    order = Window.partitionBy(*by).orderBy("tier", "caller_file", "line", "caller_symbol")
    return sites.withColumn("tier", tier).withColumn("place", F.row_number().over(order))


def best_call_site(sites: DataFrame, *, by: list[str]) -> DataFrame:
    return rank_call_sites(sites, by=by).where("place = 1").drop("place")


def other_call_sites(sites: DataFrame, *, by: list[str], most: int = 5) -> DataFrame:
    """Up to `most` besides the best, with `nth`: first one for each further file, then the rest, by file and line."""
    rows = rank_call_sites(sites, by=by)
    best = rows.where("place = 1").select(*by, F.col("caller_file").alias("_best"))
    rest = rows.where("place > 1").join(best, by)
    per_file = Window.partitionBy(*by, "caller_file").orderBy("line", "caller_symbol")
    rest = rest.withColumn("_fill", (F.row_number().over(per_file) > 1) | (F.col("caller_file") == F.col("_best")))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_fill", "caller_file", "line", "caller_symbol"))
    return rest.withColumn("nth", nth).where(F.col("nth") <= most).drop("_best", "_fill", "place")


def primary_layer(groups: DataFrame, layers: DataFrame) -> DataFrame:
    """(slug, primary_layer): the layer of most entry files of a group (slug, file); a file in several layers counts for the first by name."""
    one = layers.groupBy("file").agg(F.min("layer").alias("layer"))
    counted = groups.join(one, "file").groupBy("slug", "layer").agg(F.count("*").alias("n"))
    return counted.groupBy("slug").agg(F.min_by("layer", F.struct(-F.col("n"), F.col("layer"))).alias("primary_layer"))


def group_workflows(entry_points: DataFrame, imports: DataFrame | None = None, layers: DataFrame | None = None, *, route_kinds: tuple[str, ...] = ("api_route",)) -> DataFrame:
    """(stage, name, slug, entry_points, files[, related_files, primary_layer]) from (name, entry_type, file, description).

    Cascade: by route prefix, by file (two or more), by name prefix (two or more), by kind (two or more), then one by
    one. What a stage groups leaves the next by *name*, so equal names in other files leave with it. With the default
    route_kinds only `api_route` counts as a route; add "route" for entry points that come straight from parsers.
    """
    stem = F.regexp_replace(F.regexp_extract("file", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    prefix = F.coalesce(*(F.when(F.col("name").startswith(p), p.rstrip("_")) for p in NAME_PREFIXES))
    kind_name = F.coalesce(*(F.when(F.col("entry_type") == k, n) for k, n in KIND_NAMES.items()), F.concat(F.initcap("entry_type"), F.lit(" Workflows")))
    route = F.when(F.col("entry_type").isin(*route_kinds) & (F.col("description") != ""), F.lower(fn.route_prefix(F.col("description"))))
    title = lambda c: F.initcap(F.translate(c, "_-", "  "))
    stages = [
        (route, F.concat(title(route), F.lit(" API")), 1),
        (F.when(F.col("file") != "", F.col("file")), fn.humanize(stem), 2),
        (prefix, F.concat(F.initcap(prefix), F.lit(" Operations")), 2),
        (F.col("entry_type"), kind_name, 2),
        (F.concat_ws("\0", "name", "file"), fn.humanize(F.col("name")), 1),
    ]
    left, groups = entry_points, None
    for stage, (key, name, least) in enumerate(stages, 1):
        keyed = left.withColumn("_key", key).withColumn("_title", name).where(F.col("_key").isNotNull())
        made = keyed.groupBy("_key").agg(F.first("_title").alias("name"), F.array_sort(F.collect_list("name")).alias("entry_points"), F.array_sort(F.collect_set(F.when(F.col("file") != "", F.col("file")))).alias("files"))
        made = made.where(F.size("entry_points") >= least).select(F.lit(stage).alias("stage"), "name", fn.workflow_slug(F.col("name")).alias("slug"), "entry_points", "files")
        groups = made if groups is None else groups.unionByName(made)
        left = left.join(made.select(F.explode("entry_points").alias("name")).distinct(), "name", "left_anti")
    if layers is not None:
        groups = groups.join(primary_layer(groups.select("slug", F.explode("files").alias("file")), layers), "slug", "left").withColumn("primary_layer", F.coalesce("primary_layer", F.lit("")))
    if imports is not None:
        groups = related_files(groups, imports)
    return groups


def related_files(groups: DataFrame, imports: DataFrame, depth: int = 2) -> DataFrame:
    """groups with related_files: files within two internal imports of theirs; the walk carries the slug, so all groups go at once."""
    known = imports.select(F.col("source").alias("target")).distinct().withColumn("_known", F.lit(True))
    inner = imports.join(known, "target", "left").where(F.col("_known") | F.contains("target", F.lit("/")) | F.col("target").endswith(".py")).select(F.col("source").alias("path"), F.col("target").alias("_to")).distinct()
    seen = frontier = groups.select("slug", F.explode("files").alias("path")).distinct()
    for _ in range(depth):
        frontier = frontier.join(inner, "path").select("slug", F.col("_to").alias("path")).distinct().join(seen, ["slug", "path"], "left_anti")
        seen = seen.union(frontier)
    found = seen.groupBy("slug").agg(F.array_sort(F.collect_list("path")).alias("related_files"))
    return groups.join(found, "slug", "left").withColumn("related_files", F.coalesce("related_files", F.array().cast("array<string>")))


def with_fallbacks(summaries: DataFrame) -> DataFrame:
    """Missing purposes are Unknown, unknown layers utility, missing lists empty."""
    lists = ("key_abstractions", "internal_deps", "external_deps")
    out = summaries.withColumn("purpose", F.coalesce("purpose", F.lit("Unknown"))).withColumn("layer", F.when(F.lower("layer").isin(*LAYERS), F.lower("layer")).otherwise("utility"))
    return out.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})

