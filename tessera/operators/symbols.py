"""Symbols, references and the code index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.durable import Kept

#: Confidence multipliers of ambiguous and unresolved references.
AMBIGUOUS, UNRESOLVED = 0.5, 0.3
#: Pairs of sources and ids that one task makes, about.
PAIRS_PER_TASK = 10_000_000
# Decorators and names that make a function an entry point.
ENTRY_DECORATORS = [
    "click.command", "click.group", "typer.command",
    "app.route", "app.get", "app.post", "app.put", "app.delete", "app.patch",
    "router.route", "router.get", "router.post", "router.put", "router.delete", "router.patch",
    "flask.route", "api_view", "action",
]
ENTRY_NAMES = ["main", "__main__", "run", "start", "serve", "execute"]


def node_id(path: Column, parent: Column, name: Column) -> Column:
    """path::[parent.]name"""
    return F.concat(path, F.lit("::"), F.when(parent.isNotNull() & (parent != ""), F.concat(parent, F.lit("."))).otherwise(""), name)


def with_node_id(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("id", node_id(F.col("file_path"), F.col("parent"), F.col("name")))


def resolve(refs: DataFrame, symbols: DataFrame, *, order: list[str] = ()) -> DataFrame:
    """refs with target ids from symbols (id, name, qualified): a qualified match wins over simple names.

    One match keeps the confidence, more give a row each at half of it, none leaves the target's text at 0.3 of it, with
    target_resolved false. `order` names the columns that identify a reference.
    """
    # The ids of a name are gathered once by an aggregate and spread over its references after the join, whose small side
    # this is: adaptive execution broadcasts it or splits the references of a hot name.
    ids = _lookups(symbols)
    joined = refs.join(ids, refs["target"] == ids["_key"], "left")
    factor = F.when(F.col("_ids").isNull(), UNRESOLVED).when(F.size("_ids") > 1, AMBIGUOUS).otherwise(1.0)
    out = joined.withColumn("confidence", F.col("confidence") * factor).withColumn("target_resolved", F.col("_ids").isNotNull())
    return out.withColumn("_id", F.explode_outer("_ids")).withColumn("target", F.coalesce("_id", "target")).drop("_key", "_ids", "_id")


def _lookups(symbols: DataFrame) -> DataFrame:
    """(_key, _ids): a row for each name with the ids it stands for; a name that some symbol has in full hides symbols that only end in it."""
    names = symbols.select(F.col("qualified").alias("_key"), F.col("id").alias("_full"), F.lit(None).cast(symbols.schema["id"].dataType).alias("_part"))
    names = names.union(symbols.select(F.col("name"), F.lit(None), F.col("id")))
    ids = names.groupBy("_key").agg(F.collect_set("_full").alias("_f"), F.collect_set("_part").alias("_p"))
    return ids.select("_key", F.when(F.size("_f") > 0, F.col("_f")).otherwise(F.col("_p")).alias("_ids"))


def resolved_pairs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source, target, n, confidence): what resolve makes of refs, the resolved rows counted and their confidence summed.

    References of a source to a name are summed before they meet the ids of that name, so what is shuffled grows with the
    references and not with sources times ids. The pairs of an id that only one of the names stands for are whole then; only
    pairs of ids that several names stand for are summed once more.
    """
    keep = Kept(refs.sparkSession)
    asked = keep(refs.where("target is not null").groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence")))
    ids = _lookups(symbols).join(asked.select(F.col("target").alias("_key")).distinct(), "_key", "left_semi")
    ids = ids.select("_key", F.explode("_ids").alias("_id"), F.when(F.size("_ids") > 1, AMBIGUOUS).otherwise(1.0).alias("_factor"))
    ids = keep(ids.join(ids.groupBy("_id").agg((F.count("*") == 1).alias("_alone")), "_id"))
    # Few rows make many here, so they are dealt to tasks by what they make.
    wide = asked.groupBy(F.col("target").alias("_key")).agg(F.count("*").alias("_n")).join(ids.groupBy("_key").agg(F.count("*").alias("_m")), "_key")
    made = wide.agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]
    asked = asked.repartition(math.ceil(made / PAIRS_PER_TASK) or 1)
    pairs = lambda some: asked.join(some, asked["target"] == some["_key"]).select("source", F.col("_id").alias("target"), "n", (F.col("confidence") * F.col("_factor")).alias("confidence"))
    several = pairs(ids.where("not _alone")).groupBy("source", "target").agg(F.sum("n").alias("n"), F.sum("confidence").alias("confidence"))
    return pairs(ids.where("_alone")).unionByName(several)


def build_graph(symbols: DataFrame, refs: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from symbols with ids and resolved references; of references between one pair the last in order stays."""
    nodes = symbols.select("id", "name", F.col("symbol_type").alias("type"), "file_path", F.col("start_line").alias("line_start"), F.col("end_line").alias("line_end"), "docstring", "signature", "parent")
    usable = refs.where("target_resolved").join(symbols.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    last = last_wins(usable, ["source", "target"], order)
    return nodes, last.select("source", "target", F.col("reference_type").alias("type"), "confidence", "line")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row, in an order, under each key; of equal ones the one of largest values.

    An aggregate: rows of one key meet before the shuffle, so a key that holds many rows is no task's burden.
    """
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)), *(F.col(c) for c in others if _comparable(rows.schema[c].dataType)))
    whole = F.struct(*(F.col(c) for c in others))
    last = rows.groupBy(*keys).agg(F.max_by(whole, rank).alias("_last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"_last.`{c}`").alias(c) for c in rows.columns))


def _comparable(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType))


def build_index(symbols: DataFrame, calls: DataFrame, source_hash: Column, *, qualified: bool = False) -> DataFrame:
    """Code index rows of functions, methods and classes; one name in one file keeps its last symbol, unless names are qualified.

    calls: (file_path, symbol_name, callee, ordinal).
    """
    rows = symbols.where(F.col("symbol_type").isin("function", "method", "class"))
    name = F.when(F.col("parent").isNotNull() & F.lit(qualified), F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))
    rows = last_wins(rows.withColumn("symbol_name", name), ["file_path", "symbol_name"], [F.col("ordinal")])
    made = calls.groupBy("file_path", "symbol_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "callee"))).alias("_c"))
    rows = rows.join(made, ["file_path", "symbol_name"], "left").withColumn("calls", F.coalesce(F.col("_c.callee"), F.array().cast("array<string>"))).drop("_c")
    rows = rows.withColumn("id", F.xxhash64("file_path", "symbol_name")).withColumn("source_hash", source_hash)
    return called_by(rows)


def called_by(index: DataFrame, order: list[str] = ("file_path", "symbol_name")) -> DataFrame:
    """index with called_by: names of the rows that call each name, in row order, repeats kept; every row of a name gets them."""
    edges = index.select(F.struct(*order).alias("_at"), F.col("symbol_name").alias("caller"), F.posexplode("calls").alias("_pos", "_callee"))
    callers = edges.groupBy("_callee").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_pos", "caller"))), lambda x: x["caller"]).alias("_by"))
    # Merged, as rows come out by name then: who groups them by name shuffles and sorts no lists, which are as many as rows here.
    out = index.drop("called_by").join(callers.hint("merge"), index["symbol_name"] == callers["_callee"], "left")
    return out.withColumn("called_by", F.coalesce("_by", F.array().cast("array<string>"))).drop("_callee", "_by")


def callers_by_name(index: DataFrame) -> DataFrame:
    """(symbol_name, n, callers, first, last) of the rows that called_by updates: calls of each name that is called, how many names call it, and the first and last of them."""
    updated = called_by(index).where(F.size("called_by") > 0)
    found = updated.groupBy("symbol_name").agg(F.first("called_by").alias("called_by"))
    return found.select("symbol_name", F.size("called_by").cast("long").alias("n"), F.size(F.array_distinct("called_by")).cast("long").alias("callers"), F.array_min("called_by").alias("first"), F.array_max("called_by").alias("last"))


def callees(index: DataFrame, name: str) -> DataFrame:
    """Rows of the names that the first row of that name calls."""
    first = index.where(F.col("symbol_name") == name).orderBy("id").limit(1).select(F.explode("calls").alias("symbol_name"))
    return index.join(first.distinct(), "symbol_name", "left_semi")


def callers(index: DataFrame, name: str) -> DataFrame:
    return index.where(F.array_contains("calls", name))


def raising(index: DataFrame, exception: str) -> DataFrame:
    return index.where(F.array_contains("raises", exception))


def mutating(index: DataFrame, variable: str) -> DataFrame:
    return index.where(F.array_contains("mutates", variable))


def like(column: Column, pattern: str) -> Column:
    """A substring test in which `%` and `_` stay wildcards, ASCII case aside; backslashes are plain."""
    return column.ilike("%" + pattern.replace("\\", "\\\\") + "%")


def with_error_string(index: DataFrame, pattern: str) -> DataFrame:
    return index.where(F.exists("error_strings", lambda s: like(s, pattern)))


def in_file(index: DataFrame, pattern: str) -> DataFrame:
    return index.where(like(F.col("file_path"), pattern))


def named(index: DataFrame, name: str, file_pattern: str | None = None) -> DataFrame:
    rows = index.where(F.col("symbol_name") == name)
    return rows if file_pattern is None else in_file(rows, file_pattern)


def is_entry_point(symbol_type: Column, decorators: Column, name: Column) -> Column:
    known = F.array(*map(F.lit, ENTRY_DECORATORS))
    by_decorator = F.exists(decorators, lambda d: F.exists(known, lambda k: F.contains(d, k)))
    return symbol_type.isin("route", "cli_command") | F.coalesce(by_decorator, F.lit(False)) | name.isin(*ENTRY_NAMES)


def is_route_handler(decorators: Column) -> Column:
    """A dotted decorator whose last part is an HTTP verb."""
    return F.exists(decorators, lambda d: d.rlike(r"\.(?:get|post|put|delete|patch|options|head|route)$"))


def fan(index: DataFrame, out_limit: int = 15, in_limit: int = 20) -> DataFrame:
    """index with fan_out, fan_in and flags of those above the limits; fan_in counts the calls of a name without gathering callers."""
    into = index.select(F.explode("calls").alias("_callee")).groupBy("_callee").agg(F.count("*").cast("int").alias("_in"))
    rows = index.withColumn("fan_out", F.size("calls")).join(into, F.col("symbol_name") == F.col("_callee"), "left")
    rows = rows.withColumn("fan_in", F.coalesce("_in", F.lit(0))).drop("_callee", "_in")
    return rows.withColumn("high_fan_out", F.col("fan_out") > out_limit).withColumn("high_fan_in", F.col("fan_in") > in_limit)


def call_edges(index: DataFrame) -> DataFrame:
    """(caller_id, caller, callee, pos): a row for each call, the form to keep where callers of one name may be many."""
    return index.select(F.col("id").alias("caller_id"), F.col("symbol_name").alias("caller"), F.posexplode("calls").alias("pos", "callee"))
