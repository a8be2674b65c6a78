"""The code graph: traversal within bounded hops, paths, components, entry points, diagrams.

nodes (id, name, type, file_path, ...), edges (source, target, type, confidence, line). Traversals unroll a few joins; none
collects a frontier to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.corpus import is_test_graph
from tessera.params import DEFAULT, Params
from tessera.sources.durable import Kept

#: Edges of a path at most, and paths reported.
LONGEST_PATH, MOST_PATHS = 10, 10
#: Pairs of results and nodes that one task makes, about.
PAIRS_PER_TASK = 5_000_000


def calls_of(nodes: DataFrame, edges: DataFrame, node: str, min_confidence: float = 0.0) -> DataFrame:
    """Nodes that a node calls."""
    out = edges.where((F.col("source") == node) & (F.col("type") == "calls") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    return nodes.join(out.select(F.col("target").alias("id")).distinct(), "id", "left_semi")


def callers_of(nodes: DataFrame, edges: DataFrame, node: str, min_confidence: float = 0.0) -> DataFrame:
    """Nodes that call a node."""
    into = edges.where((F.col("target") == node) & (F.col("type") == "calls") & (F.coalesce("confidence", F.lit(0.0)) >= min_confidence))
    return nodes.join(into.select(F.col("source").alias("id")).distinct(), "id", "left_semi")


def reached(edges: DataFrame, seeds: DataFrame, hops: int, min_confidence: float = 0.0) -> DataFrame:
    """(id, hop): what lies within hops of seeds (id), edges taken both ways, with the least number of hops."""
    strong = edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    both = strong.select(F.col("source").alias("a"), F.col("target").alias("b")).union(strong.select(F.col("target"), F.col("source"))).distinct()
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for hop in range(1, hops + 1):
        nxt = both.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = nxt.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes among ids, and edges of enough confidence with both ends among them."""
    strong = edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    inner = strong.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")
    return nodes.join(ids.select("id"), "id", "left_semi"), inner


def neighborhood(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = 2, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The subgraph within hops of seeds; several seeds give the union of theirs."""
    return induced(nodes, edges, reached(edges, seeds, hops, min_confidence), min_confidence)


def distances_to(edges: DataFrame, end: str, longest: int) -> DataFrame:
    """(id, left): fewest edges from a node to `end`, for nodes at most `longest` away; edges (source, target)."""
    keep = Kept(edges.sparkSession)
    seen = frontier = edges.sparkSession.createDataFrame([(end, 0)], "id string, left int")
    for hop in range(1, longest + 1):
        nxt = edges.join(frontier.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
        frontier = keep(nxt.join(seen, "id", "left_anti").withColumn("left", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(edges: DataFrame, start: str, end: str, *, min_confidence: float = 0.0, longest: int = LONGEST_PATH, most: int = MOST_PATHS) -> DataFrame:
    """(path, hops): simple paths of at most `longest` edges, shortest first, by their nodes within a length.

    Distances are found backwards from the end first, by frontiers of nodes. An open path then goes on only to nodes from
    which the end is near enough, so paths that can't get there in time are never made. Shorter paths come first: the walk
    ends as soon as `most` are found, and before it starts if the end can't be reached.
    """
    spark = edges.sparkSession
    keep = Kept(spark)
    strong = keep(edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence).select("source", "target").distinct())
    left = distances_to(strong, end, longest)
    # Only edges between nodes that lead to the end matter, each with what is left after it.
    useful = keep(strong.join(left.select(F.col("id").alias("target"), "left"), "target"))
    open_ = left.where(F.col("id") == start).select(F.array("id").alias("path"), F.col("id").alias("at"))
    done: list[tuple[list[str], int]] = []
    for step in range(1, longest + 1):
        grown = open_.join(useful, open_["at"] == useful["source"]).where(~F.array_contains("path", F.col("target")) & (F.col("left") <= longest - step))
        grown = keep(grown.select(F.concat("path", F.array("target")).alias("path"), F.col("target").alias("at")))
        # Paths found are few once cut to what is asked for; they go on as rows of the driver's, the open ones as a frame.
        hit = grown.where(F.col("at") == end).orderBy("path").limit(most - len(done)).select("path").collect()
        done += [(r["path"], step) for r in hit]
        open_ = grown.where(F.col("at") != end)
        if len(done) >= most or open_.isEmpty():
            break
    return spark.createDataFrame(done, "path array<string>, hops int").orderBy("hops", "path")


def component(path: Column) -> Column:
    """The top-level directory; a root file is its own."""
    return F.substring_index(path, "/", 1)


def component_graph(nodes: DataFrame, edges: DataFrame, min_confidence: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(components, edges): edges between components with the largest confidence and how many they stand for; isolated ones stay."""
    placed = nodes.select("id", component(F.col("file_path")).alias("component"))
    strong = edges.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    both = strong.join(placed.select(F.col("id").alias("source"), F.col("component").alias("from")), "source").join(placed.select(F.col("id").alias("target"), F.col("component").alias("to")), "target")
    between = both.where(F.col("from") != F.col("to")).groupBy("from", "to").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n"))
    return placed.select("component").distinct(), between


def without_tests(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(~is_test_graph(F.col("file_path")))
    return kept, induced(kept, edges, kept)[1]


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at a node, of any type; a self loop counts twice."""
    return edges.select(F.col("source").alias("id")).union(edges.select("target")).groupBy("id").agg(F.count("*").alias("degree"))


def by_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "id")


def entry_points(nodes: DataFrame, edges: DataFrame, n: int = 5) -> DataFrame:
    """The n nodes of most outgoing calls that no node outside tests calls; with calls_out and degree_out (all edge types)."""
    plain = nodes.where(~is_test_graph(F.col("file_path"))).select("id")
    calls = edges.where(F.col("type") == "calls")
    called = calls.join(plain.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("target").alias("id")).distinct()
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("type") == "calls").alias("calls_out"), F.count("*").alias("degree_out"))
    return plain.join(out, "id").where("calls_out > 0").join(called, "id", "left_anti").orderBy(F.desc("calls_out"), "id").limit(n)


def entry_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that call and are not called."""
    calls = edges.where(F.col("type") == "calls")
    return nodes.join(calls.select(F.col("source").alias("id")).distinct(), "id", "left_semi").join(calls.select(F.col("target").alias("id")).distinct(), "id", "left_anti")


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that call nothing, isolated ones too."""
    return nodes.join(edges.where(F.col("type") == "calls").select(F.col("source").alias("id")).distinct(), "id", "left_anti")


def call_sites(nodes: DataFrame, edges: DataFrame, file: Column | str) -> DataFrame:
    """(caller_file, caller_symbol, line, target_symbol, target_file): calls into the symbols of a file."""
    target = nodes.where(F.col("file_path") == file).select(F.col("id").alias("target"), F.col("name").alias("target_symbol"), F.col("file_path").alias("target_file"))
    source = nodes.select(F.col("id").alias("source"), F.col("file_path").alias("caller_file"), F.col("name").alias("caller_symbol"))
    return edges.where(F.col("type") == "calls").join(target, "target").join(source, "source").select("caller_file", "caller_symbol", "line", "target_symbol", "target_file")


def results_to_nodes(results: DataFrame, nodes: DataFrame, *, source_col: str | None = None) -> DataFrame:
    """results with the id of every node in their source file; the file is a column, or read off the page path.

    Few rows make many here, so they are dealt to tasks by the pairs they make, those of a file that makes more than one task's to several.
    """
    key = F.col(source_col) if source_col else fn.source_path(F.col("path"))
    results, nodes = results.withColumn("_file", key), nodes.select(F.col("file_path").alias("_file"), F.col("id").alias("node_id"))
    sizes = results.groupBy("_file").agg(F.count("*").alias("_n")).join(nodes.groupBy("_file").agg(F.count("*").alias("_m")), "_file")
    sizes = Kept(results.sparkSession)(sizes.select("_file", (F.col("_n") * F.col("_m")).alias("_made")))
    deal = math.ceil((sizes.agg(F.sum("_made")).first()[0] or 0) / PAIRS_PER_TASK) or 1
    large = F.broadcast(sizes.where(F.col("_made") > PAIRS_PER_TASK).select("_file", F.ceil(F.col("_made") / PAIRS_PER_TASK).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = results.join(large, "_file", "left").withColumn("_part", F.pmod(F.monotonically_increasing_id(), parts)).drop("_parts")
    right = nodes.join(large, "_file", "left").select("_file", "node_id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("_part"))
    return left.repartition(deal, "_file", "_part").join(right.repartition(deal, "_file", "_part"), ["_file", "_part"]).drop("_file", "_part")


def file_imports_of(imports: DataFrame, file: str) -> DataFrame:
    """Import edges (source, target) that touch one file."""
    return imports.where((F.col("source") == file) | (F.col("target") == file))


def import_closure(imports: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(path): files reached from seeds (path) over internal imports, seeds included; internal is a known file, a path or a .py."""
    known = imports.select(F.col("source").alias("target")).distinct().withColumn("_known", F.lit(True))
    inner = imports.join(known, "target", "left").where(F.col("_known") | F.contains("target", F.lit("/")) | F.col("target").endswith(".py")).select("source", "target").distinct()
    seen = frontier = seeds.select("path").distinct()
    for _ in range(depth):
        nxt = inner.join(frontier.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("target").alias("path")).distinct()
        frontier = nxt.join(seen, "path", "left_anti")
        seen = seen.union(frontier)
    return seen.orderBy("path")


def forward_walk(index: DataFrame, start: str, max_depth: int = 3, branch: int = 3) -> DataFrame:
    """(symbol_name, file_path, depth, ord): calls from a symbol, the first `branch` of each, each symbol once, in depth-first order.

    `ord` is the path of choices that leads to a row; at most branch ** max_depth rows are ever made, so the visits are
    settled by one window over them.
    """
    table = index.groupBy("symbol_name").agg(F.min(F.struct("id", "file_path", "calls")).alias("r")).select("symbol_name", "r.file_path", "r.calls")
    level = table.where(F.col("symbol_name") == start).select("symbol_name", "file_path", "calls", F.lit(0).alias("depth"), F.array(F.lit(0)).alias("ord"), F.array("symbol_name").alias("trail"))
    rows = level
    for depth in range(1, max_depth + 1):
        nxt = level.select(F.col("ord").alias("up"), F.col("trail"), F.posexplode(F.slice("calls", 1, branch)).alias("k", "callee"))
        level = nxt.join(table, nxt["callee"] == table["symbol_name"]).where(~F.array_contains("trail", F.col("callee"))).select("symbol_name", "file_path", "calls", F.lit(depth).alias("depth"), F.concat("up", F.array("k")).alias("ord"), F.concat("trail", F.array("callee")).alias("trail"))
        rows = rows.unionByName(level)
    first = F.row_number().over(Window.partitionBy("symbol_name").orderBy("ord"))
    return rows.withColumn("_nth", first).where("_nth = 1").select("symbol_name", "file_path", "depth", "ord").orderBy("ord")


def unused(nodes: DataFrame, edges: DataFrame, sure: float = 0.7) -> DataFrame:
    """Nodes without incoming edges (probably unused) or with weak ones only (possibly); entry names and dunders aside."""
    best = edges.groupBy(F.col("target").alias("id")).agg(F.max("confidence").alias("best"))
    rows = nodes.where(~F.col("name").rlike(r"^(?:__\w+__|main|test_.*)$") & ~is_test_graph(F.col("file_path"))).join(best, "id", "left")
    return rows.where(F.col("best").isNull() | (F.col("best") < sure)).withColumn("verdict", F.when(F.col("best").isNull(), "probably unused").otherwise("possibly unused"))


def diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (diagram): nodes and edges as a flow chart, sorted. Meant for the few nodes of a subgraph."""
    lines = nodes.select(F.lit(1).alias("k"), F.col("id").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("id")), F.lit('["'), fn.diagram_label(F.col("name")), F.lit('"]')).alias("line"))
    arrows = edges.select(F.lit(2).alias("k"), F.concat_ws("\0", "source", "target").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("source")), F.lit(" -->|"), F.col("type"), F.lit("| "), fn.diagram_id(F.col("target"))).alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s", "line"))), lambda x: x["line"]), "\n")
    return lines.unionByName(arrows).agg(F.concat(F.lit("flowchart LR\n"), body).alias("diagram"))


def diagram_valid(content: Column) -> Column:
    """A known kind of diagram, balanced brackets, as many `subgraph` as `end` lines."""
    count = lambda s: F.length(content) - F.length(F.replace(content, F.lit(s), F.lit("")))
    kind = F.trim(content).rlike(r"^(?:flowchart|graph|classDiagram|sequenceDiagram|stateDiagram|erDiagram)\b")
    pairs = (count("[") == count("]")) & (count("(") == count(")")) & (count("{") == count("}"))
    blocks = F.size(F.regexp_extract_all(content, F.lit(r"(?m)(^\s*subgraph\b)"), 1)) == F.size(F.regexp_extract_all(content, F.lit(r"(?m)(^\s*end\s*$)"), 1))
    return kind & pairs & blocks


def diagram_useful(content: Column, kind: str = "flow") -> Column:
    """layers: two subgraphs and an edge; flow: an edge; classes: a member."""
    edge = content.rlike("-->|---|-\\.->|==>")
    if kind == "layers":
        return edge & (F.size(F.regexp_extract_all(content, F.lit(r"(?m)(^\s*subgraph\b)"), 1)) >= 2)
    return content.rlike(r"(?m)^\s+[+#~-]?\w+\(") if kind == "classes" else edge


def node_snippet(path: Column, first: Column, last: Column, docstring: Column, signature: Column) -> Column:
    head = F.concat(F.lit("### "), path, F.lit(":"), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.concat_ws("\n", head, F.when(docstring != "", docstring), F.when(signature != "", signature))


def within_budget(rows: DataFrame, budget: Column | int, *order: Column, tokens_col: str = "tokens", least: int = 1) -> DataFrame:
    """The rows that come, in an order, before the sum of their tokens exceeds a budget, with `pos` (from 0) and `running`.

    A row has `least` tokens or more, so no more than budget / least rows fit: that many are taken by a top-k, in which every
    partition keeps its own, and only those are summed up in order. budget is a number or a column of one value.
    """
    most = budget if isinstance(budget, int) else rows.select(F.max(budget)).first()[0] or 0
    few = rows.withColumn("_t", F.greatest(F.col(tokens_col), F.lit(least))).orderBy(*order).limit(max(most // least, 0) + 1)
    sequence = Window.orderBy(*order)
    summed = few.withColumn("pos", F.row_number().over(sequence) - 1).withColumn("running", F.sum("_t").over(sequence.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.where(F.col("running") <= budget).drop("_t")


def pack_graph_context(nodes: DataFrame, edges: DataFrame, budget: int, params: Params = DEFAULT) -> DataFrame:
    """(part, pos, line): diagram lines within their budget, then node snippets, most connected first, in what is left.

    The head of the diagram always stays. Neither part is ever sorted whole: see within_budget.
    """
    named = nodes.select(F.lit(1).alias("k"), F.col("id").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("id")), F.lit('["'), fn.diagram_label(F.col("name")), F.lit('"]')).alias("line"))
    arrows = edges.select(F.lit(2).alias("k"), F.concat_ws("\0", "source", "target").alias("s"), F.concat(F.lit("    "), fn.diagram_id(F.col("source")), F.lit(" -->|"), F.col("type"), F.lit("| "), fn.diagram_id(F.col("target"))).alias("line"))
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit("").alias("s"), F.lit("flowchart LR").alias("line"))
    lines = head.unionByName(named).unionByName(arrows).withColumn("tokens", fn.token_estimate(F.col("line")))
    lines = Kept(nodes.sparkSession)(within_budget(lines, params.diagram_token_budget, F.col("k"), F.col("s"), F.col("line")))
    spent = int(lines.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    snippets = nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    snippets = snippets.withColumn("line", node_snippet(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("docstring"), F.col("signature"))).withColumn("tokens", fn.token_estimate(F.col("line")))
    code = within_budget(snippets, max(budget - spent, 0), F.desc("degree"), F.col("id"))
    return lines.select(F.lit("diagram").alias("part"), "pos", "line").unionByName(code.select(F.lit("code").alias("part"), "pos", "line"))


def architecture(nodes: DataFrame, edges: DataFrame, *, min_confidence: float = 0.7, n_entry: int = 5, hops: int = 2) -> dict[str, DataFrame]:
    """Components, entry points and the flow below each of them, tests left out: what an architecture page is written from."""
    nodes, edges = without_tests(nodes, edges)
    components, between = component_graph(nodes, edges, min_confidence)
    entry = entry_points(nodes, edges, n_entry)
    flow_nodes, flow_edges = neighborhood(nodes, edges, entry, hops, min_confidence)
    return {"components": components, "component_edges": between, "entry_points": entry, "flow_nodes": flow_nodes, "flow_edges": flow_edges}
