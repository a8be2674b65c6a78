"""Retrieval for answers: by error anchors, call flow, metrics, gaps and the graph around results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import graph, search, symbols
from tessera.params import DEFAULT, Params

#: Columns of every retriever's result.
RESULT = ["content", "source", "path", "line_start", "line_end", "relevance"]


def describe(index: DataFrame, source: str, relevance: str | Column) -> DataFrame:
    """Index rows in the shape of RESULT."""
    content = F.concat_ws("\n", F.concat(F.col("symbol_type"), F.lit(" "), F.col("symbol_name")), F.when(F.col("signature") != "", F.col("signature")), F.when(F.col("docstring") != "", F.col("docstring")))
    return index.select(content.alias("content"), F.lit(source).alias("source"), F.col("file_path").alias("path"), "line_start", "line_end", (F.lit(relevance) if isinstance(relevance, str) else relevance).alias("relevance"))


def diagnostic_sites(index: DataFrame, anchors: dict[str, list[str]]) -> DataFrame:
    """Index rows that raise, say or are what anchors name, each once with its first `why`."""
    raised, said, named = anchors.get("exception_types", []), anchors.get("error_strings", []), anchors.get("function_refs", [])
    none = F.lit(False)
    raises = F.arrays_overlap("raises", F.array(*map(F.lit, raised))) if raised else none
    says = F.exists("error_strings", lambda s: _any(symbols.like(s, x) for x in said)) if said else none
    is_ = F.col("symbol_name").isin(*named) if named else none
    why = F.when(raises, "raises").when(says, "error string").when(is_, "named")
    return index.withColumn("why", why).where("why is not null")


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def diagnostic(index: DataFrame, anchors: dict[str, list[str]], *, sites: int = 3, mutators: int = 3, first: int = 5) -> DataFrame:
    """Where an error comes from: raising sites, and callers of the first of them that change state."""
    found = diagnostic_sites(index, anchors)
    place = F.when(F.col("why") == "raises", 0).when(F.col("why") == "error string", 1).otherwise(2)
    ordered = found.withColumn("_p", place).orderBy("_p", "file_path", "symbol_name")
    heads = ordered.limit(first).select("symbol_name").distinct()
    into = index.where(F.size("mutates") > 0).select("*", F.explode(F.array_distinct("calls")).alias("_callee")).join(heads.withColumnRenamed("symbol_name", "_callee"), "_callee", "left_semi")
    states = into.dropDuplicates(["file_path", "symbol_name"]).orderBy("file_path", "symbol_name").limit(mutators)
    return describe(ordered.limit(sites), "diagnostic", "error site").unionByName(describe(states.select(index.columns), "diagnostic", "mutates state before it"))


def exploratory(index: DataFrame, subject: str, *, rows: int = 5) -> DataFrame:
    """How something flows: entry rows named like the subject (routes, then functions), and what the best of them calls."""
    kind = F.when(F.col("symbol_type") == "route", 0).when(F.col("symbol_type") == "function", 1).otherwise(2)
    seeds = index.where(symbols.like(F.col("symbol_name"), subject) | symbols.like(F.col("file_path"), subject)).orderBy(kind, "id")
    start = seeds.limit(1).collect()
    if not start:
        return describe(index.limit(0), "exploratory", "")
    walk = graph.forward_walk(index, start[0]["symbol_name"])
    walked = index.join(walk.select("symbol_name", "file_path", "ord", "depth"), ["symbol_name", "file_path"]).orderBy("ord").limit(rows)
    flow = walk.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "depth", "symbol_name"))), lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), x["symbol_name"])), "\n").alias("content"))
    head = flow.select("content", F.lit("exploratory").alias("source"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"), F.lit("call flow").alias("relevance"))
    return head.unionByName(describe(walked, "exploratory", "step of the flow"))


def analytical(index: DataFrame, scope: str, issues: DataFrame | None = None, *, top: int = 3, most_issues: int = 5) -> DataFrame:
    """What is wrong in a part: symbols of high fan-out and fan-in in files like the scope, and its known issues."""
    rows = symbols.fan(symbols.in_file(index, scope))
    out = rows.where("high_fan_out").orderBy(F.desc("fan_out"), "id").limit(top)
    into = rows.where("high_fan_in").orderBy(F.desc("fan_in"), "id").limit(top)
    found = describe(out, "analytical", F.concat(F.lit("fan-out "), F.col("fan_out").cast("string"))).unionByName(describe(into, "analytical", F.concat(F.lit("fan-in "), F.col("fan_in").cast("string"))))
    if issues is not None:
        own = issues.where(symbols.like(F.col("file_path"), scope)).orderBy("id").limit(most_issues)
        found = found.unionByName(own.select(F.concat_ws("\n", "title", "content").alias("content"), F.lit("issue").alias("source"), F.col("file_path").alias("path"), "line_start", "line_end", F.concat_ws("/", "category", "severity").alias("relevance")))
    return found


def gap_to_index(index: DataFrame, gap: str, *, most: int = 5) -> DataFrame:
    """Rows for a gap: those of its file and symbol, else of its file (first ones), else of its symbol."""
    refs = index.sparkSession.range(1).select(fn.gap_references(F.lit(gap)).alias("r")).select("r.*").collect()[0]
    file, name = refs["file_path"], refs["function_name"]
    if not file and not name:
        return index.limit(0)
    in_file = symbols.like(F.col("file_path"), file) if file else F.lit(False)
    is_name = F.col("symbol_name") == name if name else F.lit(False)
    tier = F.when(in_file & is_name, 0).when(in_file, 1).when(is_name, 2)
    # The first rows of the best tier are the first rows by tier and id, less those of later tiers.
    first = index.withColumn("_tier", tier).where("_tier is not null").orderBy("_tier", "id").limit(most)
    return first.withColumn("_best", F.min("_tier").over(Window.partitionBy())).where("_tier = _best").drop("_tier", "_best")


def gap_lookup(nodes: DataFrame, edges: DataFrame, gap: str, hops: int = 1) -> tuple[DataFrame, DataFrame]:
    """The subgraph around the node that a specific gap names; empty if there is none."""
    name = nodes.sparkSession.range(1).select(fn.gap_node_name(F.lit(gap)).alias("n")).collect()[0]["n"]
    hit = nodes.where((F.col("name") == (name or "")) | F.col("id").endswith("::" + (name or "\0"))).orderBy("id").limit(1)
    return graph.neighborhood(nodes, edges, hit, hops)


def retrieve_gap(gap: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, point: list[float] | None, params: Params = DEFAULT) -> DataFrame:
    """(id, content) for one gap: a specific one from the graph, another from the nearest vectors."""
    specific = nodes.sparkSession.range(1).select(fn.is_specific_gap(F.lit(gap)).alias("s")).collect()[0]["s"]
    if specific:
        found = gap_lookup(nodes, edges, gap)[0]
        return found.select("id", graph.node_snippet(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("docstring"), F.col("signature")).alias("content"))
    if point is None:
        return vectors.select("id", F.col("document").alias("content")).limit(0)
    return search.vector_search(vectors, point, params.gap_top_k).select("id", F.col("document").alias("content"))


def read_response(response: str) -> tuple[str, list[str]]:
    """(answer, gaps) of one model answer on the driver: the same forms as text.answer_text and text.gap_list read."""

    def block(tag: str) -> str | None:
        found = re.search(rf"<{tag}>\s*(.+?)\s*</{tag}>", response, re.S | re.I)
        return found[1] if found else None

    answer, missing = block("answer"), block("missing")
    if answer is None and (found := re.search(r"ANSWER:\s*(.+)", response, re.S | re.I)):
        answer = re.split(r"\n<missing>|\nMISSING\s*[(:]", found[1], maxsplit=1, flags=re.I)[0]
    if missing is None and (found := re.search(r"MISSING[^:]*:\s*(.+)", response, re.S | re.I)):
        missing = found[1]
    lines = [x.strip().lstrip("-").strip() for x in (missing or "").strip().split("\n")]
    none = (missing or "").strip().upper().startswith("NONE")
    return (response if answer is None else answer).strip(), [x for x in lines if x and not x.upper().startswith("NONE") and not none]


def gap_loop(answers: list[str], retrieve, params: Params = DEFAULT) -> dict:
    """The iterative pass over model answers given as data: gaps are retrieved until none is new or passes run out.

    retrieve(gap) tells whether anything was found. Returns answer, passes, gaps_identified, gaps_resolved, gaps_unresolved.
    """
    identified, resolved, missing, answer, passes = [], [], [], "", 0
    for response in answers[: params.gap_passes]:
        passes += 1
        answer, gaps = read_response(response)
        fresh = [g for g in gaps if g not in missing]
        identified += [g for g in gaps if g not in identified]
        if not fresh:
            break
        for gap in fresh:
            (resolved if retrieve(gap) else missing).append(gap)
    return {"answer": answer, "passes": passes, "gaps_identified": identified, "gaps_resolved": list(dict.fromkeys(resolved)), "gaps_unresolved": missing}


def source_for_nodes(nodes: DataFrame, files: DataFrame, *, around: int = 5, per_file: int = 200, total: int = 1000) -> DataFrame:
    """(file_path, first, last, content): lines around the first node of each file, files in node order, to a total of lines."""
    order = Window.partitionBy("file_path").orderBy("pos")
    one = nodes.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    lines = F.split("content", "\n", -1)
    rows = one.join(files, "file_path").withColumn("_first", F.greatest(F.col("line_start") - around, F.lit(1)))
    rows = rows.withColumn("_last", F.least(F.col("line_end") + around, F.size(lines), F.col("_first") + per_file - 1)).where("_last >= _first")
    used = F.sum(F.col("_last") - F.col("_first") + 1).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_used", used).where(F.col("_used") - (F.col("_last") - F.col("_first") + 1) < total)
    rows = rows.withColumn("_last", F.least(F.col("_last"), F.col("_last") - (F.col("_used") - total)))
    return rows.select("file_path", F.col("_first").alias("first"), F.col("_last").alias("last"), F.array_join(F.slice(lines, F.col("_first"), F.col("_last") - F.col("_first") + 1), "\n").alias("content"))


def graph_context(results: DataFrame, nodes: DataFrame, edges: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Lines of the graph around search results: their files' nodes, two hops, most connected first, within a third of the budget."""
    seeds = graph.results_to_nodes(results, nodes).select(F.col("node_id").alias("id")).distinct()
    around, links = graph.neighborhood(nodes, edges, seeds, params.graph_hops, params.graph_confidence)
    return graph.pack_graph_context(around, links, params.max_context_tokens // 3, params)


def citations(cited: DataFrame, results: DataFrame, *, fallback: int = 3) -> DataFrame:
    """(path, title): cited paths (pos, path) that are among results, each once in order; the first results if none is valid."""
    known = results.groupBy("path").agg(F.min(F.struct("rank", "title")).alias("r")).select("path", "r.title", "r.rank")
    valid = cited.groupBy("path").agg(F.min("pos").alias("pos")).join(known, "path").select("path", "title", "pos")
    some = valid.agg((F.count("*") > 0).alias("some"))
    spare = known.orderBy("rank").limit(fallback).crossJoin(F.broadcast(some)).where(~F.col("some")).select("path", "title", F.col("rank").alias("pos"))
    return valid.unionByName(spare).orderBy("pos").select("path", "title")


def issue_context(issues: DataFrame, point: list[float] | None = None, *, most: int = 20, files: int = 5) -> dict[str, DataFrame]:
    """For questions about issues: the issues themselves, citations of the first files, and a confidence."""
    found = search.query_issues(issues, point, limit=most).withColumn("rank", F.row_number().over(Window.orderBy("distance" if point is not None else "id")) - 1)
    cited = found.groupBy("file_path").agg(F.min("rank").alias("rank")).orderBy("rank").limit(files)
    level = found.agg(F.when(F.count("*") >= 3, "high").when(F.count("*") >= 1, "medium").otherwise("low").alias("confidence"))
    return {"issues": found, "citations": cited, "confidence": level}


def route(query: str, mode: str, index: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """The retriever of a mode; conceptual questions get no code rows."""
    one = index.sparkSession.range(1)
    if mode == "diagnostic":
        return diagnostic(index, one.select(fn.error_anchors(F.lit(query)).alias("a")).collect()[0]["a"].asDict())
    if mode == "exploratory":
        subject = one.select(fn.trace_subject(F.lit(query)).alias("s")).collect()[0]["s"]
        return exploratory(index, subject) if subject else describe(index.limit(0), mode, "")
    if mode == "analytical":
        scope = one.select(fn.analysis_scope(F.lit(query)).alias("s")).collect()[0]["s"]
        return analytical(index, scope or "", issues)
    return describe(index.limit(0), "conceptual", "")


def assemble(response: DataFrame, confidence: DataFrame) -> DataFrame:
    """(answer, gaps, confidence, disclaimer) from one model response (response) and one confidence row."""
    notice = F.when(F.col("confidence") == "low", "Based on limited evidence; check the sources.").when(F.col("confidence") == "medium", "Based on partial evidence.").otherwise("")
    return response.crossJoin(F.broadcast(confidence.select("confidence"))).select(fn.answer_text(F.col("response")).alias("answer"), fn.gap_list(F.col("response")).alias("gaps"), "confidence", notice.alias("disclaimer"))
