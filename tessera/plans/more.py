"""Queries over retrieval, pages, directories, diagrams and scalar functions, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as fn
from tessera.operators import chunking, corpus, fulltext, graph, incremental, registry, render, retrieval, search, summaries, summary_blocks, symbols
from tessera.plans import catalog, views
from tessera.plans.catalog import _CALLS, _GRAPH, query
from tessera.plans.views import sql_view, table
from tessera.sources.durable import shared_folder
from tessera.streaming import jobs

_PAGES = views.PAGE_TABLE.format(sha="sha256(text)")
_FULL = dict(edges=views.EDGES, names=views.FULL_INDEX, pairs=_CALLS["pairs"].replace("b.symbol_name AS callee", "b.symbol_name AS callee, b.id AS callee_id"))
_COLS = "content, source, path, line_start, line_end, relevance"
_DESCRIBE = "symbol_type || ' ' || symbol_name || CASE WHEN signature <> '' THEN chr(10) || signature ELSE '' END || CASE WHEN docstring <> '' THEN chr(10) || docstring ELSE '' END AS content"


# Slugs, paths, titles and labels


@query("SELECT path, replace(path, '/', '--') AS slug FROM paths", paths=views.PATHS)
def note_slugs(spark, d):
    return sql_view(spark, d, "paths").select("path", fn.note_slug(F.col("path")).alias("slug"))


@query("SELECT path, target AS source_path FROM pages_", pages_=_PAGES)
def page_source_paths(spark, d):
    return views.page_table(spark, d).select("path", fn.source_path(F.col("path")).alias("source_path"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' X' || CAST(p_size AS VARCHAR) AS title FROM part")
def humanized_names(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.humanize(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("__x"), F.col("p_size").cast("string"))).alias("title"))


_PAGE_PATHS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'overview.md' WHEN 1 THEN 'architecture.md' WHEN 2 THEN 'workflows/' || source || '.md' WHEN 3 THEN 'directories/' || lang || '.md' WHEN 4 THEN 'files/x.md' ELSE source || '.md' END AS path, doc_id % 6 AS k, source, lang FROM documents"


@query("SELECT doc_id, CASE k WHEN 0 THEN 'overview' WHEN 1 THEN 'architecture' WHEN 2 THEN 'workflow' WHEN 3 THEN 'directory' WHEN 4 THEN 'file' ELSE 'wiki' END AS type, CASE k WHEN 0 THEN '/' WHEN 1 THEN '/architecture' WHEN 2 THEN '/workflows/' || source WHEN 3 THEN '/directories/' || lang WHEN 4 THEN '/files/x' ELSE '/' || source END AS url FROM p", p=_PAGE_PATHS)
def page_types_and_urls(spark, d):
    rows = views.rows(spark, d, _PAGE_PATHS)
    return rows.select("doc_id", fn.page_type(F.col("path")).alias("type"), fn.page_url(F.col("path")).alias("url"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'p' WHEN 1 THEN 'p / ' || source || ' / ' || lang ELSE 'p / ... / ' || source || ' / ' || lang END AS crumb FROM documents")
def breadcrumbs(spark, d):
    path = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat_ws("/", "source", "lang")).otherwise(F.concat_ws("/", F.lit("a/b/c"), "source", "lang"))
    return table(spark, d, "documents").select("doc_id", fn.breadcrumb(path, "p").alias("crumb"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN list_max(ends) > 0 THEN rtrim(substr(text, 1, list_max(ends))) || '...' ELSE regexp_replace(substr(text, 1, 400), '\\s+\\S*$', '') || '...' END AS short
 FROM (SELECT doc_id, text, list_prepend(0, list_filter(list_transform(range(1, len(s)), lambda i: CAST(list_sum(list_transform(s[1:i], lambda x: length(x) + 2)) AS BIGINT)), lambda n: n <= 400)) AS ends FROM (SELECT doc_id, text, string_split(text, '. ') AS s FROM documents))""")
def truncated_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.truncate_sentences(F.col("text"), 100).alias("short"))


@query("SELECT p_partkey, CASE WHEN length(l) > 40 THEN substr(l, 1, 37) || '...' ELSE l END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'n' || CAST(p_partkey AS VARCHAR) || replace(p_name, ' ', '') || '_' || p_type ELSE replace(p_name, ' ', '') || '_' || p_type || '_' || CAST(p_partkey AS VARCHAR) END AS node FROM (SELECT *, '(' || p_name || ') ''' || p_type || ''' | ' || p_brand || ' ' || p_name AS l FROM part)")
def diagram_labels(spark, d):
    label = F.concat(F.lit("["), F.col("p_name"), F.lit("]  \""), F.col("p_type"), F.lit("\" | "), F.col("p_brand"), F.lit(" \n"), F.col("p_name"))
    node = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_partkey").cast("string"), F.lit("::"), F.col("p_name"), F.lit("."), F.col("p_type"))).otherwise(F.concat(F.lit("/"), F.col("p_name"), F.lit("--"), F.col("p_type"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/")))
    return table(spark, d, "part").select("p_partkey", fn.diagram_label(label).alias("label"), fn.diagram_id(node).alias("node"))


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'kotlin' WHEN 3 THEN 'cpp' WHEN 4 THEN 'text' ELSE 'rust' END AS language, doc_id % 6 = 4 AS non_code FROM documents")
def file_languages(spark, d):
    k = F.col("doc_id") % 6
    path = F.concat(F.col("source"), F.lit("/f"), F.when(k == 0, ".PY").when(k == 1, ".d.tsx").when(k == 2, ".kt").when(k == 3, ".hpp").when(k == 4, ".CSV").otherwise(".rs"))
    return table(spark, d, "documents").select("doc_id", corpus.language(path).alias("language"), corpus.is_non_code(path).alias("non_code"))


# Questions, gaps and anchors


@query("SELECT id, CASE k WHEN 0 THEN string_split(p_name, ' ')[1] WHEN 1 THEN replace(p_name, ' ', '') WHEN 3 THEN string_split(lower(p_brand), '#')[1] END AS subject, CASE k WHEN 4 THEN string_split(p_name, ' ')[1] WHEN 5 THEN lower(p_type) WHEN 6 THEN string_split(p_name, ' ')[1] WHEN 7 THEN lower(p_type) END AS scope FROM q", q=views.QUESTIONS)
def question_subjects(spark, d):
    q = F.col("q")
    return sql_view(spark, d, "questions").select("id", fn.trace_subject(q).alias("subject"), fn.analysis_scope(q).alias("scope"))


@query("SELECT id, CASE k WHEN 8 THEN 'src/' || lower(p_type) || '.tsx' ELSE 'a/' || lower(p_type) || '.py' END AS file_path, name AS function_name FROM q WHERE k >= 8", q=views.QUESTIONS)
def gap_file_references(spark, d):
    return sql_view(spark, d, "questions").where("k >= 8").select("id", fn.gap_references(F.col("q")).alias("r")).select("id", "r.*")


_GAPS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'a/b.py::' || replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') || ' in x.py' WHEN 2 THEN 'the function ' || p_brand WHEN 3 THEN 'how a ' || p_name || ' is made' ELSE 'Class ' || p_type || ' of it' END AS gap, p_partkey % 5 AS k, p_name, p_brand, p_type FROM part"


@query("SELECT id, k <> 3 AS specific, CASE k WHEN 0 THEN replace(p_name, ' ', '_') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN p_brand WHEN 3 THEN 'how' ELSE p_type END AS node FROM g", g=_GAPS)
def gap_nodes(spark, d):
    return views.rows(spark, d, _GAPS).select("id", fn.is_specific_gap(F.col("gap")).alias("specific"), fn.gap_node_name(F.col("gap")).alias("node"))


_ERRORS = "SELECT p_partkey AS id, 'db.' || replace(p_name, ' ', '') || 'Error at File \"x/' || lower(p_type) || '.py\", line 7, in ' || replace(p_name, ' ', '_') || ' said ''no ' || p_name || ''' not abc, see b/c.ts' AS q, p_name, p_type FROM part"


@query("SELECT id, list_aggregate(list_sort(list_distinct(['db.' || replace(p_name, ' ', '') || 'Error', replace(p_name, ' ', '') || 'Error'])), 'string_agg', '|') AS exceptions, list_aggregate(list_sort(list_distinct(regexp_extract_all(q, '[\"'']([^\"'']{5,})[\"'']', 1))), 'string_agg', '|') AS said, list_aggregate(list_sort(['x/' || lower(p_type) || '.py', 'b/c.ts']), 'string_agg', '|') AS files, replace(p_name, ' ', '_') AS functions FROM e", e=_ERRORS)
def error_anchor_kinds(spark, d):
    rows = views.rows(spark, d, _ERRORS).select("id", fn.error_anchors(F.col("q")).alias("a"))
    return rows.select("id", *(F.array_join(f"a.{c}", "|").alias(n) for c, n in (("exception_types", "exceptions"), ("error_strings", "said"), ("file_refs", "files"), ("function_refs", "functions"))))


@query("SELECT id, CASE id % 5 WHEN 1 THEN '/items/' || name WHEN 2 THEN '' ELSE CASE WHEN id % 5 = 0 THEN 'sync' ELSE '' END END AS description FROM d", d=views.DECORATED)
def entry_descriptions(spark, d):
    k = F.col("id") % 5
    made = F.when(k == 0, F.array(F.lit("click.option('x')"), F.lit("cli.command('sync')"))).when(k == 1, F.array(F.concat(F.lit("app.get('/items/"), F.col("name"), F.lit("')")))).otherwise(F.col("decorators"))
    return sql_view(spark, d, "decorated").select("id", fn.decorator_route(made).alias("description"))


@query("SELECT id, symbol_type IN ('route', 'cli_command') OR id % 5 IN (0, 1, 2) OR name IN ('main', 'serve') AS entry, id % 5 IN (1, 2) AS handler FROM d", d=views.DECORATED)
def entry_predicates(spark, d):
    return sql_view(spark, d, "decorated").select("id", symbols.is_entry_point(F.col("symbol_type"), F.col("decorators"), F.col("name")).alias("entry"), symbols.is_route_handler(F.col("decorators")).alias("handler"))


# Structured text

_ANSWERS = "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"mode\": \"Diagnostic\", \"reasoning\": \"r' || event_type || '\", \"scope\": \"s\"}' WHEN 1 THEN '```json' || chr(10) || '{\"mode\": \"analytical\"}' || chr(10) || '```' WHEN 2 THEN '{\"mode\": \"other\"}' ELSE 'broken {' END AS a, event_type, event_id % 4 AS k FROM events"


@query("SELECT event_id, CASE k WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'analytical' ELSE 'conceptual' END AS mode, CASE k WHEN 0 THEN 'r' || event_type ELSE '' END AS reasoning, CASE k WHEN 0 THEN 's' END AS scope FROM a", a=_ANSWERS)
def classifications(spark, d):
    return views.rows(spark, d, _ANSWERS).select("event_id", fn.classification(F.col("a")).alias("c")).select("event_id", "c.*")


@query("SELECT event_id, CASE k WHEN 0 THEN 'Diagnostic' WHEN 1 THEN 'analytical' WHEN 2 THEN 'other' END AS mode FROM a", a=_ANSWERS)
def json_answers(spark, d):
    return views.rows(spark, d, _ANSWERS).select("event_id", fn.json_answer(F.col("a"), "mode string")["mode"].alias("mode"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) || '|x' AS items, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n FROM events")
def json_arrays(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    made = F.when(F.col("event_id") % 2 == 0, F.to_json(F.array("k", F.lit("x")))).otherwise(F.when(F.col("event_id") % 3 == 0, "no json"))
    full = fn.json_array(F.to_json(F.array("k", F.lit("x"))))
    return rows.select("event_id", F.array_join(full, "|").alias("items"), F.size(fn.json_array(made)).alias("n"))


@query("SELECT doc_id, '---' || chr(10) || 'source: ' || source || chr(10) || 'type: file' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'layer: ' || lang || chr(10) ELSE '' END || '---' || chr(10) || chr(10) || text AS page, source, CASE WHEN doc_id % 2 = 0 THEN lang END AS layer, text AS body FROM documents")
def frontmatter_pages(spark, d):
    none = F.lit(None).cast("string")
    page = fn.with_frontmatter(F.col("source"), F.lit("file"), none, none, F.when(F.col("doc_id") % 2 == 0, F.col("lang")), F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", page.alias("page")).withColumn("f", fn.frontmatter(F.col("page")))
    return rows.select("doc_id", "page", F.col("f")["source"].alias("source"), F.col("f")["layer"].alias("layer"), fn.frontmatter_body(F.col("page")).alias("body"))


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events")
def parsed_times(spark, d):
    k = F.col("event_id") % 3
    shown = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("yesterday")
    return table(spark, d, "events").select("event_id", fn.parse_time(shown).cast("timestamp_ntz").alias("at"))


# The code index


@query("SELECT id FROM names WHERE list_contains(raises, 'KeyError')", **_FULL)
def raising_symbols(spark, d):
    return symbols.raising(views.full_index(spark, d), "KeyError").select("id")


@query("SELECT id FROM names WHERE list_contains(mutates, 'total')", **_FULL)
def mutating_symbols(spark, d):
    return symbols.mutating(views.full_index(spark, d), "total").select("id")


@query("SELECT id FROM names WHERE len(list_filter(error_strings, lambda s: s ILIKE '%SUCH red _i%')) > 0", **_FULL)
def error_string_search(spark, d):
    return symbols.with_error_string(views.full_index(spark, d), "SUCH red _i").select("id")


@query("SELECT id, file_path LIKE '%brand1%' AS here, ends_with(symbol_name, '_7') AND file_path LIKE '%small%' AS named FROM names WHERE file_path LIKE '%brand1%' OR (symbol_name = 'red_widget_7' AND file_path LIKE '%small%') OR symbol_name = 'blue_bolt_3'", **_FULL)
def symbols_by_place(spark, d):
    rows = views.full_index(spark, d)
    some = symbols.in_file(rows, "BRAND1").unionByName(symbols.named(rows, "red_widget_7", "SMALL")).unionByName(symbols.named(rows, "blue_bolt_3")).dropDuplicates(["id"])
    return some.select("id", symbols.like(F.col("file_path"), "brand1").alias("here"), (F.col("symbol_name").endswith("_7") & symbols.like(F.col("file_path"), "small")).alias("named"))


_SITES = "SELECT *, CASE WHEN list_contains(raises, 'KeyError') THEN 'raises' WHEN len(list_filter(error_strings, lambda s: s ILIKE '%no such red%')) > 0 THEN 'error string' WHEN symbol_name IN ('blue_bolt_3', 'red_widget_7') THEN 'named' END AS why FROM names"
_ANCHORS = {"exception_types": ["KeyError"], "error_strings": ["no such red"], "function_refs": ["blue_bolt_3", "red_widget_7"]}


@query("SELECT id, why FROM s WHERE why IS NOT NULL", **_FULL, s=_SITES)
def diagnostic_anchor_sites(spark, d):
    return retrieval.diagnostic_sites(views.full_index(spark, d), _ANCHORS).select("id", "why")


_DIAGNOSTIC = dict(
    _FULL,
    s=_SITES,
    o="SELECT *, row_number() OVER (ORDER BY CASE why WHEN 'raises' THEN 0 WHEN 'error string' THEN 1 ELSE 2 END, file_path, symbol_name, id) AS n FROM s WHERE why IS NOT NULL",
    heads="SELECT DISTINCT symbol_name FROM o WHERE n <= 5",
)


@query(f"SELECT {_DESCRIBE}, 'diagnostic' AS source, file_path AS path, line_start, line_end, 'error site' AS relevance FROM o WHERE n <= 3", **_DIAGNOSTIC)
def diagnostic_retrieval(spark, d):
    # Symbols of one name in one file are told apart by id, so that the first ones are the same in both engines.
    rows = views.full_index(spark, d).withColumn("symbol_name", F.col("symbol_name"))
    return retrieval.diagnostic(rows, _ANCHORS).where("relevance = 'error site'")


@query("SELECT relevance, CAST(line_start AS VARCHAR) AS line_start FROM (SELECT 'fan-out ' || CAST(id % 30 AS VARCHAR) AS relevance, line_start FROM names WHERE file_path LIKE '%small%' AND id % 30 > 15 ORDER BY id % 30 DESC, id LIMIT 3) UNION ALL (SELECT category || '/' || severity, NULL FROM i WHERE file_path LIKE '%small%' ORDER BY id LIMIT 5)", **_FULL, i="SELECT id, file_path, 'security' AS category, 'problem' AS severity FROM names")
def analytical_retrieval(spark, d):
    rows = views.full_index(spark, d).withColumn("calls", F.transform(F.sequence(F.lit(0), (F.col("id") % 30).cast("int")), lambda k: F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("_"), k.cast("string"))))
    rows = rows.withColumn("calls", F.slice("calls", 1, F.size("calls") - 1))
    issues = rows.select("id", "file_path", F.lit("security").alias("category"), F.lit("problem").alias("severity"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"))
    return retrieval.analytical(rows, "small", issues).select("relevance", F.col("line_start").cast("string").alias("line_start"))


_GAP_HITS = "SELECT id, row_number() OVER (ORDER BY id) AS n FROM names WHERE file_path LIKE '%small/brand1.py%'"


@query("SELECT id FROM h WHERE n <= 5", **_FULL, h=_GAP_HITS)
def gap_index_rows(spark, d):
    return retrieval.gap_to_index(views.full_index(spark, d), "what is in `small/brand1.py`?").select("id")


@query("SELECT (SELECT least(count(*), 3) FROM names WHERE list_contains(raises, 'KeyError')) AS diagnostic, (SELECT count(*) FROM names WHERE false) AS conceptual", **_FULL)
def routed_retrieval(spark, d):
    rows = views.full_index(spark, d)
    found = retrieval.route("a KeyError came up", "diagnostic", rows).where("relevance = 'error site'")
    none = retrieval.route("what is this", "conceptual", rows)
    return found.agg(F.count("*").alias("diagnostic")).crossJoin(none.agg(F.count("*").alias("conceptual")))


# Graph


@query("SELECT id FROM hit UNION SELECT target FROM edges WHERE source IN (SELECT id FROM hit) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM hit)", **_GRAPH, hit="SELECT min(id) AS id FROM nodes WHERE name = 'red_widget'")
def gap_neighborhood(spark, d):
    """The surroundings of the node that a gap names, as a question's follow-up retrieves them."""
    nodes, edges = sql_view(spark, d, "nodes"), sql_view(spark, d, "edges")
    vectors = nodes.select("id", F.col("name").alias("document"))
    return retrieval.retrieve_gap("red_widget in small/x.py", nodes, edges, vectors, None).select("id")


_MOST_CALLING = "(SELECT source FROM edges WHERE type = 'calls' AND confidence >= 0.5 GROUP BY source ORDER BY count(*) DESC, source LIMIT 1)"
_MOST_CALLED = "(SELECT target FROM edges WHERE type = 'calls' AND confidence >= 0.5 GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"


@query(f"SELECT target AS id, 'called' AS way FROM edges WHERE type = 'calls' AND source = {_MOST_CALLING} AND confidence >= 0.5 UNION SELECT source, 'calling' FROM edges WHERE type = 'calls' AND target = {_MOST_CALLED} AND confidence >= 0.5", **_GRAPH)
def direct_calls(spark, d):
    """What the busiest caller calls, and what calls the most called node."""
    nodes, edges = sql_view(spark, d, "nodes"), sql_view(spark, d, "edges")
    strong = edges.where("type = 'calls' AND confidence >= 0.5")
    most = lambda end: strong.groupBy(end).count().orderBy(F.desc("count"), end).first()[0]
    called = graph.calls_of(nodes, edges, most("source"), 0.5).select("id", F.lit("called").alias("way"))
    return called.unionByName(graph.callers_of(nodes, edges, most("target"), 0.5).select("id", F.lit("calling").alias("way")))


_NO_TESTS = dict(_GRAPH, kept="SELECT id FROM nodes WHERE NOT regexp_matches(file_path, '(^|/)tests?/')")


@query("SELECT source, target FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)", **_NO_TESTS)
def graph_without_tests(spark, d):
    return graph.without_tests(sql_view(spark, d, "nodes"), sql_view(spark, d, "edges"))[1].select("source", "target")


@query("SELECT a.c AS \"from\", b.c AS \"to\", max(confidence) AS confidence, count(*) AS n FROM edges JOIN p a ON source = a.id JOIN p b ON target = b.id WHERE a.c <> b.c AND confidence >= 0.7 GROUP BY 1, 2", **_NO_TESTS, p="SELECT id, string_split(file_path, '/')[1] AS c FROM nodes WHERE id IN (SELECT id FROM kept)")
def architecture_components(spark, d):
    return graph.architecture(sql_view(spark, d, "nodes"), sql_view(spark, d, "edges"))["component_edges"]


_RESULTS = "SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) AS rid, 'files/' || lower(p_type) || '-' || lower(replace(p_brand, '#', '')) || '-m' || CAST(p_size AS VARCHAR(20)) || '-py.md' AS path, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/m' || CAST(p_size AS VARCHAR(20)) || '.py' AS file FROM part"


@query("SELECT r.rid, n.id AS node_id FROM r JOIN nodes n ON n.file_path = r.file", **_GRAPH, r=_RESULTS)
def search_results_to_nodes(spark, d):
    return graph.results_to_nodes(views.rows(spark, d, _RESULTS).drop("file"), sql_view(spark, d, "nodes")).select("rid", "node_id")


@query("SELECT source, target FROM i WHERE source = (SELECT min(source) FROM i) OR target = (SELECT min(source) FROM i)", i=views.IMPORTS)
def imports_of_a_file(spark, d):
    rows = sql_view(spark, d, "imports")
    return graph.file_imports_of(rows, rows.agg(F.min("source")).first()[0]).select("source", "target")


_WALK = dict(
    _CALLS,
    t="SELECT symbol_name, min(id) AS id FROM names GROUP BY 1",
    c="SELECT caller_id, callee, row_number() OVER (PARTITION BY caller_id ORDER BY callee) AS k FROM pairs",
    one="SELECT t.symbol_name AS caller, c.callee, c.k FROM t JOIN c ON c.caller_id = t.id WHERE c.k <= 3",
    l1="SELECT callee FROM one WHERE caller = (SELECT min(symbol_name) FROM names)",
    l2="SELECT o.callee FROM one o JOIN l1 ON o.caller = l1.callee",
    l3="SELECT o.callee FROM one o JOIN l2 ON o.caller = l2.callee",
)


@query("SELECT DISTINCT symbol_name FROM (SELECT min(symbol_name) AS symbol_name FROM names UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)", **_WALK)
def forward_call_walk(spark, d):
    rows = views.index(spark, d)
    return graph.forward_walk(rows, rows.agg(F.min("symbol_name")).first()[0]).select("symbol_name")


_DIAGRAMS = "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'flowchart LR' || chr(10) || 'subgraph a' || chr(10) || 'x[' || source || '] --> y' || chr(10) || 'end' WHEN 1 THEN 'graph TD' || chr(10) || 'x[a --> y' WHEN 2 THEN 'classDiagram' || chr(10) || ' +' || lang || '(x)' WHEN 3 THEN 'pie' ELSE 'flowchart LR' || chr(10) || 'subgraph a' || chr(10) || 'x' END AS content, doc_id % 5 AS k FROM documents"


@query("SELECT doc_id, k IN (0, 2) AS valid, k IN (0, 1) AS flow, k = 2 AS classes, false AS layers FROM g", g=_DIAGRAMS)
def diagram_checks(spark, d):
    c = F.col("content")
    return views.rows(spark, d, _DIAGRAMS).select("doc_id", graph.diagram_valid(c).alias("valid"), graph.diagram_useful(c).alias("flow"), graph.diagram_useful(c, "classes").alias("classes"), graph.diagram_useful(c, "layers").alias("layers"))


_SMALL_GRAPH = dict(_GRAPH, n2="SELECT * FROM nodes WHERE file_path LIKE '%brand1/m1.py' OR file_path LIKE '%brand2/m1.py'", e2="SELECT * FROM edges WHERE source IN (SELECT id FROM n2) AND target IN (SELECT id FROM n2)")


@query("SELECT 'flowchart LR' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY k, s), '') AS diagram FROM (SELECT 1 AS k, id AS s, '    ' || id || '[\"' || name || '\"]' AS line FROM n2 UNION ALL SELECT 2, source || chr(0) || target, '    ' || source || ' -->|' || type || '| ' || target FROM e2)", **_SMALL_GRAPH)
def flow_diagram(spark, d):
    nodes = sql_view(spark, d, "nodes").where("file_path like '%brand1/m1.py' or file_path like '%brand2/m1.py'")
    return graph.diagram(*graph.induced(nodes, sql_view(spark, d, "edges"), nodes))


# Directories and files

_DIRS = "SELECT DISTINCT unnest([source, source || '/' || lang]) AS path FROM paths"


@query("SELECT path, CASE WHEN path = '' THEN -1 ELSE length(path) - length(replace(path, '/', '')) END AS depth FROM (SELECT path FROM dirs UNION SELECT '') ORDER BY depth DESC, path", paths=views.PATHS, dirs=_DIRS)
def directory_order(spark, d):
    return corpus.processing_order(corpus.directories(sql_view(spark, d, "paths")))


@query("SELECT path FROM dirs UNION SELECT lang FROM paths", paths=views.PATHS, dirs=_DIRS)
def merged_directories(spark, d):
    rows = sql_view(spark, d, "paths")
    return corpus.merge_directories(rows, rows.select(F.col("lang").alias("path")))


@query("SELECT source || '/' || lang AS directory, count(*) AS n, min(path) AS first FROM paths GROUP BY 1", paths=views.PATHS)
def directory_files(spark, d):
    return corpus.files_by_directory(sql_view(spark, d, "paths")).select("directory", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("first"))


@query("SELECT directory, count(*) AS n FROM (SELECT string_split(file_path, '/')[1] AS directory FROM names) GROUP BY 1", **_CALLS)
def symbols_under_directories(spark, d):
    return corpus.symbols_below(sql_view(spark, d, "call_index")).groupBy("directory").agg(F.count("*").alias("n"))


@query("SELECT path FROM paths WHERE lang = 'en' OR source = (SELECT min(source) FROM paths)", paths=views.PATHS)
def excluded_by_ancestor(spark, d):
    rows = sql_view(spark, d, "paths")
    out = rows.where("lang = 'en'").select(F.concat_ws("/", "source", "lang").alias("path")).union(rows.agg(F.min("source").alias("path")))
    return corpus.has_excluded_ancestor(rows, out.distinct()).select("path")


@query("SELECT path FROM paths WHERE strpos(path, 'en/') > 0 AND source <> (SELECT max(source) FROM paths)", paths=views.PATHS)
def ignore_preview(spark, d):
    rows = sql_view(spark, d, "paths")
    return corpus.preview_search(rows, "EN/", rows.agg(F.max("source").alias("path"))).select("path")


@query("SELECT doc_id AS pos FROM documents WHERE text ILIKE '%tion%' ORDER BY doc_id <= 50, doc_id LIMIT 1")
def wrapped_log_search(spark, d):
    return corpus.next_match(table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text"), "TION", 50).select("pos")


@query("SELECT doc_id, regexp_matches(path, '(^|/)(en|vendor)/') OR path LIKE '%5.py' AND NOT starts_with(path, 'web1') AS out FROM paths", paths=views.PATHS)
def exclusion_variants(spark, d):
    rows = sql_view(spark, d, "paths")
    rule = corpus.excluded(F.col("path"), ["en/", "vendor"], []) | corpus.excluded(F.col("path"), ["*5.py"], ["web1"])
    return rows.select("doc_id", rule.alias("out"))


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'excluded_by_rule' WHEN path LIKE '%7.py' THEN 'excluded_by_ignore' WHEN strlen(text) > 2048 OR list_sum(list_transform(string_split(text, chr(10))[1:20], lambda x: length(x))) / len(string_split(text, chr(10))[1:20]) > 500 THEN 'excluded_by_rule' ELSE 'included' END AS category FROM paths) GROUP BY 1", paths=views.PATHS)
def categorized_files(spark, d):
    from dataclasses import replace

    from tessera.params import DEFAULT

    files = sql_view(spark, d, "paths").select("path", F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))
    rows = corpus.categorize(files, ["*7.py"], replace(DEFAULT, max_file_size_kb=2), default_patterns=["en/"])
    return rows.groupBy("category").agg(F.count("*").alias("n"))


# Summaries


@query("SELECT directory, sha256(f || '||' || coalesce(c, '')) AS signature FROM (SELECT source || '/' || lang AS directory, string_agg(CAST(doc_id AS VARCHAR) || '.py:' || sha256(text), '|' ORDER BY CAST(doc_id AS VARCHAR) || '.py:' || sha256(text)) AS f FROM documents GROUP BY 1) LEFT JOIN (SELECT '' AS d, '' AS c) ON d = directory UNION ALL SELECT source, sha256('||' || string_agg(source || '/' || lang || ':p' || lang, '|' ORDER BY source || '/' || lang || ':p' || lang)) FROM (SELECT DISTINCT source, lang FROM documents) GROUP BY 1")
def deep_directory_signature(spark, d):
    rows = sql_view(spark, d, "paths")
    files = rows.select("path", fn.content_hash(F.col("text")).alias("hash"))
    children = rows.select(F.concat_ws("/", "source", "lang").alias("directory"), F.concat(F.lit("p"), F.col("lang")).alias("purpose")).distinct()
    return summaries.directory_signature_deep(files, children)


_METHODS = "SELECT lower(p_type) AS file_path, p_brand AS parent, replace(p_name, ' ', '_') || CAST(p_partkey AS VARCHAR(20)) AS name, CAST(p_partkey AS INTEGER) AS start_line, CASE WHEN p_size % 2 = 0 THEN 'method' ELSE 'function' END AS symbol_type FROM part"


@query("SELECT file_path, class, array_to_string(methods, '|') AS methods FROM (SELECT file_path, parent AS class, list(name ORDER BY n) AS methods, min(start_line) AS first_line FROM (SELECT *, row_number() OVER (PARTITION BY file_path, parent ORDER BY start_line, name) AS n FROM m WHERE symbol_type = 'method') WHERE n <= 5 GROUP BY 1, 2 ORDER BY file_path, first_line, class LIMIT 15)", m=_METHODS)
def class_methods(spark, d):
    return summaries.methods_per_class(views.rows(spark, d, _METHODS)).select("file_path", "class", F.array_join("methods", "|").alias("methods"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 2")
def top_lines_per_group(spark, d):
    rows = summaries.top_per_group(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 2)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT slug, layer AS primary_layer FROM (SELECT slug, layer, row_number() OVER (PARTITION BY slug ORDER BY count(*) DESC, layer) AS n FROM (SELECT dep AS slug, layer FROM s) GROUP BY slug, layer) WHERE n = 1", s=views.SUMMARIES)
def workflow_primary_layer(spark, d):
    rows = sql_view(spark, d, "summaries")
    return summaries.primary_layer(rows.select(F.col("dep").alias("slug"), F.col("file_path").alias("file")), rows.select(F.col("file_path").alias("file"), "layer"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Unknown' ELSE p_name END AS purpose, CASE WHEN p_size % 2 = 0 THEN 'api' ELSE 'utility' END AS layer, CAST(0 AS INTEGER) AS n FROM part")
def summary_fallbacks(spark, d):
    none = F.lit(None).cast("array<string>")
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("purpose"), F.when(F.col("p_size") % 2 == 0, "API").otherwise("nowhere").alias("layer"), none.alias("key_abstractions"), none.alias("internal_deps"), none.alias("external_deps"))
    return summaries.with_fallbacks(rows).select("p_partkey", "purpose", "layer", F.size("key_abstractions").alias("n"))


# Incremental work and the store


@query("SELECT DISTINCT g.target, g.type FROM g JOIN notes n ON n.target = g.target AND n.scope = g.type AND n.updated_at > g.generated_at", notes=views.NOTES, g="SELECT DISTINCT scope AS type, target, DATE '1997-06-01' AS generated_at FROM notes")
def pages_with_newer_notes(spark, d):
    notes = sql_view(spark, d, "notes")
    made = notes.select(F.col("scope").alias("type"), "target", F.lit("1997-06-01").cast("date").alias("generated_at")).distinct()
    return incremental.newer_notes(notes, made)


@query("SELECT scope, target, seq FROM notes WHERE scope = 'file'", notes=views.NOTES)
def listed_notes(spark, d):
    return incremental.list_notes(sql_view(spark, d, "notes"), "file").select("scope", "target", "seq")


@query("SELECT directory, NOT (directory LIKE '%/en') AS regenerate, length(directory) - length(replace(directory, '/', '')) AS depth FROM (SELECT source || '/' || lang AS directory FROM documents UNION SELECT source FROM documents)")
def directories_to_regenerate(spark, d):
    rows = sql_view(spark, d, "paths")
    files = rows.select("path", fn.content_hash(F.col("text")).alias("hash"))
    children = rows.select(F.concat_ws("/", "source", "lang").alias("directory"), F.col("lang").alias("purpose")).distinct()
    stored = summaries.directory_signature_deep(files, children).where("directory like '%/en'")
    pages = stored.select(F.lit("directory").alias("type"), F.col("directory").alias("target"), F.col("signature").alias("source_hash"))
    return incremental.changed_directories(files, children, pages).select("directory", "regenerate", "depth")


@query("SELECT count(*) FILTER (doc_id % 1000 = 1) > 0 AS regenerate, true AS without, count(*) < 0 AS none FROM documents")
def synthesis_decision(spark, d):
    rows = table(spark, d, "documents").select((F.col("doc_id") % 1000 == 1).alias("regenerate"))
    none = rows.select(F.lit(False).alias("regenerate"))
    parts = [incremental.needs_synthesis(rows, none, True), incremental.needs_synthesis(none, none, False).withColumnRenamed("regenerate", "without"), incremental.needs_synthesis(none, none, True).withColumnRenamed("regenerate", "none")]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])


@query("SELECT file_path, purpose, CASE WHEN dep LIKE '%1' THEN 'utility' ELSE layer END AS layer FROM s", s=views.SUMMARIES)
def placeholder_summaries(spark, d):
    rows = sql_view(spark, d, "summaries").withColumn("layer", F.when(~F.col("dep").like("%1"), F.col("layer")))
    none = F.array().cast("array<string>")
    fresh = rows.where("dep not like '%1'").select("file_path", "purpose", "layer", none.alias("key_abstractions"), none.alias("internal_deps"), none.alias("external_deps"))
    return incremental.with_placeholders(fresh, rows.where("dep like '%1'")).select("file_path", "purpose", "layer")


@query("SELECT target, type FROM g WHERE target NOT IN (SELECT target FROM g WHERE type = 'workflow')", g=_PAGES)
def deleted_pages(spark, d):
    rows = views.page_table(spark, d)
    return incremental.delete(rows, rows.where("type = 'workflow'").select("target")).select("target", "type")


@query("SELECT target, CASE WHEN type = 'file' THEN 'new' ELSE type END AS type FROM g", g=_PAGES)
def replaced_pages(spark, d):
    rows = views.page_table(spark, d)
    return incremental.replace_by(rows, rows.where("type = 'file'").withColumn("type", F.lit("new")), "target").select("target", "type")


@query("SELECT id, 'cancelled' AS status FROM (SELECT id, arg_max(status, seq) AS status FROM (SELECT * FROM jobs) GROUP BY 1) WHERE status IN ('pending', 'running') AND id = (SELECT min(id) FROM (SELECT id, arg_max(status, seq) AS status FROM jobs GROUP BY 1) WHERE status = 'running')", jobs=views.JOBS)
def cancelled_job(spark, d):
    states = incremental.job_states(sql_view(spark, d, "jobs"), ["seq"])
    first = states.where("status = 'running'").agg(F.min("id")).first()[0]
    return incremental.cancel(states, first or "", F.current_timestamp()).select("id", "status")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN false ELSE NOT (c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0) END AS mismatch FROM customer")
def embedding_mismatch(spark, d):
    """Customers as repositories: those indexed by another provider or model than is configured now; a third has no index yet."""
    customers = table(spark, d, "customer")
    stored = customers.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_mktsegment").alias("provider"), (F.col("c_nationkey") % 2).cast("string").alias("model"))
    wanted = customers.select("c_custkey", F.lit("BUILDING").alias("provider"), F.lit("0").alias("model"))
    return incremental.mismatches(stored, wanted, ["c_custkey"])


# Answers

_CITED = "SELECT 'files/' || CAST(doc_id * 3 AS VARCHAR(20)) AS path, doc_id AS pos FROM documents"
_FOUND = "SELECT 'files/' || CAST(doc_id AS VARCHAR(20)) AS path, source AS title, doc_id AS rank FROM documents"


@query("SELECT f.path, f.title FROM f JOIN c ON c.path = f.path", c=_CITED, f=_FOUND)
def valid_citations(spark, d):
    return retrieval.citations(views.rows(spark, d, _CITED), views.rows(spark, d, _FOUND))


@query("SELECT path, title FROM f ORDER BY rank LIMIT 3", f=_FOUND)
def fallback_citations(spark, d):
    return retrieval.citations(views.rows(spark, d, _CITED).select(F.lit("files/none").alias("path"), "pos"), views.rows(spark, d, _FOUND))


_ISSUES = "SELECT 'i' || CAST(doc_id AS VARCHAR(20)) AS id, source || '/' || lang AS file_path, CASE doc_id % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'reliability' ELSE 'maintainability' END AS category, CASE doc_id % 4 WHEN 0 THEN 'problem' ELSE 'suggestion' END AS severity, lang AS title, source AS content, CAST(NULL AS INTEGER) AS line_start, CAST(NULL AS INTEGER) AS line_end FROM documents"


@query("SELECT id, category, severity FROM i WHERE category = 'security' AND severity = 'problem' ORDER BY id LIMIT 7", i=_ISSUES)
def filtered_issues(spark, d):
    rows = views.rows(spark, d, _ISSUES)
    return search.query_issues(rows.orderBy("id"), None, category="security", severity="problem", limit=7).select("id", "category", "severity")


@query("SELECT count(*) AS issues, 'high' AS confidence FROM (SELECT id FROM i LIMIT 20)", i=_ISSUES)
def issue_answer_context(spark, d):
    found = retrieval.issue_context(views.rows(spark, d, _ISSUES))
    return found["issues"].agg(F.count("*").alias("issues")).crossJoin(found["confidence"])


@query("SELECT conv_id, turn, CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE 1 END AS answered, 'Based on partial evidence.' AS disclaimer FROM conversations")
def assembled_answers(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("<answer>"), F.col("text"), F.lit("</answer>")).alias("response"))
    one = spark.createDataFrame([("medium",)], "confidence string")
    keyed = rows.join(retrieval.assemble(rows.select("response").distinct(), one).withColumn("response", F.concat(F.lit("<answer>"), F.col("answer"), F.lit("</answer>"))).select("answer", "disclaimer").distinct(), fn.answer_text(F.col("response")) == F.col("answer"))
    return keyed.select("conv_id", "turn", F.when(F.col("answer") == fn.strip(F.col("response")), 0).otherwise(1).alias("answered"), "disclaimer")


@query("SELECT count(*) AS semantic, count(*) FILTER (lang = 'en') AS fulltext, count(*) FILTER (source = 'web1') AS used, count(*) > 0 AS semantic_ok, count(*) FILTER (lang = 'en') > 0 AS fulltext_ok FROM documents")
def search_quality_counts(spark, d):
    docs = table(spark, d, "documents")
    return search.search_quality(docs, docs.where("lang = 'en'"), docs.where("source = 'web1'"))


@query("SELECT doc_id, text AS content, CASE doc_id % 2 WHEN 0 THEN 'api' END AS layer, CASE WHEN doc_id % 2 = 0 AND strpos(text, 'the') > 0 THEN 'the' ELSE '' END AS symbols, CASE doc_id % 2 WHEN 0 THEN 'x.py' ELSE '' END AS imports FROM documents")
def enriched_chunks(spark, d):
    docs = table(spark, d, "documents")
    key = F.col("doc_id").cast("string").alias("file_path")
    even = docs.where("doc_id % 2 = 0")
    chunks = docs.select("doc_id", F.col("text").alias("content"), F.col("doc_id").cast("string").alias("source_path"))
    rows = chunking.enrich(chunks, even.select(key, F.lit("api").alias("layer")), even.select(key, F.lit("the").alias("name")), even.select(key, F.lit("x.py").alias("target")), docs.where("false").select(key, F.lit("e").alias("name")))
    return rows.select("doc_id", "content", "layer", F.array_join("symbols", "|").alias("symbols"), F.array_join("imports", "|").alias("imports"))


@query("SELECT doc_id, array_to_string(l[1 : least(4, len(l))], chr(10)) AS snippet FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) >= 2 UNION ALL SELECT doc_id, l[1] FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) WHERE len(l) = 1")
def call_snippets(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", chunking.call_snippet(F.col("text"), F.lit(2), 2, 2).alias("snippet"))


@query("SELECT source, lang, array_to_string(list(DISTINCT '- ' || dep ORDER BY '- ' || dep), chr(10)) AS text FROM (SELECT source, lang, source || '.' || lang AS dep FROM documents) GROUP BY 1, 2")
def bullet_lists(spark, d):
    rows = table(spark, d, "documents").select("source", "lang", F.concat_ws(".", "source", "lang").alias("dep")).distinct()
    found = render.bullet_list(rows, "dep", ["source", "lang"])
    name = next(c for c in found.columns if c not in ("source", "lang"))
    return found.select("source", "lang", F.col(name).alias("text"))


# Stored index, job feed, registry


@query(catalog.ORACLE_SQL["fts_bm25_topk"])
def fts_stored_index(spark, d):
    """The question of fts_bm25_topk, answered from a stored index that is built first."""
    root = shared_folder(spark)
    fulltext.build(table(spark, d, "documents").select("doc_id", "text"), root, id_col="doc_id", text_cols=["text"])
    scored = fulltext.bm25(spark, root, catalog.PHRASE, clamp=False)
    return search.top_k(scored, 20, F.desc("score"), F.asc("id")).select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("SELECT id, CASE status WHEN 'completed' THEN 'complete' WHEN 'failed' THEN 'failed' ELSE 'progress' END AS event, status, CAST(seq AS BIGINT) AS seq, events FROM (SELECT id, arg_max(status, (ts, seq)) AS status, arg_max(seq, (ts, seq)) AS seq, count(*) AS events FROM jobs GROUP BY 1)", jobs=views.JOBS)
def job_stream(spark, d):
    """The job feed as a stream to its end: events in, the latest state of each job out, as progress events."""
    schema = table(spark, d, "events").schema
    events = jobs.read_events(spark, f"{d}/events.parque[t]", schema)
    rows = events.select(F.col("user_id").cast("string").alias("id"), "ts", F.col("event_id").alias("seq"), jobs.status_of(F.col("event_type")).alias("status"))
    root = shared_folder(spark)
    states = jobs.latest_states(rows)
    stream = states.writeStream.outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
    stream = stream.foreachBatch(lambda batch, k: batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"{root}/states")).start()
    stream.awaitTermination()
    newest = spark.read.parquet(f"{root}/states").groupBy("id").agg(F.max_by(F.struct("ts", "seq", "status", "events"), "batch").alias("s")).select("id", "s.*")
    sent = jobs.progress_events(newest)
    return sent.select(F.get_json_object("data", "$.id").alias("id"), "event", F.get_json_object("data", "$.status").alias("status"), F.get_json_object("data", "$.seq").cast("bigint").alias("seq"), F.get_json_object("data", "$.events").cast("bigint").alias("events"))


@query("SELECT row_number() OVER (ORDER BY s_name) AS id, s_name AS origin_url, CASE WHEN row_number() OVER (ORDER BY s_name) = 3 THEN 'ready' ELSE 'pending' END AS status FROM supplier QUALIFY row_number() OVER (ORDER BY s_name) <> 5")
def repository_registry(spark, d):
    new = table(spark, d, "supplier").select(F.col("s_name").alias("origin_url"), F.lit("git").alias("source_type"), F.lit("/x").alias("local_path"), F.col("s_name").alias("display_name"))
    rows = registry.add_repos(schemas.empty(spark, "repos"), new.unionByName(new), F.current_timestamp())
    rows = registry.add_repos(rows, new, F.current_timestamp())
    rows = registry.delete_repo(registry.update_repo(rows, 3, status="ready", id=99), 5)
    return registry.list_repos(rows).select("id", "origin_url", "status")


@query("SELECT key, value FROM (SELECT event_type AS key, arg_max(CAST(user_id AS VARCHAR), event_id) AS value FROM events GROUP BY 1) WHERE key <> 'error'")
def settings_store(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("event_id").alias("seq"))
    kept = registry.set_settings(schemas.empty(spark, "settings"), rows)
    gone = spark.createDataFrame([("error",)], "key string")
    return registry.delete_settings(kept, gone).select("key", "value")


_BLOCKS = "SELECT doc_id, 'intro' || chr(10) || CASE doc_id % 4 WHEN 0 THEN '---' || chr(10) || 'file_summary:' || chr(10) || '  purpose: \"does: ' || source || '\"' || chr(10) || '  layer: ' || CASE WHEN doc_id % 8 = 0 THEN 'api' ELSE 'nowhere' END || chr(10) || '  key_abstractions: [A, ' || lang || ']' || chr(10) || '  issues:' || chr(10) || '    - title: t' || CAST(doc_id AS VARCHAR(20)) || chr(10) || '      category: security' || chr(10) || '      lines: [3, 9]' || chr(10) || '---' || chr(10) WHEN 1 THEN '---' || chr(10) || 'other: 1' || chr(10) || '---' || chr(10) WHEN 2 THEN '---' || chr(10) || '{ broken' || chr(10) || '---' || chr(10) ELSE '' END || 'rest' AS content, source, lang FROM documents"


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'intro' || chr(10) || 'rest' ELSE content END AS content, CASE WHEN doc_id % 4 = 0 THEN 'does: ' || source ELSE 'Unknown' END AS purpose, CASE WHEN doc_id % 8 = 0 THEN 'api' ELSE 'utility' END AS layer, CASE WHEN doc_id % 4 = 0 THEN 'A|' || lang ELSE '' END AS abstractions, CASE WHEN doc_id % 4 = 0 THEN 't' || CAST(doc_id AS VARCHAR) || ' security suggestion 3-9' ELSE '' END AS issues FROM b", b=_BLOCKS)
def summary_block_reader(spark, d):
    rows = views.rows(spark, d, _BLOCKS).select(F.col("doc_id").cast("string").alias("file_path"), "content")
    found = summary_blocks.file_summaries(rows)
    issues = F.array_join(F.transform("issues", lambda i: F.concat_ws(" ", i["title"], i["category"], i["severity"], F.concat_ws("-", i["line_start"].cast("string"), i["line_end"].cast("string")))), "|")
    return found.select(F.col("file_path").cast("bigint").alias("doc_id"), "content", "purpose", "layer", F.array_join("key_abstractions", "|").alias("abstractions"), issues.alias("issues"))
