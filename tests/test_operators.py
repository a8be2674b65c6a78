from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, corpus, graph, incremental, parsing, retrieval, search, summaries, symbols
from tessera.params import DEFAULT, Params
from tessera.schemas import TABLES, conform, empty


def ids(rows, column="id"):
    return sorted(r[column] for r in rows.select(column).collect())


# Search


def ranked_lists(spark, semantic, fulltext):
    make = lambda x: spark.createDataFrame([(k, r) for r, k in enumerate(x)], "id string, rank int")
    return search.reciprocal_rank_fusion(make(semantic), make(fulltext))


def test_fusion(spark):
    scores = {r.id: r.score for r in ranked_lists(spark, ["doc_a", "doc_b", "doc_c"], ["doc_b", "doc_a", "doc_d"]).collect()}
    assert scores["doc_a"] == scores["doc_b"] == pytest.approx(1 / 61 + 1 / 62)
    assert scores["doc_c"] == scores["doc_d"] == pytest.approx(1 / 63 + 1 / 1061)
    assert ranked_lists(spark, [], []).count() == 0 and ranked_lists(spark, ["x"], []).first().score == pytest.approx(1 / 61 + 1 / 1061)
    assert ranked_lists(spark, ["x", "y", "x"], []).where("id = 'x'").first().score == pytest.approx(1 / 63 + 1 / 1061)


@pytest.mark.parametrize(("distances", "want"), [([0.2, 0.3, 0.4, 0.7], "high"), ([0.4, 0.7, 0.8], "medium"), ([0.7, 0.9], "low"), ([], "low"), ([0.3, 0.4, 0.45], "medium")])
def test_confidence(spark, distances, want):
    rows = spark.createDataFrame([(x,) for x in distances], "distance double")
    assert search.confidence(rows).first().confidence == want


def test_types_come_in_order_and_duplicates_go(spark):
    rows = spark.createDataFrame([("n", "note", " Same text"), ("c", "code", "other"), ("w", "wiki", "same TEXT \n")], "id string, type string, content string")
    order = [search.type_priority(F.col("type")), F.col("id")]
    assert [r.id for r in search.prefix_dedup(rows, order).orderBy(*order).collect()] == ["n", "c"]


def test_phrase_prefix_and_packing(spark):
    rows = spark.createDataFrame([("a", "get user profile"), ("b", "user gets profile"), ("c", "The get USERs. Get user!")], "id string, text string")
    found = {r.id: r.matches for r in search.bm25(rows, "Get us", id_col="id", text_cols=["text"]).collect()}
    assert found == {"a": 1, "c": 2}
    assert search.bm25(rows, "", id_col="id", text_cols=["text"]).count() == 0
    tokens = spark.createDataFrame([(1, 4), (2, 5), (3, 100), (4, 1)], "rank int, t int")
    assert [r["rank"] for r in search.pack_context(tokens, [F.asc("rank")], 10, tokens=F.col("t")).collect()] == [1, 2]


# Corpus


def test_exclusion_rules(spark):
    paths = ["src/main.py", "node_modules/p/i.js", "a/build/o.js", ".git/config", "README.md", ".wiki/notes/n.md", "docs/x.txt", "x.min.js", "deep/a/b.c"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = ids(rows.where(~corpus.excluded(F.col("path"), [*corpus.DEFAULT_EXCLUDES, "docs/", "deep/a"])), "path")
    assert kept == sorted([".wiki/notes/n.md", "README.md", "src/main.py"])
    assert corpus.glob_regex("a[!b]*.p?") == r"^(?:a[^b][\s\S]*\.p[\s\S])$"


def test_scan_and_categories(spark):
    files = spark.createDataFrame(
        [("src/a.py", 10, b"x = 1\n"), ("src/b.bin", 10, b"a\0b"), ("src/c.js", 10, b"x" * 1001), ("big.py", 600 * 1024, b"x"), ("node_modules/i.js", 1, b"x"), ("own/f.py", 1, b"x")], "path string, length long, content binary"
    )
    assert [r.path for r in corpus.scan(files, ["own/"]).collect()] == ["src/a.py"]
    by = {r.path: r.category for r in corpus.categorize(files, ["own/"]).collect()}
    assert by["src/a.py"] == "included" and by["own/f.py"] == "excluded_by_ignore" and by["node_modules/i.js"] == by["src/b.bin"] == by["big.py"] == "excluded_by_rule"
    assert ids(corpus.collapse_directories(spark.createDataFrame([("a/build/x/y.js",), ("src/z.py",)], "path string"), ["build"]), "path") == ["a/build"]
    assert ids(corpus.directories(files), "path") == ["", "node_modules", "own", "src"]
    assert [r.path for r in corpus.processing_order(spark.createDataFrame([("",), ("b",), ("a/c",)], "path string")).collect()] == ["a/c", "b", ""]
    assert {r.parent: r.child for r in corpus.direct_children(spark.createDataFrame([("",), ("a",), ("a/b",)], "path string")).collect()} == {"": "a", "a": "a/b"}


def test_test_files_and_languages(spark):
    rows = spark.createDataFrame([("latest_x.py",), ("src/tests/a.py",), ("conftest.py",), ("a.spec.ts",), ("main.go",)], "p string")
    got = [tuple(r) for r in rows.select(corpus.is_test_graph(F.col("p")), corpus.is_test_snippet(F.col("p")), corpus.language(F.col("p"))).collect()]
    assert got == [(True, False, "python"), (True, True, "python"), (False, True, "python"), (True, True, "typescript"), (False, False, "go")]


def test_ignore_edit_and_search(spark):
    lines = spark.createDataFrame([(0, "# top"), (1, "old/"), (2, "keep"), (3, "keep")], "pos int, line string")
    assert [r.line for r in corpus.edit_ignore_file(lines, ["old"], ["new"], ["new/x.py", "y.py"]).collect()] == ["# top", "keep", "new/", "y.py"]
    entries = spark.createDataFrame([(0, "Error a"), (1, "ok"), (2, "error b")], "pos int, text string")
    assert corpus.next_match(entries, "ERROR", 0).first().pos == 2 and corpus.next_match(entries, "error", 2).first().pos == 0


# Chunks


def test_sections_and_chunks(spark):
    page = "---\ntype: file\n---\n\n# Title\n\nIntro text.\n\n## One\nbody one\n### Sub\nmore\n## Two\n" + " ".join(f"w{i}" for i in range(3000))
    rows = chunking.chunk_pages(spark.createDataFrame([("files/a-py.md", page), ("x.md", "plain")], "path string, content string")).orderBy("path", "chunk_index").collect()
    own = [r for r in rows if r.path == "files/a-py.md"]
    assert [r.section_header for r in own] == ["Introduction", "One", "Sub", "Two", "Two", "Two"]
    assert own[0].chunk_id == "wiki_files_a-py_introduction" and own[1].chunk_id == "wiki_files_a-py_one_1" and own[0].title == "Title" and own[0].type == "file"
    words = [r.content.split("\n\n", 1)[1].split() for r in own[3:]]
    assert [len(w) for w in words] == [1333, 1333, 600] and words[0][1200:] == words[1][:133] and words[2][-1] == "w2999"
    assert [r.section_header for r in rows if r.path == "x.md"] == ["Introduction"]


def test_line_and_symbol_chunks(spark):
    text = "\n".join(f"line {i} " + "x" * 40 for i in range(300))
    files = spark.createDataFrame([("a.py", text), ("e.py", "")], "file_path string, content string")
    rows = chunking.chunk_lines(files).collect()
    assert rows[0].start_line == 1 and rows[-1].end_line == 300 and all(b.start_line == a.end_line - 4 for a, b in zip(rows, rows[1:], strict=False))
    assert all("\n".join(text.split("\n")[r.start_line - 1 : r.end_line]) == r.content for r in rows)
    found = spark.createDataFrame([("a.py", "f", 1, 50), ("a.py", "g", 52, 120), ("a.py", "h", 121, 130)], "file_path string, name string, start_line int, end_line int")
    packed = chunking.chunk_symbols(files, found).collect()
    assert [(r.start_line, r.end_line, r.symbols) for r in packed] == [(1, 50, ["f"]), (52, 130, ["g", "h"])] or len(packed) >= 2


def test_snippet_of_a_call(spark):
    text = "\n".join(["import x", "def f():", *["    pass"] * 5, "    g()", "end"])
    call = lambda n: spark.createDataFrame([(text,)], "c string").select(chunking.call_snippet(F.col("c"), F.lit(n))).first()[0]
    assert call(8).startswith("def f():") and call(8).endswith("end") and call(0) == "" and call(99).endswith("end")
    assert spark.createDataFrame([(text,)], "c string").select(chunking.source_lines(F.col("c"), F.lit("a.py"), F.lit(2), F.lit(3))).first()[0] == "# a.py:2-3\ndef f():\n    pass"


# Parsing, symbols and the graph

SOURCE = '''"""Module.

Example:
    >>> run()
"""
import os
from .db import connect

LIMIT = 3
cache = {}


@app.get("/x")
def route():
    return load()


class Store(Base):
    def save(self, x):
        """Save."""
        self.items.append(x)
        cache[x] = 1
        if not x:
            raise ValueError(f"bad {x} value")
        logger.error("lost connection")
        return connect(Helper())

    async def load(self):
        pass
'''


def test_python_parser(spark):
    parsed = parsing.parse(spark.createDataFrame([("a.py", SOURCE), ("broken.py", "def f(:\n"), ("e.py", None)], "file_path string, content string")).persist()
    rows = {(r.file_path, r.name): r for r in parsing.symbols_of(parsed).collect()}
    kinds = {k[1]: r.symbol_type for k, r in rows.items() if k[0] == "a.py"}
    assert kinds == {"LIMIT": "constant", "cache": "variable", "route": "route", "Store": "class", "save": "method", "load": "method"}
    save = rows["a.py", "save"]
    assert (save.parent, save.raises, save.mutates, save.error_strings, save.docstring) == ("Store", ["ValueError"], ["cache", "self.items"], ["bad  value", "lost connection"], "Save.")
    assert rows["a.py", "load"].signature == "async def load(self)"
    refs = {(r.source, r.target, r.reference_type, r.confidence) for r in parsing.references_of(parsed).collect()}
    assert {("a.py::Store", "Base", "inherits", 0.95), ("a.py::Store.save", "connect", "calls", 0.9), ("a.py::Store.save", "Helper", "instantiates", 0.85), ("a.py", "os", "imports", 0.99), ("a.py", ".db.connect", "imports", 0.99)} <= refs
    one = {r.file_path: r for r in parsed.collect()}
    assert one["a.py"].synopsis == "run()" and one["broken.py"].error.startswith("SyntaxError") and [s.name for s in one["broken.py"].symbols] == ["f"] and one["e.py"].symbols == []
    assert ids(parsing.errors_of(parsed), "file_path") == ["broken.py"]


def test_other_parsers():
    ts = parsing.parse_typescript("a.ts", "import { x } from './m'\nexport class A extends B {\n  run(n: number): void {\n    this.go(new C())\n  }\n}\nexport const f = (a) => g(a)\nenum E { X }\ntype T = string\ninterface I {}\n")
    assert {(s.name, s.symbol_type, s.parent) for s in ts.symbols} >= {("A", "class", None), ("run", "method", "A"), ("f", "function", None), ("E", "enum", None), ("T", "type_alias", None), ("I", "interface", None)}
    assert ts.imports == ["./m"] and ("a.ts::A", "B", "inherits") in {(r.source, r.target, r.reference_type) for r in ts.references} and ("a.ts::A.run", "C", "instantiates") in {(r.source, r.target, r.reference_type) for r in ts.references}
    java = parsing.parse_java("A.java", "import java.util.List;\npublic class A {\n  public A(int x) {\n  }\n  @GetMapping(\"/u\")\n  public List<String> users() {\n    return null;\n  }\n}\n")
    assert {(s.name, s.symbol_type) for s in java.symbols} == {("A", "class"), ("A", "method"), ("users", "route")} and not java.references
    go = parsing.parse_generic("m.go", "package m\nfunc (s *S) Do(x int) {\n}\ntype S struct {\n}\n", "go")
    assert [(s.name, s.start_line, s.end_line) for s in go.symbols] == [("Do", 2, 3), ("S", 4, 5)] and not parsing.parse_generic("r.md", "def f():\n").symbols


def test_resolution(spark):
    table = spark.createDataFrame([("a::verify", "verify", "verify"), ("a::User", "User", "User"), ("a::User.save", "save", "User.save"), ("b::process", "process", "process"), ("c::process", "process", "process")], "id string, name string, qualified string")
    refs = spark.createDataFrame([("x", "verify", 0.9), ("x", "process", 0.9), ("x", "gone", 0.9), ("x", "User.save", 0.7)], "source string, target string, confidence double")
    rows = sorted((r.target, round(r.confidence, 3), r.target_resolved) for r in symbols.resolve(refs, table, order=[]).collect())
    assert rows == [("a::User.save", 0.7, True), ("a::verify", 0.9, True), ("b::process", 0.45, True), ("c::process", 0.45, True), ("gone", 0.27, False)]


def test_qualified_names_hide_simple_ones(spark):
    table = spark.createDataFrame([("a::save", "save", "save"), ("b::S.save", "save", "S.save")], "id string, name string, qualified string")
    refs = spark.createDataFrame([("x", "save", 1.0)], "source string, target string, confidence double")
    assert [r.target for r in symbols.resolve(refs, table, order=[]).collect()] == ["a::save"]


INDEX = "id long, file_path string, symbol_name string, symbol_type string, line_start int, line_end int, signature string, docstring string, calls array<string>, called_by array<string>, raises array<string>, mutates array<string>, error_strings array<string>, source_hash string"


def make_index(spark):
    rows = [
        (1, "db.py", "get_db", "function", 1, 9, "def get_db()", "", [], [], ["OperationalError"], [], ["database is locked"], "h"),
        (2, "a.py", "promote", "function", 1, 9, "def promote()", "", ["get_db", "helper"], [], [], ["state"], [], "h"),
        (3, "a.py", "helper", "function", 10, 19, "def helper()", "", [], [], ["ValueError"], [], ["100% wrong"], "h"),
        (4, "m.py", "main", "route", 1, 5, "def main()", "", ["promote", "helper"], [], [], [], [], "h"),
    ]
    return symbols.called_by(spark.createDataFrame(rows, INDEX))


def test_code_index(spark):
    index = make_index(spark)
    by = {r.symbol_name: r.called_by for r in index.collect()}
    assert by == {"get_db": ["promote"], "promote": ["main"], "helper": ["promote", "main"], "main": []}
    assert ids(symbols.callees(index, "promote")) == [1, 3] and ids(symbols.callers(index, "helper")) == [2, 4]
    assert ids(symbols.raising(index, "ValueError")) == [3] and ids(symbols.with_error_string(index, "DATABASE")) == [1] and ids(symbols.with_error_string(index, "100% w")) == [3]
    assert ids(symbols.mutating(index, "state")) == [2] and ids(symbols.named(index, "helper", "a.p")) == [3]
    walk = [(r.symbol_name, r.depth) for r in graph.forward_walk(index, "main").collect()]
    assert walk == [("main", 0), ("promote", 1), ("get_db", 2), ("helper", 2)]
    again = symbols.build_index(spark.createDataFrame([("a.py", 0, "process", "function", 1, 2, None), ("a.py", 1, "process", "function", 10, 12, None), ("a.py", 2, "V", "constant", 1, 1, None)], "file_path string, ordinal int, name string, symbol_type string, start_line int, end_line int, parent string"), spark.createDataFrame([], "file_path string, symbol_name string, callee string, ordinal int"), F.lit("h"))
    assert [(r.symbol_name, r.start_line) for r in again.collect()] == [("process", 10)]


def test_retrieval(spark):
    index = make_index(spark)
    rows = retrieval.diagnostic(index, {"exception_types": ["OperationalError"], "error_strings": [], "function_refs": []}).collect()
    assert [(r.path, r.relevance) for r in rows] == [("db.py", "error site"), ("a.py", "mutates state before it")]
    flow = retrieval.route("trace the main flow", "exploratory", index).collect()
    assert flow[0].content == "main\n  promote\n    get_db\n    helper" and len(flow) == 5
    assert ids(retrieval.gap_to_index(index, "helper in a.py")) == [3] and ids(retrieval.gap_to_index(index, "all of a.py")) == [2, 3] and ids(retrieval.gap_to_index(index, "`get_db()`")) == [1]
    assert retrieval.route("q", "conceptual", index).count() == 0 and retrieval.route("analyze the a", "analytical", index).count() == 0
    loop = retrieval.gap_loop(["<answer>a</answer><missing>- x\n- y</missing>", "<answer>b</answer><missing>- y</missing>", "<answer>c</answer>"], lambda g: g == "x")
    assert loop == {"answer": "b", "passes": 2, "gaps_identified": ["x", "y"], "gaps_resolved": ["x"], "gaps_unresolved": ["y"]}
    cited = spark.createDataFrame([(0, "b"), (1, "zz"), (2, "b"), (3, "a")], "pos int, path string")
    results = spark.createDataFrame([(0, "a", "A"), (1, "b", "B"), (2, "c", "C"), (3, "d", "D")], "rank int, path string, title string")
    assert [r.path for r in retrieval.citations(cited, results).collect()] == ["b", "a"] and [r.path for r in retrieval.citations(cited.where("pos = 1"), results).collect()] == ["a", "b", "c"]
    answer = retrieval.assemble(spark.createDataFrame([("<answer>ok</answer><missing>NONE</missing>",)], "response string"), spark.createDataFrame([("low",)], "confidence string")).first()
    assert answer.answer == "ok" and answer.gaps == [] and answer.disclaimer
    issues = spark.createDataFrame([("i1", "a.py", "bug", "high", "T", "C", 1, 2, [0.0, 1.0]), ("i2", "b.py", "style", "low", "T", "C", 1, 2, [1.0, 0.0])], TABLES["issues"] + ", embedding array<double>")
    assert ids(search.query_issues(issues, category="bug")) == ["i1"] and [r.id for r in search.query_issues(issues, [1.0, 0.0]).collect()] == ["i2", "i1"]
    assert retrieval.issue_context(issues)["confidence"].first().confidence == "medium"


NODES, EDGES = TABLES["nodes"], TABLES["edges"]


def call_graph(spark):
    names = ["handler.py::process_request", "auth.py::verify_token", "db.py::get_user", "response.py::send_response", "tests/t.py::test_it"]
    nodes = spark.createDataFrame([(n, n.split("::")[1], "function", n.split("::")[0], 1, 9, "Doc.", "def f()", None) for n in names], NODES)
    edges = spark.createDataFrame([(names[0], names[1], "calls", 0.95, 15), (names[0], names[2], "calls", 0.90, 20), (names[0], names[3], "calls", 0.85, 25), (names[1], names[2], "calls", 0.70, 10), (names[4], names[0], "calls", 0.9, 3)], EDGES)
    return names, nodes, edges


def test_graph(spark):
    names, nodes, edges = call_graph(spark)
    assert graph.calls_of(nodes, edges, names[0]).count() == 3 and graph.calls_of(nodes, edges, names[0], 0.9).count() == 2
    assert ids(graph.callers_of(nodes, edges, names[2])) == sorted(names[:2])
    seeds = spark.createDataFrame([(names[3],)], "id string")
    around, inner = graph.neighborhood(nodes, edges, seeds, 1)
    assert ids(around) == sorted([names[0], names[3]]) and inner.count() == 1
    assert graph.neighborhood(nodes, edges, seeds, 2)[0].count() == 5 and graph.neighborhood(nodes, edges, seeds, 2, 0.9)[0].count() == 1
    paths = [r.path for r in graph.simple_paths(edges, names[0], names[2]).collect()]
    assert paths == [[names[0], names[2]], [names[0], names[1], names[2]]]
    assert [r.id for r in graph.entry_points(nodes, edges).collect()] == [names[0]]
    assert ids(graph.leaf_nodes(nodes, edges)) == sorted([names[2], names[3]]) and ids(graph.entry_nodes(nodes, edges)) == [names[4]]
    kept, left = graph.without_tests(nodes, edges)
    assert kept.count() == 4 and left.count() == 4
    components, between = graph.component_graph(nodes, edges, 0.8)
    assert components.count() == 5 and between.count() == 4
    assert graph.by_degree(nodes, edges).first().id == names[0]
    sites = graph.call_sites(nodes, edges, F.lit("db.py")).collect()
    assert sorted((s.caller_file, s.line) for s in sites) == [("auth.py", 10), ("handler.py", 20)]
    text = graph.diagram(nodes, edges).first().diagram
    assert text.startswith("flowchart LR\n") and text.count("-->") == 5
    checks = spark.createDataFrame([(text,), ("nonsense",), ("flowchart LR\n  subgraph a\n",)], "d string").select(graph.diagram_valid(F.col("d")), graph.diagram_useful(F.col("d"))).collect()
    assert [tuple(c) for c in checks] == [(True, True), (False, False), (False, False)]
    assert graph.pack_graph_context(nodes, edges, 10_000).where("part = 'code'").count() == 5
    assert retrieval.graph_context(spark.createDataFrame([("files/auth-py.md",)], "path string"), nodes, edges).count() > 0
    assert set(graph.architecture(nodes, edges)) == {"components", "component_edges", "entry_points", "flow_nodes", "flow_edges"}
    assert ids(graph.unused(nodes, edges)) == []


def test_graph_build_keeps_the_last_reference(spark):
    table = spark.createDataFrame([("a.py", 0, "f", "function", 1, 2, "", "", [], None, [], [], []), ("a.py", 1, "g", "function", 3, 4, "", "", [], None, [], [], [])], TABLES["symbols"])
    refs = spark.createDataFrame([("a.py", 0, "a.py::f", "a.py::g", "calls", 0.9, 1, True), ("a.py", 1, "a.py::f", "a.py::g", "instantiates", 0.5, 2, True), ("a.py", 2, "a.py", "os", "imports", 0.3, 1, False)], TABLES["refs"])
    nodes, edges = symbols.build_graph(symbols.with_node_id(table), refs, [F.col("file_path"), F.col("ordinal")])
    assert nodes.count() == 2 and [(e.type, e.line) for e in edges.collect()] == [("instantiates", 2)]


# Summaries


def test_call_sites_in_tiers(spark):
    rows = [("t.py", "t.py", "own", 50), ("t.py", "x.py", "ext", 10), ("t.py", "tests/test_a.py", "test", 1), ("t.py", "x.py", "ext2", 12), ("t.py", "y.py", "ext3", 5)]
    sites = spark.createDataFrame(rows, "target_file string, caller_file string, caller_symbol string, line int")
    best = summaries.best_call_site(sites, by=["target_file"]).first()
    assert (best.caller_file, best.line, best.tier) == ("x.py", 10, 1)
    others = summaries.other_call_sites(sites, by=["target_file"]).orderBy("nth").collect()
    assert [(r.caller_file, r.line) for r in others] == [("t.py", 50), ("tests/test_a.py", 1), ("y.py", 5), ("x.py", 12)]


def test_batches_reset(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate([6, 5, 20, 1, 2, 8])], "k string, i int, tokens int")
    for f in (summaries.greedy_batches, summaries.greedy_batches_long):
        assert [r.batch for r in f(rows, ["k"], ["i"], 10).orderBy("i").collect()] == [0, 1, 2, 3, 3, 4]


def test_workflows(spark):
    rows = [("list_users", "api_route", "u.py", "/api/v1/users"), ("get_user", "api_route", "u.py", "/users/{id}"), ("sync_a", "cli_command", "c1.py", ""), ("sync_b", "main_function", "c2.py", ""), ("solo", "background_task", "s.py", ""), ("x1", "cli_command", "f.py", ""), ("x2", "main_function", "f.py", "")]
    entries = spark.createDataFrame(rows, "name string, entry_type string, file string, description string")
    imports = spark.createDataFrame([("u.py", "svc.py"), ("svc.py", "repo/db.py"), ("repo/db.py", "far.py")], "source string, target string")
    layers = spark.createDataFrame([("api", "u.py")], "layer string, file string")
    found = {r.name: r for r in summaries.group_workflows(entries, imports, layers).collect()}
    assert set(found) == {"Users API", "F", "Sync Operations", "Solo"}
    assert found["Users API"].related_files == ["repo/db.py", "svc.py", "u.py"] and found["Users API"].primary_layer == "api" and found["Sync Operations"].stage == 3


def test_metrics_merges_and_signatures(spark):
    rows = spark.createDataFrame([("a.py", "api"), ("b.py", "api"), ("c.py", "domain"), ("d.py", "test")], "file_path string, layer string")
    contents = spark.createDataFrame([("a.py", "1\n2"), ("b.py", ""), ("c.py", "x")], "file_path string, content string")
    got = {r.layer: (r.files, r.lines) for r in summaries.code_metrics(rows, contents).collect()}
    assert got == {"api": (2, 2), "domain": (1, 1), "test": (1, 0), None: (4, 3)}
    parts = spark.createDataFrame([(0, "api", "short", ["b", "a"]), (1, "api", "longer text", ["a", "c"])], "batch int, layer string, purpose string, files array<string>")
    merged = summaries.merge_layers(parts).first()
    assert merged.purpose == "longer text" and merged.files == ["b", "a", "c"]
    stack = summaries.tech_stack(spark.createDataFrame([("FastAPI",), ("unknown",)], "name string"), spark.createDataFrame([("fastapi", "python", "web_framework", "FastAPI")], "library string, language string, category string, display string")).first()
    assert (stack.language, stack.category, stack.names) == ("python", "web_framework", ["FastAPI"])
    files = spark.createDataFrame([("d/b.py", "h2"), ("d/a.py", "h1")], "path string, hash string")
    import hashlib

    assert summaries.directory_signature(files).first().signature == hashlib.sha256(b"a.py:h1|b.py:h2").hexdigest()
    children = spark.createDataFrame([("d/x", "does x")], "directory string, purpose string")
    assert summaries.directory_signature_deep(files, children).first().signature == hashlib.sha256(b"a.py:h1|b.py:h2||d/x:does x").hexdigest()


# Maintenance


def test_changes_orphans_and_notes(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    pages = spark.createDataFrame([("file", t, h, datetime(2024, 1, 1), f"src/{t}") for t, h in (("a", "1"), ("b", "x"), ("d", "4"))], "type string, target string, source_hash string, generated_at timestamp, source string")
    notes = spark.createDataFrame([("file", "d", datetime(2024, 1, 2), 1), ("directory", "a", datetime(2024, 1, 2), 2), ("general", "", datetime(2023, 1, 1), 3)], "scope string, target string, updated_at timestamp, seq long")
    assert {r.path: r.reason for r in incremental.changed_files(files, pages, notes).collect()} == {"a": "unchanged", "b": "changed", "c": "new", "d": "note"}
    gone = incremental.orphans(pages, spark.createDataFrame([("src/a",), ("src/b",)], "path string"), ["b"])
    assert ids(gone, "source") == ["src/b", "src/d"]
    assert [r.seq for r in incremental.notes_for(notes, "file", "d").collect()] == [1, 3]
    merged = incremental.upsert(files, spark.createDataFrame([("a", "9"), ("z", "0")], "path string, hash string"), ["path"])
    assert {r.path: r.hash for r in merged.collect()} == {"a": "9", "b": "2", "c": "3", "d": "4", "z": "0"}
    assert incremental.delete(files, files.select("path").limit(0)).count() == 4
    jobs = spark.createDataFrame([("j", 1, "pending"), ("j", 2, "running"), ("k", 1, "completed")], "id string, seq int, status string")
    states = incremental.job_states(jobs, ["seq"]).withColumn("completed_at", F.lit(None).cast("timestamp")).withColumn("error_message", F.lit(None).cast("string"))
    assert incremental.cancel(states, "j", F.current_timestamp()).first().status == "cancelled" and incremental.cancel(states, "k", F.current_timestamp()).count() == 0
    assert {r.id: r.status for r in incremental.sweep_orphans(states, F.current_timestamp()).collect()} == {"j": "failed", "k": "completed"}


def test_schemas(spark):
    for name in TABLES:
        assert empty(spark, name).count() == 0
    assert conform(spark.createDataFrame([("s", 1)], "scope string, extra int"), "notes").columns == ["scope", "target", "content", "author", "updated_at", "seq"]
    assert isinstance(DEFAULT, Params)
