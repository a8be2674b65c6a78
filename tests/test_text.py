import pytest
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.params import DEFAULT, Params, checked, from_env


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (fn.token_estimate, "abcdefghi", 2),
        (fn.page_slug, "src/auth_x/handler.py", "src-authx-handler-py"),
        (fn.chunk_slug, "files/My Page", "files_my-page"),
        (fn.workflow_slug, "Sync_All Users!", "sync-all-users"),
        (fn.note_slug, "src/main.py", "src--main.py"),
        (fn.note_slug, "file(test).py", "file%28test%29.py"),
        (fn.source_path, "files/auth-handler-py.md", "auth/handler.py"),
        (fn.source_path, "files/notes-todo.md", "notes/todo"),
        (fn.humanize, "syncAll_users", "Sync All Users"),
        (fn.route_prefix, "/api/v1/orders/{id}", "orders"),
        (fn.route_prefix, "/{id}", None),
        (fn.page_type, "directories/x.md", "directory"),
        (fn.page_url, "files/a.md", "/files/a"),
        (fn.strip, " \n x ", "x"),
        (fn.answer_text, "a <ANSWER> yes\nno </answer> b", "yes\nno"),
        (fn.answer_text, "ANSWER: it is\nMISSING (x): y", "it is"),
        (fn.answer_text, "  plain ", "plain"),
        (fn.gap_list, "<missing>\n- f in a.py\n- NONE\n</missing>", ["f in a.py"]),
        (fn.gap_list, "<missing>NONE</missing>", []),
        (fn.gap_list, "nothing", []),
        (fn.is_specific_gap, "verify in auth.py", True),
        (fn.is_specific_gap, "how it works", False),
        (fn.gap_node_name, "auth/verify.py::check", "check"),
        (fn.gap_node_name, "verify_token in auth.py", "verify_token"),
        (fn.gap_node_name, "the function get_db", "get_db"),
        (fn.gap_node_name, "the database", "database"),
        (fn.trace_subject, "Trace the login path", "login"),
        (fn.analysis_scope, "what's wrong with the parser", "parser"),
        (fn.is_issue_question, "any SECURITY risk?", True),
        (fn.diagram_id, "a/b.py", "a_b_py"),
        (fn.lines_ast, "a\nb\n", 3),
        (fn.lines_plain, "a\nb\n", 2),
        (fn.lines_metric, "a\r\nb\rc", 3),
        (fn.lines_metric, "", 0),
        (fn.json_array, "nope", []),
        (fn.frontmatter, "---\ntype: x\nlayer: y\n---\n\nbody", {"type": "x", "layer": "y"}),
        (fn.frontmatter_body, "---\ntype: x\n---\n\nbody", "body"),
    ],
)
def test_scalar(spark, f, value, want):
    assert one(spark, f(F.col("v")), v=value) == want


def test_structures(spark):
    refs = one(spark, fn.gap_references(F.col("v")), v="`save()` in src/db.py")
    assert (refs.file_path, refs.function_name) == ("src/db.py", "save")
    anchors = one(spark, fn.error_anchors(F.col("v")), v='sqlite3.OperationalError: "database is locked" File "a/db.py", line 45, in get_db')
    assert anchors.exception_types == ["OperationalError", "sqlite3.OperationalError"] and anchors.function_refs == ["get_db"] and "database is locked" in anchors.error_strings
    for url, want in (("https://github.com/o/r.git", ("github", "github.com", "o", "r", None)), ("git@host.org:o/r.git", ("git", "host.org", "o", "r", None)), ("/home/x", ("local", None, None, None, "/home/x"))):
        assert tuple(one(spark, fn.url_parts(F.col("v")), v=url)) == want
    assert one(spark, fn.classification(F.col("v")), v='```json\n{"mode": "Analytical"}\n```').mode == "analytical"
    assert one(spark, fn.classification(F.col("v")), v="broken").mode == "conceptual"
    block = fn.with_frontmatter(F.lit("a.py"), F.lit("file"), F.lit("c"), F.lit("t"), F.lit(None).cast("string"), F.col("v"))
    assert one(spark, fn.frontmatter_body(block), v="x") == "x"


def test_snippets_and_truncation(spark):
    long = "x" * 100 + "Needle" + "y" * 300
    found = one(spark, fn.snippet(F.col("v"), F.lit("needle")), v=long)
    assert found.startswith("...") and found.endswith("...") and "Needle" in found and len(found) == 206
    assert one(spark, fn.snippet(F.col("v"), F.lit("zzz")), v=long) == long[:200] + "..."
    assert one(spark, fn.truncate_sentences(F.col("v"), 5), v="One is here. Two is there. Three.") == "One is here...."
    assert one(spark, fn.bm25_distance(F.lit(4.0)), v="") == pytest.approx(0.6) and one(spark, fn.bm25_distance(F.lit(None).cast("double")), v="") == 0.5
    assert one(spark, fn.breadcrumb(F.col("v"), "p"), v="a/b/c/d/e") == "p / ... / d / e"
    assert len(one(spark, fn.note_slug(F.col("v")), v="a/" * 150 + "x.py")) <= 200


def test_params():
    assert from_env(env={"TESSERA_RESULT_LIMIT": "20"}).result_limit == 20 and DEFAULT.result_limit == 10
    with pytest.raises(ValueError):
        checked(Params(result_limit=1000))


QUESTIONS = [
    ("Trace the login path", "login", None),
    ("trace a request through it", "request", None),
    ("Explain checkout flow, please", "checkout", None),
    ("How does caching work?", "caching", None),
    ("how does the thing work", None, None),
    ("Walk through the importer's steps", "importer", None),
    ("the code path", None, None),
    ("Which paths lead to the retry paths", "which", None),
    ("What are the issues with this scheduler?", None, "scheduler"),
    ("Flaws in\nparsing", None, "parsing"),
    ("Analyze an adapter", None, "adapter"),
    ("what's wrong with the parser", None, "parser"),
    ("Storage architecture", None, "storage"),
    ("the design", None, None),
    ("", None, None),
    (None, None, None),
]


def test_subjects_of_questions(spark):
    rows = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(QUESTIONS)], "i int, q string")
    got = {r.i: (r.t, r.s) for r in rows.select("i", fn.trace_subject(F.col("q")).alias("t"), fn.analysis_scope(F.col("q")).alias("s")).collect()}
    assert got == {i: (t, s) for i, (_, t, s) in enumerate(QUESTIONS)}


GAPS = [
    ("`save()` in src/db.py", ("src/db.py", "save")),
    ("load_all in a/b.pyi, please", ("a/b.pyi", "load_all")),
    ("see pkg/mod.tsx for the body of run()", ("pkg/mod.tsx", "run")),
    ("the implementation of merge", (None, "merge")),
    ("Method close, wherever it is", (None, "close")),
    ("what is in x.txt", (None, None)),
    ("how it starts", (None, None)),
    ("", (None, None)),
]


def test_references_of_gaps(spark):
    rows = spark.createDataFrame([(i, g) for i, (g, _) in enumerate(GAPS)], "i int, g string")
    got = {r.i: (r.r.file_path, r.r.function_name) for r in rows.select("i", fn.gap_references(F.col("g")).alias("r")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(GAPS)}


def test_exceptions_of_tracebacks(spark):
    text = "Traceback\nvalue: app.db.PoolError: no\nduring KeyError.args or Error, MyException; x.y.ZException"
    (row,) = spark.createDataFrame([(text,)], "v string").select(fn.named_exceptions(F.col("v")).alias("e")).collect()
    assert row.e == ["KeyError", "MyException", "PoolError", "ZException", "db.PoolError", "y.ZException"]
