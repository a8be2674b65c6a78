"""Steps that grew faster than their input, and queries that differed from their SQL on larger tables."""

import ast

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import chunking, graph, parsing, symbols
from tessera.plans import catalog, code, views
from tessera.streaming import sessions


def test_resolved_pairs_are_the_resolved_references_counted(spark):
    """An id that two names stand for, a hidden ending, an ambiguous name, names that nothing has, nulls."""
    table = spark.createDataFrame([("a", "save", "A.save"), ("b", "save", "B.save"), ("c", "load", "save.load"), ("d", "A.save", "D.x"), ("e", "one", None)], "id string, name string, qualified string")
    rows = [(s, t, c) for s in ("x", "y", None) for t in ("save", "A.save", "B.save", "load", "one", "gone", None) for c in (0.5, 0.25, None)]
    refs = spark.createDataFrame(rows, "source string, target string, confidence double")
    want = symbols.resolve(refs, table).where("target_resolved").groupBy("source", "target").agg(F.count("*").alias("n"), F.sum("confidence").alias("confidence"))
    found = symbols.resolved_pairs(refs, table)
    listed = lambda df: sorted((str(r.source), r.target, r.n, round(r.confidence, 6)) for r in df.collect())
    assert listed(found) == listed(want) and len(listed(found)) == 12


def test_a_parsed_batch_is_handed_on_in_parts(spark, monkeypatch):
    """A worker holds the rows of a few files, not of a whole Arrow batch: files of ten symbols come out in batches of two here."""
    monkeypatch.setattr(parsing, "ROWS_AT_ONCE", 20)
    taken, given = [], []
    files = [(f"{k}.py", "\n".join(f"def f{j}(a): return 1" for j in range(10))) for k in range(7)]

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pylist([{"file_path": p, "content": c} for p, c in files])
            for out in run(iter([batch])):
                given.append(out.num_rows)
                taken.extend(out.to_pylist())

    parsing.parse(Files())
    assert given == [2, 2, 2, 1] and [r["file_path"] for r in taken] == [p for p, _ in files]
    assert all([s["name"] for s in r["symbols"]] == [f"f{j}" for j in range(10)] for r in taken)
    assert parsing.symbols_of(parsing.parse(spark.createDataFrame(files, "file_path string, content string"))).count() == 70


def test_parameters_without_the_unparser():
    for text in ("", "a", "self, b", "a, *, b", "a: int", "a=1", "*a, **b", "a, /, b"):
        node = ast.parse(f"def f({text}): pass").body[0].args
        assert parsing._arguments(node) == ast.unparse(node)


def test_sources_are_made_in_as_many_tasks_as_rows_ask_for(spark, sf, monkeypatch):
    """A small file of parts is one task; the texts made of it are not."""
    monkeypatch.setattr(views.spread, "__defaults__", (50,))
    assert code._parsed(spark, sf, code.JAVA, "j", "java").rdd.getNumPartitions() == 4


def test_a_cut_that_ends_with_a_line_break(spark):
    """The cut is at the last white space, also where the cut's last character is a line break: `$` alone passes over that one."""
    word = "x" * 198
    texts = [f"{word}! {word}!\n{word}", f"{word}! {word}!!\n{word}", f"{word}! {word} {word}", "y" * 500, f"a\x0b{'z' * 500}"]
    want = [f"{word}! {word}!...", f"{word}!...", f"{word}! {word}...", "y" * 400 + "...", f"a\x0b{'z' * 398}..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", fn.truncate_sentences(F.col("t"), 100).alias("s"))
    assert [r.s for r in rows.orderBy("k").collect()] == want


def test_simple_paths_equal_sql_in_a_sparse_graph(spark, sf, tmp_path):
    """Fewer than ten paths of three edges: longer ones, which the SQL does not state, stay out."""
    spark.read.parquet(f"{sf}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 5 = 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["simple_paths"]).fetchall()
    assert 0 < len(want) < 10
    assert [tuple(r) for r in catalog.QUERIES["simple_paths"](spark, str(tmp_path)).collect()] == want


def test_ended_sessions_of_a_user_are_one_frame():
    """A frame for each session took most of the stream's time."""
    held = {}

    class Value:
        def __init__(self, name):
            self.name = name

        def exists(self):
            return self.name in held

        def get(self):
            return held[self.name]

        def update(self, value):
            held[self.name] = value

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value(name))  # noqa: N815
        registerTimer = deleteTimer = staticmethod(lambda at: None)  # noqa: N815

    processor = sessions.SessionProcessor()
    processor.init(Handle())
    turns = pd.DataFrame({"us": [k * 3_600_000_000 for k in range(500)], "seq": range(500), "node": [None] * 500, "missing": [None] * 500})
    (frame,) = processor.handleInputRows(("u",), iter([turns]), None)
    assert list(frame["session"]) == list(range(499)) and set(frame["event"]) == {"ended"} and list(frame["first_seq"]) == list(range(499))
    assert frame["at"][1] == pd.Timestamp("1970-01-01 01:30:00") and held["sessions"] == (499,)


def test_callers_by_name_are_called_by_counted(spark):
    rows = [(1, "f", "a", ["b", "b", "c"]), (2, "g", "a", ["b"]), (3, "g", "b", ["c", "gone"]), (4, "h", "c", None)]
    index = spark.createDataFrame(rows, "id int, file_path string, symbol_name string, calls array<string>")
    want = {r.symbol_name: (len(r.called_by), len(set(r.called_by)), min(r.called_by), max(r.called_by)) for r in symbols.called_by(index).collect() if r.called_by}
    assert {r.symbol_name: tuple(r)[1:] for r in symbols.callers_by_name(index).collect()} == want == {"b": (3, 1, "a", "a"), "c": (2, 2, "a", "b")}


def test_callers_by_name_reads_the_updated_rows(spark, monkeypatch):
    """The lists are made and put into every row of their name, and what the query returns is read there; lists are not shuffled or sorted after that."""
    rows = [(1, "f", "a", ["b", "b", "c"]), (2, "g", "a", ["b"]), (3, "g", "b", ["c"]), (4, "h", "c", []), (5, "i", "c", ["c"])]
    index = spark.createDataFrame(rows, "id int, file_path string, symbol_name string, calls array<string>")
    plan = symbols.callers_by_name(index)._jdf.queryExecution().executedPlan().toString()
    above = plan[plan.index("+- == Initial Plan ==") if "+- == Initial Plan ==" in plan else 0 : plan.index("SortMergeJoin")]
    assert "collect_list" in plan and "Exchange" not in above and "Sort [" not in above
    updated = symbols.called_by
    monkeypatch.setattr(symbols, "called_by", lambda index: updated(index).withColumn("called_by", F.concat("called_by", F.array(F.lit("zz")))))
    assert {r.symbol_name: tuple(r)[1:] for r in symbols.callers_by_name(index).collect()} == {"a": (1, 1, "zz", "zz"), "b": (4, 2, "a", "zz"), "c": (4, 4, "a", "zz")}


def test_results_of_a_large_file_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_PER_TASK", 10)
    results = spark.createDataFrame([(k, "big" if k % 4 else "small") for k in range(40)], "r int, f string")
    nodes = spark.createDataFrame([(f"n{k}", "big" if k % 3 else "other") for k in range(30)], "id string, file_path string")
    found = graph.results_to_nodes(results, nodes, source_col="f")
    assert sorted((r.r, r.node_id) for r in found.collect()) == sorted((r, f"n{k}") for r in range(40) if r % 4 for k in range(30) if k % 3)
    assert found.columns == ["r", "f", "node_id"]
    taken = [n for n in found.rdd.glom().map(len).collect() if n]
    assert len(taken) > 10 and max(taken) < 200


def test_chunks_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(chunking, "ROWS_AT_ONCE", 3)
    frames = list(chunking._frames(((str(k), k) for k in range(7)), ["a", "b"]))
    assert [len(f) for f in frames] == [3, 3, 1] and [x for f in frames for x in f["b"]] == list(range(7))
