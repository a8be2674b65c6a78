from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.schemas import TABLES, empty
from tessera.sources import files, sinks
from tessera.streaming import jobs


def test_trees_pages_and_notes(spark, tmp_path):
    root = tmp_path / "repo"
    for path, content in {"src/a.py": b"x = 1\n", "src/b.py": b"bad \xff byte\n", "node_modules/i.js": b"x", "README.md": b"# Hi `a.py`\n\ntwo words"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    rows = {r.file_path: r for r in files.scan_texts(spark, str(root)).collect()}
    assert sorted(rows) == ["README.md", "src/a.py", "src/b.py"] and rows["src/b.py"].content == "bad  byte\n" and rows["src/a.py"].language == "python"
    pages = files.read_pages(spark, str(root))
    assert files.page(pages, "README.md").first().word_count == 5 and files.page(pages, "README.md").first().source_path == "a.py"
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "n.md").write_text("---\nscope: file\ntarget: a.py\nauthor: me\nupdated_at: 2024-01-02T03:04:05\n---\n\nRemember this.")
    (notes / "bad.md").write_text("no header")
    note = files.read_notes(spark, str(notes)).collect()
    assert [(n.scope, n.target, n.content, n.updated_at) for n in note] == [("file", "a.py", "Remember this.", datetime(2024, 1, 2, 3, 4, 5))]
    ignore = tmp_path / "ignore"
    ignore.write_text("# c\n\nbuild/\n *.log \n")
    assert files.read_ignore(spark, str(ignore)) == ["build/", "*.log"]
    manifest = spark.createDataFrame([("package.json", '{"name": "js", "version": "1", "dependencies": {"react": "1"}}'), ("pyproject.toml", '[project]\nname = "py"\ndependencies = [\n  "fastapi>=1",\n]\n')], "file_path string, content string")
    got = files.manifest(manifest).first()
    assert (got.name, got.version, got.dependencies) == ("py", "1", ["fastapi", "react"])


def test_graph_and_warehouse(spark, tmp_path):
    nodes = spark.createDataFrame([("b", "b", "function", "f", 1, 2, "", "", None), ("a", "a", "function", "f", 1, 2, "", "", None)], TABLES["nodes"])
    edges = spark.createDataFrame([("a", "b", "calls", 0.5, 1)], TABLES["edges"])
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    back = files.read_graph(spark, str(tmp_path / "g"))
    assert back[0].count() == 2 and back[1].first().confidence == 0.5
    house = sinks.Warehouse(spark, str(tmp_path / "w"), "r1")
    assert house.read("edges").count() == 0 and not house.incomplete()
    house.write(edges, "edges")
    house.prepare_staging()
    assert house.incomplete()
    house.write(edges.union(edges), "edges", staged=True)
    assert house.read("edges").count() == 1
    house.promote()
    assert house.read("edges").count() == 2 and not house.incomplete()
    house.write(house.read("edges").limit(1), "edges")
    assert house.read("edges").count() == 1
    with pytest.raises(ValueError):
        sinks.Warehouse(spark, str(tmp_path), "../out")
    row = sinks.synthesis_row(spark.createDataFrame([("x",)], "a string")).first()
    assert row.content == '{"a":"x"}' and len(row.hash) == 16
    sinks.append_log(spark.createDataFrame([("t", "ok")], "timestamp string, response string"), str(tmp_path / "log"))
    assert files.read_log(spark, str(tmp_path / "log")).first().response == "ok" and files.log_lines(spark, str(tmp_path / "log")).first().entries == 1


def test_job_stream(spark, tmp_path):
    schema = "id string, ts timestamp, seq long, status string"
    start = datetime(2024, 1, 1)
    for k, status in enumerate(("pending", "running", "completed")):
        spark.createDataFrame([("j", start + timedelta(seconds=k), k, status), ("k", start, 0, "pending")][: 2 - (k > 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"), empty(spark, "jobs").select("id", F.col("started_at").alias("ts"), "seq", "status").schema)
    query = jobs.latest_states(stream).writeStream.outputMode("update").format("memory").queryName("jobs_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    last = spark.sql("select id, max_by(status, seq) s from jobs_out group by id")
    assert {r.id: r.s for r in last.collect()} == {"j": "completed", "k": "pending"}
    events = jobs.progress_events(spark.createDataFrame([("j", "completed")], "id string, status string")).first()
    assert events.event == "complete" and '"status":"completed"' in events.data


class State:
    """What update_session uses of Spark's group state."""

    def __init__(self, value=None, timed_out=False):
        self.value, self.hasTimedOut, self.timeout = value, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = ms


def test_session_cache_keeps_the_latest_nodes(spark, tmp_path):
    import pandas as pd

    from tessera.params import Params

    state = State()
    rows = pd.DataFrame([("u", datetime(2024, 1, 1, 0, 0, k), f"n{k % 4}") for k in range(6)], columns=["user", "ts", "node"])
    (out,) = jobs.update_session(("u",), iter([rows]), state, Params(session_max_nodes=3))
    assert out.nodes[0] == ["n3", "n0", "n1"] and state.timeout == 1_800_000
    state.hasTimedOut = True
    (out,) = jobs.update_session(("u",), iter([]), state)
    assert out.expired[0] and not state.exists
    stream = spark.readStream.schema("user string, ts timestamp, node string").parquet(str(tmp_path))
    assert jobs.session_cache(stream).columns == ["user", "session", "nodes", "expired"]


def test_sessions_and_answers(spark):
    turns = spark.createDataFrame([("u", datetime(2024, 1, 1, 0, m), m) for m in (0, 29, 59)] + [("u", datetime(2024, 1, 1, 1, 30), 99)], "user string, ts timestamp, seq long")
    assert [(r.session, r.n) for r in jobs.sessions(turns).orderBy("session").collect()] == [(0, 3), (1, 1)]
    events = jobs.answer_events(spark.createDataFrame([("q", "a", None), ("r", None, "boom")], "question string, answer string, error string"))
    assert [r.event for r in events.where("question = 'q'").orderBy("pos").collect()] == ["status", "status", "token", "done"] and [r.event for r in events.where("question = 'r'").orderBy("pos").collect()][-1] == "error"
