"""Paths, flows, gaps, packing and sessions against plain Python."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.operators import exploration, gaps, graph, symbols
from tessera.params import DEFAULT
from tessera.streaming import jobs, sessions

EDGES = "source string, target string, type string, confidence double, line int"
NODES = "id string, name string, type string, file_path string, line_start int, line_end int, docstring string, signature string, parent string"


def brute_paths(edges, start, end, longest, most):
    out, level = [], [[start]]
    for _ in range(longest):
        level = [p + [b] for p in level for a, b in edges if a == p[-1] and b not in p]
        out += sorted(p for p in level if p[-1] == end)
        level = [p for p in level if p[-1] != end]
    return out[:most]


@pytest.mark.parametrize(("seed", "longest", "most"), [(1, 4, 10), (2, 5, 3), (3, 2, 10)])
def test_paths_are_those_of_brute_force(spark, seed, longest, most):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(22)}
    df = spark.createDataFrame([(a, b, "calls", 0.9, 1) for a, b in pairs], EDGES)
    found = [r.path for r in graph.simple_paths(df, "n0", "n1", longest=longest, most=most).collect()]
    assert found == brute_paths(sorted(pairs), "n0", "n1", longest, most)


def test_a_hub_that_leads_nowhere_is_not_walked(spark, monkeypatch):
    """A hub of 2000 leaves and a cycle beside the way: only nodes from which the end is near are gone to."""
    pairs = [("s", "h"), ("h", "m"), ("m", "e")] + [("h", f"x{k}") for k in range(2000)] + [(f"x{k}", f"x{k + 1}") for k in range(1999)]
    df = spark.createDataFrame([(a, b, "calls", 0.9, 1) for a, b in pairs], EDGES)
    left = {r.id: r.left for r in graph.distances_to(df.select("source", "target"), "e", 10).collect()}
    assert left == {"e": 0, "m": 1, "h": 2, "s": 3}
    assert [(r.path, r.hops) for r in graph.simple_paths(df, "s", "e").collect()] == [(["s", "h", "m", "e"], 3)]
    assert graph.simple_paths(df, "e", "s").count() == 0


def test_rows_within_a_budget(spark):
    rng = random.Random(4)
    rows = [(k, rng.randrange(0, 9)) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, tokens int").repartition(5)
    for budget in (0, 1, 17, 100, 10_000):
        want, total = [], 0
        for k, tokens in sorted(rows, reverse=True):
            total += max(tokens, 1)
            if total > budget:
                break
            want.append(k)
        assert [r.k for r in graph.within_budget(df, budget, F.desc("k")).orderBy("pos").collect()] == want


def test_last_wins_and_dedup_need_no_window(spark, capsys):
    rows = spark.createDataFrame([(1, 2, "a", ["x"]), (1, 3, "b", None), (1, 3, "c", ["y"]), (None, 1, "d", [])], "k int, at int, v string, l array<string>")
    last = symbols.last_wins(rows, ["k"], [F.col("at")])
    assert sorted((r.k or 0, r.at, r.v, r.l) for r in last.collect()) == [(0, 1, "d", []), (1, 3, "c", ["y"])] and last.columns == rows.columns
    last.explain()
    assert "Window" not in capsys.readouterr().out


def brute_flow(index, subject):
    """The walk of a call graph below a subject, depth first."""
    by_name = {}
    for row in sorted(index):
        by_name.setdefault(row[1], []).append(row)
    kind = {"route": 0, "function": 1}
    seen, out = set(), []

    def walk(row, depth):
        if depth > 3 or (row[2], row[1]) in seen:
            return
        seen.add((row[2], row[1]))
        out.append((depth, row[0]))
        calls = by_name[row[1]][0][4]
        for nxt in sorted(r for r in index if r[1] in calls)[:3]:
            walk(nxt, depth + 1)

    for row in sorted(by_name.get(subject, []), key=lambda r: (kind.get(r[3], 2), r[0]))[:2]:
        walk(row, 0)
    return out


def test_flows_of_many_questions_are_those_of_a_walk(spark):
    rng = random.Random(6)
    names = [f"f{k}" for k in range(12)]
    index = [(k, rng.choice(names), f"m{k % 5}.py", rng.choice(("route", "function", "method")), rng.sample([*names, "gone"], rng.randrange(0, 5))) for k in range(40)]
    df = spark.createDataFrame([(*row, 1, 2, "def x()", "") for row in index], "id long, symbol_name string, file_path string, symbol_type string, calls array<string>, line_start int, line_end int, signature string, docstring string")
    questions = spark.createDataFrame([(k, n) for k, n in enumerate([*names, "gone", None])], "question int, subject string")
    found = {}
    for r in exploration.flows(df, questions).orderBy("question", "place").collect():
        found.setdefault(r.question, []).append((r.depth, r.id))
    assert found == {k: w for k, n in enumerate(names) if (w := brute_flow(index, n))}
    rows = exploration.exploratory_context(df, questions).where("question = 0").orderBy("place").collect()
    flow = brute_flow(index, "f0")
    assert rows[0].content.startswith("# Execution Flow\n\nf0()") and len(rows) == 1 + min(5, len(flow)) and rows[0].content.count("()") == len(flow)


def test_gap_rounds_step_all_questions_to_their_end(spark):
    said = {
        ("q1", 1): "<answer>a</answer><missing>- x in m.py\n- y\n- x in m.py</missing>",
        ("q1", 2): "<answer>b</answer><missing>- y</missing>",
        ("q2", 1): "<answer>c</answer><missing>NONE</missing>",
        ("q3", 1): "<answer>d</answer><missing>- x in m.py</missing>",
        ("q3", 2): "<answer>e</answer><missing>- x in m.py</missing>",
        ("q3", 3): "<answer>f</answer><missing>- z</missing>",
        ("q4", 1): "<answer>g</answer><missing>- w</missing>",
    }
    script = spark.createDataFrame([(q, p, r) for (q, p), r in said.items()], "question string, pass int, response string")
    contexts = []

    def answer(open_):
        contexts.append({r.question: r.context for r in open_.collect()})
        return open_.drop("context").join(script, ["question", "pass"])

    resolved = []

    def resolve(wanted):
        resolved.append(sorted(r.gap for r in wanted.collect()))
        return wanted.where("gap like 'x%'").select("gap", F.lit("X").alias("content"))

    questions = spark.createDataFrame([(q, "ctx") for q in ("q1", "q2", "q3", "q4", "q5")], "question string, context string")
    known = spark.createDataFrame([("q4", "w")], "question string, gap string")
    states, found = gaps.gap_rounds(questions, answer, resolve, known=known)
    rows = {r.question: (r.answer, r.passes, r.identified, r.resolved, r.unresolved) for r in gaps.summary(states, found).collect()}
    assert rows == {
        "q1": ("b", 2, ["x in m.py", "y"], ["x in m.py"], ["y"]),
        "q2": ("c", 1, [], [], []),
        "q3": ("f", 3, ["x in m.py", "z"], ["x in m.py"], ["z"]),
        "q4": ("g", 1, ["w"], [], ["w"]),
        "q5": (None, 0, [], [], []),
    }
    assert resolved[0] == ["x in m.py", "y"] and contexts[1] == {"q1": "ctx\n\nX", "q3": "ctx\n\nX"} and len(contexts) == 3


def test_gaps_are_resolved_in_the_graph(spark):
    nodes = spark.createDataFrame([(i, n, "function", f, 1, 9, "", f"def {n}()", None) for i, n, f in (("a.py::get", "get", "a.py"), ("b.py::get", "get", "b.py"), ("a.py::put", "put", "a.py"), ("c.py::far", "far", "c.py"))], NODES)
    edges = spark.createDataFrame([("a.py::get", "a.py::put", "calls", 0.9, 1), ("a.py::put", "c.py::far", "calls", 0.9, 1)], EDGES)
    wanted = spark.createDataFrame([("the function get",), ("x.py::put",), ("how it works",), ("function nothing",)], "gap string")
    found = {r.gap: r.content for r in gaps.resolve_in_graph(wanted, nodes, edges).collect()}
    assert set(found) == {"the function get", "x.py::put"} and "def put()" in found["the function get"] and "b.py" not in found["the function get"] and found["x.py::put"].startswith("### a.py") and "def far()" in found["x.py::put"]


TURNS = "user string, ts timestamp, seq long, node string, missing string"


def at(minute):
    return f"2026-01-01 {minute // 60:02d}:{minute % 60:02d}:00"


def run_stream(spark, folder, batches, **options):
    spark.conf.set(*sessions.STATE_STORE)
    try:
        for k, rows in enumerate(batches):
            df = spark.createDataFrame([(u, at(m), s, n, x) for u, m, s, n, x in rows], "user string, ts string, seq long, node string, missing string")
            df.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{folder}/turns")
            stream = spark.readStream.schema(TURNS).parquet(f"{folder}/turns")
            out = sessions.session_events(stream, **options)
            out.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    finally:
        spark.conf.unset(sessions.STATE_STORE[0])
    return spark.read.schema(sessions.OUTPUT).parquet(f"{folder}/out")


def test_sessions_end_by_turns_and_by_timers(spark, tmp_path):
    batches = [
        [("u", 0, 1, "n1", None), ("u", 10, 2, "n2", "gap"), ("v", 5, 3, "m", None), ("w", 1, 8, None, None)],
        [("u", 35, 4, "n1", "gap"), ("v", 50, 5, "k", None)],  # v comes back after its time to live
        [("x", 300, 6, None, None)],  # only the clock moves on
        [("u", 310, 7, "n9", None)],
        [("x", 900, 9, None, None)],
    ]
    rows = run_stream(spark, str(tmp_path), batches).collect()
    ended = sorted((r.user, r.session, r.n, r.first_seq, r.nodes, r.not_found) for r in rows)
    assert ended == [
        ("u", 0, 3, 1, ["n2", "n1"], ["gap"]),
        ("u", 1, 1, 7, ["n9"], []),
        ("v", 0, 1, 3, ["m"], []),
        ("v", 1, 1, 5, ["k"], []),
        ("w", 0, 1, 8, [], []),
        ("x", 0, 1, 6, [], []),
    ]
    assert {(r.user, r.session): r.at.strftime("%H:%M") for r in rows}["u", 0] == "01:05"


def test_a_session_forgets_the_nodes_used_longest_ago(spark, tmp_path):
    batches = [[("u", k, k, f"n{k % 7}", None) for k in range(20)], [("x", 500, 99, None, None)]]
    rows = run_stream(spark, str(tmp_path), batches, params=replace(DEFAULT, session_max_nodes=3), with_open=True).where("user = 'u'").collect()
    assert sorted((r.event, r.nodes) for r in rows) == [("ended", ["n3", "n4", "n5"]), ("open", ["n3", "n4", "n5"])]


def test_answers_are_sent_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "yes", None), ("q2", None, "no model")], "question string, answer string, error string")
    rows.write.parquet(str(tmp_path / "answers"))
    stream = jobs.answer_events(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "answers")))
    sent = []
    sessions.send(stream, str(tmp_path / "state"), sent.extend).awaitTermination()
    assert [(r["question"], r["event"]) for r in sent] == [("q1", "status"), ("q1", "status"), ("q1", "token"), ("q1", "done"), ("q2", "status"), ("q2", "status"), ("q2", "error")]
