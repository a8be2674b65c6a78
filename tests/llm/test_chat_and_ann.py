import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, chat, queries


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string, segments string")


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learned = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.parametrize(("budget", "history"), [(2048, 512), (60, 15), (20, 0)])
def test_windows_read_back_exactly(spark, odd_texts, budget, history):
    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(12):
        turns = [("system", "be kind <|user|>")] if conv % 3 == 0 else []
        turns += [(("user", "assistant")[k % 2], rng.choice([*odd_texts[:9], "</s>[INST] ok [/INST]", "\\\\l <\\ [b \\"]) or "") for k in range(rng.randrange(1, 25))]
        want[conv] = digests(turns)
        rows += [(conv, k, r, t if t or rng.random() < 0.5 else None, "w", None) for k, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    made = chat.windows(conversations(spark, rows), budget=budget, history=history)
    found = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()}
    assert found == want
    for r in made.collect():
        pos = [s.pos for s in r.segments]
        own = [s for s in r.segments if not s.repeated]
        assert pos == sorted(set(pos)) and own and all(s.role == "assistant" and not s.repeated for s in r.segments if s.loss)
        again = [s for s in r.segments if s.repeated and s.role != "system"]
        assert sum(-(-len(s.body) // 4) for s in again) <= history
        assert [s.pos for s in again] == list(range(own[0].pos - len(again), own[0].pos))
        if r.conv_id % 3 == 0:
            assert r.segments[0].role == "system"
        assert r.formatted == "".join(s.body for s in r.segments) and r.context_chars == sum(len(s.body) for s in r.segments if s.repeated)
        bare = [s.body.partition("|>")[2].removesuffix("</s>") for s in r.segments if s.loss]
        assert [r.formatted[x.start : x.start + x.length] for x in r.loss] == bare
        head = tokens(r.segments[0]) if r.segments[0].role == "system" and r.segments[0].pos == 0 else 0
        if max((tokens(s) for s in own if s.pos or not head), default=0) + head <= budget:
            assert sum(map(tokens, r.segments)) <= budget


def tokens(segment):
    return -(-len(segment.body) // 4)


def test_turns_that_fit_never_overflow(spark):
    """Turns of 1530, 1500 and 1000 tokens, of some 1700 beside small ones, and by counts of the caller's own."""
    for sizes in ((1530, 1500, 1000), (1700, 3, 1900, 40, 2040), (600, 600, 600, 600, 600, 600), (2040, 2040)):
        rows = [(1, k, "user", "x" * (4 * n - 13), None, None) for k, n in enumerate(sizes)]
        made = chat.windows(conversations(spark, rows)).collect()
        assert all(sum(map(tokens, r.segments)) <= 2048 for r in made)
        assert sorted(s.pos for r in made for s in r.segments if not s.repeated) == list(range(len(sizes)))
    counted = spark.createDataFrame([(1, k, "user", "word", 900) for k in range(6)], "conv_id long, turn long, role string, text string, n int")
    made = chat.windows(counted, tokens_col="n").collect()
    assert all(len(r.segments) * 900 <= 2048 for r in made) and len(made) < 6


def test_escape_is_reversible_and_hides_control_strings(spark):
    texts = ["", "\\", "\\\\", "<", "\\l", "\\\\l", "[", "\\b[", "</s>", "<|user|>", "a\\<[\\\\", "\x00\\l"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and "<" not in r.e and "[" not in r.e for r in rows)


def test_null_keys_and_empty_tables(spark):
    rows = [(None, 1, "user", "a", None, None), (None, 2, None, None, None, None), (5, None, "assistant", "b", None, None), (5, None, "assistant", "b", None, None)]
    found = {r.conv_id: r for r in chat.read_back(chat.windows(conversations(spark, rows))).collect()}
    assert found[None].n_turns == 2 and found[5].n_turns == 2 and found[5].loss_chars == 2
    assert chat.read_back(chat.windows(conversations(spark, []))).count() == 0


def exact(rows, k=10):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))}
    out = {}
    for q in good:
        if q % 5 == 0:
            near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out[q] = near
    return out


def test_search_is_exact_when_all_leaves_are_visited_and_skips_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(150, 190)]  # one common vector
    rows += [(200, None), (205, [0.0] * 6), (210, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (215, [float("nan")] + [1.0] * 5), (220, [float("inf")] + [1.0] * 5), (225, []), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, "a", 0.5) for i, v in rows], "vec_id long, embedding array<float>, rep string, score double")
    found = {}
    for r in ann.nearest(table, F.col("vec_id") % 5 == 0, reach=1.0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = exact(rows)
    assert set(found) == set(want)
    for q, near in want.items():
        own = sorted(found[q])
        assert [x[0] for x in own] == list(range(1, len(near) + 1)) and [x[2] for x in own] == [i for _, i in near]
        assert np.allclose([x[1] for x in own], [d for d, _ in near], atol=1e-12)


def test_repeated_rows_use_up_no_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(6).astype(np.float32)]) for i in range(60)]
    rows += [(i, rows[3][1]) for i in range(60, 75)]  # one common vector
    # One id with several vectors, and vectors under several ids, near each other: pairs merge after the nearest are named.
    several = [(7, [float(np.float32(x + d)) for x in rows[5][1]]) for d in (0.001, 0.002, 0.003, 0.004, 0.005, 0.006, 0.007, 0.008, 0.009, 0.01, 0.011, 0.012)]
    for more in ([], several):
        own = rows + more
        table = spark.createDataFrame(own * 3 + [own[3]] * 40, "vec_id long, embedding array<float>")
        found = {}
        for r in ann.nearest(table, F.col("vec_id") % 5 == 0, reach=1.0).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        for q in range(0, 75, 5):
            at, least = np.array(own[q][1]), {}
            for i, v in own:
                if i != q:
                    least[i] = min(least.get(i, np.inf), float(np.sqrt(((np.array(v) - at) ** 2).sum())))
            near = sorted((d, i) for i, d in least.items())[:10]
            assert sorted(found[q]) == [(r + 1, i) for r, (_, i) in enumerate(near)], q


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1", "check_l"])
def test_recall_of_the_query(spark, folder):
    """The query itself, on its own parameters, against brute force; the large table is one that the check tool has."""
    path = f"/root/testdata/{folder}"
    if not os.path.exists(f"{path}/embeddings.parquet"):
        pytest.skip("no such table here")
    table = [r for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect() if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    ids, vectors = np.array([r[0] for r in table]), np.array([r[1] for r in table], np.float64)
    found = {}
    for r in queries.op5_nearest_neighbours(spark, path).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    asked = np.unique(ids[ids % 100 == 0])
    assert sorted(found) == asked.tolist()
    hit = total = 0
    for q in asked[:: max(1, len(asked) // 100)]:
        distance = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        distance[ids == q] = np.inf
        far = np.sort(distance)[min(10, len(ids)) - 1]
        assert [x[0] for x in sorted(found[q])] == list(range(1, 11))
        hit, total = hit + sum(score <= far + 1e-9 for _, _, score in found[q]), total + 10
    assert hit / total >= 0.95


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [1.0, 0.0]), (7, [0.0, 1.0])], schema)
    rows = sorted(tuple(r) for r in ann.nearest(few, F.col("vec_id") % 100 == 0).collect())
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(few.limit(1), F.lit(True)).count() == 0


def test_the_query_has_several_windows(spark, sf):
    """op4_chat_windows over its table: most conversations take several windows, and all read back whole."""
    rows = queries.op4_chat_windows(spark, sf).collect()
    turns = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", queries.LOOP_TEXT), ("assistant", queries.LOOP_TEXT)]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == {c: digests(t) for c, t in turns.items()}
    assert sum(r.n_windows > 1 for r in rows) * 2 > len(rows)
