"""Leaves that hold too many rows for the forest's sample are split by trees of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def table_of(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<float>").repartition(4)


def found_by(rows):
    found = {}
    for r in rows.collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    return {q: [i for _, i in sorted(x)] for q, x in found.items()}


def nearest_of(vectors, q, k=10):
    distance = np.sqrt(((vectors.astype(np.float64) - vectors[q].astype(np.float64)) ** 2).sum(1))
    distance[q] = np.inf
    return np.lexsort((np.arange(len(vectors)), distance))[:k].tolist()


@pytest.mark.parametrize("part", [1 << 16, 64])
def test_split_forests_are_exact_at_full_reach(spark, monkeypatch, part):
    """Also where a leaf is dealt in parts that each meet a copy of its tree, and with one vector that many rows share."""
    monkeypatch.setattr(ann, "LEAF_PART", part)
    rng = np.random.default_rng(part)
    vectors = rng.standard_normal((900, 6)).astype(np.float32)
    vectors[500:560] = vectors[3]
    rows = ann.nearest(table_of(spark, vectors), F.col("vec_id") % 50 == 0, reach=1.0, sample=60, split_sample=120, leaf_rows=8, trees=2)
    found = found_by(rows)
    assert sorted(found) == list(range(0, 900, 50))
    for q, own in found.items():
        assert own == nearest_of(vectors, q), q


def test_split_leaves_are_small_and_recall_holds(spark):
    """Clustered vectors: few of all rows are read, and most of the nearest are found."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 4
    vectors = (centres[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 16))).astype(np.float32)
    rows = ann.nearest(table_of(spark, vectors), F.col("vec_id") % 100 == 0, sample=200, leaf_rows=16, trees=6)
    found = found_by(rows)
    hits = [len(set(found[q]) & set(nearest_of(vectors, q))) for q in found]
    assert len(found) == 40 and np.mean(hits) >= 9.0


def test_leaves_come_by_margin_below_a_leaf_as_above():
    rng = np.random.default_rng(7)
    points = rng.standard_normal((300, 5))
    tree = ann.Tree(points, 8, rng)
    query = rng.standard_normal(5)
    all_ = list(ann.by_margin([tree], query))
    assert [m for m, *_ in all_] == sorted(m for m, *_ in all_) and len(all_) == tree.leaves
    again = list(ann.by_margin([ann.Tree.unpacked(tree.packed())], query, [0.7]))
    assert [m for m, *_ in again] == sorted(m for m, *_ in again) and min(m for m, *_ in again) == 0.7
    assert {leaf for *_, leaf in again} == {leaf for *_, leaf in all_}
    leaf = tree.route(points)
    for margin, _, k in all_:
        if margin > 0 and (leaf == k).any():
            assert np.sqrt(((points[leaf == k] - query) ** 2).sum(1)).min() >= margin - 1e-6
