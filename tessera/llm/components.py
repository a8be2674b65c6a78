"""Connected components by randomised contraction; labels are the smallest member."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

#: Rounds at the start that go by the ids themselves: they finish stars, the usual shape, in two.
PLAIN_ROUNDS = 2


def _order(k: int):
    """A column's place in the order of round k, as a struct that holds its id last."""
    by_id = k < PLAIN_ROUNDS or k % 2
    return lambda x: F.struct((F.lit(0).cast("long") if by_id else F.xxhash64(F.col(x), F.lit(k))).alias("turn"), F.col(x).alias("id"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every end of edges (a, b); loops and repeated edges add nothing, no edges give no rows.

    Each round every vertex hooks to the first vertex of its closed neighbourhood in some order, and the graph is contracted
    to the hooks. From round PLAIN_ROUNDS on every other round orders vertices by a hash that changes with the round: that
    leaves at most three quarters of the vertices, as expected over hashes, on any graph under any labels (Bögeholz, Brand
    and Todor, In-database connected component analysis, 2020), so rounds grow with the logarithm of the vertices.
    Edges and hooks shrink by the round and stay distributed; the hooks of all rounds are composed once, last round first.
    """
    edges = scratch.keep(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    rounds: list[DataFrame] = []
    for k in itertools.count():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("x")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("x")))
        place = _order(k)
        first = both.groupBy("v").agg(F.min(place("x")).alias("first"))
        hooks = first.select("v", F.least("first", place("v"))["id"].alias("to"))
        hooks = scratch.keep(hooks, f"{name}-hooks-{k}")
        rounds.append(hooks)
        at_a, at_b = hooks.select(F.col("v").alias("a"), F.col("to").alias("x")), hooks.select(F.col("v").alias("b"), F.col("to").alias("y"))
        smaller = edges.join(at_a, "a").join(at_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = scratch.keep(smaller, f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}")
        if edges.isEmpty():
            break
    labels = rounds.pop().select(F.col("v").alias("id"), F.col("to").alias("component"))
    for k in range(len(rounds) - 1, -1, -1):
        final = labels.select(F.col("id").alias("to"), "component")
        labels = scratch.keep(rounds[k].join(final, "to", "left").select(F.col("v").alias("id"), F.coalesce("component", "to").alias("component")), f"{name}-labels-{k}")
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return scratch.keep(labels.join(least, "component").select("id", F.col("least").alias("component")), f"{name}-labels")
