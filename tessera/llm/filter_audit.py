"""Filter interaction audit: what five filters remove in every order, with duplicates found by partition refinement.

Duplicates. Documents are split by their length in code points, then by the hash of one block of text after another, each
longer than the one before; after each split, classes of one document are dropped. The texts of what survives are compared
whole, so hashes only spare work. A document fails if a smaller id has its text.

Counts. Each document becomes a mask of the filters that it fails. Masks are counted by part, before any shuffle, and what
every order removes at every step follows from those few rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

FILTERS = "ABCDE"
#: Code points of the first block, how much longer each next one is, and how many there are; the last is all the rest.
FIRST_BLOCK, BLOCK_GROWTH, BLOCKS = 64, 4, 6
WORDS = r"[^\x20\x09-\x0D]+"
#: 64-bit words of the bitmap of classes that goes to all tasks: a few MB at most, whatever the size of the corpus.
BITMAP_WORDS = 1 << 18


def _blocks(text: Column) -> list[Column]:
    """Hashes of successive blocks that cover the text; beyond its end, that of an empty text."""
    out, at, size = [], 1, FIRST_BLOCK
    for k in range(BLOCKS):
        out.append(F.xxhash64(F.substring(text, at, size if k < BLOCKS - 1 else 2**31 - 1 - at)))
        at, size = at + size, size * BLOCK_GROWTH
    return out


def with_classes(docs: DataFrame, text: Column) -> DataFrame:
    """docs with class_0, by length, and class_k, by the first k blocks too."""
    names = [f"class_{k}" for k in range(BLOCKS + 1)]
    out = docs.withColumn(names[0], F.length(text).cast("long"))
    for k, block in enumerate(_blocks(text)):
        out = out.withColumn(names[k + 1], F.xxhash64(names[k], block))
    return out


def later_copies(classes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, class): documents whose text belongs to a smaller id too; class is the last one.

    classes has id and the columns of with_classes, texts the same rows as (id, text), or with their last class. Rows
    without an id take no part.
    """
    live = classes.where("id is not null").select("id", *(f"class_{k}" for k in range(BLOCKS + 1)))
    for k in range(BLOCKS + 1):
        # Counted before the shuffle; a class of many members is met by its one row.
        several = live.groupBy(f"class_{k}").agg(F.count("*").alias("members")).where("members > 1").select(f"class_{k}")
        live = scratch.keep(live.join(several, f"class_{k}").drop(*(f"class_{j}" for j in range(min(k + 1, BLOCKS)))), f"split-{k}")
        if k:
            scratch.drop(f"split-{k - 1}")
    live = live.select("id", F.col(f"class_{BLOCKS}").alias("class")).distinct()
    # Whole texts: those of classes that may be live, which a bitmap tells at the scan; equal ones of a task meet before the
    # shuffle and go on once. A text that the bitmap let through by chance is alone in its class.
    bitmap = live.groupBy(F.shiftright(_slot(F.col("class")), 6).alias("word")).agg(F.bit_or(_bit(F.col("class"))).alias("bits"))
    bitmap = F.broadcast(scratch.keep(bitmap, "bitmap"))
    last = f"class_{BLOCKS}"
    classed = (texts if last in texts.columns else with_classes(texts, F.col("text"))).withColumn("class", F.col(last))
    maybe = classed.select("id", "class", "text", F.shiftright(_slot(F.col("class")), 6).alias("word")).join(bitmap, "word").where(F.col("bits").bitwiseAND(_bit(F.col("class"))) != 0)
    distinct = scratch.keep(maybe.groupBy("class", "text").agg(F.min("id").alias("least")), "texts")
    shape = distinct.groupBy("class").agg(F.count("*").alias("texts"), F.min("least").alias("least"))
    copies = live.join(shape.where("texts = 1"), "class").where("id > least").select("id", "class")
    mixed = scratch.keep(distinct.join(shape.where("texts > 1").select("class"), "class"), "mixed")
    if not mixed.isEmpty():
        # Different texts met by equal hashes: there the text itself tells.
        copies = copies.union(maybe.join(mixed, ["class", "text"]).where("id > least").select("id", "class"))
    return scratch.keep(copies.distinct(), "copies")


def _slot(class_: Column) -> Column:
    return F.pmod(class_, F.lit(BITMAP_WORDS * 64))


def _bit(class_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(class_, F.lit(64)).cast("int"))


def failures(docs: DataFrame, text: Column) -> DataFrame:
    """docs with `mask`: bit 0 under 100 words, 1 few distinct ones, 2 many capitals, 3 any of the characters #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n_words, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    marked = F.lit(False)
    for c in "#$%&*|":
        marked = marked | F.contains(text, F.lit(c))
    tests = [n_words < 100, 100 * distinct < 80 * n_words, 100 * capitals > 10 * F.length(text), marked]
    mask = F.lit(0)
    for k, test in enumerate(tests):
        mask = mask + F.when(test, 1 << k).otherwise(0)
    return docs.withColumn("mask", mask)


def masks(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters they fail, bit k for FILTERS[k], and labelled ones."""
    scratch = Scratch(docs.sparkSession, "audit")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch.keep(with_classes(failures(texts, F.col("text")), F.col("text")).drop("text"), "rows")
    copies = later_copies(rows, texts.where("id is not null").select("id", "text"), scratch).withColumn("copy", F.lit(1 << FILTERS.index("E")))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.select("id", "part", "mask", F.col(f"class_{BLOCKS}").alias("class")).join(copies, ["id", "class"], "left").join(marks, "id", "left")
    mask = (F.col("mask") + F.coalesce("copy", F.lit(0))).alias("mask")
    return known.groupBy("part", mask).agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """What each filter does at each step of each order, in each part: one row (part, filter_order, step, counts) of all 120 x 5.

    kept after the step, removed by it, redundant (fails the filter, removed before), unique_fails (fails it alone),
    good_lost and toxic_lost (removed here, labelled so), shapley (removed by this filter, summed over all orders).
    A null text is empty, a null part the empty string. Rows are judged apart; rows that repeat an id are copies only of
    smaller ids, a row without an id is no copy and has none, and is not labelled. A document labelled several times is
    good or toxic if one label says so; labels of no document are ignored. An empty table gives no rows.
    """
    orders = F.array(*(F.lit("".join(order)) for order in itertools.permutations(FILTERS)))
    cells = masks(docs, labels, **columns).withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {{}}, 1)) - 1)"
    cells = cells.withColumn("bit", F.expr(bit.format("step")))
    cells = cells.withColumn("before", F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (m, i) -> if(i < step, m | {bit.format('i')}, m))"))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda test, count="n": F.sum(F.when(test, F.col(count)).otherwise(0))
    share = F.expr(f"n * {len(list(itertools.permutations(FILTERS)))} div bit_count(mask)")
    return cells.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
        # A document is removed by each of the filters it fails in an equal share of the orders.
        F.sum(F.when(fails, share).otherwise(0)).alias("shapley"),
    )
