"""Call flows below the entry points of many questions, walked together in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entry points of a question, callees that a step follows, steps, and rows shown.
ENTRIES, BRANCH, DEPTH, SHOWN = 2, 3, 3, 5


def entry_rows(index: DataFrame, questions: DataFrame, *, most: int = ENTRIES) -> DataFrame:
    """(question, entry, id, symbol_name, file_path): rows named as a question's subject; routes first, then functions."""
    kind = F.when(F.contains(F.lower("symbol_type"), F.lit("route")), 0).when(F.col("symbol_type") == "function", 1).otherwise(2)
    hits = questions.select("question", F.col("subject").alias("symbol_name")).join(index.select("id", "symbol_name", "file_path", kind.alias("kind")), "symbol_name")
    place = F.row_number().over(Window.partitionBy("question").orderBy("kind", "id"))
    return hits.withColumn("entry", place).where(F.col("entry") <= most).select("question", "entry", "id", "symbol_name", "file_path")


def next_rows(index: DataFrame, names: DataFrame, *, branch: int = BRANCH) -> DataFrame:
    """(symbol_name, k, next_id, next_name, next_file): for names (symbol_name), the first rows by id that the first row of
    that name calls. A name that many rows have is cut to its first rows before it meets its callers."""
    first = index.join(names.distinct(), "symbol_name", "left_semi").groupBy("symbol_name").agg(F.min_by("calls", "id").alias("calls"))
    called = first.select("symbol_name", F.explode(F.array_distinct("calls")).alias("next_name"))
    nth = F.row_number().over(Window.partitionBy("symbol_name").orderBy("id"))
    heads = index.select("id", "symbol_name", "file_path").join(called.select(F.col("next_name").alias("symbol_name")).distinct(), "symbol_name", "left_semi").withColumn("nth", nth).where(F.col("nth") <= branch)
    heads = heads.select(F.col("id").alias("next_id"), F.col("symbol_name").alias("next_name"), F.col("file_path").alias("next_file"))
    place = F.row_number().over(Window.partitionBy("symbol_name").orderBy("next_id"))
    return called.join(heads, "next_name").withColumn("k", place).where(F.col("k") <= branch).select("symbol_name", "k", "next_id", "next_name", "next_file")


def flows(index: DataFrame, questions: DataFrame, *, depth: int = DEPTH, branch: int = BRANCH, entries: int = ENTRIES) -> DataFrame:
    """(question, place, depth, id, symbol_name, file_path): rows in the order of a depth-first walk that visits each
    (file, symbol) of a question once; places from 0. questions (question, subject); without a subject or a hit no rows.

    All walks grow together, level by level. A question has at most entries * (branch ** (depth + 1)) rows, visits of which
    are settled in order inside one row's array.
    """
    level = entry_rows(index, questions.where("subject is not null"), most=entries).select("question", F.array("entry").alias("ord"), "id", "symbol_name", "file_path")
    walked = level
    for _ in range(depth):
        steps = next_rows(index, level.select("symbol_name"), branch=branch)
        level = level.select("question", "ord", "symbol_name").join(steps, "symbol_name").select("question", F.concat("ord", F.array("k")).alias("ord"), F.col("next_id").alias("id"), F.col("next_name").alias("symbol_name"), F.col("next_file").alias("file_path"))
        walked = walked.unionByName(level)
    steps = F.array_sort(F.collect_list(F.struct("ord", "id", "symbol_name", "file_path")))
    kept = F.aggregate(
        "steps",
        F.expr("cast(array() as array<struct<ord:array<int>,id:" + index.schema["id"].dataType.simpleString() + ",symbol_name:string,file_path:string>>)"),
        lambda seen, step: F.when(
            F.exists(seen, lambda x: x["file_path"].eqNullSafe(step["file_path"]) & (x["symbol_name"] == step["symbol_name"]))
            # What a visited symbol calls was walked where it was visited first.
            | ((F.size(step["ord"]) > 1) & ~F.exists(seen, lambda x: x["ord"] == F.slice(step["ord"], 1, F.size(step["ord"]) - 1))),
            seen,
        ).otherwise(F.concat(seen, F.array(step))),
    )
    rows = walked.groupBy("question").agg(steps.alias("steps")).select("question", F.posexplode(kept).alias("place", "s"))
    return rows.select("question", "place", (F.size("s.ord") - 1).alias("depth"), "s.id", "s.symbol_name", "s.file_path")


def exploratory_context(index: DataFrame, questions: DataFrame, *, shown: int = SHOWN) -> DataFrame:
    """(question, place, content, path, line_start, line_end, relevance): for each question the flow as text (place -1), then
    its first rows. The columns of retrieval.RESULT, for many questions."""
    walk = flows(index, questions)
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.when(F.col("depth") > 0, "-> ").otherwise(""), F.col("symbol_name"), F.lit("()"))
    text = walk.withColumn("line", line).groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    none = F.lit(None).cast("int")
    head = text.join(questions.select("question", "subject"), "question").select("question", F.lit(-1).alias("place"), F.concat(F.lit("# Execution Flow\n\n"), F.col("lines")).alias("content"), F.lit("<flow diagram>").alias("path"), none.alias("line_start"), none.alias("line_end"), F.concat(F.lit("Execution flow for "), F.col("subject")).alias("relevance"))
    first = walk.where(F.col("place") < shown).select("question", "place", "depth", "id").join(index, "id")
    calls = F.slice("calls", 1, 5)
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("file_path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end")), F.when(F.col("signature") != "", F.concat(F.lit("# "), F.col("signature"))), F.when(F.size(calls) > 0, F.concat(F.lit("# Calls: "), F.array_join(calls, ", "))))
    rows = first.select("question", "place", body.alias("content"), F.col("file_path").alias("path"), "line_start", "line_end", F.concat(F.lit("Flow step at depth "), F.col("depth").cast("string")).alias("relevance"))
    return head.unionByName(rows)
