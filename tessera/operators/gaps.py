"""The loop over what answers say is missing, for many questions at once: a table of question states, stepped to a fixed point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import graph
from tessera.params import DEFAULT, Params
from tessera.sources.durable import Kept

#: (question, pass, context) of open questions to (question, response); what isn't answered is closed.
Answer = Callable[[DataFrame], DataFrame]
#: (gap) to (gap, content): what was found for gaps; a gap without a row was not found.
Resolve = Callable[[DataFrame], DataFrame]


def gap_rounds(questions: DataFrame, answer: Answer, resolve: Resolve, *, known: DataFrame | None = None, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(states, gaps) after at most `gap_passes` passes over questions (question, context).

    Each pass answers the open questions, reads the gaps off their answers and resolves those that the question has not
    looked for in vain before: each gap once, whichever questions ask for it. What was found is added to the context; a
    question without gaps, or with none but such as were not found before, is closed.

    states: (question, answer, passes, context). gaps: (question, gap, first_pass, resolved), each gap of a question once;
    one that was found in one pass and asked for again stays resolved. `known` (question, gap) are gaps of the session that
    were not found earlier. Answers are written before they are read twice, so no question is put again after a failure.
    """
    spark = questions.sparkSession
    keep = Kept(spark)
    states = keep(questions.select("question", F.col("context").cast("string").alias("context"), F.lit(None).cast("string").alias("answer"), F.lit(0).alias("passes"), F.lit(True).alias("open")))
    empty = questions.select("question", F.lit("").alias("gap"), F.lit(0).alias("first_pass"), F.lit(False).alias("resolved")).limit(0)
    asked = empty
    missing = empty.select("question", "gap") if known is None else known.select("question", "gap").distinct()
    for number in range(1, params.gap_passes + 1):
        open_ = states.where("open")
        if open_.isEmpty():
            break
        replies = keep(answer(open_.select("question", F.lit(number).alias("pass"), "context")).select("question", "response"))
        gaps = replies.select("question", F.posexplode(F.array_distinct(fn.gap_list(F.col("response")))).alias("pos", "gap"))
        fresh = keep(gaps.join(missing, ["question", "gap"], "left_anti"))
        # A gap is looked for once, however many questions name it.
        found = keep(resolve(fresh.select("gap").distinct()).groupBy("gap").agg(F.first("content").alias("content")).where("content is not null"))
        hits = fresh.join(found, "gap")
        added = hits.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n").alias("added"))
        lost = fresh.join(found.select("gap"), "gap", "left_anti").select("question", "gap")
        now = gaps.select("question", "gap").join(hits.select("question", "gap", F.lit(True).alias("hit")), ["question", "gap"], "left")
        now = now.select("question", "gap", F.lit(number).alias("first_pass"), F.coalesce("hit", F.lit(False)).alias("resolved"))
        asked = keep(asked.unionByName(now).groupBy("question", "gap").agg(F.min("first_pass").alias("first_pass"), F.max("resolved").alias("resolved")))
        missing = keep(missing.union(lost).distinct())
        goes_on = fresh.select("question").distinct().withColumn("goes_on", F.lit(True))
        stepped = open_.select("question", "context", "passes").join(replies, "question", "left").join(added, "question", "left").join(goes_on, "question", "left")
        stepped = stepped.select(
            "question",
            F.concat_ws("\n\n", "context", "added").alias("context"),
            fn.answer_text(F.col("response")).alias("answer"),
            (F.col("passes") + F.col("response").isNotNull().cast("int")).alias("passes"),
            F.coalesce("goes_on", F.lit(False)).alias("open"),
        )
        states = keep(states.where("not open").unionByName(stepped))
    return states.select("question", "answer", "passes", "context"), asked


def resolve_in_graph(gaps: DataFrame, nodes: DataFrame, edges: DataFrame, *, hops: int = 1, most: int = 20) -> DataFrame:
    """(gap, content): for specific gaps, the node they name (the first by id of those so called) and what is around it.

    Content is the snippets of that node and of its `most` most connected neighbours at most.
    """
    wanted = gaps.where(fn.is_specific_gap(F.col("gap"))).select("gap", fn.gap_node_name(F.col("gap")).alias("name")).where("name <> ''")
    names = nodes.select("id", "name").union(nodes.where(F.contains("id", F.lit("::"))).select("id", F.substring_index("id", "::", -1).alias("name")))
    hit = names.groupBy("name").agg(F.min("id").alias("id"))
    reached = wanted.join(hit, "name").select("gap", "id", F.lit(0).alias("hop"))
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("next")).union(edges.select("target", "source")).distinct()
    frontier = reached
    for hop in range(1, hops + 1):
        frontier = frontier.join(both, "id").select("gap", F.col("next").alias("id")).distinct().join(reached, ["gap", "id"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.unionByName(frontier)
    ranked = reached.join(graph.degrees(edges), "id", "left").withColumn("place", F.row_number().over(Window.partitionBy("gap").orderBy("hop", F.desc_nulls_last("degree"), "id"))).where(F.col("place") <= most + 1)
    text = graph.node_snippet(F.col("file_path"), F.col("line_start"), F.col("line_end"), F.col("docstring"), F.col("signature"))
    shown = ranked.join(nodes.select("id", text.alias("text")), "id")
    return shown.groupBy("gap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n").alias("content"))


def summary(states: DataFrame, gaps: DataFrame) -> DataFrame:
    """One row for each question: answer, passes, and its gaps as sorted arrays (identified, resolved, unresolved)."""
    lists = gaps.groupBy("question").agg(
        F.array_sort(F.collect_list("gap")).alias("identified"),
        F.array_sort(F.collect_list(F.when(F.col("resolved"), F.col("gap")))).alias("resolved"),
        F.array_sort(F.collect_list(F.when(~F.col("resolved"), F.col("gap")))).alias("unresolved"),
    )
    none = F.array().cast("array<string>")
    return states.join(lists, "question", "left").select("question", "answer", "passes", *(F.coalesce(c, none).alias(c) for c in ("identified", "resolved", "unresolved")))
