"""Chat formatting in budgeted windows, by DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: a turn is `<|role|>text</s>`.
OPEN, MIDDLE, CLOSE = "<|", "|>", "</s>"
#: Opens the marks that stand for `<` and `[`, the first characters of all control strings; doubled where it stands itself.
ESCAPE = "\\"
#: Tokens to a window, and of earlier turns that a window repeats.
BUDGET, HISTORY = 2048, 512


def escape(text: Column) -> Column:
    """Reversible: afterwards no control string of the template is left in the text."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + ESCAPE))
    out = F.replace(out, F.lit("<"), F.lit(ESCAPE + "l"))
    return F.replace(out, F.lit("["), F.lit(ESCAPE + "b"))


def unescape(text: Column) -> Column:
    """The inverse of escape: doubled escapes are split off first, so that none of them is taken for the start of another mark."""
    parts = F.transform(F.split(text, r"\\\\"), lambda p: F.replace(F.replace(p, F.lit(ESCAPE + "l"), F.lit("<")), F.lit(ESCAPE + "b"), F.lit("[")))
    return F.array_join(parts, ESCAPE)


def token_estimate(text: Column) -> Column:
    """Tokens of a formatted turn: a fourth of its code points, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """Conversations cut into windows: (conv_id, window, formatted, context_chars, loss, segments), a row for each window.

    Prefix sums of turn tokens choose the spans, turns are never split. The prefix falls into steps of `budget` less the
    system turn and `history`; turns that begin and end in one step are one window's. A turn that crosses into a later step
    joins them if all fits the budget (then less history is repeated), else it is a window of its own. So a window is
    longer than `budget` only where one turn and the system turn alone are. Each window opens with the conversation's system
    turn (its first turn, if its role is system), repeats up to `history` tokens of the turns right before its span, as far
    as the budget allows, then holds its span.

    formatted is the window's text; its first context_chars characters are turns that an earlier window holds. loss, the
    mask, lists (start, length) of the characters to learn from: texts of assistant turns of the span, so each target counts
    once. segments lists the turns as struct(pos, turn, role, body, repeated, loss).

    Tokens are those of tokens_col, a count for each turn by the tokenizer of choice, else a fourth of the formatted turn's
    characters, rounded up. A null text is empty, a null role is written as an empty one; rows of one turn number stay apart,
    ordered by role and text; a null conversation is one of its own. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), *([F.col(tokens_col).cast("long").alias("tokens")] if tokens_col else []))
    rows = rows.withColumn("opening", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).withColumn("said", escape(F.col("text"))).drop("text")
    rows = rows.withColumn("body", F.concat("opening", "said", F.lit(CLOSE)))
    estimate = token_estimate(F.col("body"))
    rows = rows.withColumn("tokens", F.coalesce("tokens", estimate) if tokens_col else estimate)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("pos", F.row_number().over(order) - 1).withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    first = F.first(F.struct("role", "tokens", "turn", "body", "opening", "said")).over(order)
    rows = rows.withColumn("head", F.when(first["role"] == "system", first))
    system = F.coalesce(F.col("head.tokens"), F.lit(0))
    system_turn = F.col("head").isNotNull() & (F.col("pos") == 0)
    room = F.greatest(F.lit(budget - history) - system, F.lit(1))
    begins = F.when(system_turn, 0).otherwise(F.col("before") - system)
    rows = rows.withColumn("begins", begins).withColumn("step", F.floor(F.col("begins") / room))
    rows = rows.withColumn("crosses", ~system_turn & (F.col("begins") + F.col("tokens") > (F.col("step") + 1) * room))
    inner = F.sum(F.when(~F.col("crosses") & ~system_turn, F.col("tokens")).otherwise(0)).over(Window.partitionBy("conv_id", "step"))
    alone = F.col("crosses") & (inner + F.col("tokens") + system > budget)
    rows = rows.withColumn("key", 2 * F.col("step") + alone.cast("int"))
    # The system turn belongs to the first window that has turns.
    rows = rows.withColumn("key", F.when(system_turn, F.coalesce(F.min(F.when(~system_turn, F.col("key"))).over(Window.partitionBy("conv_id")), F.lit(0))).otherwise(F.col("key")))
    rows = rows.withColumn("window", (F.dense_rank().over(Window.partitionBy("conv_id").orderBy("key")) - 1).cast("int"))
    # A turn is repeated in every later window that begins within its history tokens.
    spans = Window.partitionBy("conv_id", "window")
    inside = F.sum(F.when(~system_turn, F.col("tokens")).otherwise(0)).over(spans)
    own_pos = F.when(~system_turn, F.col("pos"))
    rows = rows.withColumn("reach", F.least(F.lit(history), F.lit(budget) - system - inside)).withColumn("first_pos", F.min(own_pos).over(spans))
    opened = F.when(F.col("pos") == F.col("first_pos"), F.struct("window", "begins", "reach"))
    ahead = Window.partitionBy("conv_id").orderBy("begins").rangeBetween(0, history)
    rows = rows.withColumn("later", F.collect_list(opened).over(ahead))
    own = F.array(F.struct("window", F.lit(False).alias("repeated")))
    again = F.transform(
        F.filter("later", lambda w: (w["window"] > F.col("window")) & (w["begins"] - F.col("begins") <= w["reach"]) & ~system_turn),
        lambda w: F.struct(w["window"].alias("window"), F.lit(True).alias("repeated")),
    )
    placed = rows.select("conv_id", "turn", "role", "opening", "said", "body", "pos", F.explode(F.concat(own, again)).alias("w")).select("*", "w.*").drop("w")
    heads = rows.where("head is not null and window > 0").groupBy("conv_id", "window").agg(F.first("head").alias("h"))
    heads = heads.select("conv_id", F.col("h.turn").alias("turn"), F.col("h.role").alias("role"), F.col("h.opening").alias("opening"), F.col("h.said").alias("said"), F.col("h.body").alias("body"), F.lit(0).alias("pos"), "window", F.lit(True).alias("repeated"))
    placed = placed.unionByName(heads)
    learned = ~F.col("repeated") & (F.col("role") == "assistant")
    segment = F.struct("pos", "turn", "role", "body", "repeated", learned.alias("loss"), F.length("opening").alias("skip"), F.length("said").alias("chars"))
    made = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(segment)).alias("s"))
    # Where each turn of the window starts: a running sum over its few turns.
    spans = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["body"])).alias("at"),
            F.when(t["loss"], F.concat(a["loss"], F.array(F.struct((a["at"] + t["skip"]).cast("long").alias("start"), t["chars"].cast("long").alias("length"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    context = F.aggregate(F.filter("s", lambda t: t["repeated"]), F.lit(0).cast("long"), lambda a, t: a + F.length(t["body"]))
    segments = F.transform("s", lambda t: F.struct(*(t[c].alias(c) for c in ("pos", "turn", "role", "body", "repeated", "loss"))))
    return made.select("conv_id", "window", F.array_join("s.body", "").alias("formatted"), context.alias("context_chars"), spans.alias("loss"), segments.alias("segments"))


def read_back(made: DataFrame) -> DataFrame:
    """Digests of conversations as read from the windows' texts and masks alone.

    Turns are parsed from formatted after its context by the template's marks, and unescaped; texts to learn from are the
    characters under the mask, unescaped. (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows)
    """
    fresh = F.substr("formatted", F.col("context_chars") + 1)
    pieces = F.filter(F.split(fresh, F.lit(CLOSE)), lambda p: p != "")
    role = lambda p: unescape(F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, MIDDLE) - len(OPEN) - 1))
    text = lambda p: unescape(F.substr(p, F.instr(p, MIDDLE) + len(MIDDLE)))
    said = F.transform(pieces, lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n")))
    learned = F.transform("loss", lambda x: unescape(F.substr("formatted", x["start"] + 1, x["length"])))
    read = made.select("conv_id", "window", F.length("formatted").alias("chars"), F.size(pieces).alias("n"), F.array_join(said, "").alias("said"), F.array_join(learned, "").alias("learned"))
    whole = read.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"), F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "said", "learned"))).alias("w"))
    all_said, all_learned = F.array_join("w.said", ""), F.array_join("w.learned", "")
    return whole.select("conv_id", F.col("n_turns").cast("long"), F.sha2(all_said, 256).alias("turns_sha256"), F.length(all_learned).cast("long").alias("loss_chars"), F.sha2(all_learned, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"), "n_windows")
