"""The job feed and question sessions as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.params import DEFAULT, Params

#: Job states by event type of the feed.
STATUS = {"signup": "pending", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}
FINAL = ["completed", "failed", "cancelled"]


def read_events(spark: SparkSession, path: str, schema, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of job events from a folder of Parquet files; times without a zone become timestamps, as watermarks need."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def status_of(event_type):
    return F.coalesce(*(F.when(event_type == k, v) for k, v in STATUS.items()))


def latest_states(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """(id, ts, seq, status, progress rows): the latest state of each job, in update mode; what is later than the watermark is left out."""
    rows = events.withWatermark("ts", late)
    newest = F.max(F.struct("ts", "seq", "status")).alias("s")
    return rows.groupBy("id").agg(newest, F.count("*").alias("events")).select("id", "s.ts", "s.seq", "s.status", "events")


def progress_events(states: DataFrame) -> DataFrame:
    """(event, data): what a client of the feed gets; the last event of a job names its end."""
    kind = F.when(F.col("status").isin(*FINAL), F.when(F.col("status") == "completed", "complete").otherwise(F.col("status"))).otherwise("progress")
    return states.select(kind.alias("event"), F.to_json(F.struct(*states.columns)).alias("data"))


def sessions(turns: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(user, session, first, last, n): questions of one user less than the time to live apart are one session; batch form."""
    order = Window.partitionBy("user").orderBy("ts", "seq")
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)
    fresh = F.when(gap.isNull() | (gap > params.session_ttl_minutes * 60_000_000), 1).otherwise(0)
    rows = turns.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy("user", "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


SESSION_SCHEMA = "user string, session long, nodes array<string>, expired boolean"


def update_session(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, params: Params = DEFAULT) -> Iterator[pd.DataFrame]:
    """One user's state (session, nodes) after new rows, or its end when it timed out: the least recently used nodes go beyond the limit."""
    number, nodes = state.get if state.exists else (0, [])
    nodes = list(nodes)
    columns = ["user", "session", "nodes", "expired"]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], number, nodes, True)], columns=columns)
        return
    for batch in batches:
        for node in batch.sort_values(["ts", "node"])["node"]:
            nodes = [x for x in nodes if x != node] + [node]
    nodes = nodes[-params.session_max_nodes :]
    state.update((number, nodes))
    state.setTimeoutDuration(params.session_ttl_minutes * 60_000)
    yield pd.DataFrame([(key[0], number, nodes, False)], columns=columns)


def session_cache(turns: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """A stream (user, ts, node) to each session's cached nodes; state ends with its time to live."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from update_session(key, batches, state, params)

    return turns.groupBy("user").applyInPandasWithState(update, SESSION_SCHEMA, "session long, nodes array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def answer_events(answers: DataFrame) -> DataFrame:
    """(question, pos, event, data): searching, thinking, then the answer and done, or an error. answers: (question, answer, error)."""
    status = lambda s: F.to_json(F.struct(F.lit(s).alias("stage")))
    good = F.array(F.struct(F.lit("token").alias("event"), F.to_json(F.struct(F.col("answer").alias("text"))).alias("data")), F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data")))
    bad = F.array(F.struct(F.lit("error").alias("event"), F.to_json(F.struct(F.col("error").alias("message"))).alias("data")))
    head = F.array(F.struct(F.lit("status").alias("event"), status("searching").alias("data")), F.struct(F.lit("status").alias("event"), status("thinking").alias("data")))
    return answers.select("question", F.posexplode(F.concat(head, F.when(F.col("error").isNull(), good).otherwise(bad))).alias("pos", "e")).select("question", "pos", "e.*")


def read_progress(spark: SparkSession, base: str) -> DataFrame:
    """A stream of a build's phases (id, phase, step, total, at), as build.record_progress appends them."""
    return spark.readStream.schema("id string, phase string, step int, total int, at timestamp").parquet(f"{base}/progress")
