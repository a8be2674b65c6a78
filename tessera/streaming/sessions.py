"""Question sessions as a stream with state: nodes cached per session, what was not found, and expiry by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.params import DEFAULT, Params

#: State of this kind lives in RocksDB: set this where such a stream starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "user string, session long, first timestamp, last timestamp, n long, first_seq long, nodes array<string>, not_found array<string>, event string, at timestamp"
#: Rows of one user that are handed on at once.
ROWS_AT_ONCE = 10_000
_OPEN = "session long, first long, last long, n long, first_seq long, nodes array<string>, not_found array<string>"


class SessionProcessor(StatefulProcessor):
    """One user's sessions. A turn later than the time to live after the one before ends a session and opens another; a timer
    at the end of that time ends it without another turn, and the user's state goes but for the number of sessions so far.

    Emits a row when a session ends (`ended`) and, if asked, one for each batch of a session that goes on (`open`).
    """

    def __init__(self, params: Params = DEFAULT, with_open: bool = False):
        self.ttl, self.most, self.with_open = params.session_ttl_minutes * 60_000_000, params.session_max_nodes, with_open

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.count = handle.getValueState("sessions", "n long")

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        """A user's rows, each the open state, the event and its time, as one frame: a frame for each would cost more than the rest."""
        column = lambda k: [s[k] for s, _, _ in rows]
        time = lambda us: pd.to_datetime(us, unit="us")
        lists = lambda k: [list(x) for x in column(k)]
        return pd.DataFrame({"user": [key[0]] * len(rows), "session": column(0), "first": time(column(1)), "last": time(column(2)), "n": column(3), "first_seq": column(4), "nodes": lists(5), "not_found": lists(6), "event": [event for _, event, _ in rows], "at": time([at for _, _, at in rows])})

    def _timer(self, old: int | None, new: int | None) -> None:
        """Timers count milliseconds; one is due when the time to live has passed, not before."""
        if old is not None and old != new:
            self.handle.deleteTimer(self._due(old))
        if new is not None and old != new:
            self.handle.registerTimer(self._due(new))

    def _due(self, last: int) -> int:
        return -(-(last + self.ttl) // 1000)

    def handleInputRows(self, key, turns: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(turns)).sort_values(["us", "seq"])
        s = tuple(self.open.get()) if self.open.exists() else None
        done = int(self.count.get()[0]) if self.count.exists() else 0
        timer, rows = s[2] if s else None, []
        for us, seq, node, missing in zip(turns["us"], turns["seq"], turns["node"], turns["missing"], strict=True):
            us, seq = int(us), int(seq)
            if s and us - s[2] > self.ttl:
                rows.append((s, "ended", s[2] + self.ttl))
                done, s = done + 1, None
            if s is None:
                s = (done, us, us, 0, seq, [], [])
            number, first, last, n, first_seq, nodes, not_found = s
            if node is not None:
                nodes = [x for x in nodes if x != node] + [node]
            if missing is not None and missing not in not_found:
                not_found = [*not_found, missing]
            s = (number, min(first, us), max(last, us), n + 1, first_seq, list(nodes)[-self.most :], list(not_found))
        self._timer(timer, s[2])
        self.open.update(s)
        self.count.update((done,))
        if self.with_open:
            rows.append((s, "open", s[2]))
        for k in range(0, len(rows), ROWS_AT_ONCE):
            yield self._rows(key, rows[k : k + ROWS_AT_ONCE])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = tuple(self.open.get()) if self.open.exists() else None
        # A turn may have moved the end on; then another timer is due.
        if s and self._due(s[2]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            self.count.update((s[0] + 1,))
            yield self._rows(key, [(s, "ended", s[2] + self.ttl)])


def session_events(turns: DataFrame, params: Params = DEFAULT, *, late: str = "0 seconds", with_open: bool = False) -> DataFrame:
    """A stream (user, ts, seq and, if they have them, node, missing) to the ends of sessions, by event time.

    A session ends when the watermark, which trails the newest turn of all users by `late`, has passed its time to live.
    Turns behind the watermark are left out. A user, time or node may be null: no user is a user, no time is left out.
    """
    column = lambda c: (F.col(c) if c in turns.columns else F.lit(None)).cast("string").alias(c)
    rows = turns.where("ts is not null").withWatermark("ts", late)
    rows = rows.select("user", "ts", F.unix_micros("ts").alias("us"), "seq", column("node"), column("missing"))
    return rows.groupBy("user").transformWithStateInPandas(SessionProcessor(params, with_open), OUTPUT, "Append", "EventTime")


def expiry_counts(ended: DataFrame, every: str = "1 hour") -> DataFrame:
    """(window, expired): sessions that ended in each window of event time; what a sweep would have dropped."""
    return ended.where("event = 'ended'").groupBy(F.window("at", every).alias("window")).agg(F.count("*").alias("expired"))


def send(events: DataFrame, checkpoint: str, deliver: Callable[[list[dict]], None], *, most: int = 1000) -> object:
    """Start a query that hands the rows of each batch to a callback, `most` at a time, in their order of columns.

    For feeds that clients read: rows are few, as a batch of them is what changed since the last one.
    """

    def batch(rows: DataFrame, number: int) -> None:
        held: list[dict] = []
        for row in rows.orderBy(*(c for c in ("question", "id", "pos", "seq") if c in rows.columns)).toLocalIterator():
            held.append(row.asDict())
            if len(held) == most:
                deliver(held)
                held = []
        if held:
            deliver(held)

    return events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
