"""Ranked lexical search over a two-level quantised index.

Every row of the index is one document: the hashes of its distinct terms, and two levels for each. The first is a byte, the
term's impact in units of STEP, rounded up; the second is exact, the times that the term occurs. With c the times a term is
in a query and w its weight, STEP * sum(c * w * byte) is no less than a document's score, and STEP * sum(c * w * (byte - 1))
no more.

A search reads the index twice. First, from bytes alone, the lower bounds: the kth largest of a query is its bar. Then all
documents whose upper bound reaches the bar are scored exactly in integers, from the second level, and the best stay.
Nothing is dropped by a bound that could have been among the k best. Each task answers for its own rows with at most k rows
a query, so what is shuffled does not grow with the lists of common terms, and no list of a term is in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, small_batches
from tessera.llm.textkit import text_buffer, word_hashes

#: Parts of a score's term factor: SCALE * tf div (TF_PART * tf + LENGTH_PART * m), m = LEAST_M + FULL_M * n * N div L.
SCALE, TF_PART, LENGTH_PART, FULL_M, LEAST_M = 1_000_000_000, 1000, 8, 75, 25
#: What one unit of a byte impact stands for: a term factor is below SCALE / TF_PART, so 245 units at most.
STEP = 4096
#: Terms of queries, with repeats over queries, that go to the tasks at once: 20 bytes each. More queries are searched in turns.
QUERY_BLOCK = 1 << 20
#: Query and document pairs that a task scores at a time, and postings of these documents.
PAIRS, POSTINGS = 1 << 21, 1 << 15
#: Groups in which the tasks' best rows of a query meet before all of them do.
MEETINGS = 64

_TERM = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_lo:_hi] = np.arange(_lo, _hi)
_TERM[0x41:0x5B] += 0x20


def term_hashes(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the hashes of its terms in order: runs of ASCII letters and digits and of all that isn't ASCII, A-Z as a-z."""
    raw, at = text_buffer(column)
    yield from word_hashes(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_TERM[raw])), lower=False)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(documents with a term, their terms) of each batch."""
    for batch in batches:
        raw, at = text_buffer(batch.column(0))
        inside = _TERM[raw] != 0x20
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = at[:-1][at[:-1] < at[1:]]
        first[starts] = inside[starts]
        total = np.concatenate(([0], np.cumsum(first)))
        n = total[at[1:]] - total[at[:-1]]
        yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The exact term factors of terms that occur tf times in documents of n terms."""
    m = LEAST_M + (FULL_M * n * docs) // terms
    return (SCALE * tf) // (TF_PART * tf + LENGTH_PART * m)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _index_rows(batches: Iterator[pa.RecordBatch], docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, found, times = [], [], [], []
        for id_, all_ in zip(batch.column(0).to_pylist(), term_hashes(batch.column(1)), strict=True):
            if not len(all_):
                continue
            distinct, tf = np.unique(all_.view(np.int64), return_counts=True)
            ids.append(id_)
            sizes.append(len(all_))
            found.append(distinct)
            times.append(tf)
        if not ids:
            continue
        lengths = np.array([len(x) for x in found])
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        tf, n = np.concatenate(times).astype(np.int64), np.repeat(np.array(sizes, np.int64), lengths)
        units = (-(-impacts(tf, n, docs, terms) // STEP)).astype(np.uint8)
        packed = [units[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(np.concatenate(found), offsets), pa.array(packed, pa.binary()), _lists(tf.astype(np.int32), offsets)], names=["id", "n", "terms", "units", "tf"])


@dataclass
class Index:
    """rows (id, n, terms, units, tf) of documents with a term, frequencies (term, df), and how many documents and terms there are."""

    rows: DataFrame
    frequencies: DataFrame
    docs: int
    terms: int


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of whole texts. A null text and one without a term take no part; rows count apart, whatever ids repeat or are null."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "index")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n_docs, n_terms = texts.select("text").mapInArrow(_count_terms, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0
    rows = texts.mapInArrow(lambda b: _index_rows(b, n_docs, n_terms), "id long, n long, terms array<long>, units binary, tf array<int>")
    rows = scratch.keep(rows, "rows", "zstd")
    frequencies = scratch.keep(rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    return Index(rows, frequencies, n_docs, n_terms)


def _query_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for id_, found in zip(batch.column(0).to_pylist(), term_hashes(batch.column(1)), strict=True):
            distinct, times = np.unique(found.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([id_] * len(distinct), pa.int64()), pa.array(distinct), pa.array(times)], names=["query", "term", "times"])


def query_terms(queries: DataFrame, index: Index, *, id_col: str, text_col: str) -> DataFrame:
    """(query, term, weight): weights times repeats of the terms that some document has and that weigh something."""
    asked = queries.select(F.col(id_col).cast("long").alias("query"), F.col(text_col).alias("text")).where("query is not null")
    made = asked.mapInArrow(_query_rows, "query long, term long, times long").groupBy("query", "term").agg(F.sum("times").alias("times"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))).cast("long")
    return made.join(index.frequencies, "term").select("query", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")


@dataclass
class _Asked:
    """Queries of one turn: their ids, all terms in order, and for each term the queries that hold it, with weights."""

    ids: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    weight: np.ndarray


def _asked(rows: pa.Table) -> _Asked:
    term, query, weight = (rows.column(c).to_numpy() for c in ("term", "query", "weight"))
    order = np.argsort(term, kind="stable")
    terms, starts = np.unique(term[order], return_index=True)
    ids, at = np.unique(query[order], return_inverse=True)
    return _Asked(ids, terms, np.append(starts, len(term)), at, weight[order])


def _matches(asked: _Asked, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the term lists of documents: posting, document and query of all meetings of a document's term and a query's."""
    flat = terms.flatten().to_numpy()
    doc = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    at = np.minimum(np.searchsorted(asked.terms, flat), max(len(asked.terms) - 1, 0))
    posting = np.flatnonzero(asked.terms[at] == flat) if len(asked.terms) else np.zeros(0, np.int64)
    lo, hi = asked.starts[at[posting]], asked.starts[at[posting] + 1]
    posting = np.repeat(posting, hi - lo)
    slot = np.arange(len(posting)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    return posting, doc[posting], slot


def _bounds(asked: _Asked, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Upper and lower bounds of all documents of a batch (rows) for all queries, and the meetings they come from."""
    posting, doc, slot = _matches(asked, batch.column(1))
    units = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8)
    n, m = batch.num_rows, len(asked.ids)
    cell, weight = doc * m + asked.query[slot], asked.weight[slot].astype(np.float64)
    # Sums of integers below 2 ** 53 in doubles are exact.
    upper = STEP * np.bincount(cell, weight * units[posting], n * m).reshape(n, m)
    lower = upper - STEP * np.bincount(cell, weight, n * m).reshape(n, m)
    return upper, lower, posting, cell, slot


def _parts(batch: pa.RecordBatch, asked: _Asked) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most PAIRS cells and, beyond one document, POSTINGS postings."""
    ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
    step, k = max(1, PAIRS // max(1, len(asked.ids))), 0
    while k < batch.num_rows:
        room = int(np.searchsorted(ends, (ends[k - 1] if k else 0) + POSTINGS, "right"))
        to = max(k + 1, min(k + step, room))
        yield batch.slice(k, to - k)
        k = to


def _lower_bounds(batches: Iterator[pa.RecordBatch], asked: _Asked, k: int) -> Iterator[pa.RecordBatch]:
    """The k largest lower bounds above 0 of each query among this task's documents."""
    best = np.zeros((0, len(asked.ids)))
    for batch in batches:
        for part in _parts(batch, asked):
            best = np.concatenate((best, _bounds(asked, part)[1]))
            if len(best) > k:
                best = np.partition(best, len(best) - k, axis=0)[-k:]
    row, query = np.nonzero(best > 0)
    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[query]), pa.array(best[row, query].astype(np.int64))], names=["query", "lower"])


def _exact(batches: Iterator[pa.RecordBatch], asked: _Asked, bars: np.ndarray, k: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
    """The k best (query, id, score) of each query among this task's documents, of all whose upper bound reaches the bar."""
    held: list[tuple[np.ndarray, ...]] = []
    n_held = 0
    for batch in batches:
        for part in _parts(batch, asked):
            upper, _, posting, cell, slot = _bounds(asked, part)
            reach = ((upper >= bars) & (upper > 0)).ravel()
            use = np.flatnonzero(reach[cell])
            if not len(use):
                continue
            posting, cell, slot = posting[use], cell[use], slot[use]
            tf = part.column(4).flatten().to_numpy().astype(np.int64)[posting]
            n = part.column(3).to_numpy()[cell // len(asked.ids)]
            cells, at = np.unique(cell, return_inverse=True)
            score = np.zeros(len(cells), np.int64)
            np.add.at(score, at, asked.weight[slot] * impacts(tf, n, docs, terms))
            held.append((cells % len(asked.ids), part.column(0).fill_null(0).to_numpy()[cells // len(asked.ids)], np.asarray(part.column(0).is_null())[cells // len(asked.ids)], score))
            n_held += len(cells)
            if n_held > 1 << 20:
                held = [_best(held, k)]
                n_held = len(held[0][0])
    if held:
        query, id_, no_id, score = _best(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[query]), pa.array(id_, mask=no_id), pa.array(score)], names=["query", "id", "score"])


def _best(held: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    query, id_, no_id, score = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((id_, no_id, -score, query))
    order = order[score[order] > 0]
    query = query[order]
    new = np.concatenate(([True], query[1:] != query[:-1])) if len(query) else np.zeros(0, bool)
    rank = np.arange(len(query)) - np.maximum.accumulate(np.where(new, np.arange(len(query)), 0))
    order = order[rank < k]
    return tuple(c[order] for c in (np.concatenate(x) for x in zip(*held, strict=True)))


def _top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each query, with their rank; the rows of many tasks meet in groups first."""
    first = Window.partitionBy("query", "meeting").orderBy(*order)
    some = rows.withColumn("meeting", F.pmod(F.spark_partition_id(), F.lit(MEETINGS))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).drop("meeting")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def _turns(asked: DataFrame, most: int) -> Iterator[DataFrame]:
    """The terms of queries in turns of about `most` rows; queries fall into turns by a hash of their id."""
    total = asked.count()
    turns = max(1, math.ceil(total / most))
    for k in range(turns):
        yield asked if turns == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(turns)) == k)


def search(spark: SparkSession, index: Index, queries: DataFrame, *, k: int = 10, id_col: str = "item_id", text_col: str = "text", most: int = QUERY_BLOCK) -> DataFrame:
    """The k documents of highest score for each query: (query, rank, id, score); scores above 0, ties by id, null ids last.

    Queries of one id are one query. A query without an id, text or term that a document has gets no rows, nor does any from
    an empty index. `most` bounds the rows of terms that the driver and each task hold at a time.
    """
    scratch = Scratch(spark, "search")
    asked_rows = scratch.keep(query_terms(queries, index, id_col=id_col, text_col=text_col), "asked")
    found = None
    for turn, rows in enumerate(_turns(asked_rows, most)):
        asked = _asked(rows.toArrow())
        if not len(asked.ids):
            continue
        sent = spark.sparkContext.broadcast(asked)
        level_one = index.rows.select("id", "terms", "units")
        lower = level_one.mapInArrow(lambda b, s=sent: _lower_bounds(b, s.value, k), "query long, lower long")
        kth = _top(lower, k, F.desc("lower")).where(F.col("rank") == k).select("query", "lower").toArrow()
        bars = np.zeros(len(asked.ids))
        bars[np.searchsorted(asked.ids, kth.column("query").to_numpy())] = kth.column("lower").to_numpy()
        level_two = index.rows.select("id", "terms", "units", "n", "tf")
        docs, terms = index.docs, index.terms
        scored = level_two.mapInArrow(lambda b, s=sent, bar=bars: _exact(b, s.value, bar, k, docs, terms), "query long, id long, score long")
        best = _top(scored, k, F.desc("score"), F.asc_nulls_last("id"))
        best = scratch.keep(best.select("query", "rank", "id", "score"), f"best-{turn}")
        found = best if found is None else found.union(best)
    return found if found is not None else spark.createDataFrame([], "query long, rank int, id long, score long")
