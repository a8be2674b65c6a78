"""N-gram Jaccard join with adaptive multi-match prefixes: near-duplicate classes of documents.

A document is the set of its distinct word shingles. Two documents link when their Jaccard similarity reaches the
threshold. The join is exact (up to collisions of 64-bit hashes); only its order of work is heuristic:

1. Every document is hashed to its shingle set; documents with one set become one node.
2. A fixed-size sketch counts all shingles of the corpus. Shingles are ordered rare first (sketch level, then hash).
3. Adaptive prefixes. A pair that links shares at least `alpha = ceil(t * n)` shingles, so the first
   `n - alpha + l` shingles of both share at least `l`. Each document takes the `l` of least estimated cost: postings it
   sends plus candidates it draws (the sketch counts of its prefix, over `l` by Markov's inequality). A pair is verified
   if it shares `min(l_x, l_y)` prefix shingles at positions that still allow the overlap.
4. Rounds of stars first: nodes that agree in a smallest shingle are verified against one pivot of that group, and the
   links merge. What one component holds needs no further pairs, so groups of copies cost one pair for each copy.
5. Postings then make pairs only between different components; all pairs are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.scratch import Scratch, small_batches
from tessera.llm.textkit import mix, shingles, word_hashes

#: Shingle counters of the corpus sketch are 2 ** this; the driver and each task hold four bytes of each.
SKETCH_BITS = 22
#: Counters to a row of a shuffled sketch.
SKETCH_BLOCK = 1 << 15
#: Smallest shingles by which nodes choose pivots.
BOTTOM = 8
STAR_ROUNDS = 4
#: Longest multi-match requirement that a document may choose, and shingles it needs for each step above one: a longer
#: requirement blunts the positional filter, which has to allow for as many matches.
MAX_LEVEL, LEVEL_SHINGLES = 16, 50
#: Partners that a shingle has on average where the sketch shows nothing: passages shared by a few documents.
USUAL_PARTNERS = 0.05
#: Cost of verifying a candidate, in postings, besides a part by its size.
VERIFY_COST = 4.0
#: The largest filter of ids that may be broadcast, in bits (32 MB).
FILTER_BITS = 28
#: Postings of one shingle that one task pairs with as many others at most, about: longer lists are cut into blocks and
#: each pair of blocks is a list of its own. Members of a star group that one task compares with the pivot, about.
LIST_BLOCK, GROUP_BLOCK = 4096, 1024


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    for words in word_hashes(column, lower=True):
        yield np.unique(shingles(words, width))


def _node(found: np.ndarray) -> int:
    """A 64-bit key of a whole set."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(found).sum() + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _scan(batches: Iterator[pa.RecordBatch], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, node, n, m0..) of documents, then this task's sketch as rows (block, counts)."""
    sketch, pending, held = np.zeros(1 << bits, np.uint32), [], 0
    mask = np.uint64((1 << bits) - 1)

    def flush() -> None:
        nonlocal held
        if pending:
            np.add(sketch, np.bincount((np.concatenate(pending) & mask).astype(np.int64), minlength=1 << bits).astype(np.uint32), out=sketch)
            pending.clear()
            held = 0

    for batch in batches:
        nodes, sizes, mins = [], [], []
        for found in _sets(batch.column(1), width):
            nodes.append(_node(found) if len(found) else 0)
            sizes.append(len(found))
            mins.append(np.resize(found[:BOTTOM], BOTTOM).view(np.int64) if len(found) else np.zeros(BOTTOM, np.int64))
            pending.append(found)
            held += len(found)
            if held > 1 << 21:
                flush()
        table = np.array(mins, np.int64).reshape(-1, BOTTOM)
        none = pa.nulls(len(nodes))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(table[:, j]) for j in range(BOTTOM)), none.cast(pa.int32()), none.cast(pa.binary())], names=_SCAN_NAMES)
    flush()
    for block in range(0, 1 << bits, SKETCH_BLOCK):
        part = sketch[block : block + SKETCH_BLOCK]
        if part.any():
            packed = pa.compress(part.tobytes(), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * (3 + BOTTOM) + [pa.array([block // SKETCH_BLOCK], pa.int32()), pa.array([packed], pa.binary())], names=_SCAN_NAMES)


_SCAN_NAMES = ["id", "node", "n", *(f"m{j}" for j in range(BOTTOM)), "block", "counts"]
_SCAN_SCHEMA = "id long, node long, n long, " + ", ".join(f"m{j} long" for j in range(BOTTOM)) + ", block int, counts binary"


def _unpack(packed: bytes, bits: int, kind: type = np.uint32) -> np.ndarray:
    size = np.dtype(kind).itemsize * min(SKETCH_BLOCK, 1 << bits)
    return np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True), kind)


def _sum_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = _unpack(packed, bits).astype(np.uint64)  # one task's counts fit 32 bits, those of all may not
            total[block] = total[block] + part if block in total else part
    for block, part in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["block", "counts"])


def sketch_levels(spark: SparkSession, scan: DataFrame, bits: int) -> np.ndarray:
    """For each counter 0 if its count is what chance gives, else about twice the logarithm of what is above that.

    The driver gets the summed counters only: four bytes for each, whatever the size of the corpus.
    """
    rows = scan.where("block is not null").select("block", "counts").repartition(F.col("block")).mapInArrow(lambda b: _sum_blocks(b, bits), "block int, counts binary")
    counts = np.zeros(1 << bits, np.int64)
    for row in rows.collect():
        part = _unpack(bytes(row["counts"]), bits, np.uint64).astype(np.int64)
        counts[row["block"] * SKETCH_BLOCK :][: len(part)] += part
    usual = float(np.median(counts))
    above = counts - (usual + 6 * np.sqrt(usual + 1) + 8)
    return np.where(above > 0, np.clip(np.round(2 * np.log2(np.maximum(counts - usual, 1))), 1, 255), 0).astype(np.uint8)


def choose_level(estimates: np.ndarray, base: int, size: int) -> int:
    """The l of least cost, when estimates are the likely partners of each shingle in order and base is the prefix for l = 1."""
    top = min(MAX_LEVEL, 1 + size // LEVEL_SHINGLES, size - base + 1)
    at = np.arange(1, top + 1)
    drawn = np.cumsum(estimates)[base - 1 : base - 1 + top] / at
    return int(np.argmin(base + at - 1 + drawn * (VERIFY_COST + size / 64))) + 1


def deal_long_lists(prefix: np.ndarray, blocks: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of a document's postings when lists of several blocks are cut: one list for each pair of blocks.

    The document is in one block of each list, so it goes to as many lists as there are blocks. A place is four times the
    position in the prefix, plus 2 in lists of one block, where all pair, or the side, 0 or 1, in lists of two blocks, where
    only documents of different sides pair: every two documents meet exactly once for each shingle they share.
    """
    keys, places = [prefix[blocks == 1]], [np.flatnonzero(blocks == 1) * 4 + 2]
    for pos in np.flatnonzero(blocks > 1):
        n = int(blocks[pos])
        other = np.arange(n, dtype=np.uint64)
        own = mix(np.array([doc], np.int64).view(np.uint64))[0] % np.uint64(n)
        low, high = np.minimum(other, own), np.maximum(other, own)
        with np.errstate(over="ignore"):
            keys.append(mix(prefix[pos] + mix(low * np.uint64(n) + high + np.uint64(1))))
        places.append(pos * 4 + np.where(other == own, 2, other < own))
    return np.concatenate(keys), np.concatenate(places)


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, percent: int, levels, bits: int, block: int) -> Iterator[pa.RecordBatch]:
    """(id, n, ell, prefix, places); places is null where the prefix holds no shingle of a long list: then position is place."""
    table, mask = levels.value, np.uint64((1 << bits) - 1)
    # No shingle has more partners than 64-bit ids tell apart.
    partners = np.where(np.arange(256) > 0, 2.0 ** (np.minimum(np.arange(256), 124) / 2), USUAL_PARTNERS)
    # The sketch never counts less than a list holds; a level rounds by a factor of up to the fourth root of two.
    lists = np.maximum(1, np.ceil(partners * 1.2 / block)).astype(np.int64)
    for batch in batches:
        ids, sizes, ells, runs, places = [], [], [], [], []
        for doc, found in zip(batch.column(0).to_pylist(), _sets(batch.column(1), width), strict=True):
            n = len(found)
            if not n or doc is None:
                continue
            level = table[(found & mask).astype(np.int64)]
            base = n - (percent * n + 99) // 100 + 1
            if level.any():
                order = np.argsort(level, kind="stable")
                found, level = found[order], level[order]
            ell = choose_level(partners[level[: base + MAX_LEVEL]], base, n)
            ids.append(doc)
            sizes.append(n)
            ells.append(ell)
            run, own = found[: base + ell - 1], None
            blocks = lists[level[: len(run)]]
            if (blocks > 1).any():
                run, own = deal_long_lists(run, blocks, doc)
            runs.append(run.view(np.int64))
            places.append(own)
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
        prefix = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ells, pa.int32()), prefix, pa.array(places, pa.list_(pa.int32()))], names=["id", "n", "ell", "prefix", "places"])


def _run_pairs(id_, comp, n, rest, ell, side, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of one posting list between different components that length and position allow."""
    order = np.argsort(n, kind="stable")
    id_, comp, n, rest, ell, side = id_[order], comp[order], n[order], rest[order], ell[order], side[order]
    for i in range(0, len(id_), 256):
        a = slice(i, i + 256)
        to = int(np.searchsorted(n, 100 * n[a][-1] // percent, "right"))
        if to <= i + 1:
            continue
        b = slice(i, to)
        least = np.minimum(ell[a][:, None], ell[b][None, :])
        both = n[a][:, None] + n[b][None, :]
        need = (percent * both + 99 + percent) // (100 + percent)
        ok = (comp[a][:, None] != comp[b][None, :]) & (percent * n[b][None, :] <= 100 * n[a][:, None]) & (least + np.minimum(rest[a][:, None], rest[b][None, :]) >= need)
        ok &= np.arange(to - i)[None, :] > np.arange(len(n[a]))[:, None]
        if side[i] != 2:
            ok &= side[a][:, None] != side[b][None, :]
        x, y = np.nonzero(ok)
        if len(x):
            yield id_[a][x], id_[b][y], least[x, y]


def _pairs(batches: Iterator[pa.RecordBatch], percent: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Postings sorted by shingle in, candidate pairs out: one row for each shared shingle.

    Holds the postings of one list, which are few (see LIST_BLOCK), and about `most` pairs.
    """
    open_: list[list[np.ndarray]] = []
    out: list[tuple[np.ndarray, ...]] = []
    held = 0

    def emit() -> pa.RecordBatch:
        nonlocal held
        a, b, ell = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        held = 0
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(ell.astype(np.int32))], names=["a", "b", "ell"])

    def pairs_of(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        nonlocal held
        s = columns[0]
        cut = np.flatnonzero(s[1:] != s[:-1]) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(s)]))
        for k in np.flatnonzero(ends - starts > 1):
            for found in _run_pairs(*(c[starts[k] : ends[k]] for c in columns[1:]), percent):
                out.append(found)
                held += len(found[0])
                if held > most:
                    yield emit()

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
        if not len(columns[0]):
            continue
        # The batch's last list stays open.
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if last or open_ and open_[0][0][0] != columns[0][0]:
            parts = [*open_, [c[:last] for c in columns]]
            yield from pairs_of([np.concatenate(x) for x in zip(*parts, strict=True)])
            open_ = []
        open_.append([c[last:] for c in columns])
    if open_:
        yield from pairs_of([np.concatenate(x) for x in zip(*open_, strict=True)])
    if out:
        yield emit()


class _Verifier:
    """Exact similarity of pairs of documents, on sets made anew from the texts of those documents alone."""

    def __init__(self, texts: DataFrame, scratch: Scratch, width: int, percent: int):
        self.texts, self.scratch, self.width, self.percent = texts, scratch, width, percent

    def _filter(self, ids: DataFrame, bits: int) -> np.ndarray:
        at = F.pmod(F.xxhash64("id"), F.lit(1 << bits)) + 1
        rows = ids.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
        out = np.zeros(1 << max(0, bits - 3), np.uint8)
        for row in rows:
            part = np.frombuffer(bytes(row["bits"]), np.uint8)
            room = out[(row["bucket"] - 1) * len(part) :][: len(part)]
            room[:] = part[: len(room)]
        return out

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """(id, grams) of the documents in ids (one column, id).

        A bitmap of the ids, of at most FILTER_BITS bits, goes to the scan, so that few other texts are hashed; the joins with pairs sort those out.
        """
        ids = self.scratch.keep(ids.distinct(), f"{name}-ids")
        bits = min(FILTER_BITS, max(15, int(ids.count() * 16).bit_length()))
        known = ids.sparkSession.sparkContext.broadcast(self._filter(ids, bits))
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((known.value[at >> 3] >> (at & 7) & 1).astype(bool)))
                if not batch.num_rows:
                    continue
                found = [s.view(np.int64) for s in _sets(batch.column(1), width)]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in found]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], names=["id", "grams"])

        at = F.pmod(F.xxhash64("id"), F.lit(1 << bits)).alias("at")
        made = self.texts.where("id is not null").select("id", "text", at).mapInArrow(cut, "id long, grams array<long>")
        return self.scratch.keep(made, f"{name}-sets")

    def links(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) that reach the threshold."""
        left, right = sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).alias("total"))
        return both.where(f"shared * {100 + self.percent}L >= {self.percent}L * total").select("a", "b")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5, sketch_bits: int = SKETCH_BITS, list_block: int = LIST_BLOCK) -> DataFrame:
    """One row (doc_id, n_shingles, component_id) per row of docs; component_id is the smallest id reachable by links.

    Links need 100 * intersection >= percent * union of the sets of width-word shingles (A-Z lower-cased, words split at
    ASCII white space; a shorter text is one shingle). A null or wordless text has an empty set and links with nothing.
    Rows with one id count as one document: each text of it may link. A row with a null id gets the class of rows with
    its very set, or null, and makes no links itself. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bits = sketch_bits
    scan = scratch.keep(texts.mapInArrow(lambda b: _scan(b, width, bits), _SCAN_SCHEMA), "scan")
    rows = scan.where("block is null")
    levels = spark.sparkContext.broadcast(sketch_levels(spark, scan, bits))

    bottoms = [f"m{j}" for j in range(BOTTOM)]
    nodes = scratch.keep(rows.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n"), *(F.min(m).alias(m) for m in bottoms)), "nodes")
    verifier = _Verifier(texts, scratch, width, percent)

    # Stars: a group agreeing in a smallest shingle is compared with one pivot. Pivots are of those whose smallest shingles
    # most others have, which are close to what the group was copied from; another one each round.
    votes = nodes.select("id", "n", F.explode(F.array_distinct(F.array(*bottoms))).alias("m"))
    shared = votes.groupBy("m").agg(F.count("*").alias("others")).where("others > 1")
    votes = scratch.keep(votes.join(shared, "m"), "votes")
    popular = votes.groupBy("id").agg(F.sum("others").alias("popular"))
    # A group of many members is compared with its pivot in parts.
    parts = F.ceil(F.col("others") / GROUP_BLOCK)
    votes = votes.join(popular, "id").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("others")
    votes = scratch.keep(votes, "voters")
    star_sets = verifier.sets(votes.select("id"), "star")
    links, labels = None, None
    for k in range(STAR_ROUNDS):
        named = votes if labels is None else votes.join(labels, "id", "left")
        named = named.withColumn("comp", F.col("id") if labels is None else F.coalesce("component", "id"))
        turn = F.struct(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1 + 3 * min(k, 1))).alias("turn"), (-F.col("popular")).alias("first"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("comp").alias("pivot_comp"))
        pivots = named.groupBy("m").agg(F.min(turn).alias("p"), F.first("parts").alias("parts")).select("m", "p.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        tried = named.drop("parts").join(pivots, ["m", "part"]).where(f"comp <> pivot_comp and least(n, pivot_n) * 100L >= {percent}L * greatest(n, pivot_n)")
        pairs = tried.groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).count().select("a", "b")
        found = scratch.keep(verifier.links(pairs, star_sets), f"star-links-{k}")
        if k and found.isEmpty():
            break
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"star-{k}")
        scratch.release()

    # What is left: pairs between components that share enough of their prefixes.
    prefixes = texts.mapInArrow(lambda b: _prefixes(b, width, percent, levels, bits, list_block), "id long, n int, ell int, prefix array<long>, places array<int>")
    own = nodes.select("id").join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("comp"))
    postings = prefixes.join(own, "id").select("id", "comp", "n", "ell", "places", F.posexplode("prefix").alias("pos", "s"))
    place = F.coalesce(F.get("places", F.col("pos")), F.col("pos") * 4 + 2)
    postings = postings.select("s", "id", "comp", "n", (F.col("n") - F.shiftright(place, 2) - 1).alias("rest"), "ell", place.bitwiseAND(3).alias("side"))
    pairs = postings.repartition("s").sortWithinPartitions("s").mapInArrow(lambda b: _pairs(b, percent), "a long, b long, ell int")
    pairs = scratch.keep(pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("ell").alias("ell")).where("shared >= ell").select("a", "b"), "pairs")
    scratch.drop("star-sets")
    scratch.release()
    sets = verifier.sets(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "last")
    labels = components(links.union(verifier.links(pairs, sets)), scratch, "all")
    scratch.drop("last-sets")

    classes = nodes.join(labels, "id", "left").select("node", F.coalesce("component", "id").alias("component_id"))
    return rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
