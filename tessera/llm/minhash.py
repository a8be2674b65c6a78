"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct word shingles. Its signature has CHUNKS * CHUNK_SYMBOLS symbols of 16 bits, each the
low bits of one minimum: two documents differ in a symbol with a chance of about one minus their Jaccard similarity.

1. Documents of one set become one node. A node's signature is cut into chunks. If two signatures differ in at most
   DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1 symbols, some chunk differs in at most CHUNK_ERRORS of them (pigeonhole). The
   errors that a chunk may have are enumerated: for each choice of CHUNK_ERRORS places, the chunk without those places is a
   key, so two such chunks share the key that leaves their differences out. Every pair within DISTANCE shares a key.
2. Keys that several nodes hold are lists. Rounds of stars first: the members of a list are verified against one pivot, and
   links merge, so a group of copies costs one pair for each copy.
3. Then lists that still hold several components are searched for links between them: pairs whose whole signatures are
   within DISTANCE, each in the first list that the two share, are compared by their shingles' 32-bit hashes. What can be
   a link goes on, unless sure links of the list join the two already, so a list gives few more pairs than it has
   components. Long lists are cut into blocks, every two of which meet once.
4. All links of both steps are verified on whole sets.

What may be missed is a link whose signatures differ in more than DISTANCE symbols: at a similarity of just 0.85 the chance
is about 2 in 100,000 for a pair (binomial tail of 50 symbols), less above, and only if no other links join the two.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.jaccard import _node, _sets, _Verifier
from tessera.llm.scratch import Scratch, small_batches
from tessera.llm.textkit import mix

#: Chunks of a signature, symbols in each, and differing symbols that a matching chunk may have.
CHUNKS, CHUNK_SYMBOLS, CHUNK_ERRORS = 10, 5, 1
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
#: Differing symbols up to which every pair of signatures is found.
DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
STAR_ROUNDS = 2
#: By how much short hashes may mistake the size of an intersection: two hashes that fall together, far more than is likely.
SLACK = 4
#: Members of a list that one task pairs with as many others, and those that it compares with a pivot, about.
LIST_BLOCK, GROUP_BLOCK = 4096, 1024
#: Shingles whose hashes are made at a time.
_STEP = 4096

_LEFT_OUT = list(itertools.combinations(range(CHUNK_SYMBOLS), CHUNK_ERRORS))
KEYS = CHUNKS * len(_LEFT_OUT)


def _multipliers() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_FACTORS = _multipliers()


def _first_keys() -> np.ndarray:
    """For each set of differing places of a chunk, as bits, the first choice of places that covers it, or -1."""
    out = np.full(1 << CHUNK_SYMBOLS, -1, np.int64)
    for bits in range(1 << CHUNK_SYMBOLS):
        differing = {k for k in range(CHUNK_SYMBOLS) if bits >> k & 1}
        out[bits] = next((k for k, places in enumerate(_LEFT_OUT) if differing <= set(places)), -1)
    return out


_FIRST_KEY = _first_keys()


def signature(found: np.ndarray) -> np.ndarray:
    """The symbols of a set of shingle hashes, which is not empty."""
    least = None
    with np.errstate(over="ignore"):
        for k in range(0, len(found), _STEP):
            part = (found[k : k + _STEP, None] * _FACTORS).min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """The KEYS keys of each signature: for each chunk, one for each choice of places left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, CHUNK_SYMBOLS).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, len(_LEFT_OUT)), np.uint64)
    with np.errstate(over="ignore"):
        for k, places in enumerate(_LEFT_OUT):
            h = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(len(_LEFT_OUT)) + np.uint64(k + 1))[None, :]
            for j in range(CHUNK_SYMBOLS):
                if j not in places:
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + chunks[:, :, j])
            out[:, :, k] = h
    return out.reshape(len(signatures), KEYS)


def first_shared_key(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of signatures x and y: how many symbols differ, and the number of the first key that both have, or -1."""
    differ = (x != y).reshape(len(x), CHUNKS, CHUNK_SYMBOLS)
    choice = _FIRST_KEY[differ @ (1 << np.arange(CHUNK_SYMBOLS))]
    chunk = np.argmax(choice >= 0, axis=1)
    at = np.arange(len(x))
    return differ.sum(axis=(1, 2)), np.where(choice[at, chunk] >= 0, chunk * len(_LEFT_OUT) + choice[at, chunk], -1)


_SCAN_NAMES = ["id", "node", "n", "signature", "keys"]


def _scan(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, node, n, signature, keys) of documents; the last two are null where there are no words."""
    for batch in batches:
        nodes, sizes, made = [], [], []
        for found in _sets(batch.column(1), width):
            nodes.append(_node(found) if len(found) else 0)
            sizes.append(len(found))
            if len(found):
                made.append(signature(found))
        table = np.array(made, np.uint16).reshape(-1, SYMBOLS)
        some = np.array(sizes) > 0
        lists = [_filled(table.view(np.int16), some), _filled(keys_of(table).view(np.int64), some)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *lists], names=_SCAN_NAMES)


def _filled(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """Lists of equal length from rows, one for each place where some is true, else null."""
    offsets = np.concatenate(([0], np.cumsum(some * rows.shape[1])))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rows.ravel()), mask=pa.array(~some))


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows that agree in the first n_keys columns; rows come sorted by these."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [_array(c) for c in batch.columns]
        keys = columns[:n_keys]
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        if held and any(old[0] != key[0] for old, key in zip(held[0][:n_keys], keys, strict=True)):
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(cuts):
            if lo and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([c[lo:hi] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _array(column: pa.Array) -> np.ndarray:
    """Numbers as they are, and short hashes as an array of arrays; signatures come as rows of symbols."""
    if pa.types.is_fixed_size_binary(column.type) or pa.types.is_binary(column.type):
        return np.array([np.frombuffer(x, np.uint32) for x in column.to_pylist()] + [None], object)[:-1]
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy().view(np.uint16).reshape(-1, SYMBOLS)
    return column.to_numpy(zero_copy_only=False)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, short): sets as sorted 32-bit hashes."""
    for batch in batches:
        made = [np.unique(np.asarray(x, np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for x in batch.column(1).to_numpy(zero_copy_only=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "short"])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Values that two sorted arrays share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))


class _Joined:
    """Which components are joined by what was found so far."""

    def __init__(self) -> None:
        self.of: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.of.get(x, x)) != x:
            self.of[x] = self.of.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        self.of[self.find(x)] = self.find(y)


def _pairs(batches: Iterator[pa.RecordBatch], percent: int, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows (key, low, high, slot, side, id, comp, n, signature, short) in order of the first three; pairs (a, b) out.

    Holds one list's rows, which are few (LIST_BLOCK from each side), and about `most` pairs.
    """
    out: list[np.ndarray] = []
    held = 0
    for _, _, _, slot, side, id_, comp, n, symbols, short in _runs(batches, 3):
        order = np.argsort(n, kind="stable")
        slot, side, id_, comp, n, symbols, short = (c[order] for c in (slot, side, id_, comp, n, symbols, short))
        joined = _Joined()
        for i in range(0, len(id_), 128):
            a = slice(i, i + 128)
            to = int(np.searchsorted(n, 100 * n[a][-1] // percent, "right"))
            if to <= i + 1:
                continue
            b = slice(i, to)
            ok = (comp[a][:, None] != comp[b][None, :]) & (percent * n[b][None, :] <= 100 * n[a][:, None])
            ok &= np.arange(to - i)[None, :] > np.arange(len(n[a]))[:, None]
            # Sides 0 and 1 meet each other; side 2 is a block with itself.
            ok &= (side[a][:, None] == 2) | (side[a][:, None] != side[b][None, :])
            x, y = np.nonzero(ok)
            for k in range(0, len(x), 1 << 16):
                u, v = i + x[k : k + (1 << 16)], i + y[k : k + (1 << 16)]
                apart, first = first_shared_key(symbols[u], symbols[v])
                hit = (apart <= DISTANCE) & (first == slot[u])
                found = []
                for p, q in zip(u[hit].tolist(), v[hit].tolist(), strict=True):
                    c, d = int(comp[p]), int(comp[q])
                    if joined.find(c) == joined.find(d):
                        continue
                    need = -(-percent * int(n[p] + n[q]) // (100 + percent))
                    shared = _shared(short[p], short[q])
                    if shared + SLACK >= need:
                        found.append((id_[p], id_[q]))
                        if shared - SLACK >= need:
                            joined.join(c, d)
                if found:
                    out.append(np.sort(np.array(found, np.int64).T, axis=0))
                    held += len(found)
            if held > most:
                yield _pair_batch(out)
                out, held = [], 0
    if out:
        yield _pair_batch(out)


def _pair_batch(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, list_block: int = LIST_BLOCK, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """One row (doc_id, n_shingles, component_id, kept) per row of docs; component_id is the smallest id reachable by links.

    Links need 100 * intersection >= percent * union of the sets of width-word shingles (A-Z lower-cased, words split at
    ASCII white space; a shorter text is one shingle). A null or wordless text has an empty set, links with nothing and is
    kept. Rows with one id count as one document: each text of it may link. A row with a null id gets the class of rows
    with its very set, or null, makes no links itself, and is kept only if that class is null. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scan = scratch.keep(texts.mapInArrow(lambda b: _scan(b, width), "id long, node long, n long, signature array<short>, keys array<long>"), "scan")
    rows = scan.select("id", "node", "n")
    nodes = scratch.keep(rows.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("n").alias("n")), "nodes")

    # The index: lists of the nodes that hold a key, where there are several.
    chosen = scan.drop("n").join(nodes, ["node", "id"])
    postings = chosen.select("id", "n", F.posexplode("keys").alias("slot", "key"))
    held = postings.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    lists = scratch.keep(postings.join(held, "key"), "lists")
    signatures = chosen.select("id", "signature").join(lists.select("id").distinct(), "id", "left_semi")
    signatures = scratch.keep(signatures, "signatures")

    verifier = _Verifier(texts, scratch, width, percent)
    sets = verifier.sets(lists.select("id"), "star")
    popular = lists.groupBy("id").agg(F.sum("members").alias("popular"))
    parts = F.ceil(F.col("members") / GROUP_BLOCK)
    votes = scratch.keep(lists.join(popular, "id").select("key", "id", "n", "popular", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("part")), "voters")
    labels, links = None, None
    for k in range(star_rounds):
        if labels is None:
            named = votes.withColumn("comp", F.col("id"))
        else:
            named = scratch.keep(votes.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component"), f"named-{k}")
        # The member that most others agree with first: what a group was copied from is close to it. Then others by chance.
        turn = F.struct((F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)) if k else F.lit(0).cast("long")).alias("turn"), (-F.col("popular")).alias("first"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("comp").alias("pivot_comp"))
        # A list of one component needs no more pairs.
        pivots = named.groupBy("key").agg(F.min(turn).alias("p"), F.first("parts").alias("parts"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        pivots = pivots.select("key", "p.*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        tried = named.drop("parts").join(pivots, ["key", "part"]).where(f"comp <> pivot_comp and least(n, pivot_n) * 100L >= {percent}L * greatest(n, pivot_n)")
        pairs = tried.groupBy(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).count().select("a", "b")
        found = scratch.keep(verifier.links(pairs, sets), f"star-links-{k}")
        links = found if links is None else links.union(found)
        labels = components(links, scratch, f"star-{k}")
        scratch.drop(f"named-{k}")
        scratch.release()

    # What is left: links between the components of one list.
    named = scratch.keep(lists.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component") if labels is not None else lists.withColumn("comp", F.col("id")), "named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    named = scratch.keep(named.join(mixed, "key"), "mixed")
    short = sets.join(named.select("id").distinct(), "id", "left_semi").select("id", "grams").mapInArrow(_short, "id long, short binary")
    blocks = F.ceil(F.col("members") / list_block)
    dealt = named.join(signatures.join(short, "id"), "id").withColumn("own", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).otherwise((F.col("own") > F.col("other")).cast("int"))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "slot", side.alias("side"), "id", "comp", "n", "signature", "short")
    pairs = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(lambda b: _pairs(b, percent), "a long, b long")
    pairs = scratch.keep(pairs.distinct(), "pairs")
    last = verifier.links(pairs, sets)
    labels = components(last if links is None else links.union(last), scratch, "all")
    for name in ("star-sets", "named", "mixed", "lists", "voters"):
        scratch.drop(name)

    classes = nodes.join(labels, "id", "left").select("node", F.coalesce("component", "id").alias("component_id"))
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("id") == component, component.isNull())
    return rows.join(classes, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
