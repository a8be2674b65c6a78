"""Token counts by heap-and-linked-list byte-pair merging; no ids are made."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import small_batches
from tessera.llm.tokens import PIECES, ChunkCache, byte_symbols, plain_byte_level, splittable

class MergeCounter:
    """Counts the tokens of texts under a byte-level BPE vocabulary in a `.json` file."""

    def __init__(self, path: str):
        import regex

        spec = plain_byte_level(path)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        symbols = sorted({s for m in merges for s in (*m, m[0] + m[1])} | set(byte_symbols().values()))
        number = {s: k for k, s in enumerate(symbols)}
        # (left, right) -> (rank, merged), all numbers of symbols
        self.merges = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in reversed(list(enumerate(merges)))}
        self.start = [number[byte_symbols()[b]] for b in range(256)]
        self.specials = tuple(t["content"] for t in spec["added_tokens"])
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.pieces = regex.compile(PIECES)
        self.words = ChunkCache(self.merged)
        self.chunks = ChunkCache(lambda chunk: self.plain(" " + chunk))

    def merged(self, piece: str) -> int:
        """Initial symbols minus merges, popping the adjacent pair of lowest rank, leftmost first."""
        symbol = [self.start[b] for b in piece.encode()]
        n = left_over = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            if found := self.merges.get((symbol[i], symbol[i + 1])):
                heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue  # one side has merged since
            symbol[i], symbol[j] = made, -1
            left_over -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.merges.get((made, symbol[k])):
                    heapq.heappush(heap, (found[0], i, made, symbol[k], found[1]))
            if (h := before[i]) >= 0 and (found := self.merges.get((symbol[h], made))):
                heapq.heappush(heap, (found[0], h, symbol[h], made, found[1]))
        return left_over

    def plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.pieces.findall(text)))

    def count(self, text: str) -> int:
        if splittable(text, self.specials):
            first, *rest = text.split(" ")
            return self.plain(first) + sum(map(self.chunks.__getitem__, rest))
        if not any(s in text for s in self.specials):
            return self.plain(text)
        found = self.split_special.findall(text)
        return len(found) + sum(map(self.plain, self.split_special.split(text)))


_counters: dict[str, MergeCounter] = {}


def token_counts(docs: DataFrame, path: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row's whole text; a null text is empty and has no tokens.

    Rows with one id stay apart; other columns are ignored. One narrow pass, no shuffle; a worker keeps a bounded cache.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = MergeCounter(path)
        counter = _counters[path]
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(map(counter.count, texts), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = texts.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
