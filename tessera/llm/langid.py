"""Word-first language identification with backoff to ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.scratch import Scratch, small_batches

#: A run of more letters than LONGEST_WORD (scripts without blanks) counts as words of so many, in learning and scoring.
LONGEST_WORD = 40
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST_WORD}}}")
#: Longest n-gram for unseen words; words start and end with a blank.
LONGEST = 5
#: Texts to learn from, about: where more are labelled, a hash of the id picks a fraction of each language.
TRAIN_DOCS = 20_000
#: Texts of a language that are learned from at least, about, if it has so many.
TRAIN_LEAST = 200
#: Entries (words and n-grams) of a language that the model holds at most, about: the most frequent ones, ties aside. A
#: language with fewer keeps all of them, also those seen once.
ENTRIES = 250_000
#: Counts from here on are not told apart when the entries to keep are chosen.
_MANY = 1000
#: Words and chunks that a worker remembers.
CACHED = 500_000


def letter_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of the n-grams of distinct words times their words' counts: far fewer than n-grams of the texts."""
    words: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            for n in range(LONGEST + 1):
                found: dict[str, int] = {}
                for word, times in own.items():
                    for gram in grams(word, n) if n else (word,):
                        found[gram] = found.get(gram, 0) + times
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "n", "gram", "count"])
        words.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(letter_words(text))
        if sum(map(len, words.values())) > 300_000:
            yield from rows()
    if words:
        yield from rows()


def entry_key(n: int, gram: str) -> int:
    return xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"), n)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lang, n, count) of rows (lang, n, gram, count)."""
    for batch in batches:
        keys = np.array([entry_key(n, gram) for n, gram in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1), batch.column(3)], names=["key", "lang", "n", "count"])


class Model:
    """Per entry (a word, n = 0, or an n-gram) the log frequency in each language; langs in alphabetical order.

    Only (entry, language) pairs that were seen are held, in arrays sorted by a 64-bit hash of the entry: 16 bytes for each,
    whatever the number of languages. A language in which an entry wasn't seen has that length's floor.
    """

    def __init__(self, entries: pa.Table, totals: list):
        self.langs = sorted({r["lang"] for r in totals})
        at = {lang: j for j, lang in enumerate(self.langs)}
        size = np.ones((LONGEST + 1, len(self.langs)))
        for r in totals:
            size[r["n"], at[r["lang"]]] = r["count"]
        self.floor = (math.log(0.3) - np.log(size)).tolist()
        keys = entries["key"].to_numpy().view(np.uint64)
        seen = entries["lang"].combine_chunks().dictionary_encode() if len(entries) else pa.array([], pa.string()).dictionary_encode()
        lang = np.array([at[x] for x in seen.dictionary.to_pylist()], np.int32)[seen.indices.to_numpy()]
        weight = np.log(np.maximum(entries["count"].to_numpy(), 1)) - np.log(size[entries["n"].to_numpy(), lang])
        order = np.lexsort((lang, keys))
        self.keys, self.lang, self.weight = keys[order], lang[order], weight[order].astype(np.float32)
        # Entries that were looked up, a bounded number, and marks of the hashes there are, made where they are used.
        self.memo: list[dict[str, tuple]] = [{} for _ in range(LONGEST + 1)]
        self.maybe: bytes | None = None

    def entries(self, n: int, parts: list[str]) -> list[tuple]:
        """Of the parts that are known, in order: (language, weight above the floor, language, ...)."""
        if self.maybe is None:
            size = 1 << max(16, (32 * len(self.keys)).bit_length())
            marks = np.zeros(size, np.uint8)
            marks[(self.keys & np.uint64(size - 1)).astype(np.int64)] = 1
            self.maybe, self.mask = marks.tobytes(), size - 1
        memo, maybe, mask, out = self.memo[n], self.maybe, self.mask, []
        for part in parts:
            found = memo.get(part)
            if found is None:
                key = entry_key(n, part)
                if not maybe[key & mask]:
                    continue
                if len(memo) > CACHED:
                    memo.clear()
                at, floor = np.uint64(key), self.floor[n]
                span = slice(self.keys.searchsorted(at), self.keys.searchsorted(at, "right"))
                found = memo[part] = tuple(x for j, w in zip(self.lang[span].tolist(), self.weight[span].tolist(), strict=True) for x in (j, w - floor[j]))
            if found:
                out.append(found)
        return out

    def _sum(self, n: int, known: list[tuple], weight: float) -> list[float]:
        out = [x * len(known) for x in self.floor[n]]
        for entry in known:
            for i in range(0, len(entry), 2):
                out[entry[i]] += entry[i + 1]
        return [x * weight for x in out]

    def posterior(self, word: str) -> list[float]:
        """Log posterior of the languages for one word under even priors, at least about -6 below the best; zeros if nothing in it is known.

        A known word counts by its own frequency; else its n-grams do, of the longest length of which half are known.
        """
        known = self.entries(0, [word])
        found = self._sum(0, known, 1.0) if known else None
        for n in range(min(LONGEST, len(word) + 2), 0, -1):
            if found is not None:
                break
            parts = grams(word, n)
            known = self.entries(n, parts)
            if known and 2 * len(known) >= len(parts):
                found = self._sum(n, known, min(2.0, len(parts) / n) / len(known))
        if found is None:
            return [0.0] * len(self.langs)
        best = max(found)
        found = [max(x - best, -6.0) for x in found]
        total = math.log(sum(map(math.exp, found)))
        return [x - total for x in found]

    def word(self, word: str) -> np.ndarray:
        return np.array(self.posterior(word))


class Identifier:
    def __init__(self, model: Model):
        self.model = model
        self.at: dict[str, int] = {}
        self.scores = np.zeros((CACHED, len(model.langs)), np.float32)
        self.words = np.zeros(CACHED, np.int32)
        self.known: dict[str, list[float]] = {}

    def _add(self, chunk: str) -> int:
        k = len(self.at)
        words = letter_words(chunk)
        vectors = []
        for word in words:
            vector = self.known.get(word)
            if vector is None:
                if len(self.known) >= CACHED:
                    self.known.clear()
                vector = self.known[word] = self.model.posterior(word)
            vectors.append(vector)
        self.scores[k] = vectors[0] if len(vectors) == 1 else [sum(c) for c in zip(*vectors, strict=True)] or 0
        self.words[k] = len(words)
        self.at[chunk] = k
        return k

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its posterior, tempered to the weight of at most 12 words; `und` and 0 without letters."""
        if not text or not (chunks := text.split()) or not self.model.langs:
            return "und", 0.0
        total, words = np.zeros(len(self.model.langs)), 0
        for i in range(0, len(chunks), 50_000):
            part = chunks[i : i + 50_000]
            if len(self.at) + len(part) >= CACHED:
                self.at.clear()
            at, add = self.at, self._add
            own = [at[c] if c in at else add(c) for c in part]
            total += self.scores[own].sum(0, dtype=np.float64)
            words += int(self.words[own].sum())
        if not words:
            return "und", 0.0
        total = total * min(1.0, 12 / words)
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.model.langs[best], float(share[best] / share.sum())


def _least_count(entries: dict[int, int], most: int) -> int:
    """The least count from which on there are no more than `most` entries; entries holds how many there are of each count."""
    least, total = _MANY, 0
    for count in sorted(entries, reverse=True):
        total += entries[count]
        if total > most:
            break
        least = count
    return least


def train(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS, least: int = TRAIN_LEAST, most_entries: int = ENTRIES) -> Model:
    """Learn from rows with a text and a lang, all of them up to max_docs.

    Beyond that every language gets an equal part of max_docs, or all it has, `least` if the part is smaller: a hash of
    the id picks about that many of its rows. The words and n-grams of those texts are in the model, of a language with
    more than most_entries only those seen so often that no more are left: the driver gets their hashes and counts as
    numbers, and for each language a count of rows and of entries by frequency, so what it holds does not grow with texts.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(found.values()) > max_docs:
        part = max(least, max_docs // len(found))
        shares = [(lang, min(1.0, part / n)) for lang, n in found.items()]
        shares = spark.createDataFrame(shares, "lang string, share double")
        chance = (F.xxhash64("id", F.lit(7)) / F.lit(2.0**64)) + 0.5
        rows = rows.join(F.broadcast(shares) if len(found) <= 10_000 else shares, "lang").where((chance < F.col("share")) | (F.col("share") >= 1))
    counted = rows.select("lang", "text").mapInArrow(_counts, "lang string, n int, gram string, count long")
    counted = Scratch(labelled.sparkSession, "langid").keep(counted.groupBy("lang", "n", "gram").agg(F.sum("count").alias("count")), "counts")
    totals = counted.groupBy("lang", "n").agg(F.sum("count").alias("count")).collect()
    often = F.least("count", F.lit(_MANY))
    shape: dict[str, dict[int, int]] = {}
    for r in counted.groupBy("lang", often.alias("often")).agg(F.count("*").alias("entries")).collect():
        shape.setdefault(r["lang"], {})[r["often"]] = r["entries"]
    kept = spark.createDataFrame([(lang, _least_count(own, most_entries)) for lang, own in shape.items()], "lang string, least long")
    entries = counted.join(F.broadcast(kept) if len(shape) <= 10_000 else kept, "lang").where(F.col("count") >= F.col("least")).select("lang", "n", "gram", "count").mapInArrow(_keyed, "key long, lang string, n int, count long")
    return Model(entries.toArrow(), totals)


#: The worker's model and its identifier.
_identifiers: dict = {}


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns lang_pred and score: every row's whole text, in one narrow pass.

    `und` and 0.0 for a null text or one without letters (and for all if nothing was learned); ties go to the first language of the alphabet; letters of
    no known script give even scores. Columns of docs are kept, except ones named lang_pred or score.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is not _identifiers.get("model"):
            _identifiers.clear()
            _identifiers.update(model=shared.value, identifier=Identifier(shared.value))
        own = _identifiers["identifier"]
        for batch in batches:
            found = [own.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    others = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    source = docs.select(*(F.col(c) for c in others), F.col(text_col))
    return source.mapInArrow(predict, T.StructType([*source.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def is_held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(True))
