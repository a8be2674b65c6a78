"""SentencePiece encoding and decoding as shortest paths through composed weighted transducers."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks, atoms and pairs of pieces that a worker remembers, and the length of those chunks. Results never depend on them.
CACHED, CHUNK_CHARS = 1_000_000, 40
#: How much worse than the worst piece an unknown character of a unigram model is.
UNKNOWN_PENALTY = 10.0


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of a serialised protocol buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            size, i = _varint(data, i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = struct.unpack("<d" if kind == 1 else "<f", data[i : i + size])[0], i + size
        yield tag >> 3, value


class CharacterMap:
    """The normaliser's rules: a transducer that rewrites the longest key at each place and copies other characters.

    Its states are the units of the double-array trie that model files hold, its outputs the strings that follow it.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.outputs = blob[4 + size :]
        self.plain = "".join(chr(c) for c in range(128) if not self.units or self._step(self._offset(self.units[0]), c) is None)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _step(self, at: int, byte: int) -> int | None:
        at ^= byte
        if at >= len(self.units) or self.units[at] & 0x800000FF != byte:
            return None
        return at

    def _longest(self, data: bytes, start: int) -> tuple[int, int]:
        """(end, where the output is) of the longest key that data has at start; (start, -1) without one."""
        node, found = self._offset(self.units[0]), (start, -1)
        for i in range(start, len(data)):
            at = self._step(node, data[i])
            if at is None:
                break
            unit = self.units[at]
            node = at ^ self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1, self.units[node] & 0x7FFFFFFF)
        return found

    def apply(self, text: str) -> str:
        if not self.units or not text.strip(self.plain):
            return text
        data, out, i, copied = text.encode(), [], 0, 0
        while i < len(data):
            end, at = self._longest(data, i)
            if at < 0:
                i += 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
                continue
            out += (data[copied:i], self.outputs[at : self.outputs.index(b"\0", at)])
            i = copied = end
        return b"".join([*out, data[copied:]]).decode()


class Model:
    """Pieces and normaliser of a `.model` file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        kind, suffix = 1, 0
        self.dummy_prefix, self.collapse, escape, charsmap = True, True, 1, b""
        for number, value in _fields(data):
            if number == 1:
                parts = dict(_fields(value))
                self.pieces.append((parts[1].decode(), parts.get(2, 0.0), parts.get(3, NORMAL)))
            elif number == 2:
                parts = dict(_fields(value))
                kind, suffix = parts.get(3, 1), parts.get(24, 0)
            elif number == 3:
                parts = dict(_fields(value))
                charsmap = parts.get(2, b"")
                self.dummy_prefix, self.collapse, escape = bool(parts.get(3, 1)), bool(parts.get(4, 1)), parts.get(5, 1)
        if kind not in (1, 2) or suffix or not escape:
            raise ValueError("only unigram and byte-pair models that mark spaces before words are compiled")
        self.bpe, self.map = kind == 2, CharacterMap(charsmap)
        self.user = {text: k for k, (text, _, kind) in enumerate(self.pieces) if kind == USER}
        if self.user and not self.bpe:
            raise ValueError("unigram models with pieces of the user's own are not compiled")
        self.id = {text: k for k, (text, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        self.bytes = {int(text[3:5], 16): k for k, (text, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.unknown = next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            return cls(file.read())


class Transducer:
    """The composition of normaliser, piece transducer and byte fallback, searched in the tropical semiring.

    - Normaliser: the character map, runs of spaces to one where the model says so, the space to U+2581, and the dummy
      prefix as start output. It has one path for an input.
    - Pieces: a trie of integer states over characters; the arc back to its root emits the piece that was read. For a
      unigram model it weighs minus the piece's score. A byte-pair model has no path weights that stand for its merge
      order; there a path is right exactly when every two neighbouring pieces are what merging their own text gives, so a
      state also holds the piece last emitted, arcs to a piece that may not follow it weigh infinity and all others zero.
      One path of finite weight is left for every prefix of the input (tests hold it equal to the library's).
    - Byte fallback: an arc of its own over each character that is no piece; it emits the character's bytes, or the unknown
      piece.

    `shortest` makes the composition's states along an input and settles them least weight first, as Dijkstra does, of
    equal weight the furthest first. Where no piece holds two neighbouring characters, no path crosses, so inputs are cut
    there into atoms; paths are found, and remembered, atom by atom.
    """

    def __init__(self, model: Model):
        self.model = model
        # Pieces that merging their own text gives; others can't be emitted.
        used = {text: k for text, k in model.id.items() if not model.bpe or self._merge(text) == [text]}
        # The trie: every path from its root, and the arcs that leave a position where the input goes along that path, as
        # (weight, -characters, piece), least weight first and of equal weight the longest. Piece -1 is the fallback.
        self.weight = [0.0 if model.bpe else -p[1] for p in model.pieces]
        worst = min((model.pieces[k][1] for k in used.values()), default=0.0)
        self.fallback = [(0.0 if model.bpe else UNKNOWN_PENALTY - worst, -1, -1)]
        self.trie, self.leaving = ahocorasick.Automaton(), {"": self.fallback}
        for path in {text[:i] for text in used for i in range(1, len(text) + 1)}:
            arcs = [(self.weight[used[path[:i]]], -i, used[path[:i]]) for i in range(1, len(path) + 1) if path[:i] in used]
            self.leaving[path] = sorted(arcs + ([] if path[0] in used else self.fallback))
            self.trie.add_word(path, None)
        self.used = used
        self.inside = {text[i : i + 2] for text in used for i in range(len(text) - 1)}
        # Chunks begin at spaces and are independent, unless pieces hold spaces after other characters, user's pieces may
        # begin with one, or unknown characters in a row make one piece.
        self.split = not any(SPACE in text.lstrip(SPACE) for text in used) and not model.user and bool(model.bytes)
        self.user = re.compile("(" + "|".join(re.escape(u) for u in sorted(model.user, key=len, reverse=True)) + ")")
        self.user_ids = {u: struct.pack("<I", k) for u, k in model.user.items()}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.text = [self._bytes(*p) for p in model.pieces]
        self.atom_ids = _Cache(self._atom)
        self.chunks = _Cache(lambda chunk: self._ids(SPACE + chunk))

    def normalise(self, text: str) -> str:
        text = self.model.map.apply(text)
        if self.model.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        return (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)

    def _merge(self, text: str) -> list[str]:
        """What merging gives for a text of two pieces at most: used to weigh arcs, never on inputs."""
        parts, ids, pieces = list(text), self.model.id, self.model.pieces
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and pieces[k][1] > best:
                    best, at = pieces[k][1], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, left: str, right: str) -> bool:
        """Whether the arc to `right` has finite weight in the states after `left`, in a byte-pair model."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) > 4 * CACHED:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merge(left + right) == [left, right]
        return found

    def shortest(self, text: str) -> list[tuple[str, int]]:
        """(text, piece) of the path of least weight through the composition with one atom.

        The queue holds the next arc of every settled state, arcs of a state in order; a pair's weight is looked up when
        its arc is popped.
        """
        n, bpe, leaving, longest = len(text), self.model.bpe, self.leaving, self.trie.longest_prefix
        if bpe and text in self.used:
            return [(text, self.used[text])]
        pairs, follows = self.pairs, self.follows
        came: list[tuple[int, str, int]] = [(-1, "", -1)] * (n + 1)  # of a settled state: where its last arc began, text, piece
        arcs = leaving[text[: longest(text)]]
        heap = [(arcs[0][0], arcs[0][1], 0, 0, 0.0, arcs)]  # weight, -end, start, arc, start's weight, arcs
        while heap:
            weight, end, start, k, base, arcs = heap[0]
            if k + 1 < len(arcs):
                heapreplace(heap, (base + arcs[k + 1][0], arcs[k + 1][1] - start, start, k + 1, base, arcs))
            else:
                heappop(heap)
            end = -end
            if came[end][0] >= 0:
                continue
            read = text[start:end]
            if bpe and start:
                left = came[start][1]
                finite = pairs.get((left, read))
                if not (follows(left, read) if finite is None else finite):
                    continue
            came[end] = (start, read, arcs[k][2])
            if end == n:
                break
            rest = text[end:]
            arcs = leaving[rest[: longest(rest)]]
            heappush(heap, (weight + arcs[0][0], arcs[0][1] - end, end, 0, weight, arcs))
        out = []
        while n:
            n, read, piece = came[n]
            out.append((read, piece))
        return out[::-1]

    def atoms(self, text: str) -> list[str]:
        """Cuts between characters that no piece holds side by side."""
        if not text:
            return []
        out, start, inside = [], 0, self.inside
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                out.append(text[start:i])
                start = i
        out.append(text[start:])
        return out

    def _atom(self, atom: str) -> bytes:
        out: list[int] = []
        for text, piece in self.shortest(atom):
            if piece >= 0:
                out.append(piece)
            elif self.model.bytes:
                out.extend(self.model.bytes[b] for b in text.encode())
            else:
                out.append(self.model.unknown)
        return struct.pack(f"<{len(out)}I", *out)

    def _ids(self, normal: str) -> bytes:
        """Ids of a normalised text: of its user's pieces, leftmost and longest first, and of the atoms between them."""
        atom = self.atom_ids.__getitem__
        if not self.model.user:
            out = b"".join(map(atom, self.atoms(normal)))
        else:
            parts = self.user.split(normal)
            out = b"".join(self.user_ids[part] if k % 2 else b"".join(map(atom, self.atoms(part))) for k, part in enumerate(parts))
        if not self.model.bytes:  # unknown characters in a row make one piece
            ids = np.frombuffer(out, "<u4")
            again = (ids == self.model.unknown) & (np.r_[np.uint32(self.model.unknown + 1), ids[:-1]] == ids)
            return ids[~again].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        normal = self.normalise(text)
        if not self.split or not normal.startswith(SPACE):
            return self._ids(normal)
        chunks = normal[1:].split(SPACE)
        if "" not in chunks:
            return b"".join(map(self.chunks.__getitem__, chunks))
        out, spaces = [], 0
        for chunk in chunks:
            if not chunk:  # a space before a space, or the last: it belongs to the next chunk
                spaces += 1
            elif spaces:
                out.append(self._ids(SPACE * spaces + SPACE + chunk))
                spaces = 0
            else:
                out.append(self.chunks[chunk])
        if spaces:
            out.append(self._ids(SPACE * spaces))
        return b"".join(out)

    @staticmethod
    def _bytes(text: str, _: float, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else text.replace(SPACE, " ").encode()

    def decode(self, ids: bytes) -> str:
        """The inverse transducer: ids to piece texts and bytes, spaces back, dummy prefix off; broken bytes become U+FFFD each."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


class _Cache(dict):
    """Ids of a string, made when first seen."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        found = self.make(text)
        if len(text) <= CHUNK_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[text] = found
        return found


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The worker's transducer for a file, compiled once."""
    if path not in _transducers:
        _transducers[path] = Transducer(Model.read(path))
    return _transducers[path]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip, and on demand ids array<int>) of every row's whole text.

    round_trip tells whether decoding gives the text back; it fails only where the text holds U+2581 itself, and what
    the normaliser drops. A null text is empty: no pieces, a crc of 0. Rows with one id stay apart; other columns are
    ignored. One narrow pass; caches are bounded.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = transducer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [own.encode(t) for t in texts]
            arrays = [batch.column(0), pa.array([len(f) // 4 for f in found], pa.int64()), pa.array([zlib.crc32(f) for f in found], pa.int64()), pa.array([own.decode(f) == t for f, t in zip(found, texts, strict=True)], pa.bool_())]
            names = ["id", "n_pieces", "ids_crc32", "round_trip"]
            if ids:
                arrays.append(pa.array([np.frombuffer(f, "<u4").astype(np.int32) for f in found], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * ids).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with text_col, the text that ids_col stands for; null ids give a null text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = transducer(path)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else own.decode(np.asarray(x, "<u4").tobytes()))

    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn(text_col, pandas_udf(run, "string")(F.col(ids_col)))
