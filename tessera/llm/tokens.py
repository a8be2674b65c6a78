"""Byte-level BPE ids of whole texts, through a cache of space-delimited chunks."""

from __future__ import annotations

import json
import re

import numpy as np

#: White space as the byte-level pre-tokeniser takes it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokeniser of byte-level BPE: contractions, words, numbers and signs with a leading space, white space.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: A run of white space that cannot be cut before each of its spaces without changing its pieces.
_TANGLED = re.compile(rf"[{WHITE}] (?:[{WHITE}]|$)")
#: Chunks and entries that a worker keeps; beyond the number the cache starts anew. Results never depend on it.
CHUNK_CHARS, CACHED = 32, 600_000


def splittable(text: str, specials: tuple[str, ...]) -> bool:
    """Whether the text's pieces are those of its chunks: the part before the first space, then each `' ' + part`.

    Spaces open pieces (` ?letters`), so cuts before them are piece borders, except inside runs of white space that
    hold a space after white space and before white space or the end; special strings may also swallow a border.
    """
    return not _TANGLED.search(text) and not any(s in text for s in specials)


class ChunkCache(dict):
    """chunk -> value, made by `make` when first seen."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        value = self.make(chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable character that a byte-level vocabulary file writes for each byte: itself, or the next from U+0100 on."""
    plain = [b for lo, hi in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)) for b in range(lo, hi + 1)]
    table = {b: chr(b) for b in plain}
    for b in range(256):
        table.setdefault(b, chr(0x100 + len(table) - len(plain)))
    return table


def plain_byte_level(path: str) -> dict:
    """The contents of a tokenizers `.json` file, if it is byte-level BPE without normaliser or prefix space."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return spec


class IdEncoder:
    """Ids of a tokenizers `.json` file as unsigned 32-bit numbers, special strings inside texts as its default.

    The vocabulary is the file's; the merging is done by tiktoken, whose ids are the same and come three times faster, if
    ids follow the order of merges. Where they don't, and for texts that its backtracking pattern gives up on (very long
    runs of white space), `tokenizers` itself encodes.
    """

    def __init__(self, path: str):
        import tiktoken

        spec = plain_byte_level(path)
        self.path, self.slow = path, None
        byte = {c: b for b, c in byte_symbols().items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        self.encoding = None
        if all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            self.encoding = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.encoding is not None:
            try:
                return self.encoding.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, IdEncoder] = {}


def encoder(path: str) -> IdEncoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = IdEncoder(path)
    return _encoders[path]
