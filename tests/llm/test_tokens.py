import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpecount, packing, spm
from tessera.llm.tokens import IdEncoder

PATH, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
library, counter, encoder = Tokenizer.from_file(PATH), bpecount.MergeCounter(PATH), IdEncoder(PATH)
pieces, machine = sentencepiece.SentencePieceProcessor(model_file=MODEL), spm.Transducer(spm.Model.read(MODEL))
MIXED = st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "'s", "1", "²", "é", "中", "　", "\x1c", "\x85", "!", "<|endoftext|>", "_", "\xa0", "😀", "́", "ing", "<s>", "▁", "\x00"]), max_size=16).map("".join)


@given(st.one_of(MIXED, st.text(max_size=40)))
@settings(max_examples=400, deadline=None)
def test_counts_and_ids_equal_the_library(text):
    want = library.encode(text, add_special_tokens=False).ids
    assert counter.count(text) == len(want)
    assert encoder.encode(text).tolist() == want


@given(st.one_of(MIXED, st.text(st.characters(exclude_categories=["Cs"]), max_size=40)))
@settings(max_examples=400, deadline=None)
def test_pieces_equal_the_library_and_decode(text):
    want = pieces.encode(text)
    found = machine.encode(text)
    assert np.frombuffer(found, "<u4").tolist() == want
    assert machine.decode(found) == pieces.decode(want)


def test_token_counts_of_odd_texts(make_docs, odd_texts):
    rows = sorted(bpecount.token_counts(make_docs(odd_texts), PATH).collect())
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in enumerate(odd_texts)]
    assert [tuple(r) for r in rows] == want
    assert bpecount.token_counts(make_docs([]), PATH).count() == 0


def test_sentencepiece_of_odd_texts(make_docs, odd_texts):
    encoded = spm.encode(make_docs(odd_texts), MODEL)
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(odd_texts):
        want = pieces.encode(text or "")
        assert rows[i].ids == want and rows[i].ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and rows[i].round_trip
    back = {r.doc_id: r.text for r in spm.decode(encoded, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd_texts)}


def check_packing(rows, texts, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == capacity for r in own[1:]) and (len(own) == 1 or len(ids) > capacity)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= capacity
    return len(by_sequence)


def test_packing_is_gapless_and_close_to_the_bound(monkeypatch, make_docs, odd_texts):
    rng = random.Random(3)
    texts = [*odd_texts, *(" ".join(rng.choice(("the", "cat", "sat", "on", "mat")) for _ in range(rng.randrange(1, 300))) for _ in range(300))]
    monkeypatch.setattr(packing, "GROUP", 64)
    packed = packing.pack_documents(make_docs(texts), PATH, capacity=256, ids=True)
    rows = packed.collect()
    bins = check_packing(rows, texts, 256)
    assert bins <= -(-sum(r.length for r in rows) // 256) * 1.03 + 2
    made = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(len(r.ids) for r in made.values()) == sum(r.length for r in rows) and max(len(r.ids) for r in made.values()) <= 256
    assert packing.pack_documents(make_docs([]), PATH).count() == 0


def test_repeated_and_null_ids_are_packed(make_docs):
    rows = packing.pack_documents(make_docs(["a b", "a b", "c"], [1, 1, None]), PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 2), (1, 3), (1, 3)] and len({r.sequence_id for r in rows}) == 1


@pytest.mark.parametrize("seed", range(6))
def test_every_placement_makes_the_squares_smallest(seed):
    """Step by step against all open gaps: the sum of squared counts of open bins per gap after the placement is the least."""
    rng = np.random.default_rng(seed)
    capacity = 30
    sizes = rng.integers(1, capacity + 1, 200)
    bins = packing.pack_sizes(sizes, capacity)
    gap_of: dict[int, int] = {}

    def squares(gaps):
        return sum(n * n for n in np.bincount([g for g in gaps if g], minlength=capacity + 1).tolist())

    for k in np.argsort(-sizes, kind="stable"):
        size, open_ = int(sizes[k]), list(gap_of.values())
        fitting = {g for g in open_ if g >= size}
        if not fitting:
            assert bins[k] not in gap_of
            gap_of[int(bins[k])] = capacity - size
            continue
        after = {}
        for g in fitting:
            left = open_.copy()
            left.remove(g)
            after[g] = squares([*left, g - size])
        chosen = gap_of[int(bins[k])]
        assert after[chosen] == min(after.values())
        gap_of[int(bins[k])] = chosen - size
    assert all(g >= 0 for g in gap_of.values())


@pytest.mark.parametrize("white", [" ", "\n", "\t", " \n"])
def test_very_long_white_space(make_docs, white):
    text = "a" + white * (2_000_000 // len(white)) + "b"
    want = library.encode(text, add_special_tokens=False).ids
    assert encoder.encode(text).tolist() == want and counter.count(text) == len(want)
    rows = packing.pack_documents(make_docs([text, "c"]), PATH).collect()
    check_packing(rows, [text, "c"], 2048)


def field(number, kind, payload):
    """One field of a serialised message: a varint, a float or bytes."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if kind == 2:
        return varint(number << 3 | 2) + varint(len(payload)) + payload
    return varint(number << 3 | kind) + (struct.pack("<f", payload) if kind == 5 else varint(payload))


def model_file(pieces, model_type, charsmap=b"", collapse=1):
    """A `.model` file written by hand: pieces are (text, score, type)."""
    out = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, s) + field(3, 0, k)) for t, s, k in pieces)
    byte_fallback = any(k == 6 for _, _, k in pieces)
    out += field(2, 2, field(3, 0, model_type) + field(35, 0, int(byte_fallback)))
    return out + field(3, 2, field(1, 2, b"own") + field(2, 2, charsmap) + field(3, 0, 1) + field(4, 0, collapse))


SPECIAL = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
WORDS = ["▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "▁b", "bb", "c", "abc", "▁cab", "ca", ".", "b.", "é"]
# Scores that float32 adds without rounding, so that ties are ties for the library too.
UNIGRAM = [(w, -1.0 - 0.25 * (k * 7 % 17), 1) for k, w in enumerate(WORDS)]
BYTES = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
NFKC = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")


def charsmap_of(normalizer):
    return dict(spm._fields(normalizer.serialized_normalizer_spec()))[2]


@pytest.mark.parametrize("bytes_too", [False, True])
@pytest.mark.parametrize("charsmap", [b"", charsmap_of(NFKC)], ids=["plain", "nfkc"])
def test_unigram_paths_equal_the_library(bytes_too, charsmap):
    rng = random.Random(6)
    data = model_file(SPECIAL + UNIGRAM + BYTES * bytes_too, 1, charsmap)
    library_, own = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Transducer(spm.Model(data))
    for _ in range(600):
        text = "".join(rng.choice("aabbc .  éxy中ﬁ") for _ in range(rng.randrange(14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library_.encode(text), text


def test_users_pieces_are_never_split():
    data = model_file([*SPECIAL, ("<tag>", 0.0, 4), ("ab<", 0.0, 4), *((w, float(-k), 1) for k, w in enumerate(WORDS))], 2)
    library_, own = sentencepiece.SentencePieceProcessor(model_proto=data), spm.Transducer(spm.Model(data))
    for text in ("a<tag>b", "ab<tag>", "<tag>", "ab <tag><tag> ab<", "xx<tag>x", ""):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library_.encode(text), text


@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_character_map_equals_the_library(text):
    text = text.replace("▁", "")
    own = spm.Transducer(spm.Model(model_file(SPECIAL + UNIGRAM, 1, charsmap_of(NFKC))))
    assert own.normalise(text).replace("▁", " ").strip(" ") == NFKC.normalize(text).replace("▁", " ").strip(" ")
