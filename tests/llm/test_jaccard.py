import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import jaccard, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def family(rng, n, words=60, change=0.02):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > change else f"c{rng.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_classes_as_brute_force(spark, make_docs, odd_texts, seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [*odd_texts, *family(rng, 25), *family(rng, 25, change=0.04), *family(rng, 12, 9, 0.05)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((5, 12, 18, 40)))) for _ in range(25)]
    texts += [" ".join(rng.choice("abc") for _ in range(k)) for k in range(1, 12)] * 2
    texts += [t.upper() for t in texts[30:34]]
    ids = rng.sample(range(10_000), len(texts))
    found = jaccard.near_duplicate_classes(make_docs(texts, ids)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(list(zip(ids, texts, strict=True)))


@pytest.mark.parametrize("order", ["rising", "falling", "random"])
def test_chains_of_near_copies(spark, make_docs, order):
    """Windows over one long text: each document links to its neighbours only."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000 + 60)]
    texts = [" ".join(words[2 * k : 2 * k + 30]) for k in range(1000)]
    ids = {"rising": list(range(1000)), "falling": list(range(1000, 0, -1)), "random": rng.sample(range(9000), 1000)}[order]
    found = jaccard.near_duplicate_classes(make_docs(texts, ids), sketch_bits=14).collect()
    assert {r.component_id for r in found} == {min(ids)} and len(found) == 1000


def test_long_lists_are_cut_without_loss(spark, make_docs):
    """Every list that may hold over five postings is dealt in blocks; classes stay those of brute force."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [*family(rng, 30, 40, 0.01), *(passage + f" u{k} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((2, 4, 6)))) for k in range(60))]
    found = jaccard.near_duplicate_classes(make_docs(texts), list_block=5, sketch_bits=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute(list(enumerate(texts)))


def test_dealt_lists_pair_every_two_documents_once():
    prefix, blocks = np.array([11, 12, 13], np.uint64), np.array([1, 3, 4])
    met, lists = {}, {}
    for doc in range(40):
        keys, places = jaccard.deal_long_lists(prefix, blocks, doc)
        for key, place in zip(keys.tolist(), places.tolist(), strict=True):
            lists.setdefault(key, []).append((doc, place >> 2, place & 3))
    for members in lists.values():
        for (a, pos, x), (b, _, y) in itertools.combinations(members, 2):
            if x == 2 or x != y:
                met[a, b, pos] = met.get((a, b, pos), 0) + 1
    assert met == {(a, b, pos): 1 for a, b in itertools.combinations(range(40), 2) for pos in range(3)}


def test_pairs_are_emitted_inside_a_list():
    n = 3000
    columns = [np.full(n, 7), np.arange(n), np.arange(n), np.full(n, 50), np.full(n, 45), np.ones(n, int), np.full(n, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 1000]) for c in columns], names=list("scinrew")) for i in range(0, n, 1000)]
    sizes = [b.num_rows for b in jaccard._pairs(iter(batches), 80, most=10_000)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) < 1_000_000 and len(sizes) > 3


def test_null_ids_repeated_rows_and_empty_tables(make_docs):
    text = "one two three four five six"
    rows = jaccard.near_duplicate_classes(make_docs([text, text, text, "other words are in this text"], [None, 7, 7, 9])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 7), (7, 7), (7, 7), (9, 9)]
    assert jaccard.near_duplicate_classes(make_docs([])).count() == 0


def test_chosen_level_grows_with_estimated_partners():
    calm = np.full(60, 0.01)
    crowded = np.full(60, 500.0)
    assert jaccard.choose_level(calm, 21, 100) < jaccard.choose_level(crowded, 21, 100) <= jaccard.MAX_LEVEL
    assert jaccard.choose_level(crowded, 2, 2) == 1


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(4000))) for _ in range(30)] + ["z" * 3000 + " b", None]
    want = [h.tolist() for h in textkit.word_hashes(pa.array(texts), True)]
    assert [len(h) for h in want] == [len(WORD.findall(t or "")) for t in texts]
    monkeypatch.setattr(textkit, "BLOCK", 4096)
    textkit._tables.clear()
    try:
        assert [h.tolist() for h in textkit.word_hashes(pa.array(texts), True)] == want
    finally:
        textkit._tables.clear()
