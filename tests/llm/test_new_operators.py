"""Operators 11 to 13 against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, minhash, ranked_search
from tessera.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else {tuple(words)}


def classes(rows, percent):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def family(rng, n, words=60, change=0.02):
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join(w if rng.random() > change else f"c{rng.randrange(10**6)}" for w in base) for _ in range(n)]


def as_rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("rounds", [2, 0])
def test_hamming_join_gives_the_classes_of_brute_force(make_docs, odd_texts, rounds):
    rng = random.Random(rounds)
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [*odd_texts, *family(rng, 25, 90, 0.01), *family(rng, 25, 120, 0.015), *family(rng, 12, 9, 0.05)]
    texts += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((3, 6, 9, 12, 40)))) for _ in range(25)]
    texts += [" ".join(rng.choice("abc") for _ in range(k)) for k in range(1, 12)] * 2
    texts += [t.upper() for t in texts[30:34]]
    ids = rng.sample(range(10_000), len(texts))
    found = minhash.near_duplicates(make_docs(texts, ids), star_rounds=rounds)
    assert as_rows(found) == classes(list(zip(ids, texts, strict=True)), 85)


def test_long_lists_are_cut_without_loss(make_docs):
    """Lists of over five members are dealt in blocks, every two of which meet."""
    rng = random.Random(8)
    texts = [*family(rng, 40, 80, 0.015), *family(rng, 40, 80, 0.03)]
    found = minhash.near_duplicates(make_docs(texts), list_block=5, star_rounds=0)
    assert as_rows(found) == classes(list(enumerate(texts)), 85)


def test_chain_of_near_copies(make_docs):
    """Windows over one long text: each document links to its neighbours only."""
    words = [f"w{k}" for k in range(800)]
    texts = [" ".join(words[2 * k : 2 * k + 60]) for k in range(300)]
    ids = random.Random(3).sample(range(9000), 300)
    found = minhash.near_duplicates(make_docs(texts, ids)).collect()
    assert {r.component_id for r in found} == {min(ids)} and [r.doc_id for r in found if r.kept] == [min(ids)]


def test_null_ids_repeated_rows_and_empty_tables(make_docs):
    text = "one two three four five six"
    rows = minhash.near_duplicates(make_docs([text, text, text, "other words are in this text", "alone without an id is this"], [None, 7, 7, 9, None])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in rows) == [(-1, -1, True), (-1, 7, False), (7, 7, True), (7, 7, True), (9, 9, True)]
    assert minhash.near_duplicates(make_docs([])).count() == 0


def test_signatures_within_the_distance_share_a_key():
    """Any signatures that differ in up to DISTANCE symbols, wherever these are, share a key, and first_shared_key names the first."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 16, (400, minhash.SYMBOLS)).astype(np.uint16)
    y = x.copy()
    for row, n in enumerate(rng.integers(0, minhash.DISTANCE + 1, len(x))):
        at = rng.choice(minhash.SYMBOLS, n, replace=False)
        y[row, at] ^= rng.integers(1, 1 << 16, n).astype(np.uint16)
    # The worst case: every chunk but one has one error more than it may.
    y[0] = x[0]
    y[0].reshape(minhash.CHUNKS, -1)[:-1, : minhash.CHUNK_ERRORS + 1] ^= 1
    y[0].reshape(minhash.CHUNKS, -1)[-1, : minhash.CHUNK_ERRORS] ^= 1
    same = minhash.keys_of(x) == minhash.keys_of(y)
    apart, first = minhash.first_shared_key(x, y)
    assert apart[0] == minhash.DISTANCE and same.any(axis=1).all()
    assert (first == same.argmax(axis=1)).all() and (apart == (x != y).sum(axis=1)).all()
    assert minhash.first_shared_key(x[:1], x[1:2])[1][0] == -1


def test_symbols_agree_about_as_often_as_sets_are_similar():
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 230).astype(np.uint64)
        x, y = np.unique(pool[:215]), np.unique(pool[15:])
        agree.append((minhash.signature(x) == minhash.signature(y)).mean())
    assert abs(np.mean(agree) - 200 / 230) < 0.02


def test_runs_do_not_depend_on_batches():
    keys = np.sort(np.random.default_rng(6).integers(0, 40, 500))
    rows = np.arange(500)
    for size in (1, 7, 500):
        batches = (pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(rows[k : k + size])], names=["k", "r"]) for k in range(0, 500, size))
        found = list(minhash._runs(batches, 1))
        assert [x[0][0] for x in found] == sorted(set(keys.tolist())) and np.concatenate([x[1] for x in found]).tolist() == rows.tolist()
        assert all(len(set(x[0].tolist())) == 1 for x in found)


def failing(text, copy):
    words = WORD.findall(text)
    tests = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy]
    return {f for f, bad in zip("ABCDE", tests, strict=True) if bad}


def brute_audit(rows, labels):
    rows = [(i, part or "", text or "") for i, part, text in rows]
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text] = min(i, least.get(text, i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails = [(i, part, failing(text, i is not None and i > least[text])) for i, part, text in rows]
    out = {}
    for part in {p for _, p, _ in rows}:
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                mine = [(i, x) for i, p, x in fails if p == part]
                here = [i for i, x in mine if f in x and not x & before]
                out[part, order, step] = [sum(not x & (before | {f}) for _, x in mine), len(here), sum(f in x and bool(x & before) for _, x in mine), sum(x == {f} for _, x in mine), sum(i in good for i in here), sum(i in toxic for i in here)]
                shapley[f] += len(here)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_cells(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_equals_brute_force(spark, odd_texts):
    rng = random.Random(9)
    prose = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.choice((30, 150, 3000)))) for _ in range(25)]
    texts = [*odd_texts, *prose, *prose[:10], *prose[:4], *(p + " #" for p in prose[:5]), *(p.upper() for p in prose[:5]), *("é" * 200 + p for p in prose[:3])]
    texts += [prose[-1][:-1] + "x", prose[-1]]
    rows = [(rng.randrange(10_000), rng.choice(("en", "de", None)), t) for t in texts] + [(None, "en", prose[0]), (None, None, None), (5, "", prose[1]), (5, "de", prose[1])]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i, _, _ in rows[::2]] + [(rows[0][0], 1, None), (None, 1, 1), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "m") for r in rows], "doc_id long, lang string, text string, mask long, part long, class_0 string").repartition(3)
    found = as_cells(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert found == brute_audit(rows, labels) and len(found) == 3 * 600


def test_audit_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string")
    assert as_cells(filter_audit.audit(one, labels)) == brute_audit([(1, None, None)], [])


def test_texts_that_collide_in_every_hash_are_told_apart(spark):
    """Classes are given, all the same: only the texts tell which rows are copies."""
    texts = spark.createDataFrame([(4, "a"), (2, "a"), (3, "b"), (9, "b"), (5, "c")], "id long, text string")
    classes_ = texts.select("id", *(F.lit(7).cast("long").alias(f"class_{k}") for k in range(filter_audit.BLOCKS + 1)))
    found = filter_audit.later_copies(classes_, texts.withColumn(f"class_{filter_audit.BLOCKS}", F.lit(7).cast("long")), Scratch(spark, "test"))
    assert sorted(r.id for r in found.collect()) == [4, 9]


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, queries, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for q, text in queries:
        scores = []
        for i, c in docs:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(q, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1 << 20, 12])
def test_search_equals_brute_force(spark, make_docs, odd_texts, most):
    rng = random.Random(11)
    pick = lambda: f"t{int(rng.paretovariate(0.6)) % 300}"
    texts = [*odd_texts, *(" ".join(pick() for _ in range(rng.choice((3, 20, 90)))) for _ in range(250))]
    texts += [texts[20]] * 15 + ["Été, naïve-word 42 été"]
    docs = list(zip([*rng.sample(range(9000), len(texts) - 1), None], texts, strict=True))
    queries = [(q, " ".join(pick() for _ in range(rng.choice((1, 4, 30))))) for q in range(12)] + [(50, texts[20]), (51, None), (52, "nowhere"), (53, "ÉTÉ été T1 t1, word"), (54, "!?")]
    index = ranked_search.build(make_docs([t for _, t in docs], [i for i, _ in docs]).repartition(3))
    found = ranked_search.search(spark, index, spark.createDataFrame([(q, t, "x") for q, t in queries], "item_id long, text string, rank string"), most=most)
    assert sorted(((r.query, r["rank"], r.id, r.score) for r in found.collect()), key=str) == brute_search(docs, queries)


def test_search_of_empty_tables(spark, make_docs):
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked_search.search(spark, ranked_search.build(make_docs([])), queries).count() == 0
    assert ranked_search.search(spark, ranked_search.build(make_docs(["", None])), queries).count() == 0
    assert ranked_search.search(spark, ranked_search.build(make_docs(["a b c"])), queries.limit(0)).count() == 0


def test_bounds_hold_and_bytes_suffice():
    rng = np.random.default_rng(12)
    tf, n = rng.integers(1, 3000, 2000), rng.integers(3000, 90_000, 2000)
    exact = ranked_search.impacts(tf, n, 1000, 50_000)
    units = -(-exact // ranked_search.STEP)
    assert units.max() <= 255 and (exact <= units * ranked_search.STEP).all() and (exact >= (units - 1) * ranked_search.STEP).all()
    assert ranked_search.SCALE // ranked_search.TF_PART <= 255 * ranked_search.STEP


def test_terms_are_those_of_the_pattern():
    texts = ["a-B c", "É1_x\ty", "\x00z\x7f", "", None, "x" * 70_000 + " q", "中文 文本"]
    assert [len(x) for x in ranked_search.term_hashes(pa.array(texts))] == [len(terms(t)) for t in texts]
    counted = next(iter(ranked_search._count_terms(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])]))))
    assert counted.to_pylist() == [{"docs": sum(bool(terms(t)) for t in texts), "terms": sum(len(terms(t)) for t in texts)}]
