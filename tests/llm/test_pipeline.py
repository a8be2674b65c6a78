"""The pipeline's stages against brute force, each on what the one before kept."""

import math
import random

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_documents import brute_language, brute_quality, brute_surrogates
from test_jaccard import brute as brute_classes
from test_tokens import check_packing, library

from tessera.llm import langid, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    parts = {"en": "the and ing tion er on at", "de": "der ung keit sch ein ich", "fr": "le eau tion ment que eux"}
    rows = []
    for k in range(90):
        lang = rng.choice(sorted(parts))
        of = parts[lang].split()
        lines = []
        for _ in range(rng.randrange(3, 9)):
            words = ["".join(rng.choice(of) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8, 30))]
            lines.append(" ".join(words).capitalize() + ".")
        if k % 9 == 0:
            lines.insert(1, "Home | About | Contact")
        if k % 7 == 0:
            lines.append(f"Write to user{k % 21}@corp.org or Mr. John Smith today.")
        rows.append([k, "\n".join(lines), lang if k % 11 else None, "web", None])
    rows += [[200 + k, rows[k][1], rows[k][2], "copy", 5] for k in range(0, 40, 3)]  # exact copies
    rows += [[300 + k, rows[k][1] + " zz", rows[k][2], "near", 5] for k in range(0, 40, 5)]  # near copies
    rows += [[400, None, "en", "x", 0], [401, "", "en", "x", 0], [402, "\n \t", None, "x", 1], [403, "too short", "en", "x", 9], [None, rows[1][1] + " ab cd", "en", "x", 1], [5, rows[5][1], rows[5][2], "again", 3]]
    rows += [[404, " ".join(f"{k}" for k in range(200)), None, "digits", 3], [405, "A very long text. " * 3 + " ".join(f"the{k}er" for k in range(9000)), "en", "long", None]]
    return rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    rng = random.Random(1)
    rng.shuffle(rows)
    spark.createDataFrame([tuple(r) for r in rows], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS and [f.dataType for f in docs.schema] == [f.dataType for f in spark.createDataFrame([], DOCS).schema]

    def key(rows):
        return sorted((-1 if r[0] is None else r[0], r[1]) for r in rows)

    # quality: the verdict and the text that is left
    want = []
    for i, text, lang, *_ in rows:
        kept, clean = quality_of(text)
        if kept:
            want.append((i, clean, lang))
    assert key(seen["quality_rules"]) == key(want) and 80 < len(want) < len(rows)
    by_text = {r.text: r for r in seen["quality_rules"]}
    assert all(by_text[t].n_chars == len(t) for _, t, _ in want if t not in {r[1] for r in rows})

    # language: learned from what is not held out and labelled
    held = {r[0]: r[1] for r in spark.createDataFrame([(w[0],) for w in want], "doc_id long").select("doc_id", langid.is_held_out()).collect()}
    learn = [(t, lang) for i, t, lang in want if not held[i] and lang is not None]
    found = brute_language(learn, [t for _, t, _ in want])
    want = [w for w, (lang, score) in zip(want, found, strict=True) if lang != "und" and score >= 0.5]
    assert key(seen["language_id"]) == key(want)

    # near duplicates: rows whose id is the smallest of its class; ids that are null stay
    numbered = {i: set() for i, _, _ in want if i is not None}
    for i, t, _ in want:
        if i is not None:
            numbered[i].add(t)
    classes = {i: c for i, _, c in brute_classes([(i, t) for i, texts in numbered.items() for t in sorted(texts)])}
    want = [w for w in want if w[0] is None or classes[w[0]] == w[0]]
    assert key(seen["near_duplicates"]) == key(want) and len(want) < len(seen["language_id"])

    # personal data
    texts, _ = brute_surrogates([t for _, t, _ in want], queries.DEMO_KEY)
    want = [(i, t, lang) for (i, _, lang), t in zip(want, texts, strict=True)]
    assert key(seen["personal_data"]) == key(want) and not any("@corp.org" in t or "Smith" in t for _, t, _ in want)

    # packing: gapless, within capacity, near the bound
    ids = {i: k for k, i in enumerate(sorted({w[0] for w in want if w[0] is not None}))}
    if all(w[0] is not None for w in want) and len(ids) == len(want):
        order = sorted(want)
        packed = [Row(ids[r.doc_id], r) for r in seen["best_fit_packing"]]
        check_packing(packed, [t for _, t, _ in order], 2048)
    total = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t, _ in want)
    assert sum(r.length for r in seen["best_fit_packing"]) == total
    assert len({r.sequence_id for r in seen["best_fit_packing"]}) <= math.ceil(total / 2048) * 1.05 + 1


class Row:
    """A packed piece under another doc_id."""

    def __init__(self, doc_id, piece):
        self.doc_id, self.piece, self.start, self.length = doc_id, piece.piece, piece.start, piece.length
        self.ids_crc32, self.sequence_id, self.offset = piece.ids_crc32, piece.sequence_id, piece.offset


def quality_of(text):
    """(kept, clean text) of one text by the rules of the operator, its verdict from brute-force counts."""
    from tessera.llm import quality

    clean, _, left, _ = quality.clean_lines(text or "")
    n, repeated = brute_quality(text)[0], brute_quality(text)[4]
    failed = n < 50 or 100 * repeated > 50 * n
    return not failed and left >= 0.5 * n, clean


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "x" * 200_000, "en", "a", None)]])
def test_small_and_odd_tables_pass_all_stages(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert public_tokenizers.path(queries.BYTE_BPE)


def test_clashing_columns_do_no_harm(spark):
    docs = spark.createDataFrame([tuple(r) for r in documents()[:30]], DOCS)
    for c in ("component_id", "lang_pred", "score", "kept", "n_words", "n_entities", "node", "id", "rid"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == corpus_pipeline.COLUMNS, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 30
