"""The corpus pipeline: quality, language, near duplicates, personal data, packing; each stage takes all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, packing, pii, quality
from tessera.llm.queries import BYTE_BPE, DEMO_KEY
from tessera.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document whose language has a lower posterior is rejected.
LEAST_SCORE = 0.5


def _changed(docs: DataFrame, is_changed: Column, text: Column) -> list[Column]:
    """The columns of docs with another text, whose n_chars follows it."""
    chars = F.when(is_changed, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return [text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, as the lines that passed; n_chars follows the text.

    A null, empty or blank text has no words and goes. Rows are judged apart, whatever ids repeat or are null; an empty table
    stays empty. Only the columns of documents are kept.
    """
    judged = quality.line_first(docs, keep=tuple(c for c in COLUMNS if c not in ("doc_id", "text"))).where("kept").withColumnRenamed("clean_text", "text")
    return judged.select(*_changed(docs.select(*COLUMNS), F.col("n_removed_lines") > 0, F.col("text")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model, learned from the labelled rows that came here, knows well enough.

    A text without letters is `und` and goes; one as likely in two languages as LEAST_SCORE asks stays. A null lang or id is
    no fault, rows are judged apart; where no row is labelled nothing is known and nothing stays. Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(~langid.is_held_out()))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id (all its rows, if that id repeats); rows without an id stay.

    Where ids repeat, rows of one id count as one document: they go if the id isn't its group's smallest. Null and
    wordless texts link with nothing and stay. Extra columns are dropped.
    """
    docs = docs.select(*COLUMNS)
    classes = jaccard.near_duplicate_classes(docs)
    dropped = classes.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars follows the text. Null texts stay, rows may repeat."""
    found = pii.pseudonymise(docs.select(*COLUMNS), DEMO_KEY)
    return found.select(*_changed(docs.select(*COLUMNS), F.col("n_entities") > 0, F.col("text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences: one row per piece. A null text is a piece of the end id alone; rows with one id stay apart."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Hashing, tokenising and learned scores are beyond SQL: tests/llm/test_pipeline.py runs all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
