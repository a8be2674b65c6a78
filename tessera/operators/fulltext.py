"""A stored full-text index: postings by term, and lengths of rows; questions read the postings of their own words only."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.search import K1, B, terms
from tessera.sources.durable import Kept

#: Characters of a term that name the partition its postings are in.
HEAD = 2
#: Postings that one task writes, about.
POSTINGS_PER_TASK = 4_000_000


def postings(chunks: DataFrame, id_col: str, text_cols: list[str], keep: list[str] = ()) -> DataFrame:
    """(term, field, position, id) and columns to keep: a row for each place of each term."""
    places = [chunks.select(*keep, F.col(id_col).alias("id"), F.lit(k).alias("field"), F.posexplode(terms(F.coalesce(F.col(c), F.lit("")))).alias("position", "term")) for k, c in enumerate(text_cols)]
    rows = places[0]
    for more in places[1:]:
        rows = rows.unionByName(more)
    return rows.select(*keep, "term", "field", "position", "id")


def build(chunks: DataFrame, root: str, *, id_col: str, text_cols: list[str], mode: str = "overwrite") -> None:
    """Write the index of chunks below root: postings in folders by head, sorted by term, lengths, and one row of totals.

    With mode `append` the rows of new chunks are added; ids must be new (delete by id first: `remove`). A head is dealt to as
    many tasks as its places ask for, by id: no task holds all places of a frequent word, and a rare head is one file however
    large the index is. Terms are made once and kept until the postings are written. For an index that is kept up to date see
    segments.SegmentedIndex.
    """
    spark = chunks.sparkSession
    made = [terms(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]
    texts = Kept(spark)(chunks.select(F.col(id_col).alias("id"), F.array(*made).alias("terms")))
    texts.select("id", F.aggregate("terms", F.lit(0), lambda n, t: n + F.size(t)).alias("length")).write.mode(mode).parquet(f"{root}/lengths")
    _total(spark, root)
    fields = texts.select("id", F.posexplode("terms").alias("field", "terms"))
    rows = fields.select("id", "field", F.posexplode("terms").alias("position", "term")).withColumn("head", F.substring("term", 1, HEAD))
    # Heads are few, whatever the texts: pairs of letters.
    heads = Kept(spark)(rows.groupBy("head").agg(F.count("*").alias("places")))
    places = heads.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0]
    tasks = max(math.ceil(places / POSTINGS_PER_TASK), spark.sparkContext.defaultParallelism)
    share = F.ceil(F.col("places") / max(places // tasks, 1))
    rows = rows.join(F.broadcast(heads.select("head", F.xxhash64("head").alias("first"), share.alias("share"))), "head")
    rows = rows.withColumn("task", F.pmod(F.pmod("first", F.lit(tasks)) + F.pmod(F.xxhash64("id"), "share"), F.lit(tasks)).cast("int"))
    rows = rows.select("term", "field", "position", "id", "task").repartitionById(tasks, "task")
    rows = rows.select(F.substring("term", 1, HEAD).alias("head"), "term", "field", "position", "id").sortWithinPartitions("head", "term")
    rows.write.mode(mode).partitionBy("head").parquet(f"{root}/postings")


def _total(spark: SparkSession, root: str) -> None:
    total = spark.read.parquet(f"{root}/lengths").agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length"))
    total.write.mode("overwrite").parquet(f"{root}/totals")


def remove(spark: SparkSession, root: str, ids: DataFrame) -> None:
    """Drop the rows of ids (id): both tables are written anew beside the old ones, which then give way."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for table, parts in (("postings", ["head"]), ("lengths", [])):
        kept = spark.read.parquet(f"{root}/{table}").join(ids.distinct(), "id", "left_anti")
        kept.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/{table}__new")
        old, new = hadoop.Path(f"{root}/{table}"), hadoop.Path(f"{root}/{table}__new")
        fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(old, True)
        fs.rename(new, old)
    _total(spark, root)


def _word(rows: DataFrame, word: str, prefix: bool) -> DataFrame:
    rows = rows.where(F.col("term").startswith(word) if prefix else F.col("term") == word)
    if "head" not in rows.columns:
        return rows
    head = word[:HEAD]
    return rows.where(F.col("head") == head if not prefix or len(word) >= HEAD else F.col("head").startswith(word))


def phrase_matches(rows: DataFrame, query: str) -> DataFrame:
    """(id, matches) from postings: places where rows hold the query as a phrase, its last word a prefix.

    Only folders of the query's words are read, where there are any (column head); the rarest word's places are not known beforehand, so joins of places run
    on (id, field, position), which no hot word skews.
    """
    words = re.findall(r"[^\W_]+", query.lower())
    if not words:
        return rows.where("false").groupBy("id").agg(F.count("*").alias("matches"))
    found = None
    for k, word in enumerate(words):
        own = _word(rows, word, k == len(words) - 1).select("id", "field", (F.col("position") - k).alias("start"))
        found = own if found is None else found.join(own, ["id", "field", "start"], "left_semi")
    return found.groupBy("id").agg(F.count("*").alias("matches"))


def matches(spark: SparkSession, root: str, query: str) -> DataFrame:
    """(id, matches) of the index below root."""
    schema = spark.read.parquet(f"{root}/lengths").schema["id"].dataType
    return phrase_matches(spark.read.schema(f"term string, field int, position int, id {schema.simpleString()}, head string").parquet(f"{root}/postings"), query)


def bm25(spark: SparkSession, root: str, query: str, *, clamp: bool = True) -> DataFrame:
    """(id, matches, length, score) as search.bm25 gives them for the chunks that were indexed; their texts are not read."""
    found = matches(spark, root, query)
    # Counted by a column of the matches, so that both sides want the same rows of one shuffle, which Spark then reuses.
    stats = found.agg(F.count(F.when(F.col("matches") > 0, 1)).alias("with_term")).crossJoin(F.broadcast(spark.read.parquet(f"{root}/totals").limit(1)))
    found = found.join(spark.read.parquet(f"{root}/lengths"), "id")
    odds = (F.col("docs") - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5)
    idf = F.greatest(F.ln(odds), F.lit(1e-6)) if clamp else F.ln(odds + 1)
    tf = F.col("matches")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return found.crossJoin(F.broadcast(stats)).withColumn("score", score).select("id", "matches", "length", "score")
