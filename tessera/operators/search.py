"""Full text, vectors and their fusion: phrase-prefix match, BM25, exact top-k, reciprocal rank fusion, packing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.params import DEFAULT, Params

TERM = r"[\p{L}\p{N}]+"
#: Smaller comes first in a mixed list.
TYPE_PRIORITY = {"note": 0, "code": 1, "wiki": 2}
K1, B = 1.2, 0.75


def terms(text: Column) -> Column:
    """Terms of a text in order: runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)


def term_count(text: Column) -> Column:
    """How many terms a text has; none of them is made."""
    return F.regexp_count(F.lower(text), F.lit(TERM))


def phrase_count(text: Column, phrase: list[str]) -> Column:
    """Places where a text holds a phrase of terms; the last word is a prefix. One pattern: later words are only looked at, so places may overlap."""
    if not phrase:
        return F.lit(0)
    gap = r"[^\p{L}\p{N}]+"
    rest = "".join(f"{gap}{re.escape(w)}" for w in phrase[1:])
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}]){re.escape(phrase[0])}" + (f"(?={rest})" if rest else "")))


def bm25(chunks: DataFrame, query: str, *, id_col: str, text_cols: list[str], clamp: bool = True) -> DataFrame:
    """Rows of chunks that hold the query as a phrase with a prefix at its end, with `matches`, `length` and `score`.

    The phrase counts as one term; length is that of all indexed columns; larger scores are better. idf is
    ln((N - n + 0.5) / (n + 0.5)), at least 1e-6 if clamped; else ln(1 + that quotient). Two passes over the chunks: one
    aggregate (N, n, mean length: one row, broadcast), one scan; no shuffle but the aggregate's. Right for a single question
    over a small corpus; fulltext.bm25 answers from a stored index.
    """
    words = re.findall(r"[^\W_]+", query.lower())
    texts = [F.coalesce(F.col(c), F.lit("")) for c in text_cols]
    length = sum((term_count(t) for t in texts[1:]), term_count(texts[0]))
    matches = sum((phrase_count(t, words) for t in texts[1:]), phrase_count(texts[0], words))
    # A cheap test first: a text without the first word's letters holds no phrase.
    probe = words[0] if words else ""
    maybe = sum((F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(probe)).cast("int") for c in text_cols), F.lit(0)) > 0
    counted = chunks.withColumn("length", length).withColumn("matches", F.when(maybe, matches).otherwise(0))
    stats = counted.agg(F.count("*").alias("docs"), F.count_if(F.col("matches") > 0).alias("with_term"), F.avg("length").alias("mean_length"))
    odds = (F.col("docs") - F.col("with_term") + 0.5) / (F.col("with_term") + 0.5)
    idf = F.greatest(F.ln(odds), F.lit(1e-6)) if clamp else F.ln(odds + 1)
    tf = F.col("matches")
    score = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return counted.where("matches > 0").crossJoin(F.broadcast(stats)).withColumn("score", score).drop("docs", "with_term", "mean_length")


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order: each partition keeps k, the driver merges them."""
    return rows.orderBy(*order).limit(k)


def keyword_search(chunks: DataFrame, query: str, *, id_col: str = "chunk_id", text_cols: tuple[str, ...] = ("content", "title", "section_header"), type_filter: str | None = None, k: int = 20, snippet_col: str = "content", clamp: bool = True, params: Params = DEFAULT) -> DataFrame:
    """The k best chunks for a query, optionally of one type, with a snippet and a display score."""
    rows = chunks if type_filter is None else chunks.where(F.col("type") == type_filter)
    scored = bm25(rows, query, id_col=id_col, text_cols=list(text_cols), clamp=clamp)
    best = top_k(scored, k, F.desc("score"), F.asc(id_col))
    return best.withColumn("snippet", fn.snippet(F.col(snippet_col), F.lit(query), params.snippet_max_length)).withColumn("display_score", fn.bm25_display(F.col("score")))


def squared_l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: list[float] | Column, k: int, *, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest vectors by squared Euclidean distance, exactly; a metadata filter is applied before."""
    rows = vectors if where is None else vectors.where(where)
    point = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    return top_k(rows.withColumn("distance", squared_l2(F.col(vector_col), point)), k, F.asc("distance"), F.asc(id_col))


def issue_filter(category: str | None = None, severity: str | None = None, file_path: str | None = None) -> Column:
    """The conjunction of those given; true without any."""
    out = F.lit(True)
    for name, value in (("category", category), ("severity", severity), ("file_path", file_path)):
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def query_issues(issues: DataFrame, query: list[float] | None = None, *, category: str | None = None, severity: str | None = None, file_path: str | None = None, limit: int = 50) -> DataFrame:
    """Nearest issues under a filter, or without a query the first by id."""
    where = issue_filter(category, severity, file_path)
    return top_k(issues.where(where), limit, F.asc("id")) if query is None else vector_search(issues, query, limit, where=where)


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Zero-based rank of an (already short) list."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def reciprocal_rank_fusion(semantic: DataFrame, fulltext: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(id, score, the lists' other columns): score is 1 / (k + rank + 1) summed over both lists of (id, rank, ...).

    A list without the id counts as rank params.missing_rank. Of an id that a list holds twice the last rank counts; the
    semantic row's columns win over the full-text row's.
    """

    def last(rows: DataFrame, side: str) -> DataFrame:
        others = [c for c in rows.columns if c not in ("id", "rank")]
        picked = rows.groupBy("id").agg(F.max(F.struct("rank", *others)).alias(side))
        return picked

    both = last(semantic, "s").join(last(fulltext, "f"), "id", "full_outer")
    term = lambda side: 1.0 / (params.rrf_k + F.coalesce(F.col(f"{side}.rank"), F.lit(params.missing_rank)) + 1)
    names = [c for c in dict.fromkeys(semantic.columns + fulltext.columns) if c not in ("id", "rank")]
    value = {c: [F.col(f"{side}.{c}") for side, rows in (("s", semantic), ("f", fulltext)) if c in rows.columns] for c in names}
    return both.select("id", (term("s") + term("f")).alias("score"), *(F.coalesce(*v).alias(c) for c, v in value.items()))


def type_priority(kind: Column) -> Column:
    out = None
    for name, place in TYPE_PRIORITY.items():
        out = F.when(kind == name, place) if out is None else out.when(kind == name, place)
    return out.otherwise(len(TYPE_PRIORITY))


def dedup_key(content: Column, length: int) -> Column:
    """The first characters, stripped, in lower case."""
    return F.lower(fn.strip(F.substring(content, 1, length)))


def prefix_dedup(rows: DataFrame, order: list[Column], *, content_col: str = "content", params: Params = DEFAULT) -> DataFrame:
    """The first row, by values of which smaller ones come first, of those whose contents begin alike.

    An aggregate: rows that begin alike meet before the shuffle, so boilerplate that opens a third of all rows is no task's burden.
    """
    key = F.md5(dedup_key(F.col(content_col), params.dedup_length)).alias("_key")
    first = F.min_by(F.struct(*rows.columns), F.struct(*(c.alias(f"_o{k}") for k, c in enumerate(order)))).alias("_first")
    return rows.groupBy(key).agg(first).select("_first.*")


def hybrid_search(chunks: DataFrame, vectors: DataFrame, query: str, point: list[float] | Column, *, k: int | None = None, text_cols: tuple[str, ...] = ("content",), clamp: bool = True, params: Params = DEFAULT) -> DataFrame:
    """Vector and keyword search, fused by rank, sorted by kind and score, duplicates off: at most k rows.

    chunks: id, content, type, path, title; vectors: the same and embedding. Ids are pages' paths, so chunks of one page
    fall together; rows without a path are dropped on both sides. Each side is cut to k before anything is shuffled.
    """
    k = k or params.result_limit
    wanted = ["content", "type", "path", "title"]
    near = vector_search(vectors.where("path <> ''"), point, k).select(F.col("path").alias("id"), *wanted, "distance", F.col("id").alias("_tie"))
    near = ranked(near, F.asc("distance"), F.asc("_tie")).drop("_tie")
    hits = top_k(bm25(chunks.where("path <> ''"), query, id_col="id", text_cols=list(text_cols), clamp=clamp), k, F.desc("score"), F.asc("id"))
    hits = hits.select(F.col("path").alias("id"), *wanted, fn.bm25_distance(F.col("score")).alias("distance"), F.col("score").alias("_score"), F.col("id").alias("_tie"))
    hits = ranked(hits, F.desc("_score"), F.asc("_tie")).drop("_score", "_tie")
    fused = reciprocal_rank_fusion(near, hits, params)
    order = [F.asc("priority"), F.desc("score"), F.asc("id")]
    fused = fused.withColumn("priority", type_priority(F.col("type")))
    kept = prefix_dedup(fused, [F.col("priority"), -F.col("score"), F.col("id")], params=params)
    return top_k(kept, k, *order)


def confidence(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """One row: how far the distances of an answer's sources can be trusted. No rows: low."""
    strong, best = F.count_if(F.col("distance") < params.strong_match), F.min("distance")
    level = F.when((strong >= params.min_strong_matches) & (best < params.high_confidence), "high").when((strong >= 1) & (best < params.medium_confidence), "medium").otherwise("low")
    return rows.agg(F.count("*").alias("results"), strong.alias("strong_matches"), best.alias("best_distance"), level.alias("confidence"))


def search_quality(semantic: DataFrame, fulltext: DataFrame, used: DataFrame) -> DataFrame:
    """One row: results of each side, whether it had any, and results used."""
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((semantic, "semantic"), (fulltext, "fulltext"), (used, "used"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2]).withColumn("semantic_ok", F.col("semantic") > 0).withColumn("fulltext_ok", F.col("fulltext") > 0)


def pack_context(rows: DataFrame, order: list[Column], budget: int, *, tokens: Column, by: list[str] | None = None) -> DataFrame:
    """Rows in order up to the first that would overflow the token budget, with `running`, the sum so far."""
    window = Window.partitionBy(*by) if by else Window.partitionBy()
    running = F.sum(tokens).over(window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).where(F.col("running") <= budget)
