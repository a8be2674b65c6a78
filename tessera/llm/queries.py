"""One query for each operator of this package, over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ann, bpecount, chat, filter_audit, jaccard, langid, licenses, minhash, packing, pii, quality, ranked_search, spm

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Key of the queries' surrogates; a deployment passes its own secret to pii.pseudonymise.
DEMO_KEY = b"tessera demonstration key"
#: Tokens to a window of op4, and of repeated turns in it: most of the tables' conversations take several windows.
CHAT_BUDGET, CHAT_HISTORY = 384, 96
LOOP_TEXT = "</s>[INST] ok [/INST]"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced: doc_id, text, n_entities."""
    return pii.pseudonymise(_read(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.is_held_out())
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    loop = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(LOOP_TEXT))
    return chat.read_back(chat.windows(turns.union(loop), budget=CHAT_BUDGET, history=CHAT_HISTORY))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), ids=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_first(_read(spark, sf_dir, "documents"), with_text=False)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpecount.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    return out.withColumn("notices", F.array_join("notices", ","))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(_read(spark, sf_dir, "documents"))


def op11_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build(_read(spark, sf_dir, "documents"))
    found = ranked_search.search(spark, index, _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_surrogates, op2_best_fit_packing, op3_language_id, op4_chat_windows, op5_nearest_neighbours, op6_sentencepiece, op7_quality_rules, op8_token_counts, op9_license_scan, op10_ngram_jaccard, op11_minhash_hamming, op12_filter_audit, op13_ranked_search)
} | {"pipeline": pipeline}


def _canonical_sql(column: str) -> str:
    """The expression of licenses.canonical in SQL."""
    out = f"regexp_replace({column}, '\\r\\n?', chr(10), 'g')"
    out = f"regexp_replace({out}, '(?im)^[ \\t/*#;.-]*(?:copyright\\b[ \\t]*(?:\\(c\\)|©|\\d{{4}}|[<\\[{{(])|\\(c\\)[ \\t]*(?:copyright|\\d{{4}})|©).*$', ' ', 'g')"
    out = f"' ' || trim(regexp_replace(lower({out}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    for variant, chosen in licenses.EQUIVALENT:
        out = f"replace({out}, ' {variant} ', ' {chosen} ')"
    return f"trim({out})"


def _licenses_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in licenses.LICENCES + licenses.NOTICES + licenses.long_texts())
    return f"""
WITH known AS (SELECT sha256({_canonical_sql('t')}) AS digest, min(l) AS license FROM (VALUES {rows}) AS v(l, t) GROUP BY 1 HAVING digest <> sha256('')),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
hits AS (SELECT doc_id, license FROM (SELECT doc_id, {_canonical_sql('line')} AS c FROM lines) JOIN known ON digest = sha256(c)),
notes AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, CAST(count(*) AS INTEGER) AS n_notices FROM hits GROUP BY 1),
whole AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices
FROM whole w LEFT JOIN known k ON w.digest = k.digest LEFT JOIN notes n ON w.doc_id = n.doc_id"""


_AUDIT_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM base),
flags AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, doc_id > least AS e FROM words),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
counts AS (SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM flags LEFT JOIN marks USING (doc_id) GROUP BY 1, 2),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
orders AS (SELECT p.l || q.l || r.l || s.l || u.l AS o FROM letter p, letter q, letter r, letter s, letter u WHERE p.bit + q.bit + r.bit + s.bit + u.bit = 31 AND p.bit | q.bit | r.bit | s.bit | u.bit = 31),
steps AS (SELECT o, k AS step, l.bit, (SELECT coalesce(sum(x.bit), 0) FROM letter x WHERE instr(substr(o, 1, CAST(k AS INT) - 1), x.l) > 0) AS before FROM orders, range(1, 6) g(k), letter l WHERE l.l = substr(o, CAST(k AS INT), 1)),
cells AS (
  SELECT part, o, step, s.bit,
    sum(CASE WHEN m & (bit | CAST(before AS INT)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN m & bit <> 0 AND m & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN m & bit <> 0 AND m & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN m & bit <> 0 AND m & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN m & bit <> 0 AND m & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps s GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM cells"""

_SEARCH_SQL = r"""
WITH found AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM found GROUP BY 1),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weighed AS (SELECT item_id, term, count(*) AS times, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN df USING (term), whole GROUP BY 1, 2, docs, df),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score FROM weighed JOIN tf USING (term) JOIN sizes USING (doc_id), whole GROUP BY 1, 2)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored WHERE score > 0) WHERE rank <= 10"""


def _near_sql(percent: int, kept: str = "") -> str:
    """Classes of near duplicates: shingles meet, links are closed transitively."""
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words WHERE w IS NOT NULL),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= {percent} * (s.n + t.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id{kept} FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op9_license_scan": _licenses_sql(),
    "op10_ngram_jaccard": _near_sql(80),
    "op11_minhash_hamming": _near_sql(85, ", coalesce(least(doc_id, b), doc_id) = doc_id AS kept"),
    "op12_filter_audit": _AUDIT_SQL,
    "op13_ranked_search": _SEARCH_SQL,
}
