"""Views that give the engine's tables a body in a star schema: documents as pages, parts as symbols, line items as references."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Each view as SQL that both engines run; {n_parts} and the like are scalar subqueries.
PATHS = "SELECT doc_id, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) || '.py' AS path, text, source, lang FROM documents"
NODES = """SELECT 'p' || CAST(p_partkey AS VARCHAR(20)) AS id, replace(p_name, ' ', '_') AS name, 'function' AS type,
 CASE WHEN p_size % 10 = 0 THEN 'tests/' ELSE '' END || lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '/m' || CAST(p_size AS VARCHAR(20)) || '.py' AS file_path,
 CAST(p_partkey % 500 + 1 AS INTEGER) AS line_start, CAST(p_partkey % 500 + 9 AS INTEGER) AS line_end, '' AS docstring, p_name AS signature, CAST(NULL AS VARCHAR(20)) AS parent FROM part"""
_REFS = """SELECT 'p' || CAST(l_partkey AS VARCHAR(20)) AS source, 'p' || CAST((l_partkey * 7 + l_suppkey * 3 + l_linenumber) % (SELECT count(*) FROM part) AS VARCHAR(20)) AS target,
 CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'calls' WHEN l_returnflag = 'A' THEN 'instantiates' ELSE 'imports' END AS type, round(1 - l_discount * 5, 2) AS confidence, l_linenumber AS line,
 l_orderkey AS o1, l_extendedprice AS o2, l_quantity AS o3, l_tax AS o4, l_shipdate AS o5 FROM lineitem"""
EDGES = f"""SELECT source, target, type, confidence, line FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY o1 DESC, line DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC, type DESC, confidence DESC) AS rn FROM ({_REFS}) r) e WHERE rn = 1"""
SYMBOLS = "SELECT 's' || CAST(s_suppkey AS VARCHAR(20)) AS id, n_name AS name, s_name || '.' || n_name AS qualified FROM supplier JOIN nation ON s_nationkey = n_nationkey"
REFS = "SELECT l_orderkey, l_linenumber, l_extendedprice, 's' || CAST(l_suppkey AS VARCHAR(20)) AS source, CASE WHEN l_linenumber = 7 THEN 'NOWHERE' ELSE 'NATION_' || CAST(l_partkey % 25 AS VARCHAR(20)) END AS target, 1 - l_discount AS confidence FROM lineitem"
IMPORTS = "SELECT DISTINCT lower(a.p_type) || '/' || lower(replace(a.p_brand, '#', '')) || '.py' AS source, lower(b.p_type) || '/' || lower(replace(b.p_brand, '#', '')) || '.py' AS target FROM lineitem JOIN part a ON l_partkey = a.p_partkey JOIN part b ON (l_partkey * 7 + l_suppkey * 3) % (SELECT count(*) FROM part) = b.p_partkey WHERE l_linenumber = 1 AND l_returnflag = 'R'"
SUMMARIES = "SELECT 'f' || CAST(p_partkey AS VARCHAR(20)) || '.py' AS file_path, CASE p_type WHEN 'ECONOMY' THEN 'api' WHEN 'LARGE' THEN 'domain' WHEN 'MEDIUM' THEN 'infrastructure' WHEN 'PROMO' THEN 'config' WHEN 'SMALL' THEN 'test' ELSE 'utility' END AS layer, p_name AS purpose, p_brand AS dep FROM part"
JOBS = "SELECT CAST(user_id AS VARCHAR(20)) AS id, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status, value FROM events"
NOTES = "SELECT CASE o_orderstatus WHEN 'P' THEN 'general' WHEN 'F' THEN 'file' ELSE 'directory' END AS scope, CAST(o_custkey AS VARCHAR(20)) AS target, o_orderpriority AS content, 'a' AS author, o_orderdate AS updated_at, o_orderkey AS seq FROM orders"
CALL_INDEX = "SELECT p_partkey AS id, replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 40 AS VARCHAR(20)) AS symbol_name, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.py' AS file_path FROM part"

# Arrays are made by split, and lines of code by chr(10), which both engines read alike.
FULL_INDEX = """SELECT p_partkey AS id, lower(p_type) || '/' || lower(replace(p_brand, '#', '')) || '.py' AS file_path, replace(p_name, ' ', '_') || '_' || CAST(p_partkey % 40 AS VARCHAR(20)) AS symbol_name,
 CASE p_size % 4 WHEN 0 THEN 'route' WHEN 1 THEN 'function' WHEN 2 THEN 'method' ELSE 'class' END AS symbol_type, CAST(p_partkey % 500 + 1 AS INTEGER) AS line_start, CAST(p_partkey % 500 + 9 AS INTEGER) AS line_end,
 'def ' || replace(p_name, ' ', '_') || '()' AS signature, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'Makes a ' || p_name || '.' END AS docstring,
 split(CASE p_size % 5 WHEN 0 THEN 'ValueError,KeyError' WHEN 1 THEN 'OSError' ELSE 'none' END, ',') AS raises, split(CASE p_size % 7 WHEN 0 THEN '_cache,total' WHEN 1 THEN 'total' ELSE 'none' END, ',') AS mutates,
 split('no such ' || p_name || ',bad value', ',') AS error_strings FROM part"""
DECORATED = """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'serve' ELSE replace(p_name, ' ', '_') END AS name, CASE p_partkey % 9 WHEN 0 THEN 'cli_command' WHEN 1 THEN 'route' ELSE 'function' END AS symbol_type,
 split(CASE p_partkey % 5 WHEN 0 THEN 'click.group' WHEN 1 THEN 'staticmethod,app.get' WHEN 2 THEN 'x.router.post' WHEN 3 THEN 'property' ELSE 'cache.setter' END, ',') AS decorators FROM part"""
PAGE_TABLE = """SELECT 'files/' || source || '-' || lang || '-' || CAST(doc_id AS VARCHAR(20)) || '-py.md' AS path, CASE doc_id % 5 WHEN 0 THEN 'directory' WHEN 1 THEN 'workflow' ELSE 'file' END AS type, source || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) || '.py' AS target,
 CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE sha256text END AS source_hash, DATE '1997-01-01' AS generated_at, CASE WHEN doc_id % 4 = 0 THEN 'gone/' || CAST(doc_id AS VARCHAR(20)) ELSE source || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) || '.py' END AS source FROM (SELECT doc_id, source, lang, {sha} AS sha256text FROM documents) x"""
QUESTIONS = """SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 'Trace the ' || p_name || ' please' WHEN 1 THEN 'explain ' || replace(p_name, ' ', '') || ' flow' WHEN 2 THEN 'How does the thing work' WHEN 3 THEN 'walk through ' || p_brand
 WHEN 4 THEN 'Any flaws in the ' || p_name || ' part?' WHEN 5 THEN 'Analyze ' || p_type || ' now' WHEN 6 THEN 'what''s wrong with this ' || p_name WHEN 7 THEN lower(p_type) || ' architecture'
 WHEN 8 THEN 'See ' || replace(p_name, ' ', '_') || '() in src/' || lower(p_type) || '.tsx or b.go' ELSE 'the function ' || replace(p_name, ' ', '_') || ' of a/' || lower(p_type) || '.py' END AS q, replace(p_name, ' ', '_') AS name, p_name, p_type, p_brand, p_partkey % 10 AS k FROM part"""

_NAMES = {"paths": PATHS, "nodes": NODES, "edges": EDGES, "symbols": SYMBOLS, "refs": REFS, "imports": IMPORTS, "summaries": SUMMARIES, "jobs": JOBS, "notes": NOTES, "call_index": CALL_INDEX, "decorated": DECORATED, "questions": QUESTIONS, "full_index": FULL_INDEX}


def sql_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view above as a DataFrame over the tables of a folder."""
    return rows(spark, sf_dir, _NAMES[name])


def rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL that both engines run, over the tables of a folder; nothing is registered in the session's catalog."""
    text = text.replace("VARCHAR(20)", "STRING").replace("{", "{{").replace("}", "}}")
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
    return spark.sql(re.sub(r"\b(FROM|JOIN) (" + "|".join(used) + r")\b", r"\1 {\2}", text), **{t: table(spark, sf_dir, t) for t in used})


#: Rows of a table that one task turns into texts, about.
ROWS_PER_TASK = 4_000


def spread(df: DataFrame, key: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of a small table from which much is made, dealt to as many tasks as their number asks for, before it is made.

    A file of a few megabytes is one or two tasks however many texts come of its rows, and adaptive execution counts the
    bytes of the rows only.
    """
    return df.repartition(math.ceil(df.count() / per_task) or 1, key)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code index: symbols of parts; what each calls, by line items in order of order and line."""
    names = sql_view(spark, sf_dir, "call_index")
    edges = sql_view(spark, sf_dir, "edges").where("type = 'calls'")
    callee = names.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("target"), F.col("symbol_name").alias("callee"))
    calls = edges.join(callee, "target").groupBy("source").agg(F.array_sort(F.collect_list("callee")).alias("calls"))
    out = names.join(calls, F.concat(F.lit("p"), F.col("id").cast("string")) == F.col("source"), "left")
    return out.select("id", "file_path", "symbol_name", F.coalesce("calls", F.array().cast("array<string>")).alias("calls"))


def full_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code index with all its columns."""
    calls = index(spark, sf_dir).select("id", "calls")
    return sql_view(spark, sf_dir, "full_index").join(calls, "id").withColumn("called_by", F.array().cast("array<string>"))


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir, PAGE_TABLE.format(sha="sha2(text, 256)"))
