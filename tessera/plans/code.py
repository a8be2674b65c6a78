"""Queries over sources made from the tables, whose symbols, references and chunks SQL can foretell; walks and gaps of the graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import chunking, exploration, gaps, graph, parsing
from tessera.params import DEFAULT
from tessera.plans import views
from tessera.plans.catalog import query
from tessera.plans.views import sql_view, table

_PARTS = "SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR(20)) AS id, replace(p_name, ' ', '_') AS name, p_size AS size FROM part"
_NL = "chr(10)"


def _source(lines: list[str]) -> str:
    """SQL of a text whose lines hold {id} and {name}, which both engines read alike."""
    quoted = (" || ".join("'" + p.replace("'", "''") + "'" if p not in ("id", "name") else p for p in _cut(line)) or "''" for line in lines)
    return f" || {_NL} || ".join(quoted)


def _cut(line: str) -> list[str]:
    out = []
    for k, part in enumerate(line.replace("{id}", "\0id\0").replace("{name}", "\0name\0").split("\0")):
        if part or k % 2:
            out.append(part)
    return out


TYPESCRIPT = [
    "import { Base } from './base_{id}';",
    "@Tagged({ on: '}' })",
    "export class C{id} extends Base<Map<string, number>> {",
    "  private re = /[}'\"]/g;",
    "  async run_{name}(x: string): Promise<{ a: number }> {",
    "    help_{name}(`${ inner_{id}('}') } {`);",
    "  }",
    "}",
    "export const f_{id} = (a: number) => { return new C{id}(a); };",
    "interface I{id} { m(): void }",
    "type T{id} = { a: I{id} } | null;",
    "enum E{id} { A = 1 }",
    "function g_{name}(s = d_{id}()): void {",
    "  this.api.send_{name}(s);",
    "}",
]
JAVA = [
    "package p;",
    "import java.util.List;",
    "public class C{id} extends Base implements Closeable {",
    "  private static final String S = \"}\";",
    "  @GetMapping(\"/{name}\")",
    "  public List<String> get_{name}(@Valid int i) throws IOException {",
    "    return repo.find(new Q{id}(i)).stream().toList();",
    "  }",
    "  C{id}() { init_{id}(); }",
    "  static class In{id} {",
    "    enum K{id} { A, B }",
    "    void go_{name}() { stop('}'); }",
    "  }",
    "}",
]
PYTHON = [
    "import os_{id}",
    "",
    "class C{id}(Base):",
    "    \"\"\"Doc of {name}.\"\"\"",
    "    def run_{name}(self):",
    "        self.total = help_{name}(1)",
    "        raise ValueError('broken {name}')",
    "",
    "def main_{id}():",
    "    C{id}().run_{name}()",
]


def _rows(*rows: tuple) -> str:
    """A union of one SELECT for each row of expressions, over p."""
    return " UNION ALL ".join(f"SELECT {', '.join(row)} FROM p" for row in rows)


def _symbol(file: str, name: str, kind: str, first: int, last: int, parent: str | None = None) -> tuple:
    return (f"'{file}/' || id AS file_path", f"{_source([name])} AS name", f"'{kind}' AS symbol_type", f"CAST({first} AS INTEGER) AS start_line", f"CAST({last} AS INTEGER) AS end_line", f"{_source([parent]) if parent else 'CAST(NULL AS VARCHAR)'} AS parent")


def _reference(file: str, source: str, target: str, kind: str, line: int) -> tuple:
    return (f"'{file}/' || id AS file_path", f"{_source([source])} AS source", f"{_source([target])} AS target", f"'{kind}' AS reference_type", f"CAST({line} AS INTEGER) AS line")


def _parsed(spark: SparkSession, d: str, lines: list[str], folder: str, extension: str) -> DataFrame:
    """Sources of every part, parsed; file_path is folder/id once more."""
    made = f"SELECT '{folder}/' || id || '.{extension}' AS file_path, {_source(lines)} AS content FROM "
    files = spark.sql(made.replace("{", "{{").replace("}", "}}") + "{p}", p=views.spread(views.rows(spark, d, _PARTS), "k"))
    return parsing.parse(files).withColumn("file_path", F.regexp_replace("file_path", rf"\.{extension}$", ""))


def _references(parsed: DataFrame) -> DataFrame:
    rows = parsing.references_of(parsed)
    return rows.select("file_path", F.substring_index("source", "::", -1).alias("source"), "target", "reference_type", "line")


_SYMBOLS = ["file_path", "name", "symbol_type", "start_line", "end_line", "parent"]


@query(_rows(_symbol("ts", "C{id}", "class", 3, 8), _symbol("ts", "run_{name}", "method", 5, 7, "C{id}"), _symbol("ts", "f_{id}", "function", 9, 9), _symbol("ts", "I{id}", "interface", 10, 10), _symbol("ts", "T{id}", "type_alias", 11, 11), _symbol("ts", "E{id}", "enum", 12, 12), _symbol("ts", "g_{name}", "function", 13, 15)), p=_PARTS)
def typescript_symbols(spark, d):
    return parsing.symbols_of(_parsed(spark, d, TYPESCRIPT, "ts", "ts")).select(*_SYMBOLS)


@query(
    _rows(
        _reference("ts", "C{id}", "Base", "inherits", 3), _reference("ts", "C{id}.run_{name}", "help_{name}", "calls", 6), _reference("ts", "C{id}.run_{name}", "inner_{id}", "calls", 6),
        _reference("ts", "f_{id}", "C{id}", "instantiates", 9), _reference("ts", "g_{name}", "d_{id}", "calls", 13), _reference("ts", "g_{name}", "this.api.send_{name}", "calls", 14),
    ),
    p=_PARTS,
)
def typescript_references(spark, d):
    return _references(_parsed(spark, d, TYPESCRIPT, "ts", "ts"))


@query(_rows(_symbol("j", "C{id}", "class", 3, 14), _symbol("j", "get_{name}", "route", 6, 8, "C{id}"), _symbol("j", "C{id}", "method", 9, 9, "C{id}"), _symbol("j", "In{id}", "class", 10, 13), _symbol("j", "K{id}", "enum", 11, 11), _symbol("j", "go_{name}", "method", 12, 12, "In{id}")), p=_PARTS)
def java_symbols(spark, d):
    return parsing.symbols_of(_parsed(spark, d, JAVA, "j", "java")).select(*_SYMBOLS)


@query(
    _rows(
        _reference("j", "C{id}", "Base", "inherits", 3), _reference("j", "C{id}", "Closeable", "inherits", 3), _reference("j", "C{id}.get_{name}", "repo.find", "calls", 7), _reference("j", "C{id}.get_{name}", "Q{id}", "instantiates", 7),
        _reference("j", "C{id}.C{id}", "init_{id}", "calls", 9), _reference("j", "In{id}.go_{name}", "stop", "calls", 12),
    ),
    p=_PARTS,
)
def java_references(spark, d):
    return _references(_parsed(spark, d, JAVA, "j", "java"))


@query(_rows(_symbol("py", "C{id}", "class", 3, 7), _symbol("py", "run_{name}", "method", 5, 7, "C{id}"), _symbol("py", "main_{id}", "function", 9, 10)), p=_PARTS)
def python_symbols(spark, d):
    return parsing.symbols_of(_parsed(spark, d, PYTHON, "py", "py")).select(*_SYMBOLS)


@query("SELECT 'py/' || id AS file_path, 'run_' || name AS name, 'ValueError' AS raises, 'broken ' || name AS said FROM p", p=_PARTS)
def python_behaviour(spark, d):
    rows = parsing.symbols_of(_parsed(spark, d, PYTHON, "py", "py")).where("size(raises) > 0")
    return rows.select("file_path", "name", F.array_join("raises", "|").alias("raises"), F.array_join("error_strings", "|").alias("said"))


# Chunks

_TOKENS = 100
_LINES = f"SELECT *, CAST(floor({4 * _TOKENS}.0 / ((n * (w + 1) - 1) / n)) AS BIGINT) AS step FROM (SELECT p_partkey AS k, 20 + p_size % 30 AS w, 50 + p_partkey % 400 AS n FROM part)"


@query("SELECT CAST(k AS VARCHAR) || '.txt' AS file_path, CAST(c AS INTEGER) AS chunk_index, CAST(c * (step - 5) + 1 AS INTEGER) AS start_line, CAST(least(c * (step - 5) + step, n) AS INTEGER) AS end_line FROM (SELECT *, unnest(range(0, CAST(ceil(greatest(n - step, 0) / (step - 5)) AS BIGINT) + 1)) AS c FROM l)", l=_LINES)
def line_chunks(spark, d):
    """Files of lines of one length each, cut at 100 tokens with five lines of overlap."""
    line = F.repeat(F.lit("x"), (20 + F.col("p_size") % 30).cast("int"))
    content = F.array_join(F.array_repeat(line, (50 + F.col("p_partkey") % 400).cast("int")), "\n")
    files = views.spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")).alias("file_path"), content.alias("content"))
    return chunking.chunk_lines(files, replace(DEFAULT, chunk_tokens=_TOKENS)).select("file_path", "chunk_index", "start_line", "end_line")


_FUNCTIONS = f"SELECT *, greatest(1, CAST(ceil({4 * _TOKENS + 5} / (m * (w + 1))) AS BIGINT) - 1) AS c FROM (SELECT p_partkey AS k, 20 + p_size % 30 AS w, 3 + p_partkey % 4 AS m, 5 + p_partkey % 20 AS n FROM part)"


@query("SELECT CAST(k AS VARCHAR) || '.py' AS file_path, CAST(i AS INTEGER) AS chunk_index, CAST(i * c * m + 1 AS INTEGER) AS start_line, CAST(least((i + 1) * c, n) * m AS INTEGER) AS end_line, CAST(least(c, n - i * c) AS INTEGER) AS symbols FROM (SELECT *, unnest(range(0, CAST(ceil(n / c) AS BIGINT))) AS i FROM f)", f=_FUNCTIONS)
def symbol_chunks(spark, d):
    """Files of functions of one size each, packed up to 100 tokens."""
    k = F.col("p_partkey")
    m, n = (3 + k % 4).cast("int"), (5 + k % 20).cast("int")
    line = F.repeat(F.lit("x"), (20 + F.col("p_size") % 30).cast("int"))
    path = F.concat(k.cast("string"), F.lit(".py")).alias("file_path")
    part = views.spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    i = F.col("i")
    own = part.select(path, m.alias("m"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    own = own.select("file_path", (i * F.col("m") + 1).alias("start_line"), ((i + 1) * F.col("m")).alias("end_line"), F.concat(F.lit("f"), i.cast("string")).alias("name"))
    files = part.select(path, F.array_join(F.array_repeat(line, m * n), "\n").alias("content"))
    return chunking.chunk_symbols(files, own, replace(DEFAULT, chunk_tokens=_TOKENS)).select("file_path", "chunk_index", "start_line", "end_line", F.size("symbols").alias("symbols"))


# Gaps and flows

_ASKED = "SELECT p_partkey AS question, CAST(p_partkey % 7 AS VARCHAR) AS a, CAST(p_partkey % 5 AS VARCHAR) AS b, p_partkey % 3 AS way FROM part"


@query(
    "SELECT question, CASE WHEN way = 2 THEN 'third' ELSE 'second' END AS answer, CAST(CASE WHEN way = 2 THEN 3 ELSE 2 END AS INTEGER) AS passes, 'known_a' || a || CASE WHEN way = 2 THEN '|known_c' ELSE '' END || '|lost_b' || b || CASE WHEN way = 2 THEN '|lost_d' ELSE '' END AS identified, 'known_a' || a || CASE WHEN way = 2 THEN '|known_c' ELSE '' END AS resolved, 'lost_b' || b || CASE WHEN way = 2 THEN '|lost_d' ELSE '' END AS unresolved FROM q",
    q=_ASKED,
)
def gap_loop(spark, d):
    """A question for each part, with answers as data: a third end without gaps, a third repeat a gap that was not found, a third go on."""
    k = F.col("question")
    first = F.concat(F.lit("<answer>first</answer><missing>- known_a"), (k % 7).cast("string"), F.lit("\n- lost_b"), (k % 5).cast("string"), F.lit("</missing>"))
    second = F.concat(F.lit("<answer>second</answer><missing>"), F.when(k % 3 == 0, "NONE").when(k % 3 == 1, F.concat(F.lit("- lost_b"), (k % 5).cast("string"))).otherwise("- known_c"), F.lit("</missing>"))
    third = F.lit("<answer>third</answer><missing>- lost_d</missing>")
    answer = lambda open_: open_.select("question", F.when(F.col("pass") == 1, first).when(F.col("pass") == 2, second).otherwise(third).alias("response"))
    resolve = lambda wanted: wanted.where("gap like 'known%'").select("gap", F.concat(F.lit("text of "), F.col("gap")).alias("content"))
    questions = table(spark, d, "part").select(F.col("p_partkey").alias("question"), F.lit("context").alias("context"))
    found = gaps.summary(*gaps.gap_rounds(questions, answer, resolve))
    return found.select("question", "answer", "passes", *(F.array_join(c, "|").alias(c) for c in ("identified", "resolved", "unresolved")))


_BUDGET = 3000
_PACKED = dict(
    nodes=views.NODES,
    edges=views.EDGES,
    lines="SELECT 0 AS k, '' AS s, 'flowchart LR' AS line UNION ALL SELECT 1, id, '    ' || id || '[\"' || name || '\"]' FROM nodes UNION ALL SELECT 2, source || chr(0) || target, '    ' || source || ' -->|' || type || '| ' || target FROM edges",
    running="SELECT *, row_number() OVER (ORDER BY k, s, line) - 1 AS pos, sum(greatest(length(line) // 4, 1)) OVER (ORDER BY k, s, line ROWS UNBOUNDED PRECEDING) AS running FROM lines",
    drawn=f"SELECT * FROM running WHERE running <= {DEFAULT.diagram_token_budget}",
    ends="SELECT source AS id FROM edges UNION ALL SELECT target FROM edges",
    degree="SELECT id, count(*) AS degree FROM ends GROUP BY 1",
    snippets="SELECT n.id, coalesce(degree, 0) AS degree, '### ' || file_path || ':' || CAST(line_start AS VARCHAR) || '-' || CAST(line_end AS VARCHAR) || chr(10) || signature AS line FROM nodes n LEFT JOIN degree g ON g.id = n.id",
    summed="SELECT *, row_number() OVER (ORDER BY degree DESC, id) - 1 AS pos, sum(greatest(length(line) // 4, 1)) OVER (ORDER BY degree DESC, id ROWS UNBOUNDED PRECEDING) AS running FROM snippets",
)


@query(f"SELECT 'diagram' AS part, CAST(pos AS INTEGER) AS pos, line FROM drawn UNION ALL SELECT 'code', CAST(pos AS INTEGER), line FROM summed WHERE running <= {_BUDGET} - (SELECT sum(length(line) // 4) FROM drawn)", **_PACKED)
def graph_packing(spark, d):
    return graph.pack_graph_context(sql_view(spark, d, "nodes"), sql_view(spark, d, "edges"), _BUDGET)


_SUBJECTS = dict(
    f=views.FULL_INDEX,
    q="SELECT DISTINCT symbol_name AS question FROM f",
    e="SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY CASE symbol_type WHEN 'route' THEN 0 WHEN 'function' THEN 1 ELSE 2 END, id) AS entry FROM q JOIN f ON symbol_name = question",
)


@query("SELECT question, CAST(entry AS INTEGER) AS entry, id FROM e WHERE entry <= 2", **_SUBJECTS)
def flow_entries(spark, d):
    """Entry points of a question about each symbol name of the index."""
    index = sql_view(spark, d, "full_index")
    questions = index.select(F.col("symbol_name").alias("question"), F.col("symbol_name").alias("subject")).distinct()
    return exploration.entry_rows(index, questions).select("question", "entry", "id")


@query()
def exploratory_contexts(spark, d):
    """A question about each symbol name, traced in one plan: the flow as text and its first rows. Tested by a walk in plain Python."""
    index = views.full_index(spark, d)
    questions = index.select(F.col("symbol_name").alias("question"), F.col("symbol_name").alias("subject")).distinct()
    return exploration.exploratory_context(index, questions)


@query("SELECT question, trim(subject) AS subject FROM (SELECT p_partkey AS question, 'trace the ' || lower(replace(p_name, ' ', '')) || ' flow' AS q, lower(replace(p_name, ' ', '')) AS subject FROM part)")
def traced_subjects(spark, d):
    q = F.concat(F.lit("trace the "), F.lower(F.replace("p_name", F.lit(" "), F.lit(""))), F.lit(" flow"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("question"), fn.trace_subject(q).alias("subject"))
