"""Which files belong to the corpus: exclusion patterns, size, binary and minified tests, directories."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.params import DEFAULT, Params

# What is never documented.
DEFAULT_EXCLUDES = [
    ".*",
    "node_modules", "vendor", "venv", "__pycache__", "*.pyc",
    "build", "dist", "target", "out",
    "*.min.js", "*.min.css", "*.bundle.js", "*.chunk.js", "*.map",
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock",
]
# Files that hold no code, by extension and by name.
NON_CODE_EXTENSIONS = [".md", ".rst", ".txt", ".adoc", ".asciidoc", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".xml", ".csv", ".tsv", ".lock", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".log", ".pid", ".env"]
NON_CODE_NAMES = ["readme", "license", "copying", "changelog", "changes", "authors", "contributors", "contributing", "makefile", "dockerfile", "vagrantfile", "gemfile", "pipfile", "setup.py", ".gitignore", ".gitattributes", ".dockerignore", ".editorconfig", ".prettierrc", ".eslintrc"]
# Languages by extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "scala": "scala", "sh": "shell", "bash": "shell", "pl": "perl", "pm": "perl", "lua": "lua", "r": "r", "sql": "sql", "html": "html", "css": "css", "scss": "scss",
    "vue": "vue", "svelte": "svelte", "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "clj": "clojure", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown",
}


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a shell pattern in which `*` and `?` also match slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end
        else:
            out.append({"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c, re.escape(c)))
        i += 1
    return f"^(?:{''.join(out)})$"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def excluded(path: Column, patterns: list[str], allowed: list[str] | None = None) -> Column:
    """Whether a path is left out. `dir/` and bare patterns match any component, `a/b` the path or a folder above; allowed folders win.

    All bare patterns make one alternation, so a component is matched once, not once for each pattern.
    """
    allowed = [f"{DEFAULT.wiki_dir}/notes"] if allowed is None else allowed
    bare = [p.rstrip("/") for p in patterns if p.endswith("/") or "/" not in p]
    plain = [p for p in patterns if "/" not in p]
    deep = [p for p in patterns if "/" in p.rstrip("/") and not p.endswith("/")]
    tests = []
    if bare:
        every = "|".join(glob_regex(p) for p in dict.fromkeys(bare))
        tests.append(F.exists(F.split(path, "/"), lambda c: c.rlike(every)))
    if plain:
        tests.append(path.rlike("|".join(glob_regex(p) for p in plain)))
    for p in deep:
        tests.append((path == p) | path.startswith(p + "/") | path.rlike(glob_regex(p)))
    spared = _any([(path == a) | path.startswith(a + "/") for a in allowed])
    return ~spared & _any(tests)


def ancestors(path: Column) -> Column:
    """All proper ancestor directories of a path, the root not among them."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path: Column) -> Column:
    """The directory a path is in; the root is empty."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def has_excluded_ancestor(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Files with an ancestor among directories (one column, path): an equi-join on exploded ancestors, not a prefix test on all pairs."""
    found = files.select("path", F.explode(ancestors(F.col("path"))).alias("directory")).join(directories.select(F.col("path").alias("directory")), "directory", "left_semi")
    return files.join(found.select("path").distinct(), "path", "left_semi")


def is_binary(content: Column, check_bytes: int = DEFAULT.binary_check_bytes) -> Column:
    """A NUL among the first bytes; null content (an unreadable file) is binary."""
    return F.coalesce(F.hex(F.substring(content, 1, check_bytes)).rlike("^(?:..)*?00"), F.lit(True))


def is_minified(text: Column, longest: int = DEFAULT.minified_line_length) -> Column:
    """Whether the first 20 lines are longer than that on average; what follows them stays one piece."""
    lines = F.slice(F.split(text, "\n", 21), 1, 20)
    return F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x)) / F.size(lines) > longest


def is_test_graph(path: Column) -> Column:
    """Test files as graph analysis sees them."""
    return path.rlike(r"(?:^|/)tests?/|test_[^/]+\.py$|_test\.py$|\.test\.[jt]sx?$|\.spec\.[jt]sx?$|__tests__/")


def is_test_snippet(path: Column) -> Column:
    """Test files as call-site choice sees them: by name, special file or folder."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ends = _any([name.endswith(e) for e in ("_test.py", "_spec.py", ".test.js", ".spec.js", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx")])
    return name.startswith("test_") | ends | name.isin("conftest.py", "fixtures.py") | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ("tests", "test", "spec", "__tests__"))))


def is_non_code(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "([^/]*)$", 1))
    extension = F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1)
    return extension.isin(*NON_CODE_EXTENSIONS) | name.isin(*NON_CODE_NAMES)


def language(path: Column) -> Column:
    """By extension; `text` if it is unknown."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("text"))


def categorize(files: DataFrame, user_patterns: list[str], params: Params = DEFAULT, default_patterns: list[str] | None = None) -> DataFrame:
    """files (path, length, content) with `category`: included, excluded_by_rule or excluded_by_ignore, in that order of tests."""
    rule = excluded(F.col("path"), DEFAULT_EXCLUDES if default_patterns is None else default_patterns)
    own = excluded(F.col("path"), user_patterns)
    unfit = (F.col("length") > params.max_file_size_kb * 1024) | is_binary(F.col("content"), params.binary_check_bytes) | is_minified(F.col("content").cast("string"), params.minified_line_length)
    return files.withColumn("category", F.when(rule, "excluded_by_rule").when(own, "excluded_by_ignore").when(unfit, "excluded_by_rule").otherwise("included"))


def collapse_directories(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(path) the top-most excluded directories of files: shown instead of what is below them."""
    each = files.select(F.explode(F.transform(ancestors(F.col("path")), lambda d: F.struct(d.alias("path"), excluded(d, patterns).alias("out")))).alias("d")).select("d.*").distinct()
    out = each.where("out").select("path")
    return out.join(has_excluded_ancestor(out, out), "path", "left_anti")


def included(files: DataFrame, user_patterns: list[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """Files (path, length, content) that belong to the corpus. Path and size tests run before any content is read."""
    patterns = DEFAULT_EXCLUDES + (user_patterns or [])
    kept = files.where(~excluded(F.col("path"), patterns)).where(F.col("length") <= params.max_file_size_kb * 1024)
    return kept.where(~is_binary(F.col("content"), params.binary_check_bytes)).where(~is_minified(F.col("content").cast("string"), params.minified_line_length))


def scan(files: DataFrame, user_patterns: list[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """included, sorted by path."""
    return included(files, user_patterns, params).orderBy("path")


def directories(files: DataFrame) -> DataFrame:
    """(path) all directories above files, the root as an empty path."""
    rows = files.select(F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("path"))
    return rows.distinct()


def merge_directories(files: DataFrame, more: DataFrame) -> DataFrame:
    """Directories of files and explicit ones, without the root."""
    return directories(files).union(more.select("path")).distinct().where("path <> ''")


def depth(directory: Column) -> Column:
    """Slashes in a directory's path; -1 for the root."""
    return F.when(directory == "", -1).otherwise(F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit(""))))


def directories_by_depth(rows: DataFrame) -> DataFrame:
    return rows.groupBy(depth(F.col("path")).alias("depth")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def processing_order(rows: DataFrame) -> DataFrame:
    """Deepest directories first, by name within a depth, the root last."""
    return rows.withColumn("depth", depth(F.col("path"))).orderBy(F.desc("depth"), "path")


def direct_children(summaries: DataFrame, *, path_col: str = "path") -> DataFrame:
    """(parent, child): each directory and those right below it, by an equi-join on the parent's path."""
    child = summaries.select(F.col(path_col).alias("child"), parent(F.col(path_col)).alias("parent")).where("child <> ''")
    return child.join(summaries.select(F.col(path_col).alias("parent")), "parent", "left_semi")


def files_by_directory(files: DataFrame) -> DataFrame:
    """(directory, paths): each directory's own files; those at the root under the empty path."""
    return files.groupBy(parent(F.col("path")).alias("directory")).agg(F.array_sort(F.collect_list("path")).alias("paths"))


def symbols_below(symbols: DataFrame) -> DataFrame:
    """symbols once for each directory above their file; those of root files under the empty path."""
    above = ancestors(F.col("file_path"))
    return symbols.withColumn("directory", F.explode(F.when(F.size(above) > 0, above).otherwise(F.array(F.lit("")))))


def preview_search(files: DataFrame, term: str, pending: DataFrame) -> DataFrame:
    """Paths that contain a term in any case, those below a pending exclusion hidden."""
    rows = files.where(F.contains(F.lower("path"), F.lit(term.lower())))
    return rows.join(has_excluded_ancestor(rows, pending).select("path"), "path", "left_anti")


def next_match(entries: DataFrame, term: str, current: int) -> DataFrame:
    """The first entry (pos, text) after `current` that contains a term, from the top again after the last."""
    rows = entries.where(F.contains(F.lower("text"), F.lit(term.lower())))
    return rows.orderBy(F.col("pos") <= current, "pos").limit(1)


def edit_ignore_file(lines: DataFrame, remove: list[str], add_directories: list[str], add_files: list[str]) -> DataFrame:
    """(pos, line) of an ignore file after an edit: removals first (with or without a slash), then new directories with a slash, then files not below one of them; comments keep their place, repeats go."""
    gone = [x.rstrip("/") for x in remove]
    kept = lines.where(~F.regexp_replace("line", "/+$", "").isin(*gone) | F.col("line").startswith("#")) if gone else lines
    folders = [d.rstrip("/") + "/" for d in add_directories]
    new = folders + [f for f in add_files if not any(f.startswith(d) for d in folders)]
    spark = lines.sparkSession
    start = lines.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    added = spark.createDataFrame(list(enumerate(new, 1)), "k int, line string").crossJoin(F.broadcast(start)).select((F.col("last") + F.col("k")).cast(lines.schema["pos"].dataType).alias("pos"), "line")
    rows = kept.select("pos", "line").unionByName(added)
    comment = F.col("line").startswith("#") | (F.trim("line") == "")
    firsts = rows.where(~comment).groupBy("line").agg(F.min("pos").alias("pos")).select("pos", "line")
    return rows.where(comment).unionByName(firsts).orderBy("pos")
