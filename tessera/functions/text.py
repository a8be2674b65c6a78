"""Scalar functions on columns: tokens, slugs, hashes, snippets, answers and anchors, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of source files that a gap may name, and those that page paths are turned back into.
SOURCE_EXTENSIONS = ["pyi", "py", "tsx", "ts", "jsx", "js", "java", "go", "rs", "rb", "cpp", "hpp", "cs", "swift", "kt", "scala", "php", "vue", "svelte", "c", "h"]
_PAGE_EXTENSIONS = ["py", "ts", "js", "tsx", "jsx", "java", "go", "rs", "rb"]
# Quoted texts, files of a stack trace, bare files and functions of a trace's lines, as questions hold them.
QUOTED_TEXT = r"[\"']([^\"']{5,})[\"']"
TRACE_FILE = r"File\s+\"([^\"]+\.py)\""
BARE_FILE = r"\b([\w/]+\.(?:py|ts|js|java))\b"
TRACE_FUNCTION = r"line\s+\d+,?\s+in\s+(\w+)"
# Phrases of a question in which _ is the subject; of several the first in this list counts. (the) is any article or none.
TRACE_PHRASES = ["trace (the) _", "_ flow", "how does _", "walk through (the) _", "_ path"]
SCOPE_PHRASES = [
    "flaw in (the) _", "flaws in (the) _", "problem in (the) _", "problems in (the) _", "issue in (the) _", "issues in (the) _",
    "flaw with (the) _", "flaws with (the) _", "problem with (the) _", "problems with (the) _", "issue with (the) _", "issues with (the) _",
    "analyze (the) _", "what's wrong with (the) _", "whats wrong with (the) _", "_ structure", "_ architecture", "_ design",
]
ARTICLES = ["the", "a", "an", "this"]
# Words that are no subject of a trace, or of an analysis.
NO_TRACE_SUBJECT = ["the", "a", "an", "this", "that", "code", "it"]
NO_SCOPE = ["the", "a", "an", "this", "code"]
# How the names of exceptions end, and what announces a function's name in a gap.
EXCEPTION_ENDINGS = ["Error", "Exception"]
FUNCTION_NOUNS = ["function", "method", "implementation of"]
# Words of a question that ask for known issues.
ISSUE_WORDS = ["bug", "bugs", "issue", "issues", "problem", "problems", "security", "vulnerability", "vulnerabilities", "code quality", "technical debt", "tech debt", "what's wrong", "whats wrong", "concerns", "risks", "flaws"]


def group(text: Column, pattern: str, number: int = 1) -> Column:
    """regexp_extract with null, not the empty string, where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, number))


def strip(text: Column) -> Column:
    """All white space off both ends; `trim` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# Tokens, counts and hashes


def token_estimate(text: Column) -> Column:
    """A fourth of the code points, rounded down."""
    return F.floor(F.length(text) / 4).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), 1))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def lines_ast(text: Column) -> Column:
    """Newlines and one: what syntax-tree parsers report."""
    return F.size(F.split(text, "\n", -1))


def lines_plain(text: Column) -> Column:
    """Newlines, and one more if the last line is unterminated: what the fallback parser reports."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


def lines_metric(text: Column) -> Column:
    """Lines by any line end (LF, CR, CRLF, VT, FF, FS, GS, RS, NEL, LS, PS), 0 for an empty text: what metrics count."""
    even = F.regexp_replace(text, "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85  ]", "\n")
    return lines_plain(even)


def bm25_distance(score: Column) -> Column:
    """A full-text score as a distance: one less a tenth of it, at least 0; 0.5 for none."""
    return F.when(score.isNull() | (score == 0), 0.5).otherwise(1 - F.least(F.abs(score) / 10, F.lit(1.0)))


def bm25_display(score: Column) -> Column:
    return F.coalesce(F.abs(score), F.lit(0.0))


# Slugs, paths and titles


def page_slug(path: Column, include_extension: bool = True) -> Column:
    out = F.translate(path, "/\\", "--")
    if include_extension:
        out = F.replace(out, F.lit("."), F.lit("-"))
    out = F.regexp_replace(out, "[^a-zA-Z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")


def chunk_slug(text: Column) -> Column:
    out = F.translate(F.lower(text), "/ ", "_-")
    return F.regexp_replace(out, "[^a-z0-9_-]", "")


def workflow_slug(name: Column) -> Column:
    out = F.regexp_replace(F.translate(F.lower(name), "_ ", "--"), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(out, "-+", "-"), "^-+|-+$", "")


def note_slug(path: Column, longest: int = 200) -> Column:
    """`/` as `--`, other unsafe characters percent-encoded by UTF-8 byte; long ones end in a hash, the extension kept."""
    encoded = F.array_join(
        F.transform(F.split(F.regexp_replace(path, "^/+|/+$", ""), ""), lambda c: F.when(c == "/", "--").when(c.rlike("^[A-Za-z0-9._~-]?$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))),
        "",
    )
    extension = F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,10})$", 1)
    short = F.concat(F.substr(encoded, F.lit(1), F.lit(longest) - 17 - F.length(extension)), F.lit("-"), F.substring(F.sha2(path, 256), 1, 16), extension)
    return F.when(F.octet_length(encoded) <= longest, encoded).otherwise(short)


def source_path(page_path: Column) -> Column:
    """`files/auth-handler-py.md` to `auth/handler.py`: the last dash before a known extension is its dot, others are slashes."""
    bare = F.regexp_replace(F.regexp_replace(page_path, "^files/", ""), r"\.md$", "")
    known = f"^(.*)-({'|'.join(_PAGE_EXTENSIONS)})$"
    return F.when(bare.rlike(known), F.concat(F.replace(F.regexp_extract(bare, known, 1), F.lit("-"), F.lit("/")), F.lit("."), F.regexp_extract(bare, known, 2))).otherwise(F.replace(bare, F.lit("-"), F.lit("/")))


def humanize(name: Column) -> Column:
    """snake_case and camelCase to words with capitals."""
    spaced = F.regexp_replace(F.regexp_replace(F.translate(name, "_-", "  "), "([a-z0-9])([A-Z])", "$1 $2"), " +", " ")
    return F.initcap(F.trim(spaced))


def route_prefix(route: Column) -> Column:
    """First segment of a route after `api` and version segments; null if there is none or it is a parameter."""
    bare = F.regexp_replace(F.regexp_replace(route, "^/+", ""), r"^(?:api/)?(?:v[0-9]+/)?", "")
    first = F.regexp_extract(bare, "^([^/?#]+)", 1)
    return F.when((first != "") & ~first.startswith("{"), first)


def title(content: Column, path: Column) -> Column:
    """The first `# ` heading, else the file name in words."""
    stem = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(strip(group(content, r"(?m)^#[ \t]+(\S.*)$")), F.initcap(F.translate(stem, "-_", "  ")))


def page_type(path: Column) -> Column:
    out = F.when(path.startswith("overview"), "overview").when(path.startswith("architecture"), "architecture")
    for folder, kind in (("workflows/", "workflow"), ("directories/", "directory"), ("files/", "file")):
        out = out.when(path.startswith(folder), kind)
    return out.otherwise("wiki")


def page_url(path: Column) -> Column:
    bare = F.regexp_replace(path, r"\.md$", "")
    return F.when(bare == "overview", "/").otherwise(F.concat(F.lit("/"), bare))


def breadcrumb(directory: Column, project: str, deepest: int = 4) -> Column:
    """`project / a / b`; beyond `deepest` levels the middle is an ellipsis."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    n = F.size(parts)
    long = F.concat(F.array(F.lit(project), F.lit("...")), F.slice(parts, F.greatest(n - 1, F.lit(1)), 2))
    return F.array_join(F.when(n <= deepest, F.concat(F.array(F.lit(project)), parts)).otherwise(long), " / ")


def snippet(content: Column, query: Column, longest: int = 200) -> Column:
    """50 characters before and 150 after the start of the first hit, whatever its case; else the first `longest`."""
    at = F.position(F.lower(query), F.lower(content))
    start, end = F.greatest(at - 51, F.lit(0)), F.least(at - 1 + 150, F.length(content))
    hit = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(content, start + 1, end - start), F.when(end < F.length(content), "...").otherwise(""))
    head = F.concat(F.substring(content, 1, longest), F.when(F.length(content) > longest, "...").otherwise(""))
    return F.when((at > 0) & (query != ""), hit).otherwise(head)


def truncate_sentences(text: Column, max_tokens: int) -> Column:
    """Whole sentences within the limit; if the first is longer, characters up to the last space; with an ellipsis if cut."""
    room = max_tokens * 4
    kept = F.aggregate(
        F.split(text, r"\. "),
        F.struct(F.lit("").alias("out"), F.lit(True).alias("open")),
        lambda a, s: F.struct(
            F.when(a["open"] & (F.length(a["out"]) + F.length(s) + 2 <= room), F.concat(a["out"], s, F.lit(". "))).otherwise(a["out"]).alias("out"),
            (a["open"] & (F.length(a["out"]) + F.length(s) + 2 <= room)).alias("open"),
        ),
        lambda a: a["out"],
    )
    # `$` would also match before a line break that ends the cut.
    cut = F.regexp_replace(F.substring(text, 1, room), r"[\t\n\f\r ]+[^\t\n\f\r ]*\z", "")
    return F.when(F.length(text) <= room, text).otherwise(F.concat(F.when(kept != "", F.rtrim(kept)).otherwise(cut), F.lit("...")))


def diagram_label(text: Column, longest: int = 40) -> Column:
    """Square and curly brackets as round ones, double quotes as single ones, no angle brackets, white space collapsed, cut to a length."""
    out = F.translate(text, "[]{}\"<>\r", "()()'")
    out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    return F.when(F.length(out) > longest, F.concat(F.substring(out, 1, longest - 3), F.lit("..."))).otherwise(out)


def diagram_id(text: Column) -> Column:
    """Letters, digits and underscores: dots, slashes and dashes become underscores, one for a run; a leading digit gets an n."""
    out = F.regexp_replace(F.regexp_replace(F.translate(text, "./-", "___"), "[^A-Za-z0-9_]", ""), "_+", "_")
    return F.regexp_replace(F.when(out.rlike("^[0-9]"), F.concat(F.lit("n"), out)).otherwise(out), "^_|_$", "")


def url_parts(url: Column) -> Column:
    """struct(source_type, host, owner, repo, local_path) of an https, ssh or local address of a repository."""
    ssh, web = r"^(?:ssh://)?git@([^:/]+)[:/]([^/]+)/(.+?)(?:\.git)?/?$", r"^https?://([^/]+)/([^/]+)/([^/?#]+?)(?:\.git)?/?$"
    is_ssh, is_web = url.rlike(ssh), url.rlike(web)
    part = lambda k: F.when(is_ssh, F.regexp_extract(url, ssh, k)).when(is_web, F.regexp_extract(url, web, k))
    kind = F.when(part(1) == "github.com", "github").when(part(1) == "gitlab.com", "gitlab").when(is_ssh | is_web, "git").otherwise("local")
    return F.struct(kind.alias("source_type"), part(1).alias("host"), part(2).alias("owner"), part(3).alias("repo"), F.when(~is_ssh & ~is_web, url).alias("local_path"))


# Time


def parse_time(value: Column) -> Column:
    """A time with a space or a T between date and clock; null if it is none."""
    return F.try_to_timestamp(F.replace(value, F.lit("T"), F.lit(" ")))


def expired(now: Column, last_seen: Column, minutes: int = 30) -> Column:
    return now > last_seen + F.make_interval(mins=F.lit(minutes))


# Structured text


def json_array(text: Column) -> Column:
    """A JSON array of strings; an empty one for null or no JSON."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_answer(text: Column, ddl: str) -> Column:
    """The JSON of an answer, code fences off; null if it is broken."""
    return F.from_json(F.regexp_replace(strip(text), r"(?s)^```(?:json)?\s*|\s*```$", ""), ddl)


def frontmatter(text: Column) -> Column:
    """map of the `key: value` lines of a block that opens the text; null without one."""
    block = group(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)")
    return F.str_to_map(block, F.lit("\n"), F.lit(": "))


def frontmatter_body(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?\n?", "")


def with_frontmatter(source: Column, kind: Column, commit: Column, generated: Column, layer: Column, body: Column) -> Column:
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("---\n"), field("source", source), field("type", kind), field("commit", commit), field("generated", generated), field("layer", layer), F.lit("---\n\n"), body)


def summary_block(text: Column) -> Column:
    """The lines of the first block between two `---` lines, wherever it stands; null without one."""
    return group(text, r"(?ms)^---\s*\n(.*?)\n---\s*$")


def without_summary_blocks(text: Column) -> Column:
    return F.when(summary_block(text).isNull(), text).otherwise(strip(F.regexp_replace(text, r"(?ms)^---\s*\n.*?\n---[ \t]*(?:\n|\z)", "")))


def classification(text: Column, modes=("diagnostic", "exploratory", "analytical", "conceptual")) -> Column:
    """struct(mode, reasoning, scope) of a classifier's JSON; conceptual where it is broken or the mode unknown."""
    got = json_answer(text, "mode string, reasoning string, scope string")
    mode = F.lower(got["mode"])
    return F.struct(F.when(mode.isin(*modes), mode).otherwise("conceptual").alias("mode"), F.coalesce(got["reasoning"], F.lit("")).alias("reasoning"), got["scope"].alias("scope"))


# Answers, gaps and anchors


def _block(response: Column, tag: str) -> Column:
    """The text between the first pair of tags, in any case, blanks around it aside; null without one or if it is empty."""
    return group(response, rf"(?is)<{tag}>\s*(.+?)\s*</{tag}>")


def answer_text(response: Column) -> Column:
    """The answer block; in the plain form what follows `ANSWER:` up to the missing part; else everything."""
    after = group(response, r"(?is)ANSWER:\s*(.+)")
    plain = F.get(F.split(after, r"(?i)\n<missing>|\nMISSING\s*[(:]", 2), F.lit(0))
    return strip(F.coalesce(_block(response, "answer"), plain, response))


def gap_list(response: Column) -> Column:
    """Lines of the missing block (in the plain form, after `MISSING ...:`), bullets off; none for NONE or without a block."""
    block = strip(F.coalesce(_block(response, "missing"), group(response, r"(?is)MISSING[^:]*:\s*(.+)")))
    lines = F.transform(F.split(block, "\n"), lambda x: strip(F.regexp_replace(strip(x), "^-+", "")))
    good = F.filter(lines, lambda x: (x != "") & ~F.upper(x).startswith("NONE"))
    return F.when(block.isNull() | F.upper(block).startswith("NONE"), F.array().cast("array<string>")).otherwise(good)


def is_issue_question(question: Column) -> Column:
    low = F.lower(question)
    return F.exists(F.array(*(F.lit(w) for w in ISSUE_WORDS)), lambda w: F.contains(low, w))


def is_specific_gap(gap: Column) -> Column:
    low = F.lower(gap)
    return F.contains(gap, F.lit("::")) | F.contains(low, F.lit(" in ")) | low.rlike("(?:function|class|method|def) ")


def gap_node_name(gap: Column) -> Column:
    """The name a gap asks for: after `::`, before ` in `, after a keyword, else its first identifier."""
    low = F.lower(gap)
    at = F.instr(low, " in ")
    by_word = F.coalesce(*(group(gap, rf"(?i){w} \s*(\S+)") for w in ("function", "class", "method", "def")))
    words = F.filter(F.split(F.trim(gap), r"\s+"), lambda w: ~F.lower(w).isin("the", "a", "an", "in", "for", "to", "of", "that", "which") & w.rlike(r"(?U)^\p{L}\w*$"))
    return F.when(F.contains(gap, F.lit("::")), strip(F.substring_index(gap, "::", -1))).when(at > 0, strip(F.substr(gap, F.lit(1), at - 1))).when(low.rlike("(?:function|class|method|def) "), by_word).otherwise(F.get(words, F.lit(0)))


def _first(words: Column, test) -> Column:
    """The place (from 1) of the first word that passes, null without one."""
    places = F.filter(F.transform(words, lambda w, i: F.when(test(w), i + 1)), lambda x: x.isNotNull())
    return F.get(places, F.lit(0))


def _phrase_at(words: Column, phrase: list[str]) -> Column:
    """The place (from 1) where words hold a phrase first, null if they don't."""
    wanted = F.array(*(F.lit(w) for w in phrase))
    places = F.filter(F.transform(words, lambda w, i: F.when((w == phrase[0]) & (F.slice(words, i + 1, len(phrase)) == wanted), i + 1)), lambda x: x.isNotNull())
    return F.get(places, F.lit(0))


def gap_references(gap: Column) -> Column:
    """struct(file_path, function_name) that a gap refers to, read word by word.

    The file is the first word with a source file's extension that stands after `in`, else the first one at all. The
    function is the word before that `in`, else the first word with `()` after it, else the one after a noun that announces it.
    """
    words = F.filter(F.split(F.replace(gap, F.lit("`"), F.lit("")), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\w./-]+|[^\w)]+$", ""))
    is_file = lambda w: F.element_at(F.split(w, r"\."), -1).isin(*SOURCE_EXTENSIONS) & F.contains(w, F.lit("."))
    name = lambda w: F.regexp_extract(w, r"(\w+)(?:\(\))?$", 1)
    placed = F.transform(bare, lambda w, i: F.when(is_file(w) & (i > 1) & (F.get(words, i - 1) == "in") & (name(F.get(bare, i - 2)) != ""), i + 1))
    after_in = F.get(F.filter(placed, lambda x: x.isNotNull()), F.lit(0))
    at = F.coalesce(after_in, _first(bare, is_file))
    called = _first(bare, lambda w: w.rlike(r"\w\(\)"))
    low = F.transform(bare, lambda w: F.lower(w))
    announced = F.coalesce(*(F.get(bare, _phrase_at(low, noun.split(" ")) - 1 + len(noun.split(" "))) for noun in FUNCTION_NOUNS))
    by_noun = F.when(F.regexp_extract(announced, r"^(\w+)", 1) != "", F.regexp_extract(announced, r"^(\w+)", 1))
    by_call = F.regexp_extract(F.get(bare, called - 1), r"(\w+)\(\)", 1)
    function = F.when(after_in.isNotNull(), name(F.get(bare, after_in - 3))).otherwise(F.coalesce(by_call, by_noun))
    return F.struct(F.get(bare, at - 1).alias("file_path"), function.alias("function_name"))


def named_exceptions(text: Column) -> Column:
    """Exceptions that a text names, sorted: the bare name, and with the part before it where it is dotted."""
    names = F.regexp_extract_all(text, F.lit(r"\w+(?:\.\w+)*"), F.lit(0))
    # A dotted name ends at its first part that is an exception's: what follows are its attributes.
    ends = lambda part: F.exists(F.array(*(F.lit(e) for e in EXCEPTION_ENDINGS)), lambda e: part.endswith(e) & (F.length(part) > F.length(e)))

    def parts(name: Column) -> Column:
        split = F.split(name, r"\.")
        return F.slice(split, 1, F.coalesce(_first(split, ends), F.lit(0)))

    found = F.filter(F.transform(names, parts), lambda p: F.size(p) > 0)
    bare = F.transform(found, lambda p: F.element_at(p, -1))
    dotted = F.transform(found, lambda p: F.array_join(F.slice(p, -F.least(F.size(p), F.lit(2)), 2), "."))
    return F.array_sort(F.array_union(bare, dotted))


def error_anchors(query: Column) -> Column:
    """struct of sorted distinct exceptions (bare, and with the part before them), quoted texts, files and functions that a question names."""
    every = lambda pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(query, F.lit(pattern), 1)))
    files = F.array_sort(F.array_union(every(TRACE_FILE), every(BARE_FILE)))
    return F.struct(named_exceptions(query).alias("exception_types"), every(QUOTED_TEXT).alias("error_strings"), files.alias("file_refs"), every(TRACE_FUNCTION).alias("function_refs"))


def question_words(query: Column) -> Column:
    """The words of a question in lower case, apostrophes inside them kept."""
    return F.regexp_extract_all(F.lower(query), F.lit(r"\w+(?:'\w+)*"), F.lit(0))


def _subject(query: Column, phrases: list[str], no_subject: list[str]) -> Column:
    """The word in the blank of the first phrase that a question holds with a subject there."""
    words, found = question_words(query), []
    for phrase in phrases:
        parts = phrase.split(" ")
        if parts[0] == "_":
            # Also longer forms of the last word: flows, paths.
            at = _first(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda w, cue=parts[1]: w.startswith(cue))
            word = F.get(words, at - 1)
        else:
            cue = [p for p in parts if p not in ("(the)", "_")]
            at = _phrase_at(words, cue) - 1 + len(cue)
            word = F.get(words, at)
            if "(the)" in parts:
                word = F.when(word.isin(*ARTICLES), F.get(words, at + 1)).otherwise(word)
        word = F.substring_index(word, "'", 1)
        found.append(F.when(~word.isin(*no_subject), word))
    return F.coalesce(*found)


def trace_subject(query: Column) -> Column:
    return _subject(query, TRACE_PHRASES, NO_TRACE_SUBJECT)


def analysis_scope(query: Column) -> Column:
    return _subject(query, SCOPE_PHRASES, NO_SCOPE)


def decorator_route(decorators: Column) -> Column:
    """The route path or command name in the first decorator that has one; empty without."""
    found = F.filter(F.transform(decorators, lambda d: F.coalesce(group(d, r"\.(?:get|post|put|delete|patch)\(['\"]([^'\"]+)['\"]"), group(d, r"\.command\(['\"]([^'\"]+)['\"]"))), lambda x: x.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))
