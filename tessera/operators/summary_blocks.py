"""Structured summaries that a model writes as a YAML block inside a page."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.summaries import LAYERS

# Categories and severities of issues, the defaults first.
CATEGORIES = ["maintainability", "security", "reliability"]
SEVERITIES = ["suggestion", "problem"]

_ITEM = re.compile(r"^-(?:\s+|$)")
_PAIR = re.compile(r"^([\w.-]+)\s*:(?:\s+|$)(.*)$")
SCHEMA = "file_path string, content string, purpose string, layer string, key_abstractions array<string>, internal_deps array<string>, external_deps array<string>, issues array<struct<category:string,severity:string,title:string,description:string,line_start:int,line_end:int>>"


def _scalar(text: str):
    """A plain, quoted or listed value on one line."""
    text = text.strip()
    if text[:1] in "\"'" and len(text) > 1 and text[-1] == text[0]:
        return text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1].replace('\\"', '"').replace("\\n", "\n")
    text = re.split(r"\s+#", text, maxsplit=1)[0].strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if text in ("", "~", "null"):
        return None
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def read_block(block: str):
    """The value of an indented block of mappings, lists and scalars: the part of YAML that summaries are written in.

    ValueError for what is none: tabs for indents, a line that is neither pair nor item, wrong indents.
    """
    lines = []
    for raw in block.split("\n"):
        if raw.strip() and not raw.lstrip().startswith("#"):
            if "\t" in raw[: len(raw) - len(raw.lstrip())]:
                raise ValueError("a tab in an indent")
            lines.append((len(raw) - len(raw.lstrip(" ")), raw.strip()))

    def folded(at: int, indent: int, keep: bool) -> tuple[str, int]:
        part = []
        while at < len(lines) and lines[at][0] > indent:
            part.append(lines[at][1])
            at += 1
        return ("\n" if keep else " ").join(part), at

    def value(at: int, indent: int, rest: str):
        if rest in ("|", ">", "|-", ">-"):
            return folded(at, indent, rest[0] == "|")
        if rest:
            return _scalar(rest), at
        if at < len(lines) and (lines[at][0] > indent or lines[at][0] == indent and _ITEM.match(lines[at][1])):
            return node(at, lines[at][0])
        return None, at

    def node(at: int, indent: int):
        if _ITEM.match(lines[at][1]):
            out: list = []
            while at < len(lines) and lines[at][0] == indent and (m := _ITEM.match(lines[at][1])):
                inner = lines[at][1][m.end() :]
                if _PAIR.match(inner):  # a mapping that begins on the item's line
                    lines[at] = (indent + m.end(), inner)
                    found, at = node(at, indent + m.end())
                else:
                    found, at = value(at + 1, indent, inner)
                out.append(found)
            return out, at
        made: dict = {}
        while at < len(lines) and lines[at][0] == indent and not _ITEM.match(lines[at][1]):
            pair = _PAIR.match(lines[at][1])
            if not pair:
                raise ValueError(f"neither a pair nor an item: {lines[at][1]!r}")
            made[pair[1]], at = value(at + 1, indent, pair[2])
        return made, at

    if not lines:
        return None
    found, at = node(0, lines[0][0])
    if at < len(lines):
        raise ValueError("wrong indent")
    return found


def _strings(value) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else []


def _issue(item: dict) -> dict:
    lines = item.get("lines")
    first, last = (item["line_start"], item["line_end"]) if {"line_start", "line_end"} <= item.keys() else lines[:2] if isinstance(lines, list) and len(lines) >= 2 else (None, None)
    chosen = {k: item.get(k) if item.get(k) in of else of[0] for k, of in (("category", CATEGORIES), ("severity", SEVERITIES))}
    place = {k: x if isinstance(x, int) else None for k, x in (("line_start", first), ("line_end", last))}
    return chosen | {"title": str(item.get("title") or ""), "description": str(item.get("description") or "")} | place


def file_summaries(pages: DataFrame) -> DataFrame:
    """pages (file_path, content) to rows of SCHEMA: the summary in the first `---` block, and the content without such blocks.

    An unknown layer is `utility`, an issue's unknown category or severity the default, a missing list empty. Without a
    block, or with one that can't be read or holds no `file_summary`, the content stays and the summary is the fallback:
    purpose Unknown, layer utility. Null content gives the fallback. One narrow pass.
    """
    read = pages.select("file_path", F.col("content"), fn.summary_block(F.col("content")).alias("block"), fn.without_summary_blocks(F.col("content")).alias("bare"))

    def summary(block: str | None) -> dict | None:
        try:
            found = read_block(block) if block is not None else None
        except ValueError:
            return None
        own = found.get("file_summary") if isinstance(found, dict) else None
        return own if isinstance(own, dict) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, block, bare in zip(batch["file_path"], batch["content"], batch["block"], batch["bare"], strict=True):
                own = summary(block)
                if own is None:
                    rows.append((path, content, "Unknown", "utility", [], [], [], []))
                    continue
                issues = [_issue(x) for x in own.get("issues") or [] if isinstance(x, dict)] if isinstance(own.get("issues"), list) else []
                layer = own.get("layer", "utility")
                lists = [_strings(own.get(k)) for k in ("key_abstractions", "internal_deps", "external_deps")]
                rows.append((path, bare, str(own.get("purpose", "Unknown")), layer if layer in LAYERS else "utility", *lists, issues))
            yield pd.DataFrame(rows, columns=["file_path", "content", "purpose", "layer", "key_abstractions", "internal_deps", "external_deps", "issues"])

    return read.mapInPandas(run, SCHEMA)
