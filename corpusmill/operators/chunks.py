"""Cutting texts into chunks: sliding windows, Markdown sections, notebook cells, Python definitions, units; greedy and so sequential per text."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import take_while_fits
from corpusmill.memory import give_back, short_batches
from corpusmill.operators.code import LANGUAGES, definitions
from corpusmill.operators.stripping import strip_code

CHUNK_TOKENS, UNIT_CHARS, MIN_UNIT, MAX_UNITS = 512, 2000, 3, 64
#: Characters of chunks that a worker holds before it sends them.
HELD_CHARS = 1 << 22
CHUNK = "node_type string, name string, start_line int, end_line int, content string, docstring string"


def lines_of(text: str) -> list[str]:
    """Lines without their ends; no empty line after a final line end."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    return lines[:-1] if lines[-1] == "" else lines


def windows(lines: list[str], tokens: int = CHUNK_TOKENS) -> Iterator[tuple[int, int]]:
    """(start, end) of windows of whole lines within 4 characters a token; the next one starts up to an eighth earlier, but always later than the last."""
    budget = tokens * 4
    size, start = [len(x) for x in lines], 0
    while start < len(lines):
        end, used = start + 1, size[start]
        while end < len(lines) and used + size[end] + 1 <= budget:
            used += size[end] + 1
            end += 1
        yield start, end
        if end >= len(lines):
            return
        back, overlap = end, 0
        while back > start + 1 and overlap + size[back - 1] + 1 <= budget // 8:
            overlap += size[back - 1] + 1
            back -= 1
        start = back


def plain_chunks(text: str, tokens: int = CHUNK_TOKENS) -> Iterator[tuple]:
    lines = lines_of(text)
    for a, b in windows(lines, tokens):
        yield "verbatim", None, a + 1, b, "\n".join(lines[a:b]), None


def markdown_chunks(text: str, tokens: int = CHUNK_TOKENS) -> Iterator[tuple]:
    """A section for each ATX heading, fences notwithstanding, with what stands before the first as a preamble; sections over the budget go through windows."""
    lines = lines_of(text)
    heads = [i for i, x in enumerate(lines) if re.match(r"#{1,6}( .*)?$", x, re.S)]
    for a, b in zip([0, *heads], [*heads, len(lines)], strict=True):
        if a == b or not "".join(lines[a:b]).strip():
            continue
        name = lines[a].lstrip("#").strip() if a in heads else None
        if sum(map(len, lines[a:b])) + b - a - 1 <= tokens * 4:
            yield "section", name, a + 1, b, "\n".join(lines[a:b]), None
        else:
            for c, d in windows(lines[a:b], tokens):
                yield "section", name, a + c + 1, a + d, "\n".join(lines[a + c : a + d]), None


def notebook_chunks(text: str, tokens: int = CHUNK_TOKENS) -> Iterator[tuple]:
    """A chunk for each cell with text, its source a string or a list; lines count on over the cells."""
    try:
        book = json.loads(text)
        cells = book.get("cells") or []
    except (ValueError, AttributeError):
        yield from plain_chunks(text, tokens)
        return
    kernel = ((book.get("metadata") or {}).get("kernelspec") or {}).get("language") or "python"
    at = 1
    for cell in cells:
        source = cell.get("source") or ""
        source = "".join(source) if isinstance(source, list) else str(source)
        n = len(lines_of(source))
        if source.strip():
            yield "section" if cell.get("cell_type") == "markdown" else "verbatim", None if cell.get("cell_type") == "markdown" else kernel, at, at + n - 1, source, None
        at += n


def python_chunks(text: str, tokens: int = CHUNK_TOKENS) -> Iterator[tuple]:
    """Functions, methods and classes; a text that does not parse goes through windows."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        yield from plain_chunks(text, tokens)
        return
    lines, stack = lines_of(text), [(n, False) for n in reversed(tree.body)]
    while stack:
        node, in_class = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            yield kind, node.name, node.lineno, node.end_lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), ast.get_docstring(node)
            stack += [(n, isinstance(node, ast.ClassDef)) for n in reversed(node.body)]


def code_chunks(text: str, tokens: int = CHUNK_TOKENS, *, language: str) -> Iterator[tuple]:
    """Definitions of a language with braces; a text without any goes through windows."""
    lines, found = lines_of(text), definitions(text, language)
    if not found:
        yield from plain_chunks(text, tokens)
    for kind, name, first, last in sorted(((d.kind, d.name, d.first, d.last) for d in found), key=lambda d: d[2]):
        yield kind, name, first, last, "\n".join(lines[first - 1 : last]), None


READERS: dict[str, Callable] = {**{x: partial(code_chunks, language=x) for x in LANGUAGES}, "markdown": markdown_chunks, "notebook": notebook_chunks, "python": python_chunks}


def chunk(docs: DataFrame, text_col: str = "text", language_col: str | None = None, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """A row for each chunk: docs' columns but the text, and the chunk's. Null and empty texts give none."""
    others = [f for f in docs.schema.fields if f.name != text_col]
    names = [f.name for f in others]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), CHUNK])

    columns = [*names, *(c.split()[0] for c in CHUNK.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows, held = [], 0
            for values, text, language in zip(frame[names].itertuples(index=False), frame[text_col], frame[language_col] if language_col else [None] * len(frame), strict=True):
                for c in READERS.get(language, plain_chunks)(text, tokens) if text else ():
                    rows.append((*values, *c))
                    held += len(c[4])
                    if held > HELD_CHARS or len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)
            del frame, rows
            give_back()

    return short_batches(docs).mapInPandas(run, schema)


def stripped_code(code: Column, language: Column) -> Column:
    """strip_code() of columns; null for null."""

    def run(codes, languages):
        return pd.Series([None if c is None else strip_code(c, x) for c, x in zip(codes, languages, strict=True)])

    return F.pandas_udf(run, T.StringType(), F.PandasUDFType.SCALAR)(code, language)


def units(text_col: Column, kind_col: Column) -> Column:
    """Array of units to choose from: sentences of a section, groups between blank lines otherwise; clamped, short ones dropped, 64 at most."""
    sentences = F.split(text_col, r"(?<=[.!?])|\n")
    groups = F.split(text_col, r"\n[ \t]*\n\s*")
    parts = F.when(kind_col == "section", sentences).otherwise(groups)
    cut = F.transform(parts, lambda u: F.substring(F.trim(F.regexp_replace(u, r"^\s+|\s+$", "")), 1, UNIT_CHARS))
    return F.slice(F.filter(cut, lambda u: F.length(u) >= MIN_UNIT), 1, MAX_UNITS)


def prefix_of(units_col: Column, order: Column, cap: int) -> Column:
    """Units in the given order (places from 0), whole and joined by blanks, until one would pass the cap in tokens."""
    return take_while_fits(F.transform(order, lambda i: F.get(units_col, i)), cap)
