"""Chunks of office documents: a zip container of XML parts, read by pull parsing, so that no part is held as a tree.

Word documents (docx) give a line for each paragraph and each table row, its cells joined by `` | ``, and go through windows. Spreadsheets (xlsx, ods) give a line for each row, its cells joined by tabs; a sheet of up to ``SHEET_LINES``
lines is one chunk named after it, a longer one goes through windows named by their rows. Empty lines are left out. A file that is no such container, is damaged, has a document type or unpacks to more than ``MAX_PART`` gives no chunks
and its reason in ``error``. The old binary formats and PDF are not read.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from decimal import Decimal
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunks import CHUNK, CHUNK_TOKENS, windows

SHEET_LINES, MAX_FILE, MAX_PART = 120, 64 << 20, 512 << 20
KINDS = {"docx": "docx", "xlsx": "spreadsheet", "ods": "spreadsheet"}


def events(archive: zipfile.ZipFile, part: str, whole: str = "") -> Iterator[tuple[str, tuple[str, ...], ElementTree.Element]]:
    """(start or end, names from the root, element) of an XML part, names without their spaces; an element is dropped at its end, or at that of the ``whole`` one around it."""
    if archive.getinfo(part).file_size > MAX_PART:
        raise ValueError(f"{part} is too large")
    with archive.open(part) as raw:
        if b"<!DOCTYPE" in raw.read(4096):
            raise ValueError(f"{part} has a document type")
    path: list[str] = []
    above: list[ElementTree.Element] = []
    with archive.open(part) as raw:
        for event, element in ElementTree.iterparse(raw, ("start", "end")):
            if event == "start":
                path.append(element.tag.rpartition("}")[2])
                above.append(element)
                yield event, tuple(path), element
            else:
                yield event, tuple(path), element
                path.pop()
                above.pop()
                if above and whole not in path:
                    element.clear()
                    above[-1].remove(element)


def attribute(element: ElementTree.Element, name: str) -> str | None:
    """By its name without the space."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def docx_lines(archive: zipfile.ZipFile) -> list[str]:
    """Text of the runs of paragraphs, of the body and of the cells of its tables."""
    lines, run, said, cells = [], [], [], []
    body, cell = ("document", "body"), ("document", "body", "tbl", "tr", "tc")
    for event, path, element in events(archive, "word/document.xml"):
        if event == "start":
            continue
        if path in ((*body, "p", "r", "t"), (*cell, "p", "r", "t")):
            run.append(element.text or "")
        elif path in ((*body, "p"), (*cell, "p")):
            text, run = "".join(run), []
            if text.strip():
                (said if path[:5] == cell else lines).append(text)
        elif path == cell:
            cells, said = cells + ([" ".join(said)] if said else []), []
        elif path == cell[:4]:
            lines, cells = lines + ([" | ".join(cells)] if cells else []), []
    return lines


def number(text: str) -> str:
    """A number's shortest form, without an exponent or a fraction of zero."""
    try:
        value = float(text)
    except ValueError:
        return text
    plain = format(Decimal(repr(value)), "f") if value == value and abs(value) != float("inf") else text
    return plain.rstrip("0").rstrip(".") if "." in plain else plain


def column_of(ref: str) -> int:
    place = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        place = place * 26 + ord(c) - 64
    return place - 1


def grid_lines(cells: dict[tuple[int, int], str]) -> list[str]:
    """Rows of the rectangle that holds all cells, without empty ones; by the cells there are, not by the rectangle's size."""
    rows: dict[int, dict[int, str]] = {}
    for (r, c), text in cells.items():
        if text:
            rows.setdefault(r, {})[c] = text
    if not rows:
        return []
    left, right = min(min(row) for row in rows.values()), max(max(row) for row in rows.values())
    lines = ("\t".join(row.get(c, "") for c in range(left, right + 1)) for _, row in sorted(rows.items()))
    return [line for line in lines if line.strip()]


def shared_strings(archive: zipfile.ZipFile) -> list[str]:
    out, said = [], []
    if "xl/sharedStrings.xml" not in archive.namelist():
        return out
    for event, path, element in events(archive, "xl/sharedStrings.xml"):
        if event == "end" and path in (("sst", "si", "t"), ("sst", "si", "r", "t")):
            said.append(element.text or "")
        elif event == "end" and path == ("sst", "si"):
            out.append("".join(said))
            said = []
    return out


def xlsx_sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, list[str]]]:
    """(name, lines) of each sheet in the workbook's order."""
    targets = {attribute(e, "Id"): attribute(e, "Target") for event, path, e in events(archive, "xl/_rels/workbook.xml.rels") if event == "start" and path[-1] == "Relationship"}
    sheets = [(e.attrib["name"], targets.get(next((v for k, v in e.attrib.items() if k.endswith("}id")), None))) for event, path, e in events(archive, "xl/workbook.xml") if event == "start" and path[-2:] == ("sheets", "sheet")]
    strings = shared_strings(archive)
    for name, target in sheets:
        part = posixpath.normpath(posixpath.join("xl", target)) if target and not target.startswith("/") else (target or "").lstrip("/")
        if part not in archive.namelist() or "chartsheets" in part:
            continue
        cells: dict[tuple[int, int], str] = {}
        row, column, kind, value, inline = -1, -1, "n", "", []
        for event, path, e in events(archive, part):
            if event == "start" and path[-1] == "row":
                row, column = int(e.attrib["r"]) - 1 if "r" in e.attrib else row + 1, -1
            elif event == "start" and path[-1] == "c":
                column = column_of(e.attrib["r"]) if "r" in e.attrib else column + 1
                kind, value, inline = e.attrib.get("t", "n"), "", []
            elif event == "end" and path[-2:] == ("c", "v"):
                value = e.text or ""
            elif event == "end" and path[-1] == "t" and "is" in path and "rPh" not in path:
                inline.append(e.text or "")
            elif event == "end" and path[-1] == "c":
                if kind == "s":
                    text = strings[int(value)] if value.isdigit() and int(value) < len(strings) else ""
                else:
                    text = {"inlineStr": "".join(inline), "b": {"1": "true", "0": "false"}.get(value, value)}.get(kind, number(value) if kind == "n" else value)
                cells[row, column] = text
        yield name, grid_lines(cells)


def ods_sheets(archive: zipfile.ZipFile) -> Iterator[tuple[str, list[str]]]:
    """The same of a spreadsheet of the open format; a cell or row that is said to repeat does so if it holds anything."""
    name, cells, row, column, said, value, repeat, rows, first = None, {}, 0, 0, [], "", 1, 1, {}
    for event, path, e in events(archive, "content.xml", whole="p"):
        tag = path[-1]
        if event == "start":
            if tag == "table":
                name, cells, row = attribute(e, "name"), {}, 0
            elif tag == "table-row":
                rows, column, first = int(attribute(e, "number-rows-repeated") or 1), 0, {}
            elif tag in ("table-cell", "covered-table-cell"):
                repeat, said = int(attribute(e, "number-columns-repeated") or 1), []
                kind = attribute(e, "value-type")
                value = number(attribute(e, "value") or "") if kind in ("float", "percentage", "currency") else attribute(e, "boolean-value") if kind == "boolean" else None
        elif tag == "p" and path[-2] in ("table-cell", "covered-table-cell"):
            said.append("".join(e.itertext()))
        elif tag in ("table-cell", "covered-table-cell"):
            text = value if value is not None else "\n".join(said)
            if text:
                first |= {column + i: text for i in range(min(repeat, 16384))}
            column += repeat
        elif tag == "table-row":
            if first:
                cells |= {(row + i, c): text for i in range(min(rows, 1 << 20)) for c, text in first.items()}
            row += rows
        elif tag == "table":
            yield name, grid_lines(cells)


def document_chunks(data: bytes, extension: str, tokens: int = CHUNK_TOKENS) -> Iterator[tuple]:
    """Chunks (node_type, name, start_line, end_line, content, docstring) of a document."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if extension == "docx":
            lines = [x for line in docx_lines(archive) for x in line.split("\n")]
            for a, b in windows(lines, tokens):
                yield "verbatim", None, a + 1, b, "\n".join(lines[a:b]), None
            return
        for name, found in xlsx_sheets(archive) if extension == "xlsx" else ods_sheets(archive):
            if 0 < len(found) <= SHEET_LINES:
                yield "section", name, 1, len(found), "\n".join(found), None
            elif found:
                lines = [x for line in found for x in line.split("\n")]
                for a, b in windows(lines, tokens):
                    yield "verbatim", f"{name} (rows {a + 1}–{b})", a + 1, b, "\n".join(lines[a:b]), None


def chunk_documents(files: DataFrame, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """files (path, content) to (path, language, chunk columns, error); a file that can't be read is one row with its error, other types are left out."""
    extension = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1))
    named = files.select("path", extension.alias("extension"), "content").filter(F.col("extension").isin(*KINDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, kind, data in zip(*(c for c in batch.columns), strict=True):
                rows, error = [], None
                try:
                    if len(data.as_buffer() or b"") > MAX_FILE:
                        raise ValueError("the file is too large")
                    rows = list(document_chunks(data.as_py(), kind.as_py(), tokens))
                except Exception as e:  # noqa: BLE001  a damaged container may fail in any way; its file says so and the others go on
                    rows, error = [(None,) * 6], f"{type(e).__name__}: {e}"
                if rows:
                    columns = [pa.array([r[i] for r in rows], pa.int32() if i in (2, 3) else pa.string()) for i in range(6)]
                    same = lambda v, n=len(rows): pa.array([v] * n, pa.string())
                    names = [c.split()[0] for c in CHUNK.split(", ")]
                    yield pa.RecordBatch.from_arrays([same(path.as_py()), same(KINDS[kind.as_py()]), *columns, same(error)], ["path", "language", *names, "error"])

    return named.mapInArrow(run, f"path string, language string, {CHUNK}, error string")


def read_documents(spark: SparkSession, path: str, tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Chunks of the documents below a folder, in any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx,ods}").load(path)
    return chunk_documents(files.filter(F.col("length") <= MAX_FILE).select("path", "content"), tokens)
