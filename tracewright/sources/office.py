"""Word and Excel files to blocks: their zipped XML is parsed as a stream, in document order, by the task that has the file.

Files come as bytes through Spark's own reader, so any store that it reads will do.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the formats' elements.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
BLOCKS = "path string, block_no int, location string, kind string, heading_path array<string>, text string, error string"
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]


def _squeezed(text: str) -> str:
    return " ".join(text.split())


def _row(header: list[str], cells: list[str]) -> str:
    named = itertools.zip_longest(header, cells, fillvalue="")
    return " | ".join(f"{name or f'column {k}'}: {cell}" for k, (name, cell) in enumerate(named, 1) if cell)


def _levels(book: zipfile.ZipFile) -> dict[str, int]:
    """Heading levels by the id of the style: a title is one of the first level."""
    out = {}
    if "word/styles.xml" in book.namelist():
        for style in ElementTree.parse(book.open("word/styles.xml")).iter(f"{_W}style"):
            name = style.find(f"{_W}name")
            words = name.get(f"{_W}val", "").strip().lower() if name is not None else ""
            if found := re.match(r"(heading|title)\s*(\d*)", words):
                out[style.get(f"{_W}styleId")] = int(found[2]) if found[1] == "heading" and found[2] else 1
    return out


def _paragraph(p: ElementTree.Element) -> str:
    parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
    return _squeezed("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))


def word_blocks(content: bytes, label: str) -> Iterator[tuple[str, str, list[str], str]]:
    """``location, kind, heading_path, text`` of a Word file: paragraphs and headings, and each table row with its header repeated."""
    book = zipfile.ZipFile(io.BytesIO(content))
    levels, path, tables, depth = _levels(book), [], 0, 0
    for event, element in ElementTree.iterparse(book.open("word/document.xml"), events=("start", "end")):
        if element.tag == f"{_W}tbl":
            depth += 1 if event == "start" else -1
        if event == "start" or depth:  # what is inside a table comes with it
            continue
        where = f"{label}:{' > '.join(path) or '(root)'}"
        if element.tag == f"{_W}p":
            text = _paragraph(element)
            style = element.find(f"{_W}pPr/{_W}pStyle")
            level = levels.get(style.get(f"{_W}val")) if style is not None else None
            if text and level:
                path = [*path[: level - 1], text]
                yield f"{label}:{' > '.join(path)}", "heading", list(path), text
            elif text:
                yield where, "prose", list(path), text
            element.clear()
        elif element.tag == f"{_W}tbl":
            tables += 1
            rows = [[_squeezed(" ".join(_paragraph(p) for p in cell.iter(f"{_W}p"))) for cell in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            for k, cells in enumerate(rows[1:], 1):
                if any(cells):
                    yield f"{where}#table{tables}r{k}", "table", list(path), _row(rows[0], cells)
            element.clear()


def _column(reference: str) -> int:
    """The place of a cell, from 0, by the letters of its reference."""
    at = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(c) - 64
    return at - 1


def _cell(cell: ElementTree.Element, strings: list[str]) -> str:
    value, kind = cell.find(f"{_X}v"), cell.get("t", "n")
    if kind == "inlineStr":
        return _squeezed("".join(t.text or "" for t in cell.iter(f"{_X}t")))
    text = value.text or "" if value is not None else ""
    if kind == "s" and text:
        return strings[int(text)]
    if kind == "b":
        return {"1": "true", "0": "false"}.get(text, text)
    if kind == "n" and re.fullmatch(r"-?\d+\.0+|-?\d+(\.\d+)?[eE]\+?\d+", text) and float(text).is_integer():
        return str(int(float(text)))
    return _squeezed(text)


def sheet_blocks(content: bytes, label: str) -> Iterator[tuple[str, str, list[str], str]]:
    """``location, kind, heading_path, text`` of a workbook: each row with the first populated row of its sheet as header; empty rows, and sheets with a header alone, are left out."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        for _, item in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
            if item.tag == f"{_X}si":
                strings.append(_squeezed("".join(t.text or "" for t in item.iter(f"{_X}t"))))
                item.clear()
    links = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    for sheet in ElementTree.parse(book.open("xl/workbook.xml")).iter(f"{_X}sheet"):
        name, target = sheet.get("name"), links[sheet.get(f"{_R}id")].lstrip("/")
        header, number = None, 0
        for _, row in ElementTree.iterparse(book.open(target if target.startswith("xl/") else f"xl/{target}")):
            if row.tag != f"{_X}row":
                continue
            number = int(row.get("r", number + 1))
            cells: list[str] = []
            for cell in row.findall(f"{_X}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [""] * (at + 1 - len(cells))
                cells[at] = _cell(cell, strings)
            row.clear()
            if not any(cells):
                continue
            if header is None:
                header = cells
            else:
                yield f"{label}:sheet:{name}!r{number}", "table", [label, name], _row(header, cells)


READERS = {"docx": word_blocks, "xlsx": sheet_blocks}


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """``path, block_no, location, kind, heading_path, text, error`` of the Word and Excel files below ``path``, of other suffixes none.

    A file that can't be opened or has nothing to read gives one row with an ``error``, as one bad file must neither end the job nor vanish.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))).filter(F.col("suffix").isin(*READERS))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in BLOCKS.split(", ")]
        for batch in batches:
            for place, suffix, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                label = place.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                try:
                    rows = [(place, k, *block, None) for k, block in enumerate(READERS[suffix](content.as_py(), label))]
                    error = "nothing to read; a workbook saved without its values reads as blank"
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, NotImplementedError) as problem:
                    rows, error = [], f"can't be opened: {problem}"
                rows = rows or [(place, None, None, None, None, None, error)]
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), _TYPES, strict=True)], names)

    return files.select("path", "suffix", "content").mapInArrow(parse, BLOCKS)
