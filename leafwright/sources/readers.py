"""Readers of text, Markdown, delimited tables, spreadsheets, word-processor files and slides.

Each takes paths that Spark can read, loads files as binary rows and parses them in
tasks, a file at a time; results are blocks with exact line, row, paragraph or slide
anchors.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "path string, part string, kind string, start int, end int, level int, title string, text string"
MAX_TEXT, CHUNK_ROWS, MAX_CHUNKS, MAX_SHEETS, MAX_SLIDES = 12_000, 100, 20, 20, 200


def decode(data: bytes) -> str:
    """UTF-8, with or without a mark, else GB 18030, else Latin-1."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def text_blocks(data: bytes) -> Iterator[tuple]:
    """Paragraphs between blank lines, with their lines."""
    lines, start = decode(data).splitlines(), None
    for i, line in enumerate([*lines, ""], 1):
        if line.strip():
            start = start or i
        elif start:
            body = "\n".join(lines[start - 1 : i - 1])
            yield "", "paragraph", start, i - 1, 0, lines[start - 1].strip()[:80], body[:MAX_TEXT]
            start = None


def markdown_blocks(data: bytes) -> Iterator[tuple]:
    """Sections from heading to heading; marks inside fences are text."""
    lines, fence, heads = decode(data).splitlines(), None, []
    for i, line in enumerate(lines):
        mark = re.match(r"\s{0,3}(```+|~~~+)", line)
        if fence:
            if mark and mark[1][0] == fence:
                fence = None
            continue
        if mark:
            fence = mark[1][0]
        elif m := re.match(r"\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            heads.append((i, i + 1, len(m[1]), m[2]))
        elif i and re.match(r"\s{0,3}(=+|-{2,})\s*$", line) and lines[i - 1].strip() and not (heads and heads[-1][0] == i - 1):
            heads.append((i - 1, i + 1, 1 if "=" in line else 2, lines[i - 1].strip()))
    if not heads:
        yield from text_blocks(data)
    for k, (at, body, level, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        while end > at + 1 and not lines[end - 1].strip():
            end -= 1
        yield "", "section", at + 1, end, level, title, "\n".join(lines[body:end])[:MAX_TEXT]


def _chunks(sheet: str, rows: list[tuple[int, list[str]]]) -> Iterator[tuple]:
    """Blocks of a table's rows; the first row that is not blank is the header."""
    rows = [(n, [c.strip() for c in r]) for n, r in rows if any(c.strip() for c in r)]
    if not rows:
        return
    header, body = rows[0][1], rows[1:]
    yield sheet, "header", rows[0][0], rows[0][0], 0, sheet, "\t".join(header)
    for k in range(0, min(len(body), CHUNK_ROWS * MAX_CHUNKS), CHUNK_ROWS):
        part = body[k : k + CHUNK_ROWS]
        yield sheet, "rows", part[0][0], part[-1][0], 0, sheet, "\n".join("\t".join([*r, *[""] * (len(header) - len(r))]) for _, r in part)


def csv_blocks(data: bytes, delimiter: str = ",") -> Iterator[tuple]:
    csv.field_size_limit(1 << 31)  # a field may be as long as a file
    yield from _chunks("", list(enumerate(csv.reader(io.StringIO(decode(data)), delimiter=delimiter), 1)))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _found(root, name: str) -> list:
    return [e for e in root.iter() if _local(e.tag) == name]


def _texts(e, name: str = "t") -> str:
    return "".join(x.text or "" for x in _found(e, name))


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    hits = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(hits)]


def xlsx_blocks(data: bytes) -> Iterator[tuple]:
    """Sheets of a workbook; cells count as they come, whatever their references."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = [_texts(e) for e in _found(ElementTree.fromstring(z.read("xl/sharedStrings.xml")), "si")] if "xl/sharedStrings.xml" in z.namelist() else []
    names = [e.get("name") for e in _found(ElementTree.fromstring(z.read("xl/workbook.xml")), "sheet")]
    for k, part in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml")[:MAX_SHEETS]):
        rows = []
        for n, row in enumerate(_found(ElementTree.fromstring(z.read(part)), "row"), 1):
            cells = []
            for c in _found(row, "c"):
                value = _texts(c, "v")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else _texts(c) if c.get("t") == "inlineStr" else value)
            rows.append((int(row.get("r") or n), cells))
        yield from _chunks(names[k] if k < len(names) else f"Sheet{k + 1}", rows)


def docx_blocks(data: bytes) -> Iterator[tuple]:
    """Paragraphs with the levels that their styles or numbers give."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    for i, p in enumerate(_found(root, "p"), 1):
        text = _texts(p).strip()
        if not text:
            continue
        style = next((v for e in _found(p, "pStyle") for k, v in e.attrib.items() if _local(k) == "val"), "")
        m = re.match(r"(?i)heading\s*(\d)", style)
        n = re.match(r"(\d+(?:\.\d+)*)\.?\s+\S", text) if len(text) <= 80 else None
        level = int(m[1]) if m else n[1].count(".") + 1 if n else 0
        yield "", "heading" if level else "paragraph", i, i, level, text[:80], text


def pptx_blocks(data: bytes) -> Iterator[tuple]:
    """A block for each slide: its paragraphs, then its notes."""
    z = zipfile.ZipFile(io.BytesIO(data))
    lines = lambda part: [t for p in _found(ElementTree.fromstring(z.read(part)), "p") if (t := _texts(p).strip())]
    for i, part in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml")[:MAX_SLIDES], 1):
        body = lines(part)
        notes = f"ppt/notesSlides/notesSlide{i}.xml"
        text = "\n".join([*body, *(lines(notes) if notes in z.namelist() else [])])
        yield "", "slide", i, i, 1, body[0] if body else f"Slide {i}", text


READERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {
    "txt": text_blocks,
    "md": markdown_blocks,
    "markdown": markdown_blocks,
    "csv": csv_blocks,
    "tsv": lambda data: csv_blocks(data, "\t"),
    "xlsx": xlsx_blocks,
    "docx": docx_blocks,
    "pptx": pptx_blocks,
}


def read_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of all files under ``path`` whose suffix has a reader; a broken file gives an ``error`` block."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*READERS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in f.itertuples(index=False):
                try:
                    rows = list(READERS[name.rpartition(".")[2].lower()](bytes(data)))
                except (ValueError, KeyError, IndexError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as e:
                    rows = [("", "error", 0, 0, 0, type(e).__name__, str(e))]
                yield pd.DataFrame([(name, *r) for r in rows], columns=[c.split()[0] for c in BLOCK.split(", ")])

    return files.mapInPandas(run, BLOCK)
