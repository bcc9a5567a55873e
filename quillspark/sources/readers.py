"""Readers of office documents: each file a row with its kind, sections, tables and text, read by the executors.

docx and xlsx are zip archives of XML and are parsed with the standard library. A pdf is checked (signature, size, encryption)
and its pages are read if pypdf is there; without it the row says so. Limits reject archives that unpack to too much.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE, MAX_UNPACKED, MAX_ENTRIES, MAX_CHARS = 20 << 20, 100 << 20, 10_000, 3_000_000
MAX_ROWS, MAX_COLUMNS, MAX_PAGES = 20_000, 100, 1_000

SCHEMA = "path string, kind string, block int, section string, header string, text string, error string"

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


#: What the parsers raise on damaged files: bad XML, members, streams, references, encodings, encryption.
DAMAGE = (ElementTree.ParseError, zipfile.BadZipFile, zlib.error, LookupError, ValueError, RuntimeError, NotImplementedError, EOFError, OSError, AttributeError, TypeError, RecursionError)


class Rejected(ValueError):
    """A file that a limit or a check refuses."""


def _archive(content: bytes) -> zipfile.ZipFile:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        raise Rejected("not_an_archive") from None
    own = archive.infolist()
    if len(own) > MAX_ENTRIES or sum(x.file_size for x in own) > MAX_UNPACKED:
        raise Rejected("archive_too_large")
    if any("vbaProject" in x.filename for x in own):
        raise Rejected("macros")
    return archive


class _Member(io.RawIOBase):
    """A member of an archive as it unpacks: what its header says of its size isn't trusted."""

    def __init__(self, archive: zipfile.ZipFile, name: str) -> None:
        self.stream, self.left = archive.open(name), MAX_UNPACKED

    def readable(self) -> bool:
        return True

    def read(self, size: int = -1) -> bytes:
        data = self.stream.read(min(size if size and size > 0 else 1 << 20, 1 << 20))
        self.left -= len(data)
        if self.left < 0:
            raise Rejected("archive_too_large")
        return data


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.parse(_Member(archive, name)).getroot()


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter(f"{_W}t")).strip()


def read_docx(content: bytes) -> Iterator[tuple[str, str, str]]:
    """section, header, text of each block in order: headings open sections by level, tables give a block of rows."""
    body = _xml(_archive(content), "word/document.xml").find(f"{_W}body")
    stack: list[tuple[int, str]] = []
    for node in body if body is not None else ():
        section = " > ".join(x for _, x in stack)
        if node.tag == f"{_W}p" and (text := _text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            level = re.fullmatch(r"[Hh]eading\s?(\d)", style.get(f"{_W}val", "") if style is not None else "")
            if level:
                stack = [x for x in stack if x[0] < int(level[1])] + [(int(level[1]), text)]
                section = " > ".join(x for _, x in stack)
            yield section, "", text
        elif node.tag == f"{_W}tbl":
            rows = [" | ".join(_text(c) for c in r.findall(f"{_W}tc")) for r in node.findall(f"{_W}tr")]
            if rows:
                yield section, rows[0], "\n".join(rows)


def _column(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]*", reference)[0]:
        number = number * 26 + ord(c) - 64
    return max(0, number - 1)


def read_xlsx(content: bytes) -> Iterator[tuple[str, str, str]]:
    """sheet, header, text of each non-empty row of the visible sheets, as COLUMN: value; later rows carry the first row."""
    archive = _archive(content)
    names = set(archive.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in x.iter(f"{_S}t")) for x in _xml(archive, "xl/sharedStrings.xml")]
    targets = {x.get("Id"): x.get("Target") for x in _xml(archive, "xl/_rels/workbook.xml.rels")}
    for sheet in _xml(archive, "xl/workbook.xml").iter(f"{_S}sheet"):
        if sheet.get("state", "visible") != "visible":
            continue
        head, seen = "", 0
        for row in _xml(archive, "xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/")).iter(f"{_S}row"):
            cells = {}
            for cell in row.findall(f"{_S}c"):
                value = cell.find(f"{_S}v")
                if cell.find(f"{_S}f") is not None and (value is None or not value.text):
                    raise Rejected("formula_without_value")
                inline = cell.find(f"{_S}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else "" if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text or ""
                if text.strip():
                    cells[_column(cell.get("r", "A"))] = (re.match("[A-Z]*", cell.get("r", "A"))[0], text.strip())
            if not cells:
                continue
            seen += 1
            if seen > MAX_ROWS or max(cells) >= MAX_COLUMNS:
                raise Rejected("sheet_too_large")
            text = " | ".join(f"{name}: {value}" for _, (name, value) in sorted(cells.items()))
            yield sheet.get("name", ""), head, text if not head else f"{head}\n{text}"
            head = head or text


def read_pdf(content: bytes) -> Iterator[tuple[str, str, str]]:
    """The text of each page; a page that fails stays as empty text, so that page numbers don't shift."""
    if not content.startswith(b"%PDF-"):
        raise Rejected("not_a_pdf")
    if b"/Encrypt" in content[-4096:]:
        raise Rejected("encrypted")
    try:
        import pypdf
    except ImportError:
        raise Rejected("pypdf_is_not_installed") from None
    try:
        pages = pypdf.PdfReader(io.BytesIO(content), strict=True).pages
        n = len(pages)
    except Exception:
        raise Rejected("damaged") from None
    if n > MAX_PAGES:
        raise Rejected("too_many_pages")
    for page in pages:
        try:
            yield "", "", page.extract_text() or ""
        except Exception:
            yield "", "", ""


READERS = {"docx": read_docx, "xlsx": read_xlsx, "pdf": read_pdf}


def parse(path: str, content: bytes) -> list[tuple]:
    """Rows of SCHEMA for one file; a refused file is one row with its error."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    try:
        if kind not in READERS:
            raise Rejected("unknown_kind")
        if len(content) > MAX_FILE:
            raise Rejected("file_too_large")
        rows = [(path, kind, k, section, header, text, None) for k, (section, header, text) in enumerate(READERS[kind](content))]
        if sum(len(r[5]) for r in rows) > MAX_CHARS:
            raise Rejected("too_many_characters")
        return rows
    except DAMAGE as e:
        return [(path, kind, None, None, None, None, str(e) if isinstance(e, Rejected) else "damaged")]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of every pdf, docx and xlsx file below a path."""
    return parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def parsed(files: DataFrame) -> DataFrame:
    """The blocks of files (path, content)."""

    def run(batches):
        for files in batches:
            rows = [r for p, c in zip(files["path"], files["content"], strict=True) for r in parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "kind", "block", "section", "header", "text", "error"]).astype({"block": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path and the hash of each file, for a backup's manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("h"))


def write_results(df: DataFrame, path: str, kind: str = "json", mark: bool = False) -> None:
    """Results as JSON lines, CSV with a header, or Parquet. mark: a byte order mark at the head of each CSV file."""
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        if mark:  # the header is the first thing in a file
            first, *rest = df.columns
            writer = df.toDF(f"\ufeff{first}", *rest).write.mode("errorifexists")
        writer.option("header", "true").csv(path)
    elif kind == "json":
        writer.json(path)
    else:
        writer.parquet(path)
