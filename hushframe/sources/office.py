"""Text of word-processor and spreadsheet files, parsed inside the tasks that hold the bytes."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_P = "{http://schemas.openxmlformats.org/package/2006/relationships}"

# A file whose parts unpack to more than this is reported, not read.
MAX_UNPACKED_BYTES = 1 << 30
# Files unpacked as Python objects at a time, in every task.
FILES_AT_ONCE = 100


def _open(content: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(content))
    if sum(part.file_size for part in archive.infolist()) > MAX_UNPACKED_BYTES:
        raise ValueError("unpacked size is too large")
    return archive


def docx_text(content: bytes) -> str:
    """Paragraph texts, each followed by a blank line."""
    body = ElementTree.fromstring(_open(content).read("word/document.xml"))
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    paragraphs = []
    for paragraph in body.iter(f"{_W}p"):
        words = [
            (node.text or "") if node.tag == f"{_W}t" else marks.get(node.tag, "")
            for node in paragraph.iter()
        ]
        paragraphs.append("".join(words) + "\n\n")
    return "".join(paragraphs)


def _column(reference: str) -> int:
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - ord("A") + 1
    return number


def _csv_cell(value: str) -> str:
    quoted = any(c in value for c in ',"\n\r')
    return '"' + value.replace('"', '""') + '"' if quoted else value


def _cell_text(cell: ElementTree.Element, shared: list[str]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    value = cell.findtext(f"{_S}v") or ""
    if kind == "s" and value:
        return shared[int(value)]
    if kind == "b":
        return "TRUE" if value == "1" else "FALSE"
    return value


def xlsx_sheets(content: bytes) -> list[tuple[str, str]]:
    """(sheet name, CSV text) in workbook order."""
    archive = _open(content)
    names = set(archive.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        table = ElementTree.fromstring(archive.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in table.iter(f"{_S}si")]
    links = ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): (r.get("Target") or "").lstrip("/") for r in links.iter(f"{_P}Relationship")}
    sheets = []
    for sheet in ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = targets[sheet.get(f"{_R}id")]
        part = target if target.startswith("xl/") else f"xl/{target}"
        rows: dict[int, dict[int, str]] = {}
        for r, row in enumerate(ElementTree.fromstring(archive.read(part)).iter(f"{_S}row"), start=1):
            cells = rows.setdefault(int(row.get("r") or r), {})
            for c, cell in enumerate(row.iter(f"{_S}c"), start=1):
                cells[_column(cell.get("r") or "") or c] = _cell_text(cell, shared)
        used = sorted({c for cells in rows.values() for c in cells})
        lines = []
        if used:
            for r in range(min(rows), max(rows) + 1):
                cells = rows.get(r, {})
                lines.append(",".join(_csv_cell(cells.get(c, "")) for c in range(used[0], used[-1] + 1)))
        sheets.append((sheet.get("name") or "", "\n".join(lines)))
    return sheets


def _in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    for batch in batches:
        for first in range(0, batch.num_rows, FILES_AT_ONCE):
            part = batch.slice(first, FILES_AT_ONCE)
            yield list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))


def _record_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: (path, content) to (path, text, reason)."""
    schema = pa.schema([("path", pa.string()), ("text", pa.string()), ("reason", pa.string())])
    for files in _in_slices(batches):
        rows = []
        for path, content in files:
            try:
                rows.append((path, docx_text(content), None))
            except Exception as error:  # a broken file is quarantined, never fails the job
                rows.append((path, None, f"unreadable_docx: {type(error).__name__}"))
        yield _record_batch(rows, schema)


def parse_xlsx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: (path, content) to one row per sheet."""
    schema = pa.schema(
        [("path", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string()), ("csv", pa.string()), ("reason", pa.string())]
    )
    for files in _in_slices(batches):
        rows = []
        for path, content in files:
            try:
                rows.extend([(path, i, sheet, csv, None) for i, (sheet, csv) in enumerate(xlsx_sheets(content))])
            except Exception as error:
                rows.append((path, 0, None, None, f"unreadable_xlsx: {type(error).__name__}"))
        yield _record_batch(rows, schema)
