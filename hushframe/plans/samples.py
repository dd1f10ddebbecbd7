"""Small office files packed from table rows, to exercise the file readers at table scale."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006/relationships"

# Files packed as Python objects at a time, in every task.
FILES_AT_ONCE = 100


def _zipped(parts: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, body in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return buffer.getvalue()


def docx_bytes(text: str) -> bytes:
    """A word-processor file with one paragraph per line."""
    paragraphs = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n")
    )
    return _zipped({"word/document.xml": f'<w:document xmlns:w="{_W}"><w:body>{paragraphs}</w:body></w:document>'})


def xlsx_bytes(sheets: dict[str, list[list[str]]]) -> bytes:
    """A workbook of text cells held in the shared string table."""
    shared: dict[str, int] = {}
    parts: dict[str, str] = {}
    names = links = ""
    for i, (name, rows) in enumerate(sheets.items(), start=1):
        body = ""
        for r, row in enumerate(rows, start=1):
            cells = "".join(
                f'<c r="{chr(65 + c)}{r}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
                for c, v in enumerate(row)
            )
            body += f'<row r="{r}">{cells}</row>'
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S}"><sheetData>{body}</sheetData></worksheet>'
        names += f'<sheet name="{escape(name)}" sheetId="{i}" r:id="rId{i}"/>'
        links += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
    items = "".join(f'<si><t xml:space="preserve">{escape(v)}</t></si>' for v in shared)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{_S}">{items}</sst>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_S}" xmlns:r="{_R}"><sheets>{names}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{_P}">{links}</Relationships>'
    return _zipped(parts)


def _packed(batches: Iterator[pa.RecordBatch], pack: Callable[..., bytes]) -> Iterator[pa.RecordBatch]:
    """The first column, and a file packed from the others, for a few rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, FILES_AT_ONCE):
            path, *others = batch.slice(first, FILES_AT_ONCE).columns
            content = [pack(*row) for row in zip(*[c.to_pylist() for c in others], strict=True)]
            yield pa.RecordBatch.from_arrays([path, pa.array(content, pa.binary())], names=["path", "content"])


def pack_docx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: (path, text) to (path, content)."""
    return _packed(batches, docx_bytes)


def pack_xlsx(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` body: (path, header, row) to (path, content), one sheet each."""
    return _packed(batches, lambda header, row: xlsx_bytes({"Sheet1": [header, row]}))
