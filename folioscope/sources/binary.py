"""Small per-file decoders used inside tasks (files arrive as Arrow batches)."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd

DOCX_SCHEMA = "path string, document_name string, stem string, section_no int, heading string, page_number int, section_text string"
IMAGE_SCHEMA = "path string, document_name string, stem string, suffix string, width int, height int"
PAGE_CHARS = 2500  # estimated characters of a DOCX page
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


# What a file that is no sound DOCX can raise on the way.
BROKEN = (zipfile.BadZipFile, zlib.error, ET.ParseError, EOFError, OSError, KeyError, AttributeError, NotImplementedError, RuntimeError, ValueError)


def _plain(paragraph: ET.Element) -> str:
    """Text of a paragraph with its tabs and line breaks."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    skip = {id(t) for tabs in paragraph.iter(f"{_W}tabs") for t in tabs}  # tab stops aren't tabs
    parts = [(n.text or "") if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in paragraph.iter() if id(n) not in skip]
    return "".join(parts).strip()


def _cell(node: ET.Element) -> str:
    return "\n".join(_plain(p) for p in node.findall(f"{_W}p")).strip()


def _style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    """Style names by id; localised files keep the English name of built-in styles."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    found = {}
    for style in ET.fromstring(archive.read("word/styles.xml")).findall(f"{_W}style"):
        name = style.find(f"{_W}name")
        if name is not None:
            found[style.get(f"{_W}styleId")] = name.get(f"{_W}val") or ""
    return found


def _docx_blocks(data: bytes) -> Iterator[tuple[str, str]]:
    """('heading' | 'text' | 'table', text) in reading order, tables last."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ET.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = _style_names(archive)
    for p in body.findall(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        ident = (style.get(f"{_W}val") or "") if style is not None else ""
        name = names.get(ident, ident).lower()
        yield ("heading" if "heading" in name or "title" in name else "text"), _plain(p)
    for table in body.findall(f"{_W}tbl"):
        rows = [[_cell(c) for c in r.findall(f"{_W}tc")] for r in table.findall(f"{_W}tr")]
        yield "table", "\n".join(" | ".join(r) for r in rows if any(r))


def _docx_rows(data: bytes) -> list[tuple[str, int, str]]:
    """(heading, page estimate, text) per section and page."""
    out, held, heading, page, count = [], [], "", 1, 0

    def close() -> None:
        if held:
            out.append((heading, page, "\n".join(held)))
            held.clear()

    for kind, text in _docx_blocks(data):
        if not text:
            continue
        if kind == "heading":
            close()
            heading = text
            continue
        held.append(text)
        count += len(text)
        if kind == "text" and count >= PAGE_CHARS:
            close()
            page, count = page + 1, 0
    close()
    return out


def docx_sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in DOCX_SCHEMA.split(", ")]
    for pdf in batches:
        rows = []
        for path, name, stem, data in zip(pdf.path, pdf.document_name, pdf.stem, pdf.content):
            try:
                found = _docx_rows(data)
            except BROKEN:
                continue  # listed by ``docx_errors``
            rows += [(path, name, stem, i, h, p, t) for i, (h, p, t) in enumerate(found, 1)]
        yield pd.DataFrame(rows, columns=columns)


def docx_errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, data in zip(pdf.path, pdf.content):
            try:
                _docx_rows(data)
            except BROKEN as e:
                rows.append((path, f"docx: {e}"))
        yield pd.DataFrame(rows, columns=["path", "error"])


def _image_size(data: bytes) -> tuple[int, int]:
    """Width and height from a PNG or JPEG header; (0, 0) if it is neither or cut off."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 else (0, 0)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        marker, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return 0, 0


def image_sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes = [_image_size(d or b"") for d in pdf.content]
        yield pdf.drop(columns="content").assign(width=[w for w, _ in sizes], height=[h for _, h in sizes])
