"""Documents as files: page rows of each key to a PDF, a DOCX table or an XLSX sheet, and back to text or rows.

A file is made from the rows of one key in one task: a form, a sheet of labels, a packing list.  The
writers lay out plain text; drawing of marks and exact fonts is left to others.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rows = list[list[str]]
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_OPEN = "http://schemas.openxmlformats.org"
_MAIN, _WORD = f"{_OPEN}/spreadsheetml/2006/main", f"{_OPEN}/wordprocessingml/2006/main"


@lru_cache(64)
def _fixed(kind: str, part: str, content_type: str, body: str | None, more: tuple[str, ...]) -> bytes:
    """The parts of a package that are the same in every file: all but the main part where ``body`` is None, else all but ``more``."""
    out = io.BytesIO()
    types = "".join(f'<Override PartName="/{p}" ContentType="{t}"/>' for p, t in ((part, content_type), *(((f"xl/worksheets/{k}.xml", f"application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml")) for k in more)))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_OPEN}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_OPEN}/package/2006/relationships"><Relationship Id="r1" Type="{_OPEN}/officeDocument/2006/relationships/officeDocument" Target="{part}"/></Relationships>')
        if body is not None:
            z.writestr(part, _HEAD + body)
        for k in more:
            z.writestr(f"xl/_rels/{kind}.xml.rels", f'{_HEAD}<Relationships xmlns="{_OPEN}/package/2006/relationships"><Relationship Id="r1" Type="{_OPEN}/officeDocument/2006/relationships/worksheet" Target="worksheets/{k}.xml"/></Relationships>')
    return out.getvalue()


def _with_part(fixed: bytes, path: str, text: str) -> bytes:
    """A package with one part more, added where its directory began: only that part is packed for each file."""
    at = int.from_bytes(fixed[-6:-2], "little")
    directory, n = fixed[at:-22], int.from_bytes(fixed[-12:-10], "little") + 1
    name, data = path.encode(), text.encode()
    pressed = zlib.compress(data, 6, -15)
    entry = struct.pack("<5H3L2H", 20, 0x800, 8, 0, 33, zlib.crc32(data), len(pressed), len(data), len(name), 0)
    added = b"PK\x01\x02" + struct.pack("<H", 20) + entry + struct.pack("<3H2L", 0, 0, 0, 0, at) + name
    body = b"PK\x03\x04" + entry + name + pressed
    end = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, len(directory) + len(added), at + len(body), 0)
    return b"".join((fixed[:at], body, directory, added, end))


def _column(n: int) -> str:
    return ("" if n < 26 else _column(n // 26 - 1)) + chr(65 + n % 26)


def xlsx(rows: Rows, name: str = "Sheet1") -> bytes:
    cells = lambda i, row: "".join(f'<c r="{_column(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for j, v in enumerate(row))
    sheet = f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(f"""<row r="{i}">{cells(i, row)}</row>""" for i, row in enumerate(rows, 1))}</sheetData></worksheet>'
    book = f'<workbook xmlns="{_MAIN}" xmlns:r="{_OPEN}/officeDocument/2006/relationships"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="r1"/></sheets></workbook>'
    return _with_part(_fixed("workbook", "xl/workbook.xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", book, ("sheet1",)), "xl/worksheets/sheet1.xml", _HEAD + sheet)


def xlsx_rows(data: bytes) -> Rows:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    row, cell, text = (f"{{{_MAIN}}}{x}" for x in ("row", "c", "t"))
    return [["".join([t.text or "" for t in c.iter(text)]) for c in r.iter(cell)] for r in sheet.iter(row)]


def docx(rows: Rows) -> bytes:
    """A table; a line break in a cell starts a paragraph."""
    paragraph = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    cell = lambda v: f"<w:tc>{''.join(map(paragraph, v.split(chr(10))))}</w:tc>"
    table = "".join(f"<w:tr>{''.join(map(cell, row))}</w:tr>" for row in rows)
    body = f'<w:document xmlns:w="{_WORD}"><w:body><w:tbl>{table}</w:tbl><w:p/></w:body></w:document>'
    return _with_part(_fixed("document", "word/document.xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", None, ()), "word/document.xml", _HEAD + body)


def docx_rows(data: bytes) -> Rows:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    w = f"{{{_WORD}}}"
    text = lambda c: "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in c.iter(f"{w}p"))
    return [[text(c) for c in row.iter(f"{w}tc")] for row in body.iter(f"{w}tr")]


def pdf(pages: Rows) -> bytes:
    """A page for each list of lines."""
    shown = lambda t: t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>".encode(), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for i, lines in enumerate(pages):
        stream = zlib.compress(b"BT /F1 11 Tf 14 TL 54 740 Td\n" + b"".join(b"(" + shown(line) + b") Tj T*\n" for line in lines) + b"ET")
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Contents {5 + 2 * i} 0 R>>".encode())
        objects.append(f"<</Length {len(stream)}/Filter/FlateDecode>>\nstream\n".encode() + stream + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    table = "".join(f"{p:010d} 00000 n \n" for p in places)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n{table}trailer\n<</Size {len(objects) + 1}/Root 1 0 R>>\nstartxref\n{len(out)}\n%%EOF\n".encode()
    return bytes(out)


_STREAM = re.compile(rb"<<(?P<d>(?:[^<>]|<[^<]|<<[^<>]*>>)*)>>\s*stream\r?\n", re.S)
_SHOWN = re.compile(rb"\((?P<t>(?:\\.|[^\\()])*)\)|(?P<o>Tj|TJ|T\*|Td|TD|Tm|'|\")", re.S)


def pdf_text(data: bytes) -> str:
    """The text of a PDF's content streams, line by line, where fonts use Latin codes."""
    lines = []
    for m in _STREAM.finditer(data):
        length = re.search(rb"/Length\s+(\d+)", m["d"])
        stop = m.end() + int(length[1]) if length else data.find(b"endstream", m.end())
        body = data[m.end() : stop]
        if b"FlateDecode" in m["d"]:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if not re.search(rb"\bBT\b", body):
            continue
        line = b""
        for t in _SHOWN.finditer(body):
            if t["t"] is not None:
                line += re.sub(rb"\\(\d{1,3}|.)", lambda x: bytes([int(x[1], 8) & 255]) if x[1].isdigit() else {b"n": b"\n", b"t": b"\t", b"r": b""}.get(x[1], x[1]), t["t"])
            elif t["o"] not in (b"Tj", b"TJ") and line:
                lines.append(line)
                line = b""
        lines += [line] if line else []
    return "\n".join(x.decode("cp1252", "replace") for x in lines)


def files(rows: DataFrame, key: str, order: str, columns: list[str], made: Callable[[Rows], bytes]) -> DataFrame:
    """key, content: one file from the rows of each key, in an order; nulls are empty. A file's rows are
    brought together as one value, as they are in the file."""
    kind = rows.schema[key].dataType.simpleString()
    texts_ = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    lines = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), texts_.alias("v")))), lambda x: x["v"]).alias("lines"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "content": [made([list(row) for row in p]) for p in b["lines"]]})

    return lines.mapInPandas(run, f"{key} {kind}, content binary")


def texts(found: DataFrame, key: str) -> DataFrame:
    """key, text of PDF files (key, content)."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [pdf_text(bytes(c)) for c in b["content"]]})

    return found.select(key, "content").mapInPandas(run, f"{key} {kind}, text string")


def cells(found: DataFrame, key: str, read: Callable[[bytes], Rows]) -> DataFrame:
    """key, row, cells of XLSX or DOCX files (key, content)."""
    kind = found.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, row) for k, c in zip(b[key], b["content"], strict=True) for i, row in enumerate(read(bytes(c)))]
            yield pd.DataFrame(out, columns=[key, "row", "cells"])

    return found.select(key, "content").mapInPandas(run, f"{key} {kind}, row int, cells array<string>")
