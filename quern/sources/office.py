"""Text of office files with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def docx_text(content: bytes) -> str:
    """The paragraphs of the body, a line each; those of tables are not among them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = _xml(z, "word/document.xml").find(f"{_W}body")
    signs = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "\n".join("".join(signs[e.tag](e) for e in p.iter() if e.tag in signs) for p in body.findall(f"{_W}p"))


def pptx_text(content: bytes) -> str:
    """The text of every shape of every slide, each followed by a line end."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        out = []
        for name in names:
            for shape in _xml(z, name).iter(f"{_P}sp"):
                if (body := shape.find(f"{_P}txBody")) is not None:
                    out.append("\n".join("".join(t.text or "" for t in p.iter(f"{_A}t")) for p in body.findall(f"{_A}p")) + "\n")
    return "".join(out)


def xlsx_rows(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cells) of a workbook, cells as text, gaps as empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in _xml(z, "xl/sharedStrings.xml").findall(f"{_S}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in _xml(z, "xl/workbook.xml").iter(f"{_S}sheet"):
            path = targets[sheet.get(f"{_R}id")].lstrip("/")
            rows: list[list[str]] = []
            for row in _xml(z, path if path.startswith("xl/") else f"xl/{path}").iter(f"{_S}row"):
                cells: dict[int, str] = {}
                for c in row.findall(f"{_S}c"):
                    letters = re.match(r"[A-Z]+", c.get("r", ""))
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(cells)
                    value = c.findtext(f"{_S}v") or ""
                    kind = c.get("t")
                    cells[at] = shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in c.iter(f"{_S}t")) if kind == "inlineStr" else value
                number = int(row.get("r", len(rows) + 1))
                rows.extend([] for _ in range(number - 1 - len(rows)))
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            width = max(map(len, rows), default=0)
            out.append((sheet.get("name"), [r + [""] * (width - len(r)) for r in rows]))
    return out


def xlsx_text(content: bytes) -> str:
    """Every sheet under a banner, cells joined by tabs and rows by line ends."""
    return "\n".join(f"--- SHEET {name} ---\n" + "\n".join("\t".join(r) for r in rows) for name, rows in xlsx_rows(content))
