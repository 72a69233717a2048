"""Workbooks in Office Open XML, read and written with the standard library."""

from __future__ import annotations

import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

# Namespaces and part types of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML cannot hold.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
#: Cell styles by (bold, marked), and the most text that a cell holds.
STYLES = {(False, False): 0, (True, False): 1, (False, True): 2, (True, True): 3}
CELL_MOST = 32_767


@dataclass
class Grid:
    name: str
    header: list[str]
    cells: list[list]
    bold: list[list[bool]] = field(default_factory=list)
    marked: list[list[bool]] = field(default_factory=list)
    widths: list[int] = field(default_factory=list)


def letters(column: int) -> str:
    """Column 0 is A, 26 is AA."""
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(value, row: int, column: int, style: int) -> str:
    at = f'r="{letters(column)}{row}"' + (f' s="{style}"' if style else "")
    if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value and abs(value) < 1e15:
        return f"<c {at}><v>{value!r}</v></c>"
    text = _BAD.sub("", "" if value is None else str(value))[:CELL_MOST]
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>' if text else f"<c {at}/>"


def _sheet(grid: Grid, table: bool) -> str:
    flag = lambda flags, r, c: bool(r < len(flags) and c < len(flags[r]) and flags[r][c])
    rows = [[_cell(h, 1, c, 0) for c, h in enumerate(grid.header)]]
    rows += [[_cell(v, r + 2, c, STYLES[flag(grid.bold, r, c), flag(grid.marked, r, c)]) for c, v in enumerate(cells)] for r, cells in enumerate(grid.cells)]
    widths = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(grid.widths))
    data = "".join(f'<row r="{r + 1}">{"".join(row)}</row>' for r, row in enumerate(rows))
    parts = '<tableParts count="1"><tablePart r:id="rId1"/></tableParts>' if table else ""
    return f'{HEAD}<worksheet xmlns="{MAIN}" xmlns:r="{OFFICE}">{f"<cols>{widths}</cols>" if widths else ""}<sheetData>{data}</sheetData>{parts}</worksheet>'


def _relations(rows: list[tuple[str, str]]) -> str:
    return f'{HEAD}<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(rows)) + "</Relationships>"


def write(path: str, grids: list[Grid]) -> None:
    """Each grid a sheet, with a table over header and cells where there are cells."""
    parts: dict[str, str] = {}
    kinds = {"/xl/workbook.xml": "sheet.main+xml", "/xl/styles.xml": "styles+xml"}
    for i, g in enumerate(grids, 1):
        table = bool(g.cells and g.header)
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet(g, table)
        kinds[f"/xl/worksheets/sheet{i}.xml"] = "worksheet+xml"
        if table:
            ref = f"A1:{letters(len(g.header) - 1)}{len(g.cells) + 1}"
            columns = "".join(f'<tableColumn id="{c + 1}" name={quoteattr(str(h))}/>' for c, h in enumerate(g.header))
            parts[f"xl/tables/table{i}.xml"] = f'{HEAD}<table xmlns="{MAIN}" id="{i}" name="Table{i}" displayName="Table{i}" ref="{ref}"><autoFilter ref="{ref}"/><tableColumns count="{len(g.header)}">{columns}</tableColumns><tableStyleInfo name="TableStyleMedium2" showRowStripes="1"/></table>'
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = _relations([("table", f"../tables/table{i}.xml")])
            kinds[f"/xl/tables/table{i}.xml"] = "table+xml"
    sheets = "".join(f'<sheet name={quoteattr(re.sub(r"[][*?:/\\]", " ", g.name)[:31])} sheetId="{i}" r:id="rId{i}"/>' for i, g in enumerate(grids, 1))
    parts["xl/workbook.xml"] = f'{HEAD}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{sheets}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = _relations([*(("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(grids) + 1)), ("styles", "styles.xml")])
    parts["xl/styles.xml"] = (
        f'{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>'
        '<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFFF00"/></patternFill></fill></fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4">'
        + "".join(f'<xf fontId="{int(b)}" fillId="{2 if m else 0}" applyFont="1" applyFill="1"/>' for b, m in STYLES) + "</cellXfs></styleSheet>"
    )
    parts["_rels/.rels"] = _relations([("officeDocument", "xl/workbook.xml")])
    named = "".join(f'<Override PartName="{name}" ContentType="{KIND}{kind}"/>' for name, kind in kinds.items())
    parts["[Content_Types].xml"] = f'{HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{named}</Types>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def _text(element) -> str:
    """The text of runs, without phonetic ones."""
    return "".join(t.text or "" for child in element for t in ([child] if child.tag == f"{{{MAIN}}}t" else child.iter(f"{{{MAIN}}}t") if child.tag == f"{{{MAIN}}}r" else []))


def read(path: str) -> dict[str, list[list]]:
    """Rows of each sheet, in the workbook's order, the active one under None as well; numbers stay numbers, empty cells
    are None."""
    ns = {"m": MAIN}
    with zipfile.ZipFile(path) as z:
        shared = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        out: dict[str | None, list[list]] = {}
        for s in book.findall("m:sheets/m:sheet", ns):
            target = targets[s.get(f"{{{OFFICE}}}id")]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows: list[list] = []
            for row in root.findall("m:sheetData/m:row", ns):
                at = int(row.get("r") or len(rows) + 1)
                rows += [[] for _ in range(at - len(rows))]
                cells = rows[at - 1]
                for c in row.findall("m:c", ns):
                    column = _number(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (column + 1 - len(cells))
                    cells[column] = _value(c, shared, ns)
            out[s.get("name")] = rows
    names = list(out)
    view = book.find("m:bookViews/m:workbookView", ns)
    active = int(view.get("activeTab") or 0) if view is not None else 0
    return out | ({None: out[names[min(active, len(names) - 1)]]} if names else {})


def _value(c, shared: list[str], ns: dict):
    kind, v = c.get("t", "n"), c.find("m:v", ns)
    if kind == "inlineStr":
        found = c.find("m:is", ns)
        return None if found is None else _text(found)
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind != "n":
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() and "." not in v.text and "e" not in v.text.lower() else number
