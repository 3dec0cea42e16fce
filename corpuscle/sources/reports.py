"""Small results for people: annotation workbooks, fixed-width reports and bar charts.

All of these take samples or summaries; none is meant for a table that grows.
"""
from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def _column(i: int) -> str:
    name = ""
    while True:
        name = chr(65 + i % 26) + name
        i = i // 26 - 1
        if i < 0:
            return name


def _clean(v: str) -> str:
    return "".join(c for c in v if c in "\t\n\r" or ord(c) >= 32)


def _sheet(rows: list[list], widths: dict[int, float], filled: set[int], frozen: bool) -> str:
    out = [f'{_HEAD}<worksheet xmlns="{_MAIN}">']
    if frozen:
        out.append('<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
    if widths:
        out.append("<cols>" + "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in sorted(widths.items())) + "</cols>")
    out.append("<sheetData>")
    for r, row in enumerate(rows, 1):
        cells = []
        for i, v in enumerate(row):
            if v is None:
                continue
            style = 1 if r == 1 and frozen else 2 if i in filled else 0
            at = f'r="{_column(i)}{r}" s="{style}"'
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f"<c {at}><v>{v}</v></c>")
            else:
                cells.append(f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(_clean(str(v)))}</t></is></c>')
        out.append(f'<row r="{r}">{"".join(cells)}</row>')
    return "".join(out) + "</sheetData></worksheet>"


def workbook(columns: list[str], rows: list[tuple], to_fill: tuple[str, ...] = (), widths: dict[str, float] | None = None, instructions: list[str] = (), name: str = "Sheet") -> bytes:
    """A workbook with one table (frozen, coloured header; the columns ``to_fill`` by hand in another colour) and a
    sheet of instructions."""
    filled = {i for i, c in enumerate(columns) if c in to_fill}
    sheets = [(name, _sheet([list(columns), *map(list, rows)], {i: (widths or {})[c] for i, c in enumerate(columns) if c in (widths or {})}, filled, True))]
    if instructions:
        sheets.append(("Instructions", _sheet([[x] for x in instructions], {0: 100}, set(), False)))
    fill = lambda c: f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>'
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="4"><fill/><fill><patternFill patternType="gray125"/></fill>{fill("FFD9E1F2")}{fill("FFFFF2CC")}</fills>'
        '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/><xf fillId="3" applyFill="1"/></cellXfs></styleSheet>',
        **{f"xl/worksheets/sheet{i}.xml": x for i, (_, x) in enumerate(sheets, 1)},
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def line(*cells: tuple[str, int, str]) -> Column:
    """A fixed-width line: (column, width, format) each, ``s`` left-aligned, ``d``, ``.nf`` and ``.n%`` right-aligned."""
    parts = []
    for c, width, form in cells:
        if form == "s":
            parts.append(F.rpad(F.col(c).cast("string"), width, " "))
            continue
        v = F.coalesce(F.col(c), F.lit(0)).cast("double")
        if form == "d":
            text = F.format_string("%d", v.cast("bigint"))
        else:
            places = int(form[1:-1])
            text = F.format_string(f"%.{places}f%%", v * 100) if form[-1] == "%" else F.format_string(f"%.{places}f", v)
        parts.append(F.lpad(text, width, " "))
    return F.concat_ws(" ", *parts)


def bars(table: DataFrame, label: str, value: str, colour: str, palette: dict[str, str], most: int = 200) -> str:
    """A bar chart (SVG) of at most ``most`` rows, the longest bar first, coloured by category."""
    rows = table.select(label, F.col(value).cast("double").alias("_v"), colour).where("_v is not null").orderBy(F.desc("_v"), label).limit(most).collect()
    top = max((r["_v"] for r in rows), default=0.0) or 1.0
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="900" height="{24 * len(rows) + 20}" font-family="sans-serif" font-size="12">']
    for i, r in enumerate(rows):
        y, w = 24 * i + 10, 600 * max(r["_v"], 0.0) / top
        out.append(f'<text x="190" y="{y + 13}" text-anchor="end">{escape(str(r[label]))}</text><rect x="200" y="{y}" width="{w:.1f}" height="18" fill="{palette.get(r[colour], "#888888")}"/><text x="{205 + w:.1f}" y="{y + 13}">{r["_v"]:.3f}</text>')
    return "".join(out) + "</svg>"
