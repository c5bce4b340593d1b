"""Word and Excel files with the standard library: zipped XML, read and written."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


#: Characters that a cell of a workbook can hold.
CELL = 32_767


def read_docx(data: bytes) -> dict:
    """paragraphs [(index, text)] without blank ones (indexes count them) and headings [(ord, text, level)]."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
    paragraphs, headings = [], []
    for i, p in enumerate(body.findall(f"{_W}p") if body is not None else []):
        parts = []
        for node in p.iter():
            if node.tag == f"{_W}t":
                parts.append(node.text or "")
            elif node.tag in (f"{_W}br", f"{_W}cr"):
                parts.append("\n")
            elif node.tag == f"{_W}tab":
                parts.append("\t")
        text = "".join(parts).strip()
        if not text:
            continue
        paragraphs.append((i, text))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        if (name or "").lower().startswith("heading"):
            level = re.sub(r"\D", "", name)
            headings.append((len(headings), text, int(level) if level else 1))
    return {"paragraphs": paragraphs, "headings": headings}


def write_docx(paragraphs: list[tuple[str, str | None]]) -> bytes:
    """A document of (text, style name or None), enough for read_docx and word processors."""
    def one(text: str, style: str | None) -> str:
        props = f'<w:pPr><w:pStyle w:val="{escape(style)}"/></w:pPr>' if style else ""
        return f'<w:p>{props}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join(one(*p) for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _column(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def write_xlsx(sheets: list[dict]) -> bytes:
    """Sheets of {title, header, rows, widths?}: bold white on blue header, frozen and filtered."""
    out = io.BytesIO()
    main = _S[1:-1]
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = [f"xl/worksheets/sheet{i + 1}.xml" for i in range(len(sheets))]
        types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in names)
        z.writestr(
            "[Content_Types].xml",
            '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" '
            'ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>',
        )
        pack = "http://schemas.openxmlformats.org/package/2006/relationships"
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        links = "".join(f'<Relationship Id="r{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{pack}">{links}<Relationship Id="s" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(s["title"], {chr(34): "&quot;"})}" sheetId="{i + 1}" r:id="r{i + 1}"/>' for i, s in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{tabs}</sheets></workbook>')
        z.writestr(
            "xl/styles.xml",
            f'<?xml version="1.0"?><styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/><color rgb="FFFFFFFF"/></font></fonts><fills count="3"><fill/>'
            '<fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF124191"/></patternFill></fill></fills>'
            '<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" fillId="2" applyFont="1" applyFill="1"/>'
            '<xf applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf></cellXfs></styleSheet>',
        )
        for name, s in zip(names, sheets):
            rows = []
            for r, row in enumerate([s["header"], *s["rows"]]):
                cells = []
                for c, v in enumerate(row):
                    if v is None:
                        continue
                    style = ' s="1"' if r == 0 else ' s="2"' if c in s.get("wrapped", ()) else ""
                    ref = f"{_column(c)}{r + 1}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{ref}"{style}><v>{v}</v></c>')
                    else:
                        v = ", ".join(map(str, v)) if isinstance(v, list) else str(v)
                        v = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", v)
                        if len(v) > CELL:  # what a cell cannot hold is said in it
                            note = f"… [{len(v) - CELL + 40} more characters]"
                            v = v[: CELL - len(note)] + note
                        cells.append(f'<c r="{ref}"{style} t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
                rows.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
            widths = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{w}" customWidth="1"/>' for i, w in enumerate(s.get("widths", ())))
            last = f"{_column(len(s['header']) - 1)}{len(s['rows']) + 1}"
            z.writestr(
                name,
                f'<?xml version="1.0"?><worksheet xmlns="{main}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
                + (f"<cols>{widths}</cols>" if widths else "")
                + f'<sheetData>{"".join(rows)}</sheetData><autoFilter ref="A1:{last}"/></worksheet>',
            )
    return out.getvalue()


def read_xlsx(data: bytes) -> list[list[str | None]]:
    """The rows of the first sheet as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))[0]
        rows = []
        for row in ET.fromstring(z.read(first)).iter(f"{_S}row"):
            cells: dict[int, str | None] = {}
            for c in row.findall(f"{_S}c"):
                at = 0
                for x in re.match(r"[A-Z]+", c.get("r"))[0]:
                    at = 26 * at + ord(x) - 64
                v = c.find(f"{_S}v")
                if c.get("t") == "inlineStr":
                    cells[at - 1] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif v is not None:
                    cells[at - 1] = shared[int(v.text)] if c.get("t") == "s" else v.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def term_column(rows: list[list[str | None]]) -> list[str]:
    """Terms of a sheet: the column of the first heading present of the known ones, else the first column with its first row."""
    if not rows:
        return []
    heads = [(h or "").strip().lower() for h in rows[0]]
    for name in ("acronym", "abbreviated name", "term", "parameter"):
        if name in heads:
            at, body = heads.index(name), rows[1:]
            break
    else:
        at, body = 0, rows
    return [r[at].strip() for r in body if at < len(r) and r[at] and r[at].strip()]
