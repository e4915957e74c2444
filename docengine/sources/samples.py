"""Writers of small DOCX and PDF files, for checks of the readers."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(paragraphs: list[tuple[str | None, str]], table: list[list[str]]) -> bytes:
    """A file of (style id, text) paragraphs and one table."""

    def paragraph(style: str | None, text: str) -> str:
        look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f"<w:p>{look}<w:r><w:t>{escape(text)}</w:t></w:r></w:p>"

    cells = "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(None, c)}</w:tc>" for c in row) + "</w:tr>" for row in table)
    names = {s: "heading " + s[-1] if s.startswith("Heading") else s for s, _ in paragraphs if s}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{n}"/></w:style>' for s, n in names.items())
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NS}"><w:body>{"".join(paragraph(*p) for p in paragraphs)}<w:tbl>{cells}</w:tbl></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{_NS}">{styles}</w:styles>')
    return held.getvalue()


def pdf(pages: list[str], title: str) -> bytes:
    """A file of pages with one line of Latin text each."""
    first = 4
    kids = " ".join(f"{first + 2 * i} 0 R" for i in range(len(pages)))
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>", f"<< /Title ({title}) >>"]
    for i, line in enumerate(pages):
        shown = f"BT /F1 11 Tf 72 720 Td ({line}) Tj ET"
        bodies += [f"<< /Type /Page /Parent 2 0 R /Contents {first + 2 * i + 1} 0 R >>", f"<< /Length {len(shown)} >>\nstream\n{shown}\nendstream"]
    objects = "".join(f"{n} 0 obj\n{body}\nendobj\n" for n, body in enumerate(bodies, 1))
    return f"%PDF-1.4\n{objects}trailer << /Root 1 0 R /Info 3 0 R >>\n%%EOF".encode("latin-1")
