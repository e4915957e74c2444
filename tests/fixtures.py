"""Small files of each kind, written here with the standard library."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

MARKDOWN = b"""# Handbook

Welcome to the lake house.

## Leave

Everyone gets 27 days of paid leave per year. Up to four unused days may be carried over.

### Parents

New parents get 20 weeks of fully paid leave.

```
# not a heading
```

## Travel

> Keep receipts.

The daily meal allowance is 48 EUR during trips.
"""

HTML = b"""<!DOCTYPE html><html><head><title> Probe help </title><style>p{}</style><script>var t = "</p>";</script></head>
<body><nav><a href="/">Home</a></nav><h1>Probe <b>FAQ</b></h1><p>Hello
<b>bold</b> world.<h2>Battery</h2><p>The battery of the probe lasts about 22 months.<br>It is sealed.
<ul><li>one<li>two</ul><table><tr><td>Model</td><td>Range</td></tr><tr><td>P1</td><td>40 m</td></tr></table>
<!-- secret --><footer>Imprint</footer></body></html>"""

_STYLES = {"Title": "Title", "Heading1": "heading 1", "ListBullet": "List Bullet"}


def docx(paragraphs: list[tuple[str | None, str]], table: list[list[str]] = (), title: str | None = None) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>' if s else ''}<w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for s, t in paragraphs)
    t = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{escape(c)}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in _STYLES.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p}{f'<w:tbl>{t}</w:tbl>' if t else ''}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        if title:
            z.writestr("docProps/core.xml", f'<x xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{escape(title)}</dc:title></x>')
    return out.getvalue()


DOCX = docx(
    [("Title", "Guide"), (None, "For people who start."), ("Heading1", "First day"), (None, "The first day starts at 09:15 at the front desk."), ("ListBullet", "Bring an id."), ("Heading1", "Probation"), (None, "The probation period is five months.")],
    [["Task", "Days"], ["Security course", "10"], ["", ""]],
)


def pdf(pages: list[list[str]], title: str = "Rules", deflate: bool = False, encrypted: bool = False) -> bytes:
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Title (%s) >>" % title.encode()]
    for i, lines in enumerate(pages):
        shown = b"\n".join(b"(%s) Tj 0 -14 Td" % x.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") for x in lines)
        content = b"BT /F1 11 Tf 72 720 Td\n" + shown + b"\nET"
        if deflate:
            content = zlib.compress(content)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(content), b" /Filter /FlateDecode" * deflate, content))
    body = b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1))
    return b"%PDF-1.4\n" + body + b"trailer << /Root 1 0 R /Info 3 0 R%s >>\n%%%%EOF" % (b" /Encrypt 9 0 R" * encrypted)


PDF = pdf([["Security rules", "Passwords must have at least 16 characters. They are kept", "in the vault (always)."], ["Incidents must be reported within two hours.", "Logs are retained for 300 days."]])

EXAMPLES = """// questions about the fixtures
{"id": "leave", "question": "How many days of paid leave does everyone get per year?", "expected_sources": ["handbook.md"], "expected_answer": "27 days of paid leave per year."}
{"id": "parents", "question": "How long is the leave of new parents?", "expected_sources": ["handbook.md"], "expected_answer": "20 weeks of fully paid leave."}

{"id": "battery", "question": "How long does the battery of the probe last?", "expected_sources": ["probe.html"], "expected_answer": "About 22 months."}
{"id": "password", "question": "How many characters must passwords have?", "expected_sources": ["rules.pdf#p1"], "expected_answer": "At least 16 characters."}
{"id": "incident", "question": "When must incidents be reported?", "expected_sources": ["rules.pdf#P2"], "expected_answer": "Within two hours."}
{"question": "When does the first day start?", "expected_sources": ["guide.docx"], "expected_answer": "At 09:15 at the front desk."}
"""

FILES = {"handbook.md": MARKDOWN, "probe.html": HTML, "guide.docx": DOCX, "rules.pdf": PDF}
