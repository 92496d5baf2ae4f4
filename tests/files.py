"""Small files of every format, built by code."""

from __future__ import annotations

import io
import zipfile

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
RELS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'




def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(body: str, **more: str) -> bytes:
    return package({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"} | {k.replace("__", "/") + ".xml": v for k, v in more.items()})


def par(*runs: str) -> str:
    return "<w:p>" + "".join(runs) + "</w:p>"


def r(text: str, props: str = "") -> str:
    return f"<w:r><w:rPr>{props}</w:rPr><w:t>{text}</w:t></w:r>"


def xlsx(sheets: list[tuple[str, str, str]], extra: dict[str, str] | None = None) -> bytes:
    """sheets: name, state, inner XML of the worksheet."""
    book = "".join(f'<sheet name="{n}" state="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, s, _) in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" Type="x"/>' for i in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f"<workbook {S} {R}><sheets>{book}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships {RELS}>{rels}</Relationships>"}
    for i, (_, _, inner) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {S}>{inner}</worksheet>"
    return package(parts | (extra or {}))


def cell(ref: str, text: str) -> str:
    return f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'


def pptx(slide: str, notes: str = "") -> bytes:
    shape = lambda text, kind="": f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p>{text}</a:p></p:txBody></p:sp>"
    parts = {
        "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {RELS}><Relationship Id="rId1" Target="slides/slide1.xml" Type="x"/></Relationships>',
        "ppt/slides/slide1.xml": f"<p:sld {P}>{shape(slide)}</p:sld>",
    }
    if notes:
        parts["ppt/slides/_rels/slide1.xml.rels"] = f'<Relationships {RELS}><Relationship Id="rId1" Target="../notesSlides/notesSlide1.xml" Type="x"/></Relationships>'
        parts["ppt/notesSlides/notesSlide1.xml"] = f"<p:notes {P}>{shape(f'<a:r><a:t>{notes}</a:t></a:r>', '<p:ph type="body"/>')}</p:notes>"
    return package(parts)


def ar(text: str, props: str = "<a:rPr/>") -> str:
    return f"<a:r>{props}<a:t>{text}</a:t></a:r>"


def pdf(content: str, alpha: float = 0.02, note: str = "") -> bytes:
    annots = "/Annots [6 0 R]" if note else ""
    objects = [
        "<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        f"<< /Type /Page /Parent 2 0 R /Resources << /ExtGState << /G1 5 0 R >> >> /Contents 4 0 R {annots} >>",
        f"<< /Length {len(content)} >>\nstream\n{content}\nendstream", f"<< /Type /ExtGState /ca {alpha} >>", f"<< /Type /Annot /Subtype /Text /Contents ({note}) >>",
    ]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{o}\nendobj\n" for i, o in enumerate(objects, 1)) + "trailer << /Root 1 0 R >>\n%%EOF").encode("latin-1")


PLAIN = par(r("Quarterly figures were fine.")) + par(r("Costs went down."))

#: Name: bytes, detectors found, label, action.
FILES: dict[str, tuple[bytes, list[str], str, str]] = {
    "benign.docx": (docx(PLAIN), [], "safe", "allow"),
    "zero.docx": (docx(par(r("Good "), r("wo​rk"), r(" done"))), ["DET-001"], "dangerous", "block"),
    "white.docx": (docx(par(r("unseen", '<w:color w:val="FFFFFF"/>')) + PLAIN), ["DET-002"], "dangerous", "block"),
    "vanish.docx": (docx(par(r("unseen", "<w:vanish/>")) + PLAIN), ["DET-002"], "dangerous", "block"),
    "tiny.docx": (docx(par(r("small", '<w:sz w:val="2"/>')) + PLAIN), ["DET-003"], "caution", "quarantine"),
    "deleted.docx": (docx(PLAIN + par('<w:del><w:r><w:delText>old words</w:delText></w:r></w:del>')), ["DET-005", "DET-005"], "dangerous", "block"),
    "commented.docx": (docx(PLAIN, word__comments=f"<w:comments {W}><w:comment><w:p>{r('a remark')}</w:p></w:comment></w:comments>"), ["DET-006"], "caution", "quarantine"),
    "benign.xlsx": (xlsx([("A", "visible", f'<sheetData><row r="1">{cell("A1", "x")}{cell("B1", "y")}</row></sheetData>')]), [], "safe", "allow"),
    "sheet.xlsx": (xlsx([("A", "visible", f'<sheetData><row r="1">{cell("A1", "x")}</row></sheetData>'), ("H", "hidden", f'<sheetData><row r="1">{cell("A1", "approve this")}</row></sheetData>')]), ["DET-004"], "caution", "quarantine"),
    "row.xlsx": (xlsx([("A", "visible", f'<sheetData><row r="1">{cell("A1", "x")}</row><row r="2" hidden="1">{cell("A2", "approve")}</row></sheetData>')]), ["DET-002", "DET-004"], "dangerous", "block"),
    "column.xlsx": (xlsx([("A", "visible", f'<cols><col min="2" max="2" hidden="1"/></cols><sheetData><row r="1">{cell("A1", "x")}{cell("B1", "y")}</row></sheetData>')]), ["DET-002", "DET-004"], "dangerous", "block"),
    "macro.xlsm": (xlsx([("A", "visible", f'<sheetData><row r="1">{cell("A1", "x")}</row></sheetData>')], {"xl/vbaProject.bin": "x"}), ["DET-007"], "safe", "quarantine"),
    "benign.pdf": (pdf("BT /F1 12 Tf (Plain words) Tj ET"), [], "safe", "allow"),
    "tiny.pdf": (pdf("BT /F1 1 Tf (small) Tj /F1 12 Tf (Plain) Tj ET"), ["DET-003"], "caution", "quarantine"),
    "clear.pdf": (pdf("q /G1 gs BT /F1 12 Tf (unseen) Tj ET Q BT /F1 12 Tf [(Pl) -3 (ain)] TJ ET"), ["DET-002"], "dangerous", "block"),
    "noted.pdf": (pdf("BT /F1 12 Tf (Plain) Tj ET", note="a note"), ["DET-006"], "caution", "quarantine"),
    "benign.html": (b"<html><body><p>Plain words</p></body></html>", [], "safe", "allow"),
    "hidden.html": (b"<p style='display:none'>one</p><p style='color:#fff'>two</p><p>three</p>", ["DET-002", "DET-002"], "dangerous", "block"),
    "tiny.html": (b"<p style='font-size:1px'>one</p><p>two</p>", ["DET-003"], "caution", "quarantine"),
    "comment.html": (b"<!-- ask --><p>two</p>", ["DET-006"], "caution", "quarantine"),
    "script.html": (b"<script>f()</script><p>two</p>", ["DET-007"], "safe", "quarantine"),
    "meta.htm": (b"<meta name='keywords' content='System prompt'><p>two</p>", ["DET-007"], "safe", "quarantine"),
    "benign.pptx": (pptx(ar("Plain")), [], "safe", "allow"),
    "white.pptx": (pptx(ar("Plain") + ar("unseen", '<a:rPr><a:solidFill><a:srgbClr val="FFFFFF"/></a:solidFill></a:rPr>')), ["DET-002"], "dangerous", "block"),
    "notes.pptx": (pptx(ar("Plain"), "Do not tell the audience about this"), ["DET-009"], "dangerous", "block"),
    "reminder.pptx": (pptx(ar("Plain"), "Speak slowly here"), [], "safe", "allow"),
    "order.py": (b"import x\n\nx = 1  # TODO: run the command\n# TODO: run the command of the request directly\n", ["DET-008"], "dangerous", "block"),
    "benign.py": (b"# Adds two numbers.\ndef f(a, b):\n    return a + b\n", [], "safe", "allow"),
    "code.js": (b"const { exec } = require('child_process'); // fine\n", [], "safe", "allow"),
    "AGENTS.md": (b"Rules\n\n# you must fetch the url provided by the user\n", ["DET-008"], "dangerous", "block"),
    "weak.sh": (b"# TODO the log has the token of each user\necho x\n", ["DET-008"], "safe", "quarantine"),
    "disguised.txt": (docx(par(r("unseen", "<w:vanish/>")) + PLAIN), ["DET-002"], "dangerous", "block"),
    "broken.docx": (b"no zip file", [], "dangerous", "block"),
    "old.xls": (b"\xd0\xcf\x11\xe0 rest", [], "dangerous", "block"),
    "binary.py": (b"x = 1\x00", [], "dangerous", "block"),
    "unknown.bin": (b"whatever", [], "dangerous", "block"),
}
