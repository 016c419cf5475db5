"""The PDF reader on files made here, object by object."""

import zlib

import pytest

from tracewell.operators import documents as D
from tracewell.sources import parsers, pdf


def _file(objects, packed=(), deflate=True):
    """A file of objects (number -> text, or (head, bytes) for a stream); those of ``packed`` stand in an object stream."""
    out = b"%PDF-1.7\n%\xe2\xe3\n"
    for number, value in objects.items():
        if isinstance(value, tuple):
            head, body = value
            if deflate:
                body = zlib.compress(body)
                head += " /Filter /FlateDecode"
            value = f"<< {head} /Length {len(body)} >>".encode() + b"\nstream\n" + body + b"\nendstream"
        else:
            value = value.encode("latin-1")
        out += f"{number} 0 obj\n".encode() + value + b"\nendobj\n"
    if packed:
        head, body = "", ""
        for number, text in packed:
            head += f"{number} {len(body)} "
            body += text + " "
        out += _file({90: (f"/Type /ObjStm /N {len(packed)} /First {len(head)}", (head + body).encode())})[len(b"%PDF-1.7\n%\xe2\xe3\n") :].rsplit(b"trailer", 1)[0]
    return out + b"trailer\n<< /Root 1 0 R >>\n%%EOF"


ONE = b"""BT /F1 10 Tf 50 700 Td (1. First \\(a\\) part) Tj 0 -12 Td [(See Sec) 20 (tion 2) -300 (and) ] TJ ET
q 100 0 0 50 200 300 cm /Im1 Do Q BT /F1 8 Tf 1 0 0 1 210 285 Tm (Figure 1. A map) Tj ET
BI /W 1 /H 1 ID \x00(\xff EI"""
TWO = b"BT /F2 12 Tf 14 TL 50 700 Td <00010002> Tj 0 -200 Td <0003> ' ET"
CMAP = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <00420042> endbfrange"
OBJECTS = {
    1: "<< /Type /Catalog /Pages 2 0 R /Outlines 20 0 R /PageLabels << /Nums [0 << /S /r /St 4 >> 1 << /S /D /P (A-) >>] >> /Dests << /two [4 0 R /Fit] >> >>",
    2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /Im1 9 0 R >> >> >>",
    3: "<< /Type /Page /Parent 2 0 R /Contents [7 0 R] /Annots [11 0 R 12 0 R 13 0 R] >>",
    4: "<< /Type /Page /Parent 2 0 R /Contents 8 0 R >>",
    5: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [250] >>",
    6: "<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>",
    7: ("", ONE),
    8: ("", TWO),
    9: ("/Subtype /Image /Width 1 /Height 1", b"\0"),
    10: ("", CMAP),
    11: "<< /Subtype /Link /Rect [50 690 90 702] /A << /S /URI /URI (http://x.org/a) >> >>",
    12: "<< /Subtype /Link /Rect [50 680 90 690] /Dest /two >>",
    20: "<< /First 21 0 R >>",
    21: "<< /Title (One) /Dest [3 0 R /Fit] /First 22 0 R /Next 23 0 R >>",
    22: "<< /Title <FEFF00C4> /A << /S /GoTo /D [4 0 R /Fit] >> >>",
    23: "<< /Title (Three) /Next 21 0 R >>",
}
PACKED = [(13, "<< /Subtype /Text /Rect [0 0 1 1] >>")]


@pytest.mark.parametrize("deflate", [True, False])
def test_read(deflate):
    rows = pdf.read(_file(OBJECTS, PACKED, deflate))
    of = {k: [r for r in rows if r[0] == k] for k in ("page", "block", "image", "link", "outline")}
    assert [(r[1], r[3], r[8]) for r in of["page"]] == [(0, "iv", 800.0), (1, "A-1", 800.0)]
    assert [(r[1], r[4]) for r in of["block"]] == [(0, "1. First (a) part\nSee Section 2 and"), (0, "Figure 1. A map"), (1, "ABB"), (1, "BC")]
    x0, y0, x1, y1 = of["block"][0][7]
    assert x0 == 50 and 91 < y0 < 93 and 113 < y1 < 115 and x1 > 100
    assert [r[7] for r in of["image"]] == [(200, 450, 300, 500)]
    assert [(r[5], r[6], r[7]) for r in of["link"]] == [("http://x.org/a", None, (50, 98, 90, 110)), (None, 1, (50, 110, 90, 120))]
    assert [(r[2], r[3], r[4], r[6]) for r in of["outline"]] == [(0, "1", "One", 0), (1, "2", "Ä", 1), (2, "1", "Three", None)]
    assert pdf.pages_of(_file(OBJECTS, PACKED)) == [(r[3], r[4]) for r in of["page"]]


def test_predictors():
    rows = bytes([2, 1, 2, 3, 2, 1, 1, 1, 1, 5, 1, 1, 4, 1, 0, 0, 3, 2, 2, 2])
    assert pdf._undo(rows, {"Predictor": 12, "Columns": 3}) == bytes([1, 2, 3, 2, 3, 4, 5, 6, 7, 6, 6, 7, 5, 7, 9])


def test_bad_files(spark):
    files = [("a", bytearray(_file(OBJECTS))), ("b", bytearray(b"no pdf")), ("c", bytearray(b"%PDF-1.4\n1 0 obj << /Pages 2 0 R")), ("d", bytearray(_file(OBJECTS).replace(b"/Root", b"/Encrypt 9 0 R /Root"))), ("e", bytearray())]
    rows = pdf.scan_pdf(spark.createDataFrame(files, "path string, content binary")).collect()
    errors = {r.path: r.error for r in rows if r.kind == "error"}
    assert set(errors) == {"b", "d", "e"} and "encrypted" in errors["d"]
    assert {r.path for r in rows if r.kind == "page"} == {"a"}
    assert parsers.parse(spark.createDataFrame(files[:2], "path string, content binary"), "pdf").where("error is null").count() == 2


def test_documents_of_pdf_files(spark):
    tables = pdf.pdf_blocks(pdf.scan_pdf(spark.createDataFrame([("a", bytearray(_file(OBJECTS)))], "path string, content binary")))
    made = D.build(tables["blocks"], tables["pages"], tables["images"], tables["links"], tables["labels"])
    kinds = [r.block_type for r in made["blocks"].where("page = 0").orderBy("pos").collect()]
    assert "figure" in kinds and "caption" in kinds
    assert {(r.number, r.title) for r in made["figures"].collect()} == {("1", "A map")}
    assert ("http://x.org/a", "parser_link") in {(r.target_id, r.method) for r in made["relations"].collect()}
    assert [(r.title, r.page) for r in tables["outline"].orderBy("pos").collect()] == [("One", 0), ("Ä", 1), ("Three", None)]
