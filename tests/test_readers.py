import zipfile

from quillspark.sources import readers
from quillspark.sources.tables import compare_manifests, manifest, with_optional

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(text, style=""):
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(path, body, extra=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name in extra:
            z.writestr(name, "x")


def xlsx(path, rows):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" state="hidden" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>drug</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>")


def test_reads_office_files(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("1") + "</w:tc><w:tc>" + p("2") + "</w:tc></w:tr></w:tbl>"
    docx(tmp_path / "a.docx", p("Top", "Heading1") + p("x") + p("Sub", "Heading2") + table + p("Next", "Heading1"))
    docx(tmp_path / "macro.docx", p("x"), ["word/vbaProject.bin"])
    xlsx(tmp_path / "b.xlsx", '<row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2"><v>8</v></c></row><row/>')
    xlsx(tmp_path / "c.xlsx", '<row><c r="A1"><f>1+1</f></c></row>')
    (tmp_path / "d.pdf").write_bytes(b"no")
    (tmp_path / "e.txt").write_text("x")
    got = {}
    for r in readers.read_documents(spark, str(tmp_path)).collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1], []).append(r)
    blocks = sorted(got["a.docx"], key=lambda r: r["block"])
    assert [(r["section"], r["text"]) for r in blocks] == [("Top", "Top"), ("Top", "x"), ("Top > Sub", "Sub"), ("Top > Sub", "a | b\n1 | 2"), ("Next", "Next")]
    assert sorted((r["block"], r["section"], r["text"]) for r in got["b.xlsx"]) == [(0, "One", "A: drug | C: 7"), (1, "One", "A: drug | C: 7\nA: 8")]
    assert {k: got[k][0]["error"] for k in ("macro.docx", "c.xlsx", "d.pdf", "e.txt")} == {"macro.docx": "macros", "c.xlsx": "formula_without_value", "d.pdf": "not_a_pdf", "e.txt": "unknown_kind"}
    assert readers.fingerprints(spark, str(tmp_path)).count() == 6


def test_limits(monkeypatch, tmp_path):
    docx(tmp_path / "a.docx", p("x" * 50))
    content = (tmp_path / "a.docx").read_bytes()
    monkeypatch.setattr(readers, "MAX_UNPACKED", 10)
    assert readers.parse("a.docx", content)[0][-1] == "archive_too_large"
    assert readers.parse("a.docx", b"zz")[0][-1] == "not_an_archive"


def test_damaged_files_are_rows_with_their_error(tmp_path, monkeypatch):
    docx(tmp_path / "a.docx", p("text " * 200))
    xlsx(tmp_path / "b.xlsx", '<row><c r="A1" t="s"><v>9</v></c></row>')
    good = (tmp_path / "a.docx").read_bytes()
    with zipfile.ZipFile(tmp_path / "z.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{p('deflated ' * 500)}</w:body></w:document>")
    packed = bytearray((tmp_path / "z.docx").read_bytes())
    packed[60:90] = b"\xff" * 30
    encrypted = bytearray(good)
    encrypted[6] |= 1
    encrypted[encrypted.index(b"PK\x01\x02") + 8] |= 1
    for name, content in [("x.docx", good[: len(good) // 2]), ("x.docx", bytes(packed)), ("x.docx", bytes(encrypted)), ("x.xlsx", (tmp_path / "b.xlsx").read_bytes()), ("x.docx", good.replace(b"<w:body>", b"<w:bodx>")), ("x.xlsx", good), ("x.pdf", b"%PDF-1.4 nothing")]:
        (row,) = readers.parse(name, content)
        assert row[-1] and row[5] is None, (name, row)
    assert readers.parse("x.docx", good)[0][-1] is None
    lying = (tmp_path / "z.docx").read_bytes()
    at = lying.index(b"PK\x01\x02") + 24
    monkeypatch.setattr(readers, "MAX_UNPACKED", 1000)
    assert readers.parse("x.docx", lying[:at] + (5).to_bytes(4, "little") + lying[at + 4 :])[0][-1] in ("archive_too_large", "damaged")


def test_results_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([(1, "가, 나"), (2, 'q"')], "id long, t string").coalesce(1)
    readers.write_results(df, str(tmp_path / "r"), "csv", mark=True)
    (file,) = (tmp_path / "r").glob("*.csv")
    assert file.read_bytes().startswith("\ufeffid,t\n".encode())
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).select("id").collect()] == [("1",), ("2",)]


def test_tables(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, t string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "q")], "id long, t string")
    got = {r["id"]: r["state"] for r in compare_manifests(manifest(a, "id", "t"), manifest(b, "id", "t"), "id").collect()}
    assert got == {1: "same", 2: "changed", 3: "missing", 4: "extra"}
    assert with_optional(a, {"t": "string", "u": "int"}).columns == ["id", "t", "u"]
