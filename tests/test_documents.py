"""Office documents written here, and their chunks by hand."""

import io
import zipfile

import pytest

from corpusmill.sources import documents as D

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'  # noqa: E741


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def pack(parts):
    return archive(**{k.replace("/", "__"): v for k, v in parts.items()})


def p(*runs):
    return "<w:p>" + "".join(f'<w:r><w:rPr/><w:t xml:space="preserve">{t}</w:t></w:r>' for t in runs) + "</w:p>"


def docx(body):
    return pack({"word/document.xml": f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>'})


def xlsx(sheets, strings=()):
    parts = {"xl/workbook.xml": f"<workbook {S}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {S}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>"
    return pack(parts | {f"xl/worksheets/s{i}.xml": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>" for i, rows in enumerate(sheets.values())})


def test_docx_paragraphs_and_tables():
    table = "<w:tbl><w:tr><w:tc>" + p("a", "b") + p("c") + "</w:tc><w:tc>" + p(" ") + "</w:tc><w:tc>" + p("d") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc></w:tr></w:tbl>"
    body = p("First ", "line &amp; more") + p("  ") + table + p() + '<w:p><w:hyperlink><w:r><w:t>linked</w:t></w:r></w:hyperlink><w:r><w:t>last</w:t><w:br/></w:r></w:p>'
    assert list(D.document_chunks(docx(body), "docx")) == [("verbatim", None, 1, 3, "First line & more\nab c | d\nlast", None)]
    assert list(D.document_chunks(docx(""), "docx")) == []


def test_docx_windows():
    found = list(D.document_chunks(docx("".join(p("x" * 50) for _ in range(20))), "docx", 50))
    assert found[0][2:4] == (1, 3) and found[-1][3] == 20 and all(len(c[4]) <= 200 for c in found)


def test_xlsx_cells():
    rows = """<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>1.50</v></c></row><row r="3"><c r="B3"/></row>
    <row r="4"><c r="C4" t="inlineStr"><is><t>in</t><r><t>line</t></r></is></c><c r="D4" t="b"><v>1</v></c></row>
    <row><c t="str"><v>formula</v></c><c t="e"><v>#DIV/0!</v></c><c><v>1E+3</v></c></row>"""
    data = xlsx({"One": rows, "None": "", "Two": '<row r="1"><c r="A1" t="s"><v>1</v></c></row>'}, ["<t>shared</t><rPh><t>no</t></rPh>", "<r><t>ri</t></r><r><t>ch</t></r>"])
    assert list(D.document_chunks(data, "xlsx")) == [
        ("section", "One", 1, 3, "\tshared\t\t1.5\n\t\tinline\ttrue\nformula\t#DIV/0!\t1000\t", None),
        ("section", "Two", 1, 1, "rich", None),
    ]


@pytest.mark.parametrize(("text", "shown"), [("1", "1"), ("1.0", "1"), ("-0.25", "-0.25"), ("1e21", "1000000000000000000000"), ("1e-7", "0.0000001"), ("120", "120"), ("x", "x"), ("0.1", "0.1")])
def test_numbers(text, shown):
    assert D.number(text) == shown


def test_long_sheet_is_windows():
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 122))
    found = list(D.document_chunks(xlsx({"Long": rows}), "xlsx", 20))
    assert found[0][1] == "Long (rows 1–30)" and found[0][4].split("\n")[:3] == ["1", "2", "3"] and found[-1][3] == 121
    short = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c></row>' for i in range(1, 121))
    assert [c[:4] for c in D.document_chunks(xlsx({"Short": short}), "xlsx", 20)] == [("section", "Short", 1, 120)]


def test_ods():
    cell = lambda t, **a: "<table:table-cell " + " ".join(f'{k.replace("_", ":", 1).replace("_", "-")}="{v}"' for k, v in a.items()) + f"><text:p>{t}</text:p></table:table-cell>"
    content = f"""<office:document-content {O}><office:body><office:spreadsheet><table:table table:name="S">
    <table:table-row><table:table-cell table:number-columns-repeated="2"/>{cell("<text:span>a</text:span>b")}{cell("1,5", office_value_type="float", office_value="1.50")}</table:table-row>
    <table:table-row table:number-rows-repeated="1000000"><table:table-cell table:number-columns-repeated="1000"/></table:table-row>
    <table:table-row table:number-rows-repeated="2">{cell("x", table_number_columns_repeated="2")}</table:table-row></table:table></office:spreadsheet></office:body></office:document-content>"""
    assert list(D.document_chunks(pack({"content.xml": content}), "ods")) == [("section", "S", 1, 3, "\t\tab\t1.5\nx\tx\t\t\nx\tx\t\t", None)]


def test_chunk_documents(spark):
    good = docx(p("text"))
    bomb = pack({"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "aaaa">]><w:document {W}><w:body>{p("&amp;a;")}</w:body></w:document>'})
    rows = [("a/x.docx", good), ("a/X.DOCX", good), ("b/empty.docx", docx("")), ("c/cut.docx", good[:100]), ("d/none.xlsx", None), ("e/dtd.docx", bomb), ("f/other.txt", b"text"), ("g/part.xlsx", pack({"a": "b"})), ("h/y.xlsx", xlsx({"S": '<row><c><v>1</v></c></row>'}))]
    got = {r["path"]: r for r in D.chunk_documents(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {"a/x.docx", "a/X.DOCX", "c/cut.docx", "d/none.xlsx", "e/dtd.docx", "g/part.xlsx", "h/y.xlsx"}
    assert got["a/X.DOCX"]["content"] == "text" and got["a/x.docx"]["language"] == "docx" and got["h/y.xlsx"]["name"] == "S"
    assert all(got[k]["error"] and got[k]["content"] is None for k in ("c/cut.docx", "d/none.xlsx", "e/dtd.docx", "g/part.xlsx"))


def test_read_documents(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "a.docx").write_bytes(docx(p("one") + p("two")))
    (tmp_path / "b.xlsx").write_bytes(xlsx({"S": '<row><c t="str"><v>v</v></c></row>'}))
    (tmp_path / "c.txt").write_text("no")
    got = sorted((r["path"].rpartition("/")[2], r["language"], r["content"], r["error"]) for r in D.read_documents(spark, str(tmp_path)).collect())
    assert got == [("a.docx", "docx", "one\ntwo", None), ("b.xlsx", "spreadsheet", "v", None)]
