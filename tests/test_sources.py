"""Files read from disk: long fields, bytes that are no text, filled-down formulas."""

import zipfile

from pyspark.sql import functions as F

from tallywise.operators import edits as E
from tallywise.sources import files

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_long_fields_and_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "long.csv").write_text('a,"' + "x" * 200_000 + '"\n')
    (tmp_path / "odd.csv").write_bytes(b"caf\xe9,1\n")
    cells = {(r.file, r.col): r.text for r in files.read_csv_grid(spark, str(tmp_path)).collect()}
    assert len(cells["long.csv", 2]) == 200_000 and cells["odd.csv", 1] == "caf�"
    assert [r.file for r in files.undecodable_files(spark, str(tmp_path)).collect()] == ["odd.csv"]


def test_filled_down_formulas_of_several_sheets(spark, tmp_path):
    rows = ('<row r="2"><c r="A2" t="s"><v>0</v></c><c r="E2"><f t="shared" ref="E2:F4" si="0">E1-C2+$B$1*SUM(A$1:A2)&amp;"A1"&amp;\'A1\'!B2</f><v>1</v></c></row>'
            '<row r="3"><c r="E3"><f t="shared" si="0"/><v>2</v></c></row>'
            '<row r="4"><c r="F4"><f t="shared" si="0"/><v>3</v></c></row>')
    parts = {
        "xl/workbook.xml": f'<workbook {NS} {REL}><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                                      '<Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {NS}><si><t>HOTEL</t></si></sst>',
        "xl/worksheets/a.xml": f'<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {NS}><sheetData><row r="1"><c r="A1"><f t="shared" si="0"/><v>9</v></c></row></sheetData></worksheet>'}
    with zipfile.ZipFile(tmp_path / "book.xlsx", "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    got = {(r.sheet, r.row, r.col): (r.text, r.formula) for r in files.read_workbooks(spark, str(tmp_path)).collect()}
    assert got["One", 2, 1] == ("HOTEL", None)
    assert got["One", 3, 5] == ("2", """=E2-C3+$B$1*SUM(A$1:A3)&"A1"&'A1'!B3""")
    assert got["One", 4, 6] == ("3", """=F3-D4+$B$1*SUM(B$1:B4)&"A1"&'A1'!C4""")
    assert got["Two", 1, 1] == ("9", None)


def test_currencies_come_from_a_table_or_a_list(spark):
    batch = spark.createDataFrame([(1, "AUD"), (2, "GPB")], "submission_id long, currency string").withColumns({
        "card_id": F.lit(1), "txn_date": F.lit("2026-01-01").cast("date"), "kind": F.lit("purchase"),
        "amount": F.lit(5).cast("decimal(18,2)"), "supplier": F.lit("HOTEL"), "needs_review": F.lit(True)})
    refused = lambda *known: {r.submission_id: r.error for r in E.refused_submissions(batch, *known).collect()}
    assert refused() == {2: "Not a known currency: GPB"}
    assert set(refused(spark.createDataFrame([("GPB",), ("GPB",)], "code string"))) == {1}
