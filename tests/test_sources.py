import datetime
import io
import json
import struct
import zipfile

import pytest

from checks.exports import dbf_files, xlsx_files
from ledgersift.errors import SourceError
from ledgersift.sources import load, scan_csv, sniff_csv_dialects, write_results
from ledgersift.sources.files import list_files, method_slug

ROWS = [("Київ", 1, 2.5), ("Львів", 2, -1.0)]
LATIN = [("Café", 1, 2.5), ("Zoé", 2, -1.0)]


def text(rows, sep):
    return "\n".join(sep.join(map(str, r)) for r in [("name", "n", "v"), *rows]) + "\n"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
@pytest.mark.parametrize("encoding, rows", [("utf-8", ROWS), ("cp1251", ROWS)])
def test_csv_dialects(spark, tmp_path, encoding, rows, sep):
    (tmp_path / "t.csv").write_bytes(text(rows, sep).encode(encoding))
    found = sniff_csv_dialects(list_files(spark, str(tmp_path))).first()
    assert (found["encoding"], found["sep"], found["n_cols"]) == (encoding, sep, 3)
    assert sorted(tuple(r) for r in load(spark, str(tmp_path / "t.csv")).collect()) == sorted(rows)


def test_bytes_unknown_to_earlier_encodings_reach_latin1(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b"a;b\n\x98\x81;1\n")
    assert sniff_csv_dialects(list_files(spark, str(tmp_path))).first()["encoding"] == "latin1"


def test_directory_of_mixed_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(text(ROWS, ";").encode("cp1251"))
    (tmp_path / "b.csv").write_bytes(text(ROWS, ",").encode())
    assert scan_csv(spark, str(tmp_path)).count() == 4


def test_single_column_is_refused(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n2\n")
    with pytest.raises(SourceError):
        scan_csv(spark, str(tmp_path))


def test_unknown_extension_is_csv(spark, tmp_path):
    (tmp_path / "t.DAT").write_text("a|b\n1|2\n")
    assert load(spark, str(tmp_path / "t.DAT")).columns == ["a", "b"]


def test_json_lines_and_array(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "l.json").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1))
    for name in ("l.json", "a.json"):
        assert load(spark, str(tmp_path / name)).orderBy("a").collect()[0]["b"] == "x"


def test_record_files(spark, tmp_path, orders):
    table = orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    dbf_files(table, "o_orderstatus", f"{tmp_path}/d.dbf")
    xlsx_files(table, "o_orderstatus", f"{tmp_path}/x.xlsx")
    wanted = sorted(tuple(r) for r in table.collect())
    assert sorted(tuple(r) for r in load(spark, f"{tmp_path}/d.dbf").collect()) == wanted
    assert sorted(tuple(r) for r in load(spark, f"{tmp_path}/x.xlsx").collect()) == wanted


def test_dbf_binary_fields(spark, tmp_path):
    fields = [("i", "I", 4), ("t", "T", 8), ("y", "Y", 8), ("l", "L", 1), ("d", "D", 8)]
    rows = [
        (256, (2_440_588 + 1, 3_600_000), 12_500, "T", "20240229"), (0, (0, 0), 0, "?", ""), (7, (2_440_588, 0), -10_000, "n", "19991231"),
    ]
    body = b"".join(
        (b"*" if i == 7 else b" ") + struct.pack("<iiiq1s8s", i, *t, y, l.encode(), d.encode().ljust(8)) for i, t, y, l, d in rows
    )
    head = struct.pack("<BBBBIHH20x", 0x30, 124, 1, 1, 3, 33 + 32 * 5, 30)
    head += b"".join(struct.pack("<11sc4xBB14x", n.encode(), k.encode(), w, 0) for n, k, w in fields)
    (tmp_path / "a.dbf").write_bytes(head + b"\r" + body + b"\x1a")
    got = [tuple(r) for r in load(spark, str(tmp_path / "a.dbf")).collect()]
    assert got == [
        (256, datetime.datetime(1970, 1, 2, 1), 1.25, True, datetime.date(2024, 2, 29)), (0, None, 0.0, None, None),
    ]


def test_dbf_code_page(spark, tmp_path):
    head = bytearray(struct.pack("<BBBBIHH20x", 3, 124, 1, 1, 1, 33 + 32, 11))
    head[29] = 0xC9
    head += struct.pack("<11sc4xBB14x", b"name", b"C", 10, 0)
    (tmp_path / "a.dbf").write_bytes(bytes(head) + b"\r " + "Київ".encode("cp1251").ljust(10) + b"\x1a")
    assert load(spark, str(tmp_path / "a.dbf")).collect()[0]["name"] == "Київ"


def test_workbook_order_strings_and_dates(spark, tmp_path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="b" r:id="r2"/><sheet name="a" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="dd.mm.yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>name</t></si><si><t>day</t></si><si><r><t>Ки</t></r><r><t>їв</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="1"><v>45351.5</v></c></row><row r="3"><c r="B3" s="1"><v>1</v></c></row></sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for name, body in parts.items():
            book.writestr(name, body)
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = [tuple(r) for r in load(spark, str(tmp_path / "a.xlsx")).collect()]
    assert got == [("Київ", datetime.datetime(2024, 2, 29, 12)), (None, datetime.datetime(1899, 12, 31))]


def test_results_are_written_once(spark, tmp_path):
    flagged = spark.createDataFrame([(1, 0), (2, 1)], "id int, is_sample int")
    population, sample = write_results(flagged, f"{tmp_path}/base", "Monetary Unit Sampling", "csv")
    assert population.endswith("base_monetary_unit_sampling_population") and method_slug("K-Means Clustering") == "k-means_clustering"
    assert load(spark, sample, "csv").count() == 1


def test_quotes_and_line_breaks_survive(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes(b'a,b\n"say ""hi"" now",1\n"two\nlines",2\n"x, ""y"", z", 3\n'.replace(b" 3", b"3"))
    got = {r["b"]: r["a"] for r in scan_csv(spark, str(tmp_path)).collect()}
    assert got == {1: 'say "hi" now', 2: "two\nlines", 3: 'x, "y", z'}


def test_encoding_is_decided_by_the_whole_file(spark, tmp_path):
    body = b"name,n\n" + b"plain,1\n" * 20_000 + "Київ,2\n".encode("cp1251")
    (tmp_path / "t.csv").write_bytes(body)
    got = scan_csv(spark, str(tmp_path))
    assert got.count() == 20_001 and got.where("n = 2").first()["name"] == "Київ"


def test_long_header_among_dialects(spark, tmp_path):
    wide = [f"a_rather_long_column_name_{i}" for i in range(4_000)]
    (tmp_path / "a.csv").write_text(";".join(wide) + "\n" + ";".join("1" * 4_000) + "\n")
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    (tmp_path / "c.csv").write_text("only|header\n")
    got = scan_csv(spark, str(tmp_path))
    assert got.count() == 2 and got.where(f"{wide[-1]} = 1").count() == 1


def test_csv_results_keep_every_row(spark, tmp_path):
    rows = [(1, "one\nline, \"break\"", 1), (2, " plain ", 1), (3, None, 1), (4, "", 0)]
    _, sample = write_results(spark.createDataFrame(rows, "id int, t string, is_sample int"), f"{tmp_path}/base", "M", "csv")
    assert sorted(tuple(r) for r in scan_csv(spark, sample, "id int, t string, is_sample int").collect()) == rows[:3]


def test_json_documents(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"a": {"0": 1, "1": 2}, "b": {"0": "x", "1": null}}')
    (tmp_path / "p.json").write_text(json.dumps({"a": 1, "b": "x"}, indent=2))
    assert sorted(tuple(r) for r in load(spark, str(tmp_path / "c.json")).collect()) == [(1, "x"), (2, None)]
    assert tuple(load(spark, str(tmp_path / "p.json")).first()) == (1, "x")


def test_record_files_that_do_not_fit_are_refused(spark, tmp_path, orders):
    table = orders.select("o_orderkey", "o_orderstatus").limit(20)
    dbf_files(table, "o_orderstatus", f"{tmp_path}/d.dbf")
    dbf_files(orders.select("o_custkey", "o_orderstatus").limit(20), "o_orderstatus", f"{tmp_path}/d.dbf/more")
    with pytest.raises(Exception, match="columns differ"):
        load(spark, f"{tmp_path}/d.dbf").collect()
