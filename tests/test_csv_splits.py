"""CSV files in many small blocks, against the standard library's reader over the whole file."""

import csv
import io
import random

import pytest

from ledgersift.errors import SourceError
from ledgersift.sources import scan_csv, sniff_csv_dialects
from ledgersift.sources.csv_splits import DELIMITERS, ENCODINGS, Summary, column_names, csv_structure, walk
from ledgersift.sources.files import list_files


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257b")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_dialect(data):
    encoding = next(e for e in ENCODINGS if not fails(data, e))
    header_only = None
    for sep in DELIMITERS:
        reader = csv.reader(io.StringIO(data.decode(encoding), newline=""), delimiter=sep)
        width, rows, spans, before, fits = 0, False, False, 0, True
        for record in reader:
            spans |= reader.line_num - before > 1
            before = reader.line_num
            if record and not width:
                width = len(record)
            elif record:
                rows, fits = True, fits and len(record) <= width
        if fits and width > 1:
            if rows:
                return encoding, sep, width, True, spans
            header_only = header_only or (encoding, sep, width, False, spans)
    return header_only or (None, None, 0, True, False)


def fails(data, encoding):
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return True
    return False


def random_file(rng):
    """Fields with delimiters, quotes and line breaks; sometimes a stray quote within a plain field, or a wide record."""
    sep, end = rng.choice(DELIMITERS), rng.choice(["\n", "\r\n"])
    letters = rng.choice(["abc", "äöü", "їжґ"])

    def field():
        kind = rng.random()
        word = "".join(rng.choice(letters) for _ in range(rng.randint(0, 6)))
        if kind < 0.25:
            inner = word + rng.choice(["", ",", ";", "|", '""', end, end + end, "\t"]) + word
            return f'"{inner}"'
        if kind < 0.3:
            return word + 'x"y'
        return word

    width = rng.randint(2, 4)
    rows = [[field() for _ in range(rng.randint(1, width) if rng.random() < 0.1 else width)] for _ in range(rng.randint(0, 40))]
    rows.insert(0, [f"h{i}" for i in range(width)])
    if rng.random() < 0.1:
        rows.append([field() for _ in range(width + 1)])
    text = end.join(sep.join(r) for r in rows) + rng.choice(["", end, end + end])
    encoding = "utf-8" if letters != "їжґ" else rng.choice(["utf-8", "cp1251"])
    return text.encode(encoding)


def test_dialects_of_many_blocks_are_those_of_whole_files(small_blocks, tmp_path):
    rng = random.Random(11)
    wanted = {}
    for i in range(40):
        data = random_file(rng)
        (tmp_path / f"f {i}%.csv").write_bytes(data)
        wanted[f"f {i}%.csv"] = plain_dialect(data)
    found = sniff_csv_dialects(list_files(small_blocks, str(tmp_path))).collect()
    got = {r["path"].rsplit("/", 1)[1]: tuple(r)[1:] for r in found}
    assert {n for n in wanted if got[n] != wanted[n]} == set()
    assert sum(w[4] for w in wanted.values()) > 5


def test_records_over_many_blocks(small_blocks, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["plain", 'say "so"', "two\nlines", "a\r\nb", "x" * 400 + "\n" + "y;" * 150, "", "Київ\n"]), i / 4) for i in range(300)]
    text = io.StringIO(newline="")
    out = csv.writer(text, delimiter=";", lineterminator="\r\n")
    out.writerow(["n", "long\nname", "v"])
    out.writerows(rows)
    (tmp_path / "t.csv").write_bytes(text.getvalue().encode("cp1251"))
    structure = csv_structure(small_blocks, [str(tmp_path / "t.csv")]).first()
    assert structure["multi_line"] and len(structure["inside"]) > 20
    got = scan_csv(small_blocks, str(tmp_path))
    assert got.columns == ["n", "long\nname", "v"] and [t for _, t in got.dtypes] == ["int", "string", "double"]
    assert sorted(tuple(r) for r in got.collect()) == [(n, t or None, v) for n, t, v in rows]
    assert got.rdd.getNumPartitions() > 20
    typed = scan_csv(small_blocks, str(tmp_path), "n bigint, `a text` string, v decimal(10,2)")
    assert typed.count() == 300 and typed.columns == ["n", "a text", "v"]


def test_types_of_records_that_span_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        'i,l,d,day,at,b,t,e,i\n1,3000000000,1.5,2024-02-29,2024-02-29 12:30:00,true,"x\ny",,1\n,1,2,2024-01-01,2024-02-29 12:30:01,false,z,,2\n'
    )
    got = scan_csv(spark, str(tmp_path))
    assert [t for _, t in got.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string", "int"]
    assert got.columns == ["i0", "l", "d", "day", "at", "b", "t", "e", "i8"]


def test_an_open_quote_runs_to_the_end(small_blocks, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,2\n" + '3,"open\n' + "4,5\n" * 50)
    assert plain_dialect((tmp_path / "t.csv").read_bytes()) == tuple(sniff_csv_dialects(list_files(small_blocks, str(tmp_path))).first())[1:]
    got = sorted(tuple(r) for r in scan_csv(small_blocks, str(tmp_path)).collect())
    assert len(got) == 2 and got[1][0] == 3 and got[1][1].startswith("open\n4,5\n4,5")


def test_files_without_lines(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(SourceError):
        scan_csv(spark, str(tmp_path))
    assert sniff_csv_dialects(list_files(spark, str(tmp_path)).where("false")).count() == 0


@pytest.mark.parametrize(
    ("line", "inside", "wanted"),
    [
        ("a,b", False, (2, False)), ("", False, (1, False)), ('"a,b",c', False, (2, False)), ('a,"b', False, (2, True)), ('"a""', False, (1, True)),
        ('"a"b,c', False, (2, False)), ('a"b,"c"', False, (2, False)), ('b",c', True, (1, False)), ("b,c", True, (0, True)), ('b""c', True, (0, True)),
        ('b"x"y,"z', True, (1, True)), ('","', False, (1, False)), (',"', False, (2, True)),
    ],
)
def test_walk(line, inside, wanted):
    assert walk(line, ",", inside) == wanted


def test_summaries_of_parts_add_up_to_the_whole():
    one = Summary(",", True, True)
    for line in ("x", 'y",2', "1,2,3", '4,"5'):
        one.line(line)
    start, open_, lead, done, records, first, widest, tail, spans = one.row()
    assert (lead, done, records, first, widest, tail, open_, spans) == (1, True, 1, 3, 3, 2, True, True)


def test_column_names():
    assert column_names(["a", None, "b", "A", ""]) == ["a0", "_c1", "b", "A3", "_c4"]
