"""JSON files of every form, decided file by file."""

import json
import time

from ledgersift.sources import load


def test_forms_are_decided_per_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n{"a": 1, "b": "x"}\n{"a": 2, "b": null}\n')
    (tmp_path / "b c.json").write_text(json.dumps([{"a": 3, "b": "y"}], indent=1))
    (tmp_path / "c.json").write_text(json.dumps({"a": {"0": 4, "7": 5}, "b": {"0": "z", "7": None}}))
    (tmp_path / "d.json").write_text(json.dumps({"a": {"0": 6}, "b": {"0": "w"}}, indent=2))
    (tmp_path / "e.json").write_text(json.dumps({"a": 7, "b": "v"}, indent=2))
    got = load(spark, str(tmp_path), "json")
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, "x"), (2, None), (3, "y"), (4, "z"), (5, None), (6, "w"), (7, "v")]
    assert dict(got.dtypes) == {"a": "bigint", "b": "string"}


def test_types_of_columns(spark, tmp_path):
    doc = {
        "n": {"0": 1, "1": 3_000_000_000}, "x": {"0": 1.5, "1": 2}, "flag": {"0": True, "1": None}, "t": {"0": "01", "1": 'say "so"'},
        "mixed": {"0": 1, "1": "one"}, "none": {"0": None, "1": None}, "gap": {"1": 5},
    }
    (tmp_path / "t.json").write_text(json.dumps(doc))
    got = load(spark, str(tmp_path / "t.json"))
    assert dict(got.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "t": "string", "mixed": "string", "none": "string", "gap": "bigint"}
    first = got.where("n = 1").first().asDict()
    assert first == {"n": 1, "x": 1.5, "flag": True, "t": "01", "mixed": "1", "none": None, "gap": None}
    assert got.where("n > 1").first()["t"] == 'say "so"' and got.where("n > 1").first()["gap"] == 5


def test_many_row_labels(spark, tmp_path):
    n = 100_000
    (tmp_path / "big.json").write_text(json.dumps({"k": {str(i): i for i in range(n)}, "v": {str(i): f"w{i}" for i in range(n)}}))
    at = time.time()
    got = load(spark, str(tmp_path / "big.json"))
    assert got.count() == n and got.where("v = concat('w', k)").count() == n
    assert time.time() - at < 60


def test_objects_in_rows_are_no_columns(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}\n{"a": {"x": 3}, "b": {"x": 4}}\n')
    assert load(spark, str(tmp_path / "l.json")).count() == 2
