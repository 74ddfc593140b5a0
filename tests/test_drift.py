"""Schema drift on small made files."""

import json

from seqloom.operators import drift
from tests.conftest import rows

SCHEMA = "file_id long, dataset string, series_id int, file_no int, line_no int, record_key long, payload string, path string, kind string"


def lines(spark, files):
    out = []
    for (series, no), recs in files.items():
        for i, (key, payload) in enumerate(recs):
            out.append((series * 100 + no, "d", series, no, i, key, payload if payload is None or isinstance(payload, str) else json.dumps(payload), "x", "y"))
    return spark.createDataFrame(out, SCHEMA)


def found(df):
    return set(rows(drift.changes(df).select("file_id", "change_kind", "old_field", "new_field")))


def test_changes(spark):
    recs = lambda f: [(k, f(k)) for k in range(10)]
    df = lines(spark, {
        (1, 1): recs(lambda k: {"name": f"n{k}", "count": k, "gone": k + 100}),
        (1, 2): recs(lambda k: {"name": f"n{k}", "Count": str(k) if k else "other", "new": True}),
        (1, 3): recs(lambda k: {"new": True, "name": None, "Count": str(k) if k else "other"}) + [(3, {"name": None, "Count": "3", "new": True})],
        (1, 5): recs(lambda k: {"new": k, "name": f"n{k}", "Count": 1.0}),
        (2, 1): [(1, {"a": 1})],
    })
    assert found(df) == {
        (102, "renamed", "count", "Count"), (102, "type_changed", "count", "Count"), (102, "removed", "gone", ""), (102, "added", "", "new"),
        (105, "type_changed", "Count", "Count"), (105, "type_changed", "new", "new"),
    }


def test_rename_needs_four_fifths(spark):
    def two(same):
        return {(1, 1): [(k, {"a": k}) for k in range(10)], (1, 2): [(k, {"b": k if k < same else -1}) for k in range(10)]}

    assert (102, "renamed", "a", "b") not in found(lines(spark, two(7)))
    assert (102, "renamed", "a", "b") in found(lines(spark, two(8)))


def test_rename_counts_records_in_both_files(spark):
    one = {(1, 1): [(k, {"a": k}) for k in range(4)], (1, 2): [(k, {"b": k}) for k in range(2, 40)]}
    assert (102, "renamed", "a", "b") in found(lines(spark, one))
    # A null on one side counts against, a null on both does not.
    two = {(1, 1): [(k, {"a": k if k < 4 else None}) for k in range(9)], (1, 2): [(k, {"b": k if k < 5 else None}) for k in range(9)]}
    assert (102, "renamed", "a", "b") in found(lines(spark, two))


def test_types_and_broken_payloads(spark):
    df = lines(spark, {(1, 1): [(1, '{"x": 3.0, "y": 3, "z": "3", "b": false, "o": {"p": 1}, "n": null}'), (2, "not json"), (3, None), (4, "[1]"), (5, ""), (6, '{"y": 1, "y": 2}'), (7, '{"x": 2}')]})
    got = {r["path"]: (r["type"], r["n_lines"]) for r in drift.file_types(drift.path_values(df, keep=drift.FILE)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"x": "decimal", "y": "integer", "z": "text", "b": "boolean", "o": "text", "n": None}
    deep = {r["path"] for r in drift.path_values(df, keep=["file_id"], depth=2).collect()}
    assert "o.p" in deep and "o" not in deep


def test_consistent_table(spark):
    df = lines(spark, {
        (1, 1): [(k, {"name": f"n{k}", "count": k}) for k in range(5)],
        (1, 2): [(k, {"name": f"n{k}", "Count": k}) for k in range(5)],
        (1, 3): [(k, {"name": f"n{k}", "cnt": k if k else "none", "extra": 1}) for k in range(5)],
    })
    out = drift.consistent(df, "d", {"name": "string", "count": "int"}, drift.changes(df)).where("file_id = 103").orderBy("line_no").collect()
    assert [r["count"] for r in out] == [None, 1, 2, 3, 4] and [r["name"] for r in out] == [f"n{k}" for k in range(5)]
    assert json.loads(out[0]["failed_casts"]) == [{"key": "count", "value": "none"}] and json.loads(out[1]["extras"]) == [{"key": "extra", "value": "1"}]


def test_repeated_lines_and_fields(spark):
    one = lines(spark, {
        (1, 1): [(k, {"name": f"n{k}", "count": k}) for k in range(5)],
        (1, 2): [(k, f'{{"name": "n{k}", "Count": {k}, "name": "other", "count": 9, "extra": 1, "extra": 2}}') for k in range(5)],
    })
    nulls = spark.createDataFrame([(None, "d", 1, 2, 0, 1, '{"z": 1}', "x", "y"), (102, None, None, None, 0, None, None, None, None), (None,) * 9], SCHEMA)
    df = one.unionByName(one).unionByName(nulls)
    assert found(df) == found(one) and drift.changes(df).count() == drift.changes(one).count()
    out = drift.consistent(df, "d", {"name": "string", "count": "int"}, drift.changes(df)).where("file_id = 102").orderBy("line_no").collect()
    assert len(out) == 5 and [r["name"] for r in out] == [f"n{k}" for k in range(5)] and {r["count"] for r in out} == {9}
    beside = [{"key": "Count", "value": "3"}, {"key": "extra", "value": "1"}, {"key": "extra", "value": "2"}, {"key": "name", "value": "other"}]
    assert json.loads(out[3]["extras"]) == beside


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == set()
    assert drift.consistent(df, "d", {"a": "int"}, drift.changes(df)).count() == 0
