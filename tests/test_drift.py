import csv
from datetime import datetime, timedelta

import pytest

from graphlume.operators import drift

FIELDS = tuple(drift.RUN_FIELDS)


@pytest.mark.parametrize(("header", "field"), [
    ("time_total", "time_total"), ("total_time", "time_total"), ("TIME_TOTAL", "time_total"), ("timeTotal", "time_total"), ("t_total", "time_total"), ("time_tot", "time_total"), ("time total", "time_total"), ("time_total_s", "time_total"),
    ("push down", "pushdown"), ("push-down", "pushdown"), ("is_pushdown", "pushdown"), ("pushdown_on", "pushdown"), ("PUSHDOWN", "pushdown"), ("time_Indic", "time_Indicators"), ("#nodes", "nodes#"), ("nodes_#", "nodes#"),
    ("avg_label_prop", "avgLabelProp"), ("dropped_prop_ratio", "ratio_prop_dropped"), ("time_Partition", "time_Partition"), ("cold_start", "cold_start"), ("heap_mb", "heap_mb"), ("seed_value", "seed_value"), ("comment_text", "comment_text"),
    ("dbms_version", "dbms_version"), ("null_threshold", "null_threshold"), ("label", "label"), ("N", "N"), ("n", "N"), ("time", "time"),
])
def test_fields(header, field):
    assert drift.field_of(header, FIELDS) == field


def test_fields_of_one_file():
    assert drift.fields_of(["", "Unnamed: 0", "run", "total_time", "time_total"], FIELDS) == [None, None, "run", "total_time", "time_total"]


def files(spark, *contents, series=1):
    rows = []
    for i, (n, lines) in enumerate(contents):
        for j, line in enumerate(lines):
            rows.append((n, series, f"f{n}.csv", datetime(2023, 1, 1) + timedelta(days=i), datetime(2023, 2, 1), j, line, "x"))
    rows += rows[:2]  # repeated lines
    return spark.createDataFrame(rows, "file_no long, series_no long, file_name string, written_at timestamp, loaded_at timestamp, line_no int, line string, change string")


def test_changes(spark):
    lines = files(
        spark,
        (9, ["run,pushdown,time_total", "0,True,1.5", "1,False,"]),
        (3, ["﻿run;push_down;time_total;x\r", '0;"on";2\r', "1;off;3\r"]),
        (5, [",run\tpushdown".replace(",", ""), "0\ttrue", None]),
        (7, ["pushdown,run", '"true",']),
    )
    found = {(r["file_no"], r["field"], r["change"]) for r in drift.changes(lines).collect()}
    assert found == {(3, "pushdown", "renamed"), (3, "pushdown", "retyped"), (3, "time_total", "retyped"), (3, "x", "added"), (5, "pushdown", "renamed"), (5, "pushdown", "retyped"), (5, "time_total", "removed"), (5, "x", "removed")}


def test_table_and_failures(spark):
    lines = files(spark, (1, ["run,pushdown,time_total,label,extra", '0,yes,"1,234.5",a,7', "1,maybe,2.5 s,,", "2,False,abc"]))
    rows = {r["line_no"]: r for r in drift.consistent_table(lines).collect()}
    assert (rows[1]["pushdown"], rows[1]["time_total"], rows[1]["label"], rows[1]["others"]) == (True, 1234.5, "a", {"extra": "7"})
    assert rows[2]["pushdown"] is None and rows[2]["failed"] == ["pushdown"] and rows[2]["time_total"] == 2.5 and rows[2]["label"] is None
    assert rows[3]["failed"] == ["time_total"]
    assert {(r["field"], r["n"], r["example"]) for r in drift.failed_casts(lines).collect()} == {("pushdown", 1, "maybe"), ("time_total", 1, "abc")}


def test_no_value_changes_silently(spark):
    """Column by column: what a text becomes, null where it fails."""
    cases = [
        ("run", ["3.7", "12 apples", "5e", "7.0", "1e3", "2147483648", "+5"], [None, None, None, 7, 1000, None, 5]), ("N", ["9007199254740993", "10265 nodes", "3 apples", "9007199254740993.0"], [9007199254740993, 10265, None, 9007199254740993]),
        ("time_total", ["12 ms", "12 apples", "5e", "1.5e1", "2 min", "3s"], [0.012, None, None, 15.0, 120.0, 3.0]), ("time_total_ms", ["1500", "2 s"], [1.5, 2.0]),
        ("time_Indicators", ["0,943", "27,950"], [0.943, 27.95]), ("time_Validation", ["1,234,567", "27,950"], [1234567.0, 27950.0]), ("time_Preprocessing", ["27,950", "1"], [None, 1.0]),
    ]
    lines = files(spark, *((i + 1, [f"{name};label", *(f"{v};x" for v in values)]) for i, (name, values, _) in enumerate(cases)))
    got = {(r["file_no"], r["line_no"]): r for r in drift.consistent_table(lines).collect()}
    bad = {r["file_no"]: r["n"] for r in drift.failed_casts(lines).collect()}
    for i, (name, _, wanted) in enumerate(cases):
        field = drift.field_of(name, FIELDS)
        assert [got[i + 1, j + 1][field] for j in range(len(wanted))] == pytest.approx(wanted), name
        assert bad.get(i + 1, 0) == wanted.count(None)


def test_other_schema(spark):
    schema = drift.Schema({"weight": "double", "id": "bigint"}, {"weight": {"kg": 1.0, "g": 1e-3}}, frozenset({"kg", "g", "net"}))
    lines = files(spark, (1, ["id,net weight g,run", "1,250,4"]), (2, ["ID,weight", "2,1.5 kg,5"]))
    rows = {r["file_no"]: (r["id"], r["weight"], r["others"]) for r in drift.consistent_table(lines, schema).collect()}
    assert rows == {1: (1, 0.25, {"run": "4"}), 2: (2, 1.5, {})}
    assert {(r["field"], r["change"]) for r in drift.changes(lines, schema).collect()} == {("id", "renamed"), ("weight", "renamed"), ("weight", "retyped"), ("run", "removed")}


def test_a_large_file_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(drift, "CHUNK", 10)
    lines = files(spark, (1, ["run", *map(str, range(95)), "7"]))
    assert [r["run"] for r in drift.consistent_table(lines).orderBy("line_no").collect()] == [*range(95), 7]


def test_empty_and_no_header(spark):
    assert drift.changes(files(spark, (1, ["run"])).where("false")).count() == 0
    lines = files(spark, (1, ["run", "1"]), (2, ["x", "1"])).where("file_no = 1 or line_no > 0")
    assert {tuple(r) for r in drift.changes(lines).collect()} == {(2, "run", "removed")}


def brute(rows):
    """The same rules in plain Python, with the standard library's CSV reader."""
    import re

    by = {}
    for r in rows:
        by.setdefault((r["series_no"], r["written_at"], r["file_no"]), {})[r["line_no"]] = r["line"] or ""
    out, before = set(), {}
    for (series, _, file_no), lines in sorted(by.items()):
        head = lines[0].lstrip("﻿").rstrip("\r\n")
        d = max(",;\t|", key=re.sub('"[^"]*"', "", head).count)
        clean = lambda x: [v.strip(" ﻿\t") for v in next(csv.reader([x.rstrip("\r\n")], delimiter=d), [])]  # noqa: B023, E731
        headers = clean(head)
        fields = drift.fields_of(headers, FIELDS)
        state = {}
        body = [clean(t) for n, t in lines.items() if n]
        for i, f in enumerate(fields):
            if f is None:
                continue
            values = [b[i] for b in body if i < len(b) and b[i]]
            kind = None
            if values:
                tests = [("boolean", r"(?i:true|false)"), ("integer", r"[+-]?\d+"), ("decimal", r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")]
                kind = next((k for k, p in tests if all(re.fullmatch(p, v) for v in values)), "text")
            state[f] = (headers[i], kind)
        if series in before:
            old = before[series]
            out |= {(file_no, f, "added") for f in state.keys() - old.keys()} | {(file_no, f, "removed") for f in old.keys() - state.keys()}
            for f in state.keys() & old.keys():
                out |= {(file_no, f, "renamed")} if state[f][0] != old[f][0] else set()
                out |= {(file_no, f, "retyped")} if state[f][1] and old[f][1] and state[f][1] != old[f][1] else set()
        before[series] = state
    return out


def test_against_brute_force(spark, data):
    for at in (data, data.replace("sf0.001", "sf0.01")):
        lines = spark.read.parquet(f"{at}/report_files.parquet")
        assert {tuple(r) for r in drift.changes(lines).collect()} == brute(lines.collect())


def test_previous_in_one_large_series(spark):
    from pyspark.sql import functions as F

    from graphlume.operators.ordered import with_previous

    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("long").alias("s"), (F.col("id") * 7919 % 5000).alias("t"), "id")
    found = {r["id"]: r["previous"] for r in with_previous(df, ["s"], ["t", "id"], "id", "previous").collect()}
    wanted, last = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r["s"], r["t"], r["id"])):
        wanted[r["id"]] = last.get(r["s"])
        last[r["s"]] = r["id"]
    assert found == wanted
