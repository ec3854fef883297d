import math
import statistics

from pyspark.sql import functions as F

from graphlume.operators import quality
from graphlume.operators.ordered import medians


def names(spark, *values):
    return spark.createDataFrame([("d", v) for v in values], "field string, value string")


def report(spark, rows):
    return spark.createDataFrame(rows, "row_id long, load_id long, stream_no long, load_no int, a double, b double, d string, field string")


def found(spark, rows, *listed):
    out = quality.findings(report(spark, rows), "row_id", "load_id", "stream_no", "load_no", ["a", "b"], ["d"], names(spark, *listed))
    return {tuple(r) for r in out.select("load_id", "row_id", "field", "finding").collect()}


def test_rows(spark):
    rows = [(1, 1, 1, 1, -0.1, float("inf"), "x ", "?"), (2, 1, 1, 1, 1.0, float("nan"), None, "?"), (3, 1, 1, 1, 0.0, None, "", "?"), (3, 1, 1, 1, 0.0, None, "", "?"), (4, 1, 1, 1, 0.5, float("-inf"), "x", "?")]
    assert found(spark, rows, "x", "y") == {(1, 1, "a", "range"), (1, 1, "b", "range"), (1, 4, "b", "range"), (1, 1, "d", "pattern"), (1, 3, "d", "pattern")}


def test_a_frequent_bad_value_is_still_bad(spark):
    rows = [(i, 1, 1, 1, 0.5, 0.5, "Float64" if i < 900 else "float64", "") for i in range(1000)]
    assert len(found(spark, rows, "float64")) == 900


def test_loads(spark):
    before = [(i, 1, 7, 1, 0.2, 0.5, "x" if i % 2 else "y", "") for i in range(20)]
    after = [(100 + i, 2, 7, 2, 0.4 if i < 15 else float("nan"), 0.5 if i < 14 else None, "x" if i < 19 else "bad", "") for i in range(20)]
    other = [(200 + i, 3, 8, 2, 0.9, 0.9, None, "") for i in range(4)]
    got = found(spark, before + after + other, "x", "y")
    assert got == {(2, 0, "a", "shift"), (2, 0, "b", "missing"), (2, 0, "d", "shift"), (2, 119, "d", "pattern")}


def test_empty(spark):
    assert found(spark, [], "x") == set()
    assert found(spark, [(1, 1, 1, 1, None, None, None, None)]) == set()


def test_induced_forms(spark):
    values = [(("ids"), f"AB-{i:05d}", 1) for i in range(500)] + [("ids", "?", 1), ("ids", "a much longer remark!", 1)] + [("colour", c, 400) for c in ("red", "green")]
    df = spark.createDataFrame(values, "field string, value string, n long")
    got = {r["value"]: r["expression"] for r in quality.induce(df, ["field"]).collect()}
    assert got["AB-00001"] == "[A-Z]{2}-[0-9]{5}" == got["AB-00499"]
    assert got["red"] == "red" and got["green"] == "green"


def test_rare_values_without_form_are_exceptions(spark):
    values = [("ids", f"AB-{i:05d}", 1) for i in range(500)] + [("ids", "?", 1), ("ids", "a much longer remark!", 1)] + [("free", f"{'xyz'[i % 3]}{'- ' * (i % 7)}{i * 7919 % 1000}!" * (1 + i % 5), 1) for i in range(300)]
    df = spark.createDataFrame(values, "field string, value string, n long")
    got = {(r["field"], r["value"]): r for r in quality.induce(df, ["field"]).collect()}
    assert {v for (f, v), r in got.items() if f == "ids" and not r["conforms"]} == {"?", "a much longer remark!"}
    assert got["ids", "?"]["expression"] == quality.EXCEPTION


def test_code_lengths_decide_candidates_and_the_list_confirms(spark, monkeypatch):
    values = [("d", f"float{b}", 40) for b in (16, 32, 64)] + [("d", "float99", 40), ("d", "Float64", 3)]
    df = spark.createDataFrame(values, "field string, value string, n long")
    listed = names(spark, "float16", "float32", "float64")

    def candidates():
        return {r["value"] for r in quality.induce(df, ["field"], listed).collect() if not r["conforms"]}

    assert candidates() == {"float99", "Float64"}
    rows = [(i, 1 + i % 2, 1, 1 + i % 2, 0.5, 0.5, ["float16", "float32", "float64", "float99", "Float64"][i % 5] if i % 2 else "float16", "") for i in range(100)]
    before = found(spark, rows, "float16", "float32", "float64")
    assert len(before) == 21 and (2, 0, "d", "shift") in before
    for name in ("LETTER_BITS", "DIGIT_BITS"):  # with letters and digits for nothing, one form covers listed and other names
        monkeypatch.setattr(quality, name, 0.0)
    assert candidates() == {"float16", "float32", "float64", "float99", "Float64"}
    assert found(spark, rows, "float16", "float32", "float64") == before


def test_profile_changes(spark):
    rows = [(1, 1, 1, f"A{i}", float(i)) for i in range(8)] + [(2, 1, 2, f"A{i}" if i < 4 else "zzz-zzz", None if i < 2 else 10.0) for i in range(8)] + [(3, 2, 1, None, None)]
    df = spark.createDataFrame(rows, "load_id long, s long, n int, t string, v double")
    got = {(r["load_id"], r["field"]): r for r in quality.column_profile(df, "load_id", ["t", "v"], stream="s", number="n").collect()}
    assert got[2, "v"]["missing_change"] == 0.25 and got[2, "v"]["mean_change"] == 6.5 and got[1, "v"]["missing_change"] is None
    assert got[2, "t"]["coverage_change"] == 0.5 and got[3, "t"]["n_missing"] == 1 and got[3, "t"]["n_expressions"] == 0


def test_medians(spark):
    rows = [(g, (i * 37 % 101) / 100) for g in range(3) for i in range(g * 50)] + [(3, 2.0), (4, float("nan")), (5, None), (6, 0.3)] + [(7, 0.5)] * 9
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r["g"]: r["median"] for r in medians(df, ["g"], "v", bins=16).collect()}
    wanted = {}
    for g in range(8):
        inside = [v for k, v in rows if k == g and v is not None and not math.isnan(v) and 0 <= v <= 1]
        if inside:
            wanted[g] = statistics.median(inside)
    assert got.keys() == wanted.keys() and all(abs(got[g] - wanted[g]) < 1e-12 for g in got)


def test_profile(spark, data):
    from graphlume.plans.preparation import p4_profile

    raw = spark.read.parquet(f"{data}/validation_report.parquet").dropDuplicates(["row_id"])
    wanted = {(r["load_id"]): tuple(r)[1:] for r in raw.groupBy("load_id").agg(F.count("*"), F.count_if(F.col("dtype_before").isNull()), F.count_distinct("dtype_before")).collect()}
    got = {r["load_id"]: (r["n_rows"], r["n_missing"], r["n_distinct"]) for r in p4_profile(spark, data).where("field = 'dtype_before'").collect()}
    assert got == wanted
