import ast
import json
import re

import pytest

from graphlume.operators.packed import canonical, split_packed

SIDES = ("clustering", "comparison", "unused")
FILL = [(f"[{a};{b};{c}]") for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]


def split(spark, texts, sections=(), integers=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "row_key long, text string, val string")  # ``val`` clashes with the result's name
    out = {}
    for r in split_packed(df, "row_key", "text", sections, integers=integers and not sections).collect():
        out.setdefault(r["row_key"], []).append((r["side"], r["pos"], r["val"]))
    return [sorted(out.get(i, [])) for i in range(len(texts))]


CASES = [
    ("[1;0;-1]", ["1", "0", "-1"]), ("1,0,-1,", ["1", "0", "-1"]), ("1;0;-1 ,", ["1", "0", "-1"]), ("\"[1,0,-1]\"", ["1", "0", "-1"]), ("'1'; '0'; '-1'", ["1", "0", "-1"]),
    ("[ 1  0\n -1]", ["1", "0", "-1"]), ("+1 | 0 | −1", ["1", "0", "-1"]), ("(1, 0, -1}", ["1", "0", "-1"]), ("1;;-1", ["1", "", "-1"]), ("1 ;0,-1/1|0\t1", ["1", "0", "-1", "1", "0", "1"]), ("1;\"0\";-1", ["1", "0", "-1"]), ("1", ["1"]),
]


def test_notations(spark):
    texts = [c for c, _ in CASES] + FILL * 4
    found = split(spark, texts)
    for (text, wanted), got in zip(CASES, found):
        assert [v for _, _, v in got] == wanted, text
        assert [p for _, p, _ in got] == list(range(1, len(wanted) + 1))


def test_other_delimiters_and_names_left_alone(spark):
    assert split(spark, ["1:0:-1", "1&0&-1", "1~0~-1", *FILL])[:3] == [[("", 1, "1"), ("", 2, "0"), ("", 3, "-1")]] * 3
    texts = ["a|007|+1|1.0", "007|b|1.0"] * 20
    assert [v for _, _, v in split(spark, texts, integers=False)[0]] == ["a", "007", "+1", "1.0"]


def test_nothing_in_nothing_out(spark):
    assert split(spark, [None, "", "  \n", "[1;0]"])[:3] == [[], [], []]
    empty = spark.createDataFrame([], "row_key long, text string")
    assert split_packed(empty, "row_key", "text").count() == 0


def test_sections(spark):
    names = ["A_x", "B_share, urban %", "C_roads; paved", "D_beds|1000", "E_mayor's budget", 'F_rent "net"', "G_runways #"]
    sides = {"clustering": names[:3], "comparison": names[3:6], "unused": names[6:]}
    csv = lambda n: '"' + n.replace('"', '""') + '"'
    bare = lambda n: n if not re.search("[,;|\"']", n) else csv(n)
    texts = [
        json.dumps(sides), repr(sides), "; ".join(f"{s}: " + ", ".join(map(bare, v)) for s, v in sides.items()), ";".join(f"{s.capitalize()}=" + "|".join(map(csv, v)) for s, v in sides.items()),
        "\n".join(f"{s}," + ",".join(map(csv, v)) for s, v in sides.items()), "\n".join(f"{s}:\n" + "\n".join("- " + bare(n) for n in v) for s, v in sides.items()),
        "\n".join(f"{s}=[" + " | ".join(map(csv, v)) + "]" for s, v in sides.items()),
    ]
    wanted = sorted((s, i + 1, n) for s, v in sides.items() for i, n in enumerate(v))
    for text, got in zip(texts, split(spark, texts * 6, SIDES)):
        assert got == wanted, text


def test_empty_sides_and_entries(spark):
    text = "{'clustering': [], 'comparison': ['a', 'b'], 'unused': ['c']}"
    got = split(spark, [text, "clustering=;comparison=a||b|;unused=c"] * 5, SIDES)
    assert got[0] == [("comparison", 1, "a"), ("comparison", 2, "b"), ("unused", 1, "c")]
    assert got[1] == [("comparison", 1, "a"), ("comparison", 2, ""), ("comparison", 3, "b"), ("unused", 1, "c")]
    assert ast.literal_eval(text)["comparison"] == ["a", "b"]


def test_repeated_rows_and_long_text(spark):
    long = ";".join(["1", "0", "-1"] * 20_000)
    df = spark.createDataFrame([(1, long)] * 3 + [(2, "1;0")], "k long, t string")
    found = split_packed(df, "k", "t").groupBy("row_key").count().collect()
    assert {r["row_key"]: r["count"] for r in found} == {1: 60_000, 2: 2}


@pytest.mark.parametrize(("raw", "plain"), [("+1", "1"), ("−1", "-1"), (" 0 ", "0"), ("1.0", "1"), ("1.5", "1.5"), ("-", "-"), ("a b", "a b")])
def test_canonical(raw, plain):
    assert canonical(raw) == plain


def test_counts_agree_with_the_tables(spark, data):
    from graphlume.plans.preparation import p2_found

    runs = spark.read.parquet(f"{data}/run_results.parquet").where("partition is not null and partition != ''").select("result_id", "indicators#").distinct()
    got = {r["row_key"]: r["count"] for r in p2_found(spark, data).where("src = 'run_results'").groupBy("row_key").count().collect()}
    assert {r["result_id"]: r["indicators#"] for r in runs.collect()} == got
