from graphlume import cli
from graphlume.operators import runlog


def test_indicators_and_partition(spark, data, tmp_path, capsys):
    a = cli.parser().parse_args(["indicators", data, "nation", str(tmp_path / "out"), "--pushdown", "-c", "0.999", "-n", "0.9", "--keep-nulls"])
    cli.indicators(spark, a)
    assert spark.read.csv(str(tmp_path / "out/report"), header=True).count() > 0
    assert spark.read.parquet(str(tmp_path / "out/results")).first()["indicators#"] >= 2
    record = spark.read.parquet(str(tmp_path / "out/results"))
    assert record.columns[:9] == ["run", "pushdown", "database", "N", "E", "label", "indicators#", "nodes#", "avgLabelProp"] and record.first()["N"] > 1000 and record.first()["time_total"] > 0
    table = tmp_path / "t.csv"
    table.write_text("id,a,b,c\n" + "\n".join(f"{i},{i % 2},{i},{i * i % 7}" for i in range(12)))
    cli.partition(spark, cli.parser().parse_args(["partition", str(table), "-k", "2", "-m", "rd", "--kernel", "kmeans"]))
    printed = capsys.readouterr().out
    runs = runlog.parse_logs(spark.createDataFrame([("t_rd_2_0.log", printed)], "file string, text string")).first()
    assert (runs["D"], runs["n"]) == (12, 3) and runs["cpu_time"] is not None and runs["wall_time"] > 0 and len(runs["clusters"]) == 3 and "[Silhouette]" in printed
    cli.validated(spark, cli.parser().parse_args(["validate", "--input", str(table), "--output", str(tmp_path / "o"), "--report", str(tmp_path / "r"), "--distinct-high", "1"]))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3
    table.write_text("id,a,word\n" + "\n".join(f"{i},{i},{'xyz'[i % 3]}" for i in range(12)))
    cli.validated(spark, cli.parser().parse_args(["validate", "--input", str(table), "--output", str(tmp_path / "o2"), "--report", str(tmp_path / "r2"), "--distinct-high", "1", "--allow-non-numeric"]))
    assert {r["word"] for r in spark.read.csv(str(tmp_path / "o2"), header=True).collect()} == {"2.5", "6.5", "10.5"}
