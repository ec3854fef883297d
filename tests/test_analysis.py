import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlume.operators import insights, kernels, metrics, runlog, search, validate
from graphlume.plans import analysis, runs
from graphlume.sources import files

VECTORS = {"even_grid": [1, 2, 3, 4, 5, 6], "bimodal": [1, 1.2, 1.1, 5, 5.1, 5.2, 5.3], "messy": [1, 1, 3, 5, 5, 6.7, 6.8, 7.4], "tiny": [0, 1, 2], "flat": [2, 2, 2, 2, 2]}


def matrix(spark, n=40, seed=3):
    draw = random.Random(seed)
    return spark.createDataFrame([(i, draw.gauss(5 * (i % 2), 1), draw.random(), draw.gauss(0, 2), i % 3) for i in range(n)], "id long, a double, b double, c double, label int")


def test_feature_metrics(spark):
    long = spark.createDataFrame([(k, float(v)) for k, vs in VECTORS.items() for v in vs], "feature string, value double")
    got = {r["feature"]: r for r in metrics.feature_categories(long).collect()}
    assert {k: r["category"] for k, r in got.items()} == {"even_grid": "comparison", "bimodal": "clustering", "messy": "clustering", "tiny": "unused", "flat": "unused"}
    assert abs(got["bimodal"]["bc"] - 0.990737) < 1e-6 and abs(got["messy"]["cv"] - 0.961414) < 1e-6 and got["flat"]["bc"] == 0 and got["flat"]["cv"] == math.inf and got["tiny"]["bc"] is None


def test_laplacian(spark):
    df = matrix(spark)
    x = np.array([(r["a"], r["b"]) for r in df.orderBy("id").collect()])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    s = np.zeros_like(d)
    for i in range(len(x)):
        s[i, np.argsort(d[i], kind="stable")[:5]] = 1
    s = np.maximum(s, s.T)
    deg = s.sum(1)
    wanted = []
    for f in x.T:
        g = f - (f * deg).sum() / deg.sum()
        wanted.append(((g * deg * g).sum() - g @ s @ g) / (g * deg * g).sum())
    got = {r["feature"]: r["score"] for r in metrics.laplacian_scores(df, "id", ["a", "b"]).collect()}
    assert np.allclose([got["a"], got["b"]], wanted)


def test_dip():
    draw = np.random.default_rng(0)
    assert metrics.dip(np.r_[draw.normal(0, 0.2, 200), draw.normal(9, 0.2, 200)]) > 3 * metrics.dip(draw.normal(0, 1, 400))
    assert metrics.dip(np.full(10, 3.0)) == 1 / 20


def test_knee():
    assert metrics.knee([1, 2]) is None and metrics.knee([3, 3, 3]) is None
    assert metrics.knee([0.1, 0.11, 0.12, 0.13, 5, 9]) == 0.13


def test_pair_identities(spark):
    df = matrix(spark)
    rows = df.collect()
    l1 = sum(abs(p["c"] - q["c"]) for i, p in enumerate(rows) for q in rows[i + 1 :] if p["label"] == q["label"])
    l2 = sum((p[k] - q[k]) ** 2 for k in "ab" for i, p in enumerate(rows) for q in rows[i + 1 :] if p["label"] == q["label"])
    got = kernels.objective_parts(df, ["a", "b"], ["c"]).first()
    assert abs(got["compared_sum"] - l1) < 1e-6 and abs(got["clustered_sum"] - l2) < 1e-6
    assert abs(kernels.objective(df, ["a", "b"], ["c"], 4).first()["objective"] - (l1 / 4 - l2 / 2)) < 1e-6


def test_kernels(spark):
    df = matrix(spark)
    for method in ("kmeans", "fcm", "fcm2"):
        got = kernels.cluster(df, "id", ["a"], ["c"], 2, method).collect()
        assert len(got) == 40 and {r["label"] for r in got} <= {0, 1}
    split = {r["id"] % 2: r["label"] for r in kernels.cluster(df, "id", ["a"], [], 2, "kmeans").collect()}
    assert split[0] != split[1]
    for bad in (lambda: kernels.cluster(df, "id", ["a"], [], 0), lambda: kernels.cluster(df, "id", ["a"], [], 2, "other"), lambda: kernels.kmeans(df.limit(1), "id", ["a"], 2)):
        with pytest.raises(ValueError):
            bad()


def test_medoid_step(spark):
    df = matrix(spark)
    rows = df.orderBy("id").collect()
    medoids = [(i, [rows[i]["a"], rows[i]["b"]], [rows[i]["c"]]) for i in (0, 5, 9)]
    a, c = np.array([(r["a"], r["b"]) for r in rows]), np.array([r["c"] for r in rows])
    s = np.array([1 / (1 + np.exp(-(((a - a[i]) ** 2).mean(1) - abs(c - c[i])))) for i in (0, 5, 9)]) ** (1 / 1.5)
    u = 1 / (s[:, None] / s[None]).sum(1)
    u /= u.sum(0)
    for j, i in enumerate((0, 5, 9)):
        u[:, i] = np.eye(3)[j]
    got = kernels.medoid_step(df, "id", ["a", "b"], ["c"], medoids).orderBy("id").collect()
    assert np.allclose([[r[f"u{j}"] for r in got] for j in range(3)], u)


def test_search(spark):
    problem = search.Problem(matrix(spark, 20), "id", ["a", "b", "c"], 2)
    best, score = search.search(problem, "exp", max_depth=3)
    assert search.feasible(best) and all(score >= v for v in problem.solved.values())
    for method in ("rd", "lp", "sls"):
        found, value = search.search(problem, method, steps=2)
        assert search.feasible(found) and value <= score + 1e-9
    assert search.moves((1, -1)) == [] and search.moves((1, -1, 0)) and all(map(search.feasible, search.moves((1, -1, 0))))
    with pytest.raises(ValueError):
        search.search(problem, "mincut")
    assert search.two_means([1.0, 1.1, 9.0]) == [0, 0, 1]


def test_searches_go_to_their_end(spark, data, monkeypatch):
    tried, wanted = [], (-1, 1, -1)

    def score(problem, solution):
        tried.append(solution)
        return -float(sum(abs(a - b) for a, b in zip(solution, wanted))) if search.feasible(solution) else float("-inf")

    monkeypatch.setattr(search.Problem, "score", score)
    for query in (analysis.search_exhaustive, analysis.search_local, analysis.search_smart_local):
        tried.clear()
        found = query(spark, data).first()
        assert tuple(found["solution"]) == wanted and found["score"] == 0
        if query is analysis.search_exhaustive:
            assert len(set(tried)) == 3**3


def test_top_pairs(spark):
    df = matrix(spark, 60)
    rows, wanted = df.collect(), {}
    for label in (0, 1, 2):
        mine = [r for r in rows if r["label"] == label]
        pairs = sorted((-abs(p["a"] - q["a"]) - abs(p["c"] - q["c"]), min(p["id"], q["id"]), max(p["id"], q["id"])) for i, p in enumerate(mine) for q in mine[i + 1 :])
        wanted[label] = [(a, b) for _, a, b in pairs[:4]]
    got = insights.top_pairs(df, "id", ["a", "c"], 4, block=7).orderBy("label", "rank").collect()
    assert {k: [(r["a"], r["b"]) for r in got if r["label"] == k] for k in wanted} == wanted
    alone = df.limit(1)
    assert insights.top_pairs(alone, "id", ["a"], 2).count() == 0


def test_validate(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, None if i % 2 else 1.0, str(i), "x") for i in range(10)], "id long, a double, b double, c double, d string, e string")
    kept, report = validate.process(df, 0.3, 0.02, 1.0)
    assert kept.columns == ["id", "a", "b", "d"] and {r["column"]: r["reason"] for r in report.collect() if r["action"] == "dropped"} == {"c": "null_ratio", "e": "null_ratio"}
    left, gone = validate.drop_correlated(kept, 0.98)
    assert left.columns == ["id", "a"] and gone.count() == 2
    with pytest.raises(ValueError):
        validate.process(df.select("id"))
    assert validate.process(df.where("false"))[0].columns == ["id"]
    assert validate.percentile_scale(spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k long, v double"), "k", "v").where("scaled = 0.5").count() == 2
    constant = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "p double, q double")
    assert validate.pearson_pairs(constant, ["p", "q"]).first()["r"] is None


def test_rand_index(spark):
    df = spark.createDataFrame([([1, 1, 0, 0], [0, 0, 1, 1]), ([1, 2, 3], [1, 1, 1]), ([1], [5]), ([1, 2], [1]), ([], [])], "x array<int>, y array<int>")
    got = [r[0] for r in df.select(runlog.adjusted_rand(F.col("x"), F.col("y"))).collect()]
    assert got[0] == 1.0 and got[1] == 0.0 and got[2] == 1.0 and got[3] is None and got[4] == 1.0


def test_agreement_in_every_notation(spark, tmp_path):
    draw, writers = random.Random(5), [
        lambda v: "[" + ";".join(v) + "]", ",".join, " | ".join, lambda v: ",".join(f'"{x}"' for x in v), lambda v: "[" + ";".join("+1" if x == "1" else x for x in v) + "]",
        lambda v: ";".join(v).replace("-", "\u2212"), lambda v: "[" + " ".join(v) + "]", lambda v: ",".join(v) + ",", lambda v: "[" + ";".join(v),
    ]
    vectors = [[draw.choice(("-1", "0", "1")) for _ in range(9)] for _ in range(45)]
    texts = [writers[i % len(writers)](v) for i, v in enumerate(vectors)]
    texts[0], vectors[0][4] = ";".join([*vectors[0][:4], "", *vectors[0][5:]]), "unknown"
    rows = [(i, "petals", "ls" if i % 2 else "rd", 3, t) for i, t in enumerate(texts)] + [(98, "petals", "ls", 3, None), (99, "petals", "ls", 3, "")]
    spark.createDataFrame(rows, "log_id long, data string, heuristic string, k int, clusters string").write.parquet(str(tmp_path / "solver_logs.parquet"))

    def index(a, b):
        pairs = [(a[i] == a[j], b[i] == b[j]) for i in range(len(a)) for j in range(i)]
        both, x, y = sum(p and q for p, q in pairs), sum(p for p, _ in pairs), sum(q for _, q in pairs)
        expected = x * y / len(pairs)
        return 1.0 if (x + y) / 2 == expected else (both - expected) / ((x + y) / 2 - expected)

    got = {r["heuristic"]: (r["pairs"], r["mean_ari"]) for r in runs.ari_pairs(spark, str(tmp_path)).collect()}
    wanted = {}
    for h, first in (("rd", 0), ("ls", 1)):
        of = [index(vectors[i], vectors[j]) for i in range(first, 45, 2) for j in range(first, i, 2)]
        wanted[h] = (len(of), pytest.approx(sum(of) / len(of), abs=2e-6))
    assert got == wanted


def test_error_bars(spark):
    row = spark.range(1).select(*runlog.error_bars(F.lit(2.0), F.lit(3.0), False), *runlog.error_bars(F.lit(2.0), F.lit(8.0), True)).first()
    f = math.exp(math.sqrt(math.log(5)))
    assert row[0] == 2.0 and row[1] == 3.0 and abs(row[2] - (2 - 2 / f)) < 1e-12 and abs(row[3] - (2 * f - 2)) < 1e-9


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y,cls\n1,1.5,,p\n2,bad,3,q\n")
    (tmp_path / "b.csv").write_text("id,z\n7,8\n")
    (tmp_path / "r.txt").write_text("attribute,aggregation_function\nBorn , AVG\n")
    (tmp_path / "c.json").write_text(json.dumps({"name": "g", "labels": ["A"], "password": "secret"}))
    got = files.load_indicators(spark, str(tmp_path / "a.csv"), drop_class=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1.5, None), (2, None, 3.0)]
    assert files.load_indicators(spark, str(tmp_path / "a.csv"), drop_class=True, drop_incomplete=True).columns == ["id"]
    assert files.read_csv_directory(spark, str(tmp_path)).where("z is not null").first()["source_file"] == "b.csv"
    assert {tuple(r) for r in files.summarize_csv_directory(spark, str(tmp_path)).collect()} == {("a.csv", 2, 4), ("b.csv", 1, 2)}
    assert files.read_rules(spark, str(tmp_path / "r.txt"))["born"] == "avg"
    assert files.GraphConfig.read(str(tmp_path / "c.json")).labels == ["A"]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/x_lp_2_1.log").write_text("[best solution]: [1;-1] | 3\n")
    assert runlog.parse_logs(files.read_logs(spark, str(tmp_path / "logs"))).first()["clusters"] == [1, -1]
    out = str(tmp_path / "results")
    for _ in range(2):
        files.append_results(spark.range(2), out)
    assert spark.read.parquet(out).count() == 4
    assert "a\\_b & 1.500" in files.to_latex(spark.createDataFrame([("a_b", 1.5)], "k string, v double"))


def test_stream(spark, tmp_path, data):
    from graphlume.streaming.degrees import degrees_by_type, event_stream

    spark.read.parquet(f"{data}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events"))
    running = degrees_by_type(event_stream(spark, str(tmp_path / "events"), 1)).writeStream.outputMode("complete").format("memory").queryName("degrees").trigger(availableNow=True).start()
    running.awaitTermination(120)
    batch = degrees_by_type(spark.read.parquet(f"{data}/events.parquet"))
    assert {tuple(r) for r in spark.table("degrees").collect()} == {tuple(r) for r in batch.collect()}


def cloud(spark, n, seed, d=2, labels=3):
    import random

    draw = random.Random(seed)
    rows = [(i, i % labels, *(round(draw.gauss(5 * (i % labels), 1), draw.choice([0, 3])) for _ in range(d))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"c{j} double" for j in range(d)))


@pytest.mark.parametrize(("d", "block"), [(1, 7), (2, 20), (3, 500)])
def test_nearest_against_all(spark, d, block):
    rows, df = cloud(spark, 150, d, d)
    wanted = set()
    for i, _, *x in rows:
        order = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, _, *y in rows if j != i)
        wanted |= {(i, j) for _, j in order[:4]}
    assert {tuple(r) for r in metrics.nearest(df, "id", [f"c{j}" for j in range(d)], 4, block).collect()} == wanted
    assert metrics.nearest(df.where("false"), "id", ["c0"], 4).count() == 0


@pytest.mark.parametrize("signs", [10, 0])
def test_top_pairs_against_all(spark, monkeypatch, signs):
    monkeypatch.setattr(insights, "MOST_SIGNS", signs)
    rows, df = cloud(spark, 90, 5, 3)
    wanted = set()
    for label in range(3):
        of = [(i, x) for i, g, *x in rows if g == label]
        pairs = sorted((-round(sum(abs(a - b) for a, b in zip(x, y)), 9), i, j) for n, (i, x) in enumerate(of) for j, y in of[n + 1 :])
        wanted |= {(label, r + 1, i, j) for r, (_, i, j) in enumerate(pairs[:6])}
    found = insights.top_pairs(df, "id", ["c0", "c1", "c2"], 6, 20)
    assert {tuple(r)[:4] for r in found.collect()} == wanted
    same = df.withColumn("c0", F.lit(1.0)).withColumn("c1", F.lit(2.0)).withColumn("c2", F.lit(None).cast("double"))
    assert insights.top_pairs(same, "id", ["c0", "c2"], 2).count() == 0
    assert {tuple(r)[:4] for r in insights.top_pairs(same, "id", ["c0", "c1"], 2).where("label = 0").collect()} == {(0, 1, 0, 3), (0, 2, 0, 6)}


def test_silhouette_against_all(spark):
    rows, df = cloud(spark, 120, 9, 2, 4)
    total = 0.0
    for i, g, *x in rows:
        by = {}
        for j, h, *y in rows:
            if i != j:
                by.setdefault(h, []).append(math.dist(x, y))
        a, b = sum(by[g]) / len(by[g]), min(sum(v) / len(v) for h, v in by.items() if h != g)
        total += (b - a) / max(a, b)
    assert kernels.silhouette(df, "id", ["c0", "c1"], block=25).first()[0] == pytest.approx(total / len(rows))


def test_many_k_means_at_once(spark):
    _, df = cloud(spark, 60, 3, 3)
    columns, sets = ["c0", "c1", "c2"], [["c0"], ["c1", "c2"], ["c2", "c0"]]
    together = kernels.kmeans_many(df, "id", columns, sets, 3, seed=1)
    scores = {r["at"]: r["objective"] for r in kernels.objective_many(together, columns, sets, [["c1"], ["c0"], ["c1"]]).collect()}
    for i, (s, q) in enumerate(zip(sets, [["c1"], ["c0"], ["c1"]])):
        one = kernels.kmeans(df, "id", s, 3, seed=1)
        assert {tuple(r) for r in one.collect()} == {tuple(r) for r in together.where(F.col("at") == i).select("id", "label").collect()}
        assert scores[i] == pytest.approx(kernels.objective(df.drop("label").join(one, "id"), s, q, 3).first()[0])


def test_run_tools(spark):
    grid = runlog.experiment_grid(spark, ["petals"], ("rd",), (2, 3), 2)
    done = spark.createDataFrame([("petals", "rd", 2, 0)], "data string, heuristic string, k int, run int")
    assert {c for c, _ in runlog.run_experiments(grid, lambda *c: c, done)} == {("petals", "rd", 2, 1), ("petals", "rd", 3, 0), ("petals", "rd", 3, 1)}
    with pytest.raises(ValueError, match="time_total"):
        runlog.assert_columns(spark.createDataFrame([(1,)], " `Label ` int"), ["label", "time_total"])
    text = "[best solution]: [1;-1] | 1.2e+05\n| 3e-4\n[CPU time] 1e-05 seconds\n"
    r = runlog.parse_logs(spark.createDataFrame([("petals_rd_2_0.log", text)], "file string, text string")).first()
    assert (r["best_score"], r["all_bar_scores"], r["cpu_time"]) == (1.2e5, [1.2e5, 3e-4], 1e-5)
    assert files.dated("results", at=0.0).startswith("results_0") and files.dated("results", at=0.0).endswith(".csv")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from graphlume import session

    class Nothing:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def isEmpty(self):
            return True

        def get(self, *a):
            return None

    other = Nothing()
    other.__dict__.update(sparkContext=other, conf=other, master="spark://host:7077", _jsc=other)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(other)


def test_skipped_files_and_correlated_metrics(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("")
    assert [r["file"] for r in files.skipped_csv_files(spark, str(tmp_path)).collect()] == ["b.csv"]
    table = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 3.0, 6.5)], "feature string, cv_gaps double, bc double")
    assert metrics.metric_correlations(table, ["cv_gaps", "bc"]).first()["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 6.5])[0, 1])


def test_neighbours_meet_as_plain_arrays(spark, monkeypatch):
    kept, written = [], metrics.cut
    monkeypatch.setattr(metrics, "cut", lambda df: (kept.append(df.schema.simpleString()), written(df))[1])
    x = np.repeat(np.random.default_rng(5).integers(0, 9, (30, 2)), 7, axis=0).astype(float)  # ties and copies over several tiles
    x = x[np.random.default_rng(6).permutation(len(x))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    wanted = {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:5]}
    assert {tuple(r) for r in metrics.nearest(df, "id", ["a", "b"], 5, 20).collect()} == wanted
    assert kept and not any("array<struct" in schema for schema in kept)  # Python would make an object of each row
