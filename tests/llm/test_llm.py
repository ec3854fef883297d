import base64
import math
import quopri
import random
import re
from collections import Counter, defaultdict
from email import message_from_bytes, policy

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlume.llm import clusters, digests, leakage, mail, mixing, splitting, tokens

ENC = tokens.encoding()
LENGTHS = np.array([len(ENC.decode_single_token_bytes(i)) for i in range(ENC.max_token_value + 1)])


# percentiles


def values(spark, n=6000, seed=1):
    draw = random.Random(seed)
    rows = [(["hot", "a", "b", None][min(3, i % 7)] if i % 3 else "hot", i % 5, draw.choice([draw.gauss(0, 1), draw.expovariate(0.01), 7.0])) for i in range(n)]
    rows += [("a", 0, float("nan")), ("a", 0, float("inf")), ("a", 0, None), ("none", 0, None)]
    return spark.createDataFrame(rows, "g string, day int, x double")


def test_percentiles_have_the_stated_error(spark):
    df = values(spark)
    found = digests.certified(digests.estimates(digests.digest(df, ["g", "day"], "x")), df, ["g", "day"], "x").collect()
    exact = defaultdict(list)
    for r in df.collect():
        if r["x"] is not None and np.isfinite(r["x"]):
            exact[r["g"], r["day"]].append(r["x"])
    assert len(found) == len(exact) * len(digests.PERCENTILES)
    import json

    for r in found:
        key = json.loads(r["grp"])
        xs = np.sort(exact[key["g"], key["day"]])
        assert r["n"] == len(xs)
        below, upto, rank = (xs < r["value"]).sum(), (xs <= r["value"]).sum(), r["percentile"] * len(xs)
        assert abs(r["rank_error"] - max(0, below - rank, rank - upto) / len(xs)) < 1e-12 and r["rank_error"] <= r["bound"] + 1e-12


def test_digests_of_days_combine(spark):
    df = values(spark)
    days = digests.digest(df, ["g", "day"], "x", 100)
    whole = digests.regrouped(days, "g string, day int", {"g": F.col("g")}, 100)
    found = digests.certified(digests.estimates(whole), df, ["g"], "x").collect()
    assert len(found) == 4 * len(digests.PERCENTILES) and max(r["rank_error"] for r in found) < 0.03


def test_cluster_sizes_are_bounded():
    x = np.random.default_rng(0).normal(size=50_000)
    codes, means, weights = digests.cluster(np.zeros(len(x), dtype=np.int64), x, np.ones(len(x)), 100)
    assert len(means) <= 101 and weights.sum() == len(x) and (np.diff(means) >= 0).all() and weights[0] < 50 < weights.max()


def test_percentiles_of_nothing(spark):
    empty = values(spark).where("false")
    assert digests.certified(digests.estimates(digests.digest(empty, ["g"], "x")), empty, ["g"], "x").count() == 0


# clusters


def truth(rows):
    """Linked components of alike pairs, by comparing all."""
    items = {i: (set(e), x) for i, e, x in rows if e and x is not None and np.isfinite(x)}
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(items)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            (a, x), (b, y) = items[i], items[j]
            if len(a & b) >= 0.6 * len(a | b) - 1e-9 and abs(x - y) <= 0.1 * max(abs(x), abs(y)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("seed", "local"), [(1, 8000), (2, 25)])
def test_clusters(spark, seed, local):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for t in range(12):
        base, x = draw.sample(words, draw.choice([1, 2, 5, 12, 45])), draw.choice([0.0, 1.0, 5.0, -3.0])
        for _ in range(draw.choice([1, 1, 4, 25])):
            entries = [w if draw.random() > 0.12 else draw.choice(words) for w in base]
            rows.append((len(rows), entries, x * draw.uniform(0.93, 1.07)))
            x *= draw.uniform(0.98, 1.03)  # chains, so that a cluster is more than its centre's neighbours
    rows += [(1000, None, 1.0), (1001, [], 1.0), (1002, ["w1"], None), (1003, ["w1"], float("nan")), (1004, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(*rows[3], "again")], "record_id long, entries array<string>, number double, leaf string")
    found = clusters.similarity_clusters(df, local=local)
    assert {r["record_id"]: r["first_id"] for r in found.collect()} == truth(rows)
    assert clusters.described(found).agg(F.sum("size")).first()[0] == len(truth(rows))


@pytest.mark.parametrize("local", [8000, 20])
def test_typical_records_are_nearest_the_centre(spark, local):
    draw, rows = random.Random(4), []
    for t in range(3):
        base, x = [f"t{t}w{j}" for j in range(9)], 1.0 + t
        for _ in range(40):  # chains of drifting numbers: several leaves, some of one point
            rows.append((len(rows), [w for w in base if draw.random() > 0.1] + [f"own{len(rows)}"] * (draw.random() < 0.2), x))
            x *= draw.uniform(0.99, 1.07)
    df = spark.createDataFrame(rows, "record_id long, entries array<string>, number double")
    found = clusters.described(clusters.similarity_clusters(df, local=local)).collect()
    members = {}
    for i, first in truth(rows).items():
        members.setdefault(first, []).append(i)
    assert any(r["leaves"] > 2 for r in found)
    for r in found:
        of = members[r["first_id"]]
        vectors = [{e: 1 / math.sqrt(len(rows[i][1])) for e in rows[i][1]} | {"": clusters.NUMBER_WEIGHT * math.log1p(1000 * rows[i][2])} for i in of]
        names = {e for v in vectors for e in v}
        centre = {e: sum(v.get(e, 0) for v in vectors) / len(of) for e in names}
        away = [round(math.sqrt(sum((v.get(e, 0) - centre[e]) ** 2 for e in names)), 6) for v in vectors]
        assert r["typical"] == [i for _, i in sorted(zip(away, of))[:3]]


def test_one_cluster_of_very_many(spark):
    rows = [(i, [f"e{j}" for j in range(10)] + [f"own{i}"], 2.0) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, entries array<string>, number double")
    assert clusters.similarity_clusters(df, local=50).select("first_id").distinct().count() == 1
    assert clusters.similarity_clusters(df.where("false")).count() == 0


# leakage


def wrap(text, how, rng):
    if how == "plain":
        return f"From: a@b.test\nContent-Type: text/plain; charset=utf-8\n\n{text}\n"
    if how == "quoted":
        return "From: a@b.test\n\n" + "\n".join("> > " + line for line in re.findall(r".{1,50}(?:\s|$)", text))
    if how == "qp":
        body = quopri.encodestring(text.encode("latin-1", "replace")).decode("ascii")
        return f"From: a@b.test\r\nContent-Type: text/plain; charset=iso-8859-1\r\nContent-Transfer-Encoding: Quoted-Printable\r\n\r\n{body}\r\n"
    if how == "html":
        body = "".join(w + rng.choice([" ", "<br>\n", " <b>", "</b> "]) for w in text.split())
        return f'Content-Type: multipart/alternative;\n boundary="x y"\n\n--x y\nContent-Type: text/html\n\n<style>p {{}}</style><p>{body}</p>\n'
    data = base64.encodebytes(text.encode()).decode()
    return f'MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=zz\n\npreamble\n--zz\n\nbody\n--zz\nContent-Type: text/plain; charset=utf-8; name="n.txt"\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment\n\n{data}\n--zz--\nepilogue'


def test_leaks(spark):
    rng = random.Random(4)
    words = [f"wörd{i}" if i % 9 == 0 else f"word{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([60, 25, 24, 12, 40, 5, 3, 1])]
    items += [(8, "... !"), (9, None)]
    docs, wanted = [], set()
    for n in range(200):
        i, text = items[rng.randrange(5)]
        ws = text.split()
        size = min(25, len(ws)) - rng.choice([0, 0, 1])
        start = rng.randrange(len(ws) - size + 1)
        passage = " ".join(w.upper() if rng.random() < 0.3 else w for w in ws[start : start + size])
        how = ["plain", "quoted", "qp", "html", "base64"][n % 5]
        docs.append((n, wrap("Some words here, " + passage + ". The end", how, rng)))
        if size == min(25, len(ws)):
            wanted.add((n, i))
    docs += [(900, None), (901, ""), (902, "word1 " * 50_000), (903, docs[0][1])]
    docs += [(904, "From: x\nSubject: " + items[0][1] + "\n\nnothing")]
    wanted |= {(903, i) for n, i in wanted if n == 0}
    for i in (5, 6, 7):
        for n, text in docs:
            for part in mail.parts(text or ""):
                own, have = mail.words(items[i][1]), mail.words(part)
                if any(have[k : k + len(own)] == own for k in range(len(have) - len(own) + 1)):
                    wanted.add((n, i))
    d = spark.createDataFrame([(a, b, "x") for a, b in docs] * 2, "doc_id long, text string, item_id string")
    t = spark.createDataFrame(items + items[:2], "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(d, t).collect()} == wanted
    assert {tuple(r) for r in leakage.leaked(d, t, block_words=50).collect()} == wanted
    assert leakage.leaked(d, t.where("false")).count() == 0 and leakage.leaked(d.where("false"), t).count() == 0


def test_leaks_against_brute_force(spark, data):
    """All windows of all items against all documents, with the standard library's mail parser."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/eval_items.parquet")
    windows = defaultdict(set)
    for r in items.collect():
        ws = mail.words(r["text"])
        n = min(25, len(ws))
        for k in range(len(ws) - n + 1):
            windows[n, tuple(ws[k : k + n])].add(r["item_id"])
    sizes = {n for n, _ in windows}
    wanted = set()
    for r in docs.collect():
        message = message_from_bytes(r["text"].encode(), policy=policy.compat32)
        for part in message.walk():
            if part.get_content_maintype() != "text":
                continue
            body = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")
            ws = mail.words(re.sub(r"<[^>]*>", "", body.replace("<br>", "\n")) if part.get_content_subtype() == "html" else body)
            for n in sizes:
                for k in range(len(ws) - n + 1):
                    wanted |= {(r["doc_id"], i) for i in windows.get((n, tuple(ws[k : k + n])), ())}
    assert {tuple(r) for r in leakage.leaked(docs, items).collect()} == wanted and wanted


# mixing


def test_flow_prefers_fresh_tokens():
    total, flows = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 50}, {"a": (0.5, 1), "b": (0.5, 3)})
    assert sum(n for (_, s), n in flows.items() if s == "b") == pytest.approx(total / 2, abs=1)
    assert flows[("a",), "a"] == 100 and sum(n for (p, _), n in flows.items() if p == ("a", "b")) <= 300
    assert mixing.route({}, {"a": (1.0, 1)}) == (0, {}) and mixing.route({("a",): 5}, {"a": (0.0, 1)}) == (0, {})


def test_mix(spark):
    draw = random.Random(5)
    docs = [(i, draw.choice([["a"], ["a"], ["b"], ["a", "b"], ["c"], ["z"], [], ["b", "c", "z"]]), draw.randrange(0, 60)) for i in range(3000)]
    targets = {"a": (0.3, 1), "b": (0.4, 3), "c": (0.2, 4), "ghost": (0.1, 2)}
    d = spark.createDataFrame([(*r, "x") for r in docs + docs[:5]], "doc_id long, sources array<string>, n_tokens long, source string")
    t = spark.createDataFrame([(s, x, m) for s, (x, m) in targets.items()], "source string, target_share double, max_repeats int")
    found = mixing.mix(d, t, buckets=16).collect()
    assert found == mixing.mix(d, t, buckets=16).collect() or sorted(found) == sorted(mixing.mix(d.repartition(3), t, buckets=16).collect())
    by, tokens_of = {i: (s, n) for i, s, n in docs}, Counter()
    uses = Counter()
    for r in found:
        assert r["source"] in by[r["doc_id"]][0] and 1 <= r["repeats"] <= targets[r["source"]][1]
        tokens_of[r["source"]] += r["repeats"] * r["n_tokens"]
        uses[r["doc_id"]] += r["repeats"]
    assert all(n <= max(targets[s][1] for s in by[i][0] if s in targets) for i, n in uses.items())
    total = sum(tokens_of.values())
    for s in "abc":
        assert abs(tokens_of[s] / total - targets[s][0] / 0.9) < 0.01
    shares = {r["source"]: r["share"] for r in mixing.shares(mixing.mix(d, t), t).collect()}
    assert shares["ghost"] == 0 and abs(sum(shares.values()) - 1) < 1e-9
    assert mixing.mix(d.where("false"), t).count() == 0 and mixing.mix(d, t.where("false")).count() == 0


# splitting


TEXTS = {
    "mail": "From: a@b.test\nSubject: x\n\n" + "\n\n".join(" ".join(f"Sentence {i} of paragraph {p} has some words." for i in range(20)) for p in range(60)),
    "one word": "x" * 60_000, "no blanks": "añ語🙂" * 6000, "blank": " " * 30_000, "lines": "word\n" * 9000, "base64": "\n".join(base64.b64encode(random.Random(1).randbytes(57)).decode() for _ in range(300)),
}


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_pieces(name):
    text = TEXTS[name]
    data, ids = text.encode(), ENC.encode_ordinary(text)
    pieces = splitting.split_text(text, ENC, LENGTHS, 500, 50)
    assert (not pieces) == (len(ids) <= 500)
    if not pieces:
        return
    assert pieces[0].start == 0 and pieces[-1].end == len(data)
    for a, b in zip(pieces, pieces[1:]):
        assert a.start < b.start <= a.end < b.end and 50 <= b.repeated <= 53
    whole = b"".join([data[pieces[0].start : pieces[0].end], *(data[a.end : b.end] for a, b in zip(pieces, pieces[1:]))])
    assert whole == data
    for p in pieces:
        assert len(ENC.encode_ordinary(data[p.start : p.end].decode())) == p.n_tokens <= 500
    if name == "mail":
        assert Counter(p.boundary for p in pieces)["paragraph"] >= len(pieces) - 2


def test_cut_is_the_cheapest():
    """Dynamic programming against all choices of cuts on short inputs."""
    from itertools import combinations

    rng = random.Random(6)
    for _ in range(40):
        n, limit, overlap = rng.randrange(12, 18), rng.randrange(6, 9), rng.randrange(0, 3)
        grades = np.array([rng.randrange(0, 8) for _ in range(n + 1)])
        allowed = np.ones(n + 1, dtype=bool)
        got = splitting._cut(n, grades, allowed, limit, overlap, 0)
        pieces = max(1, -(-(n - overlap) // max(1, limit - overlap)))
        even = (n + (pieces - 1) * overlap) / pieces

        def cost(spans):
            return sum(splitting.IMBALANCE * ((b - a - even) / limit) ** 2 for a, b in spans) + sum(splitting._COSTS[grades[b]] for _, b in spans[:-1])

        options = []
        for k in range(6):
            for cuts in combinations(range(1, n), k):
                at = [0, *cuts, n]
                spans = [(max(0, a - overlap), b) for a, b in zip(at, at[1:])]
                if all(b - a <= limit for a, b in spans):
                    options.append(cost(spans))
        assert got is not None and abs(cost(got) - min(options)) < 1e-9


def test_split_items(spark):
    rows = [(1, TEXTS["mail"], "p"), (2, "short", "p"), (3, None, "p"), (4, "", "p"), (5, TEXTS["one word"], "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    found = splitting.split_items(df, "doc_id", "text")
    assert {r["doc_id"] for r in found.collect()} == {1, 5}
    assert found.where("n_tokens > 2000 or (piece > 1 and repeated < 100)").count() == 0
    assert splitting.split_items(df.where("false"), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_items(df, "doc_id", "text", 100, 100)


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "id long, text string")
    assert {r["id"]: r["n_tokens"] for r in tokens.count_tokens(df, "text").collect()} == {1: 2, 2: 0, 3: 0}


def test_found_over_the_limit(spark, data):
    from graphlume.llm.queries import p8_found

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert {r["doc_id"] for r in p8_found(spark, data).collect()} == {r["doc_id"] for r in docs if r["text"] and len(ENC.encode_ordinary(r["text"])) > 2000}


# what lies beyond the former bounds


def test_parts_nested_deeper_than_any_cap():
    text = "needle in the innermost part"
    for i in range(300):
        text = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{text}\n--b{i}--\n"
    assert [p.strip() for p in mail.parts(text)] == ["needle in the innermost part"]


def test_leaves_do_not_depend_on_where_nodes_are_split(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, draw.sample(words, 8), draw.choice([1.0, 1.02, 3.0])) for i in range(150)] + [(200 + i, words[:10] + [f"own{i}"], 7.0) for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, entries array<string>, number double")
    found = [{tuple(r) for r in clusters.similarity_clusters(df, local=n).collect()} for n in (8000, 30)]
    assert found[0] == found[1]
    assert {r[0]: r[1] for r in found[0]} == truth(rows)


def test_heavy_keys_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(clusters, "HEAVY", 2)
    monkeypatch.setattr(clusters, "BLOCK", 7)
    draw = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, draw.sample(words, 6), draw.choice([1.0, 1.05, 2.0])) for i in range(120)]
    df = spark.createDataFrame(rows, "record_id long, entries array<string>, number double")
    assert {r["record_id"]: r["first_id"] for r in clusters.similarity_clusters(df, away=False).collect()} == truth(rows)


def test_small_sets_and_wide_tolerances(spark):
    rows = [(1, ["x"], 1.0), (2, ["x", "y"], 1.0), (3, ["q"], 5.0), (4, ["q"], 500.0), (5, ["q"], -5.0)]
    df = spark.createDataFrame(rows, "record_id long, entries array<string>, number double")
    first = lambda **k: {r["record_id"]: r["first_id"] for r in clusters.similarity_clusters(df, away=False, **k).collect()}
    assert first(similarity=0.5) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    assert first(tolerance=1.0) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5}
    assert first(tolerance=2.0) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}
    assert first(tolerance=0.0) == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    with pytest.raises(ValueError):
        first(similarity=0.0)


def test_a_long_chain_and_a_hub_are_one_component(spark):
    edges = [(i, i + 1) for i in range(0, 150)] + [(1000, 1001 + i) for i in range(100)]
    found = {r["leaf"]: r["root"] for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(found.values()) == {0, 1000} and found[150] == 0 and found[1100] == 1000


def test_items_in_several_blocks(spark):
    draw = random.Random(5)
    words = [f"word{i}" for i in range(4000)]
    items = [(i, " ".join(draw.choices(words, k=40))) for i in range(12)]
    docs = [(i, "Subject: x\n\n" + " ".join(draw.choices(words, k=30)) + " " + items[i % 12][1][20:] + " " + " ".join(draw.choices(words, k=9))) for i in range(24)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in leakage.leaked(a, b, block_words=100).collect()}
    assert found == {tuple(r) for r in leakage.leaked(a, b).collect()} == {(i, i % 12) for i in range(24)}


def test_pieces_stay_within_any_limit_that_allows_it():
    encoding = tokens.encoding()
    lengths = np.array([len(encoding.decode_single_token_bytes(i)) for i in range(encoding.max_token_value + 1)])
    draw = random.Random(1)
    for n in range(40):
        text = "".join(draw.choices("ab \n.é漢🙂x", k=draw.randint(20, 400)))
        limit = draw.randint(14, 40)
        overlap = draw.randint(0, limit - 10)
        for gap in (0, splitting.GAP):
            pieces = splitting.split_text(text, encoding, lengths, limit, overlap, gap)
            assert all(p.n_tokens <= limit for p in pieces)
            assert not pieces or (pieces[0].start == 0 and pieces[-1].end == len(text.encode()) and all(q.start <= p.end < q.end for p, q in zip(pieces, pieces[1:])))
    assert splitting.split_text("漢" * 50, encoding, lengths, 1, 0)  # no piece can keep within: it says so and ends


def test_largest_mix_of_many_patterns():
    draw = random.Random(2)
    names = [f"s{i}" for i in range(9)]
    patterns = {}
    for _ in range(300):
        patterns[tuple(sorted(draw.sample(names, draw.randint(1, 5))))] = draw.randint(1, 1000)
    targets = {s: (draw.choice([0.05, 0.1, 0.2]), draw.randint(1, 3)) for s in names}
    total, flows = mixing.route(patterns, targets)
    got = {s: sum(n for (_, t), n in flows.items() if t == s) for s in names}
    assert got == {s: round(targets[s][0] * total) for s in names}
    bigger = {s: round(targets[s][0] * (total + max(50, total // 1000))) for s in names}
    _, more = mixing.route(patterns, targets, total + max(50, total // 1000))
    assert any(sum(n for (_, t), n in more.items() if t == s) < bigger[s] for s in names)


def test_joins_of_clusters_are_never_broadcast(spark, monkeypatch):
    plans, written = [], clusters.cut
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(clusters, "cut", lambda df: (note(df), written(df))[1])
    draw = random.Random(6)
    words = [f"w{i}" for i in range(14)]
    rows = [(i, draw.sample(words, 6), draw.choice([1.0, 1.05, 2.0])) for i in range(120)]
    found = clusters.similarity_clusters(spark.createDataFrame(rows, "record_id long, entries array<string>, number double"), local=40)
    note(found)
    note(clusters.described(found))
    assert {r["record_id"]: r["first_id"] for r in found.collect()} == truth(rows)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
