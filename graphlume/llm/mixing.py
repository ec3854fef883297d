"""A mix of sources with target shares of the total size, by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern;
a small network (size: patterns x sources, not documents) routes each pattern's tokens to
the quotas of its sources. The r-th use of a pattern's tokens costs r - 1, so that a
document is repeated only where nothing fresh is left. Then documents fill the routed
amounts in a seeded order: the uses of a pattern form a tape on which its documents lie
one behind the other, again and again, and each source takes a stretch of the tape. A
stretch is never longer than the source's cap times the pattern, so no document is used
more often than the cap allows; a stretch begins and ends within one document, so a
source misses its quota by less than one document for each pattern.

A document's place on the tape needs running sums in the seeded order; they are taken
over buckets of the seeded hash first and then within each bucket, so that a pattern with
any share of the documents is never one task.

Defined results: a document id that occurs twice counts once; documents of no target
source, or without tokens, are not used; a source without documents gets share 0; without
a given total the mix is as large as the reachable quotas allow.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlume.operators.ordered import salted_join
from graphlume.session import cut

BUCKETS = 1024


@dataclass
class Network:
    """Min-cost flow by successive shortest paths with potentials."""

    arcs: list[list] = field(default_factory=list)  # [to, capacity, cost, reverse arc]
    out: dict[object, list[int]] = field(default_factory=dict)

    def add(self, a: object, b: object, capacity: int, cost: int = 0) -> int:
        at = len(self.arcs)
        self.arcs += [[b, capacity, cost], [a, 0, -cost]]
        self.out.setdefault(a, []).append(at)
        self.out.setdefault(b, []).append(at + 1)
        return at

    def solve(self, source: object, sink: object, most: int | None = None) -> int:
        """Send as much as possible (``most`` at most) at least cost; costs must not be negative at first."""
        sent, potential = 0, dict.fromkeys(self.out, 0)
        while most is None or sent < most:
            distance, via, heap = {source: 0}, {}, [(0, 0, source)]
            done, order = set(), 0
            while heap:
                d, _, a = heapq.heappop(heap)
                if a in done:
                    continue
                done.add(a)
                for i in self.out[a]:
                    b, capacity, cost = self.arcs[i]
                    if capacity > 0 and b not in done:
                        new = d + cost + potential[a] - potential[b]
                        if new < distance.get(b, new + 1):
                            distance[b], via[b] = new, i
                            order += 1
                            heapq.heappush(heap, (new, order, b))
            if sink not in distance:
                return sent
            for a in self.out:
                potential[a] += min(distance.get(a, distance[sink]), distance[sink])
            amount, at = (most - sent if most is not None else None), sink
            while at != source:
                capacity = self.arcs[via[at]][1]
                amount = capacity if amount is None else min(amount, capacity)
                at = self.arcs[via[at] ^ 1][0]
            at = sink
            while at != source:
                self.arcs[via[at]][1] -= amount
                self.arcs[via[at] ^ 1][1] += amount
                at = self.arcs[via[at] ^ 1][0]
            sent += amount
        return sent

    def flow(self, arc: int) -> int:
        return self.arcs[arc ^ 1][1]


def _largest(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> int:
    """The largest total whose quotas can all be filled.

    A total is too large if some set of sources asks for more than its patterns can give, and a maximal flow shows such a
    set (the sources it leaves reachable). The total is lowered to what that set can give until no set is short: each
    round finds another set, and in practice a handful are needed."""
    gives = lambda some: sum(n * min(max(targets[s][1] for s in own), sum(targets[s][1] for s in own if s in some)) for p, n in patterns.items() if (own := [s for s in p if s in targets]))
    short = set(targets)
    total = math.floor(gives(short) / sum(targets[s][0] for s in short))
    while total > 0:
        net = Network()
        quotas = {s: round(q * total) for s, (q, _) in targets.items()}
        for s in sorted(targets):
            net.add(("source", s), "end", quotas[s])
        for p, n in sorted(patterns.items()):
            own = [s for s in p if s in targets]
            if own and n:
                net.add("start", ("pattern", p), n * max(targets[s][1] for s in own))
                for s in own:
                    net.add(("pattern", p), ("source", s), n * targets[s][1])
        if net.solve("start", "end") == sum(quotas.values()):
            return total
        reached, waiting = {"end"}, ["end"]
        while waiting:  # the sources that still could give to the end
            b = waiting.pop()
            for i in net.out.get(b, ()):
                a = net.arcs[i][0]
                if net.arcs[i ^ 1][1] > 0 and a not in reached:
                    reached.add(a)
                    waiting.append(a)
        short = {s for s in targets if ("source", s) in reached}
        most = math.floor(gives(short) / sum(targets[s][0] for s in short)) if short else total - 1
        total = min(total - 1, most)
    return 0


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """The mix's total and the tokens each pattern gives each of its sources.

    ``patterns``: tokens by sorted tuple of sources; ``targets``: share and cap by source.
    """
    reachable = {s for p, n in patterns.items() if n for s in p if s in targets and targets[s][0] > 0 and targets[s][1] > 0}

    def network(size: int) -> tuple[Network, dict, int]:
        net, routes, wanted = Network(), {}, 0
        for s in sorted(reachable):
            quota = round(targets[s][0] * size)
            net.add(("source", s), "end", quota)
            wanted += quota
        for p, n in sorted(patterns.items()):
            own = [s for s in p if s in reachable]
            for r in range(max((targets[s][1] for s in own), default=0)):
                net.add("start", ("pattern", p), n, r)
            for s in own:
                routes[p, s] = net.add(("pattern", p), ("source", s), n * targets[s][1])
        return net, routes, wanted

    if not reachable:
        return 0, {}
    if total is None:
        total = _largest(patterns, {s: targets[s] for s in reachable})
    net, routes, _ = network(total)
    net.solve("start", "end")
    return total, {k: net.flow(arc) for k, arc in routes.items() if net.flow(arc)}


def plain_name(name):
    """Source names in one notation."""
    return F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")


def mix(docs: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, source, repeats, n_tokens``: how often each chosen document is used for each source.

    ``docs`` has ``doc_id``, ``sources ARRAY<STRING>`` and ``n_tokens``; ``targets`` has ``source``,
    ``target_share`` and ``max_repeats`` (a small table; the greatest row counts for a source named twice).
    """
    spark = docs.sparkSession
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source is not null").select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats").collect()}
    names = F.array(*(F.lit(s) for s in sorted(wanted))) if wanted else F.array().cast("array<string>")
    used = docs.select("doc_id", F.array_sort(F.array_intersect("sources", names)).alias("pattern"), F.col("n_tokens").cast("long").alias("n_tokens")).where("size(pattern) > 0 and n_tokens > 0").dropDuplicates(["doc_id"])
    used = cut(used)  # read three times: sizes are counted once
    # of S target sources there are at most 2^S - 1 patterns, however many documents there are
    patterns = {tuple(r["pattern"]): r["n"] for r in used.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).toLocalIterator()}
    _, flows = route(patterns, wanted, total)
    stretches, ends = [], dict.fromkeys(patterns, 0)
    for (p, s), amount in sorted(flows.items()):
        stretches.append((list(p), s, ends[p], ends[p] + amount, patterns[p]))
        ends[p] += amount
    stretch = spark.createDataFrame(stretches, "pattern array<string>, source string, a long, b long, whole long")
    placed = used.withColumn("hash", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("hash", 32), F.lit(buckets)))
    sums = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("pattern", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("hash", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # buckets keep a pattern of any size apart; the planner broadcasts the sums where they are small
    at = placed.join(sums, ["pattern", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    # the document begins at ``at``, at + whole, at + 2 whole, …: count its beginnings within [a, b)
    chosen = salted_join(at, stretch, ["pattern"], "doc_id")
    lower = F.greatest(F.lit(0), F.ceil((F.col("a") - F.col("at")) / F.col("whole")))
    upper = F.greatest(F.lit(0), F.ceil((F.col("b") - F.col("at")) / F.col("whole")))
    return chosen.withColumn("repeats", (upper - lower).cast("int")).where("repeats > 0").select("doc_id", "source", "repeats", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, n_docs, most_repeats, n_tokens, share``: what each source really contributes."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"))
    every = targets.select("source", "target_share").join(got, "source", "left")
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    return every.select("source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce(share, F.lit(0.0)).alias("share"))
