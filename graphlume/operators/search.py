"""Search for the partition of indicators into clustering (-1), unused (0) and comparison (1).

The search state is a tuple on the driver; candidates of one step are clustered and scored
together (k-means) or one after the other (other kernels) by distributed jobs over the written
matrix. Scores are kept by solution, so none is solved twice.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from graphlume.operators import kernels, metrics
from graphlume.session import cut

Solution = tuple[int, ...]
#: Solutions that are scored in the same jobs.
TOGETHER = 100


def feasible(solution: Solution) -> bool:
    """At least one comparison and one clustering indicator."""
    return 1 in solution and -1 in solution


def mask(solution: Solution, columns: list[str], side: int) -> list[str]:
    return [c for c, s in zip(columns, solution) if s == side]


@dataclass(frozen=True)
class Node:
    """A state of the search tree: a partial solution whose first ``depth`` indicators are decided."""

    solution: Solution
    depth: int = 0
    parent: Solution | None = None

    @staticmethod
    def root(n: int) -> Node:
        if n < 2:
            raise ValueError("at least two indicators are needed")
        return Node((0,) * n)

    def branch(self) -> list[Node]:
        """The next indicator as clustering, unused or comparison."""
        if self.leaf:
            return []
        return [Node((*self.solution[: self.depth], s, *self.solution[self.depth + 1 :]), self.depth + 1, self.solution) for s in (-1, 0, 1)]

    def swap(self, i: int) -> Node:
        return Node((*self.solution[:i], -self.solution[i], *self.solution[i + 1 :]), self.depth, self.solution)

    def put(self, i: int, side: int) -> Node:
        return Node((*self.solution[:i], side, *self.solution[i + 1 :]), self.depth, self.solution)

    @property
    def leaf(self) -> bool:
        return self.depth == len(self.solution)


@dataclass
class Problem:
    df: DataFrame
    key: str
    columns: list[str]
    k: int
    method: str = "kmeans"
    seed: int = 0
    solved: dict[Solution, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.df = cut(self.df.select(self.key, *(f"`{c}`" for c in self.columns)))

    def labels(self, solution: Solution) -> DataFrame:
        return kernels.cluster(self.df, self.key, mask(solution, self.columns, -1), mask(solution, self.columns, 1), self.k, self.method, self.seed)

    def score(self, solution: Solution) -> float:
        if not feasible(solution):
            return float("-inf")
        if solution not in self.solved:
            labelled = self.df.join(self.labels(solution), self.key)
            found = kernels.objective(labelled, mask(solution, self.columns, -1), mask(solution, self.columns, 1), len(self.columns)).first()
            self.solved[solution] = float(found["objective"])
        return self.solved[solution]

    def solve(self, solutions: list[Solution]) -> None:
        """Score several solutions in the same jobs."""
        new = [s for s in dict.fromkeys(solutions) if feasible(s) and s not in self.solved]
        if self.method != "kmeans":
            new = []  # scored one after the other when they are asked for
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            sets, compared = [mask(s, self.columns, -1) for s in part], [mask(s, self.columns, 1) for s in part]
            labelled = kernels.kmeans_many(self.df, self.key, self.columns, sets, self.k, seed=self.seed)
            for r in kernels.objective_many(labelled, self.columns, sets, compared).collect():  # one row per solution
                self.solved[part[r["at"]]] = float(r["objective"])

    def both(self, solution: Solution) -> tuple[float, float]:
        """The two objectives: comparison and clustering sums."""
        labelled = self.df.join(self.labels(solution), self.key)
        r = kernels.objective_parts(labelled, mask(solution, self.columns, -1), mask(solution, self.columns, 1)).first()
        return float(r["compared_sum"]), float(r["clustered_sum"])


def exhaustive(problem: Problem, max_depth: int = 9) -> tuple[Solution, float]:
    """All solutions whose first ``max_depth`` indicators vary, deeper nodes first; ties to the first found.

    Solutions are scored together, ``TOGETHER`` at a time, in the order in which they are found."""
    heap, count, seen = [(0, 0, Node.root(len(problem.columns)))], 0, set()
    waiting: list[Solution] = []
    best: tuple[Solution, float] = ((0,) * len(problem.columns), float("-inf"))
    while heap or waiting:
        if heap:
            _, _, node = heapq.heappop(heap)
            if node.solution not in seen:
                seen.add(node.solution)
                waiting.append(node.solution)
            if node.depth < max_depth:
                for child in node.branch():
                    count += 1
                    heapq.heappush(heap, (-child.depth, count, child))
        if len(waiting) >= TOGETHER or not heap:
            problem.solve(waiting)
            for solution in waiting:
                value = problem.score(solution)
                if value > best[1]:
                    best = (solution, value)
            waiting = []
    return best


def bi_objective(problem: Problem, max_depth: int = 3) -> list[tuple[Solution, float, float]]:
    """(solution, comparison sum, clustering sum) of every feasible state of the tree."""
    stack, out, seen = [Node.root(len(problem.columns))], [], set()
    while stack:
        node = stack.pop()
        if feasible(node.solution) and node.solution not in seen:
            seen.add(node.solution)
            out.append((node.solution, *problem.both(node.solution)))
        if node.depth < max_depth:
            stack += node.branch()
    return sorted(out)


def random_start(n: int, seed: int) -> Solution:
    draw = random.Random(seed)
    while True:
        found = tuple(draw.choice((-1, 0, 1)) for _ in range(n))
        if feasible(found):
            return found


def two_means(scores: list[float]) -> list[int]:
    """0 for the lower and 1 for the upper of two groups of numbers with the least squared distance to their means."""
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    ordered = [scores[i] for i in order]

    def spread(part: list[float]) -> float:
        mean = sum(part) / len(part)
        return sum((x - mean) ** 2 for x in part)

    at = min(range(1, len(ordered)), key=lambda i: spread(ordered[:i]) + spread(ordered[i:]))
    groups = [0] * len(scores)
    for i in order[at:]:
        groups[i] = 1
    return groups


def smart_start(problem: Problem, neighbours: int = 5) -> Solution:
    """Laplacian scores in two groups: the lower is clustering, the upper comparison, none unused."""
    found = {r["feature"]: r["score"] for r in metrics.laplacian_scores(problem.df, problem.key, problem.columns, neighbours).collect()}
    groups = two_means([found.get(c) or 0.0 for c in problem.columns])
    return tuple(1 if g else -1 for g in groups)


def moves(solution: Solution) -> list[Solution]:
    """All swaps of a decided indicator, both sides for an unused one, and all discards; infeasible ones left out."""
    node, out = Node(solution), []
    for i, s in enumerate(solution):
        out += [node.swap(i), node.put(i, 0)] if s else [node.put(i, -1), node.put(i, 1)]
    return [n.solution for n in out if feasible(n.solution)]


def local_search(problem: Problem, start: Solution, steps: int = 200) -> tuple[Solution, float]:
    """The best neighbour again and again, equal ones included, until it is worse or the steps are used up."""
    best = (start, problem.score(start))
    seen = {start}
    for _ in range(steps):
        options = [s for s in moves(best[0]) if s not in seen]
        if not options:
            break
        problem.solve(options)
        found = max(options, key=problem.score)
        if problem.score(found) < best[1]:
            break
        seen.add(found)
        best = (found, problem.score(found))
    return best


def search(problem: Problem, method: str, steps: int = 200, starts: int = 5, max_depth: int = 9) -> tuple[Solution, float]:
    """``rd``, ``lp``, ``ls`` (best of several random starts), ``sls`` (from the smart start) or ``exp``."""
    n = len(problem.columns)
    methods: dict[str, Callable[[], tuple[Solution, float]]] = {
        "rd": lambda: (s := random_start(n, problem.seed), problem.score(s)),
        "lp": lambda: (s := smart_start(problem), problem.score(s)),
        "ls": lambda: max((local_search(problem, random_start(n, problem.seed + i), steps) for i in range(starts)), key=lambda x: x[1]),
        "sls": lambda: local_search(problem, smart_start(problem), steps),
        "exp": lambda: exhaustive(problem, max_depth),
    }
    if method not in methods:
        raise ValueError(f"no search method {method}; the external min-cut backend is not available")
    return methods[method]()


def co_membership(labelled: DataFrame, key: str) -> DataFrame:
    """``label, members, pairs``: how many pairs each cluster has, without listing them."""
    from pyspark.sql import functions as F

    return labelled.groupBy("label").agg(F.count(key).alias("members")).withColumn("pairs", (F.col("members") * (F.col("members") - 1) / 2).cast("long"))
