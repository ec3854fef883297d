"""Passages of held-out items inside a corpus: a prefix-filtered containment join.

A document leaks an item if one of its parts holds ``window`` consecutive words of the
item, or the whole item if that is shorter. Every window of an item is a set of word
shingles all of which must occur, one behind the other; so one shingle of the window is a
sufficient prefix, and the rarest of them the best one. Steps:

1. Per document part, the positions whose shingle occurs in any item. Only runs of such
   positions as long as the shortest window needs are kept (length bound), as the item
   words' numbers; beside them the corpus counts of all item shingles.
2. For each window of each item, its rarest shingle in the corpus is its prefix token.
3. Prefix tokens meet the runs; a meeting gives the only place where the window can lie
   in the run (positional bound), and there all words are compared (exact check).

Items are treated in blocks of ``block_words`` words (and one item at most) against all documents.
What the driver holds and what is sent to the executors is one block, whatever the number of items:
a window (36 bytes) and a number (8 bytes) for each word. Documents are parsed once; with several
blocks their words are written and read again by each. Only item shingles are counted, never those
of all documents.

Defined results: null or empty documents leak nothing; an item without words is never
found; documents or items that occur twice give one row; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlume.llm import mail
from graphlume.operators.ordered import running_sum
from graphlume.session import cut

WIDTH, WINDOW, BLOCK_WORDS = 5, 25, 200_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit number for each ``width`` consecutive words."""
    if len(ids) < width:
        return np.empty(0, dtype=np.int64)
    n, total = len(ids) - width + 1, np.zeros(len(ids) - width + 1, dtype=np.uint64)
    for i in range(width):
        x = ids[i : i + n].astype(np.uint64) * _FACTORS[i]
        total = (total ^ (x ^ (x >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def _runs(hit: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` true values, as (start, end)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b - a >= least]


def _scan(vocabulary: dict[str, int], known: np.ndarray, width: int, least: int, parts: Callable[[str], list[str]]):
    """Runs of item shingles in the documents; and, in rows without a document, counts of item shingles."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = vocabulary.get
        for batch in batches:
            runs, counts = [], np.zeros(len(known), dtype=np.int64)
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for part in parts(text):
                    ids = np.fromiter((number(w, 0) for w in mail.words(part)), dtype=np.int64)
                    found = shingles(ids, width)
                    if not len(found):
                        continue
                    at = np.searchsorted(known, found)
                    at[at == len(known)] = 0
                    hit = known[at] == found
                    if not hit.any():
                        continue
                    counts += np.bincount(at[hit], minlength=len(known))
                    runs += [(doc_id, ids[a : b + width - 1], found[a:b]) for a, b in _runs(hit, least)]
            seen = np.flatnonzero(counts)
            if counts.any():
                seen = np.flatnonzero(counts)
                yield pd.DataFrame({"doc_id": [*(r[0] for r in runs), None], "ids": [*(r[1] for r in runs), counts[seen]], "hashes": [*(r[2] for r in runs), known[seen]]})

    return scan


def _leaks(documents: DataFrame, items: list[tuple[int, list[str]]], width: int, window: int, parts) -> DataFrame:
    spark = documents.sparkSession
    vocabulary: dict[str, int] = {}
    numbers = [(item, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], dtype=np.int64)) for item, ws in items]
    known = np.unique(np.concatenate([shingles(ids, width) for _, ids in numbers]))
    least = min(min(window, len(ids)) for _, ids in numbers) - width + 1
    scan = _scan(vocabulary, known, width, least, parts)
    # read by the counts and by the runs: written once, so that the documents are parsed once
    scanned = cut(documents.mapInPandas(scan, "doc_id long, ids array<bigint>, hashes array<bigint>"))
    counts = scanned.where("doc_id is null").select(F.explode(F.arrays_zip(F.col("hashes").alias("h"), F.col("ids").alias("n"))).alias("x")).groupBy(F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n"))
    rarity = dict(map(tuple, counts.collect()))  # item shingles of this block only: block_words at most

    prefixes = []
    for item, ids in numbers:
        own, size = shingles(ids, width), min(window, len(ids))
        need = size - width + 1
        rare = np.array([rarity.get(h, 0) for h in own.tolist()])
        for start in range(len(own) - need + 1):
            if rare[start : start + need].min() == 0:
                continue  # a shingle of this window occurs nowhere
            offset = int(rare[start : start + need].argmin())
            prefixes.append((int(own[start + offset]), item, offset, start, size))
    prefix = spark.createDataFrame(pd.DataFrame(prefixes, columns=["hash", "item_id", "offset", "begin", "size"]), "hash long, item_id long, offset int, begin int, size int")
    whole = spark.createDataFrame([(item, ids.tolist()) for item, ids in numbers], "item_id long, words array<bigint>")
    runs = scanned.where("doc_id is not null").select("doc_id", "ids", F.posexplode("hashes").alias("at", "hash"))
    # both are bounded by block_words: at most one window and one number for each word of the block
    met = runs.join(F.broadcast(prefix), "hash").withColumn("start", F.col("at") - F.col("offset"))
    there = met.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.size("ids"))).join(F.broadcast(whole), "item_id")
    exact = there.where(F.slice("ids", F.col("start") + 1, F.col("size")) == F.slice("words", F.col("begin") + 1, F.col("size")))
    return exact.select("doc_id", "item_id").distinct()


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, window: int = WINDOW, block_words: int = BLOCK_WORDS, parts: Callable[[str], list[str]] = mail.parts) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage of an item."""
    documents = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null and text != ''")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [mail.words(t) for t in batch["text"]]
            yield pd.DataFrame({"item": batch["item"], "words": found, "n": [len(ws) for ws in found]})

    listed = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    listed = listed.mapInPandas(read, "item long, words array<string>, n long").where("n > 0")
    # an item shorter than a shingle is one shingle; blocks hold items of one shingle width
    listed = listed.withColumn("width", F.least(F.col("n"), F.lit(width)).cast("int")).withColumn("order", F.xxhash64("item", "words"))
    listed = running_sum(listed, ["width"], ["item", "order"], "n", "before").withColumn("block", F.floor(F.col("before") / block_words).cast("long"))
    listed = cut(listed.select("width", "block", "item", "words"))
    blocks = listed.select("width", "block").distinct().orderBy("width", "block").toLocalIterator()
    out = None
    for at, next_ in itertools.pairwise(itertools.chain(blocks, [None])):
        if out is None and next_ is not None:
            documents, parts = _read_once(documents, parts), _joined_parts  # several blocks: parsed once, read by each
        # one block at a time on the driver: block_words words and one item at most
        block = [(r["item"], r["words"]) for r in listed.where((F.col("width") == at["width"]) & (F.col("block") == at["block"])).orderBy("item").collect()]
        found = _leaks(documents, block, at["width"], window, parts)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return out.distinct()


def _read_once(documents: DataFrame, parts: Callable[[str], list[str]]) -> DataFrame:
    """Documents as the words of their parts, written once: parts parted by a form feed, words by blanks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": ["\f".join(" ".join(mail.words(p)) for p in parts(t)) for t in batch["text"]]})

    return cut(documents.mapInPandas(read, "doc_id long, text string"))


def _joined_parts(text: str) -> list[str]:
    return text.split("\f")
