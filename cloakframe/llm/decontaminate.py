"""Benchmark decontamination (operator 3): BM25 index of test items, searched by every training passage.

Scores are BM25 divided by the item's score against itself, so 1 means that a
passage holds all of the item.  Passages are overlapping word windows, twice as
long as the longest item, so that an item never straddles all of them.  A
passage first meets upper bounds (of the rarer terms, by blocks of items and
then by item, plus what the common terms can add), then block-max WAND retrieves every item at or above the
threshold, then three-word overlaps of the item's question (first half) and
answer (second half) are verified.  An item of up to five words has a half
without three words; it must stand in the passage as a whole, in one run.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.5
COMMON = 0.25  # what the common terms may add to any item; the rest must come from rarer terms
_END = 1 << 60
BLOCK = 16  # items of a block of a postings list
INDEX_BYTES = 8 << 20  # item text of one index; a larger benchmark takes several, one pass over the documents each

_KEEP = np.zeros(256, bool)
_KEEP[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_KEEP[128:] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words (letters, digits, anything beyond ASCII; A-Z as a-z)."""
    low = C.LOWER[data]
    starts, ends, rows = C.pieces(_KEEP[low], offsets)
    return C.substring_hashes(C.prefix_sums(low), starts, ends), rows


def postings(items: DataFrame) -> DataFrame:
    """(iid, term, impact, words) of every distinct item text; impacts of an item sum to one."""

    def work(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for a, b, data, offsets in C.chunked(batch.column(1)):
                words, rows = tokens(data, offsets)
                sizes = np.bincount(rows, minlength=b - a)
                pair = np.unique(np.stack([rows.astype(np.uint64), words]), axis=1, return_counts=True) if len(words) else None
                if pair is not None:
                    at = pair[0][0].astype(np.int64)
                    yield C.columns_batch(iid=ids[a:b][at], term=pair[0][1].view(np.int64), tf=pair[1].astype(np.int64), words=sizes[at].astype(np.int64))

    rows = C.staged(items.mapInArrow(work, "iid long, term long, tf long, words long"))
    sizes = rows.select("iid", "words").distinct().agg(F.count(F.lit(1)), F.avg("words")).first()
    n, mean = sizes[0], sizes[1] or 1.0
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("words") / F.lit(mean)))
    weighed = rows.join(df, "term").withColumn("weight", weight)
    whole = weighed.groupBy("iid").agg(F.sum("weight").alias("whole"))
    return weighed.join(whole, "iid").select("iid", "term", (F.col("weight") / F.col("whole")).alias("impact"), "words")


@dataclass
class Index:
    """Inverted index of one block of items; everything is an array."""

    item_ids: list[int]
    terms: np.ndarray  # sorted hashes
    starts: np.ndarray  # postings of term t are starts[t]:starts[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray  # the same by blocks of items
    blocks: np.ndarray
    block_max: np.ndarray
    rare: np.ndarray  # per term, whether it counts towards the bound
    common_of_block: np.ndarray  # the most that common terms add to an item of the block
    common_of_item: np.ndarray
    parts: list[tuple[int, list[np.ndarray]]]  # words of a run, and the runs of question and answer (short items: of the whole)
    span: int  # half a passage, in words
    threshold: float

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.lists = []
        for a, b, c, d in zip(self.starts, self.starts[1:], self.block_starts, self.block_starts[1:]):
            most = dict(zip(self.blocks[c:d].tolist(), self.block_max[c:d].tolist()))
            self.lists.append((self.items[a:b].tolist(), self.impacts[a:b].tolist(), most, max(most.values())))

    # - search -

    def search(self, data: np.ndarray, offsets: np.ndarray, n: int) -> list[dict[int, float]]:
        """Per row the verified items with their best score."""
        found: list[dict[int, float]] = [{} for _ in range(n)]
        words, rows = tokens(data, offsets)
        if not len(words) or not len(self.terms):
            return found
        first = np.searchsorted(rows, np.arange(n + 1))
        hit = np.flatnonzero(self.sieve[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[hit]), len(self.terms) - 1)
        good = self.terms[at] == words[hit]
        hit, at = hit[good], at[good]
        for row, part in self._promising(hit, at, rows, first):
            begin = first[row] + part * self.span
            end = min(begin + 2 * self.span, first[row + 1])
            low, high = np.searchsorted(hit, [begin, end])
            for item, score in self.wand(np.unique(at[low:high])).items():
                if score > found[row].get(item, 0) and self._verified(item, words[begin:end]):
                    found[row][item] = score
        return found

    def _promising(self, hit, at, rows, first):
        """(row, window) of the windows in which some block of items can reach the threshold."""
        rare = self.rare[at]
        hit, at = hit[rare], at[rare]
        row = rows[hit]
        part = (hit - first[row]) // self.span
        # Parts are numbered so that neighbours within a row differ by one and rows stay apart.
        room = np.cumsum((np.diff(first) // self.span) + 3)
        base = np.concatenate([[0], room[:-1]])
        keys = np.unique((base[row] + part) * len(self.terms) + at)
        part, at = keys // len(self.terms), keys % len(self.terms)
        windows = self._reaching(part, at, self.block_starts, self.blocks, self.block_max, self.common_of_block)
        # The same bound per item, for the parts of the windows that are left.
        left = np.isin(part, np.concatenate([windows, windows + 1]))
        windows = self._reaching(part[left], at[left], self.starts, self.items, self.impacts, self.common_of_item)
        owner = np.searchsorted(base, windows, "right") - 1
        for r, p in zip(owner.tolist(), (windows - base[owner]).tolist()):
            # A window before the first part or behind the last word holds nothing that a full one does not.
            if r >= 0 and p * self.span < first[r + 1] - first[r]:
                yield r, p

    def _reaching(self, part, at, starts, columns, most, common) -> np.ndarray:
        """Windows (a part and the next one) in which the terms found can lift some column to the threshold."""
        width = len(common)
        sizes = starts[at + 1] - starts[at]
        from_ = np.repeat(starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cells, back = np.unique(np.repeat(part, sizes) * width + columns[from_], return_inverse=True)
        if not len(cells):
            return np.empty(0, np.int64)
        sums = np.bincount(back, weights=most[from_], minlength=len(cells))

        def of(wanted):
            i = np.minimum(np.searchsorted(cells, wanted), len(cells) - 1)
            return np.where(cells[i] == wanted, sums[i], 0.0)

        both = np.unique(np.concatenate([cells, cells - width]))
        bound = of(both) + of(both + width) + common[both % width]
        return np.unique(both[bound >= self.threshold - 1e-9] // width)

    def wand(self, terms: np.ndarray) -> dict[int, float]:
        """Every item whose score over these terms reaches the threshold (block-max WAND)."""
        lists = [_Cursor(self, int(t)) for t in terms]
        out: dict[int, float] = {}
        need = self.threshold - 1e-9
        while lists:
            lists.sort(key=lambda c: c.item)
            bound, pivot = 0.0, None
            for i, c in enumerate(lists):
                bound += c.most
                if bound >= need:
                    pivot = i
                    break
            if pivot is None:
                break
            item = lists[pivot].item
            while pivot + 1 < len(lists) and lists[pivot + 1].item == item:
                pivot += 1
            here = lists[: pivot + 1]
            if sum(c.block_most(item) for c in here) < need:
                goal = (item // BLOCK + 1) * BLOCK
                if pivot + 1 < len(lists):
                    goal = max(item + 1, min(goal, lists[pivot + 1].item))
            elif lists[0].item == item:
                score = sum(c.impact() for c in here)
                if score >= need:
                    out[item] = min(score, 1.0)
                goal = item + 1
            else:
                goal = item
            for c in here:
                if c.item < goal:
                    c.advance(goal)
            lists = [c for c in lists if c.item < _END]
        return out

    def _verified(self, item: int, words: np.ndarray) -> bool:
        width, parts = self.parts[item]
        have, _ = C.grams(words, np.zeros(len(words), np.int64), width)
        return all(np.isin(part, have).mean() >= OVERLAP for part in parts)


class _Cursor:
    """A position in one postings list, with the block maxima around it."""

    __slots__ = ("items", "impacts", "block_max", "most", "at", "item")

    def __init__(self, index: Index, term: int):
        self.items, self.impacts, self.block_max, self.most = index.lists[term]
        self.at, self.item = 0, self.items[0]

    def advance(self, goal: int) -> None:
        self.at = bisect_left(self.items, goal, self.at)
        self.item = self.items[self.at] if self.at < len(self.items) else _END

    def impact(self) -> float:
        return self.impacts[self.at]

    def block_most(self, item: int) -> float:
        return self.block_max.get(item // BLOCK, 0.0)


def _index(rows, texts: dict[int, tuple[int, str]], threshold: float) -> Index:
    """``rows``: (iid, term, impact) of the block; ``texts``: iid -> (item_id, text)."""
    order = sorted(texts)
    number = {iid: i for i, iid in enumerate(order)}
    parts, longest = [], 1
    for iid in order:
        raw = np.frombuffer(texts[iid][1].encode(), np.uint8)
        words, _ = tokens(raw, np.array([0, len(raw)]))
        longest = max(longest, len(words))
        half = (len(words) + 1) // 2
        width, halves = (3, [words[:half], words[half:]]) if len(words) - half >= 3 else (len(words), [words])
        parts.append((width, [C.grams(h, np.zeros(len(h), np.int64), width)[0] for h in halves]))
    item = np.array([number[r[0]] for r in rows], np.int64)
    term = np.array([r[1] for r in rows], np.int64).view(np.uint64)
    impact = np.array([r[2] for r in rows], float)
    terms, back = np.unique(term, return_inverse=True)
    at = np.lexsort((item, back))
    back, item, impact = back[at], item[at], impact[at]
    starts = np.searchsorted(back, np.arange(len(terms) + 1))
    block = item // BLOCK
    edge = np.flatnonzero(np.concatenate([[True], (back[1:] != back[:-1]) | (block[1:] != block[:-1])])) if len(back) else np.empty(0, np.int64)
    block_max = np.maximum.reduceat(impact, edge) if len(edge) else np.empty(0)
    block_starts = np.searchsorted(back[edge], np.arange(len(terms) + 1))
    # The most frequent terms are left out of the bound as long as they add little to every item.
    common, rare = np.zeros(len(order)), np.ones(len(terms), bool)
    for t in np.argsort(-np.diff(starts), kind="stable"):
        span = slice(starts[t], starts[t + 1])
        if (common[item[span]] + impact[span]).max() > COMMON:
            break
        common[item[span]] += impact[span]
        rare[t] = False
    blocks = np.zeros((len(order) + BLOCK - 1) // BLOCK)
    np.maximum.at(blocks, np.arange(len(order)) // BLOCK, common)
    return Index([texts[i][0] for i in order], terms, starts, item, impact, block_starts, block[edge], block_max, rare, blocks, common, parts, longest, threshold)


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES):
    """One index after the other; item texts reach the driver a bounded block at a time."""
    text = F.coalesce(F.col("text"), F.lit(""))
    items = C.staged(benchmark.groupBy(F.xxhash64(text).alias("iid")).agg(F.min("item_id").alias("item_id"), F.first(text).alias("text")))
    whole = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if not whole:
        return
    rows = C.staged(postings(items.select("iid", "text")))
    parts = -(-whole // index_bytes)
    block = F.pmod(F.col("iid"), F.lit(parts))
    for part in range(parts):
        mine = rows.filter(block == part).select("iid", "term", "impact").collect()
        if mine:
            known = {r[0] for r in mine}
            texts = {r["iid"]: (r["item_id"], r["text"]) for r in items.filter(block == part).collect() if r["iid"] in known}
            yield _index(mine, texts, threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``items`` (ids of leaked items, ascending) and ``leak_score`` (best score, 0 if none).

    NULL and empty texts and items leak nothing.  Items with equal texts are one item,
    known by its smallest id.
    """
    items, score = C.free(docs, "items"), C.free(docs, "leak_score")
    out = docs.select("*", F.array().cast("array<bigint>").alias(items), F.lit(0.0).alias(score))
    at = docs.columns.index("text")
    for number, index in enumerate(indexes(benchmark, threshold, index_bytes)):
        packed = pickle.dumps(index)
        schema = out.schema

        def work(batches, packed=packed):
            index = pickle.loads(packed)
            for batch in batches:
                ids, best = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                for a, b, data, offsets in C.chunked(batch.column(at)):
                    for row, hits in enumerate(index.search(data, offsets, b - a), a):
                        if hits:
                            more = [index.item_ids[i] for i in hits if index.item_ids[i] is not None]
                            ids[row] = sorted({*ids[row], *more})
                            best[row] = max(best[row], *hits.values())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=batch.schema.names)

        out = (C.staged(out) if number else out).mapInArrow(work, schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without a leaked item."""
    return contamination(docs, benchmark, threshold).filter(F.col(C.free(docs, "leak_score")) == 0).select(*docs.columns)


def op3_decontaminate(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.select("doc_id", (F.col("leak_score") > 0).alias("contaminated"), "items", F.round("leak_score", 6).alias("leak_score"))
