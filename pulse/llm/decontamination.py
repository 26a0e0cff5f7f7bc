"""Benchmark decontamination by a BM25 index of the test items, searched with block-max WAND.

Items are indexed by term with BM25 weights and one upper bound per block of postings. Every text is one
query: its words that stand in a word 5-gram of some item (of all words, for items of fewer words). A text
without such words is skipped; for the others WAND walks the postings, skips blocks that cannot reach the
threshold, and returns all items above their own threshold. The threshold is a lower bound of the score
that any text accepted by the verification has (``least_score``), so retrieval loses no accepted leak,
also when its parts lie far apart. Hits are verified by the share of the item's word 5-grams that stand in
the text, question and answer (the last sentence) apart: half of all, or half of the answer's and a
quarter of all. Benchmarks of more than ``BLOCK_ITEMS`` items are searched in blocks.

Null and empty texts and items match nothing. Repeated documents give repeated results.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")
OVERLAP, GRAM, POSTINGS, BLOCK_ITEMS = 0.5, 5, 64, 20_000
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def grams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(GRAM, max(len(words), 1))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def accepted(whole: float, answer: float) -> bool:
    """Whether shares of an item's grams and of its answer's grams are a leak."""
    return whole >= OVERLAP or (answer >= OVERLAP and whole >= OVERLAP / 2)


def _least_of(words: list[str], weight: dict[str, float], part: dict[str, float], share: float) -> float:
    """A lower bound of the summed weights of the distinct words in any ``share`` of the grams of ``words``.

    ``m`` distinct grams start at ``m`` places or more and so cover ``m + n - 1`` places; ``part`` is a word's
    weight divided by its occurrences in the item. The heaviest of ``m`` grams weighs the m-th smallest or more.
    """
    own = grams(words)
    m, n = math.ceil(share * len(own)), len(next(iter(own)))
    places = sum(sorted(part[w] for w in words)[: m + n - 1])
    return max(places, sorted(sum(weight[w] for w in set(g)) for g in own)[m - 1])


def least_score(words: list[str], answer: list[str], weight: dict[str, float]) -> float:
    """A lower bound of the score of any text that ``accepted`` takes for the item."""
    count = Counter(words)
    part = {w: weight[w] / c for w, c in count.items()}
    by_answer = _least_of(words, weight, part, OVERLAP / 2)
    if min(GRAM, len(answer)) == min(GRAM, len(words)):  # else the answer's grams are shorter than the ones looked up
        by_answer = max(by_answer, _least_of(answer, weight, part, OVERLAP))
    return min(_least_of(words, weight, part, OVERLAP), by_answer) * (1 - 1e-9)


def _codes(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of term numbers that start at ``at``."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[at + k].astype(np.uint64) + np.uint64(1)
    return out


class Terms(dict):
    """Numbers of terms; unknown words get the number after the last."""

    def __missing__(self, word: str) -> int:
        return len(self)


class Index:
    """Postings of items with block bounds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, words_of(t), t) for i, t in items if words_of(t)]
        n, mean = len(self.items), np.mean([len(w) for _, w, _ in self.items]) if self.items else 1.0
        seen = Counter(t for _, w, _ in self.items for t in set(w))
        idf = {t: float(np.log(1 + (n - c + 0.5) / (c + 0.5))) for t, c in seen.items()}
        self.term = Terms(zip(seen, range(len(seen))))
        self.lists: list[tuple[list[int], list[float]]] = [([], []) for _ in seen]
        self.need, self.parts = [], []
        codes: dict[int, list[np.ndarray]] = defaultdict(list)
        for at, (_, words, text) in enumerate(self.items):
            weight = {}
            for t, c in Counter(words).items():
                weight[t] = idf[t] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean))
                docs, weights = self.lists[self.term[t]]
                docs.append(at), weights.append(weight[t])
            sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if words_of(s)]
            answer = words_of(sentences[-1]) if len(sentences) > 1 else words
            self.need.append(least_score(words, answer, weight))
            self.parts.append((grams(words), grams(answer)))
            n = min(GRAM, len(words))
            codes[n].append(_codes(np.array([self.term[t] for t in words]), np.arange(len(words) - n + 1), n))
        #: Sorted hashes of the items' grams, by their number of words.
        self.codes = {n: np.unique(np.concatenate(c)) for n, c in codes.items()}
        self.least = min(self.need, default=np.inf)
        self.blocks = [[max(w[i : i + POSTINGS]) for i in range(0, len(w), POSTINGS)] for _, w in self.lists]
        self.bound = np.array([max(b) for b in self.blocks] + [0.0])

    def wand(self, terms: list[int]) -> list[int]:
        """Items whose score over distinct query terms reaches their own threshold."""
        heads = [[0, t] for t in terms]
        out = []
        while heads:
            heads.sort(key=lambda h: self.lists[h[1]][0][h[0]])
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(heads):
                total += self.bound[t]
                if total >= self.least:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = self.lists[heads[pivot][1]][0][heads[pivot][0]]
            while pivot + 1 < len(heads) and self.lists[heads[pivot + 1][1]][0][heads[pivot + 1][0]] == doc:
                pivot += 1
            block = 0.0
            for place, t in heads[: pivot + 1]:
                at = bisect_left(self.lists[t][0], doc, place)
                if at < len(self.lists[t][0]):
                    block += self.blocks[t][at // POSTINGS]
            if block >= self.need[doc]:
                score = 0.0
                for place, t in heads[: pivot + 1]:
                    docs, weights = self.lists[t]
                    at = bisect_left(docs, doc, place)
                    if at < len(docs) and docs[at] == doc:
                        score += weights[at]
                if score >= self.need[doc]:
                    out.append(doc)
            for h in heads[: pivot + 1]:
                h[0] = bisect_left(self.lists[h[1]][0], doc + 1, h[0])
            heads = [h for h in heads if h[0] < len(self.lists[h[1]][0])]
        return out

    def search(self, text: str | None) -> list[tuple[int, float, float]]:
        """Items found in a text: id, share of the item's grams and of its answer's grams."""
        words = words_of(text)
        if not words or not self.items:
            return []
        none = len(self.term)
        ids = np.fromiter(map(self.term.__getitem__, words), np.int64, len(words))
        known = ids < none
        shared = np.zeros(len(words), bool)
        for n, codes in self.codes.items():
            if len(words) < n:
                continue
            whole = known[: len(words) - n + 1].copy()
            for k in range(1, n):
                whole &= known[k : len(words) - n + 1 + k]
            at = np.flatnonzero(whole)
            mine = _codes(ids, at, n)
            at = at[codes[np.minimum(np.searchsorted(codes, mine), len(codes) - 1)] == mine]
            for k in range(n):
                shared[at + k] = True
        found = self.wand(np.unique(ids[shared]).tolist())
        if not found:
            return []
        mine, out = grams_in(words, {len(next(iter(p[0]))) for p in (self.parts[d] for d in found)} | {len(next(iter(self.parts[d][1]))) for d in found}), []
        for d in sorted(found):
            whole, answer = (len(p & mine) / len(p) for p in self.parts[d])
            out.append((self.items[d][0], whole, answer))
        return out


def grams_in(words: list[str], sizes: set[int]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, question_share, answer_share) of every verified hit."""
    kind = docs.schema[doc_id].dataType.simpleString()
    named = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    blocks = max(1, -(-named.count() // BLOCK_ITEMS))

    def search(block: int) -> DataFrame:
        mine = named.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else named
        listed = docs.sparkSession.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in mine.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(listed.value)
            for batch in batches:
                rows = [
                    (d, *hit)
                    for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for hit in index.search(t)
                    if accepted(hit[1], hit[2])
                ]
                cols = list(zip(*rows)) if rows else [[], [], [], []]
                types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "item_id", "question_share", "answer_share"])

        return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, item_id long, question_share double, answer_share double")

    return reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])
