"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Training passages, overlapping windows of words, are the queries, test items the documents of the index. An item's
impacts are divided by its score for itself, so a score is the share of the item that a passage covers. All
items at or above the threshold are retrieved, then verified by the overlap of question and answer.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import opened, sent, stage

THRESHOLD, OVERLAP, GRAM = 0.6, 0.8, 5
#: Items of a block at least, and blocks of an index at most.
SPAN, MAX_BLOCKS = 4, 256
K1, B = 1.2, 0.75
#: Items of one index; a larger benchmark is searched in blocks of so many.
INDEX_ITEMS, INDEX_CHARS = 4_000, 5_000_000
_WORD = re.compile(r"\w+")
_ANSWER = re.compile(r"(?s)^(.*\S)\s*(?:\n|(?<=[.!?])\s)\s*(\S.*)$")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Question and answer: the last line, or else the last sentence, is the answer; one sentence alone has none."""
    body = text.strip()
    head, cut, tail = body.rpartition("\n")
    if cut and words(head) and words(tail):
        return words(head), words(tail)
    if (m := _ANSWER.match(body)) and words(m[1]) and words(m[2]):
        return words(m[1]), words(m[2])
    return words(body), []


def grams(ws: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


class Index:
    """Postings by term, sorted by item, in blocks of items that each keep the largest impact.

    Items are numbered by length, so that a block's items have impacts of one size and its bounds are tight.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        items = sorted(items, key=lambda x: (len(words(x[1])), x[0] is None, x[0] or 0))
        self.ids = [i for i, _ in items]
        self.parts = [split_item(t or "") for _, t in items]
        docs = [q + a for q, a in self.parts]
        mean = sum(map(len, docs)) / max(1, len(docs)) or 1.0
        self.longest = max([1, *map(len, docs)])
        df: dict[str, int] = {}
        for d in docs:
            for t in set(d):
                df[t] = df.get(t, 0) + 1
        idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        self.vocabulary = {t: i for i, t in enumerate(sorted(df))}
        self.postings: list[tuple[list[int], list[float]]] = [([], []) for _ in self.vocabulary]
        for i, d in enumerate(docs):
            tf: dict[str, int] = {}
            for t in d:
                tf[t] = tf.get(t, 0) + 1
            impact = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(d) / mean)) for t, n in tf.items()}
            whole = sum(impact.values())
            for t, x in impact.items():
                ids, xs = self.postings[self.vocabulary[t]]
                ids.append(i)
                xs.append(x / whole)
        # Blocks are intervals of items; each term keeps its largest impact in every block. The last row is for words of no item.
        self.span = max(SPAN, -(-len(docs) // MAX_BLOCKS))
        self.tops = np.zeros((len(self.postings) + 1, max(1, -(-len(docs) // self.span))), dtype="float32")
        for t, (ids, xs) in enumerate(self.postings):
            np.maximum.at(self.tops[t], np.array(ids) // self.span, np.array(xs, dtype="float32"))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score for a passage of these distinct terms reaches the threshold.

        Blocks whose maxima cannot reach it together are passed over; in the others, the block's maxima choose the pivots.
        """
        tops, found = self.tops[terms], []
        for block in np.flatnonzero(tops.sum(0) >= self.threshold - 1e-4).tolist():
            bounds = tops[:, block]
            own = np.flatnonzero(bounds)
            found += self._block(block, terms[own].tolist(), bounds[own].tolist())
        return found

    def _block(self, block: int, terms: list[int], bounds: list[float]) -> list[tuple[int, float]]:
        found, end = [], (block + 1) * self.span
        lists = []
        for t, top in zip(terms, bounds):
            ids, xs = self.postings[t]
            p = bisect_left(ids, block * self.span)
            lists.append([ids[p], p, top, ids, xs])
        while lists:
            lists.sort(key=lambda x: x[0])
            total, pivot = 0.0, -1
            for n, x in enumerate(lists):
                total += x[2]
                if total >= self.threshold - 1e-4:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            to = item
            if lists[0][0] == item:
                score = sum(x[4][x[1]] for x in lists[: pivot + 1])
                if score >= self.threshold - 1e-9:
                    found.append((item, score))
                to = item + 1
            kept = []
            for x in lists[: pivot + 1]:
                ids, p = x[3], x[1]
                while p < len(ids) and ids[p] < to:
                    p += 1
                if p < len(ids) and ids[p] < end:
                    x[0], x[1] = ids[p], p
                    kept.append(x)
            lists = kept + lists[pivot + 1 :]
        return found

    def verify(self, item: int, passage: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's word GRAMs that the passage has; no answer: the question's."""
        shares = []
        for part in self.parts[item]:
            n = min(GRAM, len(part))
            own = grams(part, n) if n else set()
            shares.append(len(own & grams(passage, n)) / len(own) if own else None)
        return shares[0] or 0.0, shares[1] if shares[1] is not None else shares[0] or 0.0

    def hits(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(item id, score, question overlap, answer overlap) of every test item that some passage of the text contains."""
        ws = words(text)
        if not ws or not self.ids:
            return []
        none = len(self.postings)
        ids = np.fromiter(map(self.vocabulary.get, ws, repeat(none)), dtype=np.int64, count=len(ws))
        step = max(32, self.longest)
        best: dict[int, tuple[float, float, float]] = {}
        for s in range(0, max(1, len(ws) - step), step):
            terms = np.unique(ids[s : s + 2 * step])
            if hits := self.search(terms[terms < none]):
                passage = ws[s : s + 2 * step]
                for item, score in hits:
                    question, answer = self.verify(item, passage)
                    if question >= OVERLAP and answer >= OVERLAP and (item not in best or best[item] < (score, question, answer)):
                        best[item] = (score, question, answer)
        return [(self.ids[i], *best[i]) for i in sorted(best)]


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes, one after the other, over blocks of at most INDEX_ITEMS items and INDEX_CHARS code points; items without a word are left out.

    A benchmark is a stated query set; it is read through an iterator, block by block. Items without an id are searched
    like any other; repeated items are items of their own.
    """
    block, chars = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if words(r.text):
            if block and (len(block) >= INDEX_ITEMS or chars + len(r.text) > INDEX_CHARS):
                yield Index(block)
                block, chars = [], 0
            block.append((r.item_id, r.text))
            chars += len(r.text)
    if block:
        yield Index(block)


def _searched(docs: DataFrame, benchmark: DataFrame, label: str, search) -> list[DataFrame]:
    """search(docs, the broadcast index) for each index; only the last is not staged yet, so one index at a time is held."""
    out, before = [], None
    for index in indexes(benchmark):
        if before is not None:
            out[-1] = stage(out[-1], label)
            before.destroy()
        before = sent(docs.sparkSession, index)
        out.append(search(docs, before))
    return out


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap): a row for each row of docs and test item found in it.

    score is the share of the item's BM25 that its best passage covers. Null and empty texts and items find nothing.
    Repeated rows, and repeated items, each give theirs; a doc_id or item_id may be null; texts are searched whole, however
    long; an empty table on either side gives an empty result; other columns are not read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def search(docs: DataFrame, index) -> DataFrame:
        def run(batches):
            held = opened(index)
            for b in batches:
                rows = [(None if pd.isna(d) else int(d), *h) for d, t in zip(b["doc_id"], b["text"]) for h in held.hits(t)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                yield out.astype({"doc_id": "Int64", "item_id": "Int64"})

        return docs.select("doc_id", "text").mapInPandas(run, schema)

    found = _searched(docs, benchmark, "decontamination-found", search)
    return reduce(DataFrame.unionByName, found, docs.sparkSession.createDataFrame([], schema))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with their columns, without the rows in which a test item is found, with or without an id.

    Null and empty texts stay; of repeated rows all stay or all go; texts are searched whole, however long; an empty
    benchmark keeps all; columns of any name pass through as they are.
    """
    out, before = docs, None
    for index in indexes(benchmark):
        if before is not None:
            out = stage(out, "decontamination-clean")
            before.destroy()
        before = sent(docs.sparkSession, index)

        def run(batches, index=before):
            held = opened(index)
            for b in batches:
                yield b[[not held.hits(t) for t in b["text"]]]

        out = out.mapInPandas(run, docs.schema)
    return out
