"""Benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND.

Every training text is cut into passages of ``2 * step`` words that overlap by half; ``step`` is at least the longest
item's length, so that a copy of an item lies whole in some passage. Each passage is a query for all items whose BM25
score reaches ``threshold`` of the score that the item has with itself. Words are ASCII-lower-cased and split at ASCII
white space and punctuation.

All passages of a batch are searched at once. A passage's upper bound, the sum of its distinct words' largest weights, is
WAND's test for a pivot, and passages below the threshold have none. For the others the same test is made with the largest
weights of each block of items, and only blocks that pass it are scored. A retrieved item is then verified: enough of its question's word 3-grams and of its answer's words must
be in the passage. The answer is the last sentence of an item (its last quarter where it has one sentence only), the
question the rest; an item of under 8 words must be there as it is.

The index is sent to the workers in shards of at most ``shard_bytes`` of item text, each searched by one pass over the
texts; statistics are those of all items.

Cases: null or empty texts have no passage; items without a word are never found; rows that share an id are searched
each; a null id is carried; extra columns are not read by ``search`` and pass through ``clean``; an empty benchmark finds
nothing; of equally good passages the first is given; a very long text is cut into passages at once and searched in steps
of limited size; extra columns of ``clean`` keep their names, as no column is added on the way.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, as_bytes, slices

_TO_WORDS = bytes(c if chr(c).isalnum() or c >= 0x80 else 0x20 for c in range(256))
_SENTENCE = re.compile(rb"(?<=[.!?])\s+|\n+")
K1, B = 1.2, 0.75
POSTINGS = 8  # items in a block
SPREAD = 2 << 20  # entries of lists handled at once


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Limits:
    threshold: float = 0.5
    question: float = 0.6
    answer: float = 0.6
    shard_bytes: int = 16 << 20


class Item:
    def __init__(self, key, text: bytes):
        self.key, self.words = key, words_of(text)
        parts = [w for p in _SENTENCE.split(text.strip()) if (w := words_of(p))]
        n = len(self.words)
        if n < 8:
            question = answer = self.words
            self.size = n
        else:
            cut = n - len(parts[-1]) if len(parts) > 1 else n - max(1, n // 4)
            question, answer, self.size = self.words[:cut], self.words[cut:], 3
        self.question = self.grams(question)
        self.answer = set(answer)

    def grams(self, words: list[bytes]) -> set:
        size = min(self.size, len(words))
        return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()

    def overlaps(self, passage: list[bytes]) -> tuple[float, float]:
        size = min(self.size, min((len(g) for g in self.question), default=self.size))
        here = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
        return len(self.question & here) / max(1, len(self.question)), len(self.answer & set(passage)) / max(1, len(self.answer))


class Index:
    """Posting lists of the items of one shard, in blocks; weights are shares of an item's score with itself."""

    def __init__(self, items: list[tuple], df: dict[bytes, int], n_items: int, mean_words: float, step: int):
        self.items = [Item(*x) for x in items]
        self.step = step
        idf = {t: math.log(1 + (n_items - n + 0.5) / (n + 0.5)) for t, n in df.items()}
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for i, item in enumerate(self.items):
            norm = K1 * (1 - B + B * len(item.words) / max(mean_words, 1e-9))
            score = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in Counter(item.words).items()}
            own = sum(score.values())
            for t, s in score.items():
                lists.setdefault(t, []).append((i, s / own))
        hashes = Tokens([b" ".join(lists)]).hashes
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        terms = list(lists)
        self.terms = {terms[k]: t for t, k in enumerate(order.tolist())}
        ranked = [lists[terms[k]] for k in order.tolist()]
        # Postings of all terms one after another, by item; blocks of items, by term.
        size = np.array([len(x) for x in ranked])
        term = np.repeat(np.arange(len(ranked)), size)
        self.item = np.array([i for x in ranked for i, _ in x])
        self.weight = np.array([w for x in ranked for _, w in x])
        self.n_blocks = -(-len(self.items) // POSTINGS)
        key = term * self.n_blocks + self.item // POSTINGS
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.from_, self.to = first, np.append(first[1:], len(key))
        self.block, self.block_most = key[first] % self.n_blocks, np.maximum.reduceat(self.weight, first)
        self.block_cut = np.searchsorted(key[first] // self.n_blocks, np.arange(len(ranked) + 1))
        self.most = np.maximum.reduceat(self.weight, np.cumsum(size) - size)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, score) of all pairs that reach the threshold, for n passages given by their distinct terms.

        WAND's test with the terms' largest weights drops passages, the same test with the largest weights of each block
        of items drops blocks, and what is left is scored.
        """
        floor = threshold - 1e-9
        alive = np.bincount(passage, self.most[term], n) >= floor
        keep = np.flatnonzero(alive[passage])
        keep = keep[np.argsort(passage[keep], kind="stable")]
        passage, term = passage[keep], term[keep]
        spread = self.block_cut[term + 1] - self.block_cut[term]
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        at, done = 0, np.cumsum(spread)
        while at < len(passage):  # some passages at a time, so that what is spread out stays small
            end = int(np.searchsorted(done, (done[at - 1] if at else 0) + SPREAD))
            end = int(np.searchsorted(passage, passage[min(max(end, at), len(passage) - 1)], "right"))
            found.append(self._blocks(passage[at:end], term[at:end], spread[at:end], floor))
            at = end
        return tuple(np.concatenate(x) for x in zip(*found))

    def _blocks(self, passage: np.ndarray, term: np.ndarray, spread: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        entry = _ranges(self.block_cut[term], spread)
        pair = np.repeat(passage, spread) * self.n_blocks + self.block[entry]
        pairs, bound, which = _sums(pair, self.block_most[entry])
        entry = entry[(bound >= floor)[which]]
        pair = pair[(bound >= floor)[which]]
        size = self.to[entry] - self.from_[entry]
        posting = _ranges(self.from_[entry], size)
        pairs, score, _ = _sums(np.repeat(pair // self.n_blocks, size) * len(self.items) + self.item[posting], self.weight[posting])
        hit = score >= floor
        return pairs[hit] // len(self.items), pairs[hit] % len(self.items), score[hit]

    def passages(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passage and term of each distinct term of each passage, text and first word of each passage)."""
        halves = -(-tokens.counts // self.step)
        base = np.cumsum(halves + 1) - halves - 1  # a gap after each text
        at = np.minimum(np.searchsorted(self.hashes, tokens.hashes), len(self.hashes) - 1)
        place = np.flatnonzero(self.hashes[at] == tokens.hashes)
        term, text = at[place], tokens.text[place]
        half = base[text] + (place - tokens.starts[text]) // self.step
        order = np.argsort(term, kind="stable")
        before = np.full(len(term), -2, np.int64)  # the half in which the word came before
        same = term[order][1:] == term[order][:-1]
        before[order[1:][same]] = half[order[:-1][same]]
        new, far = before < half, (before < half - 1) & (half > base[text])
        texts = np.repeat(np.arange(len(halves)), halves + 1)
        return np.concatenate([half[new], half[far] - 1]), np.concatenate([term[new], term[far]]), texts, (np.arange(len(texts)) - base[texts]) * self.step

    def search(self, texts: list[bytes], limits: Limits) -> Iterator[tuple]:
        """(text, item key, first word of the best passage, score, question overlap, answer overlap)."""
        best: dict[tuple[int, int], tuple] = {}
        tokens = Tokens([t.lower().translate(_TO_WORDS) for t in texts])
        passage, term, text, first = self.passages(tokens)
        for p, i, score in zip(*(x.tolist() for x in self.retrieve(passage, term, len(text), limits.threshold))):
            k, a = int(text[p]), int(first[p])
            part = tokens.texts[k].split()[a : a + 2 * self.step]
            question, answer = self.items[i].overlaps(part)
            if question >= limits.question and answer >= limits.answer:
                was = best.get((k, i))
                if was is None or (score, question, answer) > was[1:]:
                    best[k, i] = (a, score, question, answer)
        for (k, i), (a, score, question, answer) in best.items():
            yield k, self.items[i].key, a, score, question, answer


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct keys, the sum of each one's values, where each value's key is among them)."""
    keys, which = np.unique(key, return_inverse=True)
    return keys, np.bincount(which, value, len(keys)), which


def _indexes(benchmark: DataFrame, key: str, text: str, limits: Limits) -> Iterator[Index]:
    """One shard after another; each holds at most about ``shard_bytes`` of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [words_of(t) for t in as_bytes(part.column("text"))]
            yield pa.RecordBatch.from_pydict({"n": [len(r) for r in rows], "terms": [sorted(set(r)) for r in rows]}, pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.binary()))]))

    items = benchmark.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    counted = items.select("text").mapInArrow(count, "n long, terms array<binary>").where("n > 0")
    stats = counted.agg(F.count("*").alias("items"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    if not stats["items"]:
        return
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    shards = -(-size // limits.shard_bytes)
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    for k in range(shards):
        mine = items.where(F.pmod(F.xxhash64("key", "text"), F.lit(shards)) == k)
        rows = sorted(((r["key"], r["text"].encode()) for r in mine.where("text is not null").collect()), key=lambda x: (x[0] is None, x))
        rows = [r for r in rows if words_of(r[1])]
        if rows:
            terms = mine.select("text").mapInArrow(count, "n long, terms array<binary>").select(F.explode("terms").alias("term")).distinct()
            df = {bytes(r["term"]): r["count"] for r in frequency.join(terms, "term", "left_semi").collect()}
            yield Index(rows, df, stats["items"], stats["mean"], max(32, stats["longest"]))


def search(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """A row for each row of ``docs`` and item found in it: the key, item_id, first_word (of the best passage), score, question_overlap, answer_overlap."""
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in (("item_id", T.LongType()), ("first_word", T.LongType()), ("score", T.DoubleType()), ("question_overlap", T.DoubleType()), ("answer_overlap", T.DoubleType())))])
    spark = docs.sparkSession

    def one(index: Index) -> DataFrame:
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text):
                found = list(sent.value.search(as_bytes(part.column(text)), limits))
                if found:
                    rows, *others = (list(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), *(pa.array(x, t) for x, t in zip(others, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())))], schema.names)

        return docs.select(key, text).mapInArrow(run, schema)

    found = [one(x) for x in _indexes(benchmark, item_key, item_text, limits)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows in which no item is found, with all their columns."""
    for index in _indexes(benchmark, item_key, item_text, limits):
        docs = docs.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(index), text, limits), docs.schema)
    return docs


def _without(sent, text: str, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            mask = np.ones(part.num_rows, bool)
            mask[[k for k, *_ in sent.value.search(as_bytes(part.column(text)), limits)]] = False
            yield part.filter(pa.array(mask))

    return run
