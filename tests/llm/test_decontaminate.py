import math
import random
from collections import Counter

import numpy as np

from framewright.llm import decontaminate as dc
from framewright.llm.common import Tokens

from .conftest import words


def index(items, step=32):
    rows = [dc.words_of(t) for _, t in items]
    return dc.Index(items, Counter(t for r in rows for t in set(r)), len(items), sum(map(len, rows)) / len(items), step)


def test_search_finds_all_above_the_threshold(monkeypatch):
    monkeypatch.setattr(dc, "SPREAD", 300)
    rng = random.Random(3)
    for size in (15, 60, 400):
        items = [(i, words(rng, rng.randrange(3, 30), size).encode()) for i in range(50)]
        ix = index(items)
        texts = [words(rng, rng.randrange(200), size).encode() for _ in range(20)] + [t for _, t in items[:10]]
        tokens = Tokens(texts)
        passage, term, text, first = ix.passages(tokens)
        term_lists: dict = {}
        for t in range(len(ix.terms)):
            for b in range(ix.block_cut[t], ix.block_cut[t + 1]):
                term_lists.setdefault(t, []).extend((int(ix.item[p]), float(ix.weight[p])) for p in range(ix.from_[b], ix.to[b]))
        for threshold in (0.3, 0.6, 0.9):
            want = set()
            for k, t in enumerate(texts):
                w = t.split()
                for a in range(0, len(w), 32):
                    score = Counter()
                    for x in {ix.terms[y] for y in w[a : a + 64] if y in ix.terms}:
                        for item, weight in term_lists[x]:
                            score[item] += weight
                    want |= {(k, a, i) for i, s in score.items() if s >= threshold - 1e-9}
            p, i, _ = ix.retrieve(passage, term, len(text), threshold)
            assert {(int(text[x]), int(first[x]), int(y)) for x, y in zip(p, i)} == want
    assert np.isclose(1.0, ix.retrieve(np.zeros(len(set(items[0][1].split())), np.int64), np.array([ix.terms[w] for w in set(items[0][1].split())]), 1, 0.99)[2].max())


def bm25(items, passage):
    """The share of each item's BM25 score with itself that a passage has, by the formula."""
    rows = [dc.words_of(t) for _, t in items]
    mean = sum(map(len, rows)) / len(rows)
    idf = {t: math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for t, n in Counter(t for r in rows for t in set(r)).items()}
    for row in rows:
        weight = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(row) / mean)) for t, n in Counter(row).items()}
        yield sum(w for t, w in weight.items() if t in passage) / sum(weight.values())


def test_scores_are_bm25():
    rng = random.Random(4)
    items = [(i, words(rng, rng.randrange(3, 30), 60).encode()) for i in range(50)]
    ix = index(items)
    texts = [words(rng, rng.randrange(1, 32), 60).encode() for _ in range(30)]  # a passage each
    passage, term, text, _ = ix.passages(Tokens(texts))
    p, i, score = ix.retrieve(passage, term, len(text), 0.2)
    got = {(int(text[x]), int(y)): s for x, y, s in zip(p, i, score)}
    want = {(k, y): s for k, t in enumerate(texts) for y, s in enumerate(bm25(items, set(t.split()))) if s >= 0.2}
    assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], rel_tol=1e-9) for x in want) and len(want) > 50


def corpus(rng):
    items = [(i, words(rng, 30) + ".\n" + words(rng, 8) + ".") for i in range(25)] + [(90, "tiny item"), (91, None), (92, ""), (None, words(rng, 20))]
    docs = [(i, words(rng, rng.randrange(400))) for i in range(60)]
    for i in range(20):  # planted whole, in upper case, and with other punctuation
        text = items[i][1].upper() if i % 2 else items[i][1].replace(".", " !")
        docs.append((100 + i, words(rng, rng.randrange(300)) + " " + text + " " + words(rng, rng.randrange(300))))
    for i in range(20):  # a few words only
        docs.append((200 + i, words(rng, 50) + " " + " ".join(items[i][1].split()[3:11]) + " " + words(rng, 50)))
    docs += [(300, "tiny item"), (301, "item tiny"), (302, None), (303, ""), (None, items[3][1])]
    return items, docs


def test_planted_items_are_found_and_others_left(spark):
    items, docs = corpus(random.Random(5))
    bench, table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id"), spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as score")
    want = {(100 + i, i) for i in range(20)} | {(300, 90), (None, 3)}
    for limits in (dc.Limits(), dc.Limits(shard_bytes=400)):
        found = dc.search(table, bench, limits=limits).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
        kept = dc.clean(table, bench, limits=limits)
        assert kept.columns == table.columns
        assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if d not in {x for x, _ in want})


def test_edges(spark, edge_docs, no_docs):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.search(edge_docs, bench).collect()) == [4, 5]
    assert dc.search(edge_docs, none).collect() == [] and dc.clean(edge_docs, none).count() == edge_docs.count()
    assert dc.search(no_docs, bench).collect() == []
