import random

import numpy as np

from framewright.llm import substring_dedup
from framewright.llm.common import Tokens

from .conftest import words


def brute(rows, size=20):
    rank = lambda d: 2**63 if d is None else d
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, (2**64, 0)), (rank(d), i))
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < (rank(d), i):
                gone[i : i + size] = [True] * size
        yield (-1 if d is None else d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())


def found(df, **options):
    rows = substring_dedup.find(df, **options).fillna(-1, "id").collect()
    return sorted((r.id, r.n_words, r.n_removed, r.kept_text) for r in rows)


def test_edges(edge_docs, edge_rows, no_docs):
    assert found(edge_docs) == sorted(brute(edge_rows))
    assert found(no_docs) == []


def test_many_blocks(spark):
    rng = random.Random(4)
    shared = [words(rng, 50) for _ in range(4)]
    rows = [(i, " ".join([words(rng, rng.randrange(30), 5), rng.choice(shared), words(rng, rng.randrange(40), 5)])) for i in range(120)]
    rows += [(200 + i, "a b c " * (i + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, block_bytes=400) == sorted(brute(rows))


def test_spans_are_what_was_removed(edge_docs):
    for r in substring_dedup.find(edge_docs).where("n_removed > 0").collect():
        w, spans = [x.decode() for x in r.text.encode().split()], r.removed_spans
        assert sum(b - a for a, b in zip(spans[::2], spans[1::2])) == r.n_removed
        assert " ".join(x for i, x in enumerate(w) if not any(a <= i < b for a, b in zip(spans[::2], spans[1::2]))) == r.kept_text


def test_equal_windows_are_known_by_the_same_boundary():
    rng = random.Random(5)
    for n in (1, 2, 3, 50, 5000):
        letters = [b"w%d" % i for i in range(n)]
        base = [rng.choice(letters) for _ in range(300)]
        texts = []
        for _ in range(12):
            a = rng.randrange(250)
            around = [[rng.choice(letters) for _ in range(rng.randrange(30))] for _ in range(2)]
            texts.append(b" ".join(around[0] + base[a : a + rng.randrange(10, 60)] + around[1]))
        tokens = Tokens(texts)
        at, names, twice = substring_dedup.anchors(tokens, 20)
        flat, by, seen = [w for t in texts for w in t.split()], {}, {}
        for i, name in zip(at.tolist(), names.tolist()):
            window = tuple(flat[i : i + 20])
            by.setdefault(window, set()).add(name)
            seen[window] = seen.get(window, 0) + 1
        assert all(len(x) == 1 for x in by.values())
        assert all(next(iter(by[w])) in set(twice.tolist()) for w, k in seen.items() if k > 1)
        if n == 5000:  # boundaries stand for many windows each
            assert len(np.unique(names)) < 0.4 * len(names)


def test_remove_keeps_columns_and_clean_texts(edge_docs, edge_rows):
    out = substring_dedup.remove(edge_docs)
    assert out.columns == edge_docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect())
    text = {}
    want = []
    for (d, t), (k, n, lost, kept) in zip(edge_rows, brute(edge_rows)):
        if not n or lost < n:
            want.append((k, kept if lost else t or ""))
    assert got == sorted(want) and text == {}
