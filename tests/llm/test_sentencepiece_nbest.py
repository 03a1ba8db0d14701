import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from framewright.llm import sentencepiece_nbest as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sp.pieces(PATH)


def brute(model, text, n):
    """The n least (cost, ids) of the whole text's lattice."""
    if not text:
        return [(0, ())]
    s = b" " + text
    whole = {b: i for i, b in enumerate(model.bytes) if b and i not in set(model.byte_id.tolist())}
    best = {len(s): [(0, ())]}
    for i in range(len(s) - 1, -1, -1):
        if s[i] & 0xC0 == 0x80:
            continue
        w = 1
        while i + w < len(s) and s[i + w] & 0xC0 == 0x80:
            w += 1
        out = [(c + int(model.cost[whole[s[i:j]]]), (whole[s[i:j]], *p)) for j in range(i + 1, len(s) + 1) if j in best and s[i:j] in whole for c, p in best[j]]
        if s[i : i + w] not in whole:
            ids = tuple(int(model.byte_id[x]) for x in s[i : i + w])
            out += [(c + sum(int(model.cost[x]) for x in ids), (*ids, *p)) for c, p in best[i + w]]
        best[i] = sorted(out)[: 4 * n]
    return best[0][:n]


def test_nbest_against_the_whole_lattice(model):
    rng = random.Random(4)
    letters = ["a", "the", " ", "  ", "in", "er", "é", "漢", "\n", "▁", "😀", "x", "ing", "on", " t"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(14))).encode() for _ in range(120)] + [b"", b"   ", b"a"]
    ids, counts, cost, others = sp.segment(sp.Known(model, 4), texts)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    assert sp.decode_ids(model, ids, cuts) == texts
    for k, text in enumerate(texts):
        best = ids[cuts[k] : cuts[k + 1]].tolist()
        got = [(int(cost[k]), tuple(best))] + [(o["cost"], tuple(sp.edited(best, o["edits"]))) for o in others[k]]
        assert [c for c, _ in got] == [c for c, _ in brute(model, text, 4)]
        assert len({p for _, p in got}) == len(got)
        for c, p in got:
            assert sum(int(model.cost[i]) for i in p) == c
            assert sp.decode_ids(model, np.array(p, np.int64), np.array([0, len(p)])) == [text]


def test_the_cache_changes_nothing(model):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "thing", "antering", "was", "of"]) + str(rng.randrange(9)) for _ in range(30)).encode() for _ in range(20)]
    small, known = sp.Known(model, 3, most=5, most_nbest=2), sp.Known(model, 3)
    for _ in range(2):
        a, b, c = (sp.segment(x, texts) for x in (small, known, sp.Known(model, 3)))
        assert a[0].tolist() == b[0].tolist() == c[0].tolist() and a[3] == b[3] == c[3]


def test_edges(edge_docs, no_docs):
    made = sp.decode(sp.encode(edge_docs, PATH, keep=("doc_id", "text"), decoded="again"), PATH).where("again = decoded")
    assert made.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0
    assert made.count() == edge_docs.count()
    assert sp.decode(sp.encode(no_docs, PATH), PATH).collect() == []
    first = made.where("coalesce(text, '') = ''").first()
    assert first.ids == [] and first.cost == 0 and first.others == []
    assert sp.decode(edge_docs.sparkSession.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()[0].decoded == ""


def test_costs_are_log_probabilities_or_ranks():
    cost, byte = sp.costs([-2.5, -0.25, -7.0], 3)
    assert cost == [2_500_000, 250_000, 7_000_000] and byte == 17_000_000
    cost, byte = sp.costs([0.0, -1.0, -2.0], 3)
    assert cost == sorted(cost) and len(set(cost)) == 3 and byte > cost[-1]
    assert sp.costs([-2.0, 0.0, -1.0], 3)[0] == [cost[2], cost[0], cost[1]]
