import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import lm_scoring

from .conftest import words


def base_scores(rows):
    docs = [(d, (t or "").encode().lower().split()) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in docs]
    train = [w for (_, w), h in zip(docs, held) if not h]
    counts = Counter(x for w in train for x in w)
    n, v = sum(counts.values()) + len(train), len(counts) + bool(train)
    for (d, w), h in zip(docs, held):
        score = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        yield (d, h, len(w) + 1, sum(counts[x] > 0 for x in w) + bool(train), n), score


def test_edges(edge_docs, edge_rows, no_docs):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens), r.base_score, r.score) for r in lm_scoring.score(edge_docs).fillna(-1, "doc_id").collect())
    want = sorted(((-1 if k[0] is None else k[0], *k[1:]), s) for k, s in base_scores(edge_rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(math.isclose(g[1], w[1], rel_tol=1e-9) and g[2] < 0 and math.isfinite(g[2]) for g, w in zip(got, want))
    assert lm_scoring.score(no_docs).collect() == []


def test_nothing_to_learn_from(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    rows = lm_scoring.score(spark.createDataFrame([(d, "some words") for d in held], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.n_tokens) for r in rows] == [(0, 0, 3)] * 2 and all(r.base_score == 0 and r.score < 0 for r in rows)


def prepared(text):
    return b" ".join((text or "").encode().lower().split())


def brute(rows, o):
    """The score of each text from plain counts, a decision at a time, weights moved after each chunk."""
    texts = [prepared(t) for _, t in rows]
    train = [t for (d, _), t in zip(rows, texts) if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    raw = b"".join(t + b"\n" for t in train)
    a = lm_scoring.Alphabet(np.bincount(np.frombuffer(raw, np.uint8), minlength=256))
    path = lambda byte: [(int(a.node[k, r]), int(a.way[k, r])) for r in [a.rank[byte]] for k in range(a.length[r])]
    marks = {}

    def mark(word, end):  # the 16 bits that stand for a word and what ends it
        if (word, end) not in marks:
            one = lm_scoring.Sequence(lm_scoring.pieces([word if end == 10 else word + b" x"], 1 << 20), a.rank, 30)
            marks[word, end] = int(one.ending[0])
        return marks[word, end]

    def coded(text):
        """For each word: (its two words before, its mark, [(contexts, byte)])."""
        line, at = b"\n" * 8 + text + b"\n", 8
        before = (b"", b"")
        for word in text.split(b" "):
            end = line[at + len(word)]
            letters = []
            for i, byte in enumerate(word + bytes([end])):
                own = word[:i]
                letters.append(((line[at + i - 4 : at + i], (own[-8:], len(own) > 8 and len(own))), byte))
            yield before, mark(word, end), letters
            before = (before[1], word)
            at += len(word) + 1

    ways = [Counter() for _ in range(2)]
    after = {}
    for t in train:
        for before, own, letters in coded(t):
            after.setdefault(before, Counter())[own] += 1
            for contexts, byte in letters:
                for node, way in path(byte):
                    for k, c in enumerate(contexts):
                        ways[k][c, node, way] += 1

    def state(right, every):  # (how much is known, the log odds of going right)
        odds = min(31, max(-31, round(4 * math.log((right + o.seen) / (every - right + o.seen)))))
        return ((every > 0) + (every > 1) + (every > 7), odds / 4) if every else (0, 0.0)

    for text in texts:
        decisions, went = [], 0  # (inputs, way, gate)
        for before, own, letters in coded(text):
            asked = before in after
            if asked:
                seen = after[before]
                least = min(seen)
                known, odds = state(seen[least], sum(seen.values()))
                decisions.append(([odds, 0], int(own == least), 6 + 3 * (known - 1) + went))
                went = 1 if own == least else 2
                if own == least:
                    continue
            for contexts, byte in letters:
                for node, way in path(byte):
                    states = [state(ways[k][c, node, 1], ways[k][c, node, 1] + ways[k][c, node, 0]) for k, c in enumerate(contexts)]
                    decisions.append(([x for _, x in states], way, min(states[1][0], 2) + 3 * asked))
        weights = np.array([[o.first_weights / 2] * 2] * 6 + [[w] * 2 for _ in range(3) for w in o.first_expected])
        offsets, bits = np.zeros(25), 0.0
        for t in range(0, len(decisions), o.chunk):
            moves, shifts = np.zeros_like(weights), np.zeros(25)
            for x, way, gate in decisions[t : t + o.chunk]:
                x = np.array(x)
                total = min(12, max(-12, weights[gate] @ x))
                p = 1 / (1 + math.exp(-(total + offsets[math.floor(total) + 12])))
                bits -= math.log2(p if way else 1 - p)
                moves[gate] += (way - p) * x
                shifts[math.floor(total) + 12] += way - p
            weights += max(o.least_rate, o.rate / (1 + t // o.chunk / 16)) * moves
            offsets += o.refine_rate * shifts
        yield -bits * math.log10(2)


def some_rows():
    rng = random.Random(2)
    lines = [words(rng, 30, 40) for _ in range(9)]
    rows = [(i, rng.choice(lines) + " " + words(rng, rng.randrange(1, 60), 90)) for i in range(40)]
    rows += [(50 + i, t) for i, t in enumerate(["", None, "w1", "Ünï漢 " * 9, "a" * 40 + " b", lines[0], lines[0], "x y " * 70, words(rng, 600, 50) + " " + lines[3]])]
    return [*rows, (None, lines[1]), (None, None)]


def test_scores_against_plain_counts(spark):
    rows = some_rows()
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "place long, doc_id long, text string")
    held = lm_scoring.held_out(F.col("doc_id"))
    plain = list(brute(rows, lm_scoring.Options()))
    # However the texts are packed and cut, the scores are the same.
    for options in (lm_scoring.Options(), lm_scoring.Options(block_bytes=700, step_bytes=200, bucket_bytes=2000), lm_scoring.Options(step_bytes=900)):
        found = {r.place: r for r in lm_scoring.score(df.repartition(3), key="place", held=held, options=options).collect()}
        assert len(found) == len(rows)
        assert np.allclose([found[i].score for i in range(len(rows))], plain, rtol=2e-3)
        sizes = [len(prepared(t)) + 1 for _, t in rows]
        assert np.allclose([found[i].bits_per_byte * n for i, n in enumerate(sizes)], [-found[i].score / math.log10(2) for i in range(len(rows))])


def test_the_tree_is_a_code():
    a = lm_scoring.Alphabet(np.bincount(np.frombuffer(b"abracadabra some other text", np.uint8), minlength=256))
    assert math.isclose(sum(2.0 ** -int(n) for n in a.length), 1) and sorted(a.rank.tolist()) == list(range(256))
    assert len({tuple(a.bits[b : b + n]) for b, n in zip(a.offset, a.length)}) == 256


def test_pieces_hold_a_text_once():
    rng = random.Random(6)
    for text in (b"", b"one", words(rng, 500).encode(), b"z" * 700, b"a " + b"z" * 700 + b" b"):
        for most in (1, 7, 100, 10_000):
            cut = lm_scoring.pieces([text], most)
            assert b"".join(p.body for p in cut) == text + b"\n"
            done = b""
            for p in cut:
                assert done.endswith(p.before) and p.before.split() == done.split()[-2:]
                done += p.body


def test_words_after_two_words_add_up():
    rng = np.random.default_rng(3)
    rows = [(int(n), int(w)) for n, w in zip(rng.integers(0, 40, 900), rng.integers(0, 9, 900))]
    want = {}
    for n, w in rows:
        want.setdefault(n, Counter())[w] += 1
    parts = []
    for k in range(5):  # five blocks; names of the last are only asked for
        mine = {}
        for n, w in rows[k::5]:
            mine.setdefault(n, Counter())[w] += 1
        parts += [(n, min(c), c[min(c)], sum(c.values())) for n, c in mine.items()]
    parts += [(n, 0, 0, 0) for n in range(50)]
    got = lm_scoring._expected(*(np.array(x, t) for x, t in zip(zip(*parts), (np.uint64, np.uint16, np.int64, np.int64))))
    for n, w, came, every in zip(*(x.tolist() for x in got)):
        c = want.get(n)
        assert (w, came, every) == ((min(c), c[min(c)], sum(c.values())) if c else (0, 0, 0))


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_texts_score_a_tenth_better_than_the_base(spark, size):
    found = lm_scoring.score(spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")).where("held_out")
    score, base = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert score > 0.9 * base


def test_scores_are_those_of_plain_counts_to_seven_digits(spark):
    rows = some_rows()
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "place long, doc_id long, text string")
    plain = list(brute(rows, lm_scoring.Options()))
    for options in (lm_scoring.Options(), lm_scoring.Options(block_bytes=700, step_bytes=200, bucket_bytes=2000)):
        found = {r.place: r.score for r in lm_scoring.score(df, key="place", held=lm_scoring.held_out(F.col("doc_id")), options=options).collect()}
        assert np.max(np.abs(np.array([found[i] for i in range(len(rows))]) / plain - 1)) < 1e-7


def test_normalised_texts_and_their_bytes():
    rng = random.Random(8)
    texts = [bytes(rng.choices(b" \t\n\x0b\x0c\r\x00\x1c\x85\xa0AZaz[@`{0", k=n)) for n in (0, 1, 2, 3, 5, 8, 40, 41, 2000) for _ in range(40)]
    assert lm_scoring.normalised(texts) == [b" ".join(t.lower().split()) for t in texts]
    for t in texts:
        assert lm_scoring.byte_counts(t).tolist() == np.bincount(np.frombuffer(t, np.uint8), minlength=256).tolist()


def test_lists_without_counts_have_the_same():
    texts = [prepared(t) for _, t in some_rows()]
    alphabet = lm_scoring.Alphabet(np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256))
    block = lm_scoring.Block(texts, np.arange(len(texts)) % 3 > 0, alphabet.rank, 30, lm_scoring.Options())
    counted, plain = lm_scoring.listed(block), lm_scoring.listed(block, counted=False)
    seq = next(block.sequences())
    for kind in range(lm_scoring.KINDS):
        code, other = np.delete(seq.code(kind), seq.not_asked), np.delete(np.repeat(~block.learned[0], seq.whole), seq.not_asked)
        want = Counter(code[~other].tolist())
        assert plain.codes[kind].tolist() == counted.codes[kind].tolist() == sorted(set(code.tolist()))
        assert counted.times[kind].tolist() == [want[c] for c in counted.codes[kind].tolist()]
    for part in ("names", "expected", "came", "every", "words"):
        assert np.array_equal(getattr(counted, part), getattr(plain, part))


def test_counts_made_small_are_the_same():
    for most in (0, 1, 255, 256, 65535, 65536, 2**32, 2**40):
        for n in (0, 1, 3, 8):
            counts = np.array([most, 0, 1, most // 2, 5, 0, 1, 2][:n], np.int64)
            assert lm_scoring._wide(lm_scoring._narrow(counts).tobytes(), n).tolist() == counts.tolist()
