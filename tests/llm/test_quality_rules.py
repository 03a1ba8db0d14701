import base64
import math
import random
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F

from framewright.llm import quality_rules

from .conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed)


def test_edges(edge_docs, edge_rows, no_docs):
    got = quality_rules.judge(edge_docs).fillna(-1, "doc_id").collect()
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted((-1 if d is None else d, *base(t)) for d, t in edge_rows)
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.judge(no_docs).collect() == []
    kept = quality_rules.keep(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in got)


def test_verdicts():
    rng = random.Random(3)
    syllables = ["ka", "ro", "ti", "men", "su", "lo", "vi", "da", "en", "the", "an", "or", "is", "sch", "um", "el"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    clean = [prose(n) for n in (60, 150, 400, 1500, 5000)]
    noise = ["".join(chr(rng.randrange(33, 127)) + " " * (rng.random() < 0.1) for _ in range(n)) for n in (4000, 20_000)]
    again = [prose(90) + "\n" + (prose(30) + " x ") * 1 + ("again and again %s\n" % prose(40)) * 12]
    page = prose(2000)
    mixed = [page + "\n" + prose(20) * 900]
    for text in clean:
        assert quality_rules.measure([text.encode()], quality_rules.Bands())["kept"][0], len(text)
    for text in [*noise, *again, *mixed]:
        assert not quality_rules.measure([text.encode()], quality_rules.Bands())["kept"][0], text[:80]


def test_dup_lines(spark):
    text = "one line\n\n one line\none line\nother\nother\r\nother"
    assert base(text)[3] == quality_rules.measure([text.encode()], quality_rules.Bands())["n_dup_lines"][0] == 2
    assert words(random.Random(1), 3).count(" ") == 2


def test_encoded_text_is_dropped_alone_and_within_prose():
    rng = random.Random(5)
    syllables = ["ka", "ro", "ti", "men", "su", "lo", "vi", "da", "en", "the", "an", "or", "is", "sch", "um", "el"]
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    cut = lambda s: " ".join(s[i : i + 12] for i in range(0, len(s), 12))
    encoded = lambda n: cut(base64.b64encode(rng.randbytes(n)).decode())[:n]
    letters = lambda n: cut("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)))[:n]
    for n in (700, 1024, 2048, 4096, 8192, 50_000):
        assert not quality_rules.measure([encoded(n).encode()], quality_rules.Bands())["kept"][0], n
    assert not quality_rules.measure([letters(10_000).encode()], quality_rules.Bands())["kept"][0]
    for n in (60, 250, 700, 1500, 5000):
        assert quality_rules.measure([prose(n).encode()], quality_rules.Bands())["kept"][0], n
    for n in (6000, 24_000):
        page = prose(5000)[:n]
        found = quality_rules.measure([(page + " " + encoded(n)).encode()], quality_rules.Bands())
        assert not found["kept"][0] and found["n_bad_chunks"][0] > found["n_chunks"][0] // 4
    tail = prose(2000)[:4096] + " " + encoded(3500)  # the encoded part is in no full chunk
    found = quality_rules.measure([tail.encode()], quality_rules.Bands())
    assert not found["kept"][0] and (found["n_chunks"][0], found["n_bad_chunks"][0]) == (2, 1)


def test_measures_against_brute_force(spark):
    rng = random.Random(9)
    bands = quality_rules.Bands()
    texts = [words(rng, n) + tail for n, tail in ((0, ""), (3, "\n"), (60, ""), (700, "é" * 9), (1500, " \n x"), (9000, ""), (5000, base64.b64encode(rng.randbytes(9000)).decode()))]
    texts += ["a" * 4096, "ab " * 1536, words(rng, 2000)[:4607], words(rng, 2000)[:4608], ""]
    size = lambda raw: len(zstandard.ZstdCompressor(level=3).compress(raw))

    def limits(n):
        points = [(math.log2(b), low, high) for b, low, high in bands.whole]
        x = min(max(math.log2(max(n, 1)), points[0][0]), points[-1][0])
        for (a, *one), (b, *two) in zip(points, points[1:]):
            if a <= x <= b:
                return [p + (q - p) * (x - a) / (b - a) for p, q in zip(one, two)]

    for row, text in zip(sorted(quality_rules.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()), texts):
        raw = text.encode()
        chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)] if len(raw) >= 4096 else []
        if len(chunks) > 1 and len(chunks[-1]) < 512:
            chunks[-2:] = [chunks[-2] + chunks[-1]]
        bad = [x for x in chunks if not all((limits(len(x))[k] + bands.chunk[k] - limits(4096)[k] - len(x) / size(x)) * s <= 1e-9 for k, s in ((0, 1), (1, -1)))]
        ratio = len(raw) / size(raw) if raw else 0
        assert (row.ratio, row.n_chunks, row.n_bad_chunks) == (ratio, len(chunks), len(bad))
        low, high = limits(len(raw))
        assert row.kept == (not base(text)[-1] and low <= ratio <= high and sum(map(len, bad)) <= 0.25 * len(raw) * bool(chunks)), len(raw)


def test_fitted_bands_drop_what_labels_call_bad(spark):
    """Limits from the good half of the labels reject the bad texts of the other half, and few good ones."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2))
    bands = quality_rules.fit(docs, labels.where(half == 0))
    found = quality_rules.judge(docs, bands=bands).where("not base_failed").join(labels.where(half == 1), "doc_id")
    kept = {r["quality"]: r["kept"] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[0] < 0.25 and kept[1] > 0.985


def test_fit_without_labels_and_with_nulls(spark, edge_docs, no_docs):
    bands = quality_rules.Bands()
    labels = spark.createDataFrame([(1, None), (None, 1), (10**9, 1)], "doc_id long, quality int")
    assert quality_rules.fit(edge_docs, labels) == bands == quality_rules.fit(no_docs, labels)
    assert quality_rules.fit(edge_docs, labels.limit(0)) == bands


def test_quantiles_and_lines_come_from_all_rows(spark):
    rng = np.random.default_rng(4)
    values = {0: rng.normal(2, 0.3, 9000), 1: np.full(50, 1.5), 2: np.repeat([1.0, 3.0], [999, 1]), 3: np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, x in values.items() for v in x], "k int, v double").repartition(5)
    shares = (0.002, 0.5, 0.996, 1.0)
    got = quality_rules._quantiles(df, shares)
    for k, x in values.items():
        assert np.allclose(got[k], [np.sort(x)[round(s * (len(x) - 1))] for s in shares], atol=1e-9)
    size = np.exp2(rng.uniform(5, 12, 21_000)).astype(int)  # more than 20,000 labelled texts
    ratio = 1 + 0.1 * np.log2(size) + rng.normal(0, 0.05, len(size))
    texts = spark.createDataFrame([(int(n), float(r), None, None) for n, r in zip(size, ratio)], "size long, ratio double, least double, most double")
    bands = quality_rules.limits_of(texts, quality_rules.Bands(), quality_rules.Fit())
    x, found = np.log2(size), {b: (low, high) for b, low, high in bands.whole}
    for k in range(6, 12):
        near = np.abs(x - k) <= 1
        line = np.polyfit(x[near] - k, ratio[near], 1)
        off = np.sort(ratio[near] - np.polyval(line, x[near] - k))
        low, high = (off[round(s * (len(off) - 1))] for s in (0.002, 0.996))
        assert np.allclose(found[1 << k], (line[-1] + low - 0.01, line[-1] + high + 0.01), atol=1e-6)
    assert bands.chunk == quality_rules.Bands().chunk


def test_fit_uses_every_label(spark):
    assert "rows" not in quality_rules.Fit.__dataclass_fields__
    rng = random.Random(8)
    rows = [(i, words(rng, 60 + i % 7)) for i in range(120)]
    docs = spark.createDataFrame([*rows, (None, words(rng, 70))], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i, _ in rows] * 2, "doc_id long, quality int")
    bands = quality_rules.fit(docs, labels)
    raw = [t.encode() for _, t in rows]
    size = np.array([len(t) for t in raw])
    ratio = np.array([len(t) / len(zstandard.ZstdCompressor(level=3).compress(t)) for t in raw])
    k = int(np.log2(size.max()))
    near = np.abs(np.log2(size) - k) <= 1
    line = np.polyfit(np.log2(size[near]) - k, ratio[near], 1)
    off = ratio[near] - np.polyval(line, np.log2(size[near]) - k)
    assert np.allclose({b: x for b, *x in bands.whole}[1 << k], (line[-1] + off.min() - 0.01, line[-1] + off.max() + 0.01), atol=1e-6)
