import math
import random
from collections import Counter
from fractions import Fraction
from math import comb

from pyspark.sql import functions as F

from framewright.llm import sharding


def test_draws_have_the_law():
    rng = random.Random(1)
    for good, bad, draws in ((5, 7, 6), (50, 30, 20), (1, 9, 3), (1000, 3000, 50)):
        seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(20_000))
        for k in range(max(0, draws - bad), min(draws, good) + 1):
            p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
            assert abs(seen[k] / 20_000 - p) < 5 * (p * (1 - p) / 20_000) ** 0.5 + 1e-3
    assert 0 <= sharding.hypergeometric(rng, 10**9, 15 * 10**9, 10**8) <= 10**8


def test_matrix_has_both_margins():
    m = sharding.matrix([10, 0, 5, 7], 3, 1)
    assert [sum(r) for r in m] == [10, 0, 5, 7] and sorted(map(sum, zip(*m))) == [7, 7, 8]


def test_edges(edge_docs, edge_rows, no_docs):
    out = sharding.shuffle(edge_docs, 4, range_rows=5)
    assert set(out.columns) == set(edge_docs.columns)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(edge_rows)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert sharding.shuffle(no_docs, 4).collect() == []


def test_equal_rows_spread_and_places_look_random(spark):
    same = spark.range(2000).select(F.lit(1).alias("x"))
    assert [r["count"] for r in sharding.shuffle(same, 8, range_rows=100).groupBy("shard").count().collect()] == [250] * 8
    rows = sharding.shuffle(spark.range(4000), 4, seed=3).collect()
    table = Counter((r.id // 1000, r.shard) for r in rows)
    assert all(abs(n - 250) < 70 for n in table.values()) and len(table) == 16
    again = sharding.shuffle(spark.range(4000), 4, seed=4).collect()
    assert {r.id: r.shard for r in rows} != {r.id: r.shard for r in again}


def test_sizes_and_checksums(spark):
    import zlib

    for text in (None, "", "é漢"):
        r = spark.createDataFrame([(text,)], "t string").select(sharding.text_size(F.col("t")).alias("n"), sharding.text_crc32(F.col("t")).alias("c")).first()
        assert (r.n, r.c) == (len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))


def test_main_path_is_native(spark):
    plan = sharding.shuffle(spark.range(10), 2)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_probabilities_at_any_size():
    for good, bad, draws in ((5, 7, 4), (1, 1, 1), (300, 900, 250), (40, 4_000, 1_000), (10_000, 3, 9_000), (50_000, 70_000, 333)):
        for x in range(max(0, draws - bad), min(draws, good) + 1, max(1, min(draws, good) // 40)):
            want = Fraction(math.comb(good, x) * math.comb(bad, draws - x), math.comb(good + bad, draws))
            if want > 1e-250:
                assert math.isclose(sharding.probability(x, good, bad, draws), want, rel_tol=1e-9)
    good, bad, draws = 10**12, 15 * 10**12, 10**12
    spread = math.sqrt(draws * good / (good + bad) * bad / (good + bad) * (1 - draws / (good + bad)))
    assert math.isclose(sharding.probability(draws // 16, good, bad, draws), 1 / (spread * math.sqrt(2 * math.pi)), rel_tol=1e-6)
