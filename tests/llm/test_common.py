import random

from types import SimpleNamespace

import numpy as np
import pytest

from framewright.llm.common import _CLEAN, Tokens, covered, shared_dir, spread, window_hash, written


def test_words_are_those_of_split():
    rng = random.Random(1)
    pieces = [b"a", b"bc", b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r", b"\xc2\x85", "é".encode(), b"longword" * 40, b"\x00", b"\x1c", b"12345678", b"123456789"]
    for _ in range(200):
        texts = [b"".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))]
        t = Tokens(texts)
        assert t.counts.tolist() == [len(x.split()) for x in texts]
        known = {}
        for word, h in zip((w for x in texts for w in x.split()), t.hashes.tolist()):
            assert known.setdefault(word, h) == h
        assert len(set(known.values())) == len(known)


def test_window_hashes_are_those_of_the_windows():
    words = np.random.default_rng(1).integers(0, 3, 500).astype(np.uint64)
    for size in (1, 3, 5, 8, 13, 20):
        by = {}
        for i, h in enumerate(window_hash(words, size).tolist()):
            by.setdefault(h, set()).add(tuple(words[i : i + size]))
        assert sum(map(len, by.values())) == len(by) == len({tuple(words[i : i + size]) for i in range(501 - size)})


def test_covered():
    assert covered(6, np.array([1, 2]), 2).tolist() == [False, True, True, True, False, False]
    assert covered(3, np.array([2]), 5).tolist() == [False, False, True]


def test_small_scans_use_all_cores(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert cores > 1 and spread(one).rdd.getNumPartitions() == cores and spread(one).count() == 1000
    made = spark.range(10)
    assert spread(made) is made


def test_written_tables_are_their_query(spark):
    before = spark.conf.get(_CLEAN, None)
    out = written(spark.range(100).selectExpr("id % 7 as k").groupBy("k").count())
    assert spark.conf.get(_CLEAN, None) == before
    assert sorted(map(tuple, out.collect())) == [(k, 15 if k < 2 else 14) for k in range(7)]


def test_a_cluster_must_name_its_shared_folder():
    session = lambda where, master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: where), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("hdfs://here/x/", "yarn")) == "hdfs://here/x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session(None, "spark://host:7077"))
