import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from framewright.llm import jaccard_join
from framewright.llm.components import connected

from .conftest import words


def brute(rows, percent=75):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def check(df, rows, **options):
    got = jaccard_join.join(df, options=jaccard_join.Options(**options)).collect()
    assert sorted(map(key, ((r.doc_id, r.n_shingles, r.component_id) for r in got))) == sorted(map(key, brute(rows)))


def test_edges(edge_docs, edge_rows, no_docs):
    check(edge_docs, edge_rows)
    assert jaccard_join.join(no_docs).collect() == []


def test_chains_and_borderline_pairs(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(15):  # each copy differs a little from the one before: components far wider than one link
        w = words(rng, rng.randrange(40, 90)).split()
        for _ in range(12):
            rows.append((len(rows), " ".join(w)))
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    line = words(rng, 14)
    rows += [(len(rows) + i, line + " " + words(rng, rng.randrange(3))) for i in range(60)]  # a line that many short texts have
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    check(df, rows)
    check(df, rows, pairs_per_row=0, settled=0.0)
    check(df, rows, pairs_per_row=10**6)


def test_filters_never_drop_a_link():
    rng = np.random.default_rng(8)
    for _ in range(300):
        base = np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64))
        other = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)]))
        if not len(other):
            continue
        both = len(np.intersect1d(base, other))
        linked = 100 * both >= 75 * (len(base) + len(other) - both)
        assert jaccard_join.linked(base, other, 75) == linked
        if linked:
            assert jaccard_join.may_link(jaccard_join.parities(base), jaccard_join.parities(other), len(base), len(other), 75)
            options = jaccard_join.Options()
            assert jaccard_join.share_firsts(jaccard_join.firsts(base, options), jaccard_join.firsts(other, options), options)
            frequent = np.sort(rng.choice(base, len(base) // 3))
            differ = np.bitwise_count((jaccard_join.sketch(base) ^ jaccard_join.sketch(other)).view(np.uint64)).sum()
            assert not linked or 175 * differ <= 25 * (len(base) + len(other))
            counts = rng.integers(4, 9, len(frequent))
            assert np.intersect1d(jaccard_join.prefix(base, frequent, counts, 75), jaccard_join.prefix(other, frequent, counts, 75)).size


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    got = {r.v: r.root for r in connected(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[1000 + i] for i in range(50)}) == 1 and got[0] != got[1000]
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_keep_one(edge_docs, edge_rows, no_docs):
    out = jaccard_join.keep_one(edge_docs)
    assert out.columns == edge_docs.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    full = brute(edge_rows)
    empty = Counter(r for r, f in zip(edge_rows, full) if not f[1])
    assert all(kept[k] == n for k, n in empty.items())
    groups = {}
    for r, (d, n, c) in zip(edge_rows, full):
        if n and c is not None:
            groups.setdefault(c, set()).add(r)
    for c, members in groups.items():
        mine = [m for m in members if kept[m] and m[0] == c]
        assert len(mine) == 1 and kept[mine[0]] == 1
    assert sum(n for (d, t), n in kept.items() if d is not None and (t or "").split()) == len(groups)
    assert jaccard_join.keep_one(no_docs).collect() == []


def test_every_link_within_a_component_is_counted(spark):
    rng = random.Random(9)
    rows = []
    for k in (2, 3, 40):  # near copies that are all unequal, some of them twice; and chains
        w = words(rng, 80).split()
        for i in range(k):
            rows += [(len(rows) + j, " ".join([*w[:-3], f"n{i}", *w[-2:]])) for j in range(1 + i % 3)]
    w = words(rng, 60).split()
    for i in range(12):
        w[rng.randrange(len(w))] = f"c{i}"
        rows.append((len(rows), " ".join(w)))
    rows += [(1000, ""), (1001, None), (1002, "alone")]
    sets = []
    for _, t in rows:
        x = (t or "").split()
        sets.append(frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) if len(x) > 4 else frozenset([tuple(x)] if x else []))
    want = {d: sum(i != j and bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y) for j, y in enumerate(sets)) for i, ((d, _), x) in enumerate(zip(rows, sets))}
    assert max(want.values()) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for block in (512, 7):
        assert {r.doc_id: r.n_links for r in jaccard_join.join(df, options=jaccard_join.Options(block=block)).collect()} == want


def test_first_tokens_keep_few_strangers():
    rng = np.random.default_rng(3)
    options = jaccard_join.Options()
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(60)]
    known = [jaccard_join.firsts(s, options) for s in sets]
    met = sum(jaccard_join.share_firsts(x, y, options) for i, x in enumerate(known) for y in known[:i])
    assert met < 10 and jaccard_join.share_firsts(known[0], known[0], options)


def test_close_pairs_against_all_pairs():
    rng = np.random.default_rng(6)
    n, root = rng.integers(20, 60, 90), rng.integers(0, 5, 90)
    bits = rng.integers(0, 2**63, (90, 8)).astype(np.uint64) & rng.integers(0, 2**63, (90, 8)).astype(np.uint64) & np.uint64(0x0101010101010101)
    first, stop = np.arange(90) + 1, np.repeat([40, 90], [40, 50])
    for step in (1, 7, 1 << 18):
        got = set(zip(*(x.tolist() for x in jaccard_join._close_pairs(first, stop, n, root, bits, 75, step))))
        want = {(i, j) for i in range(90) for j in range(i + 1, int(stop[i])) if root[i] != root[j] and 100 * min(n[i], n[j]) >= 75 * max(n[i], n[j]) and 175 * np.bitwise_count(bits[i] ^ bits[j]).sum() <= 25 * (n[i] + n[j])}
        assert got == want and want


def test_rows_without_ids_and_large_buckets(spark):
    rng = random.Random(12)
    shared = words(rng, 12)
    rows = [(None, words(rng, 40)) for _ in range(30)] + [(None, rows_) for rows_ in [words(rng, 40)] * 30]
    rows += [(i, shared + " " + words(rng, 60)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(df, rows, block=6, pairs_per_row=10**6)


def test_buckets_pass_on_no_more_links_than_join_them(spark):
    rng = np.random.default_rng(21)
    options = jaccard_join.Options(block=16)
    near, far = (rng.integers(0, 10**9, n) for n in (400, 400))
    texts = [" ".join(f"w{x}" for x in [*near[:-2], rng.integers(10**9), near[-1]]) for _ in range(40)]  # every two are linked
    texts += [" ".join(f"w{x}" for x in [*far[:280], *rng.integers(0, 10**9, 120)]) for _ in range(40)]  # no two are, though they share most
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) copy").repartition(3)
    digest = jaccard_join._digest(df, options).where("sid is not null").cache()
    for tok in (1, 2):  # two buckets that hold all of them: pairs meet in each
        rows = digest.selectExpr(f"{tok}L tok", "sid", "n", "sid root")
        left = rows if tok == 1 else left.union(rows)
    found = jaccard_join._across(df, left, left.groupBy("tok").agg(F.count("*").alias("k")), digest, options)
    ids = {r.sid: r.doc_id for r in digest.collect()}
    links = [(ids[r.a], ids[r.b]) for r in found.collect()]
    assert all(max(x) < 40 for x in links) and len({r.root for r in connected(found).collect()}) == 1
    # 3 parts give 6 pairs of parts; in each at most one link fewer than there are sets.
    assert {x for link in links for x in link} == set(range(40)) and len(links) <= 3 * 80 < 40 * 39 // 2


def test_folded_bitmaps_allow_what_may_link_allows():
    rng = np.random.default_rng(22)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: rng.integers(20, 3000)], rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64)])) for _ in range(40)]
    n = np.array([len(x) for x in sets])
    maps = [jaccard_join.folded(jaccard_join.parities(x), 256) for x in sets]
    assert max(map(len, maps)) == 256 and len(set(map(len, maps))) > 2
    i, j = np.triu_indices(len(sets), 1)
    want = [jaccard_join.may_link(maps[a], maps[b], int(n[a]), int(n[b]), 75) for a, b in zip(i, j)]
    for step in (1, 100, 1 << 20):
        assert jaccard_join._alike(i, j, n, maps, 75, step).tolist() == want
    assert all(w for a, b, w in zip(i, j, want) if jaccard_join.linked(sets[a], sets[b], 75)) and any(want) and not all(want)
