"""Near duplicates: texts whose sets of word shingles have a Jaccard similarity of at least a threshold, and their components.

Candidates come from prefix filtering under several global token orders. If J(x, y) >= t, then x and y share a token among
the first n - ceil(t n) + 1 of each under any one order of all tokens. Under the first order, by hash, the tokens of
prefixes (and those that several sets of a slice have) are only counted; the second order has the tokens that were counted
often last, by their counts. Sets that share a prefix
token under it are brought together; of these only pairs go on whose parity bitmaps allow the similarity and that share a
prefix token under each further order (other hashes) too, known by 16 bits. Only for what passes all filters the sets
themselves are read and compared exactly.

Equal sets are one vertex, however many texts have it. Sets with a common prefix token are a bucket; each slice of the
input lists a token once, so a token has no more rows in one task than there are slices. In rounds, each bucket's leader
(first the set with the most shared tokens, then others by hash) is compared with those of the bucket that are in other
components, and leaves it; buckets all in one component are done. When few pairs are left, or a round settles little,
the rest of each bucket is split into parts, and each pair of parts is a task. It compares all its pairs by sizes and
bitmaps, then the sets of the rows that any pair allows, and passes on links between components, no more than join them.
So no component is split, no bucket meets one task, and pairs are never rows. Then all pairs of distinct sets within a
component are compared, each once, in blocks, and each text's links are counted; ``keep_one`` needs components only and
leaves this out.

Words are ASCII-lower-cased. A text with fewer words than a shingle has one shingle, all its words.

Cases: null and empty texts have an empty set, link with nothing and are their own component; repeated rows are one
vertex; a component's id is the least id of its rows that isn't null; sizes and thresholds are compared in integers;
extra columns are not read by ``join`` and pass through ``keep_one``. Sets and shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, as_bytes, discard, mix, signed, slices, unsigned, window_hash, written
from .components import connected

_SLICE = 8 << 20
SKETCH = 8
#: The largest bitmaps that go with pairs and rows of buckets; those of larger sets are folded.
MAP_BYTES = 1024


@dataclass(frozen=True)
class Options:
    words: int = 5
    #: The least similarity in percent.
    percent: int = 75
    #: How many of the most frequent tokens go last in the second order; they are sent to all workers (16 bytes each).
    frequent: int = 1 << 20
    #: Tokens that fewer sets have in their first prefixes aren't called frequent.
    frequent_from: int = 4
    #: How many tokens more than the prefix are counted, in percent of it.
    counted_percent: int = 30
    #: Further token orders that candidates must pass.
    orders: int = 2
    #: Rounds go on while there are more pairs left than this many times the buckets' rows and the last round settled at least
    #: this share of them.
    pairs_per_row: int = 4
    settled: float = 0.15
    #: How many sets of a component, or of what is left of a bucket, are compared with as many others at once.
    block: int = 512


def shingles(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    tokens = Tokens([t.lower() for t in texts])
    runs = window_hash(tokens.hashes, size)
    sets = []
    for text, a, b in zip(tokens.texts, tokens.starts.tolist(), tokens.ends.tolist()):
        if b - a >= size:
            found = np.sort(runs[a : b - size + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.split()), seed=b - a)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set that doesn't depend on an order."""
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s, 5).sum(dtype=np.uint64) + np.uint64(len(s)) for s in sets], np.uint64), 6)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def prefix(tokens: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens of a sorted set under the second order: the others by hash, then the frequent ones by their counts."""
    size = prefix_size(len(tokens), percent)
    if not len(frequent) or not len(tokens):
        return tokens[:size]
    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
    late = frequent[at] == tokens
    early = tokens[~late]
    if len(early) >= size:
        return early[:size]
    rest = tokens[late]
    return np.concatenate([early, rest[np.lexsort((rest, counts[at[late]]))][: size - len(early)]])


def parities(tokens: np.ndarray) -> bytes:
    """For each of 2 to 4 times as many buckets as tokens (a power of two, 64 at least), whether an odd number of tokens falls in it.

    Two sets' bitmaps, the larger folded to the smaller's size, differ in no more bits than the sets differ in tokens.
    """
    buckets = max(64, 1 << (2 * len(tokens)).bit_length())
    hit = np.bincount((mix(tokens, 30) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(hit.astype(np.uint8)).tobytes()


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The parities of SKETCH * 64 buckets as longs, which a join's condition can compare."""
    hit = np.bincount((mix(tokens, 30) & np.uint64(SKETCH * 64 - 1)).astype(np.int64), minlength=SKETCH * 64) & 1
    return np.packbits(hit.astype(np.uint8)).view(np.int64)


def bitmap(tokens: np.ndarray) -> bytes:
    """The parities of SKETCH * 64 buckets at least and of MAP_BYTES * 8 at most."""
    found = parities(tokens)
    return folded(found, MAP_BYTES) if len(found) >= 8 * SKETCH else sketch(tokens).tobytes()


def folded(found: bytes, most: int) -> bytes:
    """A bitmap of parities for at most ``most`` bytes' buckets (a power of two)."""
    return np.bitwise_xor.reduce(np.frombuffer(found, np.uint8).reshape(-1, most), axis=0).tobytes() if len(found) > most else found


def firsts(tokens: np.ndarray, options: Options) -> bytes:
    """For each further order the first tokens under it, by 16 bits, sorted and distinct; the orders' numbers of them ahead.

    Equal tokens have equal bits, so sets without a common number have no common prefix token.
    """
    size = prefix_size(len(tokens), options.percent)
    found = [np.unique((np.partition(mix(tokens, 20 + k), size - 1)[:size] & np.uint64(0xFFFF)).astype("<u2")) for k in range(options.orders)] if size else []
    return np.array([len(f) for f in found], "<u4").tobytes() + b"".join(f.tobytes() for f in found)


def share_firsts(x: bytes, y: bytes, options: Options) -> bool:
    """Whether two sets' ``firsts`` have a number in common under each further order."""
    a = b = 4 * options.orders
    for n, m in zip(np.frombuffer(x, "<u4", options.orders).tolist(), np.frombuffer(y, "<u4", options.orders).tolist()):
        if not _common(np.frombuffer(x, "<u2", n, a), np.frombuffer(y, "<u2", m, b)):
            return False
        a, b = a + 2 * n, b + 2 * m
    return True


def may_link(x: bytes, y: bytes, n: int, m: int, percent: int) -> bool:
    """False only for sets that aren't similar: J >= t means that at most (1 - t) / (1 + t) of both sizes' sum differs."""
    if len(x) > len(y):
        x, y = y, x
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return (100 + percent) * int(np.bitwise_count(a ^ b).sum()) <= (100 - percent) * (n + m)


_DIGEST = "doc_id long, sid long, n int, copy long, parity binary, firsts binary, map binary, tok long, sets int"
_ROWS = "tok long, sid long, n int, first boolean, others boolean"


def _digest(docs: DataFrame, options: Options) -> DataFrame:
    """A row (doc_id, sid, n, copy: the text's hash, and what filters need) for each text; for each slice a row (tok, sets) for each
    token that is in the first prefix of one of its sets, or in several of its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            sets = shingles(as_bytes(part.column("text")), options.words)
            sizes = np.fromiter(map(len, sets), np.int32, len(sets))
            names = set_names(sets)
            _, first = np.unique(names, return_index=True)
            every, times = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
            counted = times > 1
            for i in first.tolist():
                counted[np.searchsorted(every, sets[i][: -(-prefix_size(len(sets[i]), options.percent) * (100 + options.counted_percent) // 100)])] = True
            every, times = every[counted], times[counted].astype(np.int32)
            k, m = len(sets), len(every)
            after = lambda column: pa.concat_arrays([column, pa.nulls(m, column.type)])
            of_text = [part.column("doc_id"), pa.array(signed(names), mask=sizes == 0), pa.array(sizes), part.column("copy"), pa.array([parities(x) for x in sets], pa.binary()),
                       pa.array([firsts(x, options) for x in sets], pa.binary()), pa.array(list(map(bitmap, sets)), pa.binary())]
            of_token = [pa.concat_arrays([pa.nulls(k, c.type), c]) for c in (pa.array(signed(every)), pa.array(times))]
            yield pa.RecordBatch.from_arrays([*map(after, of_text), *of_token], ["doc_id", "sid", "n", "copy", "parity", "firsts", "map", "tok", "sets"])

    return docs.mapInArrow(run, _DIGEST)


def _prefix_rows(docs: DataFrame, frequent, options: Options) -> DataFrame:
    """For each prefix token of a slice's sets one of them (first; others: whether there are more), and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _SLICE):
            sets = shingles(as_bytes(part.column("text")), options.words)
            names, at = np.unique(set_names(sets), return_index=True)
            prefixes = [prefix(sets[i], *frequent.value, options.percent) for i in at]
            sizes = np.fromiter((len(sets[i]) for i in at), np.int32, len(at))
            if not sizes.any():
                continue
            of = np.repeat(np.arange(len(at)), list(map(len, prefixes)))
            tok = np.concatenate(prefixes)
            order = np.argsort(tok, kind="stable")
            tok, of = tok[order], of[order]
            first = np.concatenate([[True], tok[1:] != tok[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(signed(tok)), pa.array(signed(names[of])), pa.array(sizes[of]), pa.array(first), pa.array(np.append(~first[1:], False))], ["tok", "sid", "n", "first", "others"])

    return docs.mapInArrow(run, _ROWS)


def _sets(docs: DataFrame, vertices: DataFrame, wanted: DataFrame, options: Options) -> DataFrame:
    """(sid, tokens: the set as 8-byte numbers) for the sets in ``wanted`` (sid), each read from one text."""
    source = vertices.select("sid", F.col("doc_id").alias("source"), F.col("copy").alias("source_copy")).join(wanted.distinct(), "sid", "left_semi")
    # By id and text: rows without an id, or that share one, have their own text's set only.
    chosen = docs.join(source, F.col("doc_id").eqNullSafe(F.col("source")) & (F.col("copy") == F.col("source_copy"))).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingles(as_bytes(part.column("text")), options.words)
            right = signed(set_names(sets)) == part.column("sid").to_numpy()  # another text may have the same id
            yield pa.RecordBatch.from_arrays([part.column("sid").filter(pa.array(right)), pa.array([s.tobytes() for s, x in zip(sets, right) if x], pa.binary())], ["sid", "tokens"])

    return written(chosen.mapInArrow(run, "sid long, tokens binary").groupBy("sid").agg(F.first("tokens").alias("tokens")))


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have the similarity."""
    both = _common(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def _verified(pairs: DataFrame, sets: DataFrame, options: Options) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    one, two = (sets.select(F.col("sid").alias(c), F.col("tokens").alias(f"{c}_tokens")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), options.percent) for x, y in zip(batch.column("a_tokens"), batch.column("b_tokens"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(run, "a long, b long")


def _close(a: str, b: str, options: Options):
    return (F.col(a) * 100 >= F.col(b) * options.percent) & (F.col(b) * 100 >= F.col(a) * options.percent)


def _possible(pairs: DataFrame, vertices: DataFrame, options: Options) -> DataFrame:
    """The pairs (a, b) that neither their bitmaps nor their first tokens under the further orders rule out; a written table.

    Small bitmaps come first, so that the larger ones and the tokens are exchanged for the few sets that are left only.
    """

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(c).to_numpy() for c in ("a_n", "b_n")]).astype(np.int64)
            at = np.arange(batch.num_rows)
            keep = _alike(at, at + batch.num_rows, n, batch.column("a_map").to_pylist() + batch.column("b_map").to_pylist(), options.percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a_parity", "b_parity", "a_n", "b_n", "a_firsts", "b_firsts")))
            keep = [may_link(*row, options.percent) and share_firsts(x, y, options) for *row, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def joined(pairs: DataFrame, sets: DataFrame, columns: list[str], keep) -> DataFrame:
        one, two = (sets.select(F.col("sid").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in columns)) for c in "ab")
        return written(pairs.join(one, "a").join(two, "b").select("a", "b", *(f"{c}_{x}" for x in columns for c in "ab")).mapInArrow(keep, "a long, b long"))

    few = joined(pairs, vertices, ["n", "map"], narrow)
    wanted = few.select(F.col("a").alias("sid")).union(few.select("b")).distinct()
    sets = written(vertices.select("sid", "n", "parity", "firsts").join(wanted, "sid", "left_semi"))
    possible = joined(few, sets, ["n", "parity", "firsts"], run)
    discard(few, sets)
    return possible


def _links(docs: DataFrame, vertices: DataFrame, pairs: DataFrame, options: Options) -> DataFrame:
    """Those of the pairs that are links, as a written table."""
    possible = _possible(pairs, vertices, options)
    sets = _sets(docs, vertices, possible.select(F.col("a").alias("sid")).union(possible.select("b")), options)
    links = written(_verified(possible, sets, options))
    discard(possible, sets)
    return links


def similar(x: list[np.ndarray], y: list[np.ndarray], percent: int, step: int = 1 << 12) -> np.ndarray:
    """For each of the sets x and each of y whether they have the similarity, exactly."""
    every_x, every_y = np.concatenate(x), np.concatenate(y)
    n, m = (np.fromiter(map(len, s), np.int64, len(s)) for s in (x, y))
    shared = np.intersect1d(every_x, every_y)
    places = []
    for tokens, sizes in ((every_x, n), (every_y, m)):
        at = np.searchsorted(shared, tokens)
        found = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == tokens) if len(shared) else np.empty(0, np.int64)
        found = found[np.argsort(at[found], kind="stable")]
        places.append((at[found], np.repeat(np.arange(len(sizes)), sizes)[found], len(sizes)))
    both = np.zeros((len(x), len(y)), np.int64)
    for a in range(0, len(shared), step):
        has = []
        for at, row, k in places:
            i, j = np.searchsorted(at, [a, a + step])
            has.append(np.zeros((k, min(step, len(shared) - a)), np.float32))
            has[-1][row[i:j], at[i:j] - a] = 1
        both += (has[0] @ has[1].T).astype(np.int64)
    return 100 * both >= percent * (n[:, None] + m - both)


def _across(docs: DataFrame, left: DataFrame, sizes: DataFrame, vertices: DataFrame, options: Options) -> DataFrame:
    """Of what is left of buckets (tok, sid, n, root) links (a, b) across components, enough of them to connect all that links
    connect; a written table.

    ``sizes``: (tok, k rows). Small buckets share a task; of a large one each pair of parts is one. Two passes keep, in each
    task, the rows that have another one which their sizes and bitmaps allow, first by the small bitmaps, then by the whole
    ones; a third one compares these rows' sets and passes on only links that join what its other links haven't joined. So
    none has more rows than it is given.
    """
    bins = left.count() // (4 * options.block) + 1
    parts = F.ceil(F.col("k") / options.block).cast("int")
    named = left.join(sizes.select("tok", parts.alias("parts")), "tok").join(vertices.select("sid", "map"), "sid")
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("tok"), F.lit(bins))).otherwise(F.col("tok"))
    placed = named.withColumn("part", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = ["small", "place", "low", "high"]
    tasks = placed.select("tok", "sid", "n", "root", "map", "part", (F.col("parts") == 1).alias("small"), place.alias("place"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def allowed(table: pa.Table, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        tok, part, n, root = (table.column(c).to_numpy() for c in ("tok", "part", "n", "root"))
        order = np.lexsort((part, tok))
        tok, part, n, root = tok[order], part[order], n[order].astype(np.int64), root[order]
        stop = np.searchsorted(tok, tok, "right")
        first = np.arange(len(tok)) + 1
        if low != high:  # rows of one part with those of the other
            first = np.where(part == low, np.searchsorted(part, high), stop)
        bits = np.frombuffer(b"".join(folded(x, 8 * SKETCH) for x in maps), np.uint64).reshape(-1, SKETCH)
        i, j = (order[x] for x in _close_pairs(first, stop, n, root, bits[order], options.percent))
        ok = _alike(i, j, table.column("n").to_numpy().astype(np.int64), maps, options.percent)
        return i[ok], j[ok]

    def near(table: pa.Table) -> pa.Table:
        found = np.unique(np.concatenate(allowed(table, table.column("map").to_pylist())))
        return table.select(["tok", "sid", "n", "root", "part", *task]).take(pa.array(found))

    def compare(table: pa.Table) -> pa.Table:
        every, at = np.unique(table.column("sid").to_numpy(), return_index=True)
        tokens = {x: np.frombuffer(table.column("tokens")[i].as_buffer(), np.uint64) for x, i in zip(every.tolist(), at.tolist())}
        maps = {x: parities(t) if len(t) >= 32 * SKETCH else bitmap(t) for x, t in tokens.items()}
        sid, root = table.column("sid").to_pylist(), table.column("root").to_pylist()
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        links, strangers = [], set()
        for i, j in zip(*(x.tolist() for x in allowed(table, [maps[x] for x in sid]))):
            one, two, pair = top(root[i]), top(root[j]), (min(sid[i], sid[j]), max(sid[i], sid[j]))
            if one != two and pair not in strangers:
                if linked(tokens[pair[0]], tokens[pair[1]], options.percent):
                    above[one] = two
                    links.append(pair)
                else:
                    strangers.add(pair)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    made = "tok long, sid long, n int, root long, part int, small boolean, place long, low int, high int"
    some = written(tasks.groupBy(*task).applyInArrow(near, made))
    whole = vertices.select("sid", F.when(F.length("parity") > MAP_BYTES, F.col("parity")).otherwise(F.col("map")).alias("map"))
    rows = written(some.join(whole, "sid").groupBy(*task).applyInArrow(near, made))
    discard(some)
    sets = _sets(docs, vertices, rows.select("sid"), options)
    links = written(rows.join(sets, "sid").groupBy(*task).applyInArrow(compare, "a long, b long").distinct())
    discard(rows, sets)
    return links


def _alike(i: np.ndarray, j: np.ndarray, n: np.ndarray, maps: list[bytes], percent: int, step: int = 1 << 20) -> np.ndarray:
    """What ``may_link`` says of each pair of rows i and j with these sizes and bitmaps."""
    width = np.fromiter(map(len, maps), np.int64, len(maps)) // 8
    least, ok = np.minimum(width[i], width[j]), np.zeros(len(i), bool)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        rows = np.unique(np.concatenate([i[pairs], j[pairs]]))
        bits = np.stack([np.frombuffer(folded(maps[r], 8 * w), np.uint64) for r in rows.tolist()])
        each = max(1, step // w)
        for a in range(0, len(pairs), each):
            at = pairs[a : a + each]
            differ = np.bitwise_count(bits[np.searchsorted(rows, i[at])] ^ bits[np.searchsorted(rows, j[at])]).sum(axis=1, dtype=np.int64)
            ok[at] = (100 + percent) * differ <= (100 - percent) * (n[i[at]] + n[j[at]])
    return ok


def _close_pairs(first: np.ndarray, stop: np.ndarray, n: np.ndarray, root: np.ndarray, bits: np.ndarray, percent: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of row i with rows first[i] to stop[i] that are in other components and whose sizes and sketches allow the similarity."""
    count = np.maximum(stop - first, 0)
    done, out = np.cumsum(count), []
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + step, "right")))
        size = count[a:b]
        i = np.repeat(np.arange(a, b), size)
        j = np.arange(len(i)) + np.repeat(first[a:b] - (np.cumsum(size) - size), size)
        ok = (root[i] != root[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
        i, j = i[ok], j[ok]
        differ = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
        ok = differ * (100 + percent) <= (n[i] + n[j]) * (100 - percent)
        out.append((i[ok], j[ok]))
        a = b
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def _degrees(docs: DataFrame, vertices: DataFrame, digest: DataFrame, roots: DataFrame, options: Options) -> DataFrame:
    """(sid, links): with how many texts of other sets each set's texts are linked; a written table of the sets that have links."""
    copies = digest.where("sid is not null").groupBy("sid").agg(F.count("*").alias("copies"))
    members = written(roots.withColumnRenamed("v", "sid").join(copies, "sid").select("sid", "root", "copies"))
    sets = _sets(docs, vertices, members.select("sid"), options)
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / options.block).cast("int").alias("parts"))
    bins = members.count() // (4 * options.block) + 1
    part = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    placed = members.join(sizes, "root").join(sets, "sid").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # Small components share a task; of a large one each pair of parts is one.
    place = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root"))
    tasks = placed.select("sid", "root", "copies", "tokens", "part", (F.col("parts") == 1).alias("small"), place.alias("place"), F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))

    def compare(table: pa.Table) -> pa.Table:
        sid, root, part, copies = (table.column(c).to_numpy() for c in ("sid", "root", "part", "copies"))
        tokens = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        order = np.argsort(root, kind="stable")
        names, links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for mine in np.split(order, np.flatnonzero(np.diff(root[order])) + 1):
            x, y = mine[part[mine] == low], mine[part[mine] == high]
            if not len(x) or not len(y):
                continue
            found = similar([tokens[i] for i in x], [tokens[i] for i in y], options.percent)
            if low == high:
                np.fill_diagonal(found, False)
            else:
                names.append(sid[y])
                links.append(found.T.astype(np.int64) @ copies[x])
            names.append(sid[x])
            links.append(found.astype(np.int64) @ copies[y])
        return pa.table({"sid": np.concatenate(names), "links": np.concatenate(links)})

    found = tasks.groupBy("small", "place", "low", "high").applyInArrow(compare, "sid long, links long")
    out = written(found.groupBy("sid").agg(F.sum("links").alias("links")))
    discard(members, sets)
    return out


def _vertices(docs: DataFrame, options: Options, count_links: bool) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The digest (doc_id, sid, n) of all texts, (sid, root) of all sets that have a link, and, where asked for, their links' numbers."""
    spark = docs.sparkSession
    table = written(_digest(docs, options))
    counts = table.where("tok is not null").groupBy("tok").agg(F.sum("sets").alias("sets")).where(F.col("sets") >= options.frequent_from)
    top = counts.orderBy(F.desc("sets"), "tok").limit(options.frequent).toArrow()
    tokens, times = unsigned(top.column("tok").to_numpy().astype(np.int64)), top.column("sets").to_numpy().astype(np.int64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], times[order]))
    digest = written(table.where("tok is null").select("doc_id", "sid", "n"))
    vertices = written(table.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "copy")).alias("row"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("firsts").alias("firsts"), F.first("map").alias("map")).select("sid", "row.doc_id", "row.copy", "n", "parity", "firsts", "map"))
    discard(table)

    rows = written(_prefix_rows(docs, frequent, options))
    met = rows.where("first").select("tok", "sid", "n", "others", F.count("*").over(Window.partitionBy("tok")).alias("slices")).where("slices > 1 or others")
    together = written(met.select("tok", "sid", "n").union(rows.where("not first").select("tok", "sid", "n")).distinct())
    discard(rows)
    shared = together.groupBy("sid").agg(F.count("*").cast("int").alias("shared"))
    left = written(together.join(shared, "sid").select("tok", "sid", "n", "shared", F.col("sid").alias("root")))
    discard(together)

    links, roots, r, pairs_before = [], None, 0, math.inf
    while True:
        leader = F.max(F.struct(F.col("shared") if r == 0 else F.xxhash64("sid", F.lit(r)), "sid", "n", "root"))
        leaders = written(left.groupBy("tok").agg(leader.alias("lead"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("tok", F.col("lead.sid").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.root").alias("lead_root")))
        met = left.join(leaders, "tok")
        pairs = met.where("root <> lead_root").where(_close("lead_n", "n", options)).select(F.least("lead", "sid").alias("a"), F.greatest("lead", "sid").alias("b")).distinct()
        links.append(_links(docs, vertices, pairs, options))
        roots = connected(reduce(DataFrame.union, links))
        rest = met.where("sid <> lead").select("tok", "sid", "n", "shared").join(roots.withColumnRenamed("v", "sid"), "sid", "left").select("tok", "sid", "n", "shared", F.coalesce("root", "sid").alias("root"))
        before, left = left, written(rest)
        discard(before, leaders)
        parts = left.groupBy("tok", "root").count().groupBy("tok").agg(F.sum("count").alias("k"), F.sum(F.col("count") * F.col("count")).alias("kk"), F.count("*").alias("parts")).where("parts > 1")
        size = parts.agg(F.sum("k").alias("rows"), F.sum((F.col("k") * F.col("k") - F.col("kk")) / 2).alias("pairs")).first()
        if not size["rows"]:
            break
        if size["pairs"] <= options.pairs_per_row * size["rows"] or size["pairs"] > (1 - options.settled) * pairs_before:
            sizes = written(parts.select("tok", "k"))  # a table of its own, so that Spark can split the buckets it is joined with
            links.append(_across(docs, left, sizes, vertices, options))
            roots = connected(reduce(DataFrame.union, links))
            discard(sizes)
            break
        r, pairs_before = r + 1, size["pairs"]
    discard(left)
    degrees = _degrees(docs, vertices, digest, roots, options) if count_links else None
    discard(vertices)
    return digest, roots, degrees


def join(df: DataFrame, key: str = "doc_id", text: str = "text", options: Options = Options(), count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, sid (of its set; null: empty) and root (one for a component; null: empty) for each row,
    and, unless ``count_links`` is false, n_links, how many other rows it is similar to. ``key`` is an integer column."""
    docs = df.select(df[key].cast("long").alias("doc_id"), df[text].alias("text"), F.xxhash64(df[text]).alias("copy"))
    digest, roots, degrees = _vertices(docs, options, count_links)
    least = digest.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    placed = written(least.join(roots.withColumnRenamed("v", "sid"), "sid", "left").select("sid", "least", "copies", F.coalesce("root", "sid").alias("root")))
    ids = written(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    own = [] if degrees is None else [(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")]
    if degrees is not None:
        placed = placed.join(degrees, "sid", "left")
    ids = written(placed.join(ids, "root").select("sid", "root", "component_id", *own))
    return digest.join(ids, "sid", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sid", "root", *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if own else []))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", options: Options = Options()) -> DataFrame:
    """One row of each component, that with the least id, with all its columns; texts without words all stay."""
    found = written(join(df, key, text, options, count_links=False))
    kept = found.where("sid is null or doc_id <=> component_id")
    kept = written(kept.groupBy("root", "doc_id").agg(F.min("sid").alias("sid")).select("doc_id", "sid"))
    name, size, copy = (_free(df, x) for x in ("sid", "size", "copy"))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType()), T.StructField(size, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, _SLICE):
            sets = shingles(as_bytes(part.column(text)), options.words)
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(signed(set_names(sets)), mask=sizes == 0), pa.array(sizes)], schema.names)

    rows = df.mapInArrow(run, schema)
    right = kept.select(F.col("doc_id").alias(f"{name}_id"), F.col("sid").alias(f"{name}_sid"))
    out = rows.join(right, rows[key].cast("long").eqNullSafe(F.col(f"{name}_id")) & rows[name].eqNullSafe(F.col(f"{name}_sid")), "left_semi")
    # Rows that share the kept row's id and set: one of them stays.
    again = found.groupBy("doc_id", "sid").count().where("sid is not null and count > 1").select("doc_id", "sid").join(kept, ["doc_id", "sid"], "left_semi")
    if not again.isEmpty():
        order = Window.partitionBy(key, name).orderBy(F.xxhash64(*(F.to_json(F.struct(c)) for c in df.columns)))
        out = out.withColumn(copy, F.row_number().over(order)).where(F.col(copy).eqNullSafe(1) | F.col(name).isNull())
    return out.select(*df.columns)


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    while any(c.lower() == name.lower() for c in df.columns):
        name = f"_{name}"
    return name
