"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in blocks (by a hash). How many rows of block p go to shard s is drawn first: given the block sizes and the shard
sizes, a uniform random permutation has exactly the multivariate hypergeometric law for these counts, drawn block after
block from what the shards have left. The matrix has blocks x shards numbers, whatever the number of rows. Then each block
is permuted (a row's rank by a hash decides its shard by the block's row of the matrix), the rows are exchanged, and each
shard is permuted again, which gives gapless slots. Shard sizes differ by one row at most.

Ranks in a block or shard come from two levels, counts of hash ranges and row numbers in a range, so a task sorts ranges of
about ``range_rows`` rows and never a whole shard. All of it is DataFrame operations; the driver draws the matrix.

A row's hashes come from its values and its position in the input (written once to the shared folder, so that a lost
executor changes nothing): equal rows, also a third of all, spread evenly. Cases: nulls are values like others; repeated
rows get a slot each; an empty table gives an empty result; a column that already has the name of a result is replaced;
a very long text is carried as it is, and once more in each of the two exchanges.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCKS = 64


def _rest(n: int) -> float:
    """What Stirling's formula leaves of log n!."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n / n) / n / n) / n / n) / n


def _off(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x, without loss of digits where x is near the mean."""
    t = (x - mean) / mean
    if abs(t) < 0.1:
        return mean * sum((-t) ** k / (k * (k - 1)) for k in range(2, 20))
    return (x * math.log(x / mean) if x else 0.0) + mean - x


def _binomial(x: int, n: int, p: float) -> float:
    """The probability of x of n, by Stirling's formula and its rest: exact to some digits for any n."""
    if x in (0, n):
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p))) if n else 1.0
    log = _rest(n) - _rest(x) - _rest(n - x) - _off(x, n * p) - _off(n - x, n * (1 - p))
    return math.exp(log) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def probability(x: int, good: int, bad: int, draws: int) -> float:
    """That x of the draws are among the good ones, for numbers of any size."""
    if draws in (0, good + bad):
        return 1.0
    p = draws / (good + bad)
    return _binomial(x, good, p) * _binomial(draws - x, bad, p) / _binomial(draws, good + bad, p)


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items taken without replacement are among the ``good`` ones: inversion, outward from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    top = probability(mode, good, bad, draws)
    while True:  # again only where rounding left a last sliver
        left = rng.random() - top
        if left < 0:
            return mode
        down, up, k, j = top, top, mode, mode
        while k > low or j < high:
            if j < high:
                up *= (good - j) * (draws - j) / ((j + 1) * (bad - draws + j + 1))
                j += 1
                left -= up
                if left < 0:
                    return j
            if k > low:
                down *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
                k -= 1
                left -= down
                if left < 0:
                    return k
            if up + down < 1e-300:
                break


def matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard, for blocks of the given sizes."""
    rng = random.Random(seed)
    least, more = divmod(sum(rows), shards)
    left = [least] * shards
    for s in rng.sample(range(shards), more):
        left[s] += 1
    out = []
    for n in rows:
        rest, line = sum(left), []
        for s in range(shards):
            rest -= left[s]
            taken = hypergeometric(rng, left[s], rest, n)
            line.append(taken)
            n -= taken
        left = [a - b for a, b in zip(left, line)]
        out.append(line)
    return out


def _ranked(df: DataFrame, group: str, by: str, ranges: int, out: str) -> DataFrame:
    """The rank from 0 of each row in its group by the hash ``by``: rows in earlier hash ranges, and the place in the range."""
    part, ahead = f"{out}_range", f"{out}_ahead"
    rows = df.withColumn(part, F.shiftright(F.shiftrightunsigned(by, 33) * F.lit(ranges), 31))
    before = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(group, part).agg(F.count("*").alias(ahead)).withColumn(ahead, F.coalesce(F.sum(ahead).over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(group, part).orderBy(F.shiftrightunsigned(by, 1), by))
    return rows.join(offsets, [group, part]).withColumn(out, F.col(ahead) + place - 1).drop(part, ahead)


def shuffle(df: DataFrame, shards: int = 16, seed: int = 0, blocks: int = BLOCKS, range_rows: int = 20_000, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """``df`` with the columns ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in its shard)."""
    values = [c for c in df.columns if c.lower() not in (shard.lower(), slot.lower())]
    packed = df.select(F.struct(*values).alias("row"), F.monotonically_increasing_id().alias("at"))
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "at", "row")
    rows = written(packed.select("row", F.pmod(draw(1), F.lit(blocks)).cast("int").alias("block"), draw(2).alias("first"), draw(3).alias("second")))
    counts = {r["block"]: r["count"] for r in rows.groupBy("block").count().collect()}
    sizes = [counts.get(p, 0) for p in range(blocks)]
    total = sum(sizes)
    limits = []
    for p, line in enumerate(matrix(sizes, shards, seed)):
        edges = [0]
        for n in line:
            edges.append(edges[-1] + n)
        limits.append((p, edges))
    table = df.sparkSession.createDataFrame(limits, "block int, edges array<bigint>")  # blocks x shards numbers
    permuted = _ranked(rows, "block", "first", max(1, total // (blocks * range_rows)), "rank")
    sent = permuted.join(F.broadcast(table), "block").select("row", "second", (F.size(F.filter("edges", lambda e: e <= F.col("rank"))) - 1).alias("to_shard"))
    # Empty shares repeat an edge; the last of equal edges opens the share that has the row.
    again = _ranked(sent, "to_shard", "second", max(1, total // (shards * range_rows)), "to_slot")
    return again.select(*(F.col("row").getField(c).alias(c) for c in values), F.col("to_shard").cast("int").alias(shard), F.col("to_slot").cast("long").alias(slot))


def text_size(text: Column) -> Column:
    """UTF-8 bytes (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned, of the UTF-8 bytes (null: none)."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
