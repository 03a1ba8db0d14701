"""Quality rules by compression bands.

A text is compressed whole and in fixed chunks with zstandard. Text that repeats itself, lists and markup compress too
well, random or encoded text hardly at all; how well ordinary text compresses depends on its length, and so do the limits.
They are interpolated over the logarithm of the length between the points of a ``Bands``, and beyond its first and last
point are those of that point. ``fit`` finds them from all texts that are labelled as good: at each power of two the
ratios of such texts of about that size lie on a line, and the limits are so far from it that few of them are outside.
Lines come from sums and quantiles from counts in ever narrower ranges, so no ratios meet on one machine. Where no good texts of a size are labelled, the limits of ``Bands`` hold: the lower ones lie between
base64 and the least ratios of prose; random letters are found from 8 KiB on, hex digits (ratio 1.9) aren't told from prose.

Cases: null or empty text has no words, fails the base rules and gets ratio 0. Repeated rows get equal results; a text of
any length is held as bytes and compressed whole and chunk by chunk; null ids and extra columns pass through ``keep``,
whatever their names. Null labels and labels of ids that no text has are not fitted to; without any, ``fit`` gives back
the bands that it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, as_bytes, covered, discard, pair_hash, slices, window_hash, written

SYMBOLS = b"#*$%&|<>"
_NOT_WORD_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))


@dataclass(frozen=True)
class Bands:
    """Limits of raw size / compressed size."""

    level: int = 3
    #: (bytes, lowest ratio, highest ratio) of whole texts.
    whole: tuple = ((64, 0.80, 1.70), (128, 0.95, 1.85), (256, 1.12, 2.00), (512, 1.27, 2.20), (1024, 1.42, 2.35), (2048, 1.50, 2.55), (4096, 1.50, 2.70), (8192, 1.70, 2.80), (16384, 1.75, 2.90), (32768, 1.75, 3.00))
    chunk_bytes: int = 4096
    #: A last chunk shorter than this belongs to the one before it.
    least_chunk: int = 512
    #: Lowest and highest ratio of one chunk; a last one of another size has the whole texts' limits for it, moved by what
    #: these differ from the limits of whole texts as long as a chunk.
    chunk: tuple = (1.50, 3.20)
    #: Largest share of the chunks' bytes out of the chunk band.
    bad_chunks: float = 0.25
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass(frozen=True)
class Fit:
    #: Shares of the labelled texts that may lie below and above the limits of whole texts, or have a chunk below and above those of chunks.
    whole: tuple = (0.002, 0.004)
    chunk: tuple = (0.002, 0.004)
    #: Ratios by which the limits are then widened.
    margin: float = 0.01
    #: Fewer texts or chunks of a size give no limits of their own.
    least: int = 40


MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("ratio", T.DoubleType()), ("n_chunks", T.LongType()), ("n_bad_chunks", T.LongType())]


def parts(text: bytes, bands: Bands) -> list[bytes]:
    """The chunks of a text that has a full one; others have none."""
    cuts = list(range(0, len(text), bands.chunk_bytes)) if len(text) >= bands.chunk_bytes else []
    if len(cuts) > 1 and len(text) - cuts[-1] < bands.least_chunk:
        cuts.pop()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def measure(texts: list[bytes], bands: Bands) -> dict[str, np.ndarray]:
    tokens = Tokens(texts)
    n = len(texts)
    repeat = np.zeros(n, np.int64)
    inside = np.flatnonzero(tokens.whole(3))
    if len(inside):
        keys = pair_hash(window_hash(tokens.hashes, 3)[inside], tokens.text[inside].astype(np.uint64))
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        if twice.any():
            words = covered(len(tokens.hashes), inside[twice], 3)
            repeat = np.bincount(tokens.text[words], minlength=n)
    chars, symbols, dups = (np.zeros(n, np.int64) for _ in range(3))
    ratio, chunks, bad = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    press = zstandard.ZstdCompressor(level=bands.level).compress
    at, lowest, highest = (np.array(x, float) for x in zip(*bands.whole))
    limits = lambda size: [np.interp(np.log2(size), np.log2(at), x) for x in (lowest, highest)]
    moved = np.array(bands.chunk) - limits(bands.chunk_bytes)
    in_chunk: dict[int, np.ndarray] = {}
    bad_bytes, chunk_bytes = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        if not text:
            continue
        chars[i] = len(text.translate(None, _NOT_WORD_CHARS))
        symbols[i] = len(text) - len(text.translate(None, SYMBOLS))
        lines = [x for x in text.split(b"\n") if x.strip()]
        dups[i] = len(lines) - len(set(lines))
        ratio[i] = len(text) / len(press(text))
        for part in parts(text, bands):
            if len(part) not in in_chunk:
                in_chunk[len(part)] = limits(len(part)) + moved
            low, high = in_chunk[len(part)]
            wrong = not low <= len(part) / len(press(part)) <= high
            chunks[i] += 1
            bad[i] += wrong
            chunk_bytes[i] += len(part)
            bad_bytes[i] += wrong * len(part)
    size = np.fromiter(map(len, texts), np.int64, n)
    least, most = limits(np.maximum(size, 1))
    fits = (ratio >= least) & (ratio <= most) & (bad_bytes <= bands.bad_chunks * chunk_bytes)
    failed = (tokens.counts < bands.min_words) | (100 * repeat > bands.max_repeat_percent * tokens.counts)
    return {"n_words": tokens.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & fits, "ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad}


#: The ranges that each step of ``_quantiles`` counts, and the steps: values are told apart down to their span / 2^36.
_RANGES, _STEPS = 1 << 12, 3


def _quantiles(values: DataFrame, shares: tuple) -> dict[int, list[float]]:
    """For each k of ``values`` (k int, v double) the values that these shares of its rows lie below, from all rows.

    A step counts the rows in equal ranges and goes on in the one that holds the row asked for, so at most ``_RANGES`` counts
    for each k and share come to the driver, however many rows there are.
    """
    spans = {r["k"]: (r["low"], r["high"], r["n"]) for r in values.groupBy("k").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n")).collect()}
    if not spans:
        return {}
    #: By k and share: the range, and the place of the row in it.
    at = {(k, i): (low, high, round(share * (n - 1))) for k, (low, high, n) in spans.items() for i, share in enumerate(shares)}
    schema = "k int, i int, low double, high double"
    for _ in range(_STEPS):
        ranges = values.sparkSession.createDataFrame([(k, i, low, high) for (k, i), (low, high, _) in at.items()], schema)
        inside = values.join(F.broadcast(ranges), "k").where("v >= low and v <= high")
        place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _RANGES), F.lit(_RANGES - 1))).otherwise(F.lit(0))
        found: dict = {}
        for r in inside.groupBy("k", "i", place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
            found.setdefault((r["k"], r["i"]), []).append((r["place"], r["n"], r["low"], r["high"]))
        for key, rows in found.items():
            left = at[key][2]
            for _, n, low, high in sorted(rows):
                if left < n:
                    at[key] = (low, high, left)
                    break
                left -= n
    return {k: [at[k, i][0] for i in range(len(shares))] for k in spans}


def limits_of(found: DataFrame, bands: Bands, options: Fit) -> Bands:
    """``bands`` with the limits that fit good texts; ``found``: (size long, ratio, least, most double) of each, the last two of
    its full chunks' ratios, null where it has none."""
    points = {b: (low, high) for b, low, high in bands.whole}
    x = F.log2(F.greatest("size", F.lit(1)).cast("double"))
    near = found.withColumn("k", F.explode(F.sequence(F.ceil(x - 1), F.floor(x + 1)))).where("k >= 6").select(F.col("k").cast("int").alias("k"), (x - F.col("k")).alias("x"), F.col("ratio").alias("y"))
    lines = {}
    for r in near.groupBy("k").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx")).collect():
        if r["n"] >= options.least:
            slope = r["xy"] / r["xx"] if r["xx"] > 0 else 0.0
            lines[r["k"]] = (slope, r["y"] - slope * r["x"])
    if lines:
        table = found.sparkSession.createDataFrame([(k, *line) for k, line in lines.items()], "k int, slope double, base double")
        off = _quantiles(near.join(F.broadcast(table), "k").select("k", (F.col("y") - F.col("slope") * F.col("x") - F.col("base")).alias("v")), (options.whole[0], 1 - options.whole[1]))
        # The largest size's power of two is the last that has limits of its own.
        last = found.agg(F.max("size").alias("size")).first()["size"].bit_length() - 1
        points |= {1 << k: (lines[k][1] + low - options.margin, lines[k][1] + high + options.margin) for k, (low, high) in off.items() if k <= last}
    chunk, chunks = bands.chunk, found.where("least is not null")
    if chunks.count() >= options.least:
        ends = chunks.select(F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("least").alias("v")), F.struct(F.lit(1).alias("k"), F.col("most").alias("v")))).alias("r")).select("r.k", "r.v")
        both = _quantiles(ends, (options.chunk[0], 1 - options.chunk[1]))
        chunk = (both[0][0] - options.margin, both[1][1] + options.margin)
    return replace(bands, whole=tuple((b, *points[b]) for b in sorted(points)), chunk=chunk)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", good: Column | None = None, bands: Bands = Bands(), options: Fit = Fit()) -> Bands:
    """``bands`` with the limits that fit all texts of ``docs`` whose ``labels`` are ``good`` (by default: quality = 1)."""
    good = F.col("quality") == 1 if good is None else good
    named = labels.where(good & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct()
    made = pa.schema([("id", pa.int64()), ("size", pa.int64()), *((c, pa.float64()) for c in ("ratio", "least", "most"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=bands.level).compress
        for part in slices(batches, text):
            texts = as_bytes(part.column(text))
            found = measure(texts, bands)
            at = np.flatnonzero(~found["base_failed"])
            chunks = [[len(c) / len(press(c)) for c in parts(texts[i], bands) if len(c) == bands.chunk_bytes] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), pa.array([len(texts[i]) for i in at.tolist()], pa.int64()), pa.array(found["ratio"][at]), pa.array([min(c, default=None) for c in chunks], pa.float64()), pa.array([max(c, default=None) for c in chunks], pa.float64())], schema=made)

    # All texts are measured, so that only numbers and not texts are exchanged for the labels.
    texts = docs.select(F.col(key).cast("long").alias("id"), text).where("id is not null")
    found = written(texts.mapInArrow(run, "id long, size long, ratio double, least double, most double").join(named, "id", "left_semi").drop("id"))
    out = limits_of(found, bands, options)
    discard(found)
    return out


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The key and the measures and verdict of each row, in one pass without a shuffle."""
    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            found = measure(as_bytes(part.column(text)), bands)
            yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(found[n]) for n, _ in MEASURES)], [key, *(n for n, _ in MEASURES)])

    return df.select(key, text).mapInArrow(run, schema)


def keep(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows whose text passes, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            yield part.filter(pa.array(measure(as_bytes(part.column(text)), bands)["kept"]))

    return df.mapInArrow(run, df.schema)
