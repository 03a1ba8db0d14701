"""Removal of long repeated word sequences, found by recompression.

Every window of ``size`` consecutive words whose sequence also starts earlier (a smaller doc_id, or the same document and
an earlier start) is removed, that is each word that such a window covers. Windows are judged on the input.

Recompression names a document's words in rounds: runs of one symbol and then pairs of a left and a right symbol become
new symbols, whose names are hashes of what they stand for and whose sides are bits of their names; so all workers name
alike and equal substrings get equal symbols in their interior. For every boundary between symbols the words are kept
track of that its surviving all rounds depends on. If these lie within a window, the boundary is an interior one: it
stands at the same place in every copy of the window, with the same symbols around it. A window is known by the interior
boundary whose surroundings have the least hash (windows without one, such as those within a long run, by their own).

1. Each block of documents lists its windows' boundaries once; those found twice or more among all blocks go back.
2. Each block lists its windows at these, with 96-bit names and the first place; names that are elsewhere earlier go back.
3. Each block removes what is covered by these windows and by those that it has earlier itself.

Blocks are dealt by a hash of the id, and a block lists a window once however often it holds it: no key has more rows
than there are blocks, and no document's copies meet in one task.

Cases: null or empty text and texts shorter than a window lose nothing; a null id ranks after all others; rows that share
an id count as one document's, so of two windows at the same place neither is earlier; extra columns are not read by
``find`` and pass through ``remove``, whatever their names; a very long text is a block of its own, of which about 200 bytes
a word are held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tokens, as_bytes, block_count, block_of, covered, give_back, mix, pair_hash, signed, unsigned, window_hash

SIZE = 20
ROUNDS = 2
_FAR = np.int64(1) << np.int64(40)
_NONE = np.uint64(2**64 - 1)


class Symbols:
    """The symbols over a run of texts' words: where each begins, its name, and what words the boundary before it depends on."""

    def __init__(self, tokens: Tokens):
        n = len(tokens.hashes)
        self.total = n
        self.name = mix(tokens.hashes, 11)
        self.start = np.arange(n, dtype=np.int64)
        self.low, self.high = self.start.copy(), self.start.copy()
        self.fixed = np.zeros(n, bool)  # the first symbols of texts: these boundaries stay, but say nothing about the words
        self.fixed[tokens.starts[tokens.counts > 0]] = True
        self.beyond = n  # what the end of the last text depends on: as with the first symbols of texts, nothing before the first round

    def merge(self, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins symbols j - 1 and j where joined[j]; returns the first symbol and the size of each new one."""
        end = np.append(self.start[1:], self.total)
        before, after = np.roll(self.low, 1), np.append(self.high[1:], self.beyond)
        low = np.minimum(self.low, np.minimum(before, np.roll(self.start, 1)))
        high = np.maximum(self.high, np.maximum(after, end))
        low[self.fixed], high[self.fixed] = -_FAR, self.total + _FAR
        self.beyond = self.total + _FAR
        first = np.flatnonzero(~joined)
        self.start, self.low, self.high, self.fixed = self.start[first], low[first], high[first], self.fixed[first]
        return first, np.diff(np.append(first, len(joined)))

    def name_runs(self, level: int) -> None:
        same = np.zeros(len(self.name), bool)
        same[1:] = (self.name[1:] == self.name[:-1]) & ~self.fixed[1:]
        name = self.name
        first, size = self.merge(same)
        self.name = np.where(size > 1, pair_hash(name[first], size.astype(np.uint64), 40 + level), name[first])

    def name_pairs(self, level: int) -> None:
        right = mix(self.name, 60 + level) >> np.uint64(63) == 1
        pair = np.zeros(len(self.name), bool)
        pair[1:] = ~right[:-1] & right[1:] & ~self.fixed[1:]
        name = self.name
        first, size = self.merge(pair)
        self.name = np.where(size > 1, pair_hash(name[first], name[np.minimum(first + 1, len(name) - 1)], 80 + level), name[first])


def anchors(tokens: Tokens, size: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the windows that lie in one text, by their first words; the name of what each is known by; names met at two places)."""
    words = np.flatnonzero(tokens.whole(size))
    if not len(words):
        return words, np.empty(0, np.uint64), np.empty(0, np.uint64)
    symbols = Symbols(tokens)
    for level in range(rounds):
        symbols.name_runs(level)
        symbols.name_pairs(level)
    inner = np.flatnonzero((symbols.low >= 0) & (symbols.high - symbols.low <= size) & (symbols.high <= symbols.total) & (symbols.start > 0))
    low, high, at = symbols.low[inner], symbols.high[inner], symbols.start[inner]
    # What a boundary is known by: the symbols on either side and the words its being one depends on.
    ahead = window_hash(tokens.hashes, 4)
    key = pair_hash(symbols.name[inner - 1], symbols.name[inner], 100)
    key = pair_hash(key, ahead[np.minimum(low, len(ahead) - 1)], 102)
    key = pair_hash(key, ahead[np.clip(high - 4, 0, len(ahead) - 1)], 104)
    key = pair_hash(key, ((at - low) << 20 | (high - at)).astype(np.uint64), 106)
    least = np.full(len(tokens.hashes) + 1, _NONE)
    for k in range(size + 1):  # windows from high - size to low hold the boundary's words
        begin = high - size + k
        ok = (begin <= low) & (begin >= 0)
        if not ok.any():
            break
        i = begin[ok]  # a later boundary has a later end, so no place twice
        least[i] = np.minimum(least[i], key[ok])
    names = least[words]
    bare = names == _NONE
    found = np.sort(key)
    twice = found[1:][found[1:] == found[:-1]]
    if bare.any():
        own = np.empty(len(tokens.hashes), np.uint64)
        whole = window_hash(tokens.hashes, size, 200)
        own[: len(whole)] = whole
        names[bare] = own[words[bare]]
        left = np.sort(names[bare])
        twice = np.concatenate([twice, left[1:][left[1:] == left[:-1]]])
    return words, names, np.unique(twice)


def _isin(x: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(x), bool)
    return ranked[np.minimum(np.searchsorted(ranked, x), len(ranked) - 1)] == x


def _ids(table: pa.Table, key: str) -> np.ndarray:
    """The ids; null ranks last."""
    return table.column(key).fill_null(np.iinfo(np.int64).max).to_numpy()


def _place(ids: np.ndarray, tokens: Tokens, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = tokens.text[words]
    return ids[text], words - tokens.starts[text]


def _window_names(tokens: Tokens, size: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for the windows at these words."""
    one = signed(window_hash(tokens.hashes, size, 300))[words]
    two = (window_hash(tokens.hashes, size, 400) >> np.uint64(32)).astype(np.uint32).view(np.int32)[words]
    return one, two


def _ranked(one: np.ndarray, two: np.ndarray, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order by name and then place, whether each there is its name's first)."""
    order = np.argsort(one, kind="stable")
    one = one[order]
    same = np.flatnonzero(one[1:] == one[:-1])
    if len(same):  # few names come twice: only these are put in order of their places
        group = np.zeros(len(one), bool)
        group[same] = group[same + 1] = True
        some = np.flatnonzero(group)
        mine = order[some]
        order[some] = mine[np.lexsort((at[mine], ids[mine], two[mine], one[some]))]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[order][1:] != two[order][:-1])
    return order, new


def _first_places(one: np.ndarray, two: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    order, new = _ranked(one, two, ids, at)
    return order[new]


def _after_first(one: np.ndarray, two: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which windows have the name of another that starts earlier."""
    order, new = _ranked(one, two, ids, at)
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(one), bool)
    later[order] = (ids[order] != ids[first]) | (at[order] != at[first])
    return later


_PLACES = pa.schema([("block", pa.int32()), ("id", pa.int64()), ("at", pa.int32()), ("name1", pa.int64()), ("name2", pa.int32())])
_RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed_spans", T.ArrayType(T.LongType()))]


def find(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, block_bytes: int = 8 << 20) -> DataFrame:
    """Of each row: id and text; rest (a struct of all its columns but the text); n_words; n_removed; kept_text (kept words
    joined by one space); removed_spans (first word, end, first word, ...). ``key`` is an integer column.
    """
    if size < 12:
        raise ValueError("recompression needs windows of 12 words or more")
    blocks = block_count(df, block_bytes)
    rest = [df[c] for c in df.columns if c != text]
    docs = df.select(df[key].cast("long").alias("id"), df[text].alias("text"), F.struct(*rest).alias("rest"))
    # An id may hold many rows: they are dealt by their length too.
    docs = docs.select(block_of(F.struct("id", F.length("text")), blocks).alias("block"), "id", "text", "rest")

    def list_names(table: pa.Table) -> pa.Table:
        give_back()
        block = table.column("block")[0].as_py()
        tokens = Tokens(as_bytes(table.column("text")))
        _, names, twice = anchors(tokens, size)
        names = np.unique(names)
        return pa.table({"name": signed(names), "block": np.full(len(names), block, np.int32), "twice": _isin(names, twice)})

    def list_places(table: pa.Table, wanted: pa.Table) -> pa.Table:
        give_back()
        block, words, tokens = 0, np.empty(0, np.int64), None
        if table.num_rows and wanted.num_rows:
            block = table.column("block")[0].as_py()
            tokens = Tokens(as_bytes(table.column("text")))
            words, names, _ = anchors(tokens, size)
            words = words[_isin(names, np.sort(unsigned(wanted.column("name").to_numpy())))]
        if not len(words):
            return _PLACES.empty_table()
        one, two = _window_names(tokens, size, words)
        ids, at = _place(_ids(table, "id"), tokens, words)
        first = np.sort(_first_places(one, two, ids, at))  # by place: neighbouring rows share their ids, which packs well
        return pa.table([np.full(len(first), block, np.int32), ids[first], at[first].astype(np.int32), one[first], two[first]], schema=_PLACES)

    def remove_words(table: pa.Table, earlier: pa.Table) -> pa.Table:
        give_back()
        texts = as_bytes(table.column("text"))
        tokens = Tokens(texts)
        gone = np.zeros(len(tokens.hashes), bool)
        words = np.flatnonzero(tokens.whole(size))
        if len(words):
            one, two = _window_names(tokens, size, words)
            # Later than another of this block, or known to be elsewhere earlier than the block's first.
            ids, at = _place(_ids(table, "id"), tokens, words)
            later = _after_first(one, two, ids, at)
            if earlier.num_rows:
                there = np.rec.fromarrays([earlier.column("name1").to_numpy(), earlier.column("name2").to_numpy()], names="one,two")
                maybe = np.flatnonzero(_isin(one, np.sort(there.one)))
                known = set(there.tolist())
                later[maybe[[x in known for x in zip(one[maybe].tolist(), two[maybe].tolist())]]] = True
            gone = covered(len(gone), words[later], size)
        kept, spans = [], []
        for text, a, b in zip(texts, tokens.starts.tolist(), tokens.ends.tolist()):
            out, row = gone[a:b], text.split()
            edges = np.empty(0, np.int64)
            if out.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                row = [w for w, x in zip(row, out.tolist()) if not x]
            spans.append(edges)
            kept.append(b" ".join(row))
        lost = np.bincount(tokens.text[gone], minlength=len(texts))
        return pa.table({"id": table.column("id"), "text": table.column("text"), "rest": table.column("rest"), "n_words": tokens.counts, "n_removed": lost, "kept_text": pa.array(kept, pa.binary()).cast(pa.string()), "removed_spans": pa.array(spans, pa.list_(pa.int64()))})

    names = docs.groupBy("block").applyInArrow(list_names, "name long, block int, twice boolean")
    of_name = Window.partitionBy("name")
    wanted = names.select("block", "name", (F.count("*").over(of_name) + F.max(F.col("twice").cast("int")).over(of_name)).alias("n")).where("n > 1").select("block", "name")
    places = docs.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(list_places, "block int, id long, at int, name1 long, name2 int")
    least = F.min(F.struct("id", "at")).over(Window.partitionBy("name1", "name2"))
    earlier = places.select("block", "name1", "name2", "id", "at", least.alias("least")).where(F.col("least") < F.struct("id", "at")).select("block", "name1", "name2")
    schema = T.StructType([*docs.schema.fields[1:], *_RESULT])
    return docs.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(remove_words, schema)


def remove(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows with all their columns and what is left of their texts: unchanged where nothing was removed, else the kept
    words joined by one space. A row that loses all its words goes."""
    left = find(df, key, text, size).where("n_removed < n_words or n_words = 0")
    return left.select(*(F.expr("if(n_removed > 0, kept_text, text)").alias(c) if c == text else F.col("rest").getField(c).alias(c) for c in df.columns))
