"""Language-model scores of texts by online logistic context mixing.

A text's words, ASCII-lower-cased, joined by one space and closed by an end (a line feed), are coded word by word in binary
decisions. Where the training texts know the two words before, the first decision is whether the word (with what ends it)
is the one expected after them. A word that isn't is a string of bytes, each a path of decisions in a Huffman tree over all
256 bytes. Decisions are predicted under hashed contexts: whether the expected word comes under the two words before, bytes
under the last four bytes and the word so far. A predictor's input is the log odds of how often the training
texts went either way there. The inputs are added with weights; a gate, what is known there and how the last decision of
its sort went, says which set of weights. All sets start from equal weights and move along the gradient after every
``chunk`` decisions of the text, from its first to its last, and so does a table that refines the sum by an offset for each
range of its values.

What is gathered from the corpus are counts of (context, next byte), of words after two words and of words; they grow with
the corpus, without a cap, and are never on one machine. The texts are packed in blocks. Each block lists its distinct
contexts with the counts of its training texts, buckets of contexts add them up, and each block gets what it needs for the
contexts it has. Of the words after two words a block lists that with the least hash, so a frequent context has one entry
for each block; the one expected is that with the least hash of all. The names of contexts have ``spare_bits`` more bits
than the corpus has bytes, so how many contexts share a name doesn't grow with it; an expected word is known by 16 bits.
Words, for the base score, an add-one unigram model, go the same way under 64-bit hashes. Scores don't depend on how texts
are packed.

Cases: null and empty text has the end only; a null id is a training text; repeated rows are scored (and counted) each; an
empty table gives an empty result; without training texts all counts are 0; a very long text is a block of its own, listed
and mixed piece by piece with one state; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, as_bytes, give_back, hash_ranges, mix, plan_bytes, slices, spread, written

SPACE, END = 0x20, 0x0A  # the end is never in a normalised text
PAD = 8  # ends before each piece, so that no context holds another text
ORDERS = (4,)
KINDS = len(ORDERS) + 1
WORD = KINDS - 1  # the kind of the word so far
_KIND = 60  # the first bit of a context's kind in its code; the byte's rank has the last 8


@dataclass(frozen=True)
class Options:
    #: Decisions between two changes of the weights.
    chunk: int = 64
    rate: float = 0.02
    least_rate: float = 0.004
    refine_rate: float = 0.02
    #: The sum of a set's weights at the start; for whether the expected word comes: after none was known, after one that came, after one that didn't.
    first_weights: float = 1.4
    first_expected: tuple = (0.6, 1.1, 0.4)
    #: What either way counts before anything is seen.
    seen: float = 0.05
    #: Bits of a context's name beyond the logarithm of the corpus's bytes.
    spare_bits: int = 3
    block_bytes: int = 4 << 20
    #: Text bytes whose contexts go to one bucket.
    bucket_bytes: int = 4 << 20
    #: Text bytes that are mixed together; a longer text is cut at spaces into pieces of about this size.
    step_bytes: int = 1 << 20


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


_NORMAL = bytes.maketrans(b"\t\n\x0b\x0c\r" + bytes(range(0x41, 0x5B)), b" " * 5 + bytes(range(0x61, 0x7B)))


def normalised(texts: list[bytes]) -> list[bytes]:
    """The words of each text, ASCII-lower-cased, joined by one space."""
    out = []
    for text in texts:
        text = text.translate(_NORMAL).strip(b" ")
        while b"  " in text:
            text = text.replace(b"  ", b" ")
        out.append(text)
    return out


def byte_counts(data: bytes) -> np.ndarray:
    """How often ``data`` has each byte: pairs are counted."""
    pairs = np.bincount(np.frombuffer(data, np.uint16, len(data) // 2), minlength=1 << 16).reshape(256, 256)
    counts = pairs.sum(axis=0) + pairs.sum(axis=1)
    if len(data) % 2:
        counts[data[-1]] += 1
    return counts


class Alphabet:
    """The Huffman tree of the bytes. A byte's rank is its leaf's place from left to right."""

    def __init__(self, counts: np.ndarray):
        weight = counts + 1 + counts.sum() / 2**20  # keeps paths short
        heap = [(w, s, s) for s, w in enumerate(weight.tolist())]
        heapq.heapify(heap)
        children, node = {}, 256
        while len(heap) > 1:
            (w, _, a), (v, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            children[node] = (a, b)
            heapq.heappush(heap, (w + v, node, node))
            node += 1
        self.rank = np.empty(256, np.uint8)
        paths: list[tuple] = []
        stack: list[tuple] = [(node - 1, ())]
        while stack:
            at, path = stack.pop()
            if at < 256:
                self.rank[at] = len(paths)
                paths.append(path)
            else:
                left, right = children[at]
                stack += [(right, (*path, (at, 1))), (left, (*path, (at, 0)))]
        self.length = np.array([len(p) for p in paths])
        self.offset = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.bits = np.array([bit for p in paths for _, bit in p], np.uint8)
        #: By depth and rank: the node there and which way the path goes.
        self.node = np.full((int(self.length.max()), 256), -1, np.int16)
        self.way = np.zeros(self.node.shape, np.int16)
        for rank, path in enumerate(paths):
            for depth, (at, bit) in enumerate(path):
                self.node[depth, rank], self.way[depth, rank] = at, bit


@dataclass(frozen=True)
class Piece:
    """Words of a text with what ends the last of them, after the two words before."""

    text: int
    before: bytes
    body: bytes


def pieces(texts: list[bytes], most: int) -> list[Piece]:
    """Each normalised text in one piece, or cut after spaces where it is longer than ``most``."""
    out = []
    for k, text in enumerate(texts):
        a = 0
        while True:
            b = len(text) if len(text) - a <= most else text.find(b" ", a + most - 1) + 1 or len(text)
            before = text.rfind(b" ", 0, max(0, text.rfind(b" ", 0, max(0, a - 1)))) + 1
            out.append(Piece(k, text[before:a], text[a:b] if b < len(text) else text[a:] + b"\n"))
            if b == len(text):
                break
            a = b
    return out


_ODD = 0x9E3779B97F4A7C15


_SLICE = 1 << 15  # numbers that are worked on together, so that a processor's cache holds them
_BUT_LAST = np.arange(64, -1, -8, dtype=np.uint64)  # the bits of eight bytes but the last k; a shift by 64 leaves nothing


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] of them), first[1], ..."""
    stop = np.cumsum(size)
    out = np.arange(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
    out += np.repeat((first - (stop - size)).astype(np.int32), size)
    return out


def _strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of these sizes, one after another in ``data``."""
    begin = np.concatenate([[0], np.cumsum(size)])
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(begin), pa.py_buffer(data)])


def _joined(strings: pa.Array, which: np.ndarray) -> np.ndarray:
    """Some of the strings one after another."""
    return np.frombuffer(strings.take(pa.array(which)).buffers()[2] or b"", np.uint8)


class Sequence:
    """Some pieces one after another, each after its pads and the words before: their bytes, words and contexts."""

    def __init__(self, some: list[Piece], rank: np.ndarray, bits: int):
        raw = np.frombuffer(b"".join(b"\n" * PAD + p.before + p.body for p in some) + b"\n" * 8, np.uint8)
        n = len(raw) - 8
        self.bits, self.count = bits, len(some)
        lead = np.fromiter((PAD + len(p.before) for p in some), np.int64, len(some))
        self.whole = lead + np.fromiter((len(p.body) for p in some), np.int64, len(some))
        stop = np.cumsum(self.whole)
        self.not_asked = _ranges(stop - self.whole, lead)  # the places that aren't predicted
        self.rank = np.frombuffer(raw[:n].tobytes().translate(rank.tobytes()), np.uint8)
        edge = np.flatnonzero((raw[:n] == SPACE) | (raw[:n] == END)).astype(np.int32)
        begin = np.concatenate([np.zeros(1, np.int32), edge[:-1] + 1])
        length = edge - begin  # of the words, most of which are pads and have none
        self.eight = np.zeros(n, np.uint64)  # the eight bytes before each place
        self.eight[8:] = np.ndarray((n - 8,), "<u8", raw.data, 0, (1,))
        self.so_far = _ranges(np.zeros(len(edge), np.int32), length + 1)  # how many bytes of its word are before each place
        # Words: each ends with a space or the text's end; one without a byte is an empty text's.
        first, last = np.searchsorted(edge, stop - self.whole + lead), np.searchsorted(edge, stop - 1) + 1
        self.words_of = np.concatenate([[0], np.cumsum(last - first)])  # of each piece the first word
        mine = _ranges(first, last - first)
        self.piece = np.repeat(np.arange(len(some)), last - first)
        self.first, self.size = begin[mine], length[mine] + 1  # of each word, with what ends it
        every = np.zeros(len(edge), np.uint64)
        near = np.flatnonzero(length > 0)
        every[near] = hash_ranges(raw, begin[near], edge[near])
        every = mix(every, 70)
        self.hash = every[mine]
        self.expecting = mix(mix(every[mine - 2]) + every[mine - 1], 71) >> U64(64 - bits)  # the name of the two words before
        self._ended = (self.hash + (raw[edge[mine]] == END)) * U64(_ODD)
        self.ending = (self._ended >> U64(48)).astype(np.uint16)  # the word and what ends it

    def different(self) -> np.ndarray:
        """Some of the words, among them each that is there, with what ends it; few are there twice."""
        place = (self._ended >> U64(44)).astype(np.int64)
        table = np.zeros(1 << 20, np.int32)
        number = np.arange(len(place), dtype=np.int32)
        table[place] = number
        same = table[place]
        return np.flatnonzero((same == number) | (self._ended[same] != self._ended))

    def code(self, kind: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of one kind the code of the (context, byte) at all places or some: the name's first bits, the byte's rank."""
        out = np.empty(len(self.eight) if at is None else len(at), np.uint64)
        for a in range(0, len(out), _SLICE):
            some, x = slice(a, a + _SLICE) if at is None else at[a : a + _SLICE], out[a : a + _SLICE]
            if kind == WORD:  # the last eight of its bytes and, if it is longer, its length
                size = self.so_far[some]
                np.right_shift(self.eight[some], _BUT_LAST.take(np.minimum(size, 8)), out=x)
                long = np.flatnonzero(size > 8)
                x[long] += mix(size[long].astype(np.uint64), 72)
            else:
                np.right_shift(self.eight[some], U64(64 - 8 * ORDERS[kind]), out=x)
            x += U64(kind + 1)
            x *= U64(0xD6E8FEB86659FD93)
            x ^= x >> U64(32)
            x *= U64(0xA0761D6478BD642F)
            x >>= U64(64 - self.bits)
            x <<= U64(8)
            x |= self.rank[some]
        return out


class Block:
    """The normalised texts of a block, the longest first, in pieces and these in groups of a limited size."""

    def __init__(self, texts: list[bytes], learned: np.ndarray, rank: np.ndarray, bits: int, options: Options):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.order = np.argsort(-self.size, kind="stable")
        cut = pieces([texts[i] for i in self.order.tolist()], options.step_bytes)
        run = np.cumsum([len(p.body) for p in cut]) // (2 * options.block_bytes)
        self.groups = [[cut[i] for i in mine.tolist()] for mine in np.split(np.arange(len(cut)), np.flatnonzero(np.diff(run)) + 1)]
        self.learned = [learned[self.order[[p.text for p in mine]]] for mine in self.groups]
        self._make = lambda mine: Sequence(mine, rank, bits)
        self._only = self._make(self.groups[0]) if len(self.groups) == 1 else None

    def sequences(self) -> Iterator[Sequence]:
        for mine in self.groups:
            yield self._only or self._make(mine)


@dataclass
class Listed:
    """What some texts have of each sort, sorted and distinct, and how often those that are learned from have it."""

    codes: list[np.ndarray]  # by kind
    times: list[np.ndarray]
    names: np.ndarray  # of two words
    expected: np.ndarray  # the least of the words after them, how often it comes, how often any
    came: np.ndarray
    every: np.ndarray
    words: np.ndarray
    word_times: np.ndarray


def _runs(ranked: np.ndarray, below: int = 0) -> np.ndarray:
    """Where numbers begin that aren't as the one before them, their last ``below`` bits aside."""
    new = np.ones(len(ranked), bool)
    for a in range(1, len(ranked), _SLICE):
        some, last = ranked[a : a + _SLICE], ranked[a - 1 : a - 1 + _SLICE]
        np.not_equal(some, last[: len(some)], out=new[a : a + _SLICE]) if not below else np.greater_equal(some ^ last[: len(some)], U64(1 << below), out=new[a : a + _SLICE])
    return np.flatnonzero(new)


def _sorted(numbers: np.ndarray) -> np.ndarray:
    """The distinct numbers, sorted."""
    ranked = np.sort(numbers)
    return ranked[_runs(ranked)]


def _summed(ranked: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = _runs(ranked)
    return ranked[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)


def _distinct(numbers: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, and the sums of their times."""
    return _placed(numbers, times)[:2]


def _placed(numbers: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct numbers, sorted, the sums of their times, and for each list where its numbers are."""
    every, n = np.concatenate(numbers), np.concatenate(times)
    order = np.argsort(every)
    ranked = every[order]
    return *_summed(ranked, n[order]), _places(ranked, order, numbers)


def _places(ranked: np.ndarray, order: np.ndarray, lists: list[np.ndarray], below: int = 0) -> list[np.ndarray]:
    """For each list which of the distinct numbers its numbers are; ``order`` sorts all lists' numbers to ``ranked``."""
    new = np.zeros(len(ranked), np.int32)
    new[_runs(ranked, below)[1:]] = 1
    at = np.empty(len(ranked), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32)
    return np.split(at, np.cumsum([len(x) for x in lists])[:-1])


def _expected(names: np.ndarray, expected: np.ndarray, came: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same with a row for each name: the least of the words that come after it, how often it comes, how often any."""
    return _expected_of([names], expected, came, every)[0]


def _expected_of(lists: list[np.ndarray], expected: np.ndarray, came: np.ndarray, every: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """That, and for each list of names where they are."""
    names = np.concatenate(lists)
    ranked = names << U64(17) | (every == 0).astype(np.uint64) << U64(16) | expected.astype(np.uint64)
    order = np.argsort(ranked)
    ranked, came, every = ranked[order], came[order], every[order]
    expected, first = ranked.astype(np.uint16), _runs(ranked, 17)
    if not len(first):
        return (names, expected, came, every), lists
    least = expected[first]
    same = expected == np.repeat(least, np.diff(first, append=len(ranked)))
    return (ranked[first] >> U64(17), least, np.add.reduceat(np.where(same, came, 0), first), np.add.reduceat(every, first)), _places(ranked, order, lists, 17)


def listed(block: Block, counted: bool = True) -> Listed:
    """What the block's texts have; those that aren't learned from are counted 0 times. Not ``counted``: bytes and words without counts."""
    found = [_listed(seq, learned, counted) for seq, learned in zip(block.sequences(), block.learned)]
    if len(found) == 1:
        return found[0]
    sums = _distinct if counted else lambda numbers, times: (_sorted(np.concatenate(numbers)), times[0])
    both = [sums([f.codes[k] for f in found], [f.times[k] for f in found]) for k in range(KINDS)]
    words = sums([f.words for f in found], [f.word_times for f in found])
    after = _expected(*(np.concatenate([getattr(f, c) for f in found]) for c in ("names", "expected", "came", "every")))
    return Listed([c for c, _ in both], [n for _, n in both], *after, *words)


def _listed(seq: Sequence, learned: np.ndarray, counted: bool) -> Listed:
    other = np.repeat(~learned, seq.whole) if counted else None
    codes, times = [], []
    for kind in range(KINDS):
        if not counted and kind == WORD:  # which equal words share
            some = seq.different()
            code = seq.code(kind, _ranges(seq.first[some], seq.size[some]))
            code.sort()
            codes.append(code[_runs(code)])
            times.append(np.empty(0, np.int64))
            continue
        code = seq.code(kind)
        if counted:  # a code's training texts come first
            code <<= U64(1)
            code |= other
        code[seq.not_asked] = U64(2**64 - 1)
        code.sort()
        code = code[: len(code) - len(seq.not_asked)]
        first = _runs(code)
        if not counted:
            codes.append(code[first])
            times.append(np.empty(0, np.int64))
            continue
        n = np.diff(first, append=len(code))
        once = code[first]
        first = _runs(once, 1)
        once = once[first]
        codes.append(once >> U64(1))
        times.append(np.where(once & U64(1) == 0, n[first], 0))
    mine = learned[seq.piece]
    # Sorted by name, learned first, word: of each name the first is the least word of those that are learned.
    after = seq.expecting << U64(17) | (~mine).astype(np.uint64) << U64(16) | seq.ending
    after.sort()
    first = _runs(after)
    once, n = after[first], np.diff(first, append=len(after))
    first = _runs(once, 17)
    held = once & U64(1 << 16) != 0
    every = np.add.reduceat(np.where(held, 0, n), first)
    names, held = once[first] >> U64(17), held[first]
    came = np.where(held, 0, n[first])
    expected = np.where(held, 0, once[first] & U64(0xFFFF)).astype(np.uint16)
    full = seq.size > 1
    if not counted:
        return Listed(codes, times, names, expected, came, every, _sorted(seq.hash[full]), np.empty(0, np.int64))
    words, n = np.unique(seq.hash[full & mine], return_counts=True)
    others = _sorted(seq.hash[full & ~mine])
    return Listed(codes, times, names, expected, came, every, *_distinct([words, others], [n, np.zeros(len(others), np.int64)]))


def states(right: np.ndarray, every: np.ndarray, seen: float) -> tuple[np.ndarray, np.ndarray]:
    """(how much is known: 0 nothing, 1 once, 2 up to 7 times, 3 more; the log odds of going right, in quarters)."""
    odds = np.clip(np.rint(4 * np.log((right + seen) / (every - right + seen))), -31, 31).astype(np.int16)
    return (every > 0).astype(np.int16) + (every > 1) + (every > 7), odds


def _state_bytes(known: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Two bits for how much is known, six for the log odds plus 32."""
    return np.where(known > 0, known * 64 + 32 + odds, 0).astype(np.uint8)


def log_odds(alphabet: Alphabet, code: np.ndarray, times: np.ndarray, seen: float) -> tuple[np.ndarray, np.ndarray]:
    """(for each sorted code where its path begins; for each decision of the paths, one after another, a state byte with
    the log odds of the path's own way).

    Codes of a context follow each other from the tree's left to its right, so at each depth those that pass one node are a
    run. A context with one code has the same byte along its path.
    """
    rank = (code & U64(255)).astype(np.uint8)
    context = code >> U64(8)
    length = alphabet.length[rank]
    begin = np.cumsum(length) - length
    other = np.concatenate([[True], context[1:] != context[:-1], [True]]) if len(code) else np.ones(1, bool)
    out = np.repeat(_state_bytes(*states(times, times, seen)), length)
    some = np.flatnonzero(~(other[1:] & other[:-1]))
    for depth, (nodes, ways) in enumerate(zip(alphabet.node, alphabet.way)):
        some = some[length[some] > depth]
        if not len(some):
            break
        node, own = nodes[rank[some]], context[some]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (node[1:] != node[:-1])])
        first = np.flatnonzero(new)
        every = np.add.reduceat(times[some], first)
        way = ways[rank[some]]
        right = np.add.reduceat(times[some] * way, first)
        known, odds = (x[np.cumsum(new) - 1] for x in states(right, every, seen))
        out[begin[some] + depth] = _state_bytes(known, odds * (2 * way - 1))
    return begin, out


#: Sets of weights: bytes by what is known of the word so far (nothing, once, more) and whether another word was expected;
#: expected words by what is known (once, up to 7 times, more) and whether the last expected one came.
BYTE_GATES = 6
GATES = BYTE_GATES + 9
RANGES = 25  # of the sum, one wide, for the refinement


class Lookup:
    """A hash table of numbers. What is found is a place in ``order``, which has the places among the numbers (None: as they are)."""

    def __init__(self, numbers: np.ndarray, bits: int = 0):
        """``bits``: of sorted numbers whose first bits are a hash already, how many they have."""
        size = max(4, len(numbers).bit_length())
        self.hashed, self.shift = bits > 0, U64(max(0, bits - size) if bits else 64 - size)
        if self.hashed:
            self.order, self.numbers = None, numbers
            self.start = np.zeros(1 << size, np.int32)
            np.cumsum(np.bincount((numbers >> self.shift).view(np.int64), minlength=len(self.start))[:-1], out=self.start[1:])
            return
        place = (numbers * U64(_ODD) >> self.shift).astype(np.uint32)
        self.order = np.argsort((place & np.uint32(0xFFFF)).astype(np.uint16), kind="stable").astype(np.int32)  # 16 bits at a time: numpy counts these
        if len(numbers) > 1 << 15:
            self.order = self.order[np.argsort((place >> np.uint32(16)).astype(np.uint16)[self.order], kind="stable")]
        self.numbers = numbers[self.order]
        self.start = np.zeros(1 << 64 - int(self.shift), np.int32)
        np.cumsum(np.bincount(place, minlength=len(self.start))[:-1], out=self.start[1:])

    def find(self, numbers: np.ndarray) -> np.ndarray:
        at = self.start[((numbers if self.hashed else numbers * U64(_ODD)) >> self.shift).view(np.int64)]
        todo = np.flatnonzero(self.numbers[at] != numbers)
        while len(todo):
            at[todo] += 1
            todo = todo[self.numbers[at[todo]] != numbers[todo]]
        return at


#: What the last two bits of a decision's last byte say: the way is left, there is none (the row fills a chunk), right.
LEFT, NONE, RIGHT = 0, 1, 2
_TOGETHER = 1 << 15  # decisions whose rows become numbers together, so that a processor's cache holds them


class Mixer:
    """Weights and refinements of texts side by side."""

    def __init__(self, lanes: int, options: Options):
        self.options, self.steps = options, 0
        first = np.full(GATES, options.first_weights / KINDS)
        first[BYTE_GATES:] = np.tile(np.array(options.first_expected), 3)
        #: Of each text the weights of each input, a quarter of each as inputs are in quarters, and the offsets.
        self.state = np.tile(np.concatenate([*[first / 4] * KINDS, np.zeros(RANGES)]), lanes)

    def run(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The cost in bits of each text's next n decisions; ``rows``: of all decisions, text after text, each filled up to
        whole chunks, each input's state bytes (log odds of the way that is taken), then bytes of the way and, above, the gate."""
        o, size, wide = self.options, self.options.chunk, KINDS * GATES + RANGES
        gate = (rows[KINDS] >> 2).reshape(-1, size)
        # Inputs and ways with their signs turned: what is added up is the log odds against the way that is taken.
        numbers = np.empty(rows.shape, np.int8)
        np.multiply((32 - (rows[:KINDS] & 63)).view(np.int8), rows[:KINDS] > 0, out=numbers[:KINDS])
        np.subtract(np.int8(1), (rows[KINDS] & 3).view(np.int8), out=numbers[KINDS])
        numbers = numbers.reshape(-1, size)
        # Chunks in the order in which they are mixed: the first of each text (those with the most decisions first), the second, ...
        order = np.argsort(-n, kind="stable")
        chunks = -(-n // size)
        live = np.searchsorted(-chunks[order], -np.arange(int(chunks.max(initial=0))), "left")
        base = np.concatenate([[0], np.cumsum(live)])
        lane = _ranges(np.zeros(len(live), np.int64), live)
        which = (np.cumsum(chunks) - chunks)[order][lane] + np.repeat(np.arange(len(live)), live)
        ranges = np.repeat(np.arange(int(live.max(initial=0))) * wide + KINDS * GATES - 1, size)
        least, most, above, one = (np.float64(x) for x in (-12, 12, 13, 1))  # above: over 0, where a number is cut to its floor
        rates = np.full(wide, o.refine_rate)
        cost = np.zeros(len(n))
        t = 0
        while t < len(live):
            stop = max(t + 1, int(np.searchsorted(base, base[t] + _TOGETHER // size, "right")) - 1)
            # Of each step all of the first input, all of the second, ..., the ways.
            k, a = live[t:stop], base[t:stop]
            part = np.tile(k, (KINDS + 1, 1)).T.ravel()
            some = _ranges(np.repeat(a, KINDS + 1), part)
            kind = np.repeat(np.tile(np.arange(KINDS + 1), len(k)), part)
            x = numbers[kind * len(gate) + which[some]].ravel().astype(np.float64)
            at = gate[which[some]].astype(np.int64)
            at += (lane[some] * wide + kind * GATES)[:, None]
            at = at.ravel()
            chance = np.empty(int(base[stop] - base[t]) * size)
            done = 0
            for k in k.tolist():
                m = k * size
                xs, places = x[(KINDS + 1) * done : (KINDS + 1) * (done + m)], at[(KINDS + 1) * done : (KINDS + 1) * (done + m)]
                way, refined = xs[KINDS * m :], places[KINDS * m :]
                p = chance[done : done + m]
                terms = self.state.take(places[: KINDS * m])
                terms *= xs[: KINDS * m]
                np.add(terms[:m], terms[m : 2 * m], out=p)
                for kind in range(2, KINDS):
                    p += terms[kind * m : (kind + 1) * m]
                np.minimum(p, most, out=p)
                np.maximum(p, least, out=p)
                own = p * way
                own += above
                np.copyto(refined, own, casting="unsafe")
                refined += ranges[:m]
                own = self.state.take(refined)
                own *= way
                p += own
                np.exp(p, out=p)
                p += one
                np.reciprocal(p, out=p)
                np.subtract(one, p, out=own)
                xs = xs.reshape(KINDS + 1, m)
                xs *= own
                rates[: KINDS * GATES] = max(o.least_rate, o.rate / (1 + self.steps / 16)) / 16
                move = np.bincount(places, xs.ravel(), k * wide).reshape(k, wide)
                move *= rates
                self.state[: k * wide] -= move.ravel()
                self.steps += 1
                done += m
            bits = np.log2(chance, out=chance).reshape(-1, size).sum(axis=1)
            cost -= np.bincount(lane[base[t] : base[stop]], bits, len(n))
            t = stop
        out = np.empty(len(n))
        out[order] = cost
        return out - (chunks * size - n)  # a row that has no way costs one bit


class Model:
    """What the training texts know of all contexts of some texts."""

    def __init__(self, alphabet: Alphabet, found: Listed, odds: list[np.ndarray], expected: np.ndarray, sure: np.ndarray, bits: int, options: Options):
        """``odds``: of each kind the paths' state bytes; ``expected``, ``sure``: of each name of two words the word and its state byte."""
        self.alphabet, self.bits, self.options = alphabet, bits, options
        length, size = alphabet.length, options.chunk
        self.codes, self.names = [Lookup(c) for c in found.codes], Lookup(found.names, bits)
        # After the paths of a kind: 0 to size - 1 rows of 0 that fill chunks, and what is known of an expected word: each byte.
        nothing, single = np.arange(size), np.arange(256)
        self.paths = []
        for lookup, code, x in zip(self.codes, found.codes, odds):
            paths = _strings(np.concatenate([x, np.zeros(int(nothing.sum()), np.uint8), single.astype(np.uint8)]), np.concatenate([length[(code & U64(255)).astype(np.uint8)], nothing, single * 0 + 1]))
            self.paths.append(paths.take(pa.array(np.concatenate([lookup.order, np.arange(len(code), len(paths), dtype=np.int32)]))))
        self.expected, self.sure = expected, sure
        # Last bytes of a byte's path, where no other word was expected and where one was; of what fills chunks; of expected words.
        ways = np.concatenate([alphabet.bits * RIGHT, alphabet.bits * RIGHT + 4 * 3, np.full(int(nothing.sum()), NONE), single])
        self.ways = _strings(ways.astype(np.uint8), np.concatenate([length, length, nothing, single * 0 + 1]))

    def rows(self, seq: Sequence, a: int, b: int, last: int = 0, filled: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
        """For the pieces a to b of ``seq``: (rows of all decisions, as ``Mixer.run`` has them, if they are ``filled`` up to
        whole chunks; decisions of each piece; how the last expected word went).

        ``last``: how the last expected word before the first piece went (0: there is none, 1: it came, 2: another came).
        """
        words = slice(seq.words_of[a], seq.words_of[b])
        at = self.names.find(seq.expecting[words])
        sure, size, piece = self.sure[at], seq.size[words], seq.piece[words] - a
        asked = sure > 0
        came = asked & (self.expected[at] == seq.ending[words])
        # How the last expected word before each word of its text went.
        begins = np.concatenate([[True], piece[1:] != piece[:-1]])
        marks = np.maximum.accumulate(np.where(asked | begins, np.arange(len(came)), 0))
        before = np.concatenate([[0], np.where(asked, np.where(came, 1, 2), 0)[marks[:-1]]])
        before = np.where(begins, 0, before)
        before[: int(np.argmax(asked)) + 1 if asked.any() else None] = last
        # Elements: for each word whether it is the expected one, if one is, then its bytes, if it isn't; for each piece what fills it.
        spelled = np.where(came, 0, size)
        letters = _ranges(seq.first[words], spelled)
        rank = seq.rank[letters]
        ask = np.flatnonzero(asked)
        n = np.bincount(piece, asked, b - a)
        each = np.concatenate([[0], np.cumsum(self.alphabet.length[rank])])
        stop = np.cumsum(spelled)
        n += np.bincount(piece, each[stop] - each[stop - spelled], b - a)
        n = n.astype(np.int64)
        fill = -n % self.options.chunk if filled else n * 0
        shift = np.cumsum(asked) + piece  # of the elements before each word's bytes how many aren't bytes
        where = np.arange(len(letters), dtype=np.int32)
        where += np.repeat(shift.astype(np.int32), spelled)
        where_asked = (stop - spelled + shift)[ask] - 1
        ends = np.flatnonzero(np.append(begins[1:], True))
        where_filled = (stop + shift)[ends]
        own = sure[ask]
        states = [np.where(came[ask], own, (own & 192) + 64 - (own & 63)), *[None] * (KINDS - 1)]
        element = np.empty(len(letters) + len(ask) + b - a, np.int32)
        rows = []
        for kind in range(KINDS):
            some = len(self.codes[kind].order)
            element[where] = self.codes[kind].find(seq.code(kind, letters))
            element[where_asked] = some + (1 if states[kind] is None else states[kind].astype(np.int32) + self.options.chunk)
            element[where_filled] = some + fill
            rows.append(_joined(self.paths[kind], element))
        element[where] = rank
        element[where] += np.repeat((asked * 256).astype(np.int32), spelled)
        element[where_asked] = 512 + self.options.chunk + 4 * (BYTE_GATES + 3 * ((own >> 6).astype(np.int32) - 1) + before[ask]) + RIGHT * came[ask]
        element[where_filled] = 512 + fill
        rows.append(_joined(self.ways, element))
        known = np.minimum(rows[WORD] >> 6, 2)
        known <<= 2
        rows[KINDS] += known
        return np.stack(rows), n, (1 if came[ask[-1]] else 2) if len(ask) else last

    def bits_of(self, block: Block) -> np.ndarray:
        """The negative log2 probability of each text of the block and its end."""
        step, chunk, out = self.options.step_bytes, self.options.chunk, np.zeros(len(block.size))
        text, mixer, last, rest = -1, None, 0, np.empty((KINDS + 1, 0), np.uint8)
        for seq, mine in zip(block.sequences(), block.groups):
            run = ((np.cumsum(seq.whole) - seq.whole) // step).tolist()
            a = 0
            while a < seq.count:
                b = a + 1
                if block.size[block.order[mine[a].text]] > step:  # a long text's pieces, one after another
                    if mine[a].text != text:
                        text, mixer, last = mine[a].text, Mixer(1, self.options), 0
                    rows, _, last = self.rows(seq, a, b, last, filled=False)
                    rows = np.concatenate([rest, rows], axis=1)
                    n = rows.shape[1]
                    if mine[a].body.endswith(b"\n"):
                        fill = np.zeros((KINDS + 1, -n % chunk), np.uint8)
                        fill[KINDS] = NONE
                        rows, rest = np.concatenate([rows, fill], axis=1), rows[:, n:]
                    else:
                        n = n // chunk * chunk  # whole chunks, as if it were one piece
                        rows, rest = np.ascontiguousarray(rows[:, :n]), rows[:, n:]
                    out[block.order[text]] += mixer.run(rows, np.array([n]))[0]
                else:
                    while b < seq.count and run[b] == run[a]:
                        b += 1
                    rows, n, _ = self.rows(seq, a, b)
                    out[block.order[[p.text for p in mine[a:b]]]] = Mixer(b - a, self.options).run(rows, n)
                a = b
        return out


def _press(level: int = 1):
    return zstandard.ZstdCompressor(level=level)


def _squeezed(press, numbers: np.ndarray) -> bytes:
    """64-bit numbers as their differences, all first bytes, all second bytes, ..., compressed."""
    step = np.diff(numbers.view(np.uint64), prepend=U64(0))
    return press.compress(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def _opened(open_, data: bytes) -> np.ndarray:
    planes = np.frombuffer(open_.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """In as few bytes each as the greatest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def _wide(data: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that ``_narrow`` made small."""
    return np.frombuffer(data, f"u{len(data) // n}" if n else np.uint8).astype(np.int64)


def _starts(buckets: int, bits: int) -> np.ndarray:
    """The first number of ``bits`` bits of each bucket."""
    return np.array([(k << bits) // buckets for k in range(buckets)], np.uint64)


class Cuts:
    """Which part of each list of a ``Listed`` each bucket has."""

    def __init__(self, found: Listed, buckets: int, bits: int):
        first = _starts(buckets, bits)
        ends = lambda x, at: np.append(np.searchsorted(x, at), len(x))
        self.codes = [ends(c, first << U64(8)) for c in found.codes]
        self.names, self.words = ends(found.names, first), ends(found.words, _starts(buckets, 64))

    @staticmethod
    def of(cut: np.ndarray, bucket: int) -> slice:
        return slice(int(cut[bucket]), int(cut[bucket + 1]))


def pack(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A written table (block, data, counts) of the rows of ``docs``, about ``block_bytes`` of text in each: their ids,
    whether they are held out and their normalised texts; of the training texts how often they have each byte, their words and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        press, task, number, waiting, size = _press(3), TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, waiting[0].schema) as stream:
                for part in waiting:
                    stream.write_batch(part)
            counts = np.zeros(258, np.int64)
            for part in waiting:
                mine = part.filter(pc.invert(part.column("held"))).column("text")
                texts = as_bytes(mine)
                own = byte_counts(b"\n".join(texts) + b"\n" * (len(texts) > 0))
                counts[:256] += own
                counts[256] += own[SPACE] + sum(map(bool, texts))
                counts[257] += len(texts)
            return pa.RecordBatch.from_pydict({"block": [task << 32 | number], "data": [press.compress(sink.getvalue())], "counts": [counts.tolist()]}, pa.schema([("block", pa.int64()), ("data", pa.binary()), ("counts", pa.list_(pa.int64()))]))

        for part in slices(batches, most=block_bytes):
            texts = pa.array(normalised(as_bytes(part.column("text"))), pa.binary())
            own = pc.sum(pc.binary_length(texts)).as_py() or 0
            if waiting and size + own > block_bytes:
                yield block()
                waiting, size, number = [], 0, number + 1
            waiting.append(pa.RecordBatch.from_arrays([part.column("id"), part.column("held"), texts], ["id", "held", "text"]))
            size += own
        if waiting:
            yield block()

    return written(docs.mapInArrow(run, "block long, data binary, counts array<long>"))


def training_counts(packed: DataFrame) -> np.ndarray:
    """How often the training texts have each byte, their words and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(258, np.int64)
        for batch in batches:
            for row in batch.column("counts"):
                counts += row.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"what": np.arange(258, dtype=np.int32), "n": counts})

    out = np.zeros(258, np.int64)
    for row in packed.select("counts").mapInArrow(run, "what int, n long").groupBy("what").agg(F.sum("n").alias("n")).collect():
        out[row["what"]] = row["n"]
    return out


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


_ROW = ["codes", "times", "names", "expected", "came", "every", "words", "word_times"]


def _listed_rows(packed: DataFrame, alphabet, bits: int, buckets: int, options: Options) -> DataFrame:
    """For each block and bucket what the block has there, as in ``Listed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _press()
        small = lambda x: press.compress(_narrow(x).tobytes())
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data").to_pylist()):
                table = _unpacked(data)
                found = listed(Block(as_bytes(table.column("text")), ~table.column("held").to_numpy(), alphabet.value.rank, bits, options))
                del table, data
                cuts = Cuts(found, buckets, bits)
                for k in range(buckets):
                    mine = [cuts.of(c, k) for c in cuts.codes]
                    n, w = cuts.of(cuts.names, k), cuts.of(cuts.words, k)
                    code = np.concatenate([x[s] | U64(kind << _KIND) for kind, (x, s) in enumerate(zip(found.codes, mine))])
                    if len(code) or n.start < n.stop or w.start < w.stop:
                        row = (_squeezed(press, code), small(np.concatenate([x[s] for x, s in zip(found.times, mine)])), _squeezed(press, found.names[n]), press.compress(found.expected[n].tobytes()), small(found.came[n]), small(found.every[n]), _squeezed(press, found.words[w]), small(found.word_times[w]))
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block]), *(pa.array([x], pa.binary()) for x in row)], ["bucket", "block", *_ROW])
                del found, cuts
                give_back()

    return packed.select("block", "data").mapInArrow(run, "bucket int, block long, " + ", ".join(f"{c} binary" for c in _ROW))


def _answers(rows: DataFrame, alphabet, seen: float) -> DataFrame:
    """For each row of ``_listed_rows`` what all training texts know: the state bytes along its codes' paths, the words
    expected after its two words (by how they differ from the row's) and their state bytes, its words' counts; known: how many words of the bucket training
    texts have, in one of its rows."""

    def add_up(table: pa.Table) -> pa.Table:
        give_back()
        press, open_ = _press(), zstandard.ZstdDecompressor()
        opened = lambda c: [_opened(open_, x) for x in table.column(c).to_pylist()]
        plain = lambda c, t: [np.frombuffer(open_.decompress(x), t) for x in table.column(c).to_pylist()]
        counts = lambda c: [_wide(open_.decompress(x), len(y)) for x, y in zip(table.column(c).to_pylist(), own)]
        own = opened("words")
        _, times, at = _placed(own, counts("word_times"))
        sent = [press.compress(_narrow(times[i]).tobytes()) for i in at]
        known = int(np.count_nonzero(times))
        own = opened("names")
        theirs = plain("expected", np.uint16)
        (_, expected, came, every), at = _expected_of(own, *(np.concatenate(x) for x in (theirs, counts("came"), counts("every"))))
        sure = _state_bytes(*states(came, every, seen))
        after = [press.compress((x ^ expected[i]).tobytes()) for i, x in zip(at, theirs)]
        sures = [press.compress(sure[i].tobytes()) for i in at]
        own = opened("codes")
        every, times, at = _placed(own, counts("times"))
        begin, odds = log_odds(alphabet.value, every, times, seen)
        known_paths = _strings(odds, np.diff(begin, append=len(odds)))
        paths = [press.compress(_joined(known_paths, i)) for i in at]
        binary = [pa.array(x, pa.binary()) for x in (paths, after, sures, sent)]
        return pa.table([table.column("block"), table.column("bucket"), *binary, pa.array([known, *[0] * (len(paths) - 1)])], names=["block", "bucket", "odds", "expected", "sure", "counts", "known"])

    return rows.groupBy("bucket").applyInArrow(add_up, "block long, bucket int, odds binary, expected binary, sure binary, counts binary, known long")


def _block_model(alphabet: Alphabet, found: Listed, answered: pa.Table, bits: int, buckets: int, options: Options) -> tuple[Model, np.ndarray]:
    """The model for a block's texts, and the counts of its words."""
    cuts, open_ = Cuts(found, buckets, bits), zstandard.ZstdDecompressor()
    stops = [np.concatenate([[0], np.cumsum(alphabet.length[(code & U64(255)).astype(np.uint8)])]) for code in found.codes]
    odds = [np.empty(int(s[-1]), np.uint8) for s in stops]
    expected, sure, counts = np.zeros(len(found.names), np.uint16), np.zeros(len(found.names), np.uint8), np.zeros(len(found.words), np.int64)
    for bucket, *row in zip(*(answered.column(c).to_pylist() for c in ("bucket", "odds", "expected", "sure", "counts"))):
        paths, after, sures, times = (np.frombuffer(open_.decompress(x), t) for x, t in zip(row, (np.uint8, np.uint16, np.uint8, np.uint8)))
        at = 0
        for out, cut, stop in zip(odds, cuts.codes, stops):
            a, b = int(stop[cut[bucket]]), int(stop[cut[bucket + 1]])
            out[a:b] = paths[at : at + b - a]
            at += b - a
        if at != len(paths):
            raise RuntimeError("the answers are not those of the block's contexts")
        here = cuts.of(cuts.names, bucket)
        expected[here], sure[here] = after ^ found.expected[here], sures
        here = cuts.of(cuts.words, bucket)
        counts[here] = _wide(times, here.stop - here.start)
    return Model(alphabet, found, odds, expected, sure, bits, options), counts


def base_scores(block: Block, words: Lookup, counts: np.ndarray, ends: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words and end, how many of them are known, add-one score) of each text, with the counts of the words' hashes."""
    size = len(block.size)
    n_words, known, score = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
    for seq, mine in zip(block.sequences(), block.groups):
        full = seq.size > 1
        n = counts[words.find(seq.hash[full])]
        text = block.order[[p.text for p in mine]][seq.piece[full]]
        n_words += np.bincount(text, minlength=size)
        known += np.bincount(text, n > 0, size).astype(np.int64)
        score += np.bincount(text, np.log10((n + 1) / every), size)
    return n_words + 1, known + (ends > 0), score + math.log10((ends + 1) / every)


def score(df: DataFrame, key: str = "doc_id", text: str = "text", held: Column | None = None, options: Options = Options()) -> DataFrame:
    """A row for each text: key, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10 of the probability), bits_per_byte.

    ``held``: which rows are not learned from; by default those whose id's crc32 leaves 2 when divided by 7.
    """
    spark = df.sparkSession
    held = held_out(df[key]) if held is None else held
    docs = spread(df.select(df[key].alias("id"), df[text].alias("text"), F.coalesce(held, F.lit(False)).alias("held")))
    packed = pack(docs, options.block_bytes)
    seen = training_counts(packed)
    ends = int(seen[257])
    n = int(seen[256]) + ends
    alphabet = spark.sparkContext.broadcast(Alphabet(seen[:256]))
    size = max(plan_bytes(df), int(seen[:256].sum()))
    bits = min(44, max(24, size.bit_length() + options.spare_bits))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // options.bucket_bytes)
    answers = written(_answers(_listed_rows(packed, alphabet, bits, buckets, options), alphabet, options.seen))
    v = (answers.agg(F.sum("known").alias("v")).first()["v"] or 0) + (ends > 0)
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(c, t) for c, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType())))])

    def score_texts(table: pa.Table, answered: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        give_back()
        rows = _unpacked(table.column("data")[0].as_py())
        ids, helds, clean = rows.column("id"), rows.column("held"), as_bytes(rows.column("text"))
        del table, rows
        block = Block(clean, ~helds.to_numpy(), alphabet.value.rank, bits, options)
        sizes = block.size
        del clean
        found = listed(block, counted=False)
        model, counts = _block_model(alphabet.value, found, answered, bits, buckets, options)
        base = base_scores(block, Lookup(found.words, 64), counts, ends, n + v + 1)
        del found, answered
        cost = model.bits_of(block)
        n_tokens, hit, base_score = (pa.array(x) for x in base)
        return pa.table([ids, helds, n_tokens, hit, pa.array(np.full(len(sizes), n)), base_score, pa.array(-cost * math.log10(2)), pa.array(cost / sizes)], names=schema.names)

    return packed.select("block", "data").groupBy("block").cogroup(answers.drop("known").groupBy("block")).applyInArrow(score_texts, schema)
