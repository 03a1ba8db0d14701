"""N-best segmentation into the pieces of a SentencePiece model, and decoding.

White space stands at most at the beginning of a piece (a model with other pieces is refused), so a text falls into units
(a run of spaces and what follows up to the next) whose lattices are independent. For the distinct units of a batch, all at once: a walk through
the pieces' trie finds the lattices' edges, forward Viterbi gives the least cost to each position, backward Viterbi that
to the end, and so the least extra cost of a segmentation other than the best. A text's N best differ from its best in
units among the N - 1 of least extra cost; for these, A-star searches the lattice backwards with the forward Viterbi
costs, which are the exact remaining costs, as heuristic, so segmentations come out in order; then sums are merged.

Costs are whole micro-nats, so sums and ties are exact: of the model's own log probabilities, or, where its scores are the
ranks of merges and not probabilities, of a Zipf law over these ranks. A character without a piece costs its byte pieces;
where the model has no probability for these, each costs 10 nats more than the least probable piece. Spaces are pieces' white space mark, and a space goes before a text; the mark's own character in a text
goes as bytes, so decoding gives back every text exactly.

Cases: null and empty texts have no pieces, cost 0 and one segmentation; ties are ordered by the search, alike everywhere;
repeated rows get equal results; null ids and carried columns pass; very long units are searched like others.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, hash_ranges, slices

_MARK = "▁"
_UNSEEN = np.int64(1) << np.int64(60)
_EDIT = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("drop", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
_OTHER = T.StructType([T.StructField("cost", T.LongType()), T.StructField("edits", T.ArrayType(_EDIT))])


def costs(scores: list[float], pieces: int) -> tuple[list[int], int]:
    """(the cost of each piece with these scores, the cost of a byte) in micro-nats, for a model of so many pieces."""
    if all(x <= 0 and x == int(x) for x in scores):  # ranks, the earliest merge first; equal ones as they come
        zipf = lambda rank: round(1e6 * (math.log(rank + 2.7) + math.log(math.log(pieces + 2.7))))
        out = [0] * len(scores)
        for rank, i in enumerate(sorted(range(len(scores)), key=lambda i: -scores[i])):
            out[i] = zipf(rank)
        return out, zipf(pieces)
    return [round(-1e6 * x) for x in scores], round(1e6 * (10 - min(scores)))


class Pieces:
    """The pieces of a model: bytes and cost of each id, and a trie in one hash table."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.cost = np.zeros(n, np.int64)
        self.byte_id = np.zeros(256, np.int32)
        trie, spans = {}, [0]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        cost, byte_cost = costs([model.get_score(i) for i in plain], n)
        self.cost[plain] = cost
        ends = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
                self.cost[i] = byte_cost
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace(_MARK, " ").encode()
            if b" " in self.bytes[i].lstrip(b" "):
                raise ValueError(f"piece {i} has white space inside or at its end")
            node = 0
            for b in self.bytes[i]:
                key = node << 8 | b
                node = trie.setdefault(key, len(spans))
                if node == len(spans):
                    spans.append(0)
            ends.setdefault(node, i)
        self.piece_at = np.full(len(spans), -1, np.int32)
        self.piece_at[list(ends)] = list(ends.values())
        bits = max(10, (4 * len(trie)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next = np.zeros(1 << bits, np.int32)
        mask = (1 << bits) - 1
        slots = self.slot(np.fromiter(trie, np.int64, len(trie))).tolist()
        for slot, (key, node) in zip(slots, trie.items()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & mask
            self.keys[slot], self.next[slot] = key, node
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, n)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The child of each node by a byte; -1: none."""
        keys = nodes.astype(np.int64) << 8 | values
        out = np.full(len(keys), -1, np.int64)
        slot, todo = self.slot(keys), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.next[slot[hit]]
            go = ~hit & (there >= 0)
            todo, slot = todo[go], (slot[go] + 1) & (len(self.keys) - 1)
        return out


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Lattices:
    """The lattices of some units, given as byte ranges of ``data``. Node ``base[u] + k`` is position k of unit u."""

    def __init__(self, model: Pieces, data: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.model = model
        size = last - first
        self.base = np.cumsum(size + 1) - size - 1
        self.end = self.base + size
        total = int(size.sum())
        unit = np.repeat(np.arange(len(size)), size)
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        byte = data[first[unit] + place].astype(np.int64)
        node = self.base[unit] + place
        stop = self.end[unit]
        at_node = np.zeros(int(self.end[-1]) + 1 if len(size) else 0, np.int64)
        at_node[node] = byte
        begins = (byte & 0xC0) != 0x80  # a character's first byte
        width = np.ones(total, np.int64)
        width[byte >= 0xC0], width[byte >= 0xE0], width[byte >= 0xF0] = 2, 3, 4
        found: list[tuple[np.ndarray, int, np.ndarray]] = []  # (start nodes, length, ids): one edge a start in each
        seen = np.zeros(total, bool)  # has a piece of one character
        active, state = np.flatnonzero(begins), np.zeros(int(begins.sum()), np.int64)
        length = 0
        while len(active):
            ok = node[active] + length < stop[active]
            active, state = active[ok], state[ok]
            state = model.step(state, at_node[node[active] + length])
            ok = state >= 0
            active, state = active[ok], state[ok]
            length += 1
            piece = model.piece_at[state]
            hit = np.flatnonzero(piece >= 0)
            place = active[hit]
            found.append((node[place], length, piece[hit]))
            seen[place[width[place] == length]] = True
        # Characters without a piece: their bytes.
        owner = np.maximum.accumulate(np.where(begins, np.arange(total), 0))
        bare = np.flatnonzero(~seen[owner]) if total else np.empty(0, np.int64)
        found.append((node[bare], 1, model.byte_id[byte[bare]]))
        nodes = int(self.end[-1]) + 1 if len(size) else 0
        self.unit_of = np.repeat(np.arange(len(size)), size + 1)
        from_start = np.arange(nodes) - self.base[self.unit_of]
        from_end = self.end[self.unit_of] - np.arange(nodes)
        # Forwards, edges by end; backwards, edges by start. Both are dealt to their places by counting.
        self.a, self.b, self.id = self._dealt(found, nodes, True)
        self.cost = model.cost[self.id]
        self.to_here = self._sweep(self.a, self.b, self.cost, from_start, self.base)
        a, b, id_ = self._dealt(found, nodes, False)
        self.to_end = self._sweep(b, a, model.cost[id_], from_end, self.end)
        self._best()

    @staticmethod
    def _dealt(found: list, nodes: int, by_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, ids) of the edges by end or by start, each node's in the order they were found."""
        count = np.zeros(nodes + 1, np.int64)
        ranks = []
        for start, length, _ in found:
            key = start + length if by_end else start
            ranks.append(count[key])
            count[key] += 1
        place = np.cumsum(count) - count
        total = int(count.sum())
        a, b, id_ = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int32)
        for (start, length, ids), rank in zip(found, ranks):
            at = place[start + length if by_end else start] + rank
            a[at], b[at], id_[at] = start, start + length, ids
        return a, b, id_

    @staticmethod
    def _sweep(source: np.ndarray, target: np.ndarray, cost: np.ndarray, offset: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """The least cost from the origins to each node; edges are sorted by target and taken by their targets' offsets."""
        least = np.full(len(offset), _UNSEEN, np.int64)
        least[origin] = 0
        far = offset[target]
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        far, s, t, c = far[order], source[order], target[order], cost[order]
        cuts = np.flatnonzero(np.concatenate([[True], far[1:] != far[:-1]])) if len(far) else np.empty(0, np.int64)
        for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(far)).tolist()):
            through = least[s[i:j]] + c[i:j]
            new = np.flatnonzero(np.concatenate([[True], t[i + 1 : j] != t[i : j - 1]]))
            least[t[i:j][new]] = np.minimum.reduceat(through, new)
        return least

    def _best(self) -> None:
        """The best path of each unit: ids one after another, with offsets; and the least extra cost of another path."""
        through = self.to_here[self.a] + self.cost + self.to_end[self.b]
        total = self.to_here[self.end]
        extra = through - total[self.unit_of[self.a]] if len(self.a) else through
        # Of the edges into a node that reach its least cost, the first found (shortest) is the path's.
        best = np.flatnonzero(self.to_here[self.a] + self.cost == self.to_here[self.b])[::-1]
        into = np.full(len(self.unit_of), -1, np.int64)
        into[self.b[best]] = best
        units, edges, here = [], [], self.end.copy()
        live = np.flatnonzero(here > self.base)
        on_path = np.zeros(len(self.a), bool)
        while len(live):
            edge = into[here[live]]
            units.append(live)
            edges.append(edge)
            here[live] = self.a[edge]
            live = live[here[live] > self.base[live]]
        if units:
            unit, edge = np.concatenate(units), np.concatenate(edges)
            on_path[edge] = True
            order = np.lexsort((self.a[edge], unit))
            unit, edge = unit[order], edge[order]
        else:
            unit = edge = np.empty(0, np.int64)
        self.path = self.id[edge].astype(np.int32)
        self.path_size = np.bincount(unit, minlength=len(self.end))
        self.path_start = np.cumsum(self.path_size) - self.path_size
        self.total = total
        self.extra = np.full(len(self.end), _UNSEEN, np.int64)
        off = ~on_path
        if off.any():
            np.minimum.at(self.extra, self.unit_of[self.a[off]], extra[off])
        self.edge_cut = np.searchsorted(self.b, np.append(self.base, len(self.unit_of)))

    def best_of(self, unit: int) -> tuple[int, ...]:
        s = int(self.path_start[unit])
        return tuple(self.path[s : s + int(self.path_size[unit])].tolist())

    def nbest(self, unit: int, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n least (extra cost, ids) of a unit, the Viterbi path first: backward A-star."""
        i, j = int(self.edge_cut[unit]), int(self.edge_cut[unit + 1])
        base, end = int(self.base[unit]), int(self.end[unit])
        into: dict[int, list] = {}
        for a, b, id_, cost in zip(self.a[i:j].tolist(), self.b[i:j].tolist(), self.id[i:j].tolist(), self.cost[i:j].tolist()):
            into.setdefault(b, []).append((a, id_, cost))
        ahead = self.to_here[base : end + 1].tolist()
        best = ahead[-1]
        first = self.best_of(unit)
        heap, count, out = [(best, 0, end, 0, None)], 0, [(0, first)]
        while heap and len(out) < n:
            f, _, node, behind, link = heapq.heappop(heap)
            if node == base:
                ids = []
                while link is not None:
                    ids.append(link[0])
                    link = link[1]
                if tuple(ids) != first:
                    out.append((f - best, tuple(ids)))
                continue
            for a, id_, cost in into.get(node, ()):
                if ahead[a - base] < _UNSEEN:
                    count += 1
                    heapq.heappush(heap, (behind + cost + ahead[a - base], count, a, behind + cost, (id_, link)))
        return out


class Known:
    """The best path, cost and least extra cost of units met so far, and the N best of some, by hash: a cache, whose bound changes no result."""

    def __init__(self, model: Pieces, n: int, most: int = 600_000, most_nbest: int = 30_000):
        self.model, self.n, self.most, self.most_nbest = model, n, most, most_nbest
        self.lists: dict[int, list] = {}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.start, self.size, self.total, self.extra = (np.empty(0, np.int64) for _ in range(4))
        self.path = np.empty(0, np.int32)

    def of(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Where the units with these sorted hashes are in the arrays, after the new ones are added."""
        if len(self.keys) > self.most:
            self._clear()
        new = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            found = Lattices(self.model, data, first[new], last[new])
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys = both[order]
            for name, more in (("start", found.path_start + len(self.path)), ("size", found.path_size), ("total", found.total), ("extra", found.extra)):
                setattr(self, name, np.concatenate([getattr(self, name), more])[order])
            self.path = np.concatenate([self.path, found.path])
        return np.searchsorted(self.keys, keys)

    def nbest(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, keys: np.ndarray) -> dict[int, list]:
        """The N best of these units by hash."""
        if len(self.lists) > self.most_nbest:
            self.lists = {}
        new = [i for i, k in enumerate(keys.tolist()) if k not in self.lists]
        if new:
            found = Lattices(self.model, data, first[new], last[new])
            for u, k in enumerate(keys[new].tolist()):
                self.lists[k] = found.nbest(u, self.n)
        return self.lists


def _units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts with the space before each, first and last byte of each unit, units of each text)."""
    joined = b"".join(b" " + t for t in texts if t)
    data = np.frombuffer(joined + b"        ", np.uint8)
    raw = data[:-8]
    size = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
    edge = np.cumsum(size) - size
    space = raw == 0x20
    new = np.zeros(len(raw), bool)
    new[1:] = space[1:] & ~space[:-1]
    new[edge[size > 0]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(raw))[: len(first)]
    cut = np.searchsorted(first, np.append(edge, len(raw)))
    return data, first, last, np.diff(cut)


def _merge(lists: list[list[tuple[int, tuple]]], n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n least sums of one extra cost from each list, as (sum, choice from each)."""
    start = (0,) * len(lists)
    heap, done, out = [(0, start)], {start}, []
    while heap and len(out) < n:
        cost, choice = heapq.heappop(heap)
        out.append((cost, choice))
        for k, c in enumerate(choice):
            if c + 1 < len(lists[k]):
                after = (*choice[:k], c + 1, *choice[k + 1 :])
                if after not in done:
                    done.add(after)
                    heapq.heappush(heap, (cost + lists[k][c + 1][0] - lists[k][c][0], after))
    return out


def segment(known: Known, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """(best ids of all texts, how many each has, the cost of each, the n - 1 next segmentations of each as edits)."""
    n = known.n
    data, first, last, counts = _units(texts)
    keys, where, which = np.unique(hash_ranges(data, first, last), return_index=True, return_inverse=True)
    there = known.of(data, first[where], last[where], keys)[which]
    sizes = known.size[there]
    at = np.cumsum(sizes) - sizes  # of each unit in the run of ids
    ids = known.path[np.arange(int(sizes.sum())) + np.repeat(known.start[there] - at, sizes)]
    ends = np.cumsum(counts)
    starts = ends - counts
    id_ends, costs = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes, known.total[there]))
    n_ids = id_ends[ends] - id_ends[starts]
    cost = costs[ends] - costs[starts]
    others: list[list[dict]] = [[] for _ in texts]
    if n > 1 and len(which):
        extra = known.extra[there]
        text = np.repeat(np.arange(len(texts)), counts)
        order = np.lexsort((extra, text))
        near = order[(np.arange(len(order)) - starts[text[order]] < n - 1) & (extra[order] < _UNSEEN)]
        wanted = np.unique(which[near])
        lists_of = known.nbest(data, first[where[wanted]], last[where[wanted]], keys[wanted])
        cuts = np.searchsorted(text[near], np.arange(len(texts) + 1))
        for k in range(len(texts)):
            units = np.sort(near[cuts[k] : cuts[k + 1]]).tolist()
            lists = [lists_of[int(keys[which[u]])] for u in units]
            begin = int(id_ends[starts[k]])
            for plus, choice in _merge(lists, n)[1:]:
                edits = [{"at": int(at[u]) - begin, "drop": int(sizes[u]), "ids": list(options[c][1])} for u, options, c in zip(units, lists, choice) if c]
                others[k].append({"cost": int(cost[k]) + plus, "edits": edits})
    return ids, n_ids, cost, others


def edited(ids: list[int], edits: list) -> list[int]:
    """A further segmentation, from the best one and its edits."""
    out, done = [], 0
    for e in edits:
        out += ids[done : e["at"]] + list(e["ids"])
        done = e["at"] + e["drop"]
    return out + ids[done:]


def encode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), n: int = 4, decoded: str | None = None) -> DataFrame:
    """The columns ``keep``, ids (of the best segmentation), cost (micro-nats) and others (the next n - 1: cost and edits of ids).

    ``decoded``: a further column with the text of the ids, decoded in the same pass.
    """
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("cost", T.LongType()), T.StructField("others", T.ArrayType(_OTHER))])
    if decoded is not None:
        schema = schema.add(decoded, T.StringType())
    arrow = pa.list_(pa.struct([("cost", pa.int64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(pieces(path), n)
        for part in slices(batches, text, 2 << 20):
            ids, counts, cost, others = segment(known, as_bytes(part.column(text)))
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns = [*(part.column(c) for c in keep), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(cost), pa.array(others, arrow)]
            if decoded is not None:
                columns.append(pa.array(decode_ids(known.model, ids, offsets.to_numpy()), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.select(*dict.fromkeys((*keep, text))).mapInArrow(run, schema)


def decode_ids(model: Pieces, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The text of each run of ids."""
    sizes = model.sizes[ids]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = model.blob[np.arange(int(ends[-1])) + np.repeat(model.offsets[ids] - ends[:-1], sizes)].tobytes()
    cuts = ends[offsets].tolist()
    return [out[a + 1 : b] if b > a else b"" for a, b in zip(cuts, cuts[1:])]


def _by_ids(batches: Iterator[pa.RecordBatch], ids: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows of about ``most`` ids."""
    for batch in batches:
        run = np.cumsum(pc.list_value_length(batch.column(ids)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``, the text of ``ids`` (null: empty); an id that is no piece fails."""
    name = T.StructField(out, T.StringType())
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in _by_ids(batches, ids):
            column = pa.concat_arrays([batch.column(ids)])
            offsets = column.offsets.to_numpy()
            texts = decode_ids(model, column.values.to_numpy()[: offsets[-1]].astype(np.int64), offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema.fields[:-1]), pa.array(texts, pa.binary()).cast(pa.string())], schema.names)

    return df.mapInArrow(run, schema)
