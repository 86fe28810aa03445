"""SentencePiece encoding with sampled segmentations, and decoding.

A text's segmentations into pieces of a vocabulary are the paths of a lattice. A piece's probability falls with its rank in
the vocabulary file (``1 / (rank + 50)``, not trained); a path's is the product of its pieces', over the sum of all paths.
Gumbel top-k draws k distinct paths without replacement: every path has a perturbed log-probability, and the k largest are
found best-first from the top of the tree of path prefixes (an A* search). The bound of a subtree is exact: the backward sums over the
lattice give its total probability, and its largest perturbed value is Gumbel about the log of that, cut off at its
parent's. Following one path, all branches left aside at a piece are kept as one entry of the queue with their joint
probability; taking that entry again gives the best of them.

A sample's inclusion score is the probability that its perturbed value exceeds the (k+1)-th largest, given that value. Random
numbers are seeded by the row key, so a row's samples don't depend on partitions or order.

Pieces never reach across the start of a run of blanks. Texts are taken in blocks of about BLOCK characters: the lattices of a block's different units are
built together, in columns, and all units of all its texts are walked at once, a piece at a time. Every draw is a hash of the row key and its place.

Defined cases: a null or empty text has one empty segmentation, with score 1. A text with fewer than k segmentations gives all of them.
Characters outside the vocabulary are one forced edge of byte pieces. Rows that share an id and a text have the same samples. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Batches, map_batches
from .words import mix

SAMPLES, SMOOTHING = 2, 50.0
BLOCK = 3 << 20
FEW = 16  # so many walkers go on one by one
_BLANK = "▁"
_LEAST = 1e-300
_U = np.uint64
_STRIDE = 0x9E3779B97F4A7C15
#: What a number is drawn for: steps of a walk, branchings left aside, and the choice among them.
_WALK, _ASIDE, _CHOICE = 1, 2, 3

Sample = tuple[np.ndarray, float, float]


class Lattice:
    """Vocabulary of a SentencePiece file: its pieces as a tree of characters, whose steps are looked up in an open-addressed table."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        ids, self.bytes = {}, np.zeros(256, np.int32)
        for i in range(n):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                ids[piece] = i
        self.weight = 1 / (np.arange(n) + SMOOTHING)
        self.longest = max(map(len, ids), default=1)
        number = {"": 0}
        for piece in ids:
            for end in range(1, len(piece) + 1):
                number.setdefault(piece[:end], len(number))
        self.piece = np.full(len(number), -1, np.int32)  # of each beginning of a piece the piece it is, if it is one
        for piece, i in ids.items():
            self.piece[number[piece]] = i
        bits = max(4, (2 * len(number)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        steps = [(number[w[:-1]] << 21 | ord(w[-1]), k) for w, k in number.items() if w]
        for (key, k), at in zip(steps, self._slot(np.array([key for key, _ in steps], np.int64)).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = at + 1 & self.mask
            self.keys[at], self.next[at] = key, k

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(_STRIDE)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The beginnings of pieces that are one character longer; -1 where none is."""
        key = state.astype(np.int64) << 21 | char
        at = self._slot(key)
        met = self.keys[at]
        found = np.where(met == key, self.next[at], np.int32(-1))
        left = np.flatnonzero((met != key) & (met >= 0))
        while len(left):
            at[left] = at[left] + 1 & self.mask
            met = self.keys[at[left]]
            hit = met == key[left]
            found[left[hit]] = self.next[at[left[hit]]]
            left = left[~hit & (met >= 0)]
        return found


class Units:
    """The lattices of different units, all at once.

    Places are numbered by how far they are from their unit's end, then by unit, longer units first: the first ``n`` are the units' ends. The edges of
    place ``i`` are ``first[i]`` to ``first[i + 1]``, shorter ones first; each has the place it leads to, its piece, its probability given its start, and what its
    start's other edges have together (``rest``). A piece below 0 says which of the characters outside the vocabulary it is (-1 - number).
    """

    def __init__(self, code: np.ndarray, lengths: np.ndarray, lat: Lattice) -> None:
        order = np.argsort(-lengths, kind="stable")
        self.n, longest = len(lengths), int(lengths[order[0]])
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        layer = np.concatenate([[0], np.cumsum(self.n - np.searchsorted(np.sort(lengths), np.arange(longest + 1)))])
        self.start = layer[lengths] + rank  # of each unit
        away = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))
        whose = np.repeat(rank, lengths)
        places = int(layer[-1])
        char, after = np.zeros(places, np.int64), np.zeros(places, np.int32)
        at = layer[away] + whose
        char[at], after[at] = code, layer[away - 1] + whose
        self._edges(lat, char, after, places)
        self._chances(layer)

    def _edges(self, lat: Lattice, char: np.ndarray, after: np.ndarray, places: int) -> None:
        source = np.arange(self.n, places, dtype=np.int32)
        here, state = source, np.zeros(len(source), np.int32)
        found = []
        strange = np.zeros(0, np.int64)
        for length in range(1, lat.longest + 1):
            state = lat.step(state, char[here])
            alive = state >= 0
            piece = np.where(alive, lat.piece[state], np.int32(-1))
            to = after[here]
            if length == 1:  # a character that is no piece is one edge of byte pieces
                none = np.flatnonzero(piece < 0)
                strange, which = np.unique(char[here[none]], return_inverse=True)
                piece[none] = -1 - which
                found.append((source, to, piece))
            else:
                is_piece = piece >= 0
                found.append((source[is_piece], to[is_piece], piece[is_piece]))
            alive &= to >= self.n
            source, here, state = source[alive], to[alive], state[alive]
            if not len(source):
                break
        raw = [chr(c).encode() for c in strange.tolist()]
        self.raw = lat.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        self.raw_at = np.cumsum([0, *map(len, raw)])
        forced = np.array([math.prod(lat.weight[self.raw[a:b]].tolist()) for a, b in zip(self.raw_at[:-1], self.raw_at[1:], strict=True)])
        weight = np.concatenate([lat.weight, forced[::-1]])  # found from its end by a piece below 0
        self.first = np.zeros(places + 1, np.int64)
        for one, _, _ in found:
            self.first[one + 1] += 1
        np.cumsum(self.first, out=self.first)
        free = self.first[:-1].copy()
        edges = int(self.first[-1])
        self.to, self.piece, self.weight = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        for one, to, piece in found:
            e = free[one]
            free[one] += 1
            self.to[e], self.piece[e], self.weight[e] = to, piece, weight[piece]
        self.longest = lat.longest

    def _chances(self, layer: np.ndarray) -> None:
        first, sizes = self.first, np.diff(self.first)
        ahead = np.ones(len(sizes))  # the sum over all paths from a place to its unit's end, up to a factor
        self.chance = np.empty(len(self.to))
        cuts = layer.tolist()
        for t in range(1, len(cuts) - 1):
            a, b = cuts[t], cuts[t + 1]
            i, j = int(first[a]), int(first[b])
            v = self.weight[i:j] * ahead[self.to[i:j]]
            total = np.add.reduceat(v, first[a:b] - i)
            ahead[a:b] = total
            self.chance[i:j] = v / np.repeat(total, sizes[a:b])
            if total.min() < 1e-100:  # what comes before sees no farther than the longest piece
                for r in np.flatnonzero(total < 1e-100).tolist():
                    for s in range(t, max(-1, t - self.longest - 1), -1):
                        ahead[cuts[s] + r] *= 1e100
        del self.weight
        # an edge of more than a half is the only one of its place: the others' sum loses no digits
        most = self.chance > 0.5
        self.rest = 1 - self.chance
        self.source = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        others = np.add.reduceat(np.where(most, 0.0, self.chance), first[self.n : -1])
        self.rest[most] = others[self.source[most] - self.n]

    def walk(self, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Paths from places to their units' ends, drawn by the lattices' probabilities: all edges, one walker after the other, and each walker's number of them."""
        first, chance = self.first, self.chance
        steps = np.zeros(len(place), np.int64)
        got: list[tuple[np.ndarray, np.ndarray, int]] = []
        who = np.flatnonzero(place >= self.n)
        here, seed, k = place[who], seed[who], 0
        while len(who) > FEW:
            e, last = first[here], first[here + 1] - 1
            left = np.flatnonzero(e < last)
            u, at, end = _uniform(seed[left] + _U(k)), e[left], last[left]
            while len(left):
                p = chance[at]
                on = np.flatnonzero(u >= p)
                left, u, at, end = left[on], u[on] - p[on], at[on] + 1, end[on]
                e[left] = at
                on = np.flatnonzero(at < end)
                left, u, at, end = left[on], u[on], at[on], end[on]
            got.append((who, e, k))
            k += 1
            steps[who] = k
            here = self.to[e]
            on = np.flatnonzero(here >= self.n)
            who, here, seed = who[on], here[on], seed[on]
        alone = []
        for w, at, own in zip(who.tolist(), here.tolist(), seed, strict=True):
            path, draws = [], iter(())
            while at >= self.n:
                if (u := next(draws, None)) is None:
                    draws = iter(_uniform(own + (np.arange(256, dtype=_U) + _U(k + len(path)))).tolist())
                    u = next(draws)
                e, last = int(first[at]), int(first[at + 1]) - 1
                while e < last and u >= (p := float(chance[e])):
                    u, e = u - p, e + 1
                path.append(e)
                at = int(self.to[e])
            steps[w] = k + len(path)
            alone.append((w, np.array(path, np.int64), k))
        begin = np.cumsum(steps) - steps
        out = np.empty(int(steps.sum()), np.int64)
        for w, e, k in got:
            out[begin[w] + k] = e
        for w, path, k in alone:
            out[begin[w] + k : begin[w] + k + len(path)] = path
        return out, steps

    def ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        piece = self.piece[np.concatenate(paths)]
        ends = np.cumsum([0, *map(len, paths)])
        strange = np.flatnonzero(piece < 0)
        if len(strange):
            sizes = np.ones(len(piece), np.int64)
            sizes[strange] = np.diff(self.raw_at)[-1 - piece[strange]]
            begin = np.concatenate([[0], np.cumsum(sizes)])
            piece, ends, sizes, first = np.repeat(piece, sizes), begin[ends], sizes[strange], begin[strange]
            inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.repeat(first, sizes) + inside
            piece[at] = self.raw[self.raw_at[-1 - piece[at]] + inside]
        return [piece[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.cache
def lattice(path: str) -> Lattice:
    return Lattice(path)


def normalise(text: str) -> str:
    """As the model does: a blank in front, blanks as U+2581."""
    return (_BLANK + text.replace(" ", _BLANK)) if text else ""


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different units of texts (their characters in a row, and their lengths), the number of each unit of all texts, and each text's first unit (one more at the end)."""
    spelt = [normalise(text) for text in texts]
    cuts = np.cumsum([0, *map(len, spelt)])
    code = np.frombuffer("".join(spelt).encode("utf-32-le"), "<u4")
    first = code == ord(_BLANK)
    first[1:] &= ~first[:-1]
    first[cuts[:-1][cuts[:-1] < len(code)]] = True
    begin = np.flatnonzero(first)
    at = pa.py_buffer(4 * np.append(begin, len(code)))
    units = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, at, pa.py_buffer(code)]).dictionary_encode()
    ends = np.frombuffer(units.dictionary.buffers()[1], np.int64)[: len(units.dictionary) + 1] // 4
    different = np.frombuffer(units.dictionary.buffers()[2] or b"", "<u4")[: ends[-1]]
    return different.astype(np.int64), np.diff(ends), units.indices.to_numpy(), np.searchsorted(begin, cuts)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, both excluded, of 64-bit numbers that tell draws apart."""
    return np.clip((mix(x) >> _U(11)).astype(np.float64) * 2.0**-53, 1e-12, 1 - 1e-12)


def _seeds(own: np.ndarray, kind: int, turn: int, part: np.ndarray | int) -> np.ndarray:
    """A 64-bit number for a text's draws of a kind, at a turn, in a part."""
    return mix(mix(own + _U((kind << 32) + turn)) + np.asarray(part).astype(_U) * _U(_STRIDE))


def _cut(free: float, top: float) -> float:
    """A free Gumbel draw as one about the same location given that it does not exceed ``top``: its chance to be below a value, over that of ``top``. In a form that loses no digits."""
    v = top - free
    return top - max(v, 0.0) - math.log1p(math.exp(-abs(v)))


class _Search:
    """The best-first search of one text: paths taken (edges, log-probability, perturbed value, the unit of each edge), and branches left aside.

    An entry of the queue, least value first: it, its order, path and step at which the branches were left aside, log-probability up to there, edges used.
    """

    def __init__(self, begin: int, end: int, own: int) -> None:
        self.begin, self.end, self.own = begin, end, own  # its units in the block's, the seed of its draws
        self.taken: list[tuple[np.ndarray, float, float, np.ndarray]] = []
        self.queue: list[tuple[float, int, int, int, float, tuple[int, ...]]] = []


def _spread(units: Units, start: np.ndarray, asked: list[tuple[_Search, np.ndarray, np.ndarray, float, float, int, int]], turn: int, k: int) -> None:
    """Takes the best path under each prefix and queues what it leaves aside, a branching at a time.

    ``asked``: search, edges of the prefix and their units, log-probability and perturbed value of the prefix, its last unit, place in that unit (-1: none, at the start).
    """
    whose, place, sizes = [], [], []
    for search, _, _, _, _, unit, at in asked:
        todo = np.arange(search.begin if at < 0 else unit, search.end)
        here = start[todo]
        if at >= 0:
            here[0] = at
        whose.append(todo)
        place.append(here)
        sizes.append(len(todo))
    own = np.array([s.own for s, *_ in asked], _U)
    unit = np.concatenate(whose)
    inside = unit - np.repeat(np.array([s.begin for s, *_ in asked]), sizes)
    path, steps = units.walk(np.concatenate(place), _seeds(np.repeat(own, sizes), _WALK, turn, inside))
    unit = np.repeat(unit, steps)
    ends = np.concatenate([[0], np.cumsum(steps)])[np.cumsum([0, *sizes])]
    logs = np.log(units.chance[path])
    down = np.empty(len(path))
    for (_, _, _, phi, _, _, _), a, b in zip(asked, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b > a:
            logs[a] += phi
            np.cumsum(logs[a:b], out=logs[a:b])
            down[a], down[a + 1 : b] = phi, logs[a : b - 1]
    rest = units.rest[path]
    branch = np.flatnonzero(rest > 0)
    cuts = np.searchsorted(branch, ends)
    many = np.diff(cuts)
    draws = _uniform(_seeds(np.repeat(own, many), _ASIDE, turn, branch - np.repeat(ends[:-1], many)))
    free = down[branch] + np.log(rest[branch] / -np.log(draws))
    for n, (search, prefix, known, phi, value, _, _) in enumerate(asked):
        a, b, i, j = int(ends[n]), int(ends[n + 1]), int(cuts[n]), int(cuts[n + 1])
        # no more than k of one path's branchings can be needed; to be cut off does not change their order
        best = i + np.argpartition(-free[i:j], k)[: k + 1] if j - i > k + 1 else np.arange(i, j)
        for x in best.tolist():
            at = int(branch[x])
            entry = -_cut(float(free[x]), value), len(search.queue) + 1000 * len(search.taken), len(search.taken), len(prefix) + at - a, float(down[at]), (int(path[at]),)
            heapq.heappush(search.queue, entry)
        search.taken.append((np.concatenate([prefix, path[a:b]]), float(logs[b - 1]) if b > a else phi, value, np.concatenate([known, unit[a:b]])))


def _taken_next(units: Units, search: _Search, u: np.ndarray) -> tuple[_Search, np.ndarray, np.ndarray, float, float, int, int]:
    """Opens the best branch left aside; its place's other branches go back to the queue. ``u``: two draws."""
    value, order, parent, step, phi, used = heapq.heappop(search.queue)
    path, _, _, unit = search.taken[parent]
    place = int(units.source[path[step]])
    free = [e for e in range(int(units.first[place]), int(units.first[place + 1])) if e not in used]
    mass = units.chance[free]
    edge = free[min(len(free) - 1, int(np.searchsorted(np.cumsum(mass), u[0] * mass.sum(), "right")))]
    if len(free) > 1:
        left = max(sum(float(units.chance[e]) for e in free if e != edge), _LEAST)
        again = _cut(phi + math.log(left / -math.log(u[1])), -value)
        heapq.heappush(search.queue, (-again, order, parent, step, phi, (*used, edge)))
    prefix, known = np.append(path[:step], edge), unit[: step + 1]
    return search, prefix, known, phi + math.log(units.chance[edge]), -value, int(unit[step]), int(units.to[edge])


def samples(texts: list[str], keys: list, lat: Lattice, k: int = SAMPLES) -> list[list[Sample]]:
    """For each text up to ``k`` distinct segmentations as (ids, log-probability, inclusion score), the largest perturbed value first."""
    code, lengths, spelt, first = split(texts)
    searches = [_Search(begin, end, xxhash.xxh3_64_intdigest(str(key).encode(), 12)) for begin, end, key in zip(first[:-1].tolist(), first[1:].tolist(), keys, strict=True)]
    left = [s for s in searches if s.end > s.begin]
    ids = iter(())
    if left:
        units = Units(code, lengths, lat)
        start = units.start[spelt].astype(np.int32)
        none = np.zeros(0, np.int64)
        top = -np.log(-np.log(_uniform(_seeds(np.array([s.own for s in left], _U), _CHOICE, 0, 0))))
        _spread(units, start, [(s, none, none, 0.0, v, 0, -1) for s, v in zip(left, top.tolist(), strict=True)], 0, k)
        for turn in range(1, k):
            left = [s for s in left if s.queue]
            if not left:
                break
            draws = _uniform(_seeds(np.repeat(np.array([s.own for s in left], _U), 2), _CHOICE, turn, np.tile(np.arange(2), len(left)))).reshape(-1, 2)
            _spread(units, start, [_taken_next(units, s, u) for s, u in zip(left, draws, strict=True)], turn, k)
        ids = iter(units.ids([path for s in searches for path, *_ in s.taken]))

    def result(search: _Search) -> list[Sample]:
        if not search.taken:
            return [(np.zeros(0, np.int32), 0.0, 1.0)]
        bound = -search.queue[0][0] if search.queue and len(search.taken) == k else -math.inf  # the (k+1)-th largest
        score = lambda phi: 1.0 if bound == -math.inf else -math.expm1(-math.exp(min(phi - bound, 700)))
        return [(next(ids), phi, score(phi)) for _, phi, _, _ in search.taken]

    return [result(s) for s in searches]


def sample(text: str, key: int | None, lat: Lattice, k: int = SAMPLES) -> list[tuple[bytes, float, float]]:
    """``samples`` of one text, ids in little-endian bytes."""
    return [(ids.astype("<u4").tobytes(), phi, score) for ids, phi, score in samples([text], [key], lat, k)[0]]


def decode(ids: list[int] | np.ndarray, lat: Lattice) -> str:
    return lat.model.decode(ids)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK characters; a longer text is one of its own."""
    sizes = np.cumsum([0, *((n or 0) for n in pc.utf8_length(batch.column(1)).to_pylist())])
    i = 0
    while i < len(batch):
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + BLOCK, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def segmentations(docs: DataFrame, path: str, k: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per sample: id, sample (1 to k), ids, n_pieces, ids_crc32, log_prob, inclusion, round_trip (decoding the ids gives the text)."""

    def run(batches: Batches) -> Batches:
        lat = lattice(path)
        for batch in batches:
            for part in _blocks(batch):
                row, found, rows = [], [], []
                texts = [text or "" for text in part.column(1).to_pylist()]
                for at, (text, got) in enumerate(zip(texts, samples(texts, part.column(0).to_pylist(), lat, k), strict=True)):
                    for number, (own, phi, score) in enumerate(got, 1):
                        row.append(at)
                        found.append(own)
                        rows.append((number, len(own), zlib.crc32(own.astype("<u4").tobytes()), phi, score, decode(own, lat) == text))
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
                number, *others = [pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), number, ids, *others], names)

    names = [id_col, "sample", "ids", "n_pieces", "ids_crc32", "log_prob", "inclusion", "round_trip"]
    ids = docs.select(F.col(id_col), F.col(text_col))
    kinds = (T.IntegerType(), T.ArrayType(T.IntegerType()), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    return map_batches(ids, run, T.StructType([ids.schema.fields[0], *(T.StructField(n, t) for n, t in zip(names[1:], kinds, strict=True))]))
