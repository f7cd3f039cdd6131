"""Sampled SentencePiece segmentations without replacement, and decoding."""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType,
)

from attestry.llm.common import map_text, mix, run_hashes, text_slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segmentations drawn for each text.
SAMPLES = 3
#: Text that one lattice is built for; a longer text has one of its own.
LATTICE_BYTES = 256 << 10
SPACE, OTHER_SPACE, NEWLINE = 0x2581, 0x10FFFF + 1, 0x0A
#: Ids that are spelled together to compare them with their texts.
SPELL_IDS = 1 << 14
#: No Gumbel value from 32 random bits is this far above its location.
REACH = 23.0
#: Steps of a path that are looked at first, as far as their prefix has this log chance.
STEPS, NEAR = 384, -35.0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces of a model as a trie, with a weight for each.

    A merge-rank model has no probabilities; a piece of rank r weighs 1 / (r + 2),
    Zipf's law. A character without a piece is written in byte pieces, at the
    lowest weight each.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        known = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = known.get_piece_size()
        self.bytes = [b""] * self.size
        self.byte_ids = np.zeros(256, np.int32)
        edges: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        weights = np.full(self.size, -np.log(self.size + 2.0))
        self.longest = 1
        for i in range(self.size):
            piece = known.id_to_piece(i)
            if known.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (known.is_unknown(i) or known.is_control(i) or known.is_unused(i)):
                if "▁" in piece.lstrip("▁") or "\n" in piece:
                    raise ValueError(f"piece {i} goes over the start of a word")
                node = 0
                for c in map(ord, piece):
                    node = edges.setdefault((node, c), len(edges) + 1)
                ends[node] = i
                rank = -known.get_score(i)
                weights[i] = -np.log(2.0 + (rank if rank < self.size else 0))
                self.bytes[i] = piece.replace("▁", " ").encode()
                self.longest = max(self.longest, len(piece))
        self.spellings = pa.array(self.bytes, pa.large_binary())
        self.weights, self.byte_weight = weights, -np.log(self.size + 2.0)
        self._place_edges(np.array([n << 21 | c for n, c in edges], np.int64), np.array(list(edges.values()), np.int64))
        self.piece = np.full(len(edges) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        # the nodes of first characters are looked up by character
        self.root = np.full(OTHER_SPACE + 1, -1, np.int32)
        for (node, c), to in edges.items():
            if not node:
                self.root[c] = to

    def _place_edges(self, keys: np.ndarray, child: np.ndarray) -> None:
        """Put the edges of the trie into a hash table at most a quarter full."""
        self.shift = np.uint64(64 - max(int(len(keys) * 4).bit_length(), 4))
        self.edge = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.child = np.zeros(len(self.edge), np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.edge[slot[todo]] < 0]
            self.edge[slot[free]] = keys[free]
            self.child[slot[free]] = child[free]
            todo = todo[self.edge[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.edge) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) * _SPREAD
        slot >>= self.shift
        return slot.view(np.int64)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """The node that each edge (node << 21 | character) leads to, -1 where there is none."""
        slot = self._slot(keys)
        there, out = self.edge.take(slot), self.child.take(slot)
        other = np.flatnonzero(there != keys)
        out[other] = -1
        other = other[there.take(other) >= 0]
        while len(other):
            slot[other] = (slot[other] + 1) & (len(self.edge) - 1)
            there = self.edge[slot[other]]
            hit = there == keys[other]
            out[other[hit]] = self.child[slot[other[hit]]]
            other = other[~hit & (there >= 0)]
        return out

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of an array of valid ids, the space in front included, and where each id's bytes begin."""
        _, offsets, letters = self.spellings.take(pa.array(ids)).buffers()
        return np.frombuffer(letters, np.uint8) if letters is not None and letters.size else np.zeros(0, np.uint8), np.frombuffer(offsets, np.int64)[: len(ids) + 1]

    def spells(self, rows: list[np.ndarray], texts: list[np.ndarray]) -> list[bool]:
        """Whether each row of valid ids, the space in front left out, gives the bytes of its text."""
        out, first = [], 0
        while first < len(rows):
            # as many rows as have SPELL_IDS ids, one at least
            last, size = first + 1, len(rows[first])
            while last < len(rows) and size + len(rows[last]) <= SPELL_IDS:
                size += len(rows[last])
                last += 1
            letters, at = self.spell(np.concatenate(rows[first:last]))
            bounds = at[np.concatenate([[0], np.cumsum([len(r) for r in rows[first:last]])])].tolist()
            out += [np.array_equal(letters[a + 1 : b], text) for a, b, text in zip(bounds[:-1], bounds[1:], texts[first:last], strict=True)]
            first = last
        return out

    def decode(self, ids) -> str:
        """The text of a row of ids; ids outside the vocabulary and control pieces are empty."""
        out = b"".join([self.bytes[i] for i in ids if 0 <= i < self.size])
        return out.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=1)
def vocabulary_of(model: bytes) -> Vocabulary:
    """The vocabulary of a model, built once in each Python worker."""
    return Vocabulary(model)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then starts[1], ..."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Lattice:
    """All pieces over the distinct words of some texts, with the chance of each piece at its place.

    ``beta`` is the log weight of all ways from a place to its word's end, so the
    chance of a piece depends on its place alone.
    """

    def __init__(self, vocabulary: Vocabulary, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        sizes = ends - starts
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        codes = chars[_spread(starts, sizes)].astype(np.int64)
        n = len(codes)
        left = np.repeat(self.first[1:], sizes) - np.arange(n)
        at, node, depth = np.arange(n), vocabulary.root.take(codes).astype(np.int64), 0
        found, choices = [], np.zeros(n, np.int64)
        while len(at):
            hit = np.flatnonzero(node >= 0)
            at, node = at.take(hit), node.take(hit)
            depth += 1
            piece = vocabulary.piece.take(node)
            is_piece = np.flatnonzero(piece >= 0)
            ends_here = at.take(is_piece)
            # which arc of its place each one is
            nth = choices.take(ends_here)
            found.append((ends_here, piece.take(is_piece) << 32 | depth, nth))
            choices[ends_here] = nth + 1
            more = np.flatnonzero(left.take(at) > depth)
            at, node = at.take(more), node.take(more)
            if len(at):
                node = vocabulary.follow(node << 21 | codes.take(at + depth))
        # a character that is no piece by itself has an arc for its bytes, after the others of its place
        lone = np.ones(n, bool)
        lone[found[0][0]] = False
        lone = np.flatnonzero(lone)
        letter = codes.take(lone)
        width = np.select([letter < 0x80, letter < 0x800, letter < 0x10000], [1, 2, 3], 4)
        width[letter == OTHER_SPACE] = 3
        nth = choices.take(lone)
        choices[lone] = nth + 1
        self.choices = choices
        self.arc = np.concatenate([[0], np.cumsum(choices)])
        single = self.arc.take(lone) + nth
        # pieces and their lengths, place by place
        both = np.empty(self.arc[-1], np.int64)
        for places, made, nth in found:
            both[self.arc.take(places) + nth] = made
        both[single] = -1 << 32 | 1
        self.at = np.repeat(np.arange(n), choices)
        self.piece, self.span = (both >> 32).astype(np.int32), both & 0xFFFFFFFF
        self.ids = np.ones(len(both), np.int8)
        self.ids[single] = width
        weight = vocabulary.weights.take(np.maximum(self.piece, 0))
        weight[single] = width * vocabulary.byte_weight
        self.codes = codes
        # backwards over the places, all words at once: arcs by the length left, those that end their word at a place of weight 0
        target = np.where(left.take(self.at) > self.span, self.at + self.span, n)
        beta = np.zeros(n + 1)
        # numpy counts numbers of 16 bits instead of comparing them
        by_left = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
        count = choices.take(by_left)
        arcs = _spread(self.arc.take(by_left), count)
        sorted_weight, sorted_target = weight.take(arcs), target.take(arcs)
        begin = np.concatenate([[0], np.cumsum(count)])
        levels = np.searchsorted(left.take(by_left), np.arange(1, (left.max() if n else 0) + 2))
        for lo, hi in zip(levels[:-1], levels[1:]):
            value = sorted_weight[begin[lo] : begin[hi]] + beta.take(sorted_target[begin[lo] : begin[hi]])
            groups = begin[lo:hi] - begin[lo]
            top = np.maximum.reduceat(value, groups)
            beta[by_left[lo:hi]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count[lo:hi])), groups))
        self.log_p = np.minimum(weight + beta.take(target) - beta.take(self.at), 0.0)
        self.chance = np.exp(self.log_p)
        # cumulated place by place, so that a draw depends on nothing but the place;
        # the arc of the highest chance from each place, and the draws it takes
        within, self.likely = self.chance.copy(), self.arc[:-1].copy()
        several, back = np.flatnonzero(choices > 1), 1
        start, count = self.arc.take(several), choices.take(several)
        whole = top = self.chance.take(start)
        best = start
        while len(several):
            turn = start + back
            value = self.chance.take(turn)
            whole = value + whole
            within[turn] = whole
            best, top, back = np.where(value > top, turn, best), np.maximum(value, top), back + 1
            over = count > back
            gone, more = np.flatnonzero(~over), np.flatnonzero(over)
            self.likely[several.take(gone)] = best.take(gone)
            several, start, count, whole, top, best = (x.take(more) for x in (several, start, count, whole, top, best))
        within[self.arc[1:] - 1] = 1.0
        self.key = self.at + np.minimum(within, 1.0)
        self.upto = self.key.take(self.likely)
        self.since = np.where(self.likely > self.arc[:-1], self.key.take(self.likely - 1, mode="wrap"), -1.0)

    def draw(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc from each place that a number in [0, 1) falls to."""
        key = place + u
        arc = self.likely.take(place)
        other = np.flatnonzero((key >= self.upto.take(place)) | (key < self.since.take(place)))
        arc[other] = np.searchsorted(self.key, key.take(other), side="right")
        return arc


def _random(seed, at, stream: int) -> np.ndarray:
    """64 random bits for a row, a character of it and a purpose."""
    return mix(seed + mix((np.asarray(at, np.int64).astype(np.uint64) << np.uint64(8)) + np.uint64(stream)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32


def _below(location, top, bits: np.ndarray):
    """A Gumbel value of this location that is known to lie below ``top``."""
    return -np.logaddexp(-top, np.log(-np.log(_uniform(bits))) - location)


class _Path:
    """A segmentation: its first arcs as they are, the others as part of a walk."""

    def __init__(self, head, head_at, walk, lo: int, hi: int):
        self.head, self.head_at, self.walk, self.lo, self.hi = head, head_at, walk, lo, hi

    def step(self, i: int) -> tuple[int, int]:
        k = i - len(self.head)
        return (int(self.head[i]), int(self.head_at[i])) if k < 0 else (int(self.walk.arcs[self.lo + k]), int(self.walk.at[self.lo + k]))

    def lead(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        k = max(i - len(self.head), 0)
        tail = slice(self.lo, self.lo + k)
        return np.concatenate([self.head[:i], self.walk.arcs[tail]]), np.concatenate([self.head_at[:i], self.walk.at[tail]])


class _Walk:
    """Pieces drawn from each start to its word's end: arcs in order, places in their text, ids."""

    def __init__(self, search: _Search, start, end, rows, chars, stream: int):
        lattice, active = search.lattice, np.flatnonzero(start < end)
        # word by word instead of in text order, so that neighbours look at the same pieces
        blocks = start[active] >> max(int(lattice.first[-1]).bit_length() - 16, 0)
        active = active.take(np.argsort(blocks.astype(np.uint16), kind="stable"))
        seen, counts = [], np.zeros(len(start), np.int64)
        place, last, char, seeds = start.take(active), end.take(active), chars.take(active), search.seeds.take(rows.take(active))
        while len(active):
            u = (_random(seeds, char, stream) >> np.uint64(32)).astype(np.float64) * 2.0**-32
            arc = lattice.draw(place, u)
            seen.append((active, arc, char))
            span = lattice.span.take(arc)
            place = place + span
            going = place < last
            done, more = np.flatnonzero(~going), np.flatnonzero(going)
            counts[active.take(done)] = len(seen)
            char = char + span
            active, place, last, char, seeds = (x.take(more) for x in (active, place, last, char, seeds))
        offset = np.cumsum(counts) - counts
        self.arcs, self.at = np.zeros((2, counts.sum()), np.int64)
        for k, (who, arc, char) in enumerate(seen):
            spot = offset.take(who) + k
            self.arcs[spot], self.at[spot] = arc, char
        self.bounds = np.append(offset, len(self.arcs))
        self.ids, self.id_bounds = search.ids_of(self.arcs)


class _Search:
    """Perturbed A-star search over the segmentations of several texts at once.

    The best segmentation below a node of the search tree has the node's perturbed
    value; its first child is drawn by its chance and inherits the value, and all
    siblings together are a new node whose value is a Gumbel value truncated there.
    Popping nodes by value gives segmentations in the order of their own values,
    which is sampling without replacement.
    """

    def __init__(self, vocabulary: Vocabulary, lattice: Lattice, seeds: np.ndarray, words: np.ndarray, rows: np.ndarray, chars: np.ndarray):
        self.vocabulary, self.lattice, self.seeds = vocabulary, lattice, seeds
        self.base, self.end = lattice.first[words], lattice.first[words + 1]
        self.rows, self.chars = rows, chars
        self.of_row = np.searchsorted(rows, np.arange(len(seeds) + 1))
        self.heaps: list[list[tuple]] = [[] for _ in seeds]
        self.found: list[list[tuple[_Path, float, float]]] = [[] for _ in seeds]

    def ids_of(self, arcs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of arcs, characters without a piece as bytes, and where each arc's ids begin."""
        lattice = self.lattice
        ids = lattice.piece.take(arcs)
        spelled = np.flatnonzero(ids < 0)
        sizes = lattice.ids.take(arcs.take(spelled)).astype(np.int64)
        bounds = np.arange(len(arcs) + 1)
        wide = np.flatnonzero(sizes > 1)
        if len(wide):
            long = np.ones(len(arcs), np.int64)
            long[spelled] = sizes
            ids = np.repeat(ids, long)
            np.cumsum(long, out=bounds[1:])
        single = spelled[sizes == 1]
        ids[bounds.take(single)] = self.vocabulary.byte_ids[lattice.codes[lattice.at[arcs[single]]]]
        for i in spelled[wide].tolist():
            code = int(lattice.codes[lattice.at[arcs[i]]])
            raw = chr(SPACE if code == OTHER_SPACE else code).encode("utf-8")
            ids[bounds[i] : bounds[i + 1]] = self.vocabulary.byte_ids[list(raw)]
        return ids, bounds

    def _siblings(self, arcs, at, before: float, top: float, seed, stream: int, wanted: int):
        """The best nodes of siblings along a whole path: [(value, step, log chance before the step)]."""
        log_p = self.lattice.log_p[arcs]
        prefix = before + np.cumsum(log_p) - log_p
        steps = np.flatnonzero(self.lattice.choices[self.lattice.at[arcs]] > 1)
        location = prefix[steps] + np.log(np.maximum(-np.expm1(log_p[steps]), 1e-300))
        value = _below(location, top, _random(seed, at[steps], stream))
        return [(float(value[i]), int(steps[i]), float(prefix[steps[i]])) for i in np.argsort(-value, kind="stable")[:wanted]]

    def _open(self, paths: list[tuple[int, _Path, float, float]], stream: int, wanted: int) -> None:
        """Keep new segmentations (row, path, log chance before its walk, value); the steps of their walks open nodes of siblings.

        The chance of a prefix only falls, and past a prefix of chance NEAR no value
        reaches NEAR + REACH, so the first steps decide almost always. Where they do
        not, the whole walk is looked at.
        """
        if not paths:
            return
        lattice, walk = self.lattice, paths[0][1].walk
        lo, hi = (np.array([getattr(p, k) for _, p, _, _ in paths]) for k in ("lo", "hi"))
        rows = np.array([r for r, *_ in paths])
        before, top = np.array([b for _, _, b, _ in paths]), np.array([v for *_, v in paths])
        width = int(min(STEPS, max((hi - lo).max(), 1)))
        index = lo[:, None] + np.arange(width)
        valid = index < hi[:, None]
        index = np.where(valid, index, 0) if len(walk.arcs) else np.zeros_like(index)
        if len(walk.arcs):
            arcs = walk.arcs.take(index)
            log_p = np.where(valid, lattice.log_p.take(arcs), 0.0)
            total = before[:, None] + np.cumsum(log_p, axis=1)
            prefix = total - log_p
            who, step = np.nonzero(valid & (prefix >= NEAR))
            some = np.flatnonzero(lattice.choices.take(lattice.at.take(arcs[who, step])) > 1)
            who, step = who.take(some), step.take(some)
            location = prefix[who, step] + np.log(np.maximum(-np.expm1(log_p[who, step]), 1e-300))
            # no step is left out that has a value
            value = np.full((len(paths), max(step.max(initial=0) + 1, min(wanted, width))), -np.inf)
            value[who, step] = _below(location, top.take(who), _random(self.seeds.take(rows.take(who)), walk.at.take(lo.take(who) + step), stream))
            best = np.argsort(-value, axis=1, kind="stable")[:, :wanted]
            enough = (np.take_along_axis(value, best, 1)[:, -1] >= NEAR + REACH) & (best.shape[1] == wanted) & ((hi - lo <= width) | (total[:, -1] < NEAR))
        whole = before.copy()
        some = np.flatnonzero(hi > lo)
        if len(some):
            # sums over lo[i] to hi[i]; every second one is over what lies between two walks
            edges = np.stack([lo[some], hi[some]], axis=1).ravel()
            whole[some] += np.add.reduceat(np.append(lattice.log_p.take(walk.arcs), 0.0), edges)[::2]
        for i, (r, path, start, v) in enumerate(paths):
            head = len(path.head)
            if hi[i] > lo[i]:
                if enough[i]:
                    nodes = [(float(value[i, k]), int(k), float(prefix[i, k])) for k in best[i]]
                else:
                    own = slice(lo[i], hi[i])
                    nodes = self._siblings(walk.arcs[own], walk.at[own], start, v, self.seeds[r : r + 1], stream, wanted)
                for rank, (worth, step, lead) in enumerate(nodes):
                    heapq.heappush(self.heaps[r], (-worth, (stream << 40) + rank, len(self.found[r]), head + step, (path.step(head + step)[0],), lead))
            self.found[r].append((path, float(whole[i]), v))

    def _branch(self, k: int) -> list[tuple]:
        """Pop a node of each row and draw its first child: (row, path, step, arc, character, log chance with the arc, value)."""
        lattice = self.lattice
        popped = [(r, heapq.heappop(heap)) for r, heap in enumerate(self.heaps) if heap]
        steps = [self.found[r][path][0].step(step) for r, (_, _, path, step, _, _) in popped]
        seeds = self.seeds[[r for r, _ in popped]]
        chars = np.array([char for _, char in steps], np.int64)
        draw, again = _uniform(_random(seeds, chars, 64 + k)), _random(seeds, chars, 128 + k)
        out, left = [], []
        for i, ((r, (minus, _, path, step, gone, prefix)), (old, char)) in enumerate(zip(popped, steps)):
            place = lattice.at[old]
            rest = [a for a in range(lattice.arc[place], lattice.arc[place + 1]) if a not in gone]
            chance = lattice.chance[rest]
            whole = np.cumsum(chance)
            pick = min(int(np.searchsorted(whole, draw[i] * whole[-1], side="right")), len(rest) - 1)
            arc = rest[pick]
            if len(rest) > 1:
                left.append((i, arc, prefix + np.log(max(whole[-1] - chance[pick], 1e-300))))
            out.append((r, path, step, arc, char, prefix + float(lattice.log_p[arc]), -minus))
        if left:
            at = [i for i, _, _ in left]
            values = _below(np.array([location for _, _, location in left]), np.array([-popped[i][1][0] for i in at]), again[at])
            for (i, arc, _), value in zip(left, values.tolist()):
                r, (_, _, path, step, gone, prefix) = popped[i]
                heapq.heappush(self.heaps[r], (-value, k << 40, path, step, (*gone, arc), prefix))
        return out

    def run(self, samples: int):
        """For each row: [(ids, log chance, value)] in the order of value, and the value of the next one."""
        lattice = self.lattice
        walk = _Walk(self, self.base, self.end, self.rows, self.chars, 0)
        none = np.zeros(0, np.int64)
        bounds = walk.bounds[self.of_row]
        roots = -np.log(-np.log(_uniform(_random(self.seeds, np.zeros(len(self.seeds), np.int64), 255))))
        rows = np.flatnonzero(np.diff(self.of_row))
        self._open([(r, _Path(none, none, walk, bounds[r], bounds[r + 1]), 0.0, float(roots[r])) for r in rows], 192, samples)
        for k in range(1, samples):
            turns = self._branch(k)
            if not turns:
                break
            starts, ends, rows, chars = [], [], [], []
            for r, _, _, arc, char, _, _ in turns:
                lo, hi = self.of_row[r], self.of_row[r + 1]
                word = lo + np.searchsorted(self.chars[lo:hi], char, side="right") - 1
                starts += [[lattice.at[arc] + lattice.span[arc]], self.base[word + 1 : hi]]
                ends.append(self.end[word:hi])
                rows.append(np.full(hi - word, r))
                chars += [[char + lattice.span[arc]], self.chars[word + 1 : hi]]
            walk = _Walk(self, np.concatenate(starts), np.concatenate(ends), np.concatenate(rows), np.concatenate(chars), k)
            bounds = walk.bounds[np.concatenate([[0], np.cumsum([len(e) for e in ends])])]
            grown = []
            for i, (r, path, step, arc, char, before, value) in enumerate(turns):
                lead, lead_at = self.found[r][path][0].lead(step)
                grown.append((r, _Path(np.append(lead, arc), np.append(lead_at, char), walk, bounds[i], bounds[i + 1]), before, value))
            self._open(grown, 192 + k, samples)
        heads = [path.head for own in self.found for path, _, _ in own]
        ids, bounds = self.ids_of(np.concatenate([none, *heads]))
        cut = bounds.take(np.cumsum([0] + [len(head) for head in heads])).tolist()
        before = iter(zip(cut[:-1], cut[1:]))

        def whole(path: _Path) -> np.ndarray:
            (a, b), walk = next(before), path.walk
            tail = walk.ids[walk.id_bounds[path.lo] : walk.id_bounds[path.hi]]
            return np.concatenate([ids[a:b], tail]) if b > a else tail

        return [([(whole(path), log_p, value) for path, log_p, value in own], -heap[0][0] if heap else -np.inf) for own, heap in zip(self.found, self.heaps)]


def _words(texts: list[str]):
    """Characters of all texts with a space in front, and their words: (chars, starts, ends, row of each word, place in its text)."""
    chars = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le"), np.uint32).astype(np.int64)
    space, other = np.flatnonzero(chars == 0x20), np.flatnonzero(chars == SPACE)
    chars[space], chars[other] = SPACE, OTHER_SPACE
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    row_start = np.cumsum(sizes) - sizes
    begin = np.zeros(len(chars), bool)
    space, line = chars == SPACE, chars == NEWLINE
    begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    begin[row_start[sizes > 0]] = True
    starts = np.flatnonzero(begin)
    rows = np.searchsorted(row_start[sizes > 0], starts, side="right") - 1
    rows = np.flatnonzero(sizes > 0)[rows] if len(starts) else rows
    return chars, starts, np.append(starts[1:], len(chars))[: len(starts)], rows, starts - row_start[rows]


def _distinct(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, equal in every character: (one word of each, which of them each word is)."""
    sizes = ends - starts
    word = pa.array(run_hashes(chars, starts, sizes)).dictionary_encode().indices.to_numpy().astype(np.int64)
    first = np.empty(word.max() + 1, np.int64)
    first[word[::-1]] = np.arange(len(word))[::-1]
    # the words that stand for others are compared with them
    same = sizes[first][word] == sizes
    if same.all():
        there = np.repeat(starts[first][word] - starts, sizes) + np.arange(len(chars))
        same = np.logical_and.reduceat(chars[there] == chars, starts)
    if same.all():
        return first, word
    names: dict[bytes, int] = {}
    word = np.array([names.setdefault(chars[a:b].tobytes(), len(names)) for a, b in zip(starts, ends, strict=True)])
    return np.unique(word, return_index=True)[1], word


def segment(vocabulary: Vocabulary, texts: list[str], seeds: np.ndarray, samples: int):
    """For each text its samples (ids, log chance, value) in the order drawn, and the value of the next one."""
    chars, starts, ends, rows, places = _words(texts)
    if not len(starts):
        return [([], -np.inf)] * len(texts)
    first, word = _distinct(chars, starts, ends)
    lattice = Lattice(vocabulary, chars, starts[first], ends[first])
    return _Search(vocabulary, lattice, seeds, word, rows, places).run(samples)


def sample_pieces(docs: DataFrame, model_path: str = MODEL, key_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES,
                  ids_of: int | None = None, packed: bool = False) -> DataFrame:
    """Distinct segmentations of each text, drawn without replacement by their probability.

    Adds ``segmentations``, in the order drawn: (n_pieces, log_prob, perturbed,
    log_inclusion, ids_sha256, decodes, ids). ``perturbed`` is the Gumbel value the
    order comes from; ``log_inclusion`` is the log of the chance that a
    segmentation's value exceeds the first value that was not drawn, 0 where
    nothing was left; ``ids_sha256`` digests the ids as 32-bit little-endian
    numbers; ``ids`` are filled for the first ``ids_of`` segmentations, all by
    default, as arrays, or ``packed`` as the bytes that are digested, which Spark
    passes on and writes far faster; ``decodes`` tells that the ids of this
    segmentation give the text back.

    The draw depends on the row's key and text alone, not on partitions. NULL and
    empty texts have no segmentation, texts with fewer segmentations have them all;
    a column named ``segmentations`` is replaced; rows with a NULL key share a seed;
    repeated rows get equal results. U+2581 in a text is written in bytes, so that
    every text is decoded to itself.

    Scale: one pass without a shuffle. The lattice is built once for each distinct
    word of some texts, words never sharing a piece, and their results go on before
    the next ones are read; memory follows LATTICE_BYTES, or one text where it is longer. The model file is read on the driver and
    broadcast, half a megabyte.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    entry = StructType([
        StructField("n_pieces", IntegerType()), StructField("log_prob", DoubleType()), StructField("perturbed", DoubleType()),
        StructField("log_inclusion", DoubleType()), StructField("ids_sha256", StringType()), StructField("decodes", BooleanType()),
        StructField("ids", BinaryType() if packed else ArrayType(IntegerType()))])
    arrow = pa.struct([
        ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()),
        ("ids_sha256", pa.string()), ("decodes", pa.bool_()), ("ids", pa.binary() if packed else pa.list_(pa.int32()))])
    keep = samples if ids_of is None else ids_of
    key = F.xxhash64(F.col(f"`{key_col}`"))
    rest = [c for c in docs.columns if c.lower() != "segmentations"]
    jobs = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.struct(F.col(f"`{text_col}`").alias("text"), key.alias("seed")).alias("job"))

    def make():
        vocabulary = vocabulary_of(model.value)

        def work(job: pa.Array) -> list[pa.Array]:
            texts, seeds = job.field("text"), job.field("seed").to_numpy(zero_copy_only=False).view(np.uint64)
            columns: list[list] = [[] for _ in range(6)]
            counts, kept, sizes = [], [], []
            for first, offsets, data in text_slices(texts, LATTICE_BYTES):
                own = [t or "" for t in texts.slice(first, len(offsets) - 1).to_pylist()]
                results = segment(vocabulary, own, mix(seeds[first : first + len(own)]), samples)
                whole = iter(vocabulary.spells([ids for drawn, _ in results for ids, _, _ in drawn], [
                    data[offsets[i] : offsets[i + 1]] for i, (drawn, _) in enumerate(results) for _ in drawn]))
                for drawn, after in results:
                    counts.append(len(drawn))
                    for nth, (ids, log_prob, value) in enumerate(drawn):
                        far = log_prob - after
                        inclusion = 0.0 if after == -np.inf else far if far < -30 else float(np.log(-np.expm1(-np.exp(min(far, 700.0)))))
                        sha = hashlib.sha256(ids.astype("<i4", copy=False)).hexdigest()
                        for column, v in zip(columns, (len(ids), log_prob, value, inclusion, sha, next(whole))):
                            column.append(v)
                        sizes.append(len(ids) if nth < keep else -1)
                        if nth < keep:
                            kept.append(ids)
            missing, numbers = np.array(sizes, np.int64) < 0, np.concatenate(kept) if kept else np.zeros(0, np.int32)
            ends = np.append(0, np.cumsum(np.maximum(sizes, 0)))
            if packed:
                ids_of_all = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
                    pa.array(~missing).buffers()[1], pa.py_buffer(ends * 4), pa.py_buffer(numbers.astype("<i4", copy=False))]).cast(pa.binary())
            else:
                ids_of_all = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()), mask=pa.array(missing))
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)] + [ids_of_all], fields=list(arrow))
            return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)]

        return work

    def cut(job: pa.Array):
        return ((first, len(offsets) - 1) for first, offsets, _ in text_slices(job.field("text"), LATTICE_BYTES))

    done = map_text(jobs, "job", [StructField("segmentations", ArrayType(entry))], make, cut)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], "segmentations")


def decode_pieces(rows: DataFrame, ids_col: str, model_path: str = MODEL, out_col: str = "decoded") -> DataFrame:
    """Add the text of a column of piece ids, arrays or packed; NULL stays NULL, unknown ids are empty."""
    with open(model_path, "rb") as file:
        model = rows.sparkSession.sparkContext.broadcast(file.read())

    def make():
        vocabulary = vocabulary_of(model.value)

        def numbers(r):
            return np.frombuffer(r, "<i4").tolist() if isinstance(r, bytes) else [i for i in r if i is not None]

        return lambda ids: [pa.array([None if r is None else vocabulary.decode(numbers(r)) for r in ids.to_pylist()], pa.string())]

    return map_text(rows, ids_col, [StructField(out_col, StringType())], make)
