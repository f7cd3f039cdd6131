"""Cut out long byte strings that occur more than once, by anchors and hash ranks at fixed lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from attestry.llm.common import bitmap_holds, bitmap_of, hash_pair, map_text, mix, powers, stored, text_slices

#: Positions of one text that are worked on at a time; a longer text is cut into such pieces.
PIECE = 1 << 19
#: Bytes of shorter pieces that are laid end to end and worked on at once.
GROUP = 1 << 17
#: Low bits of a rank that give way to its place in the piece.
PLACE = np.uint64((1 << 20) - 1)
#: Neighbouring positions that are ranked together.
CELL = 16


class Ranks:
    """Ranks of substrings of one piece of text: equal strings have equal ranks, whatever document they are in."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        """Ranks of the strings of ``size`` bytes at these positions."""
        return mix(((self.total[start + size] - self.total[start]) * self.down[start]) ^ np.asarray(size, np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Ranks of the strings of ``size`` bytes at all positions."""
        n = len(self.total) - size
        return mix(((self.total[size:] - self.total[:n]) * self.down[:n]) ^ np.uint64(size))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours."""
    n = len(values) - width + 1
    fill = np.full(-len(values) % width, values[-1], values.dtype)
    rows = np.concatenate([values, fill]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Pieces:
    """Pieces of texts laid end to end: their bytes, where each begins and ends, its text's class, and its place in the text."""

    def __init__(self, parts: list[tuple[int, int, int, np.ndarray]]):
        self.c0, self.c1, self.begin = (np.array([p[k] for p in parts], np.int64) for k in range(3))
        self.data = np.concatenate([p[3] for p in parts]) if len(parts) > 1 else parts[0][3]
        self.offsets = np.concatenate([[0], np.cumsum([len(p[3]) for p in parts])])

    def in_text(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places in their texts of places in these bytes."""
        return at + (self.begin - self.offsets[:-1])[own]

    def places(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        return place(self.c0[own], self.c1[own], self.in_text(at, own))


def runs_of(data: np.ndarray, size: int, short: int):
    """:func:`runs_in` for one text, piece by piece: (piece offset, ranks, anchors, their places, first positions, ends)."""
    for begin in range(0, len(data) - size + 1, PIECE):
        yield begin, *runs_in(Pieces([(0, 0, begin, data[begin : begin + PIECE + size - 1])]), size, short)[:-1]


def runs_in(pieces: Pieces, size: int, short: int):
    """Cut the positions of pieces into runs that share the place of their least rank of ``short`` bytes within ``size`` bytes.

    Returns (ranks, anchors, their places, first positions, ends, number of the piece).
    Only strings that end within their piece count. The anchor and its distance depend
    on the ``size`` bytes alone, so equal strings have equal anchors at equal distances,
    and two equal strings of one text are in different runs.
    """
    ranks = Ranks(pieces.data)
    names = ranks.every(short)
    least = _sliding_min((names & ~PLACE) | np.arange(len(names), dtype=np.uint64), size - short + 1)
    new = np.concatenate([[True], least[1:] != least[:-1]])
    new[pieces.offsets[:-1]] = True
    first = np.flatnonzero(new)
    own = np.searchsorted(pieces.offsets, first, side="right") - 1
    # a string that would reach into the next piece is none
    whole = pieces.offsets[1:][own] - size + 1
    ends = np.minimum(np.append(first[1:], len(least)), whole)
    some = ends > first
    first, ends, own = first[some], ends[some], own[some]
    spots = (least[first] & PLACE).astype(np.int64)
    return ranks, names[spots], spots, first, ends, own


def _alike(values: np.ndarray, own: np.ndarray):
    """Groups of equal values of one piece: (order that brings them together, keeping their order, first of each group, sizes)."""
    order = np.lexsort((values, own))
    v, o = values[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
    return order, first, np.diff(np.append(first, len(order)))


def cells_of(spots: np.ndarray, first: np.ndarray, ends: np.ndarray, cell: int):
    """Cut runs into cells of ``cell`` distances from the anchor: (run, cell number, first position, last position)."""
    low, high = (spots - ends + 1) // cell, (spots - first) // cell
    count = high - low + 1
    run = np.repeat(np.arange(len(spots)), count)
    number = high[run] - (np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count))
    lo = np.maximum(first[run], spots[run] - cell * number - cell + 1)
    return run, number, lo, np.minimum(ends[run] - 1, spots[run] - cell * number)


def _pieces(batches, size: int):
    """Every text that is long enough, in pieces: long ones alone, others by the group."""
    parts, held = [], 0
    for batch in batches:
        c0, c1 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        for first, offsets, data in text_slices(batch.column(0)):
            for i in np.flatnonzero(np.diff(offsets) >= size):
                text = data[offsets[i] : offsets[i + 1]]
                for begin in range(0, len(text) - size + 1, PIECE):
                    part = text[begin : begin + PIECE + size - 1]
                    if held and held + len(part) > GROUP:
                        yield Pieces(parts)
                        parts, held = [], 0
                    parts.append((c0[first + i], c1[first + i], begin, part))
                    held += len(part)
    if parts:
        yield Pieces(parts)


def place(c0, c1, at):
    """A 64-bit name for a position of a text."""
    c0, c1, at = (np.asarray(x, np.int64).view(np.uint64) for x in (c0, c1, at))
    return mix(mix(c0 ^ mix(at)) + c1)


def _flush(parts: list[list[np.ndarray]], names: list[str], least: int = 0):
    if parts and (not least or sum(len(p[0]) for p in parts) >= least):
        columns = [np.concatenate(c) for c in zip(*parts)]
        parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _anchors(size: int, short: int):
    """(anchor, place) of the runs; a text names two places at most of an anchor that it repeats."""
    names = ["anchor", "place"]

    def run(batches):
        parts: list[list[np.ndarray]] = []
        for pieces in _pieces(batches, size):
            _, anchors, _, first, _, own = runs_in(pieces, size, short)
            order, group, times = _alike(anchors, own)
            some = times > 1
            at = np.concatenate([order[group], order[(group + times - 1)[some]]])
            parts.append([anchors[at], pieces.places(first[at], own[at])])
            yield from _flush(parts, names, 1 << 16)
        yield from _flush(parts, names)

    return run


def _open_cells(batches, size: int, short: int, cell: int, repeated, outer):
    """Cells of all runs that the bitmaps let through: repeated anchors, and open runs where that is known.

    Yields (pieces, ranks, anchor, anchor's place, cell number, first and last position, number of the piece).
    """
    bits, open_runs = repeated.value, outer and outer.value
    for pieces in _pieces(batches, size):
        ranks, anchors, spots, first, ends, own = runs_in(pieces, size, short)
        use = np.flatnonzero(bitmap_holds(bits, anchors))
        if open_runs is not None:
            use = use[bitmap_holds(open_runs, pieces.places(first[use], own[use]))]
        if len(use):
            run, number, lo, hi = cells_of(spots[use], first[use], ends[use], cell)
            yield pieces, ranks, anchors[use][run], spots[use][run], number, lo, hi, own[use][run]


def _cells(size: int, short: int, cell: int, repeated, outer=None):
    """(core, whole, place, c0, c1, lo, hi, sure) of open cells.

    ``core`` ranks the bytes that all strings of a full cell share, ``whole`` all
    bytes that the cell's own strings cover, from ``lo`` to ``hi``. Cells that a text
    itself repeats are covered for sure, and only one of them stands for all.
    """
    names = ["core", "whole", "place", "c0", "c1", "lo", "hi", "sure"]

    def run(batches):
        parts: list[list[np.ndarray]] = []
        for pieces, ranks, anchors, spots, number, lo, hi, own in _open_cells(batches, size, short, cell, repeated, outer):
            core = mix(mix(anchors ^ number.astype(np.uint64)) + ranks.of(spots - cell * number, size - cell + 1))
            hi = hi + size
            whole = ranks.of(lo, hi - lo)
            order, group, times = _alike(whole, own)
            at, again = order[group], order[np.repeat(times > 1, times)]
            # a gap between pieces keeps their runs apart
            sure = merge(lo[again] + own[again], hi[again] + own[again]) if len(again) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            sure_own = np.searchsorted(pieces.offsets[:-1] + np.arange(len(pieces.begin)), sure[0], side="right") - 1
            lo, hi = np.concatenate([lo[at], sure[0] - sure_own]), np.concatenate([hi[at], sure[1] - sure_own])
            own = np.concatenate([own[at], sure_own])
            none = np.zeros(len(sure_own), np.uint64)
            parts.append([
                np.concatenate([core[at], none]), np.concatenate([whole[at], none]), pieces.places(lo, own),
                pieces.c0[own], pieces.c1[own], pieces.in_text(lo, own), pieces.in_text(hi, own), np.arange(len(lo)) >= len(at)])
            yield from _flush(parts, names, 1 << 16)
        yield from _flush(parts, names)

    return run


def _positions(size: int, short: int, cell: int, repeated, outer, opened):
    """Positions of open cells, as rank pairs: (r0, r1, c0, c1, at).

    The pair holds the ranks of the string's first and last two thirds, which
    overlap, so equal pairs are equal strings.
    """
    names = ["r0", "r1", "c0", "c1", "at"]
    half = max(size - size // 3, 1)

    def run(batches):
        bits = opened.value
        parts: list[list[np.ndarray]] = []
        for pieces, ranks, _, _, _, lo, hi, own in _open_cells(batches, size, short, cell, repeated, outer):
            pick = bitmap_holds(bits, pieces.places(lo, own))
            lo, lengths = lo[pick], (hi - lo + 1)[pick]
            if len(lo):
                own = np.repeat(own[pick], lengths)
                at = np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                parts.append([ranks.of(at, half), ranks.of(at + size - half, half), pieces.c0[own], pieces.c1[own], pieces.in_text(at, own)])
            yield from _flush(parts, names, 1 << 17)
        yield from _flush(parts, names)

    return run


def _level(texts: DataFrame, task, label: str) -> tuple[DataFrame, np.ndarray]:
    """Rank cells over all texts: what is repeated as a whole (c0, c1, lo, hi), and a bitmap of the cells left open.

    Open are cells that share their core with a different cell, one of each kind.
    """
    cells = stored(texts.mapInArrow(
        task, "core long, whole long, place long, c0 long, c1 long, lo long, hi long, sure boolean"), label)
    whole = stored(cells.where("not sure").groupBy("core", "whole").agg(F.min("place").alias("least"), F.max("place").alias("most")), f"{label}-ranks")
    several = whole.groupBy("core").agg(F.min("whole").alias("a"), F.max("whole").alias("b")).where("a <> b").select("core")
    opened = bitmap_of(F.col("least"), whole.join(several, "core", "left_semi"))
    again = cells.where("not sure").join(whole.where("least <> most").select("core", "whole"), ["core", "whole"], "left_semi")
    return again.select("c0", "c1", "lo", "hi").union(cells.where("sure").select("c0", "c1", "lo", "hi")), opened


def merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    return lo[new], np.append(hi[:-1][new[1:]], hi[-1])


def suffix_dedup(docs: DataFrame, text_col: str = "text", size: int = 400) -> DataFrame:
    """Remove every byte that lies in a string of ``size`` bytes which also starts anywhere else.

    Texts are UTF-8 bytes; matches never cross documents; strings are judged on the
    input. Returns the columns of ``docs`` and ``kept`` (the remaining bytes),
    ``n_bytes``, ``n_removed`` and ``spans`` (maximal removed runs, end exclusive);
    columns of these names are replaced. NULL and empty texts have no bytes;
    repeated rows are documents of their own, so long ones vanish in all rows.

    Method: in place of prefix doubling, ranks at a few fixed lengths that are rolling
    hashes of the strings, so that Spark brings equal ranks together without ordering unequal ones. Every
    position is named by the least rank of ``size`` / 3 bytes inside its string, its
    anchor, and its distance from there, which equal strings share. Anchors found at
    one place only are unique and drop out. The others' positions are ranked on, at
    growing lengths: all neighbours of one anchor by the bytes their strings cover,
    then neighbours in cells by the bytes they all share, ``size`` - CELL + 1, and by
    all their bytes. What occurs again as a whole is repeated as a whole; what shares
    its core with nothing drops out. The positions of what is left are ranked by
    pairs of ranks that reach the full ``size``, and those whose pair occurs at
    another place are repeated.

    Scale: equal texts are one class; what is shuffled are some rows per ``size``
    bytes, then the runs of repeated anchors, then the open cells and positions. All
    counting is by partial aggregates of a smallest and a largest place. A task works
    on GROUP bytes of texts at once, or on one piece of a longer text. Three bitmaps
    of 16 MB are broadcast; they only keep rows that cannot matter from being written.
    """
    spark = docs.sparkSession
    short = max(1, size // 3)
    text = F.col(f"`{text_col}`")
    c0, c1 = hash_pair(text)
    texts = docs.select(text.alias("text"), c0.alias("c0"), c1.alias("c1")).where(F.octet_length("text") >= size)

    anchors = texts.mapInArrow(_anchors(size, short), "anchor long, place long").groupBy("anchor").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    share = spark.sparkContext.broadcast
    repeated = share(bitmap_of(F.col("anchor"), anchors.where("lo <> hi")))
    runs, open_runs = _level(texts, _cells(size, short, size - short + 1, repeated), "runs")
    open_runs = share(open_runs)
    cell = min(CELL, size - short + 1)
    cells, open_cells = _level(texts, _cells(size, short, cell, repeated, open_runs), "cells")
    open_cells = share(open_cells)
    spots = stored(texts.mapInArrow(_positions(size, short, cell, repeated, open_runs, open_cells), "r0 long, r1 long, c0 long, c1 long, at long"), "positions")
    where = F.xxhash64("c0", "c1", "at")
    shared = spots.groupBy("r0", "r1").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("r0", "r1")
    loose = spots.join(shared, ["r0", "r1"], "left_semi").select("c0", "c1", F.col("at").alias("lo"), (F.col("at") + size).alias("hi"))
    cuts = runs.union(cells).union(loose).groupBy("c0", "c1").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    copies = texts.groupBy("c0", "c1").agg(F.count("*").alias("n")).where("n > 1")
    marks = cuts.join(copies, ["c0", "c1"], "full").select("c0", "c1", "cuts", F.col("n").isNotNull().alias("copied"))

    rest = [c for c in docs.columns]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), c0.alias("c0"), c1.alias("c1"))
    jobs = wide.join(marks, ["c0", "c1"], "left").select(
        "row", F.struct(F.col(f"row.`{text_col}`").alias("text"), F.col("cuts.lo").alias("lo"), F.col("cuts.hi").alias("hi"), F.coalesce("copied", F.lit(False)).alias("copied")).alias("job"))
    span = StructType([StructField("lo", LongType()), StructField("hi", LongType())])
    added = [StructField("kept", BinaryType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("spans", ArrayType(span))]
    arrow = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def make():
        def work(job: pa.Array) -> list[pa.Array]:
            kept, n_bytes, n_removed, spans = [], [], [], []
            for text, los, his, copied in zip(*(job.field(k) for k in ("text", "lo", "hi", "copied"))):
                data = text.cast(pa.binary()).as_py() or b""
                lo, hi = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if copied.as_py() and len(data) >= size:
                    lo, hi = np.array([0]), np.array([len(data)])
                elif los.is_valid and len(los):
                    lo, hi = merge(los.values.to_numpy(), his.values.to_numpy())
                edges = [0, *np.stack([lo, hi], axis=1).reshape(-1).tolist(), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                spans.append([{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())])
            return [pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, arrow)]

        return work

    done = map_text(jobs, "job", added, make)
    gone = {f.name for f in added}
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest if c.lower() not in gone], *[f.name for f in added])
