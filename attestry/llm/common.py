"""Helpers shared by the text operators: row-wise Arrow maps, stored tables, connected components."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from attestry.session import fresh_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one step inside a task works on; a longer text is one step of its own.
SLICE_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: later passes see the same rows, pruned and pushed down."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, size: int):
    """Jobs run inside hand ``rows`` rows and about ``size`` bytes at most to Python at once; the session's settings come back."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def hash_pair(*columns: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds: 128 bits of identity."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)]


def replaced(schema: StructType, added: list[StructField]) -> list[str]:
    """The columns that stay when ``added`` ones come; a column of the same name gives way."""
    names = {f.name.lower() for f in added}
    return [f.name for f in schema if f.name.lower() not in names]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a text column: (first row, row offsets into the bytes, the bytes). NULL has no bytes."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]]
        first = last


def map_text(df: DataFrame, text_col: str, added: list[StructField], make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
             cut: Callable[[pa.Array], Iterator[tuple[int, int]]] | None = None) -> DataFrame:
    """Add columns computed from one text column, row by row, in Arrow batches.

    ``make`` runs once in each task and returns the function from a batch of
    texts to the added columns. Every other column passes through untouched.
    ``cut`` gives the parts (first row, rows) that a batch is worked on and
    returned in, where its results are large; else a batch is one part.
    """
    keep = replaced(df.schema, added)
    schema = StructType([df.schema[c] for c in keep] + added)
    extra = text_col not in keep
    source = df.select(*[F.col(f"`{c}`") for c in keep], *([F.col(f"`{text_col}`")] if extra else []))
    at = len(keep) if extra else keep.index(text_col)
    width = len(keep)

    def run(batches):
        work = make()
        for batch in batches:
            if batch.num_rows:
                for first, count in cut(batch.column(at)) if cut else [(0, batch.num_rows)]:
                    part = batch.slice(first, count)
                    columns = [part.column(i) for i in range(width)] + work(part.column(at))
                    yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


#: Edges that one task contracts at once, in about 140 bytes for each.
EDGES_AT_ONCE = 1 << 21


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges (a, b), sorted, and for each the smallest id that these edges connect it to."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends, 2)
    root = np.arange(len(ids))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high != low
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
    return ids, ids[root]


def _forest(whole: bool, at_once: int):
    """Edges (node, component) in place of edges (a, b), ``at_once`` of them at a time; ``whole`` keeps the smallest ids themselves, too."""

    def run(batches):
        held, count = [], 0

        def emit():
            node, component = contract(*(np.concatenate(x) for x in zip(*held)))
            keep = slice(None) if whole else node != component
            return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(component[keep])], names=["node", "component"])

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                if held and count + part.num_rows > at_once:
                    yield emit()
                    held, count = [], 0
                held.append([part.column(i).to_numpy(zero_copy_only=False) for i in range(2)])
                count += part.num_rows
        if held:
            yield emit()

    return run


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every end of an undirected edge list (a, b): columns (node, component).

    Every task first puts a forest in the place of its edges. Once EDGES_AT_ONCE
    edges or fewer are left, one task finishes them; a round of what follows
    costs the driver a dozen stages. Longer lists go through alternating star
    contraction: every node hangs its larger neighbours, then its smaller ones,
    under the smallest id it sees, until nothing changes. Each round is an
    aggregate and a join; no neighbour list is ever collected.
    """
    spark = edges.sparkSession
    schema = StructType([StructField("node", LongType()), StructField("component", LongType())])

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        moved = joined.where("b > a") if large else joined
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            out = out.union(least.select("a", F.col("m").alias("b")))
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    ends = F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")
    oriented = edges.select(*ends).where("a <> b").distinct()
    current = stored(oriented.mapInArrow(_forest(False, EDGES_AT_ONCE), schema).toDF("a", "b"), "edges")
    mark = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen[0] <= EDGES_AT_ONCE:
            return current.coalesce(1).mapInArrow(_forest(True, EDGES_AT_ONCE), schema)
        if seen == mark:
            break
        mark = seen
        current = stored(star(star(current, True), False), "edges")
    empty = spark.createDataFrame([], schema)
    return empty.union(current.select("a", "b")).union(current.select("b", "b").distinct())


# --- words and shingles of many texts at once -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that are part of a word: anything but blanks, or letters and digits and all of non-ASCII.
NOT_BLANK = np.array([b != 0x20 and not 0x09 <= b <= 0x0D for b in range(256)])
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    out = x >> np.uint64(30)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n, or further, of the base of rolling hashes, and of its inverse."""
    if len(_POWERS[0]) <= n:
        for i, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS


def run_hashes(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run of values, runs laid end to end: the sum of scrambled (place in the run, value) pairs.

    Every pair is scrambled before it is added, so runs whose values follow a
    pattern collide no more often than others. Values have 32 bits at most.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(values)) - np.repeat(starts, lengths)
    pairs = (place.astype(np.uint64) << np.uint64(32)) | values.astype(np.uint64)
    return mix(np.add.reduceat(mix(pairs + _BASE), starts) + lengths.astype(np.uint64))


def word_hashes(offsets: np.ndarray, data: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased: (row offsets into the words, hashes)."""
    if not len(data):
        return np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    folded = _FOLD[data]
    inside = word_bytes[folded]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    # places of the words among the bytes inside words
    first = np.cumsum(inside)[starts] - 1
    letters = folded[inside]
    return np.searchsorted(starts, offsets), run_hashes(letters, first, np.diff(np.append(first, len(letters))))


def shingle_hashes(offsets: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words, in text order: (row offsets, hashes).

    A row with fewer words, but some, has one shingle of all of them.
    """
    counts = np.diff(offsets)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.repeat(np.arange(len(counts)), sizes)
    first = offsets[:-1][rows] + np.arange(out[-1]) - out[:-1][rows]
    total = np.zeros(len(first), np.uint64)
    length = np.minimum(counts, n)[rows]
    for k in range(n):
        if len(first) and (length.min() <= k):
            use = length > k
            total[use] = mix(total[use] + words[first[use] + k] + np.uint64(k + 1))
        elif len(first):
            total = mix(total + words[first + k] + np.uint64(k + 1))
    return out, total


# --- bitmaps: bounded broadcasts that only save work ------------------------------------------

#: Slots of a bitmap. It is broadcast as 16 MB at most, whatever the data; when it fills up, more rows pass it.
BITMAP_BITS = 27


def bitmap_of(hashes: Column, df: DataFrame) -> np.ndarray:
    """Bitmap of a column of well-mixed 64-bit hashes, put together from pieces of 4 KB that Spark aggregates."""
    slot = F.shiftrightunsigned(hashes, 64 - BITMAP_BITS) + 1
    pieces = df.groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for piece, packed in pieces.mapInArrow(_deflated, "piece long, packed binary").collect():
        bits = np.frombuffer(zlib.decompress(packed), np.uint8)
        out[(piece - 1) * len(bits) : piece * len(bits)] = bits
    return out


def _deflated(batches):
    """Pieces of a bitmap as the driver gets them: most bits are zero."""
    for batch in batches:
        packed = [zlib.compress(bits.as_buffer(), 1) for bits in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["piece", "packed"])


def bitmap_holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def sorted_groups(batches, keys: int, least: int = 2):
    """Whole groups of equal leading columns out of batches sorted by them; groups under ``least`` rows are left out."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        columns = [table.column(k).to_numpy() for k in range(keys)]
        change = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [table.num_rows]])
        for i in np.flatnonzero(np.diff(bounds[:-1]) >= least):
            yield table.slice(bounds[i], bounds[i + 1] - bounds[i])
        held = table.slice(bounds[-2])
    if held is not None and held.num_rows >= least:
        yield held
