"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import components, hash_pair, sorted_groups, stored

#: Width of a quantisation step on unit vectors, and the vectors a bucket should hold.
WIDTH, BUCKET = 2.0, 64
#: Vectors compared as one block; a larger bucket is dealt out as pairs of blocks.
BLOCK = 1024
#: Probability that a pair exactly at the threshold shares a bucket.
RECALL = 0.999


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection puts two points of this distance together."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def settings(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections in a table, and tables: buckets of unrelated vectors hold about BUCKET, whatever the row count."""
    far = collision(math.sqrt(2))
    size = max(2, math.ceil(math.log(max(rows, 1) / BUCKET) / -math.log(far))) if rows > BUCKET else 2
    near = collision(math.sqrt(2 - 2 * threshold)) ** size
    return size, math.ceil(math.log(1 - recall) / math.log1p(-near))


def bucket_keys(unit: np.ndarray, size: int, tables: int, seed: int) -> np.ndarray:
    """Bucket of each unit vector in each table, as 32-bit keys."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    lines = rng.standard_normal((unit.shape[1], size * tables))
    steps = np.floor((unit @ lines) / WIDTH + rng.random(size * tables)).astype(np.int64).reshape(len(unit), tables, size)
    key = np.full((len(unit), tables), unit.shape[1], np.uint64)
    for k in range(size):
        key = (key ^ steps[:, :, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(16)).astype(np.uint32).view(np.int32)


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _deal(size: int, tables: int, seed: int):
    """A row for each vector and table: (tab, key, rep, copies, vector, keys)."""
    names = ["tab", "key", "rep", "copies", "vector", "keys"]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                vectors = part.column(2)
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                for length in np.unique(lengths):
                    rows = np.flatnonzero(lengths == length)
                    own = part.take(pa.array(rows))
                    flat = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                    keys = bucket_keys(_unit(flat.astype(np.float64)), size, tables, seed)
                    again = pa.array(np.repeat(np.arange(len(rows)), tables))
                    wide = own.take(again)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(keys.reshape(-1)),
                        wide.column(0), wide.column(1), wide.column(2),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * tables + 1, tables, dtype=np.int32)), pa.array(keys.reshape(-1))).take(again),
                    ], names=names)

    return run


def _compare(threshold: float):
    """Links inside each bucket or pair of blocks: (node, links, root) for every vector that has some.

    A pair that meets in several tables is counted in the first of them only.
    """

    def run(batches):
        for group in sorted_groups(batches, 4):
            tab, low, high = (group.column(i)[0].as_py() for i in (0, 2, 3))
            rep, copies = group.column(4).to_numpy(), group.column(5).to_numpy()
            block = group.column(6).to_numpy()
            n = group.num_rows
            unit = _unit(group.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64))
            keys = group.column(8).combine_chunks().flatten().to_numpy().reshape(n, -1)
            a = np.flatnonzero(block == low)
            b = np.flatnonzero(block == high)
            near = unit[a] @ unit[b].T >= threshold
            x, y = np.nonzero(near)
            x, y = a[x], b[y]
            pick = rep[x] < rep[y] if low == high else rep[x] != rep[y]
            x, y = x[pick], y[pick]
            if not len(x):
                continue
            fresh = ~(keys[x, :tab] == keys[y, :tab]).any(axis=1) if tab else np.ones(len(x), bool)
            links = np.bincount(x[fresh], copies[y[fresh]], n) + np.bincount(y[fresh], copies[x[fresh]], n)
            root = np.arange(n)
            while True:
                least = root.copy()
                np.minimum.at(least, x, root[y])
                np.minimum.at(least, y, root[x])
                least = least[least]
                if (least == root).all():
                    break
                root = least
            ends = np.union1d(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(rep[ends]), pa.array(links[ends].astype(np.int64)), pa.array(rep[root[ends]])], names=["node", "links", "root"])

    return run


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                    recall: float = RECALL, seed: int = 7) -> DataFrame:
    """Link vectors whose cosine, in double precision, is at least ``threshold``.

    Quantised random projections bucket the unit vectors in several tables; pairs
    that share a bucket are checked exactly. A pair exactly at the threshold is
    found with probability ``recall``, a closer one more surely.

    Returns a row per input row: the id, ``n_links`` (other ids linked directly),
    ``component_id`` (smallest id reachable) and ``kept``. NULL and zero vectors,
    vectors with NULL or non-finite components and rows with a NULL id link with
    nothing; vectors of different lengths do not link. Rows that repeat an id and
    a vector are one vector.

    Scale: equal vectors are merged before anything else, so a vector that a third
    of the rows hold is one node with a count. Buckets over BLOCK vectors become
    pairs of blocks in tasks of their own. No pair leaves its task: per task and
    node only a sum of links and one tree edge.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("vector"))
    sound = (
        F.col("id").isNotNull() & F.col("vector").isNotNull()
        & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("vector", lambda v: v != 0)
    )
    h = hash_pair(F.col("vector"))
    marked = base.select("id", "vector", F.coalesce(sound, F.lit(False)).alias("sound")).select(
        "id", "vector", "sound", F.when(F.col("sound"), h[0]).alias("h0"), F.when(F.col("sound"), h[1]).alias("h1"))
    classes = stored(
        marked.where("sound").groupBy("h0", "h1").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "classes")
    nodes = stored(
        marked.where("sound").join(classes, (marked["id"] == classes["rep"]) & (marked["h0"] == classes["h0"]) & (marked["h1"] == classes["h1"]))
        .select("rep", "copies", "vector").dropDuplicates(["rep"]), "nodes")
    size, tables = settings(nodes.count(), threshold, recall)
    kind = vectors.schema[vec_col].dataType.simpleString()
    dealt = nodes.mapInArrow(_deal(size, tables, seed), f"tab int, key int, rep long, copies long, vector {kind}, keys array<int>")
    large = (
        nodes.mapInArrow(_deal(size, tables, seed), f"tab int, key int, rep long, copies long, vector {kind}, keys array<int>")
        .groupBy("tab", "key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select("tab", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    spread = dealt.join(stored(large, "large"), ["tab", "key"], "left").select(
        "tab", "key", "rep", "copies", "vector", "keys", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep", "tab"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = spread.select(
        "tab", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "rep", "copies", "block", "vector", "keys")
    group = ["tab", "key", "low", "high"]
    found = stored(
        keyed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), "node long, links long, root long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_class = (
        classes.join(links, classes["rep"] == links["node"], "left").drop("node")
        .join(linked, classes["rep"] == linked["node"], "left")
        .select("h0", "h1", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    out = marked.drop("vector").join(per_class, ["h0", "h1"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
