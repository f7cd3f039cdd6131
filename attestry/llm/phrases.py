"""Collocations: phrases that hold together, counted exactly with counting quotient filters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import join_dimension
from attestry.llm import quotient_filter as qf
from attestry.llm.common import arrow_batches, bitmap_holds, bitmap_of, mix, stored, text_slices

#: Language of a document whose language is NULL.
NO_LANGUAGE = "und"
#: Longest phrase, in words.
LONGEST = 4
#: Bytes of text that share one table of local word numbers.
SHARD_BYTES = 2 << 20
#: Entries that a task gathers in one filter before it is written, that a segment should hold after the merge, and that
#: filters of a segment are merged at.
FILTER_ENTRIES, SEGMENT_ENTRIES, MERGE_ENTRIES = 1 << 20, 1 << 20, 1 << 19
#: Rows and bytes that go to a Python worker at once, and text that it gathers for shards of all languages together.
BATCH_ROWS, BATCH_BYTES, HELD_BYTES = 1000, 4 << 20, 8 << 20
#: A lookup of more bytes than this is joined by a shuffle.
LOOKUP_BYTES = 8 << 20

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_OUTSIDE = _CUT.copy()
_OUTSIDE[[0x20, 0x09]] = True


def _words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: (bytes of the words, their lengths, first byte of each, number of its piece)."""
    folded = _FOLD[data]
    inside = ~_OUTSIDE[folded]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    # 32 bits hold the places of any text, and half the memory
    taken = np.cumsum(inside, dtype=np.int32)
    first = taken[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(first, taken[-1] if len(taken) else 0))
    cuts = np.cumsum(_CUT[folded], dtype=np.int32)
    piece = cuts[starts] + np.searchsorted(offsets, starts, side="right") if len(starts) else np.zeros(0, np.int64)
    return folded[inside], lengths, starts, piece


def _shards(limit: int):
    """Texts of one language, some MB of them, as local word numbers with 0 between pieces, and the words with their counts."""

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def written(lang: str):
            nonlocal number
            sizes.pop(lang)
            for _, offsets, data in text_slices(pa.concat_arrays(held.pop(lang)), limit):
                kept, lengths, _, piece = _words(offsets, data)
                if not len(lengths):
                    continue
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
                coded = column.dictionary_encode()
                codes = coded.indices.to_numpy()
                fresh = np.flatnonzero(piece[1:] != piece[:-1]) + 1
                sequence = np.insert(codes + 1, fresh, 0)
                wide = len(coded.dictionary) >= 1 << 16
                words = coded.dictionary.cast(pa.large_string()).cast(pa.string())
                counts = pa.array(np.bincount(codes, minlength=len(words)))
                one = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([(task << 40) + number], pa.int64()), pa.array([lang]), pa.array([wide]),
                    pa.array([sequence.astype("<u4" if wide else "<u2").tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, counts),
                ], names=["shard", "lang", "wide", "sequence", "words", "counts"])
                number += 1

        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(0).take(pa.array(np.flatnonzero(langs.indices.to_numpy() == k)))
                if sizes.get(lang, 0) and sizes[lang] + texts.nbytes > limit:
                    yield from written(lang)
                held.setdefault(lang, []).append(texts)
                sizes[lang] = sizes.get(lang, 0) + texts.nbytes
            if sum(sizes.values()) >= HELD_BYTES:
                for lang in list(sizes):
                    if len(sizes) > 1 and sum(sizes.values()) < HELD_BYTES // 2:
                        break
                    yield from written(max(sizes, key=sizes.get))
        for lang in list(sizes):
            yield from written(lang)

    return run


def _resolve(batches):
    """Local word numbers turned into those of the whole corpus; a word that has none becomes 0."""
    for batch in batches:
        for i in range(batch.num_rows):
            wide, sequence, pairs = (batch.column(k)[i] for k in range(3))
            local = np.frombuffer(sequence.as_buffer(), "<u4" if wide.as_py() else "<u2")
            if pairs.values is None:
                continue
            table = np.zeros(int(local.max()) + 1, "<u4")
            place, number = (f.to_numpy(zero_copy_only=False) for f in pairs.values.flatten())
            table[place + 1] = number
            yield pa.RecordBatch.from_arrays([pa.array([table[local].tobytes()], pa.binary())], names=["sequence"])


def _grams(sequence: np.ndarray, size: int, bits: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of words in two halves: pairs for ``size`` 2, else runs of three (the fourth place 0) and of four.

    ``frequent`` is a bitmap of pairs: a longer run is left out if one of its pairs is surely not frequent.
    """
    ids = sequence.astype(np.uint64)
    whole = ids != 0
    pair = whole[:-1] & whole[1:]
    if size == 2:
        return ids[:-1][pair], ids[1:][pair]
    at = np.flatnonzero(pair)
    high, low = qf.permute(ids[at], ids[at + 1], bits)
    pair[at] = bitmap_holds(frequent, mix((high << np.uint64(bits)) | low))
    joined = (ids[:-1] << np.uint64(bits)) | ids[1:]
    three = np.flatnonzero(pair[:-1] & pair[1:])
    four = three[:-1][np.diff(three) == 1]
    return (np.concatenate([joined[three], joined[four]]),
            np.concatenate([ids[three + 2] << np.uint64(bits), joined[four + 2]]))


def _filters(size: int, bits: int, segment_bits: int, entries: int, frequent=None):
    """Filters of the runs in stored sequences, one for ``entries`` of them, cut into segments: (segment, filter)."""
    width = bits if size == 2 else 2 * bits

    def run(batches):
        held = frequent.value if frequent is not None else None
        parts, size_of = [], 0

        def written():
            for number, part in qf.segments(qf.merge(parts, width), width, segment_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([qf.pack(part, width, segment_bits)], pa.binary())], names=["segment", "filter"])

        for batch in batches:
            for i in range(batch.num_rows):
                sequence = np.frombuffer(batch.column(0)[i].as_buffer(), "<u4")
                if len(sequence) < size:
                    continue
                parts.append(qf.count_keys(*_grams(sequence, size, bits, held), width))
                size_of += len(parts[-1])
                if size_of >= entries:
                    parts = [qf.merge(parts, width)]
                    size_of = len(parts[0])
                    if size_of >= entries // 2:
                        yield from written()
                        parts, size_of = [], 0
        yield from written()

    return run


def _merged(size: int, bits: int, segment_bits: int, least: int, entries: int):
    """Filters sorted by segment, merged; runs with at least ``least`` occurrences: (w1, w2, w3, w4, f, h)."""
    width = bits if size == 2 else 2 * bits

    def out(number: int, parts: list[qf.Counts]):
        whole = qf.merge(parts, width)
        keep = np.flatnonzero(whole.count >= least)
        mixed = mix((whole.high[keep] << np.uint64(bits)) | whole.low[keep])
        high, low = qf.restore(whole.high[keep], whole.low[keep], width)
        if size == 2:
            ids = [high, low, np.zeros_like(high), np.zeros_like(high)]
        else:
            mask, move = np.uint64((1 << bits) - 1), np.uint64(bits)
            ids = [high >> move, high & mask, low >> move, low & mask]
        for start in range(0, len(keep), 1 << 16):
            end = start + (1 << 16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[start:end].astype(np.int64)) for x in ids] + [pa.array(whole.count[keep[start:end]]), pa.array(mixed[start:end].view(np.int64))],
                names=["w1", "w2", "w3", "w4", "f", "h"])

    def run(batches):
        number, parts, pending = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                if own != number and parts:
                    yield from out(number, parts)
                    parts, pending = [], 0
                number = own
                parts.append(qf.unpack(batch.column(1)[i].as_py(), own, width, segment_bits))
                pending += len(parts[-1])
                if pending >= entries:
                    parts, pending = [qf.merge(parts, width)], 0
        if parts:
            yield from out(number, parts)

    return run


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered 1, 2, 3 .. without a sort: place in the stored file's partition plus the sizes of those before."""
    held = stored(df.withColumn("at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("at", 33)
    sizes = held.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()
    begin, before = 1, []
    for row in sizes:
        before.append((row["task"], begin))
        begin += row["n"]
    starts = df.sparkSession.createDataFrame(before, "task long, begin long")
    numbered = held.withColumn("task", task).join(F.broadcast(starts), "task")
    return numbered.withColumn(name, F.col("begin") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("task", "begin", "at")


def _exact(column: Column, factor: int) -> Column:
    return column.cast("decimal(19,0)") * F.lit(factor).cast("decimal(10,0)")


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000,
                 scale: int = 1_000_000, contained_percent: int = 80) -> DataFrame:
    """The phrases of two to four words that hold together best, for each language.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks,
    and pieces into words at blanks and tabs. f counts all occurrences of a
    phrase inside pieces. Phrases with at least ``least`` occurrences are
    candidates; a cut gives floor(2 * scale * a / (l + r)) with a, l and r the
    counts of the phrase and of the two sides, and the lowest cut is the score
    (ties: shortest first part). Candidates inside a longer candidate of at least
    ``contained_percent`` of their count go. Returns lang, rank, phrase, a, l, r,
    n (words of the language) and score, ``top`` rows for a language, by score,
    count (both descending) and phrase.

    NULL and empty texts have no words; a NULL language counts as ``und``;
    repeated rows count as often as they occur; other columns are not read; a
    text of any length is counted whole.

    Scale: texts are cut into shards with local word numbers, so only each
    shard's distinct words are shuffled for the common numbering. Runs are
    counted in quotient filters; a run that a third of the rows hold is one
    entry of each filter. Filters are dealt by leading key bits, a number of
    segments that follows from the word count. A bitmap of the frequent pairs
    (16 MB at most) keeps longer runs that cannot be candidates out of the filters; it only saves work.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")).where("text <> ''")
    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        shards = stored(texts.mapInArrow(
            _shards(SHARD_BYTES), "shard long, lang string, wide boolean, sequence binary, words array<string>, counts array<long>"), "shards")
    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "entry")).select(
        "shard", "lang", "place", F.col("entry.words").alias("word"), F.col("entry.counts").alias("n"))
    counted = stored(local.groupBy("lang", "word").agg(F.sum("n").alias("f")), "words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(_numbered(counted.where(F.col("f") >= least), "id"), "numbers")
    last, seen = words.agg(F.max("id"), F.sum("f")).first()
    bits = max(int(last or 0).bit_length(), 1)
    segment_bits = min(max(int(seen or 0) // SEGMENT_ENTRIES, 1).bit_length(), bits - 1)

    numbers = local.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(
        F.collect_list(F.struct("place", F.col("id").cast("int").alias("id"))).alias("pairs"))
    with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
        sequences = stored(
            shards.join(numbers, "shard").select("wide", "sequence", "pairs").mapInArrow(_resolve, "sequence binary"), "sequences")

    def frequent(size: int, held=None) -> DataFrame:
        filters = sequences.mapInArrow(_filters(size, bits, segment_bits, FILTER_ENTRIES, held), "segment long, filter binary")
        dealt = filters.repartition("segment").sortWithinPartitions("segment")
        with arrow_batches(spark, BATCH_ROWS, BATCH_BYTES):
            return stored(dealt.mapInArrow(
                _merged(size, bits, segment_bits, least, MERGE_ENTRIES), "w1 long, w2 long, w3 long, w4 long, f long, h long"), "runs")

    pairs = frequent(2)
    bitmap = spark.sparkContext.broadcast(bitmap_of(F.col("h"), pairs))
    longer = frequent(3, bitmap)
    bitmap.unpersist()

    key = ["w1", "w2", "w3", "w4"]
    found = pairs.unionByName(longer).select(*key, F.col("f").alias("a"), (F.lit(2) + F.when(F.col("w3") > 0, 1).otherwise(0)
                                             + F.when(F.col("w4") > 0, 1).otherwise(0)).alias("size"), F.array(*key).alias("ids"))

    def part(first: Column, length: Column) -> Column:
        """The key of a run inside ``ids``: its numbers, then zeros."""
        return F.struct(*[F.when(length > i, F.get("ids", first + i)).otherwise(F.lit(0)).alias(k) for i, k in enumerate(key)])

    inner = F.explode(F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), i -> struct(i AS first, m AS length))))")).alias("inner")
    inside = found.where("size > 2").select("ids", "a", inner).select(part(F.col("inner.first"), F.col("inner.length")).alias("p"), "a")
    cover = inside.groupBy("p").agg(F.max("a").alias("cover")).select("p.*", "cover")
    kept = found.join(cover, key, "left").where(
        F.col("cover").isNull() | (_exact(F.col("cover"), 100) < _exact(F.col("a"), contained_percent))).drop("cover")
    kept = stored(kept, "candidates")

    lookup = stored(words.select(F.col("id").alias("w1"), *[F.lit(0).cast("long").alias(k) for k in key[1:]], "f")
                    .unionByName(found.where("size < 4").select(*key, F.col("a").alias("f"))), "lookup")
    cuts = kept.select(*key, "a", "size", "ids", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    for side, first, length in (("l", F.lit(0), F.col("k")), ("r", F.col("k"), F.col("size") - F.col("k"))):
        own = part(first, length)
        cuts = cuts.select("*", *[own[k].alias(f"{side}_{k}") for k in key])
        cuts = join_dimension(cuts, lookup.select(*[F.col(k).alias(f"{side}_{k}") for k in key], F.col("f").alias(side)),
                              [f"{side}_{k}" for k in key], "inner", LOOKUP_BYTES).drop(*[f"{side}_{k}" for k in key])
    cuts = cuts.withColumn("twice", _exact(F.col("a"), 2 * scale)).withColumn("sides", F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)"))
    best = cuts.select(*key, F.struct(F.expr("twice div sides").alias("score"), "k", "l", "r", "a").alias("cut")).groupBy(*key).agg(F.min("cut").alias("cut"))

    spelled = best.select(*key, "cut", F.posexplode(F.filter(F.array(*key), lambda x: x > 0)).alias("place", "id"))
    spelled = join_dimension(spelled, words.select("id", "lang", "word"), "id", "inner", LOOKUP_BYTES)
    spelled = spelled.groupBy(*key).agg(
        F.first("cut").alias("cut"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    scored = spelled.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), "cut.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return join_dimension(ranked, totals, "lang", "inner").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
