"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.exprs import join_dimension
from attestry.llm.common import stored, text_slices

#: One letter in this many occurrences' names is deleted, by a checksum of document and word.
DAMAGE = 97
#: Bytes of text that one step of the word count works on.
STEP_BYTES = 1 << 20
#: Letters are dealt into this many groups; words share a block if their letter counts agree in every group.
GROUPS = 6
#: Words of a block compared as one matrix, and bytes of words in one matrix.
BLOCK, BLOCK_BYTES = 1024, 1 << 20
#: Letters: a to z (A to Z are lower-cased), then the code points from 0xC0 to 0xFF.
ALPHABET = 26 + 64
#: A lookup of more bytes than this is joined by a shuffle.
LOOKUP_BYTES = 8 << 20

_COLUMN = np.zeros(256, np.int64)
_COLUMN[0x61:0x7B] = np.arange(26)
_COLUMN[0xC0:] = np.arange(26, ALPHABET)
_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_LETTER = np.array([0x61 <= b <= 0x7A for b in range(256)])
#: Letters by how common they are in Latin scripts; dealt out one by one, they give groups of like weight.
COMMON = "etaoinsrhdlucmfywgpbvkxqjz"
_GROUP = np.array([(COMMON.index(chr(0x61 + i)) if i < 26 else i) % GROUPS for i in range(ALPHABET)])


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def _after_zeros(checks: np.ndarray, count: int) -> np.ndarray:
    """What each checksum becomes when ``count`` zero bytes follow; a checksum of joined texts is this XOR that of the second."""
    for _ in range(count):
        checks = _CRC[checks & np.uint32(0xFF)] ^ (checks >> np.uint32(8))
    return checks


def latin_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters in UTF-8 texts laid end to end: (their code points as bytes, their lengths, their rows)."""
    folded = _FOLD[data]
    lead = folded == 0xC3
    after = np.zeros(len(data), bool)
    after[1:] = lead[:-1]
    inside = _LETTER[folded] | lead | after
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    starts = np.flatnonzero(begin)
    points = inside & ~lead
    taken = np.cumsum(points)
    if not len(starts):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a run starts at its lead byte, if it has one, whose letter is counted one byte later
    first = taken[starts] - points[starts]
    letters = np.where(after, folded | 0x40, folded)[points]
    return letters, np.diff(np.append(first, taken[-1])), np.searchsorted(offsets, starts, side="right") - 1


def _coded(letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def damaged(codes: np.ndarray, rows: np.ndarray, words: list[bytes], keys: list[bytes], damage: int) -> list[tuple[bytes, int]]:
    """Distinct words of some texts with their occurrences, after one letter was deleted in those the checksum picks."""
    pair, times = np.unique(rows * np.int64(len(words)) + codes, return_counts=True)
    row, code = pair // len(words), pair % len(words)
    spelled = [w.decode("latin-1").encode() for w in words]
    sizes = np.array([len(s) for s in spelled])
    own = np.array([zlib.crc32(s) for s in spelled], np.uint32)
    before = np.array([zlib.crc32(k) for k in keys], np.uint32)
    checks = np.zeros(len(pair), np.uint32)
    size_of = sizes[code]
    shifted, done = before, 0
    for size in np.unique(sizes):
        at = np.flatnonzero(size_of == size)
        if size <= 64:
            shifted, done = _after_zeros(shifted, int(size) - done), int(size)
            checks[at] = shifted[row[at]] ^ own[code[at]]
        else:
            checks[at] = [zlib.crc32(spelled[c], int(before[r])) for r, c in zip(row[at], code[at], strict=True)]
    hit = checks % np.uint32(damage) == 0
    whole = np.bincount(code[~hit], times[~hit], len(words)).astype(np.int64)
    out = [(words[i], int(whole[i])) for i in np.flatnonzero(whole)]
    for c, h, t in zip(code[hit], checks[hit], times[hit], strict=True):
        word, drop = words[c], int(h) % len(words[c])
        out.append((word[:drop] + word[drop + 1 :], int(t)))
    return out


def _counted(damage: int, shortest: int):
    """(word, n) of the texts of a task, summed over a step's texts."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, offsets, data in text_slices(batch.column(1), STEP_BYTES):
                letters, lengths, rows = latin_words(offsets, data)
                if not len(lengths):
                    continue
                keys = [f"{'' if i is None else i}:".encode() for i in ids[first : first + len(offsets) - 1]]
                codes, words = _coded(letters, lengths)
                found = [x for x in damaged(codes, rows, words, keys, damage) if len(x[0]) >= shortest]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w for w, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["word", "n"])

    return run


def letter_matrix(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the words, offsets, letter counts: a row for each word)."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    rows = np.repeat(np.arange(len(words)), np.diff(offsets))
    counts = np.bincount(rows * ALPHABET + _COLUMN[data], minlength=len(words) * ALPHABET).reshape(len(words), ALPHABET)
    return data, offsets, counts


def _homes(batches):
    """A row for each word and each block that must see it: its own (guest false) and those whose counts by group are one edit lower.

    A word with one letter more than a block's goes to that block; of two blocks
    that differ by a replaced letter, the word goes to the one that has more of
    the earlier group. So every two words one edit apart meet in one block.
    """
    shifts = [np.zeros(GROUPS, np.int64)]
    for i in range(GROUPS):
        shifts.append(-np.eye(GROUPS, dtype=np.int64)[i])
        shifts += [np.eye(GROUPS, dtype=np.int64)[i] - np.eye(GROUPS, dtype=np.int64)[j] for j in range(i + 1, GROUPS)]
    shifts = np.array(shifts)
    member = np.zeros((ALPHABET, GROUPS), np.int64)
    member[np.arange(ALPHABET), _GROUP] = 1
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            _, offsets, counts = letter_matrix(part.column(0))
            home = (counts @ member)[:, None, :] + shifts
            sound = (home >= 0).all(axis=2)
            row, which = np.nonzero(sound)
            # a block's name: the counts by group, four bytes each
            names = np.ascontiguousarray(home[row, which].astype(">u4")).view(np.uint8)
            ends = pa.py_buffer(np.arange(0, 4 * GROUPS * (len(row) + 1), 4 * GROUPS, dtype=np.int32))
            block = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(names.reshape(-1))])
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([block, pa.array(which > 0), taken.column(0), taken.column(1)], names=["block", "guest", "word", "n"])


def one_edit(a: tuple, b: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether words x of a and y of b, as long or one letter longer, differ by exactly one edit."""
    (a_data, a_offsets), (b_data, b_offsets) = a, b
    short, long = np.diff(a_offsets)[x], np.diff(b_offsets)[y]
    good = np.zeros(len(x), bool)
    for size in np.unique(short):
        rows = np.flatnonzero(short == size)
        for start in range(0, len(rows), step := max(1, (1 << 20) // max(int(size), 1))):
            at = rows[start : start + step]
            span = np.arange(size)
            left = a_data[a_offsets[x[at]][:, None] + span]
            begin = b_data[b_offsets[y[at]][:, None] + span]
            extra = (long[at] - size)[:, None]
            end = b_data[b_offsets[y[at]][:, None] + span + extra]
            same = np.cumprod(left == begin, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            tail = np.cumprod((left == end)[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            replaced = (long[at] == size) & (same < size) & (same + tail == size - 1)
            good[at] = replaced | ((long[at] == size + 1) & (same + tail >= size))
    return good


def _near(batches):
    """Gram matrices of each block: for every word with near words (word, n, n_near, near, near_n), the last two the most frequent one.

    Rows come sorted by block and piece; those of the piece itself come before
    those it is compared with, which are taken batch by batch.
    """
    held, key, parts = None, None, []

    def matrix(words: pa.Array, counts: np.ndarray):
        data, offsets, letters = letter_matrix(words)
        kind = np.float32 if len(offsets) < 2 or int(np.diff(offsets).max()) < 1024 else np.float64
        letters = letters.astype(kind)
        return words, counts, (data, offsets), letters, (letters * letters).sum(axis=1)

    def links(left, right, inner: bool):
        gram = left[3].astype(right[3].dtype, copy=False) @ right[3].T
        gram *= -2
        gram += left[4][:, None]
        gram += right[4][None, :]
        x, y = np.nonzero(gram <= 2)
        if inner:
            x, y = x[x < y], y[x < y]
        if not len(x):
            return
        good = one_edit(left[2], right[2], x, y)
        x, y = x[good], y[good]
        for own, other, i, j in ((left, right, x, y), (right, left, y, x)):
            if not len(i):
                continue
            # the most frequent near word of each, by count and then by spelling
            spelled = pc.rank(other[0].take(pa.array(j)), sort_keys="ascending", tiebreaker="dense").to_numpy()
            order = np.lexsort((spelled, -other[1][j], i))
            first = np.flatnonzero(np.concatenate([[True], i[order][1:] != i[order][:-1]]))
            rows, best = i[order[first]], j[order[first]]
            yield pa.RecordBatch.from_arrays([
                own[0].take(pa.array(rows)), pa.array(own[1][rows]), pa.array(np.diff(np.append(first, len(order))).astype(np.int64)),
                other[0].take(pa.array(best)), pa.array(other[1][best])], names=["word", "n", "n_near", "near", "near_n"])

    def close():
        nonlocal held, parts
        if parts and held is None:
            held = matrix(pa.concat_arrays([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            parts = []
            yield from links(held, held, True)

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, pieces, other = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        words, counts = batch.column(3).cast(pa.large_binary()), batch.column(4).to_numpy()
        code = blocks.dictionary_encode()
        number = code.indices.to_numpy()
        change = np.flatnonzero((number[1:] != number[:-1]) | (pieces[1:] != pieces[:-1]) | (other[1:] != other[:-1])) + 1
        bounds = np.concatenate([[0], change, [batch.num_rows]])
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            own = (code.dictionary[int(number[start])].as_py(), int(pieces[start]))
            if own != key:
                yield from close()
                held, key, parts = None, own, []
            piece = words.slice(start, end - start), counts[start:end]
            if not other[start]:
                parts.append(piece)
                continue
            yield from close()
            if held is not None:
                for at in range(0, end - start, 4 * BLOCK):
                    yield from links(held, matrix(piece[0].slice(at, 4 * BLOCK), piece[1][at : at + 4 * BLOCK]), False)
    yield from close()


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int = DAMAGE, shortest: int = 5,
                    least: int = 3, ratio: int = 2) -> DataFrame:
    """Words of the texts, each with the more frequent word it may be a variant of.

    Words are runs of ``A-Z``, ``a-z`` and U+00C0 to U+00FF, A-Z lower-cased. If
    ``damage`` divides the CRC-32 of ``id:word``, the code point at that checksum
    modulo the length is deleted. Those of ``shortest`` code points and ``least``
    occurrences count. Two are near if they differ by one inserted, deleted or
    replaced code point. Returns word, n, n_near, form (the near word of largest
    n, ties by spelling, if that n is ``ratio`` times the word's, else NULL),
    form_n and root (the end of the chain of forms).

    NULL and empty texts have no words; a NULL id stands as empty text before the
    colon; repeated rows count as often as they occur; other columns are not
    read; runs and texts of any length are taken whole.

    Scale: counts are summed before the shuffle. Blocks are named by the letter
    counts of GROUPS groups of letters (so also by length), and a word goes to
    its own block and to those one edit away, never to a whole length. A large
    block is cut into pieces of BLOCK words whose partners pass by in batches, in
    tasks of their own. No pair leaves its task: per task and word only the
    number of near words and the best of them.
    """
    words = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text <> ''").mapInArrow(
        _counted(damage, shortest), "word binary, n long")
    counted = stored(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "words")

    homes = counted.mapInArrow(_homes, "block binary, guest boolean, word binary, n long")
    sizes = homes.where("NOT guest").groupBy("block").agg(F.count("*").alias("members"), F.max(F.length("word")).alias("width"))
    pieces = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("members") * F.col("width") / BLOCK_BYTES)).cast("int")
    dealt = join_dimension(homes, sizes.select("block", pieces.alias("pieces")), "block", "inner", LOOKUP_BYTES)
    own = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int")
    # a member is compared with the pieces before its own, a guest with all
    seen = dealt.select("block", "guest", "word", "n", own.alias("own"), F.explode(
        F.sequence(F.lit(0), F.when(F.col("guest"), F.col("pieces") - 1).otherwise(own))).alias("piece"))
    keyed = seen.select("block", "piece", (F.col("guest") | (F.col("piece") != F.col("own"))).alias("other"), "word", "n")
    found = keyed.repartition("block", "piece").sortWithinPartitions("block", "piece", "other").mapInArrow(
        _near, "word binary, n long, n_near long, near binary, near_n long")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form"), F.col("near_n").alias("form_n")))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    table = counted.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", "best.form_n")
    fits = F.col("form_n").cast("decimal(20,0)") >= F.col("n").cast("decimal(20,0)") * F.lit(ratio)
    table = stored(table.withColumns({"form": F.when(fits, F.col("form")), "form_n": F.when(fits, F.col("form_n"))}), "forms")

    # counts at least double along a chain, so a few rounds of jumping reach its end
    jumps = stored(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(join_dimension(jumps, onward, "root", "left", LOOKUP_BYTES).select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        jumps = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    out = table.join(jumps, "word", "left")
    text = {c: F.decode(F.col(c), "ISO-8859-1") for c in ("word", "form", "root")}
    return out.withColumn("root", F.coalesce("root", "word")).select(
        text["word"].alias("word"), text["form"].alias("form"), text["root"].alias("root"), "n", "n_near", "form_n")
