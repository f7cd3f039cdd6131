"""Language identification by prediction with partial matching over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from attestry.llm.common import map_text, text_slices

#: Longest context in bytes, and the rows of each language that are learned from.
ORDER, DOCS_PER_LANGUAGE = 3, 400
#: A context, its byte and its length are packed into a long; bytes scored at a time.
MAX_ORDER, CHUNK = 6, 1 << 19
#: Parts that a language's rows are dealt into before its sample is taken.
SAMPLE_PARTS = 64
UNKNOWN = "und"


def context_counts(labelled: DataFrame, text_col: str, lang_col: str, order: int) -> DataFrame:
    """(lang, size, gram, n): occurrences of every byte string of 1 to order + 1 bytes, packed into a long."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist())
            for first, offsets, data in text_slices(batch.column(0)):
                rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                owner = langs[first : first + len(offsets) - 1]
                gram = np.zeros(len(data), np.int64)
                for size in range(1, order + 2):
                    gram = (gram[:-1] << 8 if size > 1 else gram) | data[size - 1 :] if len(data) >= size else gram[:0]
                    if not len(gram):
                        break
                    whole = rows[: len(gram)] == rows[size - 1 :]
                    for lang in np.unique(owner):
                        codes, n = np.unique(gram[whole & (owner == lang)[rows[: len(gram)]]], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(codes)), pa.array(np.full(len(codes), size, np.int32)), pa.array(codes), pa.array(n.astype(np.int64))], names=["lang", "size", "gram", "n"])

    counted = labelled.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).mapInArrow(run, "lang string, size int, gram long, n long")
    return counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class CodeTable:
    """Frozen statistics of all languages: bits of each byte after each known context.

    A byte that was seen after the context costs -log2(n / (total + distinct)).
    Any other costs the escape, -log2(distinct / (total + distinct)), plus its
    bits after the context shortened by its oldest byte; under the empty context
    stands a uniform code over 256 bytes. A context that a language never saw
    costs it no escape.

    Only what a language saw is held: for each language and context length the
    sorted (context, byte) entries and the sorted contexts with their escapes, so
    the size follows the counts and ``order`` always holds.
    """

    def __init__(self, counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]], order: int):
        if not 0 <= order <= MAX_ORDER:
            raise ValueError(f"contexts of 0 to {MAX_ORDER} bytes, not {order}")
        self.langs, self.order = sorted(counts), order
        #: by language and context length: entries, their bits, contexts, their escapes
        self.tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for lang in self.langs:
            levels = []
            for k in range(order + 1):
                grams, n = counts[lang].get(k + 1, none)
                by_gram = np.argsort(grams)
                grams, n = grams[by_gram], n[by_gram]
                contexts, at = np.unique(grams >> 8, return_inverse=True)
                distinct = np.bincount(at, minlength=len(contexts))
                whole = np.bincount(at, n, len(contexts)) + distinct
                levels.append((grams, -np.log2(n / whole[at]), contexts, -np.log2(distinct / whole)))
            self.tables.append(levels)

    def _bits(self, levels: list, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram after the ``sizes`` bytes before it, under one language."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            entries, bits, contexts, escapes = levels[k]
            if not len(entries):
                continue
            deep = sizes[left] >= k
            asked = left[deep]
            gram = grams[asked] & ((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(entries, gram), len(entries) - 1)
            found = entries[at] == gram
            out[asked[found]] += bits[at[found]]
            missed, context = asked[~found], gram[~found] >> 8
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = contexts[at] == context
            out[missed[known]] += escapes[at[known]]
            left = np.concatenate([left[~deep], missed])
        out[left] += 8.0
        return out

    def lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language.

        Bytes are taken CHUNK at a time, so memory does not grow with a text; in a
        chunk, each distinct byte with its context is looked up once.
        """
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        for first in range(0, len(data), CHUNK):
            last = min(first + CHUNK, len(data))
            lo, hi = np.searchsorted(offsets, first, side="right") - 1, np.searchsorted(offsets, last, side="left")
            cuts = np.clip(offsets[lo : hi + 1], first, last) - first
            rows = np.flatnonzero(np.diff(cuts)) + lo
            place = np.arange(first, last) - np.repeat(offsets[lo:hi], np.diff(cuts))
            sizes = np.minimum(place, self.order)
            grams = data[first:last].astype(np.int64)
            for k in range(1, self.order + 1):
                before = np.zeros(last - first, np.int64)
                start = min(max(0, k - first), last - first)
                before[start:] = data[first + start - k : last - k]
                grams |= np.where(place >= k, before, 0) << 8 * k
            keys, where = np.unique(grams | sizes << 8 * (self.order + 1), return_inverse=True)
            grams, sizes = keys & ((1 << 8 * (self.order + 1)) - 1), keys >> 8 * (self.order + 1)
            for j, levels in enumerate(self.tables):
                out[rows, j] += np.add.reduceat(self._bits(levels, grams, sizes)[where], cuts[rows - lo])
        return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          docs_per_language: int = DOCS_PER_LANGUAGE) -> CodeTable:
    """Learn from ``docs_per_language`` rows of each language, those with the smallest hashes of their ids.

    Rows without text or language teach nothing; rows that share an id, or have none,
    are told apart by a hash of their text, and equal rows teach once. The rows are found on hashes alone, first within SAMPLE_PARTS parts of a
    language, then among those that are left, so that no task reads a whole
    language. Their number is bounded by languages x docs_per_language, and so are
    the counted contexts that come to the driver.
    """
    usable = labelled.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`").alias("h"), F.xxhash64(f"`{text_col}`").alias("t"),
        F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    keys = usable.select("id", "h", "t", "lang").withColumn("part", F.pmod(F.hash("h", "t"), F.lit(SAMPLE_PARTS)))
    for parts in (["lang", "part"], ["lang"]):
        by_hash = Window.partitionBy(*parts).orderBy("h", "id", "t")
        keys = keys.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= docs_per_language)
    chosen = keys.select(F.col("id").alias("own_id"), F.col("t").alias("own_t"), F.col("lang").alias("own_lang")).distinct()
    same = F.col("id").eqNullSafe(F.col("own_id")) & (F.col("t") == F.col("own_t")) & (F.col("lang") == F.col("own_lang"))
    sample = usable.join(F.broadcast(chosen), same, "left_semi").dropDuplicates(["id", "t", "lang"])
    table = context_counts(sample, "text", "lang", order).toArrow()
    counts: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    langs, sizes, grams, n = (table.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    for lang in np.unique(langs.astype(str)):
        for size in range(1, order + 2):
            pick = (langs == lang) & (sizes == size)
            counts.setdefault(str(lang), {})[size] = grams[pick], n[pick]
    return CodeTable(counts, order)


def identify(docs: DataFrame, model: CodeTable, text_col: str = "text") -> DataFrame:
    """Predict the language of each text: the one with the shortest code.

    Returns the columns of ``docs`` and ``lang_pred`` and ``score``, the share of
    the best language in 2 ** -length over all languages, and ``bits``, the code
    length per byte under it; columns of these names are replaced. NULL texts,
    texts without a letter and all texts under a model without languages are
    ``und`` with score 0. Ties go to the alphabetically first language.

    Scale: one pass without a shuffle; the broadcast table is bounded by
    the rows that were learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits", DoubleType())]

    def make():
        table = shared.value
        names = np.array(table.langs, dtype=object)

        def work(texts: pa.Array) -> list[pa.Array]:
            if not len(names):
                return [pa.array([UNKNOWN] * len(texts), pa.string()), pa.array([0.0] * len(texts)), pa.array([0.0] * len(texts))]
            lengths, sizes = [], []
            for _, offsets, data in text_slices(texts):
                lengths.append(table.lengths(offsets, data))
                sizes.append(np.diff(offsets))
            lengths, sizes = np.concatenate(lengths), np.concatenate(sizes)
            best = lengths.argmin(axis=1)
            least = lengths[np.arange(len(best)), best]
            score = 1 / np.exp2(np.clip(least[:, None] - lengths, -1000, 0)).sum(axis=1)
            return [pa.array(names[best], pa.string()), pa.array(score), pa.array(least / np.maximum(sizes, 1))]

        return work

    scored = map_text(docs, text_col, added, make)
    worded = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    return scored.withColumns({
        "lang_pred": F.when(worded, F.col("lang_pred")).otherwise(UNKNOWN),
        "score": F.when(worded, F.col("score")).otherwise(0.0),
        "bits": F.when(worded, F.col("bits")).otherwise(0.0),
    })


def is_held_out(id_col: str = "doc_id"):
    """Rows whose crc32 of the id leaves 2 modulo 4 are kept for testing; a NULL id is not."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
