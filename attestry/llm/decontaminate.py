"""Find benchmark passages inside documents with a Wu-Manber search over words."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from attestry.llm.common import LOWER, UPPER, map_text

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans(UPPER, LOWER)
#: Words in a block of the shift table.
BLOCK = 2
#: Windows that one search table holds; a larger benchmark is searched table after table in the same pass.
TABLE_WINDOWS = 200_000


def words_of(text: str | None) -> list[str]:
    """Words of a text, A-Z lower-cased; none for NULL."""
    return WORD.findall(text.translate(FOLD)) if text else []


class WuManber:
    """Search for many word windows of one length.

    ``shift`` tells for a block of words how far the window's end may jump: the
    distance of the block's last occurrence in any window from the window's end,
    and the whole length for a block that no window holds. Windows whose last
    block has shift 0 are in a bucket of that suffix; a hash of the first words
    narrows the bucket before words are compared one by one.
    """

    def __init__(self, windows: dict[tuple[str, ...], list[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[str, list[tuple[tuple[str, ...], list[str]]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                block, far = window[end - self.block : end], length - end
                if far < self.shift.get(block, self.default):
                    self.shift[block] = far
            self.buckets.setdefault(window[length - self.block :], {}).setdefault(window[0], []).append((window, items))

    def search(self, words: list[str]):
        """Yield (start, items) of every occurrence."""
        end, n, length, block = self.length, len(words), self.length, self.block
        shift, default, buckets = self.shift, self.default, self.buckets
        while end <= n:
            suffix = tuple(words[end - block : end])
            far = shift.get(suffix, default)
            if far:
                end += far
                continue
            start = end - length
            for window, items in buckets[suffix].get(words[start], ()):
                if tuple(words[start:end]) == window:
                    yield start, items
            end += 1


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, length: int) -> list[dict[tuple[str, ...], list[str]]]:
    """Windows of all items in tables of a bounded size: window -> item ids. The benchmark is the query set."""
    tables: list[dict[tuple[str, ...], list[str]]] = [{}]
    for item, text in benchmark.select(f"`{item_col}`", f"`{text_col}`").toLocalIterator():
        words = words_of(text)
        size = min(length, len(words))
        if len(tables[-1]) >= TABLE_WINDOWS:
            tables.append({})
        for i in range(len(words) - size + 1 if words else 0):
            items = tables[-1].setdefault(tuple(words[i : i + size]), [])
            if str(item) not in items:
                items.append(str(item))
    return tables


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", length: int = 10) -> DataFrame:
    """Mark the words of each document that lie in an occurrence of a benchmark window.

    A window is ``length`` consecutive words of an item, or all words of a
    shorter item. Returns the columns of ``docs`` and ``n_words``, ``n_hit``,
    ``items`` (ids with occurring windows, as sorted strings) and ``hits``
    (maximal hit runs as [first word, end)); columns of these names are replaced.
    NULL and empty texts have no words; an empty benchmark hits nothing; repeated
    items and rows are treated alike; a NULL item id is named "None".

    Scale: one pass over the documents without a shuffle. Each search table is
    broadcast and has at most TABLE_WINDOWS windows plus those of one item; a
    benchmark of several tables is searched table after table on the same batch.
    """
    spark = docs.sparkSession
    tables = [spark.sparkContext.broadcast(t) for t in windows_of(benchmark, item_col, item_text_col, length)]
    added = [
        StructField("n_words", LongType()), StructField("n_hit", LongType()),
        StructField("items", ArrayType(StringType())), StructField("hits", ArrayType(ArrayType(LongType()))),
    ]

    def make():
        searches = []
        for table in tables:
            by_length: dict[int, dict] = {}
            for window, items in table.value.items():
                by_length.setdefault(len(window), {})[window] = items
            searches += [WuManber(windows, size) for size, windows in sorted(by_length.items())]

        def work(texts: pa.Array) -> list[pa.Array]:
            n_words, n_hit, all_items, all_hits = [], [], [], []
            for value in texts:
                words = words_of(value.as_py())
                found = [(s, s + search.length, items) for search in searches for s, items in search.search(words)]
                runs: list[list[int]] = []
                for start, end, _ in sorted(found, key=lambda x: x[:2]):
                    if runs and start <= runs[-1][1]:
                        runs[-1][1] = max(end, runs[-1][1])
                    else:
                        runs.append([start, end])
                n_words.append(len(words))
                n_hit.append(sum(e - s for s, e in runs))
                all_items.append(sorted({i for *_, items in found for i in items}))
                all_hits.append(runs)
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(all_items, pa.list_(pa.string())), pa.array(all_hits, pa.list_(pa.list_(pa.int64())))]

        return work

    return map_text(docs, text_col, added, make)
