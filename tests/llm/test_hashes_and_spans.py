"""Words and texts whose bytes follow a pattern, and texts with very many matches."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import ngram_join as join_module
from attestry.llm import pieces, pii
from attestry.llm.common import NOT_BLANK, word_hashes
from attestry.llm.ngram_join import ngram_join
from attestry.llm.pieces import sample_pieces


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


PATTERNS = [thue_morse(1024), thue_morse(1024, "b", "a")]


def test_patterned_words_have_hashes_of_their_own():
    words = [thue_morse(n, *p) for n in (64, 1024, 2048) for p in ("ab", "ba", "cd", "dc")] + ["a" * n for n in range(1, 300)]
    words += ["ab" * n for n in range(1, 300)] + [c * 9 + d for c in "abcdefgh" for d in "stuvwxyz"]
    data = " ".join(words).encode()
    _, hashes = word_hashes(np.array([0, len(data)]), np.frombuffer(data, np.uint8), NOT_BLANK)
    assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))


def test_sets_of_a_batch_in_bounded_memory(monkeypatch):
    texts = [" ".join(f"w{(i * 7919 + j * j) % 5003}" for j in range(450)) for i in range(1000)] + [None, "", "one"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["id", "text"])
    found = [(int(i), s) for ids, sets in join_module._sets([batch], 5) for i, s in zip(ids, sets)]
    tracemalloc.start()
    for _ in join_module._sets([batch], 5):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    monkeypatch.setattr(join_module, "TEXT_BYTES", 1 << 30)
    whole = [(int(i), s) for ids, sets in join_module._sets([batch], 5) for i, s in zip(ids, sets)]
    assert [i for i, _ in found] == list(range(len(texts))) == [i for i, _ in whole]
    assert all(np.array_equal(a, b) for (_, a), (_, b) in zip(found, whole))


def test_word_hashes_of_many_rows():
    rows = ["", "Ab c", " ", "ab", "c AB  ", "", "x"]
    data = "".join(rows).encode()
    offsets = np.concatenate([[0], np.cumsum([len(r.encode()) for r in rows])])
    at, hashes = word_hashes(offsets, np.frombuffer(data, np.uint8), NOT_BLANK)
    assert at.tolist() == [0, 0, 2, 2, 3, 5, 5, 6]
    assert hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3] != hashes[0]


def test_patterned_texts_do_not_link(spark):
    rows = [(i, t) for i, t in enumerate([*PATTERNS, PATTERNS[0]])]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 1, 2: 0}


def test_patterned_words_are_encoded_apart(spark):
    rows = [(1, " ".join(PATTERNS)), (2, PATTERNS[1])]
    out = sample_pieces(spark.createDataFrame(rows, "doc_id long, text string"), samples=2).collect()
    assert all(r.segmentations[0].decodes for r in out)


def test_equal_hashes_of_different_words_are_told_apart(monkeypatch):
    monkeypatch.setattr(pieces, "run_hashes", lambda values, starts, lengths: np.zeros(len(starts), np.uint64))
    chars = np.frombuffer("ab cd ab xyz cd".encode("utf-32-le"), np.uint32).astype(np.int64)
    starts = np.array([0, 3, 6, 9, 13])
    first, word = pieces._distinct(chars, starts, np.append(starts[1:], len(chars)))
    spelled = [chars[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(chars)), strict=True)]
    assert [spelled[first[w]] for w in word] == spelled


@pytest.mark.parametrize("count", [1, pii.RUN - 1, pii.RUN, pii.RUN + 1, 20_000])
def test_many_matches_in_one_text(spark, count):
    text = "ü" + "".join(f"a{i}@b.co  " for i in range(count))
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find_pii(df).select("doc_id", pii.of_kind("base", "email").alias("n"), pii.span_list(pii.F.col("base")).alias("s")).collect()}
    spans = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"a[0-9]+@b\.co", text)]
    assert out[1].n == count and out[1].s == ",".join(spans) and out[2].n == 0
