"""Long repeated strings against counting every string."""

import random

import numpy as np
import pyarrow as pa
import pytest

from attestry.llm import suffix_dedup as module
from attestry.llm.queries import op10_suffix_dedup
from attestry.llm.suffix_dedup import suffix_dedup
from tests.llm import brute
from tests.llm.test_text_operators import TEXT, words


def compare(spark, rows, size=400):
    out = suffix_dedup(spark.createDataFrame(rows, TEXT), size=size).collect()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out)
    assert got == sorted(brute.repeats(rows, size))
    return got


def corpus(seed, size):
    rng = random.Random(seed)
    passage = " ".join(words(rng, size // 3, 10**6))
    rows = []
    for group in range(6):
        base = words(rng, rng.choice([20, 150, 400]), 10**6)
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 12])):
                own[rng.randrange(len(own))] = f"é{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    for _ in range(25):
        cut = rng.randrange(size // 2)
        rows.append(" ".join(words(rng, 40, 10**6)) + passage[cut : cut + rng.choice([size - 1, size, size + 1, size + 90])] + " ".join(words(rng, 40, 10**6)))
    rows += ["Un " * 70 + "ouou " * 60 + " ".join(words(rng, 30)), "Un " * 300 + "x" * 700, "ab" * 900, "x" * size, "x" * (size + 1), "", "漢" * 200]
    twice = " ".join(words(rng, size // 3, 10**6))
    rows.append(twice + " | " + twice)
    rng.shuffle(rows)
    return list(enumerate(rows)) + [(1000, None)]


@pytest.mark.parametrize("seed,size", [(1, 400), (2, 400), (3, 60)])
def test_repeats(spark, seed, size):
    got = compare(spark, corpus(seed, size), size)
    assert sum(r[2] for r in got) > 0


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(11)
    shared = " ".join(words(rng, 500, 10**6))
    rows = [(i, " ".join(words(rng, 700 + 37 * i, 10**6)) + shared + " ".join(words(rng, 300, 10**6))) for i in range(4)]
    monkeypatch.setattr(module, "PIECE", 997)
    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    ends = [(b + f[0], b + e[-1]) for b, *_, f, e in module.runs_of(data, 400, 133)]
    assert ends[0][0] == 0 and ends[-1][1] == len(data) - 399 and all(x[1] == y[0] for x, y in zip(ends, ends[1:]))
    monkeypatch.undo()
    compare(spark, rows)


def test_edges(spark):
    assert suffix_dedup(spark.createDataFrame([], TEXT)).collect() == []
    text = " ".join(words(random.Random(2), 300, 10**6))
    rows = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text[1:], "b"), (3, "short", None)], "doc_id long, text string, n_bytes string")
    out = suffix_dedup(rows)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "n_removed", "spans"]
    got = sorted((r.doc_id or -1, r.n_removed, r.n_bytes) for r in out.collect())
    assert got == [(-1, len(text) - 1, len(text) - 1), (1, len(text), len(text)), (1, len(text), len(text)), (3, 0, 5)]


def test_texts_laid_end_to_end_keep_their_runs(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(words(rng, n, 10**6)).encode() for n in (90, 60, 300, 75)] + [b"x" * 400, b"x" * 401, b"ab" * 500]
    texts += [texts[2]]
    monkeypatch.setattr(module, "GROUP", 5000)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(range(len(texts))), pa.array(range(len(texts)))], names=["text", "c0", "c1"])
    groups = list(module._pieces([batch], 400))
    assert 1 < len(groups) < len(texts) and sum(len(g.data) for g in groups) == sum(len(t) for t in texts if len(t) >= 400)
    got = []
    for group in groups:
        _, anchors, spots, first, ends, own = module.runs_in(group, 400, 133)
        got += zip(group.c0[own], anchors, group.in_text(spots, own), group.in_text(first, own), group.in_text(ends, own))
    alone = []
    for i, text in enumerate(texts):
        for begin, _, anchors, spots, first, ends in module.runs_of(np.frombuffer(text, np.uint8), 400, 133):
            alone += zip([i] * len(anchors), anchors, begin + spots, begin + first, begin + ends)
    assert sorted(got) == sorted(alone)


def test_covered_texts_beside_each_other(spark):
    # runs that end and begin where two texts meet in a group stay apart
    rows = [(i, c * (401 + i)) for i, c in enumerate("abcdefg")] + [(9, " ".join(words(random.Random(3), 200, 10**6)))]
    assert [r[2] for r in compare(spark, rows)] == [401 + i for i in range(7)] + [0]


def test_planted_passages_are_told_by_their_bytes(spark, tmp_path):
    """Passages of over 50 words in two documents each: those of 400 bytes or more are removed, shorter ones and other documents stay."""
    rng = random.Random(17)
    rows, planted = [], {}
    for group in range(40):
        passage = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(rng.randrange(51, 90)))
        for side in "ab":
            planted[len(rows)] = len(passage)
            rows.append((len(rows), f"{' '.join(words(rng, 60, 10**6))} {side}<{passage}>{side} {' '.join(words(rng, 60, 10**6))}"))
    rows += [(i, " ".join(words(rng, 160, 10**6))) for i in range(len(rows), len(rows) + 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op10_suffix_dedup(spark, str(tmp_path)).collect()}
    # the brackets around a passage are repeated with it
    assert {i for i, r in got.items() if r.repeated} == {i for i, size in planted.items() if size + 2 >= 400}
    assert all(r.n_removed == planted[i] + 2 and r.n_spans == 1 for i, r in got.items() if r.repeated)
    assert 0 < sum(r.repeated for r in got.values()) < len(planted)
