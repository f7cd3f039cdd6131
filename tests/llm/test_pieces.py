"""Sampled segmentations against enumeration, and exact round trips."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest

from attestry.llm import pieces
from attestry.llm.common import mix
from attestry.llm.queries import op1_sampled_pieces
from tests.llm.test_text_operators import TEXT

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Vocabulary(file.read())


def all_paths(vocabulary, word):
    """{piece ids: probability} of every segmentation of a short text."""
    import sentencepiece

    known = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "▁" + word.replace(" ", "▁")

    def ways(rest):
        if not rest:
            yield (), 0.0
            return
        heads = [(k, known.piece_to_id(rest[:k])) for k in range(1, len(rest) + 1)]
        heads = [(k, (i,), vocabulary.weights[i]) for k, i in heads if not known.is_unknown(i)]
        if not any(k == 1 for k, *_ in heads):
            raw = rest[0].encode()
            heads.append((1, tuple(int(vocabulary.byte_ids[b]) for b in raw), len(raw) * vocabulary.byte_weight))
        for k, ids, weight in heads:
            for more, w in ways(rest[k:]):
                yield ids + more, weight + w

    weights = {ids: math.exp(w) for ids, w in ways(text)}
    total = sum(weights.values())
    return {ids: w / total for ids, w in weights.items()}


def draw(vocabulary, text, rows, samples):
    seeds = mix(np.arange(rows, dtype=np.uint64))
    found = pieces.segment(vocabulary, [text] * rows, seeds, samples)
    return [[(tuple(ids.tolist()), log_p, value) for ids, log_p, value in own] for own, _ in found], found


@pytest.mark.parametrize("text", ["ab the", "été", "a\nb 漢"])
def test_samples_follow_the_distribution(vocabulary, text):
    want = all_paths(vocabulary, text)
    rows = 6000
    drawn, _ = draw(vocabulary, text, rows, 3)
    first, second = Counter(own[0][0] for own in drawn), Counter(own[1][0] for own in drawn if len(own) > 1)
    for ids, p in want.items():
        assert abs(first[ids] / rows - p) < 5 * math.sqrt(p * (1 - p) / rows) + 1e-3
        # second draw: p(i second) = sum over other j first of p_j * p_i / (1 - p_j)
        q = sum(other * p / (1 - other) for j, other in want.items() if j != ids and other < 1)
        assert abs(second[ids] / rows - q) < 5 * math.sqrt(q * max(1 - q, 0) / rows) + 1e-3
    for own in drawn[:300]:
        assert len({ids for ids, *_ in own}) == len(own)
        assert all(math.isclose(math.exp(log_p), want[ids], rel_tol=1e-6) for ids, log_p, _ in own)
        values = [v for *_, v in own]
        assert values == sorted(values, reverse=True)


def test_all_segmentations_when_there_are_few(vocabulary):
    want = all_paths(vocabulary, "ab")
    drawn, found = draw(vocabulary, "ab", 20, 50)
    assert all({ids for ids, *_ in own} == set(want) for own in drawn)
    assert all(after == -np.inf for _, after in found)


def test_inclusion_scores_weigh_back(vocabulary):
    """Sum of p / inclusion over a sample estimates the whole distribution, 1."""
    rows = 4000
    _, found = draw(vocabulary, "the cat", rows, 4)
    total = 0.0
    for own, after in found:
        for _, log_p, _ in own:
            total += math.exp(log_p) / -math.expm1(-math.exp(log_p - after)) if after > -np.inf else math.exp(log_p)
    assert abs(total / rows - 1) < 0.05


def test_rows(spark):
    texts = ["Hello  world\nfoo é 漢字 a", " leading", "trailing ", "\n\n", "▁ literal ▁▁", "\U0001f600 \x00 tab\t", "x" * 70000, "a", "word " * 30000, None, ""]
    rows = [(i, t, 3) for i, t in enumerate(texts)] + [(0, texts[0], 3), (None, "null key", 3)]
    docs = spark.createDataFrame(rows, TEXT + ", segmentations int").repartition(3)
    out = pieces.sample_pieces(docs)
    assert out.columns == ["doc_id", "text", "segmentations"]
    result = out.collect()
    once = {r.doc_id: r.segmentations for r in result}
    for r in result:
        if not r.text:
            assert r.segmentations == []
            continue
        assert r.segmentations[0].decodes is True
        assert len({s.ids_sha256 for s in r.segmentations}) == len(r.segmentations) <= 3
        assert all(s.log_inclusion <= 0 and s.n_pieces == len(s.ids) for s in r.segmentations)
        assert r.segmentations == once[r.doc_id]
    again = {r.doc_id: r.segmentations for r in pieces.sample_pieces(docs.coalesce(1), ids_of=0).collect()}
    assert {k: [s.ids_sha256 for s in v] for k, v in again.items()} == {k: [s.ids_sha256 for s in v] for k, v in once.items()}
    assert all(s.ids is None for v in again.values() for s in v)
    decoded = pieces.decode_pieces(out.selectExpr("text", "get(segmentations, 0).ids AS ids"), "ids").collect()
    assert all(r.decoded == r.text for r in decoded if r.text)
    assert pieces.sample_pieces(spark.createDataFrame([], TEXT)).collect() == []


def test_decode_odd_ids(spark):
    rows = spark.createDataFrame([([],), (None,), ([0, 1, 2, 99999, -1, None],)], "ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(rows, "ids").collect()] == ["", None, ""]


def test_query_returns_and_decodes_every_sample(spark, tmp_path):
    texts = ["Hello  world\nfoo é 漢字 a", "a", "\n\n", "▁ \U0001f600", "word " * 20000, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    result = op1_sampled_pieces(spark, str(tmp_path))
    assert len(result.collect()) == len(texts)
    for r in result.collect():
        assert r.decodes is True and r.n_samples == len(r.ids) == len(r.ids_sha256) and (r.n_samples > 0) == bool(texts[r.doc_id])
        assert [hashlib.sha256(ids).hexdigest() for ids in r.ids] == r.ids_sha256
        assert [len(ids) // 4 for ids in r.ids] == r.n_pieces
    decoded = pieces.decode_pieces(result.selectExpr("doc_id", "explode(ids) AS ids"), "ids").collect()
    assert len(decoded) == sum(r.n_samples for r in result.collect()) > len(texts) and all(r.decoded == texts[r.doc_id] for r in decoded)
    arrays = pieces.sample_pieces(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
    assert {r.doc_id: [np.array(s.ids, "<i4").tobytes() for s in r.segmentations] for r in arrays} == {r.doc_id: [bytes(i) for i in r.ids] for r in result.collect()}
    for packed in (False, True):
        drawn = pieces.sample_pieces(spark.read.parquet(f"{tmp_path}/documents.parquet"), ids_of=1, packed=packed).collect()
        assert all(s.decodes is True and (s.ids is None) == (nth > 0) for r in drawn for nth, s in enumerate(r.segmentations))


def test_spelling_tells_wrong_ids(vocabulary, monkeypatch):
    texts = [b"some words", "漢字 é".encode(), b"x"]
    drawn = pieces.segment(vocabulary, [t.decode() for t in texts], mix(np.arange(3).astype(np.uint64)), 1)
    ids = [own[0][0] for own, _ in drawn]
    raw = [np.frombuffer(t, np.uint8) for t in texts]
    for limit in (1, 1 << 16):
        monkeypatch.setattr(pieces, "SPELL_IDS", limit)
        assert vocabulary.spells(ids, raw) == [True] * 3
        assert vocabulary.spells([ids[0][:-1], ids[1], ids[0]], raw) == [False, True, False]
    assert vocabulary.spells([], []) == []


def test_values_are_drawn_for_likely_steps_alone(vocabulary, monkeypatch):
    """Steps past a prefix of chance NEAR get no value, so a long text costs what its first words do."""
    drawn, below = [], pieces._below
    monkeypatch.setattr(pieces, "_below", lambda location, top, bits: drawn.append(np.size(location)) or below(location, top, bits))
    rows, seeds = 20, mix(np.arange(20).astype(np.uint64))
    found = pieces.segment(vocabulary, ["the cat sat on the mat " * 100] * rows, seeds, 3)
    assert all(len({ids.tobytes() for ids, *_ in own}) == 3 for own, _ in found)
    assert sum(drawn) < rows * 3 * pieces.STEPS / 2


def test_spelling_tells_places(vocabulary):
    ids = pieces.segment(vocabulary, ["some words 漢 é"], mix(np.arange(1).astype(np.uint64)), 1)[0][0][0][0]
    letters, at = vocabulary.spell(ids)
    assert [letters[a:b].tobytes() for a, b in zip(at[:-1], at[1:])] == [vocabulary.bytes[i] for i in ids]
    assert vocabulary.spell(ids[:0])[1].tolist() == [0]


def test_character_that_is_no_piece_by_itself(vocabulary):
    """Where longer pieces begin with it, its bytes are one more way."""
    import copy

    node = int(vocabulary.follow(np.array([ord("t")], np.int64))[0])
    less = copy.copy(vocabulary)
    less.piece = vocabulary.piece.copy()
    less.piece[node] = -1
    found = pieces.segment(less, ["a\nthe"], mix(np.arange(1).astype(np.uint64)), 1000)
    ways = [tuple(ids.tolist()) for ids, *_ in found[0][0]]
    assert len(set(ways)) == len(ways) and found[0][1] == -np.inf
    assert all(less.decode(ids) == "a\nthe" for ids in ways)
    assert any(less.byte_ids[ord("t")] in ids for ids in ways) and any(less.byte_ids[ord("t")] not in ids for ids in ways)
    assert math.isclose(sum(math.exp(log_p) for _, log_p, _ in found[0][0]), 1.0, rel_tol=1e-9)
