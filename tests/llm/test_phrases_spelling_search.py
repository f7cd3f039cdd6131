"""Phrases, spelling variants and top-k search against plain counting, and their edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest

from attestry.llm import phrases, spelling, topk_search
from attestry.llm import quotient_filter as qf
from attestry.llm.common import arrow_batches
from attestry.llm.phrases import mine_phrases
from attestry.llm.spelling import spelling_groups
from attestry.llm.topk_search import ImpactIndex
from attestry.llm.topk_search import topk_search as search

DOCS = "doc_id long, text string, lang string, rank long, word string, n long, id long, v array<int>, shard long"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- quotient filter ---------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 16, 18, 32, 36, 64])
def test_filter_round_trip_and_merge(bits):
    rng = np.random.default_rng(bits)
    top = (1 << bits) - 1
    keys = [(int(rng.integers(0, top, endpoint=True, dtype=np.uint64)), int(rng.integers(0, top, endpoint=True, dtype=np.uint64))) for _ in range(300)]
    keys += [keys[0]] * 400 + [keys[1]] * 255 + [keys[2]] * 254 + [(0, 0), (top, top), (0, top)]
    high, low = (np.array([k[i] for k in keys], np.uint64) for i in (0, 1))
    back = qf.restore(*qf.permute(high, low, bits), bits)
    assert (back[0] == high).all() and (back[1] == low).all()
    want = Counter(keys)
    for segment_bits in {0, min(3, bits - 1)}:
        halves = []
        for part in (slice(0, 350), slice(350, None)):
            counts = qf.count_keys(high[part], low[part], bits)
            blobs = [(s, qf.pack(c, bits, segment_bits)) for s, c in qf.segments(counts, bits, segment_bits)]
            halves += [qf.unpack(blob, s, bits, segment_bits) for s, blob in blobs]
        whole = qf.merge(halves, bits)
        h, w = qf.restore(whole.high, whole.low, bits)
        assert {(int(a), int(b)): int(c) for a, b, c in zip(h, w, whole.count, strict=True)} == want


def test_filter_is_smaller_than_its_keys():
    rng = np.random.default_rng(3)
    counts = qf.count_keys(rng.integers(0, 1 << 18, 50_000).astype(np.uint64), rng.integers(0, 1 << 18, 50_000).astype(np.uint64), 18)
    assert len(qf.pack(counts, 18, 0)) < 6 * len(counts)


# --- phrases -----------------------------------------------------------------------------------


def plain_phrases(docs, least=30, top=2000):
    count, total = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", fold(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    count[lang, tuple(w[i : i + m])] += 1
    kept = {k: f for k, f in count.items() if f >= least and len(k[1]) > 1}
    cover = defaultdict(int)
    for (lang, w), f in kept.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                cover[lang, w[i : i + m]] = max(cover[lang, w[i : i + m]], f)
    out = defaultdict(list)
    for (lang, w), a in kept.items():
        if 100 * cover[lang, w] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k, count[lang, w[:k]], count[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w), left, right))
    return sorted((lang, i + 1, p, -a, left, right, total[lang], -s)
                  for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2].encode()))[:top]))


def rows_of(docs):
    return [(*d, None, None, None, None, None, None) for d in docs]


def found_phrases(spark, docs, **options):
    out = mine_phrases(spark.createDataFrame(rows_of(docs), DOCS), **options)
    return sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def phrase_corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "é", "İx", "über all", "straße", "漢字", "a-b", "New", "York"]
    docs = []
    for i in range(120):
        words = [rng.choice(common) if rng.random() < 0.7 else f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 1, 3, 40, 90]))]
        for _ in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([["New", "York", "City"], ["in", "spite", "of"], ["as", "far", "as", "it"], ["ha"] * 6])
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " ", " "]) for w in words)
        docs.append((i, text, rng.choice(["en", "en", "fr", None, "und"])))
    return docs


@pytest.mark.parametrize("seed,top", [(1, 2000), (2, 7)])
def test_phrases_equal_plain_counting(spark, monkeypatch, seed, top):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 700)
    docs = phrase_corpus(seed)
    got = found_phrases(spark, docs, least=8, top=top)
    assert got == plain_phrases(docs, least=8, top=top) and len(got) > 2 * min(top, 8)


def test_phrases_of_many_filters_and_segments(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_ENTRIES", 64)
    monkeypatch.setattr(phrases, "SEGMENT_ENTRIES", 200)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    docs = phrase_corpus(5)
    assert found_phrases(spark, docs, least=4) == plain_phrases(docs, least=4)


def test_shards_hold_texts_of_many_batches(spark):
    rows = [(f"w{i} w{i % 7}. é", "ab"[i % 2]) for i in range(400)] + [(None, "a"), ("", "b")]
    texts = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    schema = "shard long, lang string, wide boolean, sequence binary, words array<string>, counts array<long>"
    with arrow_batches(spark, 10, 1 << 20):
        shards = texts.mapInArrow(phrases._shards(1 << 20), schema).collect()
    assert sorted(r.lang for r in shards) == ["a", "b"] and len({r.shard for r in shards}) == 2
    assert sum(sum(r.counts) for r in shards) == 1200
    with arrow_batches(spark, 10, 1 << 20):
        cut = texts.mapInArrow(phrases._shards(600), schema).collect()
    assert len(cut) > 4 and len({r.shard for r in cut}) == len(cut) and sum(sum(r.counts) for r in cut) == 1200


def test_batch_settings_come_back(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ZeroDivisionError), arrow_batches(spark, 10, 1 << 20):
        assert [spark.conf.get(n) for n in names] == ["10", str(1 << 20)]
        raise ZeroDivisionError
    assert [spark.conf.get(n) for n in names] == before


def test_phrases_edge_cases(spark):
    assert found_phrases(spark, []) == []
    assert found_phrases(spark, [(1, None, "en"), (2, "", None), (3, " \n.,", "en"), (None, "one", None)]) == []
    # a hot row, repeated rows, NULL ids, one very long text
    docs = [(None, "to be or not", None)] * 300 + [(7, "to be. " * 20_000, "xx")] + [(8, "x", "xx")]
    assert found_phrases(spark, docs) == plain_phrases(docs)


# --- spelling ----------------------------------------------------------------------------------


def plain_spelling(docs, damage=97):
    n = Counter()
    for key, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        a, b = sorted((a, b), key=len)
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w, found in beside.items():
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(beside[w]), n.get(form[w]) or 0) for w in n)


def found_spelling(spark, docs, **options):
    out = spelling_groups(spark.createDataFrame([(*d, None, *[None] * 6) for d in docs], DOCS), **options)
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in out.collect())


def spelling_corpus(seed):
    rng = random.Random(seed)
    stems = ["letter", "señor", "Größe", "anagram", "granama", "æther", "straße", "aaaaa", "aaaaaa", "über×all", "ÀÉÎõü"]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.choice([0, 5, 60])):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "é", "ÿ"])
            words.append("".join(w))
        docs.append((rng.choice([i, i, None]), "".join(w + rng.choice([" ", ", ", "1", "漢", "ſ", "Ā"]) for w in words)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(spelling, "BLOCK", 3)
    monkeypatch.setattr(spelling, "STEP_BYTES", 900)
    docs = spelling_corpus(seed)
    got = found_spelling(spark, docs, damage=11)
    assert got == plain_spelling(docs, damage=11)
    assert any(form for _, form, *_ in got)


def test_spelling_edge_cases(spark):
    assert found_spelling(spark, []) == []
    assert found_spelling(spark, [(1, None), (2, ""), (None, "12 . 漢"), (4, "abcd " * 9)]) == []
    # very long runs one edit apart, a hot word, repeated rows
    long = "abcde" * 4000
    docs = [(i, f"{long} {long[:-3] + long[-2:]} hotter") for i in range(3)] + [(9, "hotter " * 5000)] * 3
    got = found_spelling(spark, docs, damage=10**9)
    assert {(r[0], r[4]) for r in got} == {(long, 1), (long[:-3] + long[-2:], 1), ("hotter", 0)}


def test_checksum_of_joined_texts():
    words, keys = [b"word", b"x" * 70, "\xe9t\xe9".encode("latin-1")], [b"", b"12:", b"-999999:"]
    rows, codes = np.repeat(np.arange(3), 3), np.tile(np.arange(3), 3)
    out = spelling.damaged(codes, rows, words, keys, 1)
    want = []
    for k in keys:
        for w in words:
            h = zlib.crc32(k + w.decode("latin-1").encode())
            want.append((w[: h % len(w)] + w[h % len(w) + 1 :], 1))
    assert sorted(out) == sorted(want)


# --- search ------------------------------------------------------------------------------------


def plain_search(rows, k=5, every=50, scale=256):
    held = {}
    for key, x, *_ in rows:
        if key is not None and x and all(v is not None and np.isfinite(v) for v in x):
            v = [int(np.floor(scale * float(np.float32(c)))) for c in x]
            held[key] = min(held.get(key, v), v)
    out = []
    for q, a in held.items():
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in held.items() if c != q and len(b) == len(a))
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def found_search(spark, rows, **options):
    schema = "vec_id long, embedding array<float>, score long, rank int, query long, v int"
    out = search(spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], schema), **options)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    return sorted(tuple(r) for r in out.collect())


def test_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 100)
    monkeypatch.setattr(topk_search, "CHUNK", 7)
    rng = np.random.default_rng(4)
    rows = [(i - 200, rng.normal(size=12).tolist()) for i in range(700)]
    # a vector that a third of the rows hold, also among the queries; other lengths
    rows += [(1000 + i, [0.5] * 12) for i in range(350)] + [(3000 + i, [1.0, -1.0]) for i in range(60)] + [(5000, [2.0] * 3)]
    rng.shuffle(rows)
    assert found_search(spark, rows) == plain_search(rows)


def test_search_edge_cases(spark):
    assert found_search(spark, []) == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, None), (100, []), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (None, [9.0, 9.0]),
            (3, [0.0, 0.0]), (300, [0.0, 0.0]), (4, [1.0, 2.0]), (4, [1.0, 2.0]), (7, [3.0, 1.0]), (7, [-3.0, 1.0])]
    got = found_search(spark, rows)
    assert got == plain_search(rows) and {r[0] for r in got} == {0, 300}


@pytest.mark.parametrize("size", [3, 50, 5000, 1 << 40, 1 << 61])
def test_impact_index_against_sorting(size):
    rng = np.random.default_rng(size % 97)
    for _ in range(60):
        n, dims = int(rng.integers(1, 90)), int(rng.integers(1, 6))
        vectors, ids = rng.integers(-size, size + 1, (n, dims)), rng.permutation(1000)[:n]
        query, k = rng.integers(-size, size + 1, dims).tolist(), int(rng.integers(1, 8))
        found, scores = ImpactIndex(ids, vectors).search(query, k)
        exact = [sum(int(a) * b for a, b in zip(v, query, strict=True)) for v in vectors]
        best = sorted(range(n), key=lambda i: (-exact[i], ids[i]))[:k]
        assert found.tolist() == [ids[i] for i in best] and scores == [exact[i] for i in best]


def test_impact_index_leaves_out_what_bounds_prove():
    rng = np.random.default_rng(0)
    vectors = rng.integers(-80, 80, (4000, 16))
    index = ImpactIndex(np.arange(4000), vectors)
    sizes = [len(index.possible(q, 6)) for q in rng.integers(-80, 80, (20, 16)).tolist()]
    assert max(sizes) <= 2000
    assert all((a >= b).all() for side in index.impacts for a, b in pairwise(side.T))
