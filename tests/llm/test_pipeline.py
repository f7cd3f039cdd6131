"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from attestry.llm import pieces
from tests.llm import brute
from tests.llm.test_text_operators import words


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    line = "Subscribe to our weekly letter today"
    item = " ".join(words(rng, 15, 10**6))
    rows = []
    for i in range(40):
        rows.append([i, f"{' '.join(words(rng, 60, 10**6))}\n{line}", "en", "a", 0])
    copy = rows[5][1].split()
    copy[3] = "other"
    rows += [[50, " ".join(copy), "en", "b", 0], [51, rows[7][1], "en", "b", 0], [52, f"{item} {' '.join(words(rng, 30, 10**6))}", None, None, None],
             [53, None, "en", "b", 0], [54, "12 34 !!", "en", "b", 4], [55, "", "en", "b", 0], [56, line, "en", "b", 3]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        docs = spark.createDataFrame(out.collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in docs.collect()}
    everyone = {r[0] for r in rows}
    assert set(seen["language_id"]) == everyone - {53, 54, 55}
    lines = brute.line_dedup([(r.doc_id, r.text) for r in seen["language_id"].values()])
    assert {i: r.text for i, r in seen["line_dedup"].items()} == {i: t for i, (_, _, t) in lines.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].values())
    groups = brute.ngram_join([(r.doc_id, r.text) for r in seen["line_dedup"].values()], 5, 80)
    assert set(seen["near_copies"]) == {i for i, (_, c) in groups.items() if c == i}
    assert set(seen["decontamination"]) == set(seen["near_copies"]) - {52}
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(result) == set(seen["decontamination"])
    with open(pieces.MODEL, "rb") as file:
        vocabulary = pieces.Vocabulary(file.read())
    assert all(vocabulary.decode(r.piece_ids) == seen["decontamination"][i].text for i, r in result.items())
