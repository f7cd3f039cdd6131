"""One query for each operator, over its whole table, and SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate as leaks
from attestry.llm import langid, licenses, pii, wrapper
from attestry.llm.common import read_table
from attestry.llm.embedding_dedup import embedding_dedup
from attestry.llm.line_dedup import line_dedup
from attestry.llm.ngram_join import ngram_join
from attestry.llm.phrases import mine_phrases
from attestry.llm.pieces import sample_pieces
from attestry.llm.spelling import spelling_groups
from attestry.llm.suffix_dedup import suffix_dedup
from attestry.llm.topk_search import topk_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


@query("op1_sampled_pieces")
def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample_pieces(read_table(spark, sf_dir, "documents").select("doc_id", "text"), packed=True)
    fields = ["n_pieces", "log_prob", "perturbed", "log_inclusion", "ids_sha256", "ids"]
    return out.select(
        "doc_id", F.size("segmentations").cast("long").alias("n_samples"), *[F.col(f"segmentations.{f}").alias(f) for f in fields],
        F.forall("segmentations", lambda s: s["decodes"]).alias("decodes"))


@query("op2_ngram_jaccard", r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM ways UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
low AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_decontamination", r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, list_slice(w, i, i + least(10, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, list_slice(w, i, i + size - 1) AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT doc_id, item_id, i, dw.size FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks.decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_line_dedup", r"""
WITH lines AS (SELECT doc_id, i, arr[i] AS line
               FROM (SELECT doc_id, arr, unnest(range(1, len(arr) + 1)) AS i
                     FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS arr FROM documents))),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
spread AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, first IS NOT NULL AND doc_id <> first AS gone FROM keyed LEFT JOIN spread USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.is_held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.is_held_out().alias("held_out"), "lang_pred", "score", "bits")


@query("op3_personal_data")
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.of_kind("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return out.select(
        "doc_id", *counts, F.sha2(pii.span_list(F.col("base")), 256).alias("base_sha256"),
        pii.span_list(F.col("spans")).alias("spans"), F.size("added").cast("long").alias("n_added"))


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.license_scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = F.transform("licenses", lambda x: F.concat_ws(":", x["template"], x["first_word"].cast("string"), x["end_word"].cast("string")))
    return out.select(
        "doc_id", F.size("licenses").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["template"]))), ",").alias("templates"),
        F.array_join(line, ",").alias("spans"))


@query("op7_html_extraction")
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extract_pages(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"))


@query("op9_embedding_dedup", """
WITH RECURSIVE
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE len([y FOR y IN x IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN x IF y <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x)
          WHERE list_dot_product(a.x, b.x) >= 0.9 * a.norm * b.norm),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(vec_id, other) AS (SELECT a, b FROM ways UNION SELECT reach.vec_id, ways.b FROM reach JOIN ways ON ways.a = reach.other),
low AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, least(vec_id, coalesce(other, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN low USING (vec_id)""")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op10_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
c AS (SELECT doc_id, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
f AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM c),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM g GROUP BY doc_id, g),
rest AS (SELECT doc_id, hi AS a, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), n) AS b FROM runs JOIN d USING (doc_id)
         UNION ALL SELECT doc_id, 0, coalesce(min(lo), any_value(n)) FROM d LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM rest JOIN d USING (doc_id) GROUP BY doc_id),
cut AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256,
       coalesce(n_removed, 0) > 0 AS repeated
FROM d LEFT JOIN cut USING (doc_id) JOIN kept USING (doc_id)""")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


@query("op11_phrase_mining", r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
runs AS (SELECT lang, size, list_slice(w, i, i + size - 1) AS w
         FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM p, range(1, 5) AS s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, w, count(*) AS f FROM runs GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM runs WHERE size = 1 GROUP BY lang),
inner_runs AS (SELECT lang, list_slice(w, i, i + m - 1) AS w, f
               FROM (SELECT lang, w, f, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM f WHERE size > 2))),
cover AS (SELECT lang, w, max(f) AS cover FROM inner_runs GROUP BY ALL),
cand AS (SELECT f.lang, f.w, f.size, f.f AS a FROM f LEFT JOIN cover USING (lang, w) WHERE size >= 2 AND (cover IS NULL OR 100 * cover < 80 * f.f)),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM cand),
cut_scores AS (SELECT cuts.lang, cuts.w, a, k, x.f AS l, y.f AS r, (CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS score
               FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.w = list_slice(cuts.w, 1, k) JOIN f AS y ON y.lang = cuts.lang AND y.w = list_slice(cuts.w, k + 1, cuts.size)),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score,
                  row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""")
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(read_table(spark, sf_dir, "documents").select("text", "lang"))


@query("op12_spelling_variants", r"""
WITH RECURSIVE
crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(i))),
runs AS (SELECT doc_id, w, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents) GROUP BY ALL),
bytes AS (SELECT doc_id, w, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM runs),
checks AS (SELECT w, times, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT) FOR i IN range(len(h) // 2)]),
                                 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table),
fixed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % len(w) AS BIGINT)) || substr(w, CAST(h % len(w) AS BIGINT) + 2) ELSE w END AS word, times FROM checks),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM fixed WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
pairs AS (SELECT a.word AS word, b.word AS other FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.rest = words.word
          UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.rest = words.word),
near AS (SELECT pairs.word, count(*) AS n_near, arg_min(other, (-words.n, other)) AS best FROM pairs JOIN words ON words.word = pairs.other GROUP BY pairs.word),
forms AS (SELECT a.word, a.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= 2 * a.n THEN b.word END AS form, CASE WHEN b.n >= 2 * a.n THEN b.n END AS form_n
          FROM words AS a LEFT JOIN near USING (word) LEFT JOIN words AS b ON b.word = near.best),
chain(word, tip, depth) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, forms.form, depth + 1 FROM chain JOIN forms ON forms.word = chain.tip WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(tip, depth) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op13_topk_search", """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0 AND len(embedding) > 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
           FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
