"""Text operators against plain versions on small tables with planted cases."""

import random

import numpy as np
import pytest
from pyspark.sql import Row

from attestry.llm import langid, licenses, pii, wrapper
from attestry.llm.decontaminate import decontaminate
from attestry.llm.embedding_dedup import embedding_dedup, settings
from attestry.llm.line_dedup import line_dedup
from attestry.llm.ngram_join import ngram_join, product
from tests.llm import brute

TEXT = "doc_id long, text string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}x" for _ in range(n)]


def near_copies(seed=3):
    """Groups of exact and near copies, a passage that many documents share, short and empty texts."""
    rng = random.Random(seed)
    rows, at = [], 0
    passage = words(rng, 40)
    for group in range(12):
        base = words(rng, rng.choice([3, 5, 30, 120, 200]), 4000)
        for _ in range(rng.choice([1, 2, 7, 30])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            rows.append((at, " ".join(own)))
            at += 1
    for _ in range(60):
        own = words(rng, 60, 4000)
        own[20:20] = passage
        rows.append((at, " \t".join(own).upper()))
        at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n\t "), (at + 3, "one"), (at + 4, "ONE"), (at + 5, "one two three four five")]
    rng.shuffle(rows)
    return rows


def test_ngram_join_matches_all_pairs(spark):
    rows = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == brute.ngram_join(rows)


def test_ngram_join_long_columns(spark):
    """Many documents of one phrase list in several groups: long columns that hold more than one component."""
    rng = random.Random(5)
    core = words(rng, 120, 10**6)
    rows = []
    for i in range(240):
        own = list(core)
        for j in range(i % 4 * 7):
            own[(j * 17) % len(own)] = f"g{i % 4}y{j}"
        own[rng.randrange(len(own))] = f"e{i}"
        rows.append((i, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, TEXT)).collect()}
    assert got == brute.ngram_join(rows)


def test_ngram_join_edges(spark):
    assert ngram_join(spark.createDataFrame([], TEXT)).collect() == []
    rows = [Row(doc_id=None, text="a b c d e", component_id="x"), Row(doc_id=4, text="a b c d e", component_id="x"),
            Row(doc_id=4, text="a b c d e", component_id="x"), Row(doc_id=2, text="A b  c d e", component_id=None)]
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect())
    assert got == [(-1, 2, None), (2, 2, 2), (4, 2, 2), (4, 2, 2)]


def test_product_of_blocks():
    rng = np.random.default_rng(2)
    base = np.sort(rng.choice(2**40, 9000, replace=False).astype(np.uint64))
    sets = [np.sort(rng.choice(base, size, replace=False)) for size in (9000, 8800, 7000, 8000, 8000, 50, 1)]
    sizes = np.array([len(s) for s in sets])
    x, y = np.nonzero(product(sets, sets, sizes, sizes, 85))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
            if 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))}
    assert set(zip(x.tolist(), y.tolist())) == want


def test_line_dedup(spark):
    line = "Subscribe to the newsletter"
    rows = [(5, f"{line}\nalpha beta gamma\n{line}"), (2, f"  {line.upper()}\t\nown words here\nshort"), (9, f"short\n{line}"),
            (7, None), (8, ""), (11, "\n\n"), (12, "own words here")]
    out = line_dedup(spark.createDataFrame([(*r, "x") for r in rows], TEXT + ", n_lines string"))
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    assert got == brute.line_dedup(rows)
    assert got[5] == (3, 2, "alpha beta gamma")


def test_line_dedup_edges(spark):
    assert line_dedup(spark.createDataFrame([], TEXT)).collect() == []
    rows = [(None, "a shared line of text"), (1, "a shared line of text"), (1, "a shared line of text"), (2, "x" * 300000 + "\n" + "a shared line of text")]
    got = sorted((r.doc_id or -1, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, TEXT)).collect())
    assert got == [(-1, 0), (1, 1), (1, 1), (2, 1)]
    three = line_dedup(spark.createDataFrame([(1, "a shared line of text"), (2, "a shared line of text")], TEXT), min_docs=3)
    assert [r.n_dropped for r in three.collect()] == [0, 0]


def test_decontaminate(spark):
    rng = random.Random(1)
    items = [(1, " ".join(words(rng, 25))), (2, " ".join(words(rng, 10))), (3, "Short Item"), (4, None), (5, "..."), (3, "Short Item")]
    docs = []
    for i in range(40):
        own = words(rng, 80)
        item = items[i % 3][1].split()
        if i % 2:
            own[30:30] = item[i % 7 :][:12]
        docs.append((i, ", ".join(own).upper()))
    docs += [(100, None), (101, ""), (102, "short item"), (103, "a short item, short-item"), (104, items[0][1] * 3)]
    out = decontaminate(spark.createDataFrame([(*d, 7) for d in docs], TEXT + ", items int"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out.collect()}
    assert got == brute.contamination(docs, items)
    assert got[103][1] == 4 and sum(v[1] > 0 for v in got.values()) > 10
    empty = decontaminate(spark.createDataFrame(docs, TEXT), spark.createDataFrame([], "item_id long, text string"))
    assert {r.n_hit for r in empty.collect()} == {0}
    assert decontaminate(spark.createDataFrame([], TEXT), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_decontaminate_in_several_tables(spark, monkeypatch):
    monkeypatch.setattr("attestry.llm.decontaminate.TABLE_WINDOWS", 5)
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 14))) for i in range(6)]
    docs = [(i, " ".join(words(rng, 20) + items[i % 6][1].split()[:11])) for i in range(12)]
    out = decontaminate(spark.createDataFrame(docs, TEXT), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in out.collect()} == brute.contamination(docs, items)


PII = [
    "write a.b@c.co_m@x.y or me+you%z@mail-1.example.org. Not a@b nor @c.d",
    "ips 1.2.3.4.5.6.7.8, 256.1.1.1, 010.0.0.255 and 999.1.2.3.4",
    "card 4425 4142-5915 7784 x 4425414259157784, 4425414259157785, 12345678901234567890123",
    "+1 (319) 555-5132 and +49.30.123456 and +12 and +1234567890123456 or + 1",
    "é漢 é@é a@b.c漢d 4425414259157784é+33 1 23 45 67 89.", None, "", "x" * 50000 + "@" + "y" * 50000 + ".z", "1-" * 40000, "1 2.3.4.5@6.7",
]


def test_pii_base_rules(spark):
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(PII)), TEXT)).collect()}
    for i, text in enumerate(PII):
        assert [(s.kind, s.start, s.end) for s in got[i].base] == brute.base_pii(text), i
        assert all(text[s.start : s.end] == s.span for s in got[i].spans)
        assert set(got[i].base) <= set(got[i].spans)


def test_pii_learns_further_spans(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        rows.append((i, f"{' '.join(words(rng, 6))} phone +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} end mail u{i}@mail{i % 7}.example.com now"))
    rows += [(200, "please call (319) 555-5132 today"), (201, "version 2.0 of order 1234-5678 in 1999"), (202, "plain words only")]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(rows, TEXT)).collect()}
    assert [s.span for s in got[200].added] == ["(319) 555-5132"]
    assert got[201].spans == [] and got[202].spans == []
    assert pii.find_pii(spark.createDataFrame([], TEXT)).collect() == []


def test_pii_needs_no_context_word(spark):
    """The classifier decides alone: spelled-out and national forms without a word for them are found, failed card numbers are not."""
    rng = random.Random(14)
    rows = []
    for i in range(200):
        rows.append((i, f"{' '.join(words(rng, 6))} phone +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} end mail u{i}@mail{i % 7}.example.com now visa 4425414259157784 so"))
    for i in range(200, 220):
        rows.append((i, f"see ({i + 119}) 555-{i + 5000} or jo{i} at example dot com today"))
    rows += [(300 + i, f"see 44254142591577{85 + i} end") for i in range(9)]
    got = {r.doc_id: [s.span for s in r.added] for r in pii.find_pii(spark.createDataFrame(rows, TEXT)).collect()}
    for i in range(200, 220):
        assert got[i] == [f"({i + 119}) 555-{i + 5000}", f"jo{i} at example dot com"], i
    assert all(not got[300 + i] for i in range(9)), [got[300 + i] for i in range(9)]


def test_pii_estimate_trusts_agreeing_labelers():
    counts = [("phone", (1, 1, 1), 50), ("phone", (1, 1, 0), 30), ("phone", (-1, -1, 0), 60), ("phone", (-1, 1, 1), 2)]
    p = pii.estimate(counts)
    assert p["phone", (1, 1, 1)] > 0.95 and p["phone", (-1, -1, 0)] < 0.05


def test_license_scan(spark):
    rng = random.Random(6)
    rows = []
    names = list(licenses.TEMPLATES)
    for i in range(80):
        own = words(rng, rng.choice([4, 30, 200]), 10**6)
        if i % 2:
            text = licenses.TEMPLATES[names[i % len(names)]].split()
            if i % 3 == 0 and len(text) > 30:
                text[11] = "changed"
            at = rng.randrange(len(own))
            own[at:at] = text
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, "Licensed under"), (103, "released under the mit license")]
    got = {r.doc_id: {x.template for x in r.licenses} for r in licenses.license_scan(spark.createDataFrame(rows, TEXT)).collect()}
    for i, text in rows:
        assert brute.licenses(text, licenses.TEMPLATES) <= got[i], i
    assert got[100] == got[101] == got[102] == set() and got[103] == {"MIT (notice)"}
    assert all(not got[i] for i in range(0, 80, 2))
    (one,) = licenses.license_scan(spark.createDataFrame([(1, "some words. Released under the MIT License. more")], TEXT)).collect()
    assert [(x.template, x.first_word, x.end_word, x.containment) for x in one.licenses] == [("MIT (notice)", 2, 7, 1.0)]
    assert licenses.license_scan(spark.createDataFrame([], TEXT)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad {i} --><div class="ad">Buy {i}</div>
<article><h1>Title&nbsp;{i}</h1><p><b>First &amp; <i>second</i>
 line {i}<br><p>Next &#233; {i}</p><form>name <input></form><div id="comments"><p>Great post {i}</p></div></article>
<aside>See also</aside><footer>&copy; site</footer></body>"""


def test_html_marked_article(spark):
    rows = [(i, f"https://a.example.com/{i}", PAGE.format(i=i)) for i in range(6)] + [(10, None, None), (11, "not a url", ""), (12, "https://b/", "plain <b>text")]
    out = wrapper.extract_pages(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, Text string"))
    got = {r.page_id: (r.blocks, r.text) for r in out.collect()}
    for i in range(6):
        assert got[i][1] == f"Title {i}\n\nFirst & second line {i}\n\nNext é {i}"
    assert got[10] == ([], "") and got[11] == ([], "") and got[12] == (["plain text"], "plain text")
    assert wrapper.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_wrapper_finds_slots(spark):
    """Pages without article: what is constant over the host goes, what varies stays."""
    page = ("<html><body><div class='top'><span>Site name</span></div><div class='box'><h2>Story {i}</h2><p>{w}</p>"
            "<p>All rights reserved by nobody</p></div><div class='low'>Made with care</div></body></html>")
    rng = random.Random(2)
    rows = [(i, "http://c.example.org/x", page.format(i=i, w=" ".join(words(rng, 30)))) for i in range(9)]
    got = {r.page_id: r.blocks for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        assert got[i] == [f"Story {i}", html.split("<p>")[1].split("</p>")[0]]


PAGES = "page_id long, url string, html string"


def test_html_template_inside_article(spark):
    """Constant blocks go although an article holds them; the rest of the article stays, its links too."""
    page = ("<html><body><div>Shop</div><article><h1>Story {i}</h1><div class='box'>Read our house rules before you write</div>"
            "<div class='text'><p>{w}</p><p><a href='/'>Source {i} of it all</a></p></div></article><p>Seen {i} times</p></body></html>")
    rng = random.Random(8)
    rows = [(i, "http://d.example.org/x", page.format(i=i, w=" ".join(words(rng, 30)))) for i in range(9)]
    got = {r.page_id: r.blocks for r in wrapper.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, html in rows:
        assert got[i] == [f"Story {i}", html.split("<p>")[1].split("</p>")[0], f"Source {i} of it all"]


def test_html_teaser_inside_main(spark):
    page = "<html><body><main><h1>Story {i}</h1><p>{w}</p><article><p>Also read {i}</p></article></main></body></html>"
    rng = random.Random(9)
    rows = [(i, f"http://{'e' if i < 6 else i}.example.org/x", page.format(i=i, w=" ".join(words(rng, 30)))) for i in range(8)]
    got = {r.page_id: r.blocks for r in wrapper.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, html in rows:
        assert got[i][:2] == [f"Story {i}", html.split("<p>")[1].split("</p>")[0]]


def test_html_names_only_vote(spark):
    """Frames and compounds whose names sound like menus keep their text; small named boxes go."""
    rng = random.Random(10)
    long = [" ".join(words(rng, 30)) for _ in range(6)]
    article = "<article><div class='article-header'><h1>Story {i}</h1></div><p>It cost <span class='share-price'>{i} crowns</span> then {w}</p></article>"
    frames = [
        "<div class='layout has-sidebar'>" + article + "</div>", "<div class='sidebar'>" + article + "</div>", "<form>" + article + "</form>",
        "<div class='post no-comments'>" + article + "</div>", "<div class='search-results-page copyright-law'>" + article + "</div>",
        "<div class='widget'><div class='article-header'><h1>Story {i}</h1></div><p>It cost <span class='share-price'>{i} crowns</span> then {w}</p></div>",
    ]
    rows = [(i, f"http://f{i}.example.org/", f"<body>{f.format(i=i, w=long[i])}<div class='related-posts'>See {i}</div><div class='top ad'>Buy {i}</div></body>") for i, f in enumerate(frames)]
    got = {r.page_id: r.blocks for r in wrapper.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(6):
        assert got[i] == [f"Story {i}", f"It cost {i} crowns then {long[i]}"], i
    page = f"<body><div class='x'><p>{long[0]}</p><p><a href='/'>A source in a paragraph</a></p></div></body>"
    assert wrapper.extract(page, set(), "") == [long[0], "A source in a paragraph"]


def test_html_asides_go_whatever_their_size():
    """Comments, forms and adverts longer than a short article; a list of links under the text stays."""
    rng = random.Random(11)
    text, long = " ".join(words(rng, 8)), " ".join(words(rng, 90))
    asides = [f"<{tag} {name}><p>{long}</p><p>{long}</p></{tag.split()[0]}>" for tag, name in (
        ("div", "class='comments'"), ("section", "id='user-comments'"), ("ul", "class='reader-comments'"), ("form", ""), ("div", "class='ad-slot'"),
        ("div", "class='cookie-notice-x'"))]
    for aside in asides:
        for frame in ("<article><h1>Title</h1><p>{t}</p>{a}</article>", "<article><h1>Title</h1><p>{t}</p></article>{a}",
                      "<main><h1>Title</h1><p>{t}</p>{a}</main>", "<div class='x'><h1>Title</h1><p>{t}</p>{a}</div>"):
            assert wrapper.extract(f"<body>{frame.format(t=text, a=aside)}</body>", set(), "") == ["Title", text], (aside[:40], frame)
    form = f"<body><form id='all'><div class='x'><h1>Title</h1><p>{text}</p></div></form></body>"
    assert wrapper.extract(form, set(), "") == ["Title", text]
    links = "".join(f"<li><a href='/{i}'>Source {i}</a></li>" for i in range(3))
    page = f"<body><ul>{links.replace('Source', 'Menu')}</ul><div class='x'><ul>{links.replace('Source', 'Jump')}</ul><p>{long}</p><ul>{links}</ul></div></body>"
    assert wrapper.extract(page, set(), "") == [long, "Source 0", "Source 1", "Source 2"]


def test_html_long_and_repeated_pages(spark):
    """Every paragraph of a very long page is kept; repeated rows are treated alike."""
    rng = random.Random(13)
    paragraphs = [[f"{i} {k} " + " ".join(words(rng, 6)) for k in range(400)] for i in range(2)]
    pages = ["<body><div>Shop</div><article>" + "".join(f"<p>{p}</p>" for p in own) + "</article></body>" for own in paragraphs]
    rows = [(i % 2, "http://h.example.org/", pages[i % 2]) for i in range(6)]
    got = [(r.page_id, r.blocks) for r in wrapper.extract_pages(spark.createDataFrame(rows, PAGES)).collect()]
    assert len(got) == 6 and all(blocks == paragraphs[i] for i, blocks in got)


def test_html_counts_all_pages_of_a_host(spark):
    """A notice on nine pages of ten goes wherever it is missing, and each of two layouts has its own wrapper."""
    rng = random.Random(12)
    one = "<body><div class='a'><h2>Story {i}</h2><p>{w}</p>{n}</div></body>"
    two = "<body><section><div class='side'><p>Our weather map of every day</p></div><div class='b'><p>{w}</p></div><div class='c'><p>Paper {i}</p></div></section></body>"
    notice = "<p>Terms apply to all readers</p>"
    rows = [(i, "http://g.example.org/", one.format(i=i, w=" ".join(words(rng, 20)), n="" if i % 10 == 3 else notice)) for i in range(40)]
    rows += [(i, "http://g.example.org/", two.format(i=i, w=" ".join(words(rng, 20)))) for i in range(40, 50)]
    got = {r.page_id: r.blocks for r in wrapper.extract_pages(spark.createDataFrame(rows, PAGES), references=2).collect()}
    for i, _, html in rows[:40]:
        assert got[i] == [f"Story {i}", html.split("<p>")[1].split("</p>")[0]], i
    for i, _, html in rows[40:]:
        assert got[i] == [html.split("<p>")[2].split("</p>")[0]], i


def test_simple_tree_matching_pairs_equal_shapes():
    a, b = (wrapper.skeleton(wrapper.parse(p)) for p in ("<div><p>x</p><p>y</p></div>", "<div><p>x</p><h2>q</h2><p>z</p></div>"))
    score, pairs = wrapper.match(a, b)
    assert score == sum(1 for _ in pairs)
    assert ("x", "x") in [(p.text, q.text) for p, q in pairs]


def test_embedding_dedup_matches_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for _ in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append((at, (base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.3])).astype(np.float32).tolist()))
            at += 1
    rows += [(at, rows[0][1]), (at + 1, None), (at + 2, [0.0] * 16), (at + 3, [float("nan")] * 16), (at + 4, [1.0, float("inf")]), (at + 5, [1.0, None]), (at + 6, [2.0] * 4), (at + 7, [3.0] * 4)]
    out = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    assert got == brute.cosines(rows)
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_embedding_dedup_large_bucket(spark, monkeypatch):
    monkeypatch.setattr("attestry.llm.embedding_dedup.BLOCK", 16)
    rng = np.random.default_rng(9)
    base = rng.standard_normal(24)
    rows = [(i, (base + rng.standard_normal(24) * 0.25).astype(np.float32).tolist()) for i in range(120)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == brute.cosines(rows)


@pytest.mark.parametrize("rows", [10, 10**4, 10**8])
def test_embedding_settings(rows):
    size, tables = settings(rows, 0.9)
    assert size >= 2 and tables >= 1


def language(rng, letters, n=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcdeé", "bb": "defghi", "cc": "ghijkß"}
    rows = [(i, language(rng, alphabets[g]), g) for i in range(150) for g in [sorted(alphabets)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 100"))
    out = langid.identify(docs, model).collect()
    assert all(r.lang_pred == r.lang and 0.99 < r.score <= 1 for r in out if r.doc_id >= 100)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "漢字"), (None, "abcde"), (6, "abc" * 10**6)], TEXT)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[6][0] == got[None][0] == "aa" and 0 <= got[4][1] <= 1
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_language_code_lengths_are_exact(spark):
    """The table against escapes followed one by one."""
    docs = spark.createDataFrame([(1, "abracadabra abc", "x"), (2, "banana cab", "y")], "doc_id long, text string, lang string")
    model = langid.train(docs, order=2)
    counts = {}
    for text, lang in (("abracadabra abc", "x"), ("banana cab", "y")):
        for k in range(3):
            for i in range(len(text) - k):
                counts.setdefault((lang, text[i : i + k]), {}).setdefault(text[i + k], 0)
                counts[lang, text[i : i + k]][text[i + k]] += 1

    def bits(lang, context, symbol):
        seen = counts.get((lang, context))
        rest = bits(lang, context[1:], symbol) if context else 8.0
        if not seen:
            return rest
        whole = sum(seen.values()) + len(seen)
        return -np.log2(seen[symbol] / whole) if symbol in seen else -np.log2(len(seen) / whole) + rest

    text = "abcab nazz"
    data = np.frombuffer(text.encode(), np.uint8)
    got = model.lengths(np.array([0, len(data)]), data)[0]
    want = [sum(bits(lang, text[max(0, i - 2) : i], text[i]) for i in range(len(text))) for lang in model.langs]
    assert np.allclose(got, want, rtol=1e-5)


def test_language_lengths_do_not_depend_on_chunks(spark, monkeypatch):
    """Texts cut into chunks anywhere, empty ones among them, cost what they cost alone."""
    rng = random.Random(20)
    docs = spark.createDataFrame([(i, language(rng, "abcdé" if i % 2 else "xyzab"), str(i % 2)) for i in range(40)], "doc_id long, text string, lang string")
    model = langid.train(docs, order=4)
    texts = ["", "abc", *(language(rng, "abcdéxyz", 30) for _ in range(6)), "", "zz", ""]
    raw = [t.encode() for t in texts]
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    alone = [model.lengths(np.array([0, len(r)]), np.frombuffer(r, np.uint8))[0] for r in raw]
    for chunk in (1, 3, 7, 64, 1 << 19):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert np.allclose(model.lengths(offsets, data), alone)


def test_language_order_holds_however_many_contexts(spark):
    """A model of many languages and contexts keeps its order and holds only what was seen."""
    rng = np.random.default_rng(3)
    counts = {}
    for lang in range(12):
        grams = np.unique(rng.integers(0, 256, (60_000, 4), np.int64) @ (256 ** np.arange(4)))
        counts[str(lang)] = {4: (grams, np.ones(len(grams), np.int64))}
    model = langid.CodeTable(counts, 3)
    assert model.order == 3 and sum(len(levels[3][0]) for levels in model.tables) == sum(len(c[4][0]) for c in counts.values())


def test_language_sample_is_bounded_by_rows(spark):
    """Rows without an id and rows of one id are told apart; ties and clashing columns have a defined result."""
    texts = [("a" * 40 + str(i), "x") for i in range(30)] + [("b" * 40 + str(i), "y") for i in range(30)]
    for ids in ([None] * 60, [7] * 60):
        docs = spark.createDataFrame([(i, t, g, "s") for i, (t, g) in zip(ids, texts)] * 2, "doc_id long, text string, lang string, score string")
        model = langid.train(docs, docs_per_language=5)
        assert model.langs == ["x", "y"]
        # of 30 texts with different numbers, five teach: at most ten digits and a letter
        assert all(len(levels[0][0]) <= 11 for levels in model.tables)
        out = langid.identify(docs, model)
        assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score", "bits"]
        assert all(r.lang_pred == r.lang for r in out.collect())
    twins = spark.createDataFrame([(1, "abc abc", "q"), (2, "abc abc", "p")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(twins, langid.train(twins)).collect()} == {"p"}
