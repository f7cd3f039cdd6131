"""Personal data by weak supervision, in DataFrame functions only.

Labelers vote on candidate spans, expectation-maximisation estimates how far
each can be trusted, and a naive Bayes classifier of the span's shape and
surroundings, trained on the resulting probabilities, decides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: The leftmost match always starts a run of its first class, or where the last match ended, and never has to give back
#: a character; lookbehinds and possessive repeats say so, and keep long runs linear.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried at all.
GUARDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
    "email2": r"(?i)[\x20(\[]at[\x20)\]]", "phone2": r"[0-9]{3}[\x20.-][0-9]{4}",
}
#: Wider nets for spans that the base rules do not cover; the classifier decides on them.
WIDE = {
    "email2": rf"(?i)(?<!{_LOCAL}){_LOCAL}++\x20?(?:\(at\)|\[at\]|at)\x20?{_HOST}++\x20?(?:\(dot\)|\[dot\]|dot)\x20?[a-z]{{2,12}}(?![A-Za-z0-9])",
    "phone2": r"(?<![0-9+().\x20-][\x20(]|[0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}
# Gazetteers.
TOP_DOMAINS = "com org net edu gov mil int info biz io co me eu de fr es it uk us ca au ch at be nl pl pt br mx jp cn in ru".split()
CALLING_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|64|65|62)"
RESERVED_NETS = r"^0*(?:0|127|255)\."
# Words before a span that speak for its kind, and words that speak against personal data.
CONTEXT_WORDS = {
    "email": r"(?i)(?:mail|contact|kontakt|contacto|correo|courriel|write to|reach)",
    "ip": r"(?i)(?:\bip\b|host|server|address|adresse|direcci)",
    "card": r"(?i)(?:card|visa|master|amex|karte|carte|tarjeta|payment|credit)",
    "phone": r"(?i)(?:tel|phone|call|fax|mobil|cell|anruf|llam|appel|whatsapp)",
}
AGAINST_WORDS = r"(?i)(?:version|release|isbn|order|invoice|serial|part no|build|chapter|section)"
SIDE = 24
FIELDS = "array<struct<kind:string,start:int,end:int,span:string,before:string,after:string>>"


#: Matches whose positions are summed up together; blocks of them are shifted by the lengths of earlier blocks.
RUN = 128


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(text: Column, pattern: str, guard: str, kind: str) -> Column:
    """All matches of a pattern with code point positions and their surroundings.

    The gaps between matches give the positions. They are summed up in blocks of
    RUN matches, so that no step copies more than a block of spans.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    walk = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next")), lambda x: x["hit"].isNotNull())

    def long(x: Column) -> Column:
        return F.length(x["gap"]) + F.length(x["hit"])

    def block(walk: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(walk) - 1) / RUN).cast("int")), lambda i: F.slice(walk, i * RUN + 1, F.lit(RUN)))

    def begins(blocks: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(blocks, first, lambda s, x: F.struct(
            (s["at"] + F.aggregate(x, F.lit(0), lambda n, y: n + long(y))).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["hit"].alias("span"),
            F.right(x["gap"], F.lit(SIDE)).alias("before"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(2)).alias("after"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).cast(FIELDS).alias("out"))

    def spans(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(FIELDS).alias("out")), step, lambda s: s["out"])

    none = F.array().cast(FIELDS)
    found = _let(walk, lambda w: F.when(F.size(w) > 0, _let(block(w), lambda b: _let(begins(b), lambda a: F.flatten(
        F.transform(b, lambda x, i: spans(x, F.get(a, i))))))).otherwise(none))
    return F.when(text.rlike(guard), found).otherwise(none)


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(span: Column) -> Column:
    figures = F.transform(F.split(F.reverse(_digits(span)), ""), lambda d, i: d.cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(figures, F.lit(0), lambda s, d: s + F.coalesce(F.when(d > 9, d - 9).otherwise(d), F.lit(0))) % 10 == 0


def base_holds(kind: str, span: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's check."""
    figures = F.length(_digits(span))
    return {
        "email": F.lit(True),
        "ip": span.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
        "card": figures.between(12, 19) & _luhn(span),
        "phone": figures.between(9, 15),
    }[kind]


def _passes(kind: str):
    return lambda x: base_holds(kind, x["span"])


def of_kind(spans: str, kind: str) -> Column:
    """How many of the spans are of this kind."""
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def _votes(x: Column) -> list[Column]:
    """Regex, gazetteer and context labelers: 1 for, -1 against, 0 no opinion.

    The base rules say nothing on spelled-out addresses and national numbers: they
    are not made for these forms.
    """
    kind, span = x["kind"], x["span"]

    def case(by_kind: dict[str, Column]) -> Column:
        out = F.lit(0)
        for k, v in by_kind.items():
            out = F.when(kind == k, v).otherwise(out)
        return out

    sign = lambda c: F.when(c, 1).otherwise(-1)
    strict = {
        "email": F.when(span.contains("@"), 1).otherwise(0), "ip": sign(base_holds("ip", span)), "card": sign(base_holds("card", span)),
        "phone": F.when(span.startswith("+"), sign(base_holds("phone", span))).otherwise(0),
    }
    gazetteer = {
        "email": sign(F.lower(F.regexp_extract(span, "([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)),
        "ip": sign(~span.rlike(RESERVED_NETS)),
        "card": sign(_digits(span).rlike(CARD_ISSUERS)),
        "phone": F.when(span.startswith("+"), sign(span.rlike(CALLING_CODES))).otherwise(sign(_digits(span).rlike("^[2-9]"))),
    }
    words = {k: F.when(x["before"].rlike(v), 1).when(x["before"].rlike(AGAINST_WORDS), -1).otherwise(0) for k, v in CONTEXT_WORDS.items()}
    return [case(strict), case(gazetteer), case(words)]


def _features(x: Column) -> list[Column]:
    """What the final classifier sees of a span: never the votes."""
    edge = lambda c: (
        F.when(c == "", "none").when(c.rlike(r"^\s"), "blank").when(c.rlike(r"^\p{L}"), "letter").when(c.rlike("^[0-9]"), "digit").otherwise("mark"))
    return [
        F.concat(F.lit("size "), F.least(F.floor(F.length(x["span"]) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("left "), edge(F.right(x["before"], F.lit(1)))),
        F.concat(F.lit("right "), edge(F.left(x["after"], F.lit(1)))),
        F.concat(F.lit("signs "), F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(x["span"], F.lit(r"[+@(.\x20-]"), F.lit(0)))), "")),
    ]


def estimate(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 100) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over vote patterns: the probability that a span with these votes is personal data.

    Each kind has a share of true spans and each labeler a distribution over its
    three votes for true and for false spans; no opinion is no evidence. Starts from
    the majority vote.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = [(v, n) for k, v, n in counts if k == kind]
        true = {v: 1 / (1 + math.exp(-1.5 * sum(v) - 0.5)) for v, _ in own}
        for _ in range(rounds):
            whole = sum(n for _, n in own)
            share = (sum(n * true[v] for v, n in own) + 1) / (whole + 2)
            rates = [[{w: (sum(n * (true[v] if y else 1 - true[v]) for v, n in own if v[j] == w) + (2 if w == (1 if y else -1) else 1))
                       for w in (-1, 0, 1)} for y in (0, 1)] for j in range(len(own[0][0]))]
            rates = [[{w: r[w] / sum(r.values()) for w in r} for r in labeler] for labeler in rates]
            new = {}
            for v, _ in own:
                odds = math.log(share / (1 - share)) + sum(math.log(rates[j][1][w] / rates[j][0][w]) for j, w in enumerate(v) if w)
                new[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
            done = max(abs(new[v] - true[v]) for v in new) < 1e-9
            true = new
            if done:
                break
        out |= {(kind, v): p for v, p in true.items()}
    return out


def _lookup(values: dict[str, float], key: Column) -> Column:
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[key], F.lit(0.0))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in each text.

    ``base`` has the spans of the fixed rules (email, ip, card, phone), leftmost
    and not overlapping within a kind; ``added`` has further spans (spelled-out
    addresses, national phone numbers, card-like numbers) that the trained
    classifier accepts and that touch no base span: its prior odds are those that
    expectation-maximisation gives the span's votes. A number that fails the card
    check must also be outvoted by its issuer and a context word. ``spans`` has both. All are
    arrays of (kind, start, end, span), by start, then kind as listed; positions are
    code points, end exclusive. One row per input row with the id; NULL and empty
    texts have none; repeated rows are treated alike.

    Scale: no row is joined with another. Spans stay in their document's row; what
    is aggregated over the corpus are counts of vote patterns (at most 27 per kind)
    and of feature values, both bounded by the labelers and features.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    raw = {k: _found(text, PATTERNS[k], GUARDS[k], k) for k in KINDS}
    raw |= {k: _found(text, WIDE[k], GUARDS[k], k[:-1]) for k in WIDE}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), *[c.alias(k) for k, c in raw.items()])
    base = F.concat(*[F.filter(k, _passes(k)) for k in KINDS])
    missed = F.filter("card", lambda x: ~base_holds("card", x["span"]) & F.length(_digits(x["span"])).between(13, 19))
    rows = rows.select("id", base.alias("base"), F.concat(missed, "email2", "phone2").alias("wide"))
    apart = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = stored(rows.select("id", "base", F.filter("wide", apart).alias("wide")), "spans")

    spans = rows.select(F.explode(F.concat("base", "wide")).alias("x")).select(
        F.col("x.kind").alias("kind"), F.array(*_votes(F.col("x"))).alias("votes"), F.array(*_features(F.col("x"))).alias("features"))
    counted = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()
    true = estimate([(r["kind"], tuple(r["votes"]), r["n"]) for r in counted])
    name = lambda kind, votes: F.concat_ws(" ", kind, F.array_join(votes, " "))
    belief = _lookup({f"{k} {' '.join(map(str, v))}": p for (k, v), p in true.items()}, name(F.col("kind"), F.col("votes")))
    weights = (
        spans.select("kind", belief.alias("p"), F.explode("features").alias("value"))
        .groupBy("kind", "value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    )
    table = {}
    for kind in KINDS:
        own = [r for r in weights if r["kind"] == kind]
        yes, no = (sum(r[c] for r in own) / 4 for c in ("yes", "no"))
        for r in own:
            table[f"{kind} {r['value']}"] = math.log((r["yes"] + 1) / (yes + 20)) - math.log((r["no"] + 1) / (no + 20))

    odds = {f"{k} {' '.join(map(str, v))}": math.log((p + 1e-9) / (1 - p + 1e-9)) for (k, v), p in true.items()}

    def accepted(x: Column) -> Column:
        score = _lookup(odds, name(x["kind"], F.array(*_votes(x))))
        for value in _features(x):
            score = score + _lookup(table, F.concat_ws(" ", x["kind"], value))
        votes = _votes(x)
        return (score > 0) & ((votes[0] >= 0) | (votes[0] + votes[1] + votes[2] > 0))

    order = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])

    def sorted_spans(spans: Column) -> Column:
        keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("nth"), x["kind"].alias("kind"), x["end"].alias("end"), x["span"].alias("span")))
        return F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["span"].alias("span")))

    added = F.filter("wide", accepted)
    return rows.select(
        F.col("id").alias(id_col), sorted_spans(F.col("base")).alias("base"), sorted_spans(added).alias("added"),
        sorted_spans(F.concat("base", added)).alias("spans"))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
