"""Drop lines that other documents already hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import hash_pair, lower_ascii

BLANKS = "' \\t\\n\\u000b\\f\\r'"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.expr(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Lines whose key occurs in ``min_docs`` documents stay only in the smallest id holding them.

    Explodes normalised lines, hashes them to 128 bits, counts the distinct
    documents of each hash, and cuts the lines out by position. Keys shorter than
    ``min_chars`` code points always stay.

    Returns the columns of ``docs`` with the remaining text in ``text_col``, and
    ``n_lines`` (before) and ``n_dropped``; columns of these names are replaced.
    NULL and empty texts are one empty line, and NULL becomes empty. A NULL id
    counts as the smallest id; rows that share an id are one document. Repeats of
    a line inside the document that keeps it stay.

    Scale: the exploded rows carry two hashes, an id and a position. Distinct
    documents are counted through partial aggregates (the smallest and the
    largest id for a threshold of two), so a line held by a third of all
    documents is merged before the shuffle. Lines are joined with the repeated
    hashes only; both sides of that join can be split where a key is hot.
    """
    kind = docs.schema[id_col].dataType
    rank = F.coalesce(F.col(f"`{id_col}`"), F.lit(-(2**63)).cast(kind))
    lines = F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n", -1)
    version = F.xxhash64(F.col(f"`{text_col}`"))
    keys = (
        docs.select(rank.alias("id"), version.alias("version"), F.posexplode(lines).alias("pos", "line"))
        .select("id", "version", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "pos", *[h.alias(f"h{i}") for i, h in enumerate(hash_pair(F.col("key")))])
    )
    if min_docs <= 2:
        spread = keys.groupBy("h0", "h1").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        spread = keys.select("h0", "h1", "id").distinct().groupBy("h0", "h1").agg(F.min("id").alias("first"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    drops = (
        keys.join(spread.select("h0", "h1", "first"), ["h0", "h1"])
        .where("id > first")
        .groupBy("id", "version")
        .agg(F.collect_set("pos").alias("drops"))
    )
    rest = [c for c in docs.columns if c.lower() not in (text_col.lower(), "n_lines", "n_dropped")]
    held = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), rank.alias("id"), version.alias("version"), lines.alias("lines")
    )
    joined = held.join(drops, ["id", "version"], "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drops")), lambda i: F.get(F.col("lines"), i))
    text = F.concat_ws("\n", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(kept))
    made = {text_col: text, "n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("drops"), F.lit(0)).cast("long")}
    order = [c if c in rest else text_col for c in docs.columns if c in rest or c.lower() == text_col.lower()]
    out = [F.col(f"row.`{c}`").alias(c) if c in rest else made[text_col].alias(text_col) for c in order]
    return joined.select(*out, made["n_lines"].alias("n_lines"), made["n_dropped"].alias("n_dropped"))
