"""Benchmark decontamination by winnowing.

Of every four consecutive five-word hashes of a text the least is kept. Four
five-grams are eight words, so a span of eight words that a document shares
with a benchmark item has the same least hash in both, and the join of kept
hashes finds it. Hits are then extended: the eight-word windows around a kept
hash are compared with the item's windows as text, so chance hash matches do
no harm. Items of fewer words are one window, found by the hash of all their
words. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, ascii_lower, bounded, durable, with_row_key

#: Words of a window, of a hashed gram, and grams of which the least is kept.
SPAN, GRAM = 8, 5
KEEP = SPAN - GRAM + 1


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters a to z (A-Z lower-cased) and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(w: Column, n: int) -> Column:
    """The hashes of all n consecutive words, seeded by n; empty if there are fewer words."""
    at = F.sequence(F.lit(0), F.size(w) - n)
    return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(F.lit(n), *[F.get(w, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: Column) -> Column:
    """The least of every KEEP consecutive hashes."""
    at = F.sequence(F.lit(0), F.size(grams) - KEEP)
    return F.when(F.size(grams) >= KEEP, F.transform(at, lambda i: F.least(*[F.get(grams, i + j) for j in range(KEEP)]))).otherwise(F.array().cast("array<bigint>"))


def _spans(starts: Column, n: int) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("s"), F.lit(n).alias("n")))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted as strings).

    A word is hit if it is in any occurrence of a window of any item: eight
    consecutive words of it, or all of them if it has fewer. ``items`` are the
    items of which a window occurs. Null texts have no words; items without an
    id or without words take no part; a repeated item id is one item. Rows of
    one id and text get the same result. Empty tables: no rows, or no hits.
    """
    item = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words(F.col(f"`{item_text_col}`")).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    item = item.withColumn("g", _grams(F.col("w"), GRAM))
    part = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - SPAN + 1)), lambda i: F.array_join(F.slice("w", i, SPAN), " "))
    windows = durable(item.select("item", F.explode(part).alias("window")).distinct())
    texts = bounded(durable(windows.select("window").distinct()))
    short = [r[0] for r in item.where(F.size("w") < SPAN).select(F.size("w")).distinct().collect()]  # seven values at most
    prints = item.where(F.size("w") >= SPAN).select(F.explode(_kept(F.col("g"))).alias("f"))
    for n in short:
        prints = prints.unionByName(item.where(F.size("w") == n).select(F.explode(_grams(F.col("w"), n)).alias("f")))
    prints = bounded(durable(prints.distinct()))

    keyed = with_row_key(docs.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")), "doc", "text")
    tokens = keyed.select("doc", *ROW_KEY, words(F.col("text")).alias("w"))
    own = tokens.select("doc", *ROW_KEY, "w", _grams(F.col("w"), GRAM).alias("g")).select("doc", *ROW_KEY, "w", _kept(F.col("g")).alias("k"))
    marks = F.concat("k", *[_grams(F.col("w"), n) for n in short])
    own = durable(own.select("doc", *ROW_KEY, F.size("w").cast("long").alias("n_words"), F.array_distinct(marks).alias("marks")))
    found = own.select(*ROW_KEY, F.explode("marks").alias("f")).join(prints, "f").groupBy(*ROW_KEY).agg(F.collect_set("f").alias("seeds"))
    found = durable(found)

    # few texts have a hash in common with an item: only these are cut into words again
    ids = bounded(durable(found.select(*ROW_KEY)))
    texts_found = keyed.join(ids, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).join(found, ROW_KEY).withColumn("w", words(F.col("text")))
    near = texts_found.select(*ROW_KEY, "w", "seeds", _grams(F.col("w"), GRAM).alias("g"))
    near = near.withColumn("at", F.filter(F.transform("g", lambda h, i: F.when(F.array_contains(F.col("seeds"), h), i)), lambda i: i.isNotNull()))
    last = F.size("w") - SPAN
    starts = F.array_distinct(F.flatten(F.transform(F.filter("at", lambda i: last >= 0), lambda i: F.sequence(F.greatest(F.lit(0), F.least(i, last) - KEEP + 1), F.least(i, last)))))
    places = [_spans(starts, SPAN)]
    for n in short:
        same = F.transform(_grams(F.col("w"), n), lambda h, i: F.when(F.array_contains(F.col("seeds"), h), i))
        places.append(_spans(F.filter(same, lambda i: i.isNotNull()), n))
    near = near.select(*ROW_KEY, "w", F.concat(*places).alias("places"))
    tried = near.select(*ROW_KEY, F.explode(F.transform("places", lambda p: F.struct(p.s.alias("s"), p.n.alias("n"), F.array_join(F.slice("w", p.s + 1, p.n), " ").alias("window")))).alias("p")).select(*ROW_KEY, "p.*")
    occurs = durable(tried.join(texts, "window"))
    covered = occurs.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("s", "n")).alias("c"))
    covered = covered.select(*ROW_KEY, F.size(F.array_distinct(F.flatten(F.transform("c", lambda x: F.sequence(x.s, x.s + x.n - 1))))).alias("n_hit"))
    named = occurs.select(*ROW_KEY, "window").distinct().join(windows, "window").groupBy(*ROW_KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marked = covered.join(named, ROW_KEY)
    out = own.select("doc", *ROW_KEY, "n_words").join(marked, ROW_KEY, "left")
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), *ROW_KEY)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows in which windows of ``least_items`` items or more occur.

    All columns stay as they are; nulls and ties as in :func:`hits`.
    """
    marked = hits(docs, benchmark, id_col, text_col).where(F.size("items") >= least_items).select(*ROW_KEY).distinct()
    return with_row_key(docs, id_col, text_col).join(marked, ROW_KEY, "left_anti").drop(*ROW_KEY)


__all__ = ["drop_contaminated", "hits", "words"]
