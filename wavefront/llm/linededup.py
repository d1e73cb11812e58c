"""Line deduplication by overlapping three-line windows.

The non-blank lines of a text give overlapping windows of three. Windows are
named by 128 hash bits of their lines; a grouping with partial sums finds the
names that occur more than once and the first occurrence of each. All other
occurrences cover their lines, covered stretches are merged, and what is
covered is removed. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HIDDEN, ROW_KEY, bounded, durable, with_row_key


#: How a text is cut, what stands between the parts, and what is no content at their ends.
UNITS = {"lines": ("\n", "\n", " "), "sentences": (r"(?<=\n)|(?<=[.!?])(?=[ \t])", "", " \t\n")}


def _windows(lines: Column, width: int, blank: str) -> Column:
    """Array of (h1, h2, a, b): a window's name and its first and last line.

    A text with fewer non-blank lines than ``width``, but some, is one window.
    """
    full = F.filter(F.transform(lines, lambda x, i: F.struct(F.btrim(x, F.lit(blank)).alias("x"), i.alias("i"))), lambda s: s.x != "")

    def of(full: Column) -> Column:
        n = F.least(F.size(full), F.lit(width))
        starts = F.sequence(F.lit(0), F.size(full) - n)

        def window(s: Column) -> Column:
            part = F.slice(full, s + 1, n)
            text = F.transform(part, lambda p: p.x)
            return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.get(part, F.lit(0)).i.alias("a"), F.get(part, n - 1).i.alias("b"))

        return F.when(n > 0, F.transform(starts, window))

    # a one-element array binds the list of lines, so that it is made once
    return F.get(F.transform(F.array(full), of), F.lit(0))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_lines: str = "n_lines", n_removed: str = "n_removed", units: str = "lines") -> DataFrame:
    """``docs`` with the repeated lines cut from the text, and the numbers of lines before and of lines removed.

    Of equal windows the first stays, in the order of id (null last), hash of
    the text, and place; the lines of all others go, with blank lines between
    them. ``units``: "sentences" takes sentences and line ends in the place of
    lines, which finds passages inside long lines as well, and cuts near copies
    to what is their own. Rows of the same id and text are one document here and keep the same
    lines. Null texts stay null with 0 lines; a text may become empty, and an
    empty table stays empty. A text is handled whole, as one row, however many
    lines it has; a text repeated everywhere has its windows counted in parts
    before they meet. Columns
    with the names of added ones are replaced, all others stay as they are.
    """
    parting, glue, blank = UNITS[units]
    a, b, h1, h2, cut = (f"{HIDDEN}{x}" for x in ("a", "b", "h1", "h2", "cut"))
    keyed = with_row_key(docs.drop(n_lines, n_removed), id_col, text_col)
    seen = keyed.select(F.col(f"`{id_col}`").alias(f"{HIDDEN}doc"), *ROW_KEY, F.explode(_windows(F.split(F.col(f"`{text_col}`"), parting), width, blank)).alias("w"))
    seen = seen.select(f"{HIDDEN}doc", *ROW_KEY, F.col("w.h1").alias(h1), F.col("w.h2").alias(h2), F.col("w.a").alias(a), F.col("w.b").alias(b))
    place = F.struct(F.col(f"{HIDDEN}doc").isNull(), f"{HIDDEN}doc", f"{HIDDEN}h", a)
    least = [f"{HIDDEN}{x}" for x in ("null", "first_doc", "first_h", "first_a")]
    first = seen.groupBy(h1, h2).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    # a table of its own: few are broadcast; beyond that both sides are shuffled for the join, so that a passage found everywhere can be split
    first = durable(first.select(h1, h2, *[F.col("first").getField(f.name).alias(c) for f, c in zip(first.schema["first"].dataType, least)]))
    later = seen.join(bounded(first), [h1, h2]).where(~place.eqNullSafe(F.struct(*least)))
    covered = later.groupBy(*ROW_KEY).agg(F.collect_set(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias(cut))
    lines = F.split(F.col(f"`{text_col}`"), parting)
    gone = F.flatten(F.transform(cut, lambda r: F.sequence(r.a, r.b)))
    left = F.array_except(F.sequence(F.lit(0), F.size(f"{HIDDEN}lines") - 1), gone)
    out = keyed.join(covered, ROW_KEY, "left").withColumn(f"{HIDDEN}lines", lines)
    out = out.withColumn(f"{HIDDEN}left", F.when(F.col(cut).isNotNull(), left))
    whole, kept = F.coalesce(F.size(f"{HIDDEN}lines"), F.lit(0)), F.col(f"{HIDDEN}left")
    total = F.when(F.col(f"`{text_col}`").isNull(), 0).otherwise(whole)
    out = out.withColumns({
        n_lines: total.cast("long"),
        n_removed: F.when(kept.isNotNull(), total - F.size(kept)).otherwise(0).cast("long"),
        text_col: F.when(kept.isNotNull(), F.array_join(F.transform(kept, lambda i: F.get(F.col(f"{HIDDEN}lines"), i)), glue)).otherwise(F.col(f"`{text_col}`")),
    })
    names = list(dict.fromkeys([c for c in docs.columns if c not in (n_lines, n_removed)] + [n_lines, n_removed]))
    return out.select(*[F.col(f"`{c}`") for c in names])
