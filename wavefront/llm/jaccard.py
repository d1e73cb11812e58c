"""Near copies by the Jaccard similarity of their shingle sets; complete and exact.

The stage form of operator 1. Its fingerprints, here of shingles of this width,
its grid and its check bit by bit give the first candidates. Fingerprints of 64
bits can't separate all pairs at similarity 0.8 from others, so further candidates,
all that there are, come from shared shingles.

1. A text becomes the set of its shingles' 64-bit hashes. Equal sets are one
   node, named by a 64-bit hash of the set. Nodes whose fingerprints operator 1
   links are compared as in step 5 and tied together if they are similar.
2. Two sets of similarity s or more share a shingle among the first
   n - ceil(s n) + 1 of each, in any one order of all shingles. Here frequent
   shingles (passages that many texts share) come last, others by their hashes. A
   task gives an eighth more shingles than needed in the order of the hashes
   alone; what is frequent is counted on one in eight nodes, which only decides
   the order. Only texts with more frequent shingles than that are read again.
3. Nodes that share one of their first shingles are candidates, if in both the
   shingle stands where, for their two sizes, the first common one can stand. So
   a shingle's nodes leave it that no size among the others allows. A pair's common
   first shingles, what is left of both sets behind the last of them, and
   parities of segments bound its overlap; only pairs that may reach s are compared.
4. A big group of copies is tied together first, by comparing all nodes of a
   shingle with one of them that has few shingles of its own; then only candidates
   that are still in different components are compared. A pair within a component
   can't change it.
5. A comparison counts the common shingles of the whole sets.

No list, group or window is cut. DataFrame functions, but for the hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash, wordhash
from .common import HIDDEN, ROW_KEY, SMALL_ROWS, bounded, byte_slices, durable, release, with_row_key
from .components import components

#: One in so many of the first shingles is given besides, four at least.
SPARE = 8
#: Segments of the parities.
CELLS = 2048
#: Nodes that may share a shingle before it counts as frequent.
FEW = 64
#: One in so many nodes is read to find what is frequent.
SAMPLE = 8
#: Rounds in which a shingle's nodes are compared with one of them.
STARS = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending."""
    found = wordhash.words(texts)
    h, ends = found.hashes, np.cumsum(found.per_text)
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for k in range(width):
        grams = grams * _STEP + h[k : k + len(grams)]
    grams = wordhash.mixed(grams).view(np.int64)
    out = []
    for n, end in zip(found.per_text, ends):
        if n >= width:
            part = np.sort(grams[end - n : end - width + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])])
            continue
        one = np.zeros(min(n, 1), np.uint64)
        for x in h[end - n : end]:
            one = one * _STEP + x
        out.append(wordhash.mixed(one).view(np.int64))
    return out


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a text of fewer words is one shingle, without words none."""
    return _sets(pa.array([text or ""]), width)[0]


def _node(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "big", signed=True)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def _parities(found: list[np.ndarray]) -> pa.Array:
    """For each set CELLS bits in longs: whether an odd number of its hashes falls in a cell."""
    out = np.zeros((len(found), CELLS), np.uint8)
    for row, s in zip(out, found):
        row[:] = np.bincount(s & (CELLS - 1), minlength=CELLS) & 1
    longs = np.packbits(out, axis=1).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, longs.size + 1, CELLS // 64, dtype=np.int32), pa.array(longs.ravel()))


def _needed(n: int, per_cent: int) -> int:
    """So many first shingles of a set of n show one of any similar set."""
    return n - (n * per_cent + 99) // 100 + 1


def _spare(k: int) -> int:
    return max(4, k // SPARE)


def _among(found: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of ``found`` are in ``ordered`` (ascending). By bisection: ``ordered`` holds up to
    all frequent shingles of the corpus, so a text must not cost a pass over it."""
    if not len(ordered):
        return np.zeros(len(found), bool)
    return ordered[np.minimum(np.searchsorted(ordered, found), len(ordered) - 1)] == found


def _nodes(rows: DataFrame, width: int, per_cent: int | None, late: np.ndarray | None = None) -> DataFrame:
    """``rows`` with the column text replaced by node, n (the number of its shingles) and the
    first of them: all where ``per_cent`` is None; as many as that similarity needs, those in
    ``late`` (ascending) last, where it is given; else some more than needed, together with ``odd``, the
    parities of the whole set, and ``fp``, the fingerprint of operator 1 on these shingles."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    names, opening = [c for c in rows.columns if c != "text"], per_cent is not None and late is None
    longs = F.array().cast("array<bigint>")
    schema = rows.select(*names, *(F.lit(0).cast("long").alias(c) for c in ("node", "n")), longs.alias("first"), *([longs.alias("odd"), F.lit(0).cast("long").alias("fp")] if opening else [])).schema

    def first(found: np.ndarray) -> np.ndarray:
        if per_cent is None:
            return found
        k = _needed(len(found), per_cent)
        if late is None:
            return found[: k + _spare(k)]
        hot = _among(found, late)
        return np.concatenate([found[~hot], found[hot]])[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for b in byte_slices(batch, at):
                sets = _sets(b.column(at), width)
                new = [pa.array([_node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([first(s) for s in sets])]
                if opening:
                    new += [_parities(sets), pa.array([simhash.fingerprint(t, width) for t in b.column(at).to_pylist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], schema.names)

    return rows.mapInArrow(run, schema)


def _placed(nodes: DataFrame, late: np.ndarray, per_cent: int) -> DataFrame:
    """(node, n, first) with the needed shingles that are not in ``late``; ``first`` is null
    where more are in ``late`` than were given besides."""
    schema = nodes.select("node", "n", "first").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, h in zip(batch.column(1).to_pylist(), batch.column(2)):
                h, k = np.asarray(h.values), _needed(n, per_cent)
                rest = h[~_among(h, late)]
                out.append(rest[:k] if len(h) - len(rest) <= len(h) - min(k, len(h)) else None)
            lists = pa.array(out, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], schema.names)

    return nodes.select("node", "n", "first").mapInArrow(run, schema)


def _frequent(sets: DataFrame) -> np.ndarray:
    """Shingles of more than FEW nodes, ascending, as the one node in SAMPLE tells that ``sets`` holds; no more than SMALL_ROWS."""
    found, least = sets.select(F.explode("first").alias("h")).groupBy("h").agg(F.count("*").alias("df")), FEW // SAMPLE
    found = durable(found.where(F.col("df") > least))
    while found.where(F.col("df") > least).count() > SMALL_ROWS:
        least *= 2
    return np.sort(found.where(F.col("df") > least).select("h").toArrow().column(0).to_numpy())


def _late(nodes: DataFrame, sets_of, per_cent: int) -> np.ndarray:
    """Frequent shingles; any choice gives the same links. First those among the first
    shingles, then all of the sets whose first shingles these crowd."""
    some = durable(nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "n", "first"))
    late = _frequent(some)
    crowded = durable(_placed(some, late, per_cent).where("first IS NULL").select("node"))
    return late if crowded.isEmpty() else np.union1d(late, _frequent(sets_of(crowded)))


def _overlap(one: Column, two: Column, per_cent: int) -> Column:
    """The least number of common shingles of similar sets of these sizes."""
    return F.ceil((one + two) * per_cent / (100.0 + per_cent) - 1e-6)


def _in_reach(rows: DataFrame, least: str, most: str, per_cent: int) -> DataFrame:
    """The rows (n, place) whose shingle can be the first one in common with a similar set of ``least`` to ``most`` shingles."""
    partner = F.greatest(least, F.ceil(F.col("n") * per_cent / 100.0 - 1e-6))
    return rows.where((partner <= F.col(most)) & (F.col("place") <= F.col("n") - _overlap(F.col("n"), partner, per_cent) + 1))


def _verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) of at least that similarity; ``sets``: (node, n, first) with whole sets."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("first").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("first").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c"))
    return both.where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * per_cent).select("a", "b")


def _close(pairs: DataFrame, odd: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) of (a, b, na, nb) that the parities, ``odd``: (node, odd), don't tell
    apart: sets differ in no fewer shingles than the segments in which their parities differ
    (a Manhattan distance)."""
    pairs = pairs.select("a", "b", (F.col("na") + F.col("nb") - 2 * _overlap(F.col("na"), F.col("nb"), per_cent)).alias("most"))
    one, two = odd.select(F.col("node").alias("a"), F.col("odd").alias("oa")), odd.select(F.col("node").alias("b"), F.col("odd").alias("ob"))
    differ = F.aggregate(F.zip_with("oa", "ob", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(one, "a").join(two, "b").where(differ <= F.col("most")).select("a", "b")


def _possible(met: DataFrame, odd: DataFrame, per_cent: int, likely: bool) -> DataFrame:
    """The pairs (a, b) that may be similar enough. ``met``: a row for each common shingle
    among the first ones of both, with its place in either set.

    Three bounds, each of which loses nothing: of sets with enough in common the
    first common shingle leaves room for the others behind it in both; the overlap
    is no more than the common first shingles and what is left behind the last of
    them; and the parities. ``likely``: instead of the second only those that the
    first shingles make likely or a frequent one joins, where others get another turn.
    """
    needed = _overlap(F.col("na"), F.col("nb"), per_cent)
    pairs = met.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent) & (F.col("pa") <= F.col("na") - needed + 1) & (F.col("pb") <= F.col("nb") - needed + 1))
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max("hot").alias("hot"))
    if likely:
        pairs = pairs.where((F.col("c") * 100 >= (F.col("pa") + F.col("pb") - F.col("c")) * (per_cent - 20)) | F.col("hot"))
    else:
        pairs = pairs.where(F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= needed)
    return _close(pairs, odd, per_cent)


def _checked(pairs: DataFrame, sets_of, per_cent: int) -> DataFrame | None:
    """Those of some candidates (a, b) that are links; None if there are no candidates."""
    pairs = durable(pairs)
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    return durable(_verified(pairs, sets_of(wanted), per_cent))


def _fingerprint_links(nodes: DataFrame, sets_of, per_cent: int) -> DataFrame | None:
    """Links among the nodes whose fingerprints operator 1 joins; ``nodes``: (node, n, odd, fp).

    Nodes of one fingerprint are compared with the least of them, and these with
    each other where their fingerprints are linked.
    """
    least = durable(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("x")).select("fp", F.col("x.node").alias("least"), F.col("x.n").alias("size")))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"), F.col("n").alias("na"), F.col("size").alias("nb"))
    one, two = least.toDF("fa", "a", "na"), least.toDF("fb", "b", "nb")
    near = simhash.near_links(least.select("fp")).toDF("fa", "fb").join(one, "fa").join(two, "fb").select("a", "b", "na", "nb")
    found = _checked(_close(same.unionByName(near), nodes.select("node", "odd"), per_cent), sets_of, per_cent)
    del least, same, one, two, near
    release(nodes.sparkSession)
    return found


def _links(first: DataFrame, odd: DataFrame, sets_of, per_cent: int, links: DataFrame | None) -> DataFrame | None:
    """``links`` and others (a, b) whose components are those of all similar pairs that share a row's shingle.

    ``first``: (h, node, n, place, hot), the first shingles of each node in one order;
    ``odd``: (node, odd), the parities of each node;
    ``sets_of``: from a table of nodes to (node, n, first) with their whole sets, and maybe others.
    """
    group = None if links is None else durable(components(links))
    for turn in range(STARS + 1):
        rows = first
        if group is not None:
            rows = rows.join(group, "node", "left").withColumn("g", F.coalesce("component", "node")).drop("component")
            open_ = durable(rows.groupBy("h").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most")).where("lo <> hi").drop("lo", "hi"))
            rows = durable(_in_reach(rows.join(open_, "h"), "least", "most", per_cent).drop("least", "most"))
        else:
            rows = rows.withColumn("g", F.col("node"))
        left = rows.select("h", "hot", "g", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
        if turn < STARS:
            typical = F.struct(F.floor(F.col("place") / (1 + 3 * turn)), F.xxhash64(F.lit(turn), "node"))  # few shingles of its own before a frequent one
            centre = rows.groupBy("h").agg(F.min_by(F.struct("g", "node", "n", "place"), typical).alias("x"), F.count("*").alias("k"))
            centre = durable(centre.where("k > 1").drop("k"))
            right = centre.select("h", F.col("x.g").alias("gb"), F.col("x.node").alias("b"), F.col("x.n").alias("nb"), F.col("x.place").alias("pb"))
            met = left.join(right, "h").where("g <> gb")
        else:
            right = rows.select("h", F.col("g").alias("gb"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"))
            met = left.join(right, "h").where("a < b AND g <> gb")
        found = _checked(_possible(met, odd, per_cent, turn < STARS), sets_of, per_cent)
        if found is None:
            continue
        links = found if links is None else links.unionByName(found)
        if turn < STARS:
            group = durable(components(links))
        rows = left = right = centre = met = found = None
        release(first.sparkSession)
    return links


def similar_links(nodes: DataFrame, lists_of, sets_of, per_cent: int) -> DataFrame | None:
    """Links (a, b) whose components are those of all pairs of similar nodes; None if there is no candidate.

    ``nodes``: (node, n, first, odd, fp), each node once, as :func:`_nodes` gives them;
    ``sets_of`` as in :func:`_links`; ``lists_of``: from a table of nodes and the
    frequent shingles to (node, n, first), and maybe others, with those last.
    """
    links = _fingerprint_links(nodes.select("node", "n", "odd", "fp"), sets_of, per_cent)
    late = _late(nodes, sets_of, per_cent)
    placed = durable(_placed(nodes, late, per_cent))
    crowded, lists = durable(placed.where("first IS NULL").select("node")), placed.where("first IS NOT NULL")
    if not crowded.isEmpty():
        lists = lists.unionByName(lists_of(crowded, late).join(crowded, "node", "left_semi"))
    rows = lists.select("node", "n", F.posexplode("first").alias("pos", "h"))
    rows = rows.select("h", "node", F.shiftleft(F.col("n"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))  # one long, which compresses well
    n = F.shiftright("np", 32)
    shared = durable(rows.groupBy("h").agg(F.count("*").alias("df"), F.min(n).alias("least"), F.max(n).alias("most")).where("df > 1").withColumn("hot", F.col("df") > FEW).drop("df"))
    met = rows.join(shared, "h").select("h", "node", n.alias("n"), (F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)) + 1).alias("place"), "hot", "least", "most")
    first = durable(_in_reach(met, "least", "most", per_cent).drop("least", "most"))
    del placed, crowded, lists, rows, shared, met
    release(nodes.sparkSession)
    return _links(first, nodes.select("node", "odd"), sets_of, per_cent, links)


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, per_cent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the least id.

    Two rows are linked if the Jaccard similarity of their sets of ``width``-word
    shingles is ``per_cent`` or more (words end at white space, ASCII case is
    ignored); a group is all that links reach. Every such pair is found, and
    none below. Texts without words, null ones too, are copies of each other;
    a text of fewer words than ``width`` is one shingle. All columns stay as
    they are. Null ids come last; among equal ids the row with the least hash
    of its text stays, and once. An empty table gives no rows.
    """
    keyed = with_row_key(docs, id_col, text_col)
    slim = keyed.select(F.col(f"`{id_col}`").alias(f"{HIDDEN}doc"), *ROW_KEY, F.col(f"`{text_col}`").alias("text"))
    coded = _nodes(slim, width, per_cent)
    own = durable(coded.drop("n", "first", "odd", "fp"))
    nodes = durable(coded.groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"), F.first("odd").alias("odd"), F.min("fp").alias("fp"), F.min(F.struct(*ROW_KEY)).alias("key")))
    release(docs.sparkSession)

    def texts_of(wanted: DataFrame) -> DataFrame:
        keys = nodes.join(wanted, "node", "left_semi").select("key.*")
        texts = slim.join(bounded(durable(keys)), ROW_KEY, "left_semi")
        if repeated:
            texts = texts.dropDuplicates(ROW_KEY)
        return texts.select("text")

    def sets_of(wanted: DataFrame) -> DataFrame:
        return durable(_nodes(texts_of(wanted), width, None))

    def lists_of(wanted: DataFrame, late: np.ndarray) -> DataFrame:
        return durable(_nodes(texts_of(wanted), width, per_cent, late))

    repeated = not own.groupBy(*ROW_KEY).count().where("count > 1").isEmpty()
    links = similar_links(nodes.drop("key"), lists_of, sets_of, per_cent)
    g = F.col("node")
    if links is not None:
        own, g = own.join(components(links), "node", "left"), F.coalesce("component", "node")
    order = F.struct(F.col(f"{HIDDEN}doc").isNull(), f"{HIDDEN}doc", *ROW_KEY)
    kept = durable(own.groupBy(g.alias("g")).agg(F.min(order).alias("k")).select(*[F.col(f"k.{c}").alias(c) for c in ROW_KEY]))
    return keyed.join(kept, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).drop(*ROW_KEY)


__all__ = ["drop_similar", "shingles", "similar_links"]
