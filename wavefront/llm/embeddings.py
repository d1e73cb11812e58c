"""Embedding near-duplicates by sorted projection passes.

For each pass a vector gets the concatenated signs of random projections, taken
from the mean direction of its label. Within a label, vectors are ordered by
these bits, and each is compared with a bounded number of its successors. The
order of all passes is cut into blocks of a fixed size by rank, so no label,
hash value or cluster makes a task larger than others. A pair that several
passes meet counts in the first of them, which the ranks of both vectors tell;
so passes run side by side, and blocks give a count for each vector and a
spanning forest of the links, never the pairs.

How many passes a label gets follows from its size and its spread. Two vectors
at the threshold agree in a bit with a chance that their angle tells; in a
label of n vectors about log2(n / window) bits must agree for them to come
within a window; passes are so many that all fail with a chance of 1 - recall
at most. A label that one window covers needs one pass and is complete.

A window can be too short for a cluster of more vectors than it holds. Vectors
that found half a window of partners or more are therefore compared with all
vectors of their label, as a stated set in blocks; that part is exact.

Equal vectors of a label are one vector with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable
from .components import components

#: Bits of an order, vectors of a block; the window must not be longer than a block.
BITS, BLOCK = 48, 4096
#: Vectors of a set that are compared with a block at once, and ways a label's blocks are dealt.
CHUNK, SALT = 1024, 32
#: Passes of a label at most; labels whose centres are broadcast.
MOST, LABELS = 64, 2000


def _keys(vectors: list[np.ndarray], centres: list[np.ndarray], passes: np.ndarray, seed: int) -> list[np.ndarray]:
    """For each vector the signs of its passes, an integer for each. Vectors may differ in length."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(vectors)
    sizes = np.array([len(v) for v in vectors])
    for d, n in set(zip(sizes.tolist(), passes.tolist())):
        rows = np.nonzero((sizes == d) & (passes == n))[0]
        x = np.array([vectors[i] - centres[i] for i in rows])
        found = np.empty((len(rows), n), np.int64)
        for which in range(n):
            planes = np.random.default_rng([seed, d, which]).normal(size=(d, BITS))
            found[:, which] = (x @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])
        for i, row in zip(rows, found):
            out[i] = row
    return out


def _directions(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Vectors of length one in double precision; scaled first, so that no square overflows."""
    out = []
    for v in column.to_pylist():
        x = np.array(v, float)
        x /= np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n by the links (i, j)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _found(ids: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray, both: np.ndarray) -> pa.Table:
    """Counts of i (and of j where ``both``) and a forest for links between rows i and j."""
    links = np.bincount(i, weight[j], len(ids)) + np.bincount(j[both], weight[i[both]], len(ids))
    kinds = np.bincount(i, minlength=len(ids)) + np.bincount(j[both], minlength=len(ids))
    root = _forest(len(ids), i, j)
    at, leaf = np.nonzero(kinds)[0], np.nonzero(root != np.arange(len(ids)))[0]
    none = pa.nulls(len(at), pa.int64())
    return pa.table({
        "a": pa.chunked_array([pa.array(ids[at]), pa.array(ids[leaf])]), "b": pa.chunked_array([none, pa.array(ids[root[leaf]])]),
        "n": pa.chunked_array([pa.array(links[at].astype(np.int64)), pa.array(np.zeros(len(leaf), np.int64))]),
        "kinds": pa.chunked_array([pa.array(kinds[at].astype(np.int64)), pa.array(np.zeros(len(leaf), np.int64))]),
    })


RESULT = "a long, b long, n long, kinds long"


def _cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(x @ y.T >= threshold)


def _compare_block(table: pa.Table, start: int, window: int, threshold: float) -> pa.Table:
    """The links of one block: each own row with its ``window`` successors in the same pass and label.

    Own rows have a rank below start + BLOCK; the others are there to be met.
    """
    rank = table.column("rank").to_numpy()
    order = np.argsort(rank)
    ids = table.column("cid").to_numpy()[order]
    weight = table.column("weight").to_numpy()[order].astype(float)
    vectors, ranks = _directions(table.column("vec")), table.column("ranks").to_pylist()
    labels, passes = table.column("label").to_pylist(), table.column("pass").to_numpy()
    kind = [(passes[o], labels[o], len(vectors[o])) for o in order]
    cuts = [0, *[k for k in range(1, len(kind)) if kind[k] != kind[k - 1]], len(kind)]
    own = int(np.searchsorted(rank[order], start + BLOCK))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo >= own:
            break
        x = np.array([vectors[o] for o in order[lo:hi]])
        before = np.array([ranks[o][: kind[lo][0]] for o in order[lo:hi]], np.int64)
        for at in range(lo, min(hi, own), 256):
            end = min(at + 256, hi, own)
            i, j = _cosines(x[at - lo : end - lo], x[at - lo : end - lo + window], threshold)
            i, j = i + at, j + at
            met = (j > i) & (j - i <= window)
            i, j = i[met], j[met]
            met = (np.abs(before[i - lo] - before[j - lo]) > window).all(axis=1)
            left.append(i[met])
            right.append(j[met])
    i, j = np.concatenate(left), np.concatenate(right)
    return _found(ids, weight, i, j, np.ones(len(i), bool))


def _ranked(slim: DataFrame) -> DataFrame:
    """(cid, ranks): the place of each row in the order of each of its passes, one count through all passes."""
    parts = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "label", "dim", "key", "cid"]
    rows = slim.select("cid", "label", "dim", F.posexplode("keys").alias("pass", "key"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.arange(n, n + b.num_rows))], ["cid", "pass", "pid", "at"])
            n += b.num_rows

    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("cid", "pass", F.spark_partition_id().alias("pid"))
    placed = durable(dealt.mapInArrow(number, "cid long, pass int, pid int, at long"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    starts = placed.groupBy("pid").count().select("pid", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    placed = placed.join(F.broadcast(starts), "pid").select("cid", F.struct("pass", (F.col("base") + F.col("at")).alias("rank")).alias("x"))
    return placed.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["rank"]).alias("ranks"))


def _labels(rows: DataFrame, threshold: float, passes: int | None, window: int, recall: float) -> DataFrame:
    """(label, dim, centre, passes) of each label and length: its mean direction, and how many passes it gets."""
    kind = T.StructType().add("label", rows.schema["label"].dataType).add("dim", T.IntegerType()).add("pos", T.IntegerType()).add("s", T.DoubleType()).add("n", T.LongType())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met: dict = {}
            for label, x in zip(b.column(0).to_pylist(), _directions(b.column(1))):
                known = met.setdefault((label, len(x)), [0.0, 0])
                known[0], known[1] = known[0] + x, known[1] + 1
            names = [(label, d, k, float(v), n) for (label, d), (s, n) in met.items() for k, v in enumerate(s)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in names], t) for i, t in enumerate((b.schema.field(0).type, pa.int32(), pa.int32(), pa.float64(), pa.int64()))], kind.names)

    mean = rows.select("label", "vec").mapInArrow(sums, kind).groupBy("label", "dim", "pos").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))
    mean = mean.groupBy("label", "dim").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centre"), F.max("n").alias("n"))
    if passes is not None:
        return durable(mean.select("label", "dim", "centre", F.lit(passes).alias("passes")))
    alike = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x * x)  # the mean cosine of two rows
    cosine = F.greatest(F.lit(0.0), 1 - (1 - threshold) / F.greatest(1 - alike, F.lit(1e-9)))
    together = F.pow(1 - F.acos(cosine) / np.pi, 1 + F.greatest(F.lit(0.0), F.log2(F.col("n") / window)))
    wanted = F.ceil(np.log(1 - recall) / F.log(1 - F.least(together, F.lit(1 - 1e-9)))).cast("int")
    return durable(mean.select("label", "dim", "centre", F.when(F.col("n") <= window + 1, 1).otherwise(F.least(F.greatest(wanted, F.lit(2)), F.lit(MOST))).alias("passes")))


def _against_all(rows: DataFrame, full: DataFrame, window: int, threshold: float) -> DataFrame:
    """Links of the rows in ``full`` (column cid) to all of their label that no window met."""
    marked = rows.join(full.withColumn("full", F.lit(True)), "cid", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    deal = Window.partitionBy("label", "dim", "part").orderBy("cid")
    sets = marked.where("full").withColumn("part", F.pmod(F.xxhash64("cid"), F.lit(SALT)))
    packed = F.collect_list(F.struct("cid", "weight", "ranks", "vec", "full"))
    sets = sets.withColumn("chunk", F.floor((F.row_number().over(deal) - 1) / CHUNK)).groupBy("label", "dim", "part", "chunk").agg(packed.alias("x"))
    blocks = marked.withColumn("block", F.floor(F.get("ranks", F.lit(0)) / BLOCK)).groupBy("label", "dim", "block").agg(packed.alias("y"))
    blocks = durable(blocks.withColumn("salt", F.pmod("block", F.lit(SALT)).cast("int")))
    sets = sets.join(blocks.select("label", "dim", "salt").distinct(), ["label", "dim"])  # a copy for each way that has blocks
    pairs = sets.join(blocks, ["label", "dim", "salt"]).select("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (pa.Table.from_struct_array(batch.column(c).slice(k, 1).flatten()) for c in ("x", "y"))
                a, b = np.array(_directions(x.column("vec"))), np.array(_directions(y.column("vec")))
                rx, ry = (np.array(t.column("ranks").to_pylist(), np.int64) for t in (x, y))
                ids = np.concatenate([x.column("cid").to_numpy(), y.column("cid").to_numpy()])
                i, j = _cosines(a, b, threshold)
                new = ids[i] != ids[len(a) + j]
                for p in range(rx.shape[1]):
                    new &= np.abs(rx[i, p] - ry[j, p]) > window
                i, j = i[new], j[new]
                weight = np.concatenate([x.column("weight").to_numpy(), y.column("weight").to_numpy()]).astype(float)
                yield from _found(ids, weight, i, j + len(a), ~y.column("full").to_numpy(zero_copy_only=False)[j]).combine_chunks().to_batches()

    return pairs.mapInArrow(run, RESULT)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, passes: int | None = None, window: int = 1024, recall: float = 0.999, seed: int = 5) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Two rows are linked if their labels are equal and not null and the cosine
    of their vectors is ``threshold`` or more; what is found is so. ``recall``:
    the part of pairs at the threshold that is aimed at in choosing the passes
    of each label, if ``passes`` doesn't fix them. ``n_links``: linked other
    rows, equal vectors included; ``component_id``: the least id that links
    reach, the row's own included; ``kept``: whether that is its own.

    Vectors that are null, empty, zero, or hold a null or non-finite number,
    and vectors of different lengths, are linked with nothing. Null ids link
    but name no component (null where a component has no other id) and are not
    kept. Repeated rows count each. An empty table gives no rows. Other columns
    are ignored.
    """
    if window > BLOCK:
        raise ValueError(f"the window must not exceed {BLOCK}")
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    base = df.select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vec.alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0)
    base = base.withColumn("good", F.coalesce(good, F.lit(False))).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")})
    base = durable(base)
    same = ["label", "h1", "h2"]
    classes = durable(base.where("good").groupBy(*same).agg(F.min("uid").alias("cid"), F.count("*").alias("weight"), F.min("id").alias("least")))
    rows = durable(base.select(F.col("uid").alias("cid"), "vec", F.size("vec").alias("dim")).join(classes.select("cid", "label", "weight"), "cid"))
    kinds = _labels(rows, threshold, passes, window, recall)
    if kinds.limit(LABELS + 1).count() <= LABELS:
        kinds = F.broadcast(kinds)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = _keys(_directions(b.column("vec")), [np.array(c) for c in b.column("centre").to_pylist()], b.column("passes").to_numpy(), seed)
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("label"), b.column("dim"), lists], ["cid", "label", "dim", "keys"])

    label_type = rows.schema["label"].dataType
    slim = T.StructType().add("cid", "long").add("label", label_type).add("dim", T.IntegerType()).add("keys", T.ArrayType(T.LongType()))
    slim = durable(rows.join(kinds, ["label", "dim"]).select("cid", "label", "dim", "vec", "centre", "passes").mapInArrow(hash_all, slim))
    rows = durable(rows.join(_ranked(slim), "cid"))

    met = rows.select("cid", "label", "weight", "vec", "ranks", F.posexplode("ranks").alias("pass", "rank"))
    block = F.floor(F.col("rank") / BLOCK)
    met = met.withColumn("block", F.explode(F.when((F.col("rank") % BLOCK < window) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        return _compare_block(table, key[0].as_py() * BLOCK, window, threshold)

    links = durable(met.groupBy("block").applyInArrow(compare, RESULT))
    crowded = durable(links.where("b IS NULL").groupBy("a").agg(F.sum("kinds").alias("k")).where(F.col("k") >= window // 2).select(F.col("a").alias("cid")))
    if not crowded.isEmpty():
        links = durable(links.unionByName(_against_all(rows, crowded, window, threshold)))

    totals = links.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    group = components(links.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.join(totals, "cid", "left").join(group, "cid", "left").withColumn("g", F.coalesce("component", "cid"))
    named = durable(named.select(*same, "g", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    names = named.groupBy("g").agg(F.min("least").alias("component_id"))
    named = named.join(names, "g").select(*same, "n_links", "component_id")
    alone = base.where("NOT good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = base.where("good").join(named, same).select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
