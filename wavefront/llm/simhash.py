"""SimHash near-duplicates through a segment-popcount embedding.

1. A document's fingerprint has bit i set if more than half of its shingle
   hashes have it set.
2. The 64 bits are cut into 32 segments of two; a fingerprint becomes the
   vector of its 32 bit counts. Flipping one bit moves the vector by one step,
   so the Manhattan distance of two vectors never exceeds the Hamming distance
   of their fingerprints.
3. Grid range-join: a vector is put in its own cell and in every cell one step
   away. Two vectors at distance two or less share a cell, whatever the data.
   Fingerprints alone in all of their cells have no partner and leave here.
4. Exact check: fingerprints that share a cell are compared bit by bit, each
   with the least of the cell and, where a cell holds few, with each other.
   Where it holds many (a group of near copies), all of them are listed under
   the 65 words that are at most one flip away, and all that meet under one are
   linked to the least of them: two fingerprints differ in at most two bits if
   and only if they share such a word. So nothing is missed or added, and a
   group of k near copies gives on the order of k rows and never k squared.

Equal fingerprints are one row from the start, so groups of exact copies cost
nothing after a pre-aggregated grouping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ROW_KEY, bounded, byte_slices, durable, with_row_key
from .components import components

WIDTH = 2
#: Fingerprints of a cell that are compared with each other.
FEW = 32
#: Shingles whose bits are counted at once, which bounds the memory for one text.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint as a signed integer; 0 for null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        if len(part) <= shingle:
            hashes = digest(b" ".join(part), 42)
        else:
            hashes = b"".join([digest(b" ".join(s), 42) for s in zip(*(part[i:] for i in range(shingle)))])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def _with_fingerprints(df: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """``df`` with the text replaced by the long column ``fp``."""
    schema = T.StructType([f for f in df.schema if f.name != text_col] + [T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rest = [i for i in range(batch.num_columns) if i != at]
            for part in byte_slices(batch, at):
                fps = pa.array([fingerprint(t, shingle) for t in part.column(at).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in rest] + [fps], [batch.schema.names[i] for i in rest] + ["fp"])

    return df.mapInArrow(run, schema)


def cell(fp: Column) -> Column:
    """The 32 bit counts, two bits each, as one long: a pair's low bit is the
    exclusive or of its bits, its high bit their conjunction."""
    other, low = F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    return fp.bitwiseXOR(other).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(other).bitwiseAND(low), 1))


def _steps(at: Column) -> Column:
    """The cell itself and all cells one step away; null where a count has no such step.

    Flipping the low bit of a count leads from 0 to 1 or back, flipping both
    bits from 1 to 2 or back.
    """
    out = [at]
    for s in range(0, 64, WIDTH):
        count = F.shiftrightunsigned(at, s).bitwiseAND(F.lit(3))
        out += [F.when(count < 2, at.bitwiseXOR(_word(1 << s))), F.when(count > 0, at.bitwiseXOR(_word(3 << s)))]
    return F.array(*out)


def _word(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def _flips(fp: Column) -> Column:
    """The word itself and all words one flip away."""
    return F.array(fp, *[fp.bitwiseXOR(_word(1 << i)) for i in range(64)])


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at two or fewer differing bits.

    ``fps``: distinct values in a long column fp.
    """
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = durable(fps.select("fp", cell(F.col("fp")).alias("own")).repartition(parts, "fp"))  # so many rows come of one that a task must not hold many
    in_cells = own.select("fp", "own", F.explode(F.filter(_steps(F.col("own")), lambda x: x.isNotNull())).alias("c"))
    shared = durable(in_cells.groupBy("c").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1"))
    met = durable(in_cells.join(bounded(shared), "c"))

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2

    links = met.where(F.col("fp") != F.col("least")).where(near("fp", "least")).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    few = met.where(F.col("n") <= FEW)
    one, two = (few.select("c", F.col("fp").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab")
    # vectors of one cell are compared there alone; of two neighbours each other cell has one at most
    pairs = one.join(two, "c").where("a > b AND (own_a <> own_b OR own_a = c)").where(near("a", "b")).select("a", "b")
    words = met.where(F.col("n") > FEW).select("fp").distinct().select("fp", F.explode(_flips(F.col("fp"))).alias("w"))
    least = durable(words.groupBy("w").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("w", "b"))
    chained = words.join(bounded(least), "w").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return links.unionByName(pairs).unionByName(chained).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, keep_hash: bool = False) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Two rows are linked if their fingerprints differ in at most two bits;
    ``component_id`` is the least id among all rows that links reach.

    Null or wordless texts have fingerprint zero and are linked like any other.
    Fewer words than the shingle: the words there are make one shingle. Null
    ids link like others but never name a component, except that it is null
    where all ids of it are. Repeated rows and ids are all returned. Other
    columns of the input are ignored; an empty input gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    if keep_hash:
        slim = with_row_key(slim, "id", "text")
    own = durable(_with_fingerprints(slim, "text", shingle))
    classes = durable(own.groupBy("fp").agg(F.min("id").alias("rep")))
    group = components(near_links(classes.select("fp")))
    labelled = classes.join(group, classes.fp == group.node, "left").select("fp", F.coalesce("component", "fp").alias("g"), "rep")
    labelled = durable(labelled)
    names = labelled.groupBy("g").agg(F.min("rep").alias("component_id"))
    fp_name = labelled.join(names, "g").select("fp", "g", "component_id")
    extra = ["g", *ROW_KEY] if keep_hash else []
    return own.join(fp_name, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *extra)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id.

    All columns stay as they are. Null ids come last; among equal ids the row
    with the least hash of its text stays, and once.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, keep_hash=True)
    order = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), *ROW_KEY)
    kept = found.groupBy("g").agg(F.min(order).alias("k")).select(*[F.col(f"k.{c}").alias(c) for c in ROW_KEY])
    return with_row_key(docs, id_col, text_col).join(kept, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY).drop(*ROW_KEY)


__all__ = ["cell", "drop_near_duplicates", "fingerprint", "near_duplicates", "near_links"]
