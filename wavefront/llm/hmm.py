"""A hidden Markov language model.

The model emits a class for each token, and a token given its class. The most
frequent training words are classes of their own; all others share a fixed
number of classes by their last bytes, within which a word has its add-one
share of the class's training count. So the tables of the model have a fixed
size, while the counts of all words of the corpus stay in a distributed table
and reach a text by a join.

Texts are cut into words as bytes, whole batches at a time, and a word is a
64-bit hash from there on: 52 bits of a polynomial of its bytes, and its class
by its last bytes. Two words that have the same one would count as one word;
among ten million words none is to be expected. Each text becomes the numbers of its classes once; learning and
scoring read only these.

Baum-Welch learns by distributed rounds: early ones over another share of the
training rows each, then rounds over all of them. Each task adds up the
expected counts of its documents by scaled forward and backward recursion, a
grouping adds up the tasks' counts, and the driver gets tables of fixed size.
Scoring is the exact forward recursion over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash
from .common import HIDDEN, byte_slices, durable, offsets_of

#: Words that are classes of their own, classes by last bytes, states. Class 0 is the end of a text.
OWN, HASHED, STATES = 8191, 4096, 6
SYMBOLS = 1 + OWN + HASHED
#: Words whose counts every task holds (24 bytes each); the counts of others are joined.
HELD = 1_000_000
#: Pseudo-count of the prior of each state's emissions and each row of transitions.
PRIOR = 20.0
#: Words that are counted before they are handed on.
WORDS = 1 << 21
#: Tokens whose recursions are in memory at once, however long a text is.
TOKENS = 100_000
#: Steps between two scalings; no product of so many probabilities leaves the range of doubles.
EVERY = 8
#: Texts that are taken together: short ones ride along with the steps of a long one.
ROWS = 5000


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some non-null texts, and how many words each text has.

    The low bits of a hash are the word's class by its last three bytes.
    """
    found = wordhash.words(texts)
    tail = found.last_bytes(3)
    classes = (tail * np.uint32(2654435761) >> np.uint32(20)).astype(np.uint64)
    return found.hashes & ~np.uint64(HASHED - 1) | classes, found.per_text


def _by_tail(h: np.ndarray) -> np.ndarray:
    return ((h & np.uint64(HASHED - 1)) + np.uint64(1 + OWN)).astype(np.int16)


def _texts(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("string").alias("text")


def held_out(id_col: Column) -> Column:
    """True for rows that the model doesn't learn from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 7 == 2


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over whole texts: a word's hash and its count; a null word is the end of a text.

    Null texts are empty ones. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0

        def counted() -> pa.RecordBatch:
            h = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(np.diff(np.append(new, len(h))))], ["word", "c"])

        for batch in batches:
            rows += batch.num_rows
            for part in byte_slices(batch, 0):
                held.append(_words(part.column(0))[0])
                size += len(held[-1])
                if size >= WORDS:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([rows], pa.int64())], ["word", "c"])

    found = docs.select(_texts(docs, text_col)).mapInArrow(run, "word long, c long")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``words`` (sorted hashes), ``number`` (class) and ``logs`` (log10 of the count and one) of the
    words that every task holds; ``share``: by class, log10 of what a count is divided by."""

    words: np.ndarray
    number: np.ndarray
    logs: np.ndarray
    tokens: int
    distinct: int
    ends: int
    share: np.ndarray
    prior: np.ndarray
    start: np.ndarray
    moves: np.ndarray
    emit: np.ndarray

    def table(self) -> tuple[np.ndarray, int]:
        """Where words with the same first bits begin among the sorted ones, and the number of these bits."""
        bits = max(1, int(len(self.words)).bit_length())
        edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        return np.searchsorted(self.words, edges).astype(np.int32), bits

    def places(self, h: np.ndarray, table: tuple[np.ndarray, int]) -> np.ndarray:
        """The place of each hash among the held words, -1 where it is none of them."""
        begins, bits = table
        out = np.full(len(h), -1, np.int32)
        if not len(self.words):
            return out
        at = begins[h >> np.uint64(64 - bits)]
        left = np.arange(len(h))
        while len(left):
            here = np.minimum(at, len(self.words) - 1)
            found = self.words[here]
            hit = found == h[left]
            out[left[hit]] = here[hit]
            more = (found < h[left]) & (at < len(self.words))
            left, at = left[more], at[more] + 1
        return out


def _frequent(counts: DataFrame, most: int) -> pa.Table:
    """(word, c) of the most frequent words, but not more than ``most``.

    A histogram of sixteen classes for each doubling of the count says where to
    cut; so the tasks send no more rows than are returned. Words of one class
    of the histogram are in or out together.
    """
    classed = counts.where("word IS NOT NULL").withColumn("b", F.floor(F.log2("c") * 16))
    cut, total = None, 0
    for b, n in sorted(map(tuple, classed.groupBy("b").count().collect()), reverse=True):  # a thousand classes at most
        total += n
        if total > most:
            break
        cut = b
    return classed.where(F.col("b") >= cut if cut is not None else F.lit(False)).select("word", "c").toArrow()


def vocabulary(counts: DataFrame, states: int = STATES, seed: int = 11) -> Model:
    """The model before any learning, from the :func:`word_counts` of the training rows."""
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("d")).first()
    tokens, distinct, rows = totals["n"] or 0, totals["v"], totals["d"] or 0
    top = _frequent(counts, HELD)
    words, count = top["word"].to_numpy().astype(np.int64).view(np.uint64), top["c"].to_numpy().astype(np.int64)
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words, -count))] = np.arange(len(words))
    own, by_tail = rank < OWN, _by_tail(words)
    size, kinds = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
    tail = F.col("word").bitwiseAND(F.lit(HASHED - 1)).cast("int") + (1 + OWN)
    for r in counts.where("word IS NOT NULL").groupBy(tail.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():  # one row for each class
        size[r["k"]], kinds[r["k"]] = r["c"], r["v"]
    size -= np.bincount(by_tail[own], count[own], SYMBOLS)
    kinds -= np.bincount(by_tail[own], minlength=SYMBOLS)
    size[0] = rows
    size[1 + rank[own]] = count[own]
    share = np.zeros(SYMBOLS)
    share[1 + OWN :] = np.log10(size[1 + OWN :] + kinds[1 + OWN :] + 1)
    weight = size + 1
    weight[1 + int(own.sum()) : 1 + OWN] = 1e-9  # classes without a word
    prior = weight / weight.sum()
    order = np.argsort(words)
    number = np.where(own, 1 + rank, by_tail).astype(np.int16)[order]
    rng = np.random.default_rng(seed)
    model = Model(words[order], number, np.log10(count[order] + 1.0), tokens, distinct, rows, share, prior, np.full(states, 1 / states), 0.9 * np.eye(states) + 0.1 / states, prior * rng.uniform(0.5, 1.5, (states, SYMBOLS)))
    model.moves /= model.moves.sum(axis=1, keepdims=True)
    model.emit /= model.emit.sum(axis=1, keepdims=True)
    return model


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, kept in the checkpoint folder: uid, id, n_tokens, n_known, base, part, classes, rare.

    ``classes``: two bytes for each token, the end included; ``base`` and
    ``part``: what the held words add to the two scores apart from the
    likelihood; ``rare``: the other words, for their counts.
    """
    uid = f"{HIDDEN}uid"
    slim = docs.select(F.monotonically_increasing_id().alias(uid), F.col(f"`{id_col}`").alias("id"), _texts(docs, text_col))
    added = T.StructType().add("n_tokens", "long").add("n_known", "long").add("base", "double").add("part", "double").add("classes", "binary").add("rare", T.ArrayType(T.LongType()))
    schema = T.StructType([f for f in slim.schema if f.name != "text"] + list(added))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def coded(part: pa.RecordBatch, own: Model, table: tuple[np.ndarray, int]) -> pa.RecordBatch:
        h, n = _words(part.column(2))
        doc = np.repeat(np.arange(len(n)), n)
        place = own.places(h, table)
        known = place >= 0
        number, logs = _by_tail(h), np.zeros(len(h))
        number[known] = own.number[place[known]]
        logs[known] = own.logs[place[known]]
        within = np.where(number > OWN, logs, 0.0) - own.share[number]
        below = np.log10(own.tokens + own.distinct + 1)
        base = np.bincount(doc, logs, len(n)) + np.log10(own.ends + 1) - below * (n + 1)
        sizes = np.concatenate([[0], np.cumsum(n + 1)])
        flat = np.zeros(sizes[-1], np.int16)
        flat[np.arange(len(h)) + doc] = number
        classes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((2 * sizes).astype(np.int32)), pa.py_buffer(flat)])
        lost = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=len(n)))]).astype(np.int32)
        rare = pa.ListArray.from_arrays(lost, pa.array(h[~known].view(np.int64)))
        columns = [pa.array(n + 1), pa.array(np.bincount(doc, known, len(n)).astype(np.int64) + (own.ends > 0)), pa.array(base, pa.float64()), pa.array(np.bincount(doc, within, len(n)).astype(float)), classes, rare]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = own.table()
        for batch in batches:
            for part in byte_slices(batch, 2):
                yield coded(part, own, table)

    return durable(slim.mapInArrow(run, schema))


def _sequences(column: pa.Array) -> list[np.ndarray]:
    offsets = offsets_of(column) // 2
    flat = np.frombuffer(column.buffers()[2], np.int16, offsets[-1])
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def _steps(active: np.ndarray) -> list[tuple[int, int]]:
    """The steps cut into stretches of a bounded number of tokens."""
    total = np.cumsum(active)
    out, at = [], 0
    while at < len(active):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOKENS, "right")))
        out.append((at, end))
        at = end
    return out


def recursions(sequences: list[np.ndarray], start: np.ndarray, moves: np.ndarray, emit: np.ndarray, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Natural log likelihood of each sequence (none is empty).

    All sequences advance together, the longest first, so those that have not
    ended are always the first rows. The steps are taken in stretches of a
    bounded number of tokens; between them only one row of forward values for
    each sequence is kept, from which a stretch is computed again on the way
    back. ``counts``: expected starts, moves and emissions are added to these
    arrays.
    """
    states = len(start)
    out = np.zeros(len(sequences))
    if not len(sequences):
        return out
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order])
    begins = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    stretches = _steps(active)
    logs = np.zeros(len(order))
    onward = np.ascontiguousarray(moves.T)

    def forward(t0: int, t1: int, before: np.ndarray | None, add: bool) -> tuple[np.ndarray, ...]:
        """Symbols, offsets, rows, emissions, forward values and their scales of some steps; a column is a token."""
        here = active[t0:t1]
        offsets = np.concatenate([[0], np.cumsum(here)])
        rows = np.arange(offsets[-1]) - np.repeat(offsets[:-1], here)
        symbols = flat.take(begins.take(rows) + np.repeat(np.arange(t0, t1), here)).astype(np.intp)
        emitted = emit.take(symbols, axis=1)
        alphas, scale = np.empty((states, offsets[-1])), np.ones(offsets[-1])
        for k in range(t1 - t0):
            at, end = offsets[k], offsets[k + 1]
            now = alphas[:, at:end]
            if before is None:
                now[:] = start[:, None]
            else:
                np.matmul(onward, before[:, : end - at], out=now)
            now *= emitted[:, at:end]
            if (t0 + k) % EVERY == EVERY - 1:
                total = now.sum(axis=0)
                now /= total
                scale[at:end] = total
                if add:
                    logs[: end - at] += np.log(total)
            before = now
        if add:
            ended = np.arange(active[t1] if t1 < len(active) else 0, here[0])
            logs[ended] += np.log(alphas[:, offsets[lengths[ended] - 1 - t0] + ended].sum(axis=0))
        return symbols, offsets, rows, emitted, alphas, scale

    at_start: list[np.ndarray | None] = []
    before = last = None
    for t0, t1 in stretches:
        at_start.append(before)
        last = forward(t0, t1, before, True)
        before = last[4][:, last[1][-2] :].copy()
    out[order] = logs
    if counts is None:
        return out
    starts, moved, seen = counts
    total_moves = np.zeros_like(moves)
    beta = None
    for which in range(len(stretches) - 1, -1, -1):
        (t0, t1), before = stretches[which], at_start[which]
        symbols, offsets, rows, ahead, alphas, scale = last if which == len(stretches) - 1 else forward(t0, t1, before, False)
        betas = np.ones((states, offsets[-1]))
        if beta is not None:
            betas[:, offsets[-2] : offsets[-2] + beta.shape[1]] = beta
        for k in range(t1 - t0 - 1, -1, -1):
            at, end = offsets[k], offsets[k + 1]
            now = ahead[:, at:end]  # the emissions so far
            now *= betas[:, at:end]
            beta = moves @ now
            if (t0 + k) % EVERY == 0:
                beta /= beta.sum(axis=0)
            if k:
                betas[:, offsets[k - 1] : offsets[k - 1] + end - at] = beta
        gammas = np.multiply(alphas, betas, out=betas)
        total = gammas.sum(axis=0)
        gammas /= total
        ahead /= total * scale
        first = offsets[1]
        earlier = np.repeat(np.concatenate([[0], offsets[:-2]]), active[t0:t1]) + rows
        total_moves += alphas.take(earlier[first:], axis=1) @ ahead[:, first:].T
        if before is None:
            starts += gammas[:, :first].sum(axis=1)
        else:
            total_moves += before[:, :first] @ ahead[:, :first].T
        for s in range(states):
            seen[s] += np.bincount(symbols, weights=gammas[s], minlength=seen.shape[1])
    moved += total_moves * moves
    return out


def _maximize(model: Model, starts: np.ndarray, moved: np.ndarray, seen: np.ndarray) -> None:
    states = len(starts)
    model.start = (starts + 1) / (starts + 1).sum()
    moved = moved + PRIOR * (0.9 * np.eye(states) + 0.1 / states)
    model.moves = moved / moved.sum(axis=1, keepdims=True)
    seen = seen + PRIOR * model.prior[None, :] * 10
    model.emit = seen / seen.sum(axis=1, keepdims=True)


def _empty(states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(states), np.zeros((states, states)), np.zeros((states, SYMBOLS))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def expected_counts(coded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions over all rows: a sum of tables of fixed size."""
    states = len(model.start)
    names = [f"s{i}" for i in range(states)]
    shared = coded.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = _empty(states), 0
        for part in _batches(batches):
            recursions(_sequences(part.column(0)), *shared.value, counts)
            n += part.num_rows
        if n:
            table = np.concatenate([counts[2], counts[1].T, counts[0][:, None]], axis=1)
            filled = np.nonzero(table.any(axis=0))[0]
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32())] + [pa.array(table[i, filled]) for i in range(states)], ["k", *names])

    schema = T.StructType([T.StructField("k", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in names])
    found = coded.select("classes").mapInArrow(run, schema)
    rows = found.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).collect()  # one for each class and state
    shared.unpersist()
    table = np.zeros((states, SYMBOLS + states + 1))
    for r in rows:
        table[:, r["k"]] = r[1:]
    return table[:, -1], table[:, SYMBOLS:-1].T, table[:, :SYMBOLS]


def fit(docs: DataFrame, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = 2, sample_rounds: int = 8, seed: int = 11, model: Model | None = None, coded: DataFrame | None = None) -> Model:
    """The model of training documents whose :func:`word_counts` are ``counts``.

    ``sample_rounds``: early rounds, each over another one of so many shares of
    the rows, so that together they go through all of them once; ``rounds``:
    those after them, each over all rows. ``model`` and ``coded``:
    :func:`vocabulary` and :func:`encode` of the same, where they are at hand.
    """
    model = model or vocabulary(counts, states, seed)
    if not model.ends:
        return model
    coded = encode(docs, model, id_col, text_col) if coded is None else coded
    share = F.pmod(F.xxhash64("id", "n_tokens", "base"), F.lit(max(1, sample_rounds)))
    for i in range(sample_rounds + rounds):
        expected = expected_counts(coded.where(share == i) if i < sample_rounds else coded, model)
        if expected[0].any():
            _maximize(model, *expected)
    return model


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", coded: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, n_tokens, n_known, base_score, score, train_tokens.

    ``score`` is the log10 probability of the whole text with its end under the
    model, ``base_score`` that of an add-one unigram model of the same counts,
    ``n_known`` the number of tokens seen in training. Null texts are empty
    ones. Repeated rows are scored each; an empty table gives no rows; other
    columns are ignored. A text of any length takes memory for its classes (two
    bytes a token) and one stretch of steps.
    """
    coded = encode(docs, model, id_col, text_col) if coded is None else coded
    uid = f"{HIDDEN}uid"
    shared = docs.sparkSession.sparkContext.broadcast((model.start, model.moves, model.emit))
    slim = coded.select(uid, "id", "n_tokens", "n_known", "base", "part", "classes")
    schema = T.StructType([f for f in slim.schema if f.name != "classes"] + [T.StructField("likely", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            likely = recursions(_sequences(part.column(6)), *shared.value) / np.log(10)
            yield pa.RecordBatch.from_arrays([*part.columns[:6], pa.array(likely)], schema.names)

    first = slim.mapInArrow(run, schema)
    rest = coded.select(uid, F.explode("rare").alias("word")).join(counts, "word")
    rest = rest.groupBy(uid).agg(F.count("*").alias("n"), F.sum(F.log10(F.col("c") + 1)).alias("s"))
    out = first.join(rest, uid, "left")
    more = F.coalesce("s", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("likely") + F.col("part") + more).alias("score"),
    )
