"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each
filter's largest response in a window goes through a softmax layer. A filter
of width w is w tables of 256 weights, one for each byte under it, so a
response is a sum of table rows. For prediction the tables of neighbouring
bytes are added up to tables of byte pairs; that is the same sum.

Training is plain numpy on the driver, on a sample of labelled text whose size
has a bound that doesn't depend on the corpus. Prediction covers every byte of
every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HIDDEN, byte_slices

#: Bytes of a window; windows overlap by the widest filter less one.
WINDOW, WIDTHS = 256, (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
#: Windows whose responses are in memory at once.
CHUNK = 64
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Network:
    """``tables``: by width an array (width, 256, filters); ``weights`` (features, languages)."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def paired(self) -> tuple[np.ndarray, np.ndarray]:
        """Tables by byte pair: of the first two bytes under all filters, and of the rest."""

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(65536, -1)

        two, three, four = self.tables
        first = np.concatenate([pair(t[0], t[1]) for t in (two, three, four)], axis=1)
        rest = np.concatenate([pair(three[2], np.zeros_like(three[2])), pair(four[2], four[3])], axis=1)
        first[:256] = -1e9  # a zero byte is padding and begins nothing
        return first.astype(np.float32), rest.astype(np.float32)

    def probabilities(self, data: np.ndarray, paired: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """(windows, languages) for bytes padded to windows + OVERLAP."""
        n = (len(data) - OVERLAP) // WINDOW
        out = np.empty((n, len(self.languages)), np.float32)
        codes = (data[:-1].astype(np.uint16) << 8) | data[1:]
        first, rest = paired
        skip = self.tables[0].shape[2]
        for at in range(0, n, CHUNK):
            end = min(n, at + CHUNK)
            response = first.take(codes[at * WINDOW : end * WINDOW], axis=0)
            response[:, skip:] += rest.take(codes[at * WINDOW + 2 : end * WINDOW + 2], axis=0)
            response = response.reshape(end - at, WINDOW, -1)
            width = WINDOW
            while width > 1:
                width //= 2
                response = np.maximum(response[:, :width], response[:, width:])
            out[at:end] = _softmax(np.maximum(response[:, 0] + self.bias, 0) @ self.weights + self.offset)
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], filters: int = 16, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fits a network to windows of text by Adam; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.searchsorted(languages, labels)
    size = WINDOW + OVERLAP
    raw = [_LOWER[np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)] for t in texts]
    parts, rows = [], []
    for r, data in enumerate(raw):
        cuts = {min(len(data), size)} | {n for n in (12, 24, 48, 96) if n < len(data)}  # short texts are met as well
        for n in sorted(cuts):
            start = int(rng.integers(0, len(data) - n + 1))
            parts.append(np.pad(data[start : start + n], (0, size - n)))
            rows.append(r)
    x, y = np.array(parts, np.uint8).reshape(-1, size), target[rows]
    n, k = len(WIDTHS) * filters, len(languages)
    params = [rng.normal(0, 0.1, (w, 256, filters)) for w in WIDTHS] + [np.zeros(n), rng.normal(0, 0.1, (n, k)), np.zeros(k)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            xb, lanes = x[pick], np.arange(len(pick))
            pooled, best = [], []
            for w, table in zip(WIDTHS, params):
                response = sum(table[j][xb[:, j : j + WINDOW]] for j in range(w))
                response[xb[:, :WINDOW] == 0] = -1e9
                at = response.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
            before = np.concatenate(pooled, axis=1) + params[-3]
            hidden = np.maximum(before, 0)
            error = _softmax(hidden @ params[-2] + params[-1])
            error[lanes, y[pick]] -= 1
            error /= len(pick)
            back = (error @ params[-2].T) * (before > 0)
            grads = []
            for i, (w, table) in enumerate(zip(WIDTHS, params)):
                g = np.zeros_like(table)
                part, at = back[:, i * filters : (i + 1) * filters], best[i]
                for j in range(w):
                    np.add.at(g[j], (xb[lanes[:, None], at + j], np.arange(filters)[None, :]), part)
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    *tables, bias, weights, offset = params
    return Network(languages, tables, bias.astype(np.float32), weights.astype(np.float32), offset.astype(np.float32))


def held_out(id_col: Column) -> Column:
    """True for rows that training never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[str, str]]:
    """At most ``per_language`` windows of labelled rows for each language that has a row.

    Rows are drawn by a hash of their id and text, and a window's place in the
    whole text by the same hash, so the draw is the same on every run: about a
    fifth more than wanted by the share of a language's rows, then the first
    ones in the order of the hash.
    """
    own = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l"))
    own = own.where(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = own.groupBy("l").count().collect()  # a row for each language, which the network has as well
    if not counts:
        return []
    draw = F.xxhash64("i", "t")
    share = docs.sparkSession.createDataFrame([(r["l"], min(1.0, 1.2 * per_language / r["count"])) for r in counts], "l string, share double")
    place = F.pmod(F.shiftright(draw, 20), F.greatest(F.lit(1), F.length("t") - WINDOW + 1)).cast("int") + 1
    drawn = own.join(F.broadcast(share), "l").where(F.pmod(draw, F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("l", F.substring(F.col("t"), place, F.lit(WINDOW)).alias("t"), draw.alias("d"))
    turn = F.row_number().over(Window.partitionBy("l").orderBy("d", "t"))  # of a bounded number of rows
    rows = drawn.where(F.col("t").rlike(r"\p{L}")).withColumn("turn", turn).where(F.col("turn") <= per_language).collect()
    return [(r["t"], r["l"]) for r in sorted(rows, key=lambda r: (r["d"], r["t"], r["l"]))]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Network | None:
    """The network for a table, or None if no row can be learned from.

    It learns every language that has a row, from at most ``per_language``
    windows of each; that is its bound on labelled rows. Null texts and texts
    without a letter teach nothing.
    """
    rows = training_sample(docs, id_col, text_col, lang_col, per_language)
    return train([t for t, _ in rows], [lang for _, lang in rows]) if rows else None


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the text replaced by the predicted language and its score.

    ``keep_text``: the text stays as well.

    Every window of the whole text is classified; a text's probabilities are
    the means over its windows, weighted by their bytes. Null texts, texts
    without a letter, and all texts where there was nothing to learn from get
    ``und`` and 0. Repeated rows get the same result, an empty table gives an
    empty one. Other columns stay, except columns that have an added name.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c == text_col or c not in (lang_pred, score)])
    rest = [f for f in docs.schema if keep_text or f.name != text_col]
    schema = T.StructType([*rest, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    if network is None:
        return docs.select(*[F.col(f"`{f.name}`") for f in rest], F.lit(UNKNOWN).alias(lang_pred), F.lit(0.0).alias(score))
    letters = f"{HIDDEN}letters"
    docs = docs.withColumn(letters, F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paired = network.paired()
        names = np.array(network.languages + [UNKNOWN], object)
        for batch in batches:
            at, flag = (batch.schema.get_field_index(c) for c in (text_col, letters))
            others = [batch.schema.get_field_index(f.name) for f in rest]
            for part in byte_slices(batch, at, 1 << 20):
                texts = [t.encode("utf-8", "surrogatepass") if any_letter else b"" for t, any_letter in zip(part.column(at).to_pylist(), part.column(flag).to_pylist())]
                sizes = np.array([len(t) for t in texts])
                windows = -(-(sizes + OVERLAP) // WINDOW) * (sizes > 0)
                data = b"".join([t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, windows)]) + bytes(OVERLAP)
                found = network.probabilities(_LOWER[np.frombuffer(data, np.uint8)], paired)
                ends = np.cumsum(windows)
                weight = np.full(len(found), float(WINDOW))
                full = sizes > 0
                weight[ends[full] - 1] = np.maximum(1, sizes[full] - (windows[full] - 1) * WINDOW)
                total = np.zeros((len(texts), len(network.languages)))
                np.add.at(total, np.repeat(np.arange(len(texts)), windows), found * weight[:, None])
                best = np.where(full, total.argmax(axis=1), len(network.languages))
                mean = total.max(axis=1) / np.maximum(1, total.sum(axis=1))
                columns = [pa.array(names[best], pa.string()), pa.array(np.where(full, np.clip(mean, 0, 1), 0.0), pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(i) for i in others] + columns, [batch.schema.names[i] for i in others] + [lang_pred, score])

    return docs.mapInArrow(run, schema)
