"""Byte-level BPE by dynamic programming over prefixes.

For the bytes of one piece, ``last[i]`` is the last token of the encoding of
the first i bytes. A token t that ends at i is that token if and only if the
encoding of the prefix before t ends in a token p such that merging the bytes
of p and t gives back exactly (p, t). At most one t passes, so one backward
walk over ``last`` reads the encoding of any prefix. ``last[i]`` depends only
on the longest token's number of entries before it: appending bytes is exact
and re-encoding after an edit ends as soon as that many entries agree again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices

#: Most entries of each memo of a worker; a full memo is emptied and fills again.
MEMO = 300_000
#: Characters of a piece that is remembered at most, so that entries bound bytes too.
LONG = 48


class Codec:
    """Encodes and decodes with the ranks of a vocabulary; a token's rank is its id."""

    def __init__(self, vocabulary: bytes, pattern: str):
        pairs = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # \s is the White_Space property, as in the engine that the pattern was written for.
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.found = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.found.add_word(token.decode("latin-1"), (rank, len(token)))
        self.found.make_automaton()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.split_of: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes, least: int = 1) -> list[bytes]:
        """The merges by definition, always the pair of the least rank, the leftmost
        first, until none is possible or ``least`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ids = self.ids
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ids.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _reached(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(self.merged(self.tokens[token])) == 1
        return known

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if token not in self.split_of:
            parts = self.merged(self.tokens[token], 2)
            self.split_of[token] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self.split_of[token]

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """The parts that stand at the left (0) or right (1) end while the token is
        merged, from a byte to the whole, each with the rank that ends its time."""
        known = self.edges[side].get(token)
        if known is None:
            known, part, until = [], token, float("inf")
            while True:
                known.append((self.tokens[part], until))
                if (halves := self._halves(part)) is None:
                    break
                part, until = halves[side], part
            self.edges[side][token] = known = known[::-1]
        return known

    def _fit(self, before: int, token: int) -> bool:
        """Whether no merge crosses the border of two neighbours.

        While the merges run, in the order of their ranks, the parts at the
        border change as the edges of both tokens say. A crossing merge comes
        first if its rank is below that of the left part's next merge (of equal
        ones the left goes first) and not above that of the right part's.
        """
        pair = before << 32 | token
        if (known := self.fits.get(pair)) is not None:
            return known
        left, right, ids = self._edge(before, 1), self._edge(token, 0), self.ids
        i = j = 0
        known = True
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            rank = ids.get(a + b)
            if rank is not None and rank < a_until and rank <= b_until:
                known = False
                break
            if a_until <= b_until:
                i += 1
            else:
                j += 1
            if i == len(left) or j == len(right):
                break
        if len(self.fits) >= MEMO:
            self.fits.clear()
        self.fits[pair] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Lengthen ``last`` (``last[0]`` is -1) to cover ``data``.

        Aho-Corasick gives the tokens that end at a position, the longest first.
        """
        first = len(last)
        begin = max(0, first - self.longest)
        last.extend([-1] * (len(data) + 1 - first))
        for end, (token, n) in self.found.iter(data[begin:].decode("latin-1")):
            i = begin + end + 1
            if i < first or last[i] >= 0:
                continue
            before = last[i - n]
            if (i == n or before >= 0 and self._fit(before, token)) and self._reached(token):
                last[i] = token

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.tokens[last[i]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        if (token := self.ids.get(data)) is not None:
            return [token]
        last = [-1]
        self.extend(data, last)
        return self.walk(data, last)

    def _missing(self, piece: str) -> tuple[int, ...]:
        """Two generations of a memo: what is used stays, and the size is bounded. Long pieces are not remembered."""
        if len(piece) > LONG:
            return tuple(self.encode_piece(piece.encode()))
        if len(self.memo) >= MEMO:
            self.older, self.memo = self.memo, {}
        known = self.memo[piece] = self.older.get(piece) or tuple(self.encode_piece(piece.encode()))
        return known

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out: list[int] = []
        for piece in self.split.findall(text):
            out += self.memo.get(piece) or self._missing(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The encodings of all prefixes of one piece, kept up to date under changes."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, data: bytes) -> None:
        self.data += data
        self.codec.extend(self.data, self.last)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Replace the bytes from start to end.

        An entry depends on no more entries before it than the longest token
        has bytes. Once so many agree with those of before the edit, all later
        ones do, and are copied.
        """
        old, shift, reach = self.last, len(data) - (end - start), self.codec.longest
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        upto = start + len(data)
        while upto < len(self.data):
            upto = min(len(self.data), upto + 2 * reach)
            self.codec.extend(self.data[:upto], self.last)
            if self.last[upto - reach + 1 :] == old[upto - reach + 1 - shift : upto + 1 - shift] and upto - 2 * reach >= start + len(data):
                self.last += old[upto + 1 - shift :]
                return
        self.codec.extend(self.data, self.last)

    def encoding(self, upto: int | None = None) -> list[int]:
        data = self.data if upto is None else self.data[:upto]
        return self.codec.walk(data, self.last)


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    """One per worker process, so that its memos serve all tasks there."""
    key = (hash(vocabulary), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def encode(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the text replaced by its token ids (array of int).

    ``vocabulary``: path of a rank file on the driver (base64 token and rank
    in each line); it has a fixed size and goes to the workers with the code.
    ``decoded_col``: also add the bytes that decoding the ids gives.

    A null text is encoded as the empty one, to an empty array. Texts are
    encoded whole, at any length; rows are independent, so repeated rows give
    repeated results and an empty table an empty one. Other columns stay,
    except columns that have the name of an added one.
    """
    data = Path(vocabulary).read_bytes()
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns if c == text_col or c not in added])
    fields = [f for f in df.schema if f.name != text_col] + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(decoded_col, T.BinaryType())] if decoded_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rest = [i for i in range(batch.num_columns) if i != at]
            for part in byte_slices(batch, at, 1 << 20):
                found = [codec.encode(t) for t in part.column(at).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x) for x in found], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
                columns = [part.column(i) for i in rest] + [pa.ListArray.from_arrays(offsets, flat)]
                if decoded_col:
                    columns.append(pa.array([codec.decode(x) for x in found], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[i] for i in rest] + added)

    return df.mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids added; null ids give null bytes.

    A column with the name of the added one is replaced, all others stay.
    Rows are independent: repeated rows give repeated results, lists of any
    length are decoded whole, an empty table gives an empty one. An id that the
    vocabulary lacks raises KeyError.
    """
    data = Path(vocabulary).read_bytes()
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == ids_col or c != decoded_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [None if x is None else codec.decode(x) for x in part.column(ids_col).to_pylist()]
                yield part.append_column(decoded_col, pa.array(found, pa.binary()))

    return df.mapInArrow(run, T.StructType([*df.schema, T.StructField(decoded_col, T.BinaryType())]))
