"""Byte-level BPE as a tree reduction over a monoid.

An encoded text is an element of a monoid whose product joins two neighbours. The halves of a text are encoded
on their own, then joined by encoding again a window at the boundary, which grows until nothing outside it can
change. Two facts make that provable:

* Splitting: a match depends only on the text after its start, and sees at most three characters beyond its end.
  So matches that end three characters before the cut stay; matching goes on from there until it meets a
  boundary of the right half, from where both agree.
* Merging: a list of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of
  their joint bytes (merges inside a span never depend on what is outside until one crosses its border, and the
  first one that crosses would also cross in the pair alone). So a window is large enough when the pairs at its
  two seams are stable.

Decoding joins the bytes of the tokens up the same tree.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import held, packed_lists, slices

#: Leaves of the two trees; how many pieces of text (of two generations each), and
#: runs or seams inside them, are remembered per worker.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 32_768, 6, 4_096
#: Runs up to this length are merged by scanning; the leaf of a longer piece.
SHORT_BYTES, LONG_LEAF_BYTES = 64, 65_536
REMEMBERED, REMEMBERED_RUNS = 150_000, 100_000
#: How far beyond its end a match can look: "'ll" and the like.
LOOKAHEAD = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base 64 and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one table of ranks and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(pattern)
        self.known = _Known(self)
        self.stable: dict[tuple[int, int], bool] = {}
        self.runs: dict[bytes, list[int]] = {}
        self.pair_ranks: dict[int, int | None] = {}

    # --- merging -----------------------------------------------------------------------------------------

    def _run(self, data: bytes) -> list[int]:
        """Tokens of a short run of bytes; runs met before are remembered, since halves of words recur."""
        found = self.runs.get(data)
        if found is None:
            found = self._merged(data)
            if len(data) <= 2 * LEAF_BYTES:
                if len(self.runs) >= REMEMBERED_RUNS:
                    self.runs.clear()
                self.runs[data] = found
        return found

    def _merged(self, data: bytes) -> list[int]:
        """Tokens of a run of bytes: the leftmost pair of lowest rank is merged until none is left."""
        if len(data) > SHORT_BYTES:
            return self._merged_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank_of = self.ranks.get
        ranks = [rank_of(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, rank in enumerate(ranks):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [self.ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank_of(parts[at - 1] + parts[at])

    def _merged_long(self, data: bytes) -> list[int]:
        """The same for a long run: places wait under the rank of their pair, ranks in a heap, parts in a linked list."""
        tokens = [self.ranks[data[i : i + 1]] for i in range(len(data))]
        after, before = list(range(1, len(data) + 1)), list(range(-1, len(data) - 1))
        waiting: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(tokens, tokens[1:])):
            rank = self._pair_rank(a, b)
            if rank is not None:
                waiting.setdefault(rank, []).append(i)
        heap = sorted(waiting)
        while heap:
            rank = heapq.heappop(heap)
            places = sorted(waiting.pop(rank))
            for k, i in enumerate(places):
                j = after[i]
                if tokens[i] < 0 or j == len(data) or self._pair_rank(tokens[i], tokens[j]) != rank:
                    continue  # one of the two has been merged meanwhile
                tokens[i], tokens[j], after[i] = rank, -1, after[j]
                if after[i] < len(data):
                    before[after[i]] = i
                lowest = rank
                for left, right in ((before[i], i), (i, after[i])):
                    if left >= 0 and right < len(data):
                        new = self._pair_rank(tokens[left], tokens[right])
                        if new is not None:
                            if new not in waiting:
                                heapq.heappush(heap, new)
                            waiting.setdefault(new, []).append(left)
                            lowest = min(lowest, new)
                if lowest < rank:  # a lower rank has come up: it is next, the other places wait on
                    if rank not in waiting:
                        heapq.heappush(heap, rank)
                    waiting.setdefault(rank, []).extend(places[k + 1 :])
                    break
        return [t for t in tokens if t >= 0]

    def _pair_rank(self, a: int, b: int) -> int | None:
        key = a << 32 | b
        found = self.pair_ranks.get(key, -1)
        if found == -1:
            found = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if len(self.pair_ranks) >= REMEMBERED_RUNS:
                self.pair_ranks.clear()
            self.pair_ranks[key] = found
        return found

    def _is_stable(self, a: int, b: int) -> bool:
        found = self.stable.get((a, b))
        if found is None:
            found = self._merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            if len(self.stable) >= REMEMBERED_RUNS:
                self.stable.clear()
            self.stable[a, b] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The product: tokens of the joint bytes of two encodings.

        A side of the window that is not stable yet takes in as many tokens again as it has; a window that covers
        both halves is their encoding.
        """
        if not left or not right or self._is_stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            kept = len(left) - i
            window = self._run(b"".join(self.bytes_of[t] for t in left[kept:] + right[:j]))
            open_left = kept > 0 and not self._is_stable(left[kept - 1], window[0])
            open_right = j < len(right) and not self._is_stable(window[-1], right[j])
            if not open_left and not open_right:
                return left[:kept] + window + right[j:]
            i, j = min(i * (1 + open_left), len(left)), min(j * (1 + open_right), len(right))

    def _encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._run(data)
        if SHORT_BYTES < len(data) <= LONG_LEAF_BYTES:
            return self._merged_long(data)
        middle = len(data) // 2
        return self.join(self._encode_bytes(data[:middle]), self._encode_bytes(data[middle:]))

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one match of the pattern."""
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self._encode_bytes(data))

    # --- splitting ---------------------------------------------------------------------------------------

    def _ends(self, text: str, low: int, high: int) -> list[int]:
        """Ends of the matches in text[low:high], which tile it."""
        if high - low <= LEAF_CHARS:
            return [m.end() for m in self.pattern.finditer(text, low, high)]
        middle = (low + high) // 2
        left, right = self._ends(text, low, middle), self._ends(text, middle, high)
        while left and left[-1] > middle - LOOKAHEAD:
            left.pop()
        goal = {end: k for k, end in enumerate(right, 1)} | {middle: 0}
        for m in self.pattern.finditer(text, left[-1] if left else low, high):
            left.append(m.end())
            if m.end() in goal:
                return left + right[goal[m.end()] :]
        return left

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern in the whole text."""
        if len(text) <= LEAF_CHARS:
            return self.pattern.findall(text)
        ends = self._ends(text, 0, len(text))
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    # --- both ways ---------------------------------------------------------------------------------------

    def packed(self, text: str) -> bytes:
        """Ids of the text as 32-bit integers, one after another."""
        return b"".join(map(self.known.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class _Known(dict):
    """Packed tokens of the pieces met so far. When it is full, a new generation begins, into which pieces of the
    one before are taken over as they recur; the rest goes."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, piece: str) -> bytes:
        tokens = self.before.get(piece)
        if tokens is None:
            tokens = array("i", self.codec.encode_piece(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = tokens
        return tokens


def _codec(key: tuple, shared) -> Codec:
    """The worker's codec for a broadcast table of ranks, kept until the worker serves another operator."""
    return held(("byte_bpe", *key), lambda: Codec(shared.value, key[0]))


def _shared(docs: DataFrame, ranks_path: str, pattern: str) -> tuple[tuple, object]:
    """Name and broadcast of a table of ranks."""
    ranks = read_ranks(ranks_path)
    key = (pattern, len(ranks), zlib.crc32(b"".join(b"%s %d " % r for r in ranks.items())))
    return key, docs.sparkSession.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add `into`: the token ids of the whole text, without special tokens.

    A null text counts as empty and gives no ids; an empty table stays empty; repeated rows give equal ids;
    other columns pass unchanged, and a column named like `into` is replaced. Ids do not depend on how the text
    is cut. The table of ranks is read on the driver and broadcast: its size is that of the vocabulary.
    """
    turn = _Encode(*_shared(docs, ranks_path, pattern))
    return _mapped(docs, text, into, T.ArrayType(T.IntegerType(), False), turn)


def decode(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add `into`: the bytes that the token ids stand for; null ids give no bytes."""
    return _mapped(docs, ids, into, T.BinaryType(), _Decode(*_shared(docs, ranks_path, pattern)))


class _Encode:
    def __init__(self, key: tuple, shared):
        self.key, self.shared = key, shared

    def __call__(self, column: pa.Array) -> pa.Array:
        codec = _codec(self.key, self.shared)
        return packed_lists([codec.packed(text or "") for text in column.to_pylist()])


class _Decode(_Encode):
    def __call__(self, column: pa.Array) -> pa.Array:
        codec = _codec(self.key, self.shared)
        values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return pa.array([codec.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.binary())


def _mapped(docs: DataFrame, source: str, into: str, kind: T.DataType, turn: _Encode) -> DataFrame:
    keep = [c for c in docs.columns if c != into]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            names = part.schema.names
            columns = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, turn(part.column(names.index(source)))], [*keep, into])

    return docs.mapInArrow(run, schema)


def digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


@lru_cache(maxsize=4)
def public_vocabulary(name: str) -> tuple[str, str]:
    """Path and pattern of a vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN
