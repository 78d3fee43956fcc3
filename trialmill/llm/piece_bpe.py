"""SentencePiece BPE by a table of last tokens.

Merges are tried in the order of the scores of what they make, so each token has one last merge, and a list of
tokens is the encoding of its text exactly if each two neighbours are the encoding of their joint text. Hence
the encoding of a prefix, less its last token, is the encoding of a shorter prefix, and each prefix has exactly
one last token: the one of the tokens ending there which goes with the last token of the prefix before it. An
automaton over all pieces yields the tokens that end at each place; the table of last tokens is filled from the
left, and the ids are read off it from the right. The work is linear in the text.

A text is cut first where two characters meet that no piece holds side by side: no merge crosses such a place. The
stretches between are shorter than words and recur more often, so most of them are remembered.

A pair of tokens is tested by undoing their merges at the seam, the latest first: the pair stands unless a merge
across the seam would have come before the one just undone. That needs parts that are merged before the whole.
Pieces without this order (runs of spaces, which share one score) are tested by merging their joint text.
"""

from __future__ import annotations

import codecs
import re
import sys
import zlib
from array import array
from collections.abc import Iterable
from itertools import chain, pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import held, packed_lists, with_column

#: The sign that stands for a space in pieces.
SPACE = "\N{LOWER ONE EIGHTH BLOCK}"
#: Words (of two generations each) and pairs of tokens that a worker remembers, and the longest remembered word.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_CHARS = 200_000, 300_000, 48
#: Characters of a text whose words are listed at once.
LONG = 100_000
#: Kinds of characters that a piece goes on after, and that it goes on with; further characters share a kind.
CHARACTER_KINDS = 1_000
#: Two ids in one number; marks of a place without a last token so far, and of the beginning.
SHIFT, NONE, START = 32, -1, -2
#: What an unknown id is decoded to.
UNKNOWN = " ⁇ "


class Pieces(NamedTuple):
    """What a model says: its size is that of the vocabulary file."""

    words: dict[str, int]
    score: dict[int, float]
    byte_ids: tuple[int, ...]
    surface: tuple[bytes, ...]


def read_pieces(path: str) -> Pieces:
    """The pieces of a BPE model with byte fallback, a space put before the text and no other normalisation."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rules, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
    plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not plain or not model.trainer_spec.byte_fallback:
        raise ValueError(f"{path} is no BPE model with byte fallback that leaves texts as they are")
    words, score, bytes_of, surface = {}, {}, {}, []
    for i, p in enumerate(model.pieces):
        if p.type == kinds.NORMAL:
            words[p.piece], score[i] = i, p.score
            surface.append(p.piece.replace(SPACE, " ").encode())
        elif p.type == kinds.BYTE:
            bytes_of[int(p.piece[1:-1], 16)] = i
            surface.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == kinds.UNKNOWN:
            surface.append(UNKNOWN.encode())
        elif p.type == kinds.CONTROL:
            surface.append(b"")
        else:
            raise ValueError(f"{path}: pieces of kind {p.type} are not supported")
    return Pieces(words, score, tuple(bytes_of[b] for b in range(256)), tuple(surface))


class Codec:
    """Encoder and decoder for one set of pieces."""

    def __init__(self, pieces: Pieces):
        self.words, self.score, self.byte_ids, self.surface = pieces
        self.length = [0] * len(self.surface)
        self.text = [""] * len(self.surface)
        for word, i in self.words.items():
            self.length[i], self.text[i] = len(word), word
        # last merge of each token, and whether its parts are always merged before it
        self.parts: dict[int, tuple[int, int]] = {}
        self.ordered = [False] * len(self.surface)
        self.automaton = ahocorasick.Automaton()
        for word, i in sorted(self.words.items(), key=lambda w: len(w[0])):
            if len(word) > 1:
                made, last = self._merged(word)
                if len(made) > 1:
                    continue  # no text is ever encoded to this piece
                self.parts[i] = last
                a, b = last
                self.ordered[i] = self.ordered[a] and self.ordered[b] and self.score[i] < min(self._made(a), self._made(b))
            else:
                self.ordered[i] = True
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()
        self.foreign = re.compile("[^" + "".join(re.escape(w) for w in self.words if len(w) == 1) + "]") if self.words else re.compile("(?s:.)")
        for word in self.words:
            if self.foreign.search(word):
                raise ValueError(f"the characters of {word!r} are no pieces")
        self._side_by_side()
        self.goes: dict[int, bool] = {}
        self.known = _Known(self)

    def _side_by_side(self) -> None:
        """The kind of each character before and behind a place, and which two kinds always part tokens there.

        Characters of one kind part tokens only if all of them do. Kind 0 is that of characters without a piece
        that goes on there; foreign ones are of kind 0 on either side, so they stand alone. A space is of the kind of its sign.
        """
        pairs = {ab for word in self.words for ab in pairwise(word)}
        n_behind = min(len({b for _, b in pairs}), CHARACTER_KINDS) + 1
        self.before, self.behind = np.zeros(sys.maxunicode + 1, np.int32), np.zeros(sys.maxunicode + 1, np.int32)
        for k, a in enumerate(sorted({a for a, _ in pairs})):
            self.before[ord(a)] = (k % CHARACTER_KINDS + 1) * n_behind
        for k, b in enumerate(sorted({b for _, b in pairs})):
            self.behind[ord(b)] = k % CHARACTER_KINDS + 1
        self.part = np.ones(int(self.before.max()) + n_behind, bool)
        for a, b in pairs:
            self.part[self.before[ord(a)] + self.behind[ord(b)]] = False
        for kind in (self.before, self.behind):
            kind[ord(" ")] = kind[ord(SPACE)]

    def _cuts(self, text: str, start: int) -> list[int]:
        """The places behind `start`, among the next LONG ones, that no token crosses."""
        codes = np.frombuffer(text[start : start + LONG + 1].encode("utf-32-le"), np.uint32)
        return (np.flatnonzero(self.part[self.before[codes[:-1]] + self.behind[codes[1:]]]) + (start + 1)).tolist()

    def _words(self, text: str) -> Iterable[str]:
        """The stretches that no token crosses."""
        if len(text) <= LONG:
            return [text[a:b] for a, b in pairwise([0, *self._cuts(text, 0), len(text)])]
        cuts = chain.from_iterable(self._cuts(text, start) for start in range(0, len(text), LONG))
        return (text[a:b] for a, b in pairwise(chain([0], cuts, [len(text)])))

    def _made(self, token: int) -> float:
        """Score of a token's last merge; a character is there from the start."""
        return self.score[token] if token in self.parts else float("inf")

    def _merged(self, text: str) -> tuple[list[str], tuple[int, int] | None]:
        """The text merged step by step, and the two tokens of the last merge."""
        parts, last = list(text), None
        while True:
            best, at = None, -1
            for i, (a, b) in enumerate(zip(parts, parts[1:])):
                made = self.words.get(a + b)
                if made is not None and (best is None or self.score[made] > best):
                    best, at = self.score[made], i
            if best is None:
                return parts, last
            last = self.words[parts[at]], self.words[parts[at + 1]]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair(self, a: int, b: int) -> bool:
        """Whether the joint text of two tokens is encoded as these two."""
        found = self.goes.get(a << SHIFT | b)
        if found is None:
            if self.ordered[a] and self.ordered[b]:
                found = self._seam_holds(a, b)
            else:
                found = self._merged(self.text[a] + self.text[b])[0] == [self.text[a], self.text[b]]
            if len(self.goes) >= REMEMBERED_PAIRS:
                self.goes.clear()
            self.goes[a << SHIFT | b] = found
        return found

    def _seam_holds(self, a: int, b: int) -> bool:
        words, text, parts = self.words, self.text, self.parts
        undone, undone_left = float("-inf"), False
        while True:
            across = words.get(text[a] + text[b])
            if across is not None:
                score = self.score[across]
                # of equal scores the one further left comes first
                if score > undone or (score == undone and not undone_left):
                    return False
            of_a, of_b = self._made(a), self._made(b)
            if of_a == of_b == float("inf"):
                return True
            if of_a < of_b:
                undone, undone_left, a = of_a, True, parts[a][1]
            else:
                undone, undone_left, b = of_b, False, parts[b][0]

    def _tokens(self, text: str) -> list[int]:
        """Tokens of a text all of whose characters are pieces."""
        length, goes = self.length, self.goes.get
        # last[-1] stands for the beginning of the text, which goes with every token
        last = array("i", [NONE]) * len(text) if len(text) > LONG else [NONE] * len(text)
        last.append(START)
        for end, token in self.automaton.iter(text):
            if last[end] == NONE:
                before = last[end - length[token]]
                stands = before == START or goes(before << SHIFT | token)
                if stands or (stands is None and self.pair(before, token)):
                    last[end] = token
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        """Tokens of a stretch that no token crosses; characters without a piece become bytes."""
        if not self.foreign.search(word):
            return self._tokens(word)
        ids, at = [], 0
        for other in self.foreign.finditer(word):
            ids += self._tokens(word[at : other.start()])
            ids.extend(self.byte_ids[b] for b in other.group().encode())
            at = other.end()
        return ids + self._tokens(word[at:])

    def packed(self, text: str) -> bytes:
        """Ids of the text as 32-bit integers, one after another."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self._words(" " + text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that form no character become a replacement sign each."""
        whole = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        spaced = first is not None and first in self.score and whole.startswith(b" ")
        return whole[spaced:].decode("utf-8", "replace_each_byte")


class _Known(dict):
    """Packed tokens of the words met so far. When it is full, a new generation begins, into which words of the
    one before are taken over as they recur; the rest goes."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, word: str) -> bytes:
        tokens = self.before.get(word)
        if tokens is None:
            # the sign takes the place of spaces in new words only: most texts need a byte a character without it
            tokens = array("i", self.codec.encode_word(word.replace(" ", SPACE))).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[word] = tokens
        return tokens


codecs.register_error("replace_each_byte", lambda e: ("\N{REPLACEMENT CHARACTER}" * (e.end - e.start), e.end))


class _Turn:
    """One way of the codec, for a worker."""

    def __init__(self, docs: DataFrame, path: str):
        pieces = read_pieces(path)
        self.key = "piece_bpe", zlib.crc32(repr((pieces.words, pieces.score)).encode())
        self.shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def codec(self) -> Codec:
        return held(self.key, lambda: Codec(self.shared.value))


class _Encode(_Turn):
    def __call__(self, column: pa.Array) -> pa.Array:
        codec = self.codec()
        return packed_lists([codec.packed(text or "") for text in column.to_pylist()])


class _Decode(_Turn):
    def __call__(self, column: pa.Array) -> pa.Array:
        codec = self.codec()
        values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return pa.array([codec.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())


def encode(docs: DataFrame, model_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add `into`: the ids of the whole text as the model gives them, without begin or end ids and sampling.

    A null text counts as empty and gives no ids; an empty table stays empty; repeated rows give equal ids; other
    columns pass unchanged, and a column named like `into` is replaced. Words are cut only where no token can
    cross. The model is read on the driver and its pieces broadcast: their size is that of the vocabulary.
    """
    return with_column(docs, text, into, T.ArrayType(T.IntegerType(), False), _Encode(docs, model_path))


def decode(docs: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add `into`: the text that the ids stand for, without the space put before it; null ids give an empty text."""
    return with_column(docs, ids, into, T.StringType(), _Decode(docs, model_path))


def public_model(name: str) -> str:
    """Path of a model of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
