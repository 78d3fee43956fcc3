"""Alignment of two tokenizers over the same text.

A token's end is the number of bytes up to and with it. Dictionaries from end to index are made for both id
lists; their common keys, found as an intersection of hash sets and sorted, are the places where both cut. They
slice both lists into groups, and within a group tokens are linked where their bytes overlap.

Tokenizers that work word by word part at every space inside a text, so a text is aligned word by word, and words
met before are remembered. How often a pair of ids is linked in the whole corpus is counted from sums per block
of documents; the counts are then looked up once per block and pair, not once per document.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate, chain, count
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import held, slices, stage

#: Words (of two generations each) and groups that a worker remembers, the longest taken over,
#: texts cut and words aligned at once.
REMEMBERED, REMEMBERED_CHARS, TOGETHER, AT_ONCE = 200_000, 48, 64, 32
#: Different pairs in one row, and links of a block of documents that meets its counts in one group.
ROW_PAIRS, BLOCK_LINKS = 500_000, 1_000_000
#: A space where both tokenizers begin a token: after something else than a space, before a letter, digit or sign.
CUT = re.compile(r"(?<=[^ ▁]) (?=[\w!-/:-@\[-`{-~])")
#: A stretch that may follow another one so.
JOINS = re.compile(r" [\w!-/:-@\[-`{-~]")


#: A stretch of a text with its tokens aligned: numbers of tokens of either kind and of groups, how the groups are
#: written, and a * n + b of each link as packed 64-bit integers. Plain tuples, which the garbage collector lets be.
Word = tuple[int, int, int, str, bytes]


def slices_of(a_sizes: Iterable[int], b_sizes: Iterable[int]) -> dict[int, tuple[int, int]]:
    """Where both of two lists of token sizes in bytes have an end, in order: indexes behind the tokens of either list.

    All sizes are positive and the sums equal.
    """
    a_at = dict(zip(accumulate(a_sizes), count(1)))
    b_at = dict(zip(accumulate(b_sizes), count(1)))
    return {end: (a_at[end], b_at[end]) for end in sorted(a_at.keys() & b_at.keys())}


def expand(a: Sequence[int], b: Sequence[int], a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Pairs of a group whose bytes overlap; no end inside the group is common."""
    links, i, j = [(a[0], b[0])], 0, 0
    a_end, b_end = a_sizes[0], b_sizes[0]
    while i < len(a) - 1 or j < len(b) - 1:
        if a_end < b_end:
            i += 1
            a_end += a_sizes[i]
        else:
            j += 1
            b_end += b_sizes[j]
        links.append((a[i], b[j]))
    return links


class Aligner:
    """Two tokenizers: a byte-level BPE as the content of its JSON file, a SentencePiece model as bytes."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        plain = _byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(plain[c] for c in token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]
        self.n_b = len(self.b_bytes)
        self.a_sizes, self.b_sizes = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.groups: dict[tuple[tuple[int, ...], tuple[int, ...]], tuple[str, array]] = {}
        self.single: dict[int, str] = {}
        self.known: dict[str, Word | None] = {}
        self.before: dict[str, Word | None] = {}

    def words(self, texts: list[list[str]]) -> dict[str, Word | None]:
        """All stretches of some texts, aligned; None where the tokens do not give the stretch's bytes."""
        if len(self.known) >= REMEMBERED:
            # a new generation begins, into which words are taken over as they recur
            self.before = {w: made for w, made in self.known.items() if len(w) <= REMEMBERED_CHARS}
            self.known = {}
        known, before = self.known, self.before
        new = []
        for word in set(chain.from_iterable(texts)).difference(known):
            if word in before:
                known[word] = before[word]
            elif JOINS.match(word) and word[-1] not in " ▁":
                new.append(word)
            else:
                known[word] = self.aligned([word])[0]
        for start in range(0, len(new), AT_ONCE):  # few enough for what is made of them to stay in the processor's cache
            some = new[start : start + AT_ONCE]
            known.update(zip(some, self.aligned(some)))
        return known

    def aligned(self, words: list[str]) -> list[Word | None]:
        """Stretches aligned, read by the tokenizers as one text, in which each of them is a stretch again."""
        whole = "".join(words)
        data = whole.encode()
        flat_a = self.a.encode_batch_fast([whole], add_special_tokens=False)[0].ids
        flat_b = self.b.encode(whole[1:])
        sizes_a, sizes_b = [self.a_sizes[i] for i in flat_a], [self.b_sizes[i] for i in flat_b]
        cuts = slices_of(sizes_a, sizes_b) if sum(sizes_a) == sum(sizes_b) else {}
        ends = list(accumulate(map(len, map(str.encode, words))))
        same = b"".join(map(self.a_bytes.__getitem__, flat_a)) == data == b"".join(map(self.b_bytes.__getitem__, flat_b))
        if not same or not all(map(cuts.__contains__, ends)):
            # some do not come back: halves, down to those
            half = len(words) // 2
            return [*self.aligned(words[:half]), *self.aligned(words[half:])] if half else [None]
        known, single, n_b = self.groups.get, self.single.get, self.n_b
        told, linked, behind, i, j = [], array("q"), [], 0, 0
        for to_i, to_j in cuts.values():
            if to_i - i == 1 == to_j - j:
                link = flat_a[i] * n_b + flat_b[j]
                told.append(single(link) or self._single(link))
                linked.append(link)
            else:
                key = tuple(flat_a[i:to_i]), tuple(flat_b[j:to_j])
                found = known(key) or self._group(*key)
                told.append(found[0])
                linked.extend(found[1])
            behind.append(len(linked))
            i, j = to_i, to_j
        place = dict(zip(cuts, count(1)))
        out, packed, group, link, i, j = [], linked.tobytes(), 0, 0, 0, 0
        for end in ends:
            to_group, (to_i, to_j) = place[end], cuts[end]
            to_link = behind[to_group - 1]
            out.append((to_i - i, to_j - j, to_group - group, ";".join(told[group:to_group]), packed[8 * link : 8 * to_link]))
            group, link, i, j = to_group, to_link, to_i, to_j
        return out

    def _single(self, link: int) -> str:
        """How a group of one token of either kind is written."""
        if len(self.single) >= REMEMBERED:
            self.single.clear()
        made = self.single[link] = f"{link // self.n_b}|{link % self.n_b}"
        return made

    def _group(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[str, array]:
        """How a group is written, and its links."""
        if len(a) == 1 or len(b) == 1:
            pairs = [(x, y) for x in a for y in b]
        else:
            pairs = expand(a, b, [self.a_sizes[x] for x in a], [self.b_sizes[y] for y in b])
        made = f"{','.join(map(str, a))}|{','.join(map(str, b))}", array("q", [x * self.n_b + y for x, y in pairs])
        if len(a) + len(b) <= REMEMBERED_CHARS:
            if len(self.groups) >= REMEMBERED:
                self.groups.clear()
            self.groups[a, b] = made
        return made

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray]]:
        """n_a, n_b, n_groups, the digest of the groups and the links of each text."""
        parted = [_parts(" " + t) if t else [] for t in texts]
        known = self.words(parted)
        for words in parted:
            made = list(map(known.__getitem__, words))
            if not made or None in made:
                yield 0, 0, 0, "", np.zeros(0, np.int64)
                continue
            n_a, n_b, n_groups, told, links = zip(*made)
            digest = hashlib.sha256()
            for start in range(0, len(told), 10_000):
                digest.update((";" if start else "").encode() + ";".join(told[start : start + 10_000]).encode())
            yield sum(n_a), sum(n_b), sum(n_groups), digest.hexdigest(), np.frombuffer(b"".join(links), np.int64)


def _parts(text: str) -> list[str]:
    """The text in stretches that begin with a space; tokens of neither kind cross their borders."""
    first, *rest = CUT.split(text)
    return [first, *[" " + r for r in rest]]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def links(
    docs: DataFrame, a_json: str, b_model: bytes, doc_id: str = "doc_id", text: str = "text", row_pairs: int = ROW_PAIRS, block_links: int = BLOCK_LINKS
) -> DataFrame:
    """Texts aligned, with their different linked pairs of ids, and sums of the pairs per block of documents.

    Rows with `row` hold one text, or a part of a text that has more than `row_pairs` pairs; only the first part
    has counts, digest and doc_id. Rows without `row` hold the pairs of a whole block, which ends with the text
    that brings it to `block_links` links.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((a_json, b_model))
    key = "alignment", zlib.crc32(b_model), zlib.crc32(a_json.encode())
    schema = (
        "block long, row long, first boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, pairs array<long>, times array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = held(key, lambda: Aligner(*shared.value))
        block, row = TaskContext.get().partitionId() << 32, 0
        gathered: list[np.ndarray] = []
        out = _Rows(row_pairs)
        for part in slices(batches, TOGETHER):
            names = part.schema.names
            ids = part.column(names.index("doc_id")).to_pylist()
            for name, made in zip(ids, aligner.texts(part.column(names.index("text")).to_pylist())):
                *told, found = made
                pairs, times = np.unique(found, return_counts=True)
                for start in range(0, max(len(pairs), 1), row_pairs):
                    part_of = slice(start, start + row_pairs)
                    counts = [name, *told[:3], len(found), told[3]] if start == 0 else [None] * 6
                    out.add([block, (TaskContext.get().partitionId() << 32) + row, start == 0, *counts], pairs[part_of], times[part_of])
                row += 1
                gathered.append(found)
                if sum(map(len, gathered)) >= block_links:
                    out.block(block, gathered)
                    block, gathered = block + 1, []
            if out.heavy():
                yield out.batch()
        if gathered:
            out.block(block, gathered)
        yield out.batch()

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


class _Rows:
    """Rows of `links` until they are handed on."""

    NAMES = ["block", "row", "first", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    TYPES = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 5, pa.string()]

    def __init__(self, row_pairs: int = ROW_PAIRS):
        self.row_pairs = row_pairs
        self.rows: list[list[Any]] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, row: list[Any], pairs: np.ndarray, times: np.ndarray) -> None:
        self.rows.append(row)
        self.pairs.append(pairs)
        self.times.append(times)

    def block(self, block: int, gathered: list[np.ndarray]) -> None:
        pairs, times = np.unique(np.concatenate(gathered), return_counts=True)
        for start in range(0, len(pairs), self.row_pairs):
            part = slice(start, start + self.row_pairs)
            self.add([block, None, False, *[None] * 6], pairs[part], times[part])

    def heavy(self) -> bool:
        return sum(map(len, self.pairs)) > self.row_pairs

    def batch(self) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in self.rows], kind) for k, kind in enumerate(self.TYPES)]
        ends = pa.array(np.cumsum([0, *map(len, self.pairs)]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (self.pairs, self.times)]
        self.__init__(self.row_pairs)
        return pa.RecordBatch.from_arrays([*columns, *lists], [*self.NAMES, "pairs", "times"])


def compare(
    docs: DataFrame, a_json_path: str, b_model_path: str, doc_id: str = "doc_id", text: str = "text", row_pairs: int = ROW_PAIRS, block_links: int = BLOCK_LINKS
) -> DataFrame:
    """Per row of `docs`: how the tokens of two tokenizers align, weighed by the whole corpus.

    Tokenizer A, byte-level BPE, reads a space and the text; B, SentencePiece, puts that space itself. Columns:
    doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair is, in the whole corpus, linked as
    often as the commonest pair of its B id), count_sum (those corpus counts, over links), groups_sha256.

    A text that is null or empty, or that one of the two does not give back byte for byte, has no tokens: zeros
    and an empty digest. Repeated rows count and are returned as often as they occur; a null doc_id stays null;
    other columns are left out; an empty table gives no rows. Both files are read on the driver and broadcast:
    their size is that of the vocabularies. The aligned texts are stored once, so a lost executor costs little.
    """
    with open(a_json_path, encoding="utf-8") as file:
        a_json = file.read()
    with open(b_model_path, "rb") as file:
        b_model = file.read()
    n_b = _size(b_model)
    made = stage(links(docs, a_json, b_model, doc_id, text, row_pairs, block_links), "alignment")
    texts = made.where(F.col("row").isNotNull())
    in_blocks = made.where(F.col("row").isNull()).select("block", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    in_blocks = in_blocks.select("block", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    counts = in_blocks.groupBy("pair").agg(F.sum("times").alias("count")).withColumn("b", F.col("pair") % n_b)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    counts = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    looked_up = in_blocks.select(F.col("block").alias("of"), "pair").join(counts, "pair")

    def weigh(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(known["pair"].to_numpy())
        pairs, count, best = (known[c].to_numpy()[order] for c in ("pair", "count", "best"))
        n_best, count_sum = [], []
        for here, times in zip(rows["pairs"], rows["times"]):
            at = np.searchsorted(pairs, np.asarray(here, np.int64))
            times = np.asarray(times, np.int64)
            n_best.append(int(times[best[at].astype(bool)].sum()) if len(at) else 0)
            count_sum.append(int((times * count[at]).sum()) if len(at) else 0)
        return pd.DataFrame({"row": rows["row"], "n_best": n_best, "count_sum": count_sum})

    weighed = (
        texts.select("block", "row", "pairs", "times").groupBy("block")
        .cogroup(looked_up.groupBy("of"))
        .applyInPandas(weigh, "row long, n_best long, count_sum long")
    )
    # a text with very many pairs has several parts
    weighed = weighed.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = texts.where("first").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = told.join(weighed, "row")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _size(b_model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=b_model).get_piece_size()


def public_files(a_name: str, b_name: str) -> tuple[str, str]:
    """Paths of two vocabularies of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(a_name), public_tokenizers.path(b_name)
