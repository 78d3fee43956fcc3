"""N-gram Jaccard join with prefix trees.

Documents are sets of word n-grams in one global order, rare grams first. Two sets can only be similar enough if
they share one of the first few grams of each; such shared grams lead sets to a common cluster. The order comes in
two steps. A table of counts of fixed size tells very frequent grams, and gives each set a head somewhat longer
than needed: heads of sets that link share several grams. Exact counts are then made of the grams of heads only,
and the rarest of a head, as many as at least one shared gram must be among, tell which sets meet. In a large
collection most of these meet by chance, and through them nearly all sets would hang together. So two sets that
meet lead to one cluster only if their sketches, bitmaps of their grams, leave room for the overlap that a link
needs. Inside a cluster the sets stand in a trie, frequent grams first, so that similar sets share long paths. Every set is walked down
the trie: what it shares with a path is counted once for all sets below, and a subtree is left as soon as the
remaining lengths can't give the overlap that a link needs. Large clusters are cut into blocks, and each pair of
blocks is joined in a task of its own.

Equal sets are one node throughout. Sets that are already known to be connected aren't compared again, so a
large group of near copies costs about as many comparisons as it has members.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_words, components, held, maybe_in, slices, stage

#: Buckets of the table of gram counts, which gives the global order (fixed size, broadcast).
BUCKETS = 1 << 18
#: Grams of a cluster per block, which bounds a task; bytes of text that are hashed at a time.
BLOCK_GRAMS, CHUNK_BYTES = 400_000, 1 << 18
#: Most bits of a set's sketch (a larger set has a fuller one, which tells less); sets of one gram that meet in a task.
SKETCH_BITS, MEET_SETS = 1 << 18, 4_096
#: Bits of the filter that spares texts outside all clusters (fixed size, broadcast).
FILTER_BITS = 1 << 22
#: Bits of the filter that spares rare grams a second shuffle (fixed size, broadcast).
GRAM_FILTER_BITS = 1 << 24

_U = np.uint64
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Base of the polynomial over bytes (odd, so it has an inverse modulo 2^64), and a random value for each byte.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept until the worker serves another operator."""
    size = max(2 * CHUNK_BYTES, 1 << (n - 1).bit_length())
    run = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
    return held(("powers", size), lambda: (run(_BASE), run(_INVERSE)))


def gram_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text.

    A-Z count as lower case; words are runs of bytes other than ASCII white space. A text with fewer words than
    `words` is one gram; without words the set is empty.
    """
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        upto = at + 1
        while upto < len(texts) and offsets[upto + 1] - offsets[at] <= CHUNK_BYTES:
            upto += 1
        yield from _chunk_sets(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at], words)
        at = upto


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    n_docs, empty = len(offsets) - 1, np.zeros(0, np.uint64)
    inside = ~_SPACES[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offsets] = False  # a word doesn't go on from the text before
    starts = np.flatnonzero(inside & ~before[:-1])
    if not len(starts):
        yield from (empty for _ in range(n_docs))
        return
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    power, inverse = _powers_to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * power[: len(data)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)  # first word of each text
    factors = [_U(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

    def gram(parts: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(parts[0]), len(parts), np.uint64)
        for k, part in enumerate(parts):
            total = _mix(total * factors[k % 8] + part)
        return total

    count = max(0, len(word) - words + 1)
    grams = gram([word[k : k + count] for k in range(words)]) if count else empty
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= words:
            yield np.unique(grams[a : b - words + 1])
        elif b > a:
            yield gram([word[k : k + 1] for k in range(a, b)])
        else:
            yield empty


def _signature(grams: np.ndarray) -> tuple[int, int]:
    """Two sums over the set, as signed 64-bit numbers: equal sets have equal ones."""
    with np.errstate(over="ignore"):
        a, b = (_mix(grams ^ _U(k)).sum(dtype=np.uint64) for k in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _node():
    """A set's name: a hash of its signature."""
    return F.xxhash64("s1", "s2")


def _columns(*columns) -> list[pa.Array]:
    return [pa.array(values, kind) for values, kind in columns]


class _Nodes:
    """First pass: size and signature of every set, then the counts of gram buckets of the whole task."""

    def __init__(self, words: int):
        self.words = words

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "s1", "s2", "bucket", "times"]
        counts, waiting, held = np.zeros(BUCKETS, np.int64), [], 0
        for part in slices(batches, 2_000):
            rows = []
            for doc, grams in zip(part.column(0).to_pylist(), gram_sets(part.column(1), self.words)):
                rows.append((doc, len(grams), *_signature(grams)))
                waiting.append((grams & _U(BUCKETS - 1)).astype(np.int32))
                held += len(grams)
                if held >= 500_000:
                    counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
                    waiting, held = [], 0
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(_columns(*[(c, pa.int64()) for c in zip(*rows)], (none, pa.int32()), (none, pa.int64())), names)
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=BUCKETS)
        used = np.flatnonzero(counts)
        for start in range(0, len(used), 65_536):
            mine = used[start : start + 65_536]
            none = pa.nulls(len(mine), pa.int64())
            yield pa.RecordBatch.from_arrays([none] * 4 + _columns((mine, pa.int32()), (counts[mine], pa.int64())), names)


def _ranked(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The grams in the global order: by the count of their bucket, then by hash."""
    return grams[np.lexsort((grams, counts[(grams & _U(BUCKETS - 1)).astype(np.int64)]))]


def _needed(n: int, least: tuple[int, int]) -> int:
    """Grams at the start of a set of n that must hold one of any set it links with."""
    top, bottom = least
    return n - -(-top * n // bottom) + 1


def _sketch(grams: np.ndarray) -> bytes:
    """A bitmap with the bits of the set's grams, at least two bits a gram up to SKETCH_BITS in all."""
    size = min(SKETCH_BITS, max(64, 1 << (2 * len(grams) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(grams & _U(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) as they are with fewer bits."""
    return np.bitwise_or.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def may_link(n: int, sketch: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, least: tuple[int, int]) -> np.ndarray:
    """Whether a set of n grams can link with others, by their sketches in rows; never false for a link.

    A bit of one sketch that the other lacks stands for a gram, or several, that are not shared.
    """
    words = min(len(sketch), sketches.shape[1])
    if len(sketch) > words:
        sketch = _fold(sketch[None], words)[0]
    elif sketches.shape[1] > words:
        sketches = _fold(sketches, words)
    top, bottom = least
    need = -(-top * (n + sizes) // (top + bottom))
    count = lambda bits: np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)
    both = count(sketches & sketch)
    return (n - count(sketch) + both >= need) & (sizes - count(sketches) + both >= need)


class _Heads:
    """Second pass: the head of every set in the order of the table of counts, and its sketch."""

    def __init__(self, words: int, least: tuple[int, int], counts):
        self.words, self.least, self.counts = words, least, counts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(self.counts.value), np.int64)
        for part in slices(batches, 2_000):
            rows = []
            for grams in gram_sets(part.column(0), self.words):
                if len(grams):
                    n = _needed(len(grams), self.least)
                    rows.append((*_signature(grams), _ranked(grams, counts)[: n + n // 3].view(np.int64), _sketch(grams)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = _columns(*zip(zip(*rows), kinds)) if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["s1", "s2", "head", "sketch"])


class _Star:
    """Pairs (`a`, `b`) whose sketches allow a link."""

    def __init__(self, least: tuple[int, int]):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = lambda v: np.frombuffer(v.as_buffer(), np.uint64)
        for part in slices(batches, 2_000):
            a, b, sizes, others, left, right = part.columns
            others = others.to_numpy()
            keep = [
                bool(may_link(n, words(x), others[i : i + 1], words(y)[None], self.least)[0])
                for i, (n, x, y) in enumerate(zip(sizes.to_pylist(), left, right))
            ]
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def meetings(nodes: np.ndarray, labels: np.ndarray, sizes: np.ndarray, asks: np.ndarray, sketches: list[np.ndarray], share: tuple[int, int], least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of labels that connect all sets with different labels whose sketches allow a link.

    Sets that ask are held against those that don't, and against each other where the sum of their names falls into
    this task's share (number, of how many).
    """
    top, bottom = least
    mine, of = share
    labels = labels.copy()
    lengths = np.array([len(x) for x in sketches])
    alike = [(k, np.stack([sketches[i] for i in k])) for k in (np.flatnonzero(lengths == n) for n in np.unique(lengths))]
    place = nodes % of
    links = []
    for i in np.flatnonzero(asks):
        for k, rows in alike:
            fits = (labels[k] != labels[i]) & (top * sizes[k] <= bottom * sizes[i]) & (top * sizes[i] <= bottom * sizes[k])
            fits &= ~asks[k] | ((k > i) & ((place[k] + place[i]) % of == mine))
            if not fits.any():
                continue
            met = k[fits]
            for j in met[may_link(sizes[i], sketches[i], sizes[met], rows[fits], least)]:
                if labels[i] != labels[j]:
                    links.append((int(labels[i]), int(labels[j])))
                    labels[labels == labels[j]] = labels[i]
    return links


class _Meet:
    """Joins the sets that meet at a gram, whose rows arrive one after another."""

    def __init__(self, least: tuple[int, int]):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        top, bottom = self.least

        def done() -> list[tuple[int, int]]:
            # most groups are small, and most of these hold no two sets of like sizes and different labels
            if len(rows) < 16 and not any(
                x[1] != y[1] and top * x[2] <= bottom * y[2] and top * y[2] <= bottom * x[2] for x, y in combinations(rows, 2)
            ):
                return []
            *columns, sketches = zip(*rows)
            columns = [np.array(c, kind) for c, kind in zip(columns, (np.int64, np.int64, np.int64, bool))]
            return meetings(*columns, [np.frombuffer(x.as_buffer(), np.uint64) for x in sketches], key[1:], self.least)

        for part in slices(batches):
            links = []
            *columns, sketches = part.columns
            for gram, chunk, chunks, *row, sketch in zip(*[c.to_pylist() for c in columns], sketches):
                if (gram, chunk, chunks) != key:
                    links += done()
                    key, rows = (gram, chunk, chunks), []
                rows.append((*row, sketch))
            yield self._batch(links)
        yield self._batch(done())

    @staticmethod
    def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_columns(([a for a, _ in links], pa.int64()), ([b for _, b in links], pa.int64())), ["a", "b"])


def _clusters(leading: DataFrame, sketches: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Components (`node`, `component`) of the pairs that meet at a gram of `leading` and whose sketches allow a link.

    In each gram's group, the sets are held first against the lowest one. Those that stay with it, there or elsewhere,
    have one label; then the sets of a group with different labels meet in a task. The sets of a group's commonest
    label are dealt to several tasks where they are many, and only the others go to each of these. So a large group
    of near copies costs as many comparisons as it has members.
    """
    top, bottom = least
    lowest = leading.groupBy("gram").agg(F.min(F.struct("node", "n")).alias("low"))
    star = leading.join(lowest, "gram").select(F.col("low.node").alias("a"), F.col("node").alias("b"), F.col("low.n").alias("n_a"), F.col("n").alias("n_b"))
    star = star.where(f"a < b AND {top} * n_a <= {bottom} * n_b AND {top} * n_b <= {bottom} * n_a").distinct()
    for side in "ab":
        star = star.join(sketches.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)
    star = star.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_Star(least), "a long, b long")
    labels = stage(components(star))

    labelled = leading.join(labels, "node", "left").select("gram", "node", "n", F.coalesce("component", "node").alias("label"))
    labelled = stage(labelled)
    groups = labelled.groupBy("gram", "label").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("low"))
    groups = groups.groupBy("gram").agg(
        F.max(F.struct("k", "label")).alias("most"), F.min("low").alias("low"), F.sum("k").alias("sets"), F.count(F.lit(1)).alias("labels")
    )
    groups = groups.where("labels > 1 AND sets > 2").select(
        "gram", "low", F.col("most.label").alias("common"), F.ceil(F.col("sets") / MEET_SETS).cast("int").alias("chunks")
    )
    sets = labelled.join(groups, "gram").where("node > low").withColumn("asks", F.col("label") != F.col("common"))
    every, one = F.sequence(F.lit(0), F.col("chunks") - 1), F.array(F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    sets = sets.withColumn("chunk", F.explode(F.when(F.col("asks"), every).otherwise(one))).join(sketches, "node")
    sets = sets.select("gram", "chunk", "chunks", "node", "label", "n", "asks", "sketch")
    sets = sets.repartition("gram", "chunk").sortWithinPartitions("gram", "chunk")
    merged = stage(components(stage(sets.mapInArrow(_Meet(least), "a long, b long"))))

    into = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    named = labels.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return named.unionByName(merged.join(labels.select("node"), "node", "left_anti"))


def _candidates(texts: DataFrame, nodes: DataFrame, words: int, least: tuple[int, int], counts) -> DataFrame:
    """Clusters (`node`, `component`) of sets: pairs that can link stand in one cluster.

    A head has n needed grams and c = n // 3 more, so heads of linked sets share c + 1 grams or more. Order the
    grams of a head by (in one set only or in several, count, gram): the first shared gram is among the first n
    of both heads. Two more cover what rounding may cost where sizes differ. Grams of one set come first and lead
    nowhere; so most documents have no gram that leads to another.

    Grams are counted with a partial sum before the shuffle, so copies and frequent grams are no hot keys. A gram
    that stands twice names its two sets in that sum; the sets of more frequent grams are looked up again, and a
    filter spares most of the other grams this second shuffle.
    """
    heads = stage(texts.select("text").mapInArrow(_Heads(words, least, counts), "s1 long, s2 long, head array<long>, sketch binary"))
    postings = heads.select(_node().alias("node"), F.explode("head").alias("gram"))
    sums = postings.groupBy("gram").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("times"))
    shared = stage(sums.where("low < high"))
    twice = shared.where("times = 2").select(F.explode(F.array("low", "high")).alias("node"), "times", "gram")
    often = shared.where("times > 2").select("gram", "times")
    maybe = maybe_in(postings, "gram", bit_words(often, "gram", GRAM_FILTER_BITS), GRAM_FILTER_BITS)
    several = twice.unionByName(maybe.join(often, "gram").select("node", "times", "gram"))
    several = several.groupBy("node").agg(F.collect_set(F.struct("times", "gram")).alias("several"))
    top, bottom = least
    sizes = nodes.select(_node().alias("node"), "n").select("node", F.expr(f"CAST(n - (n * {top} + {bottom - 1}) DIV {bottom} + 1 AS INT)").alias("needed"), "n")
    length = F.least(F.col("n"), F.col("needed") + F.expr("needed DIV 3"))
    room = (F.col("needed") + 2 - (length - F.size("several"))).cast("int")
    leading = several.join(sizes, "node").where(room > 0)
    leading = leading.select("node", "n", F.explode(F.slice(F.array_sort("several"), F.lit(1), room)).alias("g"))
    leading = stage(leading.select("node", "n", F.col("g.gram").alias("gram")))
    sketches = stage(heads.select(_node().alias("node"), "sketch").dropDuplicates(["node"]))
    return _clusters(leading, sketches, least)


class _Sets:
    """Third pass: whole sets of the documents that the filter lets through, as bytes."""

    def __init__(self, words: int, bits):
        self.words, self.bits = words, bits

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(zlib.decompress(self.bits.value), np.uint64)
        for part in slices(batches, 2_000):
            at = part.column(2).to_numpy(zero_copy_only=False)
            through = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1
            part = part.filter(pa.array(through))
            rows = [
                (doc, *_signature(grams), grams.tobytes())
                for doc, grams in zip(part.column(0).to_pylist(), gram_sets(part.column(1), self.words))
                if len(grams)
            ]
            kinds = [pa.int64()] * 3 + [pa.binary()]
            columns = _columns(*zip(zip(*rows), kinds)) if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "s1", "s2", "grams"])


class Trie:
    """Sets of ids in one order, stored as path segments; segments of one level lie side by side.

    Segment k holds the ids of set k beyond the longest path it shares with the set before it. Set k hangs at
    some place of an earlier segment, its parent.
    """

    def __init__(self, sets: list[np.ndarray]):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        seqs = [sets[i] for i in self.order]
        m = len(seqs)
        self.sizes = np.array([len(s) for s in seqs])
        depth, parent, level = np.zeros(m, int), np.full(m, -1), np.zeros(m, int)
        stack: list[int] = []
        for k in range(m):
            if k:
                a, b = seqs[k - 1], seqs[k]
                n = min(len(a), len(b))
                unlike = np.flatnonzero(a[:n] != b[:n])
                depth[k] = unlike[0] if len(unlike) else n
                while len(stack) > 1 and depth[stack[-1]] >= depth[k]:
                    stack.pop()
                if depth[k]:
                    parent[k] = stack[-1]
                    level[k] = level[stack[-1]] + 1
                else:
                    stack = []
            stack.append(k)
        self.least, self.most = self.sizes.copy(), self.sizes.copy()
        for k in range(m - 1, -1, -1):  # sizes in the subtree of each segment
            if parent[k] >= 0:
                self.least[parent[k]] = min(self.least[parent[k]], self.least[k])
                self.most[parent[k]] = max(self.most[parent[k]], self.most[k])
        self.depth, self.parent = depth, parent
        self.levels = []
        for at in range(level.max() + 1 if m else 0):
            segments = np.flatnonzero(level == at)
            lengths = self.sizes[segments] - depth[segments]
            ids = np.concatenate([seqs[k][depth[k] :] for k in segments])
            starts = np.concatenate([[0], np.cumsum(lengths)])
            self.levels.append((segments, ids, starts))
        self.slot = np.zeros(m, int)
        for segments, _, _ in self.levels:
            self.slot[segments] = np.arange(len(segments))

    def overlaps(self, has: np.ndarray, passed: np.ndarray, size: int, open_: np.ndarray, least: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of sets that are reached without pruning, and their overlaps with a set.

        `has` tells for each id whether the set holds it, `passed` how many of its ids are below; `open_` marks
        the sets that may be reached.
        """
        top, bottom = least
        reached, shared = [], []
        base, alive = np.zeros(len(self.sizes), int), np.zeros(len(self.sizes), bool)
        # a link needs overlap >= top * (sizes together) / (top + bottom)
        need = lambda sizes: -(-top * (size + sizes) // (top + bottom))
        above = None
        for segments, ids, starts in self.levels:
            if above is None:
                alive[segments] = True
            else:
                up = self.parent[segments]
                sums, first = above
                edge = first[self.slot[up]]
                upto = edge + self.depth[segments] - self.depth[up]
                base[segments] = base[up] + sums[upto] - sums[edge]
                alive[segments] = alive[up]
            # what is left below: ids of the set from the first id of the segment on, and lengths in the subtree
            begins = np.minimum(starts[:-1], len(ids) - 1) if len(ids) else None
            left = size - passed[ids[begins]] if begins is not None else np.zeros(len(segments), int)
            left = np.where(starts[1:] > starts[:-1], left, 0)
            rest = self.most[segments] - self.depth[segments]
            left = np.where(starts[1:] > starts[:-1], np.minimum(left, rest), 0)
            fits = (top * size <= bottom * self.most[segments]) & (top * self.least[segments] <= bottom * size)
            # a subtree may branch off at the segment's first id or later, never before it
            alive[segments] &= fits & (base[segments] + left >= need(self.least[segments]))
            if not alive[segments].any():
                break
            sums = np.concatenate([[0], np.cumsum(has[ids])])
            above = (sums, starts)
            mine = alive[segments] & open_[segments]
            reached.append(segments[mine])
            shared.append((base[segments] + sums[starts[1:]] - sums[starts[:-1]])[mine])
        if not reached:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(reached), np.concatenate(shared)


def trie_links(names: list[int], sets: list[np.ndarray], side: list[int], counts: np.ndarray, least: tuple[int, int]) -> list[tuple[int, int]]:
    """Pairs of names that connect all sets that links connect (a spanning forest of the links).

    `side` tells two blocks apart: sets of one block are compared with those of the other; if there is one block
    only, with each other.
    """
    top, bottom = least
    every = _ranked(np.unique(np.concatenate(sets)), counts)[::-1]  # frequent first
    by_hash = np.argsort(every)
    ranks = [np.sort(by_hash[np.searchsorted(every, s, sorter=by_hash)]) for s in sets]
    two = len(set(side)) > 1
    stored = [i for i in range(len(sets)) if not two or side[i] == 1]
    asking = [i for i in range(len(sets)) if not two or side[i] == 0]
    trie = Trie([ranks[i] for i in stored])
    label = np.arange(len(sets))
    at = np.array([stored[k] for k in trie.order])  # set of each position in the trie
    has = np.zeros(len(every), bool)
    links = []
    for x in asking:
        open_ = label[at] != label[x]
        if not two:
            open_ &= at > x
        if not open_.any():
            continue
        has[ranks[x]] = True
        passed = np.cumsum(has) - has
        found, overlap = trie.overlaps(has, passed, len(ranks[x]), open_, least)
        has[ranks[x]] = False
        linked = found[bottom * overlap >= top * (len(ranks[x]) + trie.sizes[found] - overlap)]
        for y in at[linked]:
            if label[y] != label[x]:
                links.append((names[x], names[int(y)]))
                label[label == label[y]] = label[x]
    return links


class _Join:
    """Joins the sets of each block pair; its rows arrive one after another."""

    def __init__(self, least: tuple[int, int], counts):
        self.least, self.counts = least, counts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(zlib.decompress(self.counts.value), np.int64)
        key, names, sets, sides, links = None, [], [], [], []

        def done():
            if len(names) > 1:
                links.extend(trie_links(names, sets, sides, counts, self.least))

        for part in slices(batches):
            columns = [part.column(i).to_pylist() for i in range(3)]
            for *this, node, side, grams in zip(*columns, part.column(3).to_pylist(), part.column(4).to_pylist(), part.column(5)):
                if this != key:
                    done()
                    key, names, sets, sides = this, [], [], []
                names.append(node)
                sides.append(side)
                sets.append(np.frombuffer(grams.as_buffer(), np.uint64))
        done()
        yield pa.RecordBatch.from_arrays(_columns(([a for a, _ in links], pa.int64()), ([b for _, b in links], pa.int64())), ["a", "b"])


def connect(docs: DataFrame, words: int = 5, least: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Near-duplicate classes: doc_id, n_shingles (size of the set) and component_id.

    Documents link when bottom * |intersection| >= top * |union| of their sets of `words`-word grams, with
    `least` = (top, bottom); component_id is the smallest document id that links reach. Documents without words
    or text have no set and are linked with nothing. Rows with one id and one set are one row of the result;
    rows with one id and different sets are documents of their own. A null id gets no row. Extra columns are
    ignored; an empty table gives no rows. Texts are read whole. Grams are 64-bit hashes.

    `least` must be one half or more. Texts are read three times and never shuffled. What is shuffled: a
    signature per document, the heads (4/3 * (1 - top/bottom) of the grams), sketches of sets that meet at a rare gram
    and the whole sets of clusters only. The table of counts and both filters have fixed sizes; a filter that fills up spares nothing (heads are then
    shuffled twice, or all sets once), and the join after it still decides.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where(F.col("doc_id").isNotNull())

    read = texts.mapInArrow(_Nodes(words), "doc_id long, n long, s1 long, s2 long, bucket int, times long")
    read = stage(read)
    members = read.where(F.col("doc_id").isNotNull()).select("doc_id", "n", "s1", "s2").distinct()
    table = read.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.sum("times").alias("times")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[table.bucket.to_numpy()] = table.times.to_numpy()
    counts = share(zlib.compress(counts.tobytes(), 1))

    nodes = members.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("node"))
    nodes = stage(nodes)
    own = _node()
    clusters = stage(_candidates(texts, nodes, words, least, counts))

    of = nodes.select(F.col("node").alias("doc_id"), "s1", "s2", "n", own.alias("key")).join(clusters.withColumnRenamed("node", "key"), "key")
    mass = of.groupBy("component").agg(F.sum("n").alias("mass"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("mass") / BLOCK_GRAMS)).cast("int")
    of = of.join(mass.select("component", blocks.alias("blocks")), "component")
    of = stage(of.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int")))

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    set_bits = bit_words(of, "doc_id", FILTER_BITS).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[set_bits.word.to_numpy().astype(int)] = set_bits.bits.to_numpy()
    sets = texts.withColumn("bit", bit).mapInArrow(_Sets(words, share(zlib.compress(bits.tobytes(), 1))), "doc_id long, s1 long, s2 long, grams binary")
    whole = sets.join(of, ["doc_id", "s1", "s2"])
    dealt = whole.select("component", "block", "key", "grams", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(
        "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "key", F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"), "grams",
    )
    group = ["component", "low", "high"]
    sorted_ = dealt.repartition(*group).sortWithinPartitions(*group)
    links = sorted_.mapInArrow(_Join(least, counts), "a long, b long")

    joined = components(stage(links))
    named = nodes.select(own.alias("key"), F.col("node").alias("first"), "s1", "s2").join(joined.withColumnRenamed("node", "key"), "key")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    result = named.join(lowest, "component").select("s1", "s2", "component_id")
    alone = nodes.select("s1", "s2", F.col("node").alias("own"))
    classes = alone.join(result, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component_id", "own").alias("component_id"))
    return members.join(classes, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )
