"""Toxicity by multiple-instance learning.

Only documents have labels, yet a sentence or two make a document toxic. Each sentence gets a probability, and
a document's score is their noisy-or: the chance that at least one sentence is toxic, beyond that of sentences
without any sign. Weights of words and word
beginnings are trained through the noisy-or from document labels, and the sentence scores then locate the
offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from .shared import let_go, slices, with_column

#: Bounds of the fit: labelled rows that are looked at, features that are kept.
TRAIN_ROWS, FEATURES = 8_000, 4_096
#: A feature must stand in so many toxic documents of the sample, and be so many times as frequent there.
LEAST_DOCS, LEAST_LIFT = 3, 4.0
#: Characters of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Chance, in training, that a document is toxic for no reason that its words tell.
LEAK = 0.01
#: From this score on a document or sentence is taken as toxic.
THRESHOLD = 0.3
#: Words whose weight a task remembers.
REMEMBERED = 100_000
_JUDGED = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
_SENTENCE = re.compile(r"[^.!?\n]+")
_STRIP = ".,;:!?\"'()[]{}<>*-_|"


def keys_of(word: str) -> tuple[str, ...]:
    """Features of a lower-cased word: itself, and its beginnings with a star."""
    bare = word.strip(_STRIP)
    if not bare:
        return ()
    return (bare, *[bare[:n] + "*" for n in BEGINNINGS if len(bare) >= n])


@dataclass(frozen=True)
class Model:
    """Weights by feature, the bias of a sentence, and the chance of any sentence that is taken off each one's.

    A trained model takes off what its bias alone gives. Else sentences that say nothing would add up, and a
    long enough document would be toxic by its length.
    """

    weights: dict[str, float]
    bias: float
    base: float = 0.0

    def sentence_scores(self, text: str, memory: dict[str, float]) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of sentences, and start, end and probability of those with a feature."""
        n, hits = 0, []
        for m in _SENTENCE.finditer(text):
            words = m[0].lower().split()
            if not words:
                continue
            n += 1
            total = 0.0
            for w in words:
                weight = memory.get(w)
                if weight is None:
                    weight = memory[w] = sum(self.weights.get(k, 0.0) for k in keys_of(w))
                total += weight
            if total:
                hits.append((m.start(), m.end(), float(_sigmoid(self.bias + total))))
        return n, hits

    def score(self, n: int, hits: list[tuple[int, int, float]]) -> float:
        """Noisy-or of a document's sentences, each without the base chance; none counts for less than nothing."""
        usual = np.log1p(-self.base)
        clear = (n - len(hits)) * min(0.0, np.log1p(-_sigmoid(self.bias)) - usual)
        clear += sum(min(0.0, np.log1p(-min(p, 1 - 1e-12)) - usual) for *_, p in hits)
        return float(-np.expm1(clear))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2. A null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most about `rows` labelled documents that are not held out (all of them where there are fewer).

    The sample is drawn by a hash of the id, so reruns agree. Documents without a label, with a null label or
    held out teach nothing; several labels of one id count as toxic if one is. Without a toxic or a clean
    document the model scores every text zero. Spark counts the features; the driver gets the kept features
    (at most `FEATURES`) and the sample reduced to them.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    share = min(1.0, rows / max(1, marks.count()))
    # the hash keeps about `rows` ids, a millionth of all at least, so the fit never runs dry
    sample = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, int(share * 1_000_000)))
    texts = docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(sample), "doc_id").select("_text", "toxic")
    counts = (
        texts.mapInArrow(_count_features, "feature string, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    sizes = texts.groupBy("toxic").count().toPandas().set_index("toxic")["count"]
    n_toxic, n_clean = int(sizes.get(1, 0)), int(sizes.get(0, 0))
    if not n_toxic or not n_clean:
        return Model({}, -40.0, float(_sigmoid(-40.0)))
    lift = (F.col("toxic") / n_toxic) / ((F.col("clean") + 1) / n_clean)
    kept = (
        counts.where((F.col("toxic") >= LEAST_DOCS) & (lift >= LEAST_LIFT))
        .orderBy((F.col("toxic") * F.log(lift)).desc(), "feature")
        .limit(FEATURES)
        .select("feature", "toxic", "clean")
        .toPandas()
    )
    known = {f: i for i, f in enumerate(shortest(kept))}
    bags = texts.mapInArrow(_Bags(known), "toxic int, plain int, starts array<int>, features array<int>").toPandas()
    weights, bias = fit(bags, len(known))
    return Model({f: float(weights[i]) for f, i in known.items()}, bias, float(_sigmoid(bias)))


def shortest(kept: pd.DataFrame) -> list[str]:
    """Features without those of which a beginning separates the labels as well.

    A word and its nested beginnings stand in the same documents. Were all of them kept, they would share one
    weight, and a form of the word that has not been seen would get a part of it only.
    """
    lift = {f: t / (c + 1) for f, t, c in zip(kept["feature"], kept["toxic"], kept["clean"])}

    def covered(feature: str) -> bool:
        word, whole = feature.removesuffix("*"), not feature.endswith("*")
        shorter = [word[:n] + "*" for n in BEGINNINGS if n < len(word) + whole]
        return any(lift.get(b, -1.0) >= lift[feature] for b in shorter)

    return [f for f in kept["feature"] if not covered(f)]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each feature, by label, summed up per slice of rows."""
    let_go()
    for part in slices(batches):
        by_label = (Counter(), Counter())
        for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            by_label[toxic].update({k for w in set((text or "").lower().split()) for k in keys_of(w)})
        clean, toxic = by_label
        names = [*toxic, *(k for k in clean if k not in toxic)]
        columns = [pa.array(names, pa.string()), pa.array([toxic[k] for k in names], pa.int64()), pa.array([clean[k] for k in names], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "toxic", "clean"])


class _Bags:
    """Per document: sentences without a feature, and the features of each of the others."""

    def __init__(self, known: dict[str, int]):
        self.known = known

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in slices(batches):
            rows = []
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                plain, starts, features = 0, [], []
                for m in _SENTENCE.finditer(text or ""):
                    words = m[0].lower().split()
                    found = [self.known[k] for w in words for k in keys_of(w) if k in self.known]
                    if found:
                        starts.append(len(features))
                        features += found
                    elif words:
                        plain += 1
                rows.append((toxic, plain, starts, features))
            ints = pa.list_(pa.int32())
            kinds = [pa.int32(), pa.int32(), ints, ints]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "plain", "starts", "features"])


def fit(bags: pd.DataFrame, n_features: int, steps: int = 300, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Gradient ascent (Adam) on the likelihood of document labels under the noisy-or of sentences.

    Documents are scored as `Model.score` does. In training alone any document may be toxic for a reason that no
    word of it tells, with the chance `LEAK`: else labels without a feature would have no likelihood.
    """
    # order of rows must not change the result
    order = sorted(range(len(bags)), key=lambda i: (bags.toxic[i], bags.plain[i], tuple(bags.features[i]), tuple(bags.starts[i])))
    y = np.array([bags.toxic[i] for i in order], float)
    doc_of, sentence_of, feature = [], [], []
    for row, i in enumerate(order):
        edges = [*bags.starts[i], len(bags.features[i])]
        for a, b in zip(edges, edges[1:]):
            sentence_of += [len(doc_of)] * (b - a)
            doc_of.append(row)
        feature += list(bags.features[i])
    doc_of, sentence_of, feature = (np.array(v, int) for v in (doc_of, sentence_of, feature))
    n = len(order)
    theta = np.zeros(n_features + 1)
    theta[-1] = -5.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sentence_of, w[feature], minlength=len(doc_of))
        p, p0 = np.minimum(_sigmoid(z), 1 - 1e-12), _sigmoid(b)
        # as in Model.score: a sentence counts by what it adds to the chance of one that says nothing
        adds = p >= p0
        clear = np.log1p(-LEAK) + np.bincount(doc_of, np.where(adds, np.log1p(-p) - np.log1p(-p0), 0.0), minlength=n)
        toxic = -np.expm1(clear)
        pull = np.where(y > 0, (1 - toxic) / toxic, -1.0)
        dz = np.where(adds, pull[doc_of] * p, 0.0)
        gradient = np.append(np.bincount(feature, dz[sentence_of], minlength=n_features), dz.sum() - (pull[doc_of] * adds).sum() * p0) / n
        gradient[:-1] -= decay * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


class _Judge:
    """Score and offending sentences of each text; weights of words are remembered for one task."""

    def __init__(self, model: Model):
        self.model, self.memory = model, {}

    def __call__(self, texts: pa.Array) -> pa.Array:
        let_go()
        out = []
        for value in texts.to_pylist():
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
            n, hits = self.model.sentence_scores(value or "", self.memory)
            places = [{"start": a, "end": b, "score": p} for a, b, p in hits if p >= THRESHOLD]
            out.append({"score": self.model.score(n, hits) if n else 0.0, "offending": places})
        return pa.array(out, _JUDGED)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add `score` (0 to 1) and `offending`: start, end and score of the sentences at or above the threshold.

    A null or empty text, or one without a word, has no sentence and scores zero. Texts are read whole, a slice of rows at a time;
    equal texts score equally. Other columns pass unchanged; those with the names of the new ones are replaced. The
    model is bounded by `FEATURES` and travels with the tasks. No shuffle.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "offending")]
    judged = with_column(docs, text, "_judged", from_arrow_type(_JUDGED), _Judge(model))
    return judged.select(*kept, F.col("_judged.score").alias("score"), F.col("_judged.offending").alias("offending"))
