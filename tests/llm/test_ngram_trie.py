import random
import re

import numpy as np
import pyarrow as pa
import pytest

from trialmill.llm import ngram_trie, queries
from trialmill.llm.shared import components


def grams(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def classes(rows, words, least):
    """Component of each row by comparing all pairs."""
    sets = [grams(t, words) for _, t, *_ in rows]
    low = [i for i, *_ in rows]
    top, bottom = least
    changed = True
    links = [
        (a, b)
        for a in range(len(rows))
        for b in range(a)
        if sets[a] and sets[b] and bottom * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted((i, len(s), c) for (i, *_), s, c in zip(rows, sets, low))


def corpus(n, seed):
    """Families of texts with edits in steps, so that links chain, and passages that many texts share."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40))
    passage = [word() for _ in range(25)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                t[rng.randrange(len(t))] = word()
        else:
            t = [word() for _ in range(rng.choice([1, 3, 8, 60, 150]))] + (passage if rng.random() < 0.4 else [])
        texts.append(t)
        rows.append((1000 - i, " ".join(t), "s"))
    return rows


@pytest.mark.parametrize(("words", "least", "block"), [(4, (85, 100), 400_000), (5, (4, 5), 400_000), (5, (4, 5), 300)])
def test_agrees_with_all_pairs(docs, monkeypatch, words, least, block):
    monkeypatch.setattr(ngram_trie, "BLOCK_GRAMS", block)
    rows = corpus(220, seed=words + block)
    got = ngram_trie.connect(docs(rows), words, least).select("doc_id", "n_shingles", "component_id").collect()
    want = classes(rows, words, least)
    assert sorted(map(tuple, got)) == want
    assert len({c for *_, c in want}) < len(want)


def test_hard_rows(docs):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [
        (5, None, "s"), (4, "", "s"), (3, " \n\t", "s"), (2, "One two", None), (1, "one  TWO", "s"), (9, long, "s"),
        (8, long + " end", "s"), (7, long, "s"), (7, long, "s"), (None, "one two", "s"), (6, "É x y z", "s"), (10, "é x y z", "s"),
    ]
    out = sorted(map(tuple, ngram_trie.connect(docs(rows), 4, (85, 100)).collect()))
    assert out == [
        (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 29_997, 7), (8, 29_998, 7), (9, 29_997, 7), (10, 1, 10),
    ]
    assert ngram_trie.connect(docs([])).count() == 0


def test_gram_sets_do_not_depend_on_chunks(monkeypatch):
    texts = pa.array(["a b c d e", None, "", "a  b\tc\nd e f", "x" * 3000, "q w e r t y"] * 3)
    whole = [s.tolist() for s in ngram_trie.gram_sets(texts, 3)]
    monkeypatch.setattr(ngram_trie, "CHUNK_BYTES", 10)
    assert [s.tolist() for s in ngram_trie.gram_sets(texts, 3)] == whole
    assert [s.tolist() for s in ngram_trie.gram_sets(texts.slice(2, 5), 3)] == whole[2:7]
    assert [len(s) for s in whole[:6]] == [3, 0, 0, 4, 1, 4] and set(whole[0]) <= set(whole[3])


def test_trie_counts_shared_paths():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(80)]
    sets += [s[:-1] for s in sets[:10] if len(s) > 1] + [sets[0], sets[1]]
    trie = ngram_trie.Trie(sets)
    for x in sets[:40]:
        has = np.zeros(60, bool)
        has[x] = True
        found, overlap = trie.overlaps(has, np.cumsum(has) - has, len(x), np.ones(len(sets), bool), (1, 2))
        got = {trie.order[k]: int(n) for k, n in zip(found, overlap)}
        for y, s in enumerate(sets):
            shared = len(np.intersect1d(x, s))
            if 2 * shared >= len(x) + len(s) - shared:
                assert got[y] == shared  # nothing that links is pruned
            assert got.get(y, shared) == shared


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 20)] + [(300 + k, 300 + (k + 1) % 7) for k in range(7)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100 + k: 100 for k in range(20)} | {300 + k: 300 for k in range(7)}


def test_stage_keeps_one_of_each_class(spark, docs):
    rows = corpus(120, seed=1) + [(2000, None, "s"), (2001, "", "s")]
    left = {r.doc_id for r in queries.drop_near_copies(spark, docs(rows), "").collect()}
    assert left == {c for *_, c in classes(rows, 5, (4, 5))}


def overlap_links(a, b, least):
    top, bottom = least
    shared = len(np.intersect1d(a, b))
    return bottom * shared >= top * (len(a) + len(b) - shared)


def sets_of_families(rng, families, members):
    """Sets of 64-bit grams, in families with different shares in common."""
    sets = []
    for size in families:
        whole = rng.integers(0, 1 << 63, size).astype(np.uint64)
        for _ in range(members):
            keep = whole[rng.random(size) > rng.choice([0.0, 0.02, 0.1, 0.4])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 10)).astype(np.uint64)])))
    return [s for s in sets if len(s)]


def test_texts_that_meet_by_chance_form_no_cluster(docs, monkeypatch):
    largest = []

    def watched(edges):
        found = components(edges)
        largest.append(max([0, *(r["count"] for r in found.groupBy("component").count().collect())]))
        return found

    monkeypatch.setattr(ngram_trie, "components", watched)
    # each text shares one half with the text before and one with the text after: a chain through all, without a link
    half = lambda k: [f"p{k}w{j}" for j in range(60)]
    rows = [(k, " ".join(half(k) + half(k + 1)), "s") for k in range(30)]
    rows.append((100, rows[7][1].replace("p8w30", "other"), "s"))
    out = sorted(map(tuple, ngram_trie.connect(docs(rows), 4, (85, 100)).select("doc_id", "n_shingles", "component_id").collect()))
    assert out == classes(rows, 4, (85, 100))
    assert dict((i, c) for i, _, c in out)[100] == 7
    assert max(largest) == 2


@pytest.mark.parametrize(("most", "least"), [(1 << 18, (85, 100)), (256, (4, 5)), (1 << 18, (1, 2))])
def test_sketches_never_part_what_links(monkeypatch, most, least):
    monkeypatch.setattr(ngram_trie, "SKETCH_BITS", most)
    sets = sets_of_families(np.random.default_rng(5), [1, 6, 30, 33, 200, 500, 1_100], 12)
    sketches = [np.frombuffer(ngram_trie._sketch(s), np.uint64) for s in sets]
    told = np.array([[ngram_trie.may_link(len(a), x, np.array([len(b)]), y[None], least)[0] for b, y in zip(sets, sketches)] for a, x in zip(sets, sketches)])
    links = np.array([[overlap_links(a, b, least) for b in sets] for a in sets])
    assert links.sum() > len(sets) and told[links].all()
    if most > 256:
        assert told.sum() < 1.5 * links.sum()


@pytest.mark.parametrize("chunks", [1, 4])
def test_meetings_connect_all_that_may_link(chunks):
    rng, least = np.random.default_rng(6), (85, 100)
    sets = sets_of_families(rng, [40, 45, 300, 300], 25)
    m = len(sets)
    sizes, sketches = np.array([len(s) for s in sets]), [np.frombuffer(ngram_trie._sketch(s), np.uint64) for s in sets]
    nodes, labels = rng.integers(-(1 << 62), 1 << 62, m), np.where(rng.random(m) < 0.4, 0, np.arange(m))
    links = []
    for mine in range(chunks):
        k = np.flatnonzero((labels != 0) | (nodes % chunks == mine))
        links += ngram_trie.meetings(nodes[k], labels[k], sizes[k], labels[k] != 0, [sketches[i] for i in k], (mine, chunks), least)

    def joined(pairs):
        of = {int(x): int(x) for x in labels}
        for a, b in pairs:
            of = {x: of[a] if c == of[b] else c for x, c in of.items()}
        return {frozenset(x for x, c in of.items() if c == d) for d in of.values()}

    every = [(int(labels[i]), int(labels[j])) for i in range(m) for j in range(m) if ngram_trie.may_link(sizes[i], sketches[i], sizes[j : j + 1], sketches[j][None], least)[0]]
    assert joined(links) == joined(every) and len(joined(every)) > 1


def test_agrees_with_all_pairs_in_small_meetings(docs, monkeypatch):
    monkeypatch.setattr(ngram_trie, "MEET_SETS", 3)
    monkeypatch.setattr(ngram_trie, "BLOCK_GRAMS", 300)
    rows = corpus(220, seed=77)
    got = ngram_trie.connect(docs(rows), 4, (85, 100)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == classes(rows, 4, (85, 100))
